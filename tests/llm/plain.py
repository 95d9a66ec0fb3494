"""Plain versions of what the operators compute, for small inputs."""

from __future__ import annotations

import collections
import math
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Texts that are odd in some way; the very long one has one word of 30,000 characters.
ODD_TEXTS = [
    None, "", "   ", "\n\n", "word", "a b c d", "a b c d", "one two three four five", "é ç　x y\x1c z",
    "<|endoftext|> it's 's", "tab\tline\nline\nline\n line\n", "日本語のテキスト 😀", "! ? . ,", "x " * 6000,
    "y" * 30000, "The and of to in a is that for it as was with be by on not he i this are",
]


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def repetition(text: str | None, least: int = 4) -> dict:
    w = words(text)
    n = len(w)

    def cover(spans):
        flags = [False] * n
        for a, b in spans:
            flags[a:b] = [True] * (b - a)
        return sum(flags)

    windows = collections.Counter(tuple(w[i:i + 8]) for i in range(n - 7))
    longest = [0] * n
    places = collections.defaultdict(list)
    for i in range(n - least + 1):
        places[tuple(w[i:i + least])].append(i)
    for group in places.values():
        for a in group:
            for b in group:
                if a < b:
                    k = least
                    while b + k < n and w[a + k] == w[b + k]:
                        k += 1
                    longest[a], longest[b] = max(longest[a], k), max(longest[b], k)
    lines = [x for x in (text or "").split("\n") if words(x)]
    return {
        "n_words": n, "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": cover([(i, i + 8) for i in range(n - 7) if windows[tuple(w[i:i + 8])] > 1]),
        "covered_words": cover([(i, i + k) for i, k in enumerate(longest)]), "longest_repeat": max(longest, default=0)}


def near_duplicates(texts: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    """Smallest id of the class and number of links, for distinct ids."""
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = collections.Counter()
    ids = sorted(texts)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            both = len(sets[i] & sets[j])
            if both and 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (find(i), links[i]) for i in ids}


def base_scores(texts: dict[int, str | None], training: set[int]) -> dict[int, tuple[int, int, int, float]]:
    tokens = {i: (t or "").encode().lower().split() + [None] for i, t in texts.items()}
    counts = collections.Counter(w for i in training for w in tokens[i])
    total = sum(counts.values())
    return {i: (len(w), sum(counts[x] > 0 for x in w), total,
                sum(math.log10((counts[x] + 1) / (total + len(counts) + 1)) for x in w)) for i, w in tokens.items()}


def viterbi(unit: str, pieces: dict[str, tuple[int, float]], unknown: float) -> list[int]:
    """Ids of the best path; characters that are no piece as their code points below zero."""
    best = [(0.0, 0, 0)]
    for end in range(1, len(unit) + 1):
        found = None
        for start in range(end):
            piece = unit[start:end]
            if piece in pieces:
                i, s = pieces[piece]
            elif end - start == 1:
                i, s = -1 - ord(piece), unknown
            else:
                continue
            if found is None or best[start][0] + s > found[0]:
                found = (best[start][0] + s, start, i)
        best.append(found)
    ids, at = [], len(unit)
    while at:
        ids.append(best[at][2])
        at = best[at][1]
    return ids[::-1]
