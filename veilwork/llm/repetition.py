"""Quality rules by repetition inside a text, found with suffix arrays.

Every text is a sequence of words.  Suffixes are sorted by prefix doubling, many
texts at a time; common-prefix lengths of neighbours in that order give the
longest repeat that starts at each word, hence the union of all maximal repeated
word sequences (four words or more) and the longest of them.  Texts of any
length are taken whole: memory is a fixed number of bytes a word, however much
repeats, time that times the logarithm of the longest repeat.  The work per text
is local to its row, so a hot source or a group of copies costs what its bytes cost.

Defined results: NULL and empty texts have no words, all counts 0 and fail the
base rule; repeated rows are judged alike; an empty table gives an empty table.
The operator adds columns and keeps those of its input; its own replace columns
of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .tables import arrow_map, filter_rows, read
from .words import Piece, pieces

#: The base rule: eight-word windows.
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: The method's own limits: repeats of this many words or more count, the share of a text's words that they may
#: cover, and the share of the words that the longest may have.
MIN_REPEAT = 4
MAX_COVERED = 0.30
MAX_LONGEST = 0.15
#: Places between those whose common prefixes are read one by one, and how many words are compared at once.
STRIDE = 1 << 10
COMPARED = 1 << 18

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
MEASURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
            "covered_words long, longest_repeat long")


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks of key tuples, equal for equal tuples and in their order."""
    out = np.unique(keys[0], return_inverse=True)[1].astype(np.int32)
    for key in keys[1:]:
        joint = out * np.int64(int(key.max(initial=0)) + 2) + (key + 1)
        out = np.unique(joint, return_inverse=True)[1].astype(np.int32)
    return out


def _ahead(rank: np.ndarray, at: np.ndarray, step: int, stop: np.ndarray) -> np.ndarray:
    """Rank of the suffix ``step`` words on, -1 beyond the end of the text."""
    to = at + step
    inside = to < stop[at]
    return np.where(inside, rank[np.where(inside, to, 0)], -1)


def _cover(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Flags of the places inside any of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge)[:n] > 0


def _common(words: np.ndarray, left: np.ndarray, right: np.ndarray, stop: np.ndarray, least: int) -> np.ndarray:
    """Words that the suffixes at ``left`` share with their predecessors in suffix order, at ``right``.

    ``left`` is ascending, and each pair shares at least ``least - 1`` words.  From
    one place of a text to the next the end of what is shared never moves back,
    whence two passes without further arrays: places ``STRIDE`` apart are read on
    from where the one before ended, and those between lie between the ends of
    their neighbours, half a stride at a time, so that each pass compares every
    word about once.
    """
    n, floor = len(words), least - 1
    partner = np.full(n, -1, np.int32)
    partner[left] = right
    limit = np.minimum(stop[left] - left, stop[right] - right)
    room = np.full(n, floor, np.int32)
    room[left] = limit
    end = np.empty(n + 1, np.int64)  # of what is shared, at places done so far
    end[n] = n + floor
    reached = 0
    for at in range(0, n, STRIDE):
        have = max(reached - at, floor)
        if partner[at] >= 0:
            other, most, look = int(partner[at]), int(room[at]), STRIDE
            while have < most:
                some = min(look, most - have)
                differ = words[at + have:at + have + some] != words[other + have:other + have + some]
                if differ.any():
                    have += int(differ.argmax())
                    break
                have, look = have + some, min(2 * look, 1 << 20)
        reached = end[at] = at + have
    step = STRIDE
    while step > 1:
        step //= 2
        at = np.arange(step, n, 2 * step)
        low, high = end[at - step], end[np.minimum(at + step, n)]
        have = np.maximum(low - at, floor)
        most = np.where(partner[at] >= 0, np.minimum(room[at], high - at), have)
        for a in range(0, len(at), COMPARED):  # as many places at once, each with what lies between its bounds
            part = slice(a, a + COMPARED)
            have[part] = _read_on(words, at[part], partner[at[part]], have[part], most[part])
        end[at] = at + have
    return end[left] - left


def _read_on(words: np.ndarray, at: np.ndarray, other: np.ndarray, have: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words are shared, of which ``have`` are known to be and more than ``most`` are not."""
    have, open_ = have.copy(), np.flatnonzero(have < most)
    look = 1
    while len(open_):
        width = np.minimum(look, most[open_] - have[open_])
        first = np.cumsum(width) - width
        ahead = np.arange(int(width.sum())) - np.repeat(first - have[open_], width)
        same = words[np.repeat(at[open_], width) + ahead] == words[np.repeat(other[open_], width) + ahead]
        wrong = np.flatnonzero(~same)
        nearest = np.searchsorted(wrong, first)
        miss = np.where(nearest < len(wrong), wrong[np.minimum(nearest, max(len(wrong) - 1, 0))] if len(wrong) else 0,
                        len(same)) - first
        have[open_] += np.minimum(miss, width)
        open_ = open_[(miss >= width) & (have[open_] < most[open_])]
        look = max(1, min(2 * look, COMPARED // max(len(open_), 1)))
    return have


def repeats(words: np.ndarray, first: np.ndarray, window: int = WINDOW,
            least: int = MIN_REPEAT) -> tuple[np.ndarray, np.ndarray]:
    """Words in repeated windows, and at each word the longest repeat starting there.

    ``words`` are word ids, text ``d`` has those at ``first[d]:first[d + 1]``.
    Repeats under ``least`` words count as none; it and ``window`` are powers of
    two, ``least`` the smaller.
    """
    n, counts = len(words), np.diff(first)
    longest = np.zeros(n, np.int32)
    if not n:
        return np.zeros(0, bool), longest
    stop = np.repeat(first[1:].astype(np.int32), counts)
    every = np.arange(n, dtype=np.int32)
    rank = _dense(np.repeat(np.arange(len(counts)), counts), words)

    def repeated(length: int) -> np.ndarray:
        return np.flatnonzero((np.bincount(rank)[rank] > 1) & (every + length <= stop)).astype(np.int32)

    step, active, shared = 1, repeated(least) if least == 1 else None, rank
    while step < window:
        rank = _dense(rank, _ahead(rank, every, step, stop))
        step *= 2
        if step == least:
            active, shared = repeated(least), rank
    full = repeated(window)
    twice = _cover(n, full, np.full(len(full), window))
    del full, every

    # Suffix order of the words where a repeat starts.  A group's rank is the place of its first member.
    size = np.bincount(rank)
    members = active[size[rank[active]] > 1]
    rank = (np.cumsum(size) - size).astype(np.int32)[rank]
    while len(members):
        after = _ahead(rank, members, step, stop)
        order = np.argsort((rank[members].astype(np.int64) << 32) + after, kind="stable")
        members, after = members[order], after[order]
        group = rank[members]
        head = np.concatenate([[True], group[1:] != group[:-1]])
        new = head | np.concatenate([[True], after[1:] != after[:-1]])
        at = np.arange(len(members), dtype=np.int32)
        since = at - np.maximum.accumulate(np.where(head, at, 0))
        sub = np.maximum.accumulate(np.where(new, at, 0))
        rank[members] = group + since[sub]
        step *= 2
        run = np.flatnonzero(new)
        length = np.diff(np.concatenate([run, [len(members)]]))
        members = members[np.repeat(length > 1, length)]

    order = active[np.argsort(rank[active], kind="stable")]
    left, right = order[1:], order[:-1]
    near = shared[left] == shared[right]
    left, right = left[near], right[near]
    by_place = np.argsort(left)
    left, right = left[by_place], right[by_place]
    del rank, shared, order, near, by_place
    common = _common(words, left, right, stop, least)
    np.maximum.at(longest, left, common)
    np.maximum.at(longest, right, common)
    return twice, longest


def _duplicate_lines(piece: Piece) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    bounds = np.unique(np.concatenate([np.flatnonzero(piece.buf == 10) + 1, piece.offsets]))
    starts, ends = bounds[:-1], bounds[1:].copy()
    ends -= piece.buf[ends - 1] == 10
    has_word = np.searchsorted(piece.starts, starts) < np.searchsorted(piece.starts, ends)
    starts, ends = starts[has_word], ends[has_word]
    text = np.searchsorted(piece.offsets, starts, "right") - 1
    key = pd.DataFrame({"text": text, "line": piece.spans(starts, ends)})
    return np.bincount(text[key.duplicated().to_numpy()], minlength=len(piece))


def measure(piece: Piece, least: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """The measures of each text of a piece."""
    edge = np.zeros(len(piece.buf) + 1, np.int8)
    edge[piece.starts] += 1
    edge[piece.ends] -= 1
    spaces = np.cumsum(edge[:-1], dtype=np.int8) == 0
    n = len(piece)
    ids = pd.factorize(piece.hashes())[0]
    twice, longest = repeats(ids, piece.first, least=least)
    covered = _cover(len(ids), np.flatnonzero(longest), longest[longest > 0])
    owner = piece.owner
    top = np.zeros(n, np.int64)
    np.maximum.at(top, owner, longest)
    return {
        "n_words": piece.n_words,
        "word_chars": piece.per_text(~spaces & ((piece.buf & 0xC0) != 0x80)),
        "n_symbols": piece.per_text(_SYMBOLS[piece.buf]),
        "n_dup_lines": _duplicate_lines(piece),
        "n_repeat_words": np.bincount(owner[twice], minlength=n),
        "covered_words": np.bincount(owner[covered], minlength=n),
        "longest_repeat": top,
    }


def judge(measures: dict[str, np.ndarray], max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST,
          min_words: int = MIN_WORDS) -> dict[str, np.ndarray]:
    """``base_failed`` and ``kept`` from the measures of texts.

    A text passes the base rule with at least ``min_words`` words of which at
    most 30 % lie in eight-word windows found twice or more.  It is kept if it
    also has at most the share ``max_covered`` of its words inside maximal
    repeats, and no repeat longer than the share ``max_longest`` of its words.
    """
    n = measures["n_words"]
    failed = (n < min_words) | (100 * measures["n_repeat_words"] > MAX_REPEAT_PERCENT * n)
    good = (measures["covered_words"] <= max_covered * n) & (measures["longest_repeat"] <= max_longest * n)
    return {"base_failed": failed, "kept": ~failed & good}


def repetition(docs: DataFrame, text: str = "text", min_repeat: int = MIN_REPEAT, **limits) -> DataFrame:
    """Add the measures, ``base_failed`` and ``kept`` to documents.

    Repeats of ``min_repeat`` words or more count (a power of two up to eight);
    ``limits`` are those of ``judge``.
    """
    added = StructType.fromDDL(f"{MEASURES}, base_failed boolean, kept boolean")
    docs = docs.drop(*added.names)
    at, names = docs.columns.index(text), docs.columns

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for piece in pieces(batch.column(at)):
            part = batch.slice(piece.rows.start, len(piece))
            measures = measure(piece, min_repeat)
            yield dict(zip(names, part.columns)) | measures | judge(measures, **limits)

    return arrow_map(docs, StructType([*docs.schema.fields, *added.fields]), work)


def good(docs: DataFrame, text: str = "text", min_repeat: int = MIN_REPEAT, **limits) -> DataFrame:
    """The documents that are kept, columns unchanged."""
    def keep(texts: pa.Array) -> np.ndarray:
        return np.concatenate([np.zeros(0, bool), *(
            judge(measure(piece, min_repeat), **limits)["kept"] for piece in pieces(texts))])

    return filter_rows(docs, text, keep)


def op5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return repetition(docs).drop("text")


QUERIES = {"op5_repetition": op5_repetition}

_words = r"[^\x20\x09-\x0D]+"
_following = ", ".join(f"lead(word, {k}) OVER following" for k in range(1, WINDOW))
#: Any word inside a repeat of four words or more is inside a repeated four-word window, and the other way round; the
#: longest repeat is the longest run of equal four-word windows at one distance from each other.
ORACLES = {"op5_repetition": rf"""WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_words}') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM t),
windows AS (
  SELECT doc_id, place, [word, {_following}] AS ws FROM words WINDOW following AS (PARTITION BY doc_id ORDER BY place)),
short AS (
  SELECT doc_id, place, gram FROM (SELECT doc_id, place, array_to_string(ws[:{MIN_REPEAT}], ' ') AS gram FROM windows
    WHERE ws[{MIN_REPEAT}] IS NOT NULL) QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
wide AS (
  SELECT doc_id, place FROM (SELECT doc_id, place, array_to_string(ws, ' ') AS gram FROM windows
    WHERE ws[{WINDOW}] IS NOT NULL) QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
covered AS (SELECT doc_id, count(DISTINCT place + k) AS n FROM short, range({MIN_REPEAT}) r(k) GROUP BY 1),
repeated AS (SELECT doc_id, count(DISTINCT place + k) AS n FROM wide, range({WINDOW}) r(k) GROUP BY 1),
pairs AS (
  SELECT a.doc_id, a.place, b.place - a.place AS apart,
    a.place - row_number() OVER (PARTITION BY a.doc_id, b.place - a.place ORDER BY a.place) AS run
  FROM short a JOIN short b ON a.doc_id = b.doc_id AND a.gram = b.gram AND a.place < b.place),
longest AS (
  SELECT doc_id, max(n) + {MIN_REPEAT - 1} AS n FROM (SELECT doc_id, count(*) AS n FROM pairs GROUP BY doc_id, apart, run)
  GROUP BY 1),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '{_words}') GROUP BY 1),
m AS (
  SELECT t.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(lines.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words,
    coalesce(covered.n, 0) AS covered_words, coalesce(longest.n, 0) AS longest_repeat
  FROM t LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN covered USING (doc_id)
    LEFT JOIN longest USING (doc_id))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT base_failed AND covered_words <= {MAX_COVERED}::DOUBLE * n_words AND longest_repeat <= {MAX_LONGEST}::DOUBLE * n_words
    AS kept FROM m"""}
