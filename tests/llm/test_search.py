"""Ranked search against scoring every document for every item."""

import collections
import math
import random
import re

import numpy as np
import pytest
from plain import ODD_TEXTS
from pyspark.sql import functions as F

from veilwork.llm import search

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def plain(docs, items):
    counted = [(i, collections.Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scored = []
        for i, c in counted:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (
                1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if t in c)
            if score:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -score)
                for rank, (score, none, i) in enumerate(sorted(scored)[:10], 1)]
    return sorted(map(repr, out))


def got(df):
    return sorted(repr((r.item_id, r["rank"], r.doc_id, r.score)) for r in df.collect())


def zipf(n, seed, longest=120, vocabulary=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    chances = [1 / (i + 1) for i in range(vocabulary)]
    return [" ".join(rng.choices(words, chances, k=rng.randint(1, longest))) for _ in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_results_equal_scoring_everything(spark, monkeypatch, small):
    """Also with many small shards, small blocks and items searched in several rounds."""
    if small:
        for name, value in (("PAIRS", 60), ("SHARD_DOCS", 100), ("BLOCK", 4), ("KEPT", 200)):
            monkeypatch.setattr(search, name, value)
    texts = zipf(500, 1)
    docs = list(enumerate(texts)) + [(900 + i, texts[7]) for i in range(40)] + [(3, texts[7])] * 2
    items = [(i, t) for i, t in enumerate(zipf(12, 2, 25))] + [(50, texts[7]), (50, "w1 w2 W3"), (51, "nowhere")]
    found = search.ranked(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS))
    assert got(found) == plain(docs, items)


def test_odd_rows(spark):
    docs = list(enumerate(ODD_TEXTS)) + [(None, "a b c d"), (None, None), (2, "a B c"), (2, "a B c"),
                                         (70, "ünïcode-Wörter, Ünïcode"), (71, "x\x00y\x7fz")]
    items = [(1, "a b"), (None, "The of"), (None, "c"), (2, None), (3, ""), (4, "!?"), (5, "ünïcode wörter"),
             (6, "Ünïcode y"), (7, "日本語のテキスト line")]
    columns = {"item": F.lit("x"), "doc": F.lit(1), "n": F.lit(2), "score": F.lit(3), "rank": F.lit(4), "terms": F.lit("t")}
    found = search.ranked(spark.createDataFrame(docs, DOCS).withColumns(columns),
                          spark.createDataFrame(items, ITEMS).withColumns(columns))
    assert got(found) == plain(docs, items)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([(1, "a")], ITEMS)
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0)),
                 (spark.createDataFrame([(1, None)], DOCS), items)):
        found = search.ranked(d, i)
        assert found.count() == 0 and found.columns == ["item_id", "rank", "doc_id", "score"]


def _shard(texts, asked):
    """One shard and its items, with contributions that count occurrences."""
    words = sorted({w for t in asked for w in t.split()})
    items = search.Items(list(range(len(asked))), [np.array([words.index(w) for w in sorted(set(t.split()))], np.uint64)
                                                   for t in asked])
    rows = [collections.Counter(w for w in t.split() if w in words) for t in texts]
    place = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    term = np.array([words.index(w) for r in rows for w in sorted(r)], np.int64)
    value = np.array([r[w] * (1000 // (1 + words.index(w))) for r in rows for w in sorted(r)], np.int64)
    ids = np.arange(len(texts))
    return search.Shard(items, ids, np.zeros(len(texts), bool), place, term, value), rows


def test_summaries_are_maxima_and_lists_are_whole(monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 8)
    shard, _ = _shard(zipf(300, 3), zipf(6, 4, 20))
    dense = np.zeros((300, len(shard.items.vocabulary)), np.int64)
    dense[np.repeat(np.arange(300), np.diff(shard.place)), shard.term] = shard.value
    for term in range(dense.shape[1]):
        blocks = shard.blocks(term) if dense[:, term].any() else None
        if blocks:
            assert sorted(blocks.docs) == np.flatnonzero(dense[:, term]).tolist()
            assert np.diff(blocks.first).max() <= 16
            for b in range(len(blocks.first) - 1):
                inside = dense[blocks.docs[blocks.first[b]:blocks.first[b + 1]]]
                assert (blocks.summary[b] == inside[:, blocks.columns].max(axis=0)).all()


def test_blocks_are_skipped_and_nothing_is_lost(monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 8)
    texts = zipf(1500, 5)
    shard, rows = _shard(texts, [texts[11], "w200 w7 w150 w90"])
    dense = np.zeros((1500, len(shard.items.vocabulary)), np.int64)
    dense[np.repeat(np.arange(1500), np.diff(shard.place)), shard.term] = shard.value
    for q, wanted in enumerate(shard.items.terms):
        scores = dense[:, wanted].sum(axis=1)
        want = sorted((-int(s), False, i) for i, s in enumerate(scores) if s)[:10]
        assert shard.search(q, []) == want
    assert shard.skipped > 0


def test_length_factors_beyond_64_bits():
    n = np.array([1, 10 ** 9, 3 * 10 ** 9])
    assert search.length_factors(n, 10 ** 9, 10 ** 18).tolist() == [10 + 90 * int(x) * 10 ** 9 // 10 ** 18 for x in n]
