"""SimHash components against comparing all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from plain import ODD_TEXTS
from pyspark.sql import functions as F

from veilwork.llm import fingerprints as fp
from veilwork.llm.queries import QUERIES
from veilwork.llm.tables import Workspace
from veilwork.llm.words import pieces

SCHEMA = "doc_id long, text string"


def plain_mark(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(marks):
    """``marks``: (id or None, fingerprint); per row the smallest id it reaches."""
    distinct = sorted({m for _, m in marks})
    root = {m: m for m in distinct}

    def find(m):
        while root[m] != m:
            m = root[m]
        return m

    values = np.array(distinct, np.uint64)
    for i, m in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= 3):
            root[find(m)] = find(distinct[j])
    least = {}
    for i, m in marks:
        if i is not None:
            least[find(m)] = min(least.get(find(m), i), i)
    return sorted((repr((i, f"{m:016x}", least.get(find(m)))) for i, m in marks))


def expected(rows):
    return plain_components([(i, plain_mark(t)) for i, t in rows])


def got(df):
    return sorted(repr((r.doc_id, r.fingerprint, r.component_id)) for r in df.collect())


def texts(n, seed=5):
    """Texts of few words, so that many fingerprints are near, and copies changed in a word."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            words = rng.choice(out).split(" ")
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = rng.choices(vocabulary, k=rng.randint(30, 200))
        out.append(" ".join(words))
    return list(enumerate(out))


def test_marks_equal_spark_hashes(spark):
    """The library's hash is Spark's own ``xxhash64``."""
    words = ["a b c", "é ç x", ""]
    df = spark.createDataFrame([(w,) for w in words], "s string").select(F.xxhash64("s").alias("h"))
    assert [r.h for r in df.collect()] == [int(np.int64(np.uint64(xxhash.xxh64_intdigest(w.encode(), 42)))) for w in words]


def test_odd_texts(spark):
    rows = list(enumerate(ODD_TEXTS)) + [(None, "a b c d"), (None, None), (None, "only here and nowhere else"), (3, ""),
                                         (3, ""), (90, "A b C"), (91, "a  B\tc")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns(
        {"key": F.lit("x"), "fingerprint": F.lit(1), "label": F.lit(2), "least": F.lit(3)})
    assert got(fp.linked_fingerprints(df)) == expected(rows)


def test_pieces_and_chunks_do_not_matter(monkeypatch):
    monkeypatch.setattr(fp, "_CHUNK", 7)
    some = [t for t in ODD_TEXTS if t is None or len(t) < 500] + [t for _, t in texts(20)]
    found = np.concatenate([fp.simhash(p) for p in pieces(pa.array(some), lower=True, size=300)])
    assert found.tolist() == [plain_mark(t) for t in some]


@pytest.mark.parametrize("small", [False, True])
def test_components_equal_all_pairs(spark, monkeypatch, small):
    """With one shard, and with many shards, small leaves and cells of several blocks."""
    if small:
        for name, value in (("SHARD", 64), ("SAMPLED", 8), ("CELL", 50), ("_LEAF", 4), ("_COMPARED", 64)):
            monkeypatch.setattr(fp, name, value)
    rows = texts(700)
    want = expected(rows)
    assert len({w.split(",")[-1] for w in want}) < 650
    assert got(fp.linked_fingerprints(spark.createDataFrame(rows, SCHEMA).repartition(4))) == want


def test_edges_of_crowded_fingerprints(spark, monkeypatch):
    """Thousands of fingerprints around few centres, chains, and many that share a half."""
    for name, value in (("SHARD", 256), ("SAMPLED", 16), ("CELL", 700)):
        monkeypatch.setattr(fp, name, value)
    rng = np.random.default_rng(8)
    centers = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    marks = rng.choice(centers, 2500)
    for _ in range(5):
        marks = marks ^ (np.uint64(1) << rng.integers(0, 64, len(marks), dtype=np.uint64))
    shared = (rng.integers(0, 1 << 32, 1500, dtype=np.uint64) << np.uint64(32)) | np.uint64(7)
    distinct = np.unique(np.concatenate([marks, shared, centers]))
    reps = spark.createDataFrame([(int(m),) for m in distinct.view(np.int64)], "fingerprint long")
    work = Workspace(spark, "test")
    labels = {r.node: r.label for r in fp.components(fp._edges(reps, work), work, "c").collect()}
    want = plain_components([(int(i), int(m)) for i, m in enumerate(distinct)])
    parts = {}
    for i, m in enumerate(distinct.view(np.int64).tolist()):
        parts.setdefault(labels.get(m, m), []).append(i)
    assert sorted(repr((i, f"{int(distinct[i]):016x}", min(p))) for p in parts.values() for i in p) == want


def test_shards_keep_what_is_near():
    """Whatever lies within reach of a value is in one of the shards that its reach touches."""
    rng = np.random.default_rng(9)
    values = rng.integers(0, 1 << 32, 3000, dtype=np.uint32)
    tree = fp.Shards(np.sort(values), 40)
    assert tree.count > 30
    moved = values ^ (np.uint32(1) << rng.integers(0, 32, len(values), dtype=np.uint32))
    home = np.empty(len(values), int)
    for shard, at in tree.reached(values, 0):
        home[at] = shard
    seen = {(shard, int(i)) for shard, at in tree.reached(moved, fp.REACH) for i in at}
    assert all((home[i], i) in seen for i in range(len(values)))
    assert len(seen) < tree.count * len(values) / 2


def test_empty_table(spark):
    out = fp.linked_fingerprints(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and out.columns == ["doc_id", "fingerprint", "component_id"]


def test_query_equals_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(QUERIES["op12_vantage_point_simhash"](spark, sf)) == expected(rows)
