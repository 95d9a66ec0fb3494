"""Vector codes against a plain Lloyd over integers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilwork.llm import codes
from veilwork.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label string"


def plain(rows):
    """Codes, errors and codebooks by comparing every part with every entry."""
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], label) for i, v, label in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // 8
    cut = [[tuple(v[p * width:(p + 1) * width]) for p in range(8)] for _, v, _ in kept]
    books = [[cut[k][p] for k in range(min(16, len(kept)))] for p in range(8)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(6):
        for p in range(8):
            members = {}
            for row in cut:
                members.setdefault(near(row[p], books[p])[1], []).append(row[p])
            for e, xs in members.items():
                books[p][e] = tuple(sum(c) // len(xs) for c in zip(*xs))
    out = []
    for (i, _, label), row in zip(kept, cut):
        found = [near(row[p], books[p]) for p in range(8)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    by_label = {}
    for _, label, _, error in out:
        by_label[label] = by_label.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted((repr((i, code, error, by_label[label], digest)) for i, label, code, error in out))


def got(df):
    return sorted(repr((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256)) for r in df.collect())


def rows_of(n, length=16, seed=1):
    rng = np.random.default_rng(seed)
    spread = rng.normal(size=(5, length))
    v = (spread[rng.integers(0, 5, n)] + 0.3 * rng.normal(size=(n, length))).astype(np.float32)
    return [(i, [float(x) for x in v[i]], f"l{i % 3}") for i in range(n)]


@pytest.mark.parametrize("n", [1, 7, 16, 400])
def test_codes_equal_a_plain_version(spark, n):
    rows = rows_of(n)
    assert got(codes.vector_codes(spark.createDataFrame(rows, SCHEMA).repartition(3))) == plain(rows)


def test_blocks_do_not_matter(spark, monkeypatch):
    rows = rows_of(300, seed=2)
    monkeypatch.setattr(codes, "BLOCK_ROWS", 37)
    assert got(codes.vector_codes(spark.createDataFrame(rows, SCHEMA).coalesce(2))) == plain(rows)


def test_odd_vectors(spark):
    """Unusable vectors go; repeated rows, ties, NULL ids and labels and a hot vector stay."""
    rows = rows_of(40, 8) + [
        (50, None, "x"), (51, [], "x"), (52, [None] * 8, "x"), (53, [float("nan")] * 8, "x"),
        (54, [float("inf")] + [0.0] * 7, "x"), (None, [0.5] * 8, None), (60, [1.0, -1.0] * 4, None),
        (60, [-1.0, 1.0] * 4, "l1"), (61, [0.0] * 8, "l1"), (61, [0.0] * 8, "l1"), (3, [0.25] * 8, "l2")]
    rows += [(100 + i, [0.125] * 8, "hot") for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns(
        {"code": F.lit("mine"), "error": F.lit(1), "of": F.lit(2), "id": F.lit(3), "vector": F.lit("v")})
    assert got(codes.vector_codes(df)) == plain(rows)


def test_empty_table(spark):
    out = codes.vector_codes(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert codes.vector_codes(spark.createDataFrame([(1, None, "a")], SCHEMA)).count() == 0


def test_lengths_and_range_are_checked(spark):
    with pytest.raises(ValueError, match="multiple"):
        codes.vector_codes(spark.createDataFrame([(1, [0.0] * 9, "a")], SCHEMA))
    with pytest.raises(Exception, match="out of range"):
        codes.vector_codes(spark.createDataFrame([(1, [1e9] * 8, "a")], SCHEMA))


def test_cover_tree_holds_its_bounds():
    """Ranges nest, radii bound what is below, and siblings' centres are apart."""
    points = np.unique(np.random.default_rng(3).integers(-300, 300, (900, 4)), axis=0)
    order, nodes = codes.cover_tree(points)
    assert sorted(order) == list(range(len(points)))
    for node in nodes:
        inside = points[order[node["start"]:node["end"]]]
        off = np.sqrt(((inside - points[node["center"]]) ** 2).sum(axis=1))
        assert off.max() <= node["radius"] + 1e-9
        below = nodes[node["child"]:node["child"] + node["children"]]
        if len(below):
            assert below["start"][0] == node["start"] and below["end"][-1] == node["end"]
            assert (below["start"][1:] == below["end"][:-1]).all()
        else:
            assert len(inside) <= codes.LEAF or node["radius"] == 0


def test_clear_subtrees_are_not_compared_point_by_point():
    rng = np.random.default_rng(4)
    rows = np.concatenate([rng.integers(0, 40, (500, 4)) + 1000 * k for k in range(4)])
    (start, end, _), (single, _) = codes.Tree.of(rows).settle(np.array([[1000 * k + 20] * 4 for k in range(4)]))
    assert (end - start).sum() + len(single) == len(np.unique(rows, axis=0))
    assert len(single) == 0 and len(start) < 100


def test_query_covers_the_table(spark):
    out = QUERIES["op11_cover_tree_codes"](spark, "/root/testdata/sf0.001")
    assert out.count() == spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
