"""Digests of key ranges against comparing all rows."""

import random

import pytest
from pyspark.sql import functions as F

from veilwork import MaskSpec, apply_spec, run_log
from veilwork.operators import digests as dg
from veilwork.plans.publish import COMPLETED, compare_runs, digests_of


def plain(before, after, n_keys):
    def grouped(rows):
        out = {}
        for r in rows:
            out.setdefault(tuple(r[:n_keys]), []).append(r)
        return {k: sorted(map(repr, v)) for k, v in out.items()}

    old, new = grouped(before), grouped(after)
    return sorted(repr((*k, "missing" if k not in new else "added" if k not in old else "changed"))
                  for k in {*old, *new} if old.get(k) != new.get(k))


def found(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def damaged(rows, rng, key):
    out = [r for r in rows if rng.random() > 0.01]
    out = [(*r[:-1], None if rng.random() < 0.5 else "x") if rng.random() < 0.02 else r for r in out]
    return out + [(*key(rng), "new") for _ in range(3)] + out[:2]


@pytest.mark.parametrize("schema, key", [
    ("k long, v string", lambda rng: (rng.randrange(-5000, 5000),)),
    ("k string, v string", lambda rng: (None if rng.random() < 0.01 else f"k{rng.randrange(9999)}",)),
    ("k date, v string", lambda rng: (__import__("datetime").date(2000, 1, 1) + __import__("datetime").timedelta(rng.randrange(4000)),)),
    ("a int, b int, v string", lambda rng: (rng.randrange(40), rng.randrange(99))),
])
def test_named_rows_equal_all_differences(spark, monkeypatch, schema, key):
    """Missing, added, changed and repeated rows, NULLs among the keys; in few and in many ranges."""
    rng = random.Random(len(schema))
    rows = [(*key(rng), f"v{rng.randrange(9)}") for _ in range(600)]
    other = damaged(rows, rng, key)
    pk = [c.split()[0] for c in schema.split(", ")][:-1]
    before, after = spark.createDataFrame(rows, schema), spark.createDataFrame(other, schema)
    want = plain(rows, other, len(pk))
    for sampled in (dg.SAMPLED_KEYS, 20):
        monkeypatch.setattr(dg, "SAMPLED_KEYS", sampled)
        starts = dg.fit_ranges(before, pk[0])
        trees = [dg.digest_tree(df.repartition(3), pk, ["v"], starts) for df in (before, after)]
        ranges = dg.differing_ranges(*trees)
        assert found(dg.difference_rows(before, after, pk, before.columns, ranges)) == want
        assert dg.totals(trees[0])["n_rows"] == 600
        assert dg.differing_ranges(trees[0], dg.digest_tree(before.repartition(7), pk, ["v"], starts)) == []


def test_ranges_of_any_number_of_starts(spark):
    """Every key is in the range whose bounds hold it."""
    df = spark.range(-50, 4000).select("id")
    for n in (0, 1, 31, 32, 33, 900):
        starts = [str(4 * i) for i in range(n)]
        tree = dg.digest_tree(df, ["id"], [], starts).collect()
        assert sum(r.n_rows for r in tree) == 4050 and len(tree) == n + 1
        for r in tree:
            low, high = int(r.low) if r.low else -50, int(r.high) if r.high else 4000
            assert r.n_rows == high - low


def test_only_differing_ranges_are_read(spark, tmp_path):
    path = str(tmp_path / "sorted")
    spark.range(64_000).select("id", F.md5(F.col("id").cast("string")).alias("v")).repartitionByRange(16, "id").sortWithinPartitions(
        "id").write.parquet(path)
    before = spark.read.parquet(path)
    after = before.withColumn("v", F.when(F.col("id") == 31_000, F.lit("x")).otherwise(F.col("v")))
    starts = dg.fit_ranges(before, "id")
    assert len(starts) > 500
    trees = [dg.digest_tree(df, ["id"], [], starts) for df in (before, after)]
    ranges = dg.differing_ranges(*trees)
    assert len(ranges) == 1 and int(ranges[0][0]) <= 31_000 < int(ranges[0][1])
    some = before.where(dg.in_ranges("id", before.schema["id"].dataType, ranges))
    assert some.select(F.input_file_name()).distinct().count() == 1 and some.count() < 500
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id," in plan and "LessThan(id," in plan
    assert found(dg.difference_rows(before, after, ["id"], ["id", "v"], ranges)) == [repr((31_000, "changed"))]


def test_runs_are_compared_by_their_digests(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    base = spark.range(3000).select("id", F.concat(F.lit("n"), "id").alias("name"), (F.col("id") % 9).alias("part"))
    other = base.withColumn("part", F.when(F.col("id") == 77, F.lit(100)).otherwise(F.col("part"))).where("id <> 2500")
    spec = MaskSpec.from_dict({"salt": "s", "allowed": ["dev"], "tables": [
        {"name": "t", "pk": "id", "columns": [{"name": "name", "gen": {"type": "hash"}}]}]})
    for frame in (base, base.repartition(5), other):
        apply_spec(spark, spec, lambda name, now=frame: now, out, target="dev")
    runs = [r.run_id for r in run_log(spark, out).where(F.col("status") == COMPLETED).orderBy("updated_at").collect()]
    trees = [digests_of(spark, out, run, "t") for run in runs]
    assert dg.differing_ranges(trees[0], trees[1]) == [] and len(dg.differing_ranges(trees[0], trees[2])) == 2
    assert compare_runs(spark, out, spec.tables[0], *runs[:2]).count() == 0
    assert found(compare_runs(spark, out, spec.tables[0], runs[0], runs[2])) == [repr((2500, "missing")), repr((77, "changed"))]
    resalted = MaskSpec.from_dict({"salt": "other", "allowed": ["dev"], "tables": [
        {"name": "t", "pk": "id", "columns": [{"name": "name", "gen": {"type": "hash"}}]}]})
    apply_spec(spark, resalted, lambda name: base, out, target="dev")
    last = run_log(spark, out).where(F.col("status") == COMPLETED).orderBy(F.desc("updated_at")).first().run_id
    tree = digests_of(spark, out, last, "t")
    assert dg.differing_ranges(trees[0], tree, "kept") == [] and len(dg.differing_ranges(trees[0], tree)) == trees[0].count()
