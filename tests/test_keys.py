"""Composite keys and inclusions against trying everything."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from veilwork.operators import discover, keys


def plain_keys(rows, names, largest):
    found = []
    for size in range(1, largest + 1):
        for chosen in combinations(range(len(names)), size):
            values = [tuple(r[i] for i in chosen) for r in rows]
            if any(set(f) <= set(chosen) for f in found) or any(None in v for v in values):
                continue
            if len(set(values)) == len(values):
                found.append(chosen)
    return {tuple(names[i] for i in f) for f in found}


def counts_of(df):
    return {r.column_name: (r.n_rows, r.n_values, r.n_distinct) for r in discover.discover_keys({"t": df}).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_minimal_keys_equal_trying_all_sets(spark, monkeypatch, seed):
    """With and without a sample, on columns of few and many values, some with NULLs."""
    rng = random.Random(seed)
    domains = [2, 3, 5, 7, 12, 40]
    rows = [tuple(None if k == 3 and rng.random() < 0.02 else rng.randrange(d) if k % 2 else str(rng.randrange(d))
                  for k, d in enumerate(domains)) for _ in range(120)]
    names = [f"c{k}" for k in range(len(domains))]
    df = spark.createDataFrame(rows, ", ".join(f"c{k} {'int' if k % 2 else 'string'}" for k in range(len(domains))))
    want = plain_keys(rows, names, 4)
    assert set(keys.minimal_keys(df, counts_of(df), 4)) == want
    monkeypatch.setattr(keys, "SAMPLE_ROWS", 10)
    monkeypatch.setattr(keys, "SETS_AT_ONCE", 3)
    assert set(keys.minimal_keys(df, counts_of(df), 4)) == want


def test_small_products_are_not_read(spark, monkeypatch):
    """Columns with too few values between them are no key, which their counts alone tell."""
    df = spark.range(100).select((F.col("id") % 5).alias("a"), (F.col("id") % 7).alias("b"), (F.col("id") % 25).alias("c"),
                                 F.floor(F.col("id") / 25).alias("d"))
    asked = []
    real = keys.unique_sets
    monkeypatch.setattr(keys, "unique_sets", lambda df, n, sets: asked.extend(sets) or real(df, n, sets))
    assert keys.minimal_keys(df, counts_of(df), 3) == [("b", "c"), ("c", "d"), ("a", "b", "d")]
    assert ("a", "b") not in asked and ("b", "c") in asked
    assert not any({"c", "d"} < set(s) for s in asked)


def _counted(monkeypatch):
    """Rows of which digests are counted, call by call."""
    counted, real = [], keys._repeated
    monkeypatch.setattr(keys, "_repeated", lambda values, sets: counted.append(values.count()) or real(values, sets))
    return counted


def test_whole_tables_are_counted_by_one_hash_a_value(spark, monkeypatch):
    """Digests are counted only of rows whose hash comes twice, here the two with a repeated value."""
    counted = _counted(monkeypatch)
    df = spark.range(2000).select((F.col("id") % 50).alias("a"), F.floor(F.col("id") / 50).alias("b"), F.when(
        F.col("id") == 1999, 0).otherwise(F.floor(F.col("id") / 50)).alias("c"))
    sets = {("a", "b"): ("a", "b"), ("a", "c"): ("a", "c")}
    assert keys.unique_sets(df, 2000, sets) == {("a", "b")} and counted == [2]
    assert keys.unique_sets(df.select("a", "b"), 2000, {("a", "b"): ("a",)}) == {("a", "b")} and counted == [2]


def test_sets_share_the_rows_drawn(spark, monkeypatch):
    """Rows are drawn by the values of a column that sets have in common; larger samples see only the sets left."""
    monkeypatch.setattr(keys, "SAMPLE_ROWS", 40)
    counted = _counted(monkeypatch)
    df = spark.range(4000).select((F.col("id") % 1000).alias("a"), (F.col("id") % 8).alias("b"), (F.col("id") % 2).alias("c"),
                                  F.floor(F.col("id") / 1000).alias("d"))
    sets = {("a", "b"): ("a",), ("a", "c"): ("a",), ("a", "d"): ("a",)}
    assert keys.unique_sets(df, 4000, sets) == {("a", "d")}
    assert len(counted) == 2 and counted[0] % 12 == 0 and 0 < counted[0] < 400 and counted[1] % 4 == 0 and counted[1] < 1500


def test_columns_that_rows_are_drawn_by():
    distinct = {"a": 3, "b": 5000, "c": 900}
    assert keys._drawn_by(("a", "b", "c"), distinct, 1 << 20) == ("b",)
    assert keys._drawn_by(("a", "b", "c"), distinct, 1 << 30) == ("b", "c")
    assert keys._drawn_by(("a", "c"), distinct, 1 << 40) == ("c", "a")


def test_conversations_have_a_key_of_two_columns(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    found = keys.discover_composite_keys({"conversations": df}, discover.discover_keys({"conversations": df}))
    assert ("conv_id,turn", 2) in [(r.columns, r.n_columns) for r in found.collect()]


def test_empty_table_has_no_key(spark):
    df = spark.createDataFrame([], "a int, b string")
    assert keys.minimal_keys(df, counts_of(df), 3) == []
    assert keys.find_keys({"t": df}) == {}


def test_find_keys_agrees_with_the_counts(spark):
    tables = {
        "first": spark.range(9).select("id", F.lit(1).alias("one")),
        "later": spark.range(9).select((F.col("id") % 2).alias("a"), F.when(F.col("id") > 0, F.col("id")).alias("gap"), "id"),
        "none": spark.range(9).select((F.col("id") % 2).alias("a"), F.col("id").cast("double").alias("d"))}
    want = {r.table_name: r.column_name for r in discover.discover_keys(tables).where("is_key").collect()}
    assert keys.find_keys(tables) == want == {"first": "id", "later": "id"}
    tables["unread"] = spark.range(1).select(F.raise_error(F.lit("read")).cast("int").alias("id"))
    assert keys.find_keys(tables, {"unread": "id"})["unread"] == "id"


def test_inclusions_equal_trying_all_pairs(spark):
    """Hot values, NULLs, integers of several widths, and more columns than a long has bits."""
    rng = random.Random(4)
    tables, values = {}, {}
    for t in range(10):
        columns, data = [], []
        for c in range(8):
            kind = rng.choice(["int", "bigint", "string"])
            pool = rng.sample(range(12), rng.randint(1, 6))
            column = [None if rng.random() < 0.1 else 3 if rng.random() < 0.4 and 3 in pool else rng.choice(pool) for _ in range(30)]
            columns.append(f"c{c} {kind}")
            data.append([str(v) if kind == "string" and v is not None else v for v in column])
            found = {("s" if kind == "string" else "i", v) for v in column if v is not None}
            values[f"t{t}", f"c{c}"] = found
        tables[f"t{t}"] = spark.createDataFrame(list(zip(*data)), ", ".join(columns))
    want = {(*a, *b, len(values[a])) for a in values for b in values if a != b and values[a] and values[a] <= values[b]}
    found = keys.discover_inclusions(tables).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want) > 100


def test_references_by_value_need_no_names(spark):
    people = spark.range(50).select((F.col("id") * 3).alias("person_no"), F.lit("x").alias("note"))
    things = spark.range(80).select(F.col("id").alias("thing"), ((F.col("id") % 50) * 3).cast("int").alias("owner"))
    tables = {"people": people, "things": things}
    assert discover.fk_candidates(tables, {"people": "person_no", "things": "thing"}) == []
    found = keys.references_by_value(keys.discover_inclusions(tables), keys.find_keys(tables))
    assert found == [("things", "owner", "people", "person_no")]
    assert [r.holds for r in discover.verify_references(tables, found).collect()] == [True]


def test_described_columns(spark):
    tables = {"p": spark.range(5).select("id", F.lit("a").alias("v")), "c": spark.range(5).select(
        F.col("id").alias("n"), (F.col("id") % 2).alias("p_id"), F.array("id").alias("list"))}
    references = discover.verify_references(tables, [("c", "p_id", "p", "id")])
    rows = {(r.table_name, r.column_name): r for r in discover.describe_columns(
        tables, discover.discover_keys(tables), references).collect()}
    assert rows["p", "id"].is_key and not rows["p", "v"].is_unique and rows["c", "p_id"].is_fk
    assert rows["c", "list"].has_nulls is None and not rows["c", "list"].is_key and rows["c", "list"].position == 2


def test_inclusions_shuffle_values_once(spark):
    tables = {t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("nation", "orders", "customer")}
    plan = keys.discover_inclusions(tables)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(v#") == 1 and "Join" not in plan
