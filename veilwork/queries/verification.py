"""Checks of masked tables against their inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import digests as dg
from ..operators import verify as v
from ..operators.mask import MaskedTable
from . import _sql as sql
from ._common import faker, lookup, masked, rule, spec_of

COLUMNS = [faker("c_name", "full_name"), {"name": "c_mktsegment", "gen": {"type": "hash"}, "seed_by": "value"}]
BY_VALUE = [faker("c_name", "email", seed_by="value")]


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region codes redrawn from a small domain: some come out as they were."""
    orders = lookup(spark, sf_dir)("orders")
    spec = spec_of("orders", "o_orderkey", [rule("o_orderstatus", "constant", value="F"),
                                            rule("o_orderpriority", "hash")])
    out = MaskedTable(orders, spec.tables[0], spec).output()
    return v.leaks(orders, out, ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


def _determinism(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As stored, spread by key, and in ranges against the key order."""
    customer = lookup(spark, sf_dir)("customer")
    spec = spec_of("customer", "c_custkey", COLUMNS)
    layouts = [customer, customer.repartition("c_custkey"), customer.repartitionByRange(F.desc("c_custkey"))]
    return v.determinism([MaskedTable(df, spec.tables[0], spec).output() for df in layouts])


def _consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same names, masked in their table and in a second table that repeats them."""
    find = lookup(spark, sf_dir)
    repeated = find("orders").join(find("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "o_custkey", "c_name")
    other = spec_of("order_names", "o_orderkey", BY_VALUE)
    there = MaskedTable(repeated, other.tables[0], other).output()
    here = masked(spark, sf_dir, "customer", "c_custkey", BY_VALUE).output().select(
        "c_custkey", F.col("c_name").alias("mask"))
    return v.consistency(there.join(here, F.col("o_custkey") == F.col("c_custkey")), "c_name", "mask")


def _mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = lookup(spark, sf_dir)("customer")
    after = masked(spark, sf_dir, "customer", "c_custkey", COLUMNS).output()
    return v.value_mapping(before, after, ["c_custkey"], "c_mktsegment")


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References after masking both sides, and against a part of the parents."""
    orders = masked(spark, sf_dir, "orders", "o_orderkey", [rule("o_orderpriority", "hash")]).output()
    customer = masked(spark, sf_dir, "customer", "c_custkey", COLUMNS).output()
    whole = v.orphans(orders, "o_custkey", customer, "c_custkey").withColumn("parents", F.lit("all"))
    some = v.orphans(orders, "o_custkey", customer.where("c_acctbal > 0"), "c_custkey").withColumn(
        "parents", F.lit("in credit"))
    return whole.unionByName(some)


def _salt(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, other = (masked(spark, sf_dir, "customer", "c_custkey", [rule("c_name", "hash")], salt=s).output()
                  for s in ("salt", "pepper"))
    return v.salt_sensitivity(one, other, ["c_custkey"], "c_name")


def _untouched(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = lookup(spark, sf_dir)("customer")
    after = masked(spark, sf_dir, "customer", "c_custkey", COLUMNS).output()
    return v.untouched(before, after, ["c_custkey"], ["c_name", "c_mktsegment"])


# The same checks on damaged results: what they report must be the damage.


def _leaks_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks undone on every fifth key, every seventh row lost, every third repeated under a new key."""
    orders = lookup(spark, sf_dir)("orders")
    out = masked(spark, sf_dir, "orders", "o_orderkey", [rule("o_orderpriority", "hash")]).output()
    undone = out.drop("o_orderpriority").join(orders.select("o_orderkey", F.col("o_orderpriority").alias("was")), "o_orderkey").join(
        out.select("o_orderkey", "o_orderpriority"), "o_orderkey").withColumn(
        "o_orderpriority", F.when(F.col("o_orderkey") % 5 == 0, F.col("was")).otherwise(F.col("o_orderpriority")))
    added = undone.where("o_orderkey % 3 = 0").withColumn("o_orderkey", -1 - F.col("o_orderkey"))
    return v.leaks(orders, undone.where("o_orderkey % 7 <> 0").unionByName(added), ["o_orderkey"], ["o_orderpriority"])


def _determinism_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = masked(spark, sf_dir, "customer", "c_custkey", COLUMNS).output()
    other = one.withColumn("c_name", F.when(F.col("c_custkey") % 9 == 0, F.concat("c_name", F.lit("?"))).otherwise(F.col("c_name")))
    return v.determinism([one, other])


def _untouched_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = lookup(spark, sf_dir)("customer")
    after = masked(spark, sf_dir, "customer", "c_custkey", COLUMNS).output()
    after = after.withColumn("c_acctbal", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")))
    return v.untouched(before, after, ["c_custkey"], ["c_name", "c_mktsegment"])


def _difference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a damaged copy, found by the digests of its key ranges: only ranges that differ are compared by row."""
    after = masked(spark, sf_dir, "customer", "c_custkey", COLUMNS).output()
    key, some = F.col("c_custkey"), F.col("c_custkey") % 100 < 20
    damaged = after.where(~(some & (key % 7 == 0))).withColumn(
        "c_acctbal", F.when(some & (key % 5 == 0), -F.lit(1.5)).otherwise(F.col("c_acctbal")))
    damaged = damaged.unionByName(after.where(key % 90 == 0).withColumn("c_custkey", -key - 1))
    starts = dg.fit_ranges(after, "c_custkey")
    trees = [dg.digest_tree(df, ["c_custkey"], ["c_name", "c_mktsegment"], starts) for df in (after, damaged)]
    return dg.difference_rows(after, damaged, ["c_custkey"], after.columns, dg.differing_ranges(*trees))


def _salt_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, other = (masked(spark, sf_dir, "customer", "c_custkey", [rule("c_name", "hash")], salt=s).output()
                  for s in ("salt", "pepper"))
    mixed = other.where("c_custkey % 5 <> 0").unionByName(one.where("c_custkey % 5 = 0"))
    return v.salt_sensitivity(one, mixed.where("c_custkey % 6 <> 0"), ["c_custkey"], "c_name")


QUERIES = {
    "verify_leaks_damaged": _leaks_damaged,
    "verify_determinism_damaged": _determinism_damaged,
    "verify_untouched_damaged": _untouched_damaged,
    "verify_salt_damaged": _salt_damaged,
    "verify_difference_rows": _difference_rows,
    "verify_leaks": _leaks,
    "verify_determinism": _determinism,
    "verify_consistency": _consistency,
    "verify_value_mapping": _mapping,
    "verify_orphans": _orphans,
    "verify_salt": _salt,
    "verify_untouched": _untouched,
}

ORACLES = {
    "verify_leaks": "SELECT 'o_orderstatus' AS column_name, count(*) AS n_rows, "
                    "count(*) FILTER (WHERE o_orderstatus = 'F') AS n_unchanged, 0::BIGINT AS n_missing, "
                    "0::BIGINT AS n_added FROM orders UNION ALL SELECT 'o_orderpriority', count(*), 0, 0, 0 FROM orders",
    "verify_leaks_damaged": "SELECT 'o_orderpriority' AS column_name, count(*) FILTER (WHERE o_orderkey % 7 <> 0) AS n_rows, "
                            "count(*) FILTER (WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 = 0) AS n_unchanged, "
                            "count(*) FILTER (WHERE o_orderkey % 7 = 0) AS n_missing, "
                            "count(*) FILTER (WHERE o_orderkey % 3 = 0) AS n_added FROM orders",
    "verify_determinism_damaged": "SELECT 1 AS run, count(*) FILTER (WHERE c_custkey % 9 = 0) AS n_only_before, "
                                  "count(*) FILTER (WHERE c_custkey % 9 = 0) AS n_only_after FROM customer",
    "verify_untouched_damaged": "SELECT true AS same_schema, count(*) FILTER (WHERE c_custkey % 4 = 0) AS n_only_before, "
                                "count(*) FILTER (WHERE c_custkey % 4 = 0) AS n_only_after FROM customer",
    "verify_difference_rows": "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'missing' ELSE 'changed' END AS problem "
                              "FROM customer WHERE c_custkey % 100 < 20 AND (c_custkey % 7 = 0 OR c_custkey % 5 = 0) "
                              "UNION ALL SELECT -c_custkey - 1, 'added' FROM customer WHERE c_custkey % 90 = 0",
    "verify_salt_damaged": "SELECT count(*) FILTER (WHERE c_custkey % 6 <> 0) AS n_rows, "
                           "count(*) FILTER (WHERE c_custkey % 6 <> 0 AND c_custkey % 5 = 0) AS n_equal, "
                           "count(*) FILTER (WHERE c_custkey % 6 = 0) AS n_unpaired FROM customer",
    "verify_determinism": "SELECT run::INTEGER AS run, 0::BIGINT AS n_only_before, 0::BIGINT AS n_only_after "
                          "FROM (VALUES (1), (2)) t(run)",
    "verify_consistency": "SELECT count(*) AS n_pairs, 0::BIGINT AS n_different FROM orders "
                          "JOIN customer ON o_custkey = c_custkey",
    "verify_value_mapping": f"SELECT c_mktsegment AS original, {sql.value_seed('c_mktsegment')} AS mask, "
                            f"count(*) AS n_rows FROM customer GROUP BY 1, 2",
    "verify_orphans": "SELECT 'all' AS parents, count(*) AS n_orphans FROM orders "
                      "WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL "
                      "SELECT 'in credit', count(*) FROM orders "
                      "WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
    "verify_salt": "SELECT count(*) AS n_rows, 0::BIGINT AS n_equal, 0::BIGINT AS n_unpaired FROM customer",
    "verify_untouched": "SELECT true AS same_schema, 0::BIGINT AS n_only_before, 0::BIGINT AS n_only_after",
}
