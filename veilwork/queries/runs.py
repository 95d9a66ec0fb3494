"""Runs that publish: partitions, reports, estimates and runs that continue where the last one ended."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diff as d
from ..operators.writeback import update_partitions
from ..plans.publish import apply_spec, published
from ..plans.spec import MaskSpec
from ..storage import scratch_path
from ..streaming.stream import publish_batch, publish_stream, published_batches
from . import _sql as sql
from ._common import faker, lookup, rule, spec_of
from .sources import ORACLES as _SOURCES
from .sources import PRIORITY_BY_VALUE, RECENT, changes, reported, urgent

STEPS = ("1995-06-01", "1998-01-01")


def _by_status(spark: SparkSession, sf_dir: str) -> str:
    """The orders as a table with a partition per status."""
    place = scratch_path(spark, "orders-by-status")
    lookup(spark, sf_dir)("orders").write.partitionBy("o_orderstatus").parquet(place)
    return place


def _update_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of one status, written back into a table partitioned by status."""
    place = _by_status(spark, sf_dir)
    update_partitions(spark, place, changes(spark, sf_dir), ["o_orderkey"])
    return spark.read.parquet(place)


def _publish_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filtered run over a partitioned table, as a reader sees it."""
    place, out = _by_status(spark, sf_dir), scratch_path(spark, "published")
    spec = spec_of("orders", "o_orderkey", [faker("o_orderpriority", "email"), rule("o_custkey", "counter")],
                   source={"filter": f"o_orderstatus = 'O' AND {RECENT}"})
    apply_spec(spark, spec, lambda name: spark.read.parquet(place), out, target="testdata")
    return published(spark, out, "orders")


def _report_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a run as its writing jobs counted it; times as a check of their order."""
    found = apply_spec(spark, reported(), lookup(spark, sf_dir), scratch_path(spark, "published"), target="testdata")
    timed = (F.col("started_at") <= F.col("ended_at")) & (F.col("duration_ms") >= 0)
    return found.withColumn("timed", timed).drop("started_at", "ended_at", "duration_ms")


def _estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An analysed catalog table, plain files, and a computed frame, which has to be counted."""
    find, name = lookup(spark, sf_dir), f"estimated_{uuid.uuid4().hex}"
    place = scratch_path(spark, "analysed")
    find("customer").write.parquet(place)
    spark.catalog.createTable(name, path=place, source="parquet")
    try:
        spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS")
        return d.row_estimates({"customer": spark.table(name), "lineitem": find("lineitem"),
                                "recent": find("orders").where(RECENT)})
    finally:
        spark.sql(f"DROP TABLE {name}")


def _watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs over a growing table, each of which finds out by itself what is new."""
    out, orders = scratch_path(spark, "published"), lookup(spark, sf_dir)("orders")
    spec = spec_of("orders", "o_orderkey", [faker("o_orderpriority", "full_name"), rule("o_custkey", "counter")],
                   source={"watermark": "o_orderdate"})
    for arrived in (orders.where(f"o_orderdate < '{STEPS[0]}'"), orders.where(f"o_orderdate <= '{STEPS[1]}'"), orders):
        apply_spec(spark, spec, lambda name, now=arrived: now, out, target="testdata")
    return published(spark, out, "orders")


def _stream_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of orders of which a view names the ones to mask, and their originals; its first batch comes twice."""
    orders = lookup(spark, sf_dir)("orders")
    spec = spec_of("orders", "o_orderkey", [PRIORITY_BY_VALUE, rule("o_orderstatus", "hash")],
                   source={"type": "view", "name": "urgent"})
    find = lookup(spark, sf_dir, urgent=urgent(spark, sf_dir))
    incoming = spark.readStream.schema(orders.schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir)
    place, table = scratch_path(spark, "stream"), spec.tables[0]
    query = publish_stream(incoming, table, spec, find, f"{place}/out", f"{place}/state", available_now=True)
    query.awaitTermination()
    publish_batch(orders, 0, table, spec, find, f"{place}/out")
    return published_batches(spark, f"{place}/out", orders)


QUERIES = {
    "stream_view_mask": _stream_view,
    "update_partitions": _update_partitions,
    "publish_partitions": _publish_partitions,
    "run_report_full": _report_full,
    "row_estimates_stats": _estimates,
    "incremental_watermark": _watermark,
}

# ------------------------------------------------------------------------------

_types = {"c_name": "string", "o_orderpriority,o_custkey": "string,bigint", "s_name": "string", "n_name": "string"}
_type_case = " ".join(f"WHEN '{columns}' THEN '{types}'" for columns, types in _types.items())
_rows = " ".join(f"WHEN '{t}' THEN (SELECT count(*) FROM {t})" for t in ("customer", "orders", "supplier", "nation"))

ORACLES = {
    "stream_view_mask": _SOURCES["src_view_mask"],
    "update_partitions": _SOURCES["update_join"],
    "publish_partitions": sql.masked(
        "orders", "o_orderkey", {"o_orderpriority": sql.provider("email"), "o_custkey": sql.counter()},
        where="o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'"),
    "run_report_full": f"""SELECT table_name, columns, CASE columns {_type_case} END AS types, 'table' AS source,
        CASE table_name {_rows} END AS estimate, 'footers' AS estimated_from, selected, updated, retried, failed,
        duplicates_kept, unmatched, NULL::INTEGER AS partitions_written, true AS timed
      FROM ({_SOURCES["mask_report"]}) WHERE table_name <> 'TOTAL'""",
    "row_estimates_stats": "SELECT 'customer' AS table_name, count(*) AS n_rows, 'statistics' AS known_from FROM customer "
                           "UNION ALL SELECT 'lineitem', count(*), 'footers' FROM lineitem UNION ALL "
                           "SELECT 'recent', count(*), 'count' FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'",
    "incremental_watermark": _SOURCES["incremental_orders"],
}
