"""Writing changes back into a partitioned table: only partitions that hold a changed row are written again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..sources.layout import in_partitions, partitioning, partitions_of
from .mask import update_join


class LayoutError(ValueError):
    """The table's folders do not allow the write that was asked for."""


def touched_partitions(base: DataFrame, keys: DataFrame, pk: Sequence[str]) -> list[str]:
    """Partitions of ``base`` with a row whose key is among ``keys``; only key and partition columns are read."""
    by = partitioning(base)
    return partitions_of(base.select(*pk, *by).join(keys.select(*pk), list(pk), "left_semi"), by)


def write_partitions(rows: DataFrame, path: str, by: Sequence[str], mode: str = "error") -> None:
    """Write rows below ``path`` by partition, few files each: a large partition is spread over several tasks."""
    spread = rows.hint("rebalance", *by) if by else rows
    spread.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _as_named(spark: SparkSession, path: str) -> DataFrame:
    """The table with partition values as the text of its folders, so that a partition is written where it was read:
    the folder of ``01`` is none of the integer 1."""
    setting = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        return spark.read.parquet(path)
    finally:
        spark.conf.set(setting, before)


def update_partitions(spark: SparkSession, path: str, changes: DataFrame, pk: Sequence[str]) -> list[str]:
    """Set the non-key columns of ``changes`` on the rows it names, in the table at ``path``; names of the partitions
    written.

    What comes out equals ``update_join``: rows without a change stay, unknown
    keys are ignored, a key listed twice stops the job.  Other partitions are
    neither read nor written.  Partitions change when the whole job has been
    written beside them, one after the other.
    """
    base = _as_named(spark, path)
    by = partitioning(base)
    if not by:
        raise LayoutError(f"the table at {path} has no partitions; write a new one with update_join")
    moved = [c for c in changes.columns if c in by]
    if moved:
        raise LayoutError(f"{moved} decide in which partition a row lies and cannot be set in place")
    names = touched_partitions(base, changes, pk)
    if names:
        part = base.where(in_partitions(by, names))
        write_partitions(update_join(part, changes, pk), path, by, "overwrite")
    return names
