"""What Spark already knows of a table without reading it: its folders, partitions, statistics and file sizes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files whose footers an estimate reads.
SAMPLED_FILES = 32
#: Stands for NULL in the name of a partition; no file system lets a folder have it.
_NULL = "\x00"


def _relation(df: DataFrame):
    """The logical relation that a frame is, as the table or view it was opened from; None for anything computed."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("SubqueryAlias", "View"):
        plan = plan.child()
    return plan if plan.getClass().getSimpleName() == "LogicalRelation" else None


def _files(df: DataFrame):
    relation = _relation(df)
    if relation is None or relation.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return None
    return relation.relation()


def partitioning(df: DataFrame) -> list[str]:
    """The columns a file table is partitioned by, outermost first."""
    files = _files(df)
    return list(files.partitionSchema().fieldNames()) if files is not None else []


def roots(df: DataFrame) -> list[str]:
    """The folders a file table lies in."""
    files = _files(df)
    if files is None:
        return []
    found = files.location().rootPaths()
    return [found.apply(i).toString() for i in range(found.size())]


def partition_name(by: Sequence[str]) -> Column:
    """One text per partition; a condition on it prunes partitions, as it depends on their values only."""
    return F.concat_ws("/", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(_NULL))) for c in by])


def partitions_of(rows: DataFrame, by: Sequence[str]) -> list[str]:
    """Names of the partitions that rows lie in: no more than the table has, all of which the driver lists anyway."""
    return sorted(r["name"] for r in rows.select(partition_name(by).alias("name")).distinct().collect())


def in_partitions(by: Sequence[str], names: Iterable[str]) -> Column:
    return partition_name(by).isin(list(names))


def file_system(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = file_system(spark, path)
    return fs.exists(at)


def _from_statistics(df: DataFrame) -> int | None:
    """Rows by the statistics of the catalog, if the table was analysed and the frame is that table."""
    relation = _relation(df)
    if relation is None or not relation.catalogTable().isDefined():
        return None
    stats = relation.catalogTable().get().stats()
    rows = stats.get().rowCount() if stats.isDefined() else None
    return int(str(rows.get())) if rows is not None and rows.isDefined() else None


def _from_footers(df: DataFrame) -> int | None:
    """Rows by the footers of some Parquet files, extended to all by bytes; exact if there are no more files."""
    files = _files(df)
    if files is None or files.fileFormat().getClass().getSimpleName() != "ParquetFileFormat":
        return None
    spark = df.sparkSession
    names = sorted(df.inputFiles(), key=lambda name: hashlib.md5(name.encode()).digest())[:SAMPLED_FILES]
    if not names:
        return 0
    sizes = [fs.getFileStatus(at).getLen() for at, fs in (file_system(spark, name) for name in names)]
    rows = spark.read.schema(df.schema).parquet(*names).count()  # of no column, so footers are all that is read
    total = int(files.sizeInBytes())
    return rows if total <= sum(sizes) else round(rows * total / max(1, sum(sizes)))


def estimated_rows(df: DataFrame) -> tuple[int, str]:
    """Rows of a table and where the number is from: ``statistics``, ``footers`` or, read in full, ``count``."""
    for source, found in (("statistics", _from_statistics), ("footers", _from_footers)):
        rows = found(df)
        if rows is not None:
            return rows, source
    return df.count(), "count"
