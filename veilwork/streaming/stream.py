"""Masking a stream.

The mask of a row depends on that row only, so the projection used on tables
runs unchanged on a stream: no state, no watermark, append mode.  Where a view or
a query says which rows to mask, each micro-batch is joined with it as a table
would be, and published once: a batch that Spark repeats after a failure is known
from the run log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.mask import MaskedTable
from ..plans.publish import COMPLETED, STARTED, log_state, run_log
from ..plans.spec import MaskSpec, TableSpec
from ..sources.backends import TableLookup


class StreamRuleError(ValueError):
    """A rule that needs to see all rows cannot run on a stream."""


def mask_stream(stream: DataFrame, table: TableSpec, spec: MaskSpec) -> DataFrame:
    """The masked stream.

    Distinct masks are refused: who gets a value depends on smaller keys, and
    on unbounded input one may always still arrive.
    """
    if table.source.type != "table":
        raise StreamRuleError("view and query sources are joined with each batch: use publish_stream")
    _refuse_unique(table)
    return MaskedTable(stream, table, spec).output()


def _refuse_unique(table: TableSpec) -> None:
    unique = [c.name for c in table.columns if c.resolves]
    if unique:
        raise StreamRuleError(f"unique masks are undefined on a stream: {unique}")


def write_stream(masked: DataFrame, path: str, checkpoint: str, fmt: str = "parquet",
                 available_now: bool = False, interval: str = "10 seconds") -> StreamingQuery:
    """Append the masked stream to files, exactly once per input row.

    ``available_now`` processes what is there in bounded batches and stops.
    """
    writer = masked.writeStream.outputMode("append").format(fmt).option("path", path).option(
        "checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def _folder(out: str, batch: int) -> str:
    return f"{out.rstrip('/')}/batch-{batch}"


def publish_batch(rows: DataFrame, batch: int, table: TableSpec, spec: MaskSpec, lookup: TableLookup, out: str) -> bool:
    """Mask one batch and publish it, unless that has been done; whether it was done now.

    What an interrupted try left behind is written again, as the log does not
    list it as completed and readers never saw it.
    """
    spark, run = rows.sparkSession, f"batch-{batch}"
    log = run_log(spark, out).where((F.col("run_id") == run) & (F.col("status") == COMPLETED))
    if not log.isEmpty():
        return False
    log_state(spark, out, run, 0, STARTED)
    MaskedTable(rows, table, spec, lookup).output().write.mode("overwrite").parquet(_folder(out, batch))
    log_state(spark, out, run, 1, COMPLETED)
    return True


def publish_stream(stream: DataFrame, table: TableSpec, spec: MaskSpec, lookup: TableLookup, out: str, checkpoint: str,
                   available_now: bool = False, interval: str = "10 seconds") -> StreamingQuery:
    """Mask a stream whose rows a table, view or query source selects; each batch is published exactly once.

    The source is read anew for every batch, so it may grow meanwhile.  Rows that
    it does not name pass as they are; a key that it names twice stops the stream.
    """
    _refuse_unique(table)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda rows, batch: publish_batch(rows, batch, table, spec, lookup, out) and None)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def published_batches(spark: SparkSession, out: str, like: DataFrame) -> DataFrame:
    """All rows of the batches published so far; ``like`` has the columns of the stream."""
    done = run_log(spark, out).where(F.col("status") == COMPLETED).select("run_id").distinct().collect()
    batches = sorted(int(r["run_id"].removeprefix("batch-")) for r in done)
    if not batches:
        return spark.createDataFrame([], like.schema)
    return spark.read.schema(like.schema).parquet(*[_folder(out, b) for b in batches])
