"""Reading the given tables and writing intermediate ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from veilwork.storage import Workspace

__all__ = ["Workspace", "arrow_map", "filter_rows", "held_out", "read"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(key: Column, folds: int, fold: int) -> Column:
    """Whether ``crc32`` of the key as text falls into the held-out fold (NULL key: as the text '')."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(folds)) == fold


def arrow_map(df: DataFrame, schema: str | StructType, work: Callable[[pa.RecordBatch], Iterator[dict]]) -> DataFrame:
    """Apply ``work`` to Arrow batches; it yields columns by name, in any order."""
    fields = to_arrow_schema(schema if isinstance(schema, StructType) else StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in work(batch):
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, type=f.type)
                     for f in fields for c in (columns[f.name],)], schema=fields)
        pa.default_memory_pool().release_unused()  # workers stay for later tasks

    return df.mapInArrow(run, schema)


def filter_rows(df: DataFrame, column: str, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows for which ``keep``, given batches of one column, says so; columns unchanged."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(at)), pa.bool_()))
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, df.schema)
