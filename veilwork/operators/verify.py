"""Checks of a masked table against its input, each a job over whole tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def leaks(before: DataFrame, after: DataFrame, pk: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per column: rows of both frames, rows whose value did not change, and rows that only one of them has."""
    old = before.select(*pk, *[F.col(c).alias(f"__old_{c}") for c in columns], F.lit(True).alias("__before"))
    both = old.join(after.select(*pk, *columns, F.lit(True).alias("__after")), list(pk), "full")
    paired = F.col("__before").isNotNull() & F.col("__after").isNotNull()
    same = [F.struct(F.lit(c).alias("column_name"),
                     F.count_if(paired & F.col(f"__old_{c}").eqNullSafe(F.col(c))).alias("n_unchanged")) for c in columns]
    return both.agg(
        F.count_if(paired).alias("n_rows"), F.count_if(F.col("__after").isNull()).alias("n_missing"),
        F.count_if(F.col("__before").isNull()).alias("n_added"), F.array(*same).alias("s")).select(
        "n_rows", "n_missing", "n_added", F.explode("s").alias("s")).select(
        "s.column_name", "n_rows", "s.n_unchanged", "n_missing", "n_added")


def _plain(column: Column, dtype: T.DataType) -> Column:
    """The same information in types that can be hashed: a map as its entries in order of their hashes."""
    if isinstance(dtype, T.MapType):
        entries = F.transform(F.map_entries(column), lambda e: F.struct(
            _marked(e["key"], dtype.keyType).alias("key"), _marked(e["value"], dtype.valueType).alias("value")))
        return F.array_sort(F.transform(entries, lambda e: F.xxhash64(e)))
    if isinstance(dtype, T.ArrayType):
        return F.transform(column, lambda e: _marked(e, dtype.elementType))
    if isinstance(dtype, T.StructType):
        return F.struct(*[_marked(column[f.name], f.dataType).alias(f"f{i}") for i, f in enumerate(dtype.fields)])
    return column


def _marked(column: Column, dtype: T.DataType) -> Column:
    """With a mark for NULL, which hashing would skip, so that values cannot move between columns unseen."""
    return F.struct(column.isNull().alias("null"), _plain(column, dtype).alias("value"))


def row_digest(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Two independent 64-bit hashes of a row."""
    types = {f.name: f.dataType for f in df.schema.fields}
    marked = [_marked(F.col(c), types[c]) for c in columns]
    return [F.xxhash64(*marked), F.xxhash64(F.lit("second"), *reversed(marked))]


def difference(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, counted with repetition, that only one of two frames has.

    What is shuffled is a 16-byte digest per row, combined to counts before.
    """
    tagged = [df.select(*[h.alias(f"h{i}") for i, h in enumerate(row_digest(df, columns))], F.lit(side).alias("__side"))
              for df, side in ((left, 1), (right, -1))]
    surplus = tagged[0].unionByName(tagged[1]).groupBy("h0", "h1").agg(F.sum("__side").alias("d"))
    return surplus.agg(
        F.coalesce(F.sum(F.greatest("d", F.lit(0))), F.lit(0)).alias("n_only_before"),
        F.coalesce(F.sum(F.greatest(-F.col("d"), F.lit(0))), F.lit(0)).alias("n_only_after"))


def checksum(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row count and order-free sums of two row hashes: one scan, no shuffle."""
    first, second = row_digest(df, columns) if columns else (F.lit(0), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.sum(first.cast("decimal(38,0)")).alias("sum_first"),
                  F.sum(second.cast("decimal(38,0)")).alias("sum_second"))


def same_schema(before: DataFrame, after: DataFrame) -> bool:
    return [(f.name, f.dataType) for f in before.schema] == [(f.name, f.dataType) for f in after.schema]


def untouched(before: DataFrame, after: DataFrame, pk: Sequence[str], masked: Sequence[str]) -> DataFrame:
    """Whether the schema, the row set and all unmasked columns are unchanged."""
    columns = [c for c in before.columns if c not in masked]
    return difference(before, after, columns).select(
        F.lit(same_schema(before, after)).alias("same_schema"), "n_only_before", "n_only_after")


def determinism(runs: Sequence[DataFrame]) -> DataFrame:
    """Rows in which runs of the same rules over differently spread data differ from the first."""
    parts = [difference(runs[0], other, runs[0].columns).select(F.lit(i).alias("run"), "n_only_before", "n_only_after")
             for i, other in enumerate(runs[1:], 1)]
    return reduce(DataFrame.unionByName, parts)


def consistency(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Rows in which two masks that should agree differ."""
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"),
                     F.count_if(~F.col(left).eqNullSafe(F.col(right))).alias("n_different"))


def value_mapping(before: DataFrame, after: DataFrame, pk: Sequence[str], column: str) -> DataFrame:
    """Distinct pairs of original and mask, with the rows holding them."""
    old = before.select(*pk, F.col(column).alias("original"))
    return old.join(after.select(*pk, F.col(column).alias("mask")), list(pk)).groupBy("original", "mask").agg(
        F.count(F.lit(1)).alias("n_rows"))


def orphans(child: DataFrame, child_column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child rows, with a value, that have no parent."""
    values = child.where(F.col(child_column).isNotNull()).groupBy(F.col(child_column).alias("v")).agg(
        F.count(F.lit(1)).alias("n"))
    return values.join(parent.select(F.col(parent_column).alias("v")), "v", "left_anti").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_orphans"))


def duplicates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values held by more than one row, with their row count; NULLs do not collide."""
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return df.where(present).groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def uniqueness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, distinct values and rows beyond the first of their value."""
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return df.where(present).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def salt_sensitivity(one: DataFrame, other: DataFrame, pk: Sequence[str], column: str) -> DataFrame:
    """Rows of both, rows whose mask is the same under two salts, and rows that only one run has."""
    left = one.select(*pk, F.col(column).alias("__one"), F.lit(True).alias("__left"))
    right = other.select(*pk, F.col(column).alias("__other"), F.lit(True).alias("__right"))
    paired = F.col("__left").isNotNull() & F.col("__right").isNotNull()
    return left.join(right, list(pk), "full").agg(
        F.count_if(paired).alias("n_rows"), F.count_if(paired & F.col("__one").eqNullSafe(F.col("__other"))).alias("n_equal"),
        F.count_if(~paired).alias("n_unpaired"))
