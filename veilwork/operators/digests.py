"""Digests of key ranges, by which two tables are compared without reading what is equal.

A table's keys are cut into ranges on two levels; each range has a count and
order-free sums of row hashes, and a range of the upper level those of its parts
together.  The digests of a published table are stored beside it.  To compare two
tables with the same ranges, upper ranges are compared first, then the parts of
those that differ, and only rows of parts that differ are read and named.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .verify import row_digest

#: Parts of the table, and parts of each of these.
FAN = 32
#: Keys that the ranges are fitted to.
SAMPLED_KEYS = 1 << 14

SCHEMA = ("upper int, part int, low string, high string, n_rows long, kept_first decimal(38,0), kept_second decimal(38,0), "
          "all_first decimal(38,0), all_second decimal(38,0)")
_SUMS = ("n_rows", "kept_first", "kept_second", "all_first", "all_second")

Bounds = list[list[str]]  # by upper range: where its parts begin but the first, then where the next upper range begins


def _typed(values: Sequence[str], dtype: T.DataType) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(T.ArrayType(dtype)) if values else F.array().cast(T.ArrayType(dtype))


def fit_ranges(df: DataFrame, key: str) -> list[str]:
    """Keys at which ranges begin, as text: quantiles of a sample drawn by hash, so that parts are about equal."""
    keys = df.select(F.col(key).alias("k")).where("k IS NOT NULL")
    rate = max(1, keys.count() // SAMPLED_KEYS)
    drawn = keys.where(F.pmod(F.xxhash64("k"), F.lit(rate)) == 0).distinct().orderBy("k")
    found = [r["k"] for r in drawn.select(F.col("k").cast("string").alias("k")).collect()]
    step = max(1, -(-len(found) // (FAN * FAN)))
    return found[step::step]


def _places(key: Column, dtype: T.DataType, starts: Sequence[str]) -> tuple[Column, Column]:
    """The upper range of a key and its part there; NULL lies before all others."""
    groups = [list(starts[i:i + FAN]) for i in range(0, len(starts), FAN)] or [[]]
    firsts = _typed([g[0] for g in groups if g], dtype)
    upper = F.greatest(F.size(F.filter(firsts, lambda b: b <= key)) - 1, F.lit(-1))
    parts = F.element_at(F.array(*[_typed(g, dtype) for g in groups]), F.greatest(upper, F.lit(0)) + 1)
    part = F.when(key.isNull() | (upper < 0), F.lit(-1)).otherwise(F.size(F.filter(parts, lambda b: b <= key)) - 1)
    return F.when(key.isNull(), F.lit(-1)).otherwise(upper).cast("int"), part.cast("int")


def digest_tree(df: DataFrame, pk: Sequence[str], masked: Sequence[str], starts: Sequence[str]) -> DataFrame:
    """The digests of all parts that have rows, as a table of at most ``FAN * FAN + 1`` rows; one scan.

    ``kept`` sums leave out the masked columns, ``all`` sums are over every column.
    """
    dtype = df.schema[pk[0]].dataType
    upper, part = _places(F.col(pk[0]), dtype, starts)
    kept = row_digest(df, [c for c in df.columns if c not in masked])
    every = row_digest(df, df.columns)
    sums = [F.sum(h.cast("decimal(38,0)")).alias(n) for n, h in zip(_SUMS[1:], [*kept, *every])]
    found = df.groupBy(upper.alias("upper"), part.alias("part")).agg(F.count(F.lit(1)).alias("n_rows"), *sums)
    bounds = F.array(*[F.lit(s) for s in starts]) if starts else F.array().cast("array<string>")
    at = F.when(F.col("upper") < 0, F.lit(0)).otherwise(F.col("upper") * FAN + F.col("part") + 1)  # of the next start
    return found.select("upper", "part", F.get(bounds, at - 1).alias("low"), F.get(bounds, at).alias("high"), *_SUMS)


def starts_of(tree: DataFrame) -> list[str]:
    """Where ranges begin that a stored tree has rows in, in order."""
    rows = tree.where("low IS NOT NULL").select("upper", "part", "low").collect()
    return [r["low"] for r in sorted(rows)]


def totals(tree: DataFrame) -> T.Row:
    """Rows and sums of the whole table."""
    return tree.agg(*[F.sum(c).alias(c) for c in _SUMS]).first()


def _by_range(tree: DataFrame) -> dict[int, dict[int, T.Row]]:
    out: dict[int, dict[int, T.Row]] = {}
    for r in tree.collect():
        out.setdefault(r["upper"], {})[r["part"]] = r
    return out


def differing_ranges(before: DataFrame, after: DataFrame, sums: str = "all") -> list[tuple[str | None, str | None]]:
    """Ranges of keys (low included, high not) whose rows are not the same in two trees over the same starts."""
    columns = ["n_rows", f"{sums}_first", f"{sums}_second"]

    def total(parts: Mapping[int, T.Row]) -> list:
        return [sum(r[c] for r in parts.values()) for c in columns]

    old, new = _by_range(before), _by_range(after)
    found = []
    for upper in sorted({*old, *new}):
        left, right = old.get(upper, {}), new.get(upper, {})
        if total(left) == total(right):
            continue
        for part in sorted({*left, *right}):
            a, b = left.get(part), right.get(part)
            if a is None or b is None or [a[c] for c in columns] != [b[c] for c in columns]:
                found.append(((a or b)["low"], (a or b)["high"]))
    return found


def in_ranges(key: str, dtype: T.DataType, ranges: Sequence[tuple[str | None, str | None]]) -> Column:
    """Comparisons of the key alone, which reach the scan and skip row groups where the files are in order."""
    joined: list[tuple[str | None, str | None]] = []
    for low, high in ranges:
        if joined and joined[-1][1] == low and low is not None:
            joined[-1] = (joined[-1][0], high)
        else:
            joined.append((low, high))
    out = F.lit(False)
    for low, high in joined:
        inside = F.lit(True)
        if low is not None:
            inside = F.col(key) >= F.lit(low).cast(dtype)
        if high is not None:
            inside = inside & (F.col(key) < F.lit(high).cast(dtype))
        out = out | (inside | F.col(key).isNull() if low is None else inside)
    return out


def difference_rows(before: DataFrame, after: DataFrame, pk: Sequence[str], columns: Sequence[str],
                    ranges: Sequence[tuple[str | None, str | None]]) -> DataFrame:
    """Keys of rows in these ranges that are missing, were added or differ in one of the columns.

    Keys that several rows have are compared by all their rows together.
    """
    chosen = in_ranges(pk[0], before.schema[pk[0]].dataType, ranges)

    def digests(df: DataFrame, side: str) -> DataFrame:
        first, second = row_digest(df, list(columns))
        return df.where(chosen).groupBy(*pk).agg(F.count(F.lit(1)).alias(f"n_{side}"), F.sum(
            first.cast("decimal(38,0)")).alias(f"a_{side}"), F.sum(second.cast("decimal(38,0)")).alias(f"b_{side}"))

    left, right = digests(before, "before"), digests(after, "after")
    right = right.withColumnsRenamed({c: f"__{c}" for c in pk})
    same_key = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in pk])
    both = left.join(right, same_key, "full").select(
        *[F.coalesce(c, f"__{c}").alias(c) for c in pk], *[F.col(f"{x}_{s}") for x in "nab" for s in ("before", "after")])
    problem = (F.when(F.col("n_after").isNull(), "missing").when(F.col("n_before").isNull(), "added")
               .when((F.col("n_before") != F.col("n_after")) | (F.col("a_before") != F.col("a_after"))
                     | (F.col("b_before") != F.col("b_after")), "changed"))
    return both.select(*pk, problem.alias("problem")).where("problem IS NOT NULL")
