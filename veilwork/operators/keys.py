"""Which sets of columns identify a row, and which columns' values lie in which others."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.seed import is_seedable
from ..storage import Workspace

Reference = tuple[str, str, str, str]  # child table, child column, parent table, parent column

#: Rows of a table from which repeats are looked for before the whole table is read, and sets counted by one job.
SAMPLE_ROWS = 1 << 20
SETS_AT_ONCE = 8
#: Of sets looked at in a sample, one job takes so many times more.
MORE_DRAWN = 4
#: How many times larger the next sample is, and the rate below which it is the whole table.
GROWTH, LEAST_RATE = 16, 4
#: Columns to draw by have one value for as many rows at least, or several are taken.
VALUES_TO_DRAW = 1024


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _digest(columns: Sequence[str]) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of values none of which is NULL."""
    return F.xxhash64(*columns), F.xxhash64(F.lit("second"), *reversed(columns))


def _drawn_by(columns: Sequence[str], distinct: Mapping[str, int], n_rows: int) -> tuple[str, ...]:
    """The fewest of a set's columns by whose values its rows can be drawn evenly, those with most values first."""
    by = sorted(columns, key=lambda c: -distinct[c])
    values = 1
    for i, c in enumerate(by, 1):
        values *= distinct[c]
        if values >= n_rows // VALUES_TO_DRAW:
            return tuple(by[:i])
    return tuple(by)


def _repeated(values: DataFrame, sets: Sequence[tuple[str, ...]]) -> set[tuple[str, ...]]:
    """The sets (named by position) with a digest that comes twice; equal ones are combined per task before the shuffle."""
    found = values.groupBy("set", "a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("set").distinct()
    return {sets[r["set"]] for r in found.collect()}


def _repeating_drawn(df: DataFrame, sets: Mapping[tuple[str, ...], tuple[str, ...]], rate: int) -> set[tuple[str, ...]]:
    """Which sets have equal values in two rows, among one of ``rate`` values of the columns each is drawn by.

    Rows are drawn by their values, so a repeated value is drawn with all its
    rows: what repeats here is proven, whatever the rate.  Sets drawn by the same
    columns share the draw, so a row that none draws costs a hash or two and is
    not looked at further.
    """
    hits = {by: F.pmod(F.xxhash64(F.lit("draw"), *by), F.lit(rate)) == 0 for by in sets.values()}
    offered = []
    for i, (columns, by) in enumerate(sets.items()):
        first, second = _digest(columns)
        offered.append(F.when(hits[by], F.struct(F.lit(i).alias("set"), first.alias("a"), second.alias("b"))))
    drawn = df.where(reduce(Column.__or__, hits.values()))
    return _repeated(drawn.select(F.explode(F.array_compact(F.array(*offered))).alias("o")).select("o.*"), list(sets))


def _repeating(df: DataFrame, sets: Sequence[tuple[str, ...]]) -> set[tuple[str, ...]]:
    """Which sets have equal values in two rows of the whole table.

    Hardly any of the values counted here repeats, so all of them are shuffled,
    each as one 64-bit hash read by a scan of its own columns.  Only rows with a
    hash that comes twice are counted by their digests.
    """
    parts = []
    for i, columns in enumerate(sets):
        first, second = _digest(columns)
        parts.append(df.select(F.lit(i).alias("set"), first.alias("a"), second.alias("b"),
                               F.xxhash64(F.lit(i), *columns).alias("h")))
    values = _union(parts)
    work = Workspace(df.sparkSession, "keys")
    twice = work.save(values.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "twice")
    found = set() if twice.isEmpty() else _repeated(values.join(twice, "h", "left_semi"), sets)
    work.drop()
    return found


def unique_sets(df: DataFrame, n_rows: int, sets: Mapping[tuple[str, ...], tuple[str, ...]]) -> set[tuple[str, ...]]:
    """The sets (of columns without NULLs) that no two rows share the values of.

    ``sets`` names for each the columns of it that its rows are drawn by.  Most
    sets repeat values so often that a sample proves it, others in a larger one;
    only what is left is counted over all rows.
    """
    left, rate = list(sets), n_rows // SAMPLE_ROWS
    while rate >= LEAST_RATE:
        left = _without(left, SETS_AT_ONCE * MORE_DRAWN,
                        lambda some, rate=rate: _repeating_drawn(df, {s: sets[s] for s in some}, rate))
        rate //= GROWTH
    return set(_without(left, SETS_AT_ONCE, lambda some: _repeating(df, some)))


def _without(sets: list[tuple[str, ...]], at_once: int,
             repeating: Callable[[list[tuple[str, ...]]], set[tuple[str, ...]]]) -> list[tuple[str, ...]]:
    """The sets that do not repeat, asked by so many at once."""
    found: set[tuple[str, ...]] = set()
    for a in range(0, len(sets), at_once):
        found |= repeating(sets[a:a + at_once])
    return [s for s in sets if s not in found]


def minimal_keys(df: DataFrame, counts: Mapping[str, tuple[int, int, int]], largest: int) -> list[tuple[str, ...]]:
    """The smallest sets of columns, up to ``largest`` columns each, whose values identify a row.

    ``counts`` has rows, non-NULL and distinct values of each column.  Sets are
    visited level by level.  A set is not looked at if a part of it is a key, nor
    if its parts have too few values between them: a set has at most as many as
    the product of a part's and the remaining column's.
    """
    order = [c for c in df.columns if c in counts and counts[c][0] == counts[c][1]]
    n_rows = max((counts[c][0] for c in order), default=0)
    if not n_rows:
        return []
    found = [(c,) for c in order if counts[c][2] == n_rows]
    most = {(c,): counts[c][2] for c in order if (c,) not in found}  # of sets that are no keys, by position
    level = list(most)
    for size in range(2, largest + 1):
        bounds: dict[tuple[str, ...], int] = {}
        for a, b in combinations(level, 2):
            if a[:-1] != b[:-1]:
                continue
            columns = (*a, b[-1])
            parts = [columns[:i] + columns[i + 1:] for i in range(size)]
            if all(p in most for p in parts):
                bounds[columns] = min(most[p] * most[(c,)] for p, c in zip(parts, columns))
        open_ = [s for s, bound in bounds.items() if bound >= n_rows]
        distinct = {c: counts[c][2] for c in order}
        keys = unique_sets(df, n_rows, {s: _drawn_by(s, distinct, n_rows) for s in open_})
        found += [s for s in open_ if s in keys]
        most |= {s: min(bound, n_rows - 1) for s, bound in bounds.items() if s not in keys}
        level = [s for s in bounds if s not in keys]
    return found


def discover_composite_keys(tables: Mapping[str, DataFrame], facts: DataFrame, largest: int = 3) -> DataFrame:
    """Per table, the minimal sets of columns that identify its rows: ``table_name, columns, n_columns``.

    ``facts`` are the columns' counts from ``discover_keys``.
    """
    counts: dict[str, dict[str, tuple[int, int, int]]] = {}
    for r in facts.collect():  # as many rows as the tables have columns
        counts.setdefault(r["table_name"], {})[r["column_name"]] = (r["n_rows"], r["n_values"], r["n_distinct"])
    rows = [(name, ",".join(key), len(key)) for name, df in tables.items()
            for key in minimal_keys(df, counts.get(name, {}), largest)]
    return facts.sparkSession.createDataFrame(rows, "table_name string, columns string, n_columns int")


def find_keys(tables: Mapping[str, DataFrame], declared: Mapping[str, str] | None = None) -> dict[str, str]:
    """The key of each table: declared, or its first column, in schema order, that is unique without NULLs.

    The first columns of all tables are counted by one job, and where none of
    these is a key, the others by a second one; declared keys read nothing.
    """
    keys = dict(declared or {})
    waiting = {name: [f.name for f in df.schema.fields if is_seedable(f.dataType)]
               for name, df in tables.items() if name not in keys}
    for one in (True, False):
        parts = []
        for name, columns in waiting.items():
            for i, column in enumerate(columns[:1] if one else columns[1:]):
                digest = _digest([column])
                values = tables[name].select(*[F.when(F.col(column).isNotNull(), d).alias(x) for x, d in zip("ab", digest)])
                per_value = values.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
                parts.append(per_value.agg(F.max(F.when(F.col("a").isNull(), 2).otherwise(F.col("n"))).alias("most")).select(
                    F.lit(name).alias("table_name"), F.lit(column).alias("column_name"), F.lit(i).alias("position"), "most"))
        if parts:
            found = sorted((r["position"], r["table_name"], r["column_name"]) for r in _union(parts).where("most = 1").collect())
            for _, name, column in found:
                keys.setdefault(name, column)
        waiting = {name: columns for name, columns in waiting.items() if name not in keys}
    return keys


def family(dtype: T.DataType) -> str:
    """Types whose values can be compared: integers of any width are one family."""
    return "integer" if isinstance(dtype, T.IntegralType) else dtype.simpleString()


def _value(column: str, dtype: T.DataType) -> Column:
    """A value as 16 bytes that are equal for equal values of one family only."""
    return F.unhex(F.md5(F.concat(F.lit(f"{family(dtype)}:"), F.col(column).cast("string"))))


def discover_inclusions(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All pairs of columns of which one has every value that the other has, whatever their names.

    Every value is listed once with the set of columns holding it, as bits; what
    a column is included in is the intersection of the sets of all its values.
    Both are aggregations with map-side combining whose shuffled rows are values,
    not rows, so a value that most rows hold costs no more than any other, and
    after the first of them only the different sets are left.
    """
    columns = [(name, f.name, f.dataType) for name, df in tables.items() for f in df.schema.fields if is_seedable(f.dataType)]
    words = [f"w{i}" for i in range(-(-len(columns) // 64))]

    def mask(at: int) -> list[Column]:
        bit = 1 << at % 64
        return [F.lit((bit - (1 << 64) if bit >> 63 else bit) if i == at // 64 else 0).cast("long").alias(w)
                for i, w in enumerate(words)]

    def holds(at: int) -> Column:
        return F.shiftright(words[at // 64], at % 64).bitwiseAND(F.lit(1)) == 1

    listed = _union([tables[name].where(F.col(column).isNotNull()).select(_value(column, dtype).alias("v"), *mask(at))
                     for at, (name, column, dtype) in enumerate(columns)])
    held = listed.groupBy("v").agg(*[F.bit_or(w).alias(w) for w in words])
    sets = held.groupBy(*words).agg(F.count(F.lit(1)).alias("n"))
    members = F.array_compact(F.array(*[F.when(holds(at), F.lit(at)) for at in range(len(columns))]))
    common = sets.withColumn("at", F.explode(members)).groupBy("at").agg(
        *[F.bit_and(w).alias(w) for w in words], F.sum("n").alias("n_values"))
    pairs = common.withColumn("of", F.explode(members)).where("at <> of")
    names = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(c).alias("c")) for t, c, _ in columns])
    child, parent = F.element_at(names, F.col("at") + 1), F.element_at(names, F.col("of") + 1)
    return pairs.select(child["t"].alias("child_table"), child["c"].alias("child_column"), parent["t"].alias("parent_table"),
                        parent["c"].alias("parent_column"), "n_values")


def references_by_value(inclusions: DataFrame, keys: Mapping[str, str]) -> list[Reference]:
    """Inclusions in another table's key, by a column that is no key itself: candidates for references."""
    parents: Iterable[tuple[str, str]] = keys.items()
    in_key = reduce(lambda a, b: a | b, [(F.col("parent_table") == t) & (F.col("parent_column") == c) for t, c in parents],
                    F.lit(False))
    return sorted((r["child_table"], r["child_column"], r["parent_table"], r["parent_column"])
                  for r in inclusions.where(in_key).collect()
                  if r["child_table"] != r["parent_table"] and keys.get(r["child_table"]) != r["child_column"])
