"""Checks before anything is written.

Rules and schemas are checked on the driver; keys and row sources are checked
by jobs over the whole tables.  All issues are reported, not just the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, datetime
from decimal import Decimal, InvalidOperation
from functools import reduce

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.generators import GenContext, UnknownGenerator, domain_size, find_generator
from ..functions.providers import UnknownProvider, find_provider
from ..functions.seed import SeedScope, is_seedable
from ..functions.template import TemplateError, compile_template
from ..operators.discover import verify_references
from ..operators.keys import family
from ..sources.backends import SourceError, TableLookup, has_source, source_rows
from .spec import SEED_BY, ColumnSpec, MaskSpec, TableSpec

ISSUES = "severity string, table_name string, column_name string, code string, message string"
PRODUCTION_WORDS = ("prod", "live")

Issue = tuple[str, str, str, str, str]


class TargetNotAllowed(PermissionError):
    """The target of a run is not on the allowlist."""


class PreflightFailed(ValueError):
    """The preflight found errors."""


def check_target(spec: MaskSpec, target: str, force: bool = False) -> None:
    """Refuse a target that is not listed; an empty list refuses everything."""
    if not force and not spec.is_allowed(target):
        raise TargetNotAllowed(f"target {target!r} is not in the allowlist")


def is_production_like(target: str) -> bool:
    return any(word in target.lower() for word in PRODUCTION_WORDS)


def literal_fits(text: str, dtype: T.DataType) -> bool:
    """Whether a constant can be cast to the column type."""
    try:
        if isinstance(dtype, T.IntegralType):
            bits = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}[type(dtype)]
            return -(2 ** (bits - 1)) <= int(text) < 2 ** (bits - 1)
        if isinstance(dtype, T.DecimalType):
            value = Decimal(text)
            return value.is_finite() and value.adjusted() < dtype.precision - dtype.scale
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            float(text)
        elif isinstance(dtype, T.BooleanType):
            return text.strip().lower() in ("true", "t", "yes", "y", "1", "false", "f", "no", "n", "0")
        elif isinstance(dtype, T.DateType):
            date.fromisoformat(text)
        elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            datetime.fromisoformat(text)
        else:
            return isinstance(dtype, T.StringType)
    except (ValueError, InvalidOperation):
        return False
    return True


def type_problem(column: ColumnSpec, dtype: T.DataType) -> str | None:
    """Why what the generator produces does not fit the column."""
    produces = find_generator(column.gen.type).produces
    if produces in ("any", "null") or isinstance(dtype, T.StringType):
        return None
    if column.gen.type == "constant":
        fits = literal_fits(column.gen.value, dtype)
    elif produces == "int64":
        fits = isinstance(dtype, T.LongType) or (
            isinstance(dtype, T.DecimalType) and dtype.precision - dtype.scale >= 19)
    else:
        fits = produces == "bool" and isinstance(dtype, T.BooleanType)
    if fits:
        return None
    return f"{produces} values do not fit a column of type {dtype.simpleString()}"


def _rule_issues(table: TableSpec, column: ColumnSpec, spec: MaskSpec,
                 types: dict[str, T.DataType] | None) -> Iterator[tuple[str, str, str]]:
    gen = column.gen
    dtype = (types or {}).get(column.name)
    if column.name in table.pk:
        yield "error", "pk_masked", f"{column.name!r} belongs to the key, which stays as it is"
    if column.seed_by not in SEED_BY:
        yield "error", "unknown_seed_by", f"unknown seed_by {column.seed_by!r}"
    if types is not None and dtype is None:
        yield "error", "column_missing", f"table {table.name!r} has no column {column.name!r}"
    if dtype is not None and column.by_value and not is_seedable(dtype):
        yield "error", "key_type", f"values of type {dtype.simpleString()} cannot seed masks"
    if column.name in dict(table.foreign_keys):
        yield "warning", "fk_masked", f"{column.name!r} refers to another table; its masks may refer to nothing"
    if gen.type == "null" and (column.name in table.not_null):
        yield "error", "not_null", f"column {column.name!r} is declared NOT NULL"
    if gen.type == "null" and column.force_unique:
        yield "error", "null_unique", "NULL cannot be made unique"
    if column.by_value and column.resolves:
        yield "warning", "unique_by_value", "unique masks seeded by value do not stay equal across tables"
    if column.unique and column.on_exhausted == "null" and column.name in table.not_null:
        yield "error", "not_null", f"unresolved rows would set NOT NULL column {column.name!r} to NULL"

    required = {"faker": gen.provider, "constant": gen.value, "template": gen.template}
    if gen.type in required and not required[gen.type]:
        yield "error", "missing_parameter", f"generator {gen.type!r} misses its parameter"
        return
    locale = spec.locale if column.locale is None else column.locale
    try:
        generator = find_generator(gen.type)
        if gen.type == "faker":
            find_provider(gen.provider, locale)
        if gen.type == "template":
            known = types or {}
            pk = [(F.col(c), known.get(c, T.StringType())) for c in table.pk]
            compile_template(gen.template, GenContext(SeedScope("check_", F.lit("")), gen, table.name, column.name,
                                                      locale, pk, F.col(column.name), dtype or T.StringType()))
    except UnknownGenerator as e:
        yield "error", "unknown_generator", str(e)
        return
    except UnknownProvider as e:
        yield "error", "unknown_provider", str(e)
        return
    except TemplateError as e:
        yield "error", "bad_template", f"invalid template: {e}"
        return
    problem = generator.check(gen, dtype) if generator.check else None
    if problem:
        yield "error", "generator_check", problem
    if dtype is not None:
        mismatch = type_problem(column, dtype)
        if mismatch:
            yield "error", "type_mismatch", mismatch


def static_issues(spec: MaskSpec, target: str = "") -> list[Issue]:
    """Problems of the rules alone."""
    found: list[Issue] = []
    if is_production_like(target) and not spec.salt:
        found.append(("error", "", "", "missing_salt",
                      f"target {target!r} looks like production, which needs a salt"))
    for t in spec.tables:
        if not has_source(t.source.type):
            found.append(("error", t.name, "", "unknown_source", f"no row source is called {t.source.type!r}"))
        for c in t.columns:
            found += [(s, t.name, c.name, code, text) for s, code, text in _rule_issues(t, c, spec, None)]
    return found


def _schema_issues(t: TableSpec, spec: MaskSpec, base: DataFrame, lookup: TableLookup) -> list[Issue]:
    types = {f.name: f.dataType for f in base.schema.fields}
    found: list[Issue] = []
    for key in t.pk:
        if key not in types:
            found.append(("error", t.name, key, "pk_missing", f"table {t.name!r} has no key column {key!r}"))
        elif not is_seedable(types[key]):
            found.append(("error", t.name, key, "key_type",
                          f"values of type {types[key].simpleString()} cannot seed masks"))
    for c in t.columns:
        found += [(s, t.name, c.name, code, text) for s, code, text in _rule_issues(t, c, spec, types)]
    found += _filter_issues(t, base)
    found += _reference_issues(t, types, lookup)
    if t.source.watermark:
        found += _watermark_issues(t, types)
    try:
        rows = source_rows(base.sparkSession, t, lookup)
    except (SourceError, AnalysisException) as e:
        found.append(("error", t.name, "", "bad_source", str(e).splitlines()[0]))
    else:
        if rows is not None and not is_deterministic(rows):
            found.append(("error", t.name, "", "source_random",
                          f"the {t.source.type} source names other rows each time it is read"))
    return found


def _parents(t: TableSpec, lookup: TableLookup) -> Iterator[tuple[str, str, str, DataFrame]]:
    """Column, parent table, its column and its rows of each declared reference to a table within reach."""
    for column, parent in t.foreign_keys:
        table, _, key = parent.rpartition(".")
        try:
            rows = lookup(table)
            rows.schema
        except (AnalysisException, KeyError):
            continue  # a table that lives elsewhere may be declared, but not checked
        yield column, table, key, rows


def _reference_issues(t: TableSpec, types: dict[str, T.DataType], lookup: TableLookup) -> list[Issue]:
    """Declared references between columns that do not exist or cannot be compared."""
    found: list[Issue] = []
    for column, table, key, rows in _parents(t, lookup):
        there = {f.name: f.dataType for f in rows.schema.fields}
        if column not in types or key not in there:
            text = f"{t.name}.{column} refers to {table}.{key}, and one of them does not exist"
        elif family(types[column]) != family(there[key]):
            text = f"{t.name}.{column} and {table}.{key} are of different types"
        else:
            continue
        found.append(("error", t.name, column, "bad_reference", text))
    return found


def is_deterministic(df: DataFrame) -> bool:
    """Whether every expression of the resolved plan, functions of the user included, gives the same each time."""
    return df._jdf.queryExecution().analyzed().deterministic()


def _filter_issues(t: TableSpec, base: DataFrame) -> list[Issue]:
    """Whether the filter of a table source means something for this table: resolved, as a run would resolve it."""
    text = t.source.filter
    if not text or t.source.type != "table":
        return []  # those of views are resolved with their source, a query states its own

    def issue(code: str, message: str) -> list[Issue]:
        return [("error", t.name, "", code, f"the filter {text!r} {message}")]

    try:
        dtype = base.select(F.expr(text).alias("f")).schema["f"].dataType
        if not isinstance(dtype, T.BooleanType):
            return issue("filter_type", f"is of type {dtype.simpleString()}, not boolean")
        chosen = base.where(text)  # where aggregates and window functions have no place
    except (AnalysisException, ParseException) as e:
        return issue("bad_filter", f"cannot be resolved: {e.getCondition()}")
    return [] if is_deterministic(chosen) else issue("filter_random", "selects other rows each time it is read")


def _watermark_issues(t: TableSpec, types: dict[str, T.DataType]) -> list[Issue]:
    column = t.source.watermark
    ordered = (T.DateType, T.TimestampType, T.TimestampNTZType)
    found = []
    if t.source.type != "table":
        found.append("a watermark needs a table source")
    if column not in types:
        found.append(f"table {t.name!r} has no column {column!r}")
    elif not (isinstance(types[column], ordered) or is_seedable(types[column])):
        found.append(f"values of type {types[column].simpleString()} have no order to continue in")
    if column in t.masked:
        found.append(f"{column!r} is masked, so its values say nothing about what is new")
    if any(c.resolves for c in t.columns):
        found.append("distinct masks need all rows, a run with a watermark sees the new ones only")
    return [("error", t.name, column, "bad_watermark", text) for text in found]


def key_counts(df: DataFrame, pk: tuple[str, ...]) -> DataFrame:
    """Rows, rows with a NULL in the key, and rows beyond the first of their key."""
    null_key = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in pk])
    per_key = df.groupBy(*pk).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(null_key, F.col("n"))), F.lit(0)).alias("n_null_keys"),
        F.coalesce(F.sum(F.when(~null_key, F.col("n") - 1)), F.lit(0)).alias("n_duplicate_keys"))


def _when_counted(counts: DataFrame, table: str, checks: list[tuple[Column, str, str, str, Column]]) -> DataFrame:
    """Issues whose condition holds on a row of counts, which is computed once."""
    found = F.array(*[
        F.when(condition, F.struct(
            F.lit(severity).alias("severity"), F.lit(table).alias("table_name"), F.lit(column).alias("column_name"),
            F.lit(code).alias("code"), message.alias("message")))
        for condition, severity, column, code, message in checks])
    return counts.select(F.explode(F.array_compact(found)).alias("i")).select("i.*")


def _data_issues(t: TableSpec, spec: MaskSpec, base: DataFrame, lookup: TableLookup) -> list[DataFrame]:
    def counted(column: str, text: str) -> Column:
        return F.concat(F.col(column).cast("string"), F.lit(text))

    name, count = ",".join(t.pk), F.col
    checks = [
        (count("n_null_keys") > 0, "error", name, "pk_null", counted("n_null_keys", " rows have a NULL key")),
        (count("n_duplicate_keys") > 0, "error", name, "pk_duplicate",
         counted("n_duplicate_keys", " rows repeat an earlier key"))]
    shared = []
    for c in t.columns:
        size = domain_size(c.gen, spec.locale if c.locale is None else c.locale) if c.resolves else None
        if size is not None:
            shared.append((count("n_rows") > size, "warning", c.name, "domain_small",
                           counted("n_rows", f" rows share {size} possible values")))
    out = [_when_counted(key_counts(base, t.pk), t.name, checks)]
    for column, table, key, rows in _parents(t, lookup):
        held = verify_references({t.name: base, table: rows}, [(t.name, column, table, key)])
        out.append(_when_counted(held, t.name, [
            (~count("holds"), "warning", column, "reference_orphans",
             counted("n_orphans", f" rows refer to no row of {table}"))]))
    source = source_rows(base.sparkSession, t, lookup)
    if shared:
        chosen = base.where(t.source.filter) if t.source.filter else base
        if source is not None:
            chosen = base.select(*t.pk).join(source.select(*t.pk), list(t.pk), "left_semi")
        out.append(_when_counted(chosen.agg(F.count(F.lit(1)).alias("n_rows")), t.name, shared))
    if source is not None:
        out.append(_when_counted(key_counts(source, t.pk), t.name, [
            (count("n_duplicate_keys") > 0, "error", name, "source_duplicate",
             counted("n_duplicate_keys", " source rows repeat an earlier key"))]))
        absent = source.select(*t.pk).join(base.select(*t.pk), list(t.pk), "left_anti").agg(
            F.count(F.lit(1)).alias("n"))
        out.append(_when_counted(absent, t.name, [
            (count("n") > 0, "warning", name, "source_unmatched",
             counted("n", " source rows have no row in the table"))]))
    return out


def preflight(spark: SparkSession, spec: MaskSpec, lookup: TableLookup, target: str = "",
              strict: bool = False, data: bool = True) -> DataFrame:
    """All issues of a run as ``(severity, table_name, column_name, code, message)``.

    ``strict`` turns warnings into errors.  ``data=False`` skips the jobs over
    table contents.
    """
    found = [i for i in static_issues(spec, target) if i[1] == "" or i[3] == "unknown_source"]
    checks: list[DataFrame] = []
    for t in spec.tables:
        try:
            base = lookup(t.name)
            base.schema
        except (AnalysisException, KeyError):
            found.append(("error", t.name, "", "table_missing", f"there is no table {t.name!r}"))
            continue
        if not has_source(t.source.type):
            continue
        issues = _schema_issues(t, spec, base, lookup)
        found += issues
        usable = not {"pk_missing", "bad_source", "bad_filter", "filter_type", "unknown_generator", "unknown_provider",
                      "bad_reference"} & {i[3] for i in issues}
        if data and usable:
            checks += _data_issues(t, spec, base, lookup)
    out = reduce(DataFrame.unionByName, checks, spark.createDataFrame(found, ISSUES))
    return out.withColumn("severity", F.lit("error")) if strict else out


def require_clean(issues: DataFrame) -> None:
    """Raise when there are errors; the message names all (at most a few per rule)."""
    errors = issues.where("severity = 'error'").collect()
    if errors:
        raise PreflightFailed("; ".join(f"{e.table_name}.{e.column_name}: {e.message}" for e in errors))
