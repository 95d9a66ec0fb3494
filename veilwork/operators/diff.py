"""Change lists, previews and run reports, all read from the masking frame."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.spec import MaskSpec, TableSpec
from ..sources.backends import TableLookup
from ..sources.layout import estimated_rows
from .mask import FAILED, SELECTED, MaskedTable, attempt_name

PREVIEW_ROWS = 5


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def diff(masked: MaskedTable) -> DataFrame:
    """One row per selected row and masked column, in long form, values as text.

    A narrow unpivot: every input row becomes as many output rows as there are
    rules, without a shuffle.
    """
    table = masked.table
    changes = [F.struct(F.lit(i).alias("column_position"), F.lit(r.name).alias("column_name"),
                        F.col(masked._originals[r.name]).cast("string").alias("old_value"),
                        masked._value(r).cast("string").alias("new_value"))
               for i, r in enumerate(table.columns)]
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in table.pk])
    return masked.changes.select(
        F.lit(table.name).alias("table_name"), key.alias("pk_value"), F.explode(F.array(*changes)).alias("c")
    ).select("table_name", "pk_value", "c.column_position", "c.column_name", "c.old_value", "c.new_value")


def dry_run(spec: MaskSpec, lookup: TableLookup) -> DataFrame:
    """Everything a run would change, and nothing written."""
    return _union([diff(MaskedTable(lookup(t.name), t, spec, lookup)) for t in spec.tables])


def preview(spec: MaskSpec, lookup: TableLookup, n: int = PREVIEW_ROWS) -> DataFrame:
    """The changes of the first ``n`` rows of each source in key order.

    Rows are cut off by a top-n before masking.  Distinct masks come out as in
    the full run because only smaller keys can take precedence over a row.
    """
    return _union([diff(MaskedTable(lookup(t.name), t, spec, lookup, limit=n)) for t in spec.tables])


def counters(masked: MaskedTable) -> list[Column]:
    """What a report counts, over the rows of the masking frame.

    ``retried`` adds up the retries for UNIQUE columns, ``failed`` counts rows
    left without a value, ``duplicates_kept`` those that a ``force_unique`` rule
    had to leave equal.
    """
    chosen = F.col(SELECTED)
    retried, kept = F.lit(0).cast("long"), F.lit(0).cast("long")
    for rule in masked.resolved:
        if rule.unique:
            tries = F.when(chosen, F.col(attempt_name(rule.name)).cast("long"))
            retried = retried + F.coalesce(F.sum(tries), F.lit(0))
        else:
            kept = kept + F.count_if(chosen & F.col(f"__exhausted_{rule.name}"))
    return [F.count_if(chosen).alias("selected"), F.count_if(chosen & ~F.col(FAILED)).alias("updated"),
            retried.alias("retried"), F.count_if(chosen & F.col(FAILED)).alias("failed"), kept.alias("duplicates_kept")]


def report(masked: MaskedTable) -> DataFrame:
    """Counters of one table; ``unmatched`` are the keys the source names in vain."""
    table = masked.table
    counts = masked.changes.agg(*counters(masked))
    absent = masked.unmatched().agg(F.count(F.lit(1)).alias("unmatched"))
    both = counts.unionByName(absent, allowMissingColumns=True)
    return both.agg(*[F.sum(c).alias(c) for c in both.columns]).select(
        F.lit(table.name).alias("table_name"), F.lit(",".join(table.masked)).alias("columns"), *both.columns)


def run_report(spec: MaskSpec, lookup: TableLookup) -> DataFrame:
    """The report of every table in the order of the rules, and the totals."""
    tables = _union([report(MaskedTable(lookup(t.name), t, spec, lookup)) for t in spec.tables])
    counters = [c for c in tables.columns if c not in ("table_name", "columns")]
    totals = tables.agg(*[F.sum(c).alias(c) for c in counters]).select(
        F.lit("TOTAL").alias("table_name"), F.lit("").alias("columns"), *counters)
    return tables.unionByName(totals)


def report_json(report_rows: DataFrame) -> DataFrame:
    """Each report row as one JSON document."""
    return report_rows.select("table_name", F.to_json(F.struct(*report_rows.columns)).alias("report"))


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Exact rows per table; for files the count comes from their footers."""
    return _union([df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
                   for name, df in tables.items()])


def row_estimates(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table as far as they are known without reading it, and how: statistics, file footers, or a count."""
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame([(name, *estimated_rows(df)) for name, df in tables.items()],
                                 "table_name string, n_rows long, known_from string")


def source_estimate(table: TableSpec, lookup: TableLookup) -> tuple[int, str]:
    """Rows of what a rule reads; a query is not estimated."""
    if table.source.type == "query":
        return 0, "none"
    return estimated_rows(lookup(table.source.name if table.source.type == "view" else table.name))


def plan_summary(spec: MaskSpec, lookup: TableLookup) -> DataFrame:
    """Tables, columns and row estimates of a run."""
    rows = [(t.name, ",".join(t.masked), source_estimate(t, lookup)[0]) for t in spec.tables]
    return lookup(spec.tables[0].name).sparkSession.createDataFrame(
        rows, "table_name string, columns string, n_rows long")
