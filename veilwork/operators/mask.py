"""Masking a table: one projection, plus a key join where rows come from elsewhere.

:class:`MaskedTable` builds, lazily, one frame with the original columns, the
new values and a few flags.  The masked table, the change list, the preview and
the report are projections and aggregations of that frame, so a dry run and a
real run cannot differ.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.generators import GenContext, build_generator
from ..functions.seed import SeedScope, materialise_seeds, pk_identifier, render_or_nil, seed_column
from ..plans.spec import GENERATOR_TYPES, ColumnSpec, MaskSpec, TableSpec
from ..sources.backends import TableLookup, source_rows
from .joint import resolve_joint
from .unique import FORCE_UNIQUE_TRIES, UNIQUE_COLUMN_TRIES, Attempts, resolve_attempts

SELECTED = "__selected"
FAILED = "__failed"
ROW_ATTEMPT = "row"


class ExhaustedError(RuntimeError):
    """No unique value was found for some rows and the rule asks to fail."""


def new_name(column: str) -> str:
    return f"__new_{column}"


def old_name(column: str) -> str:
    return f"__old_{column}"


def attempt_name(owner: str) -> str:
    return f"__attempt_{owner}"


def locale_of(rule: ColumnSpec, spec: MaskSpec) -> str:
    return spec.locale if rule.locale is None else rule.locale


def add_new_values(
    df: DataFrame,
    table: TableSpec,
    rules: Sequence[ColumnSpec],
    spec: MaskSpec,
    types: Mapping[str, T.DataType],
    originals: Mapping[str, str],
    attempts: Mapping[str, str] | None = None,
    selected: Column | None = None,
) -> DataFrame:
    """Add ``__new_<column>`` for each rule, computed from the row alone.

    ``originals`` and ``attempts`` name the columns holding the original value
    and the try of each rule.  Rows outside ``selected`` get NULL without the
    hashing.  Rules with the same identifier and try share one seed.
    """
    attempts = attempts or {}
    pk = [(F.col(c), types[c]) for c in table.pk]
    scopes: dict[tuple[str, str], SeedScope] = {}
    values: dict[str, Column] = {}
    for rule in rules:
        original, dtype = F.col(originals[rule.name]), types[rule.name]
        attempt_column = attempts.get(rule.name)
        attempt = F.col(attempt_column) if attempt_column else F.lit(0)
        key = (rule.name if rule.by_value else "", attempt_column or "")
        if key not in scopes:
            identifier = render_or_nil(original, dtype) if rule.by_value else pk_identifier(table.name, pk)
            seed = seed_column(spec.salt, identifier, attempt)
            scopes[key] = SeedScope(f"__s{len(scopes)}_", seed if selected is None else F.when(selected, seed))
        ctx = GenContext(scopes[key], rule.gen, table.name, rule.name, locale_of(rule, spec), pk,
                         original, dtype, attempt)
        values[new_name(rule.name)] = build_generator(ctx).cast(dtype)
    keep = df.columns
    seeded = materialise_seeds(df, list(scopes.values()))
    return seeded.select(*[F.col(c) for c in keep], *[v.alias(n) for n, v in values.items()])


class MaskedTable:
    """One table under its rules.

    ``base`` is the table, ``lookup`` finds the view of a view source.  With
    ``limit`` only the first rows of the source in key order take part, as in a
    preview.
    """

    def __init__(self, base: DataFrame, table: TableSpec, spec: MaskSpec,
                 lookup: TableLookup | None = None, limit: int | None = None):
        self.spark: SparkSession = base.sparkSession
        self.base, self.table, self.spec, self.limit = base, table, spec, limit
        self.types = {f.name: f.dataType for f in base.schema.fields}
        self._lookup = lookup or self.spark.table
        self._source = source_rows(self.spark, table, self._lookup)
        filter_ = table.source.filter if self._source is None else ""
        self._filter = F.expr(filter_) if filter_ else None
        self.attempts: dict[str, Attempts] = {}
        self.keys_checked = False  # once per table, whatever the number of rules

    # -- which rows ------------------------------------------------------------

    @property
    def rewrites_everything(self) -> bool:
        return self._source is None and self._filter is None

    @property
    def _originals(self) -> dict[str, str]:
        """Column holding the original value of each masked column."""
        given = () if self._source is None else self._source.columns
        return {c: old_name(c) if c in given else c for c in self.table.masked}

    @cached_property
    def _frame(self) -> DataFrame:
        """All base rows with the flag of those the source selects."""
        if self.limit is not None:
            return self._preview_frame
        if self._source is None:
            chosen = F.lit(True) if self._filter is None else F.coalesce(self._filter, F.lit(False))
            return self.base.withColumn(SELECTED, chosen)
        # The guard sits in the plan: a key named twice stops the job instead of
        # duplicating or arbitrarily choosing rows.  Unused originals are pruned.
        old = {c: name for c, name in self._originals.items() if name != c}
        once = self._source.groupBy(*self.table.pk).agg(
            F.count(F.lit(1)).alias("__n"), *[F.any_value(c).alias(name) for c, name in old.items()])
        joined = self.base.join(once, list(self.table.pk), "left")
        return joined.withColumn(SELECTED, self._once_guard().otherwise(F.col("__n").isNotNull())).drop("__n")

    def _first_rows(self, rows: DataFrame, more: int = 0) -> DataFrame:
        # Without the coalesce the projections that follow move below the limit
        # and turn the top-n into a full sort.
        return rows.orderBy(*self.table.pk).limit(self.limit + more).coalesce(1)

    @cached_property
    def _preview_frame(self) -> DataFrame:
        pk = list(self.table.pk)
        if self._source is None:
            return self._first_rows(self._filtered).withColumn(SELECTED, F.lit(True))
        # One row more than shown, so that a repeated last key is seen; then the guard of a full run.
        old = {c: name for c, name in self._originals.items() if name != c}
        once = self._first_rows(self._source, 1).groupBy(*pk).agg(
            F.count(F.lit(1)).alias("__n"), *[F.any_value(c).alias(name) for c, name in old.items()])
        first = once.orderBy(*pk).limit(self.limit).coalesce(1)
        return self.base.join(first, pk).withColumn(SELECTED, self._once_guard().otherwise(F.lit(True))).drop("__n")

    def _once_guard(self) -> Column:
        return F.when(F.col("__n") > 1, F.raise_error(F.lit(
            f"source of table {self.table.name} returns a key more than once")).cast("boolean"))

    @property
    def _filtered(self) -> DataFrame:
        return self.base if self._filter is None else self.base.where(self._filter)

    @cached_property
    def selected(self) -> DataFrame:
        """The base rows the source selects, with their original values."""
        if self._source is None and self.limit is None:
            return self._filtered.withColumn(SELECTED, F.lit(True))  # a plain filter, so the scan can use it
        return self._frame.where(SELECTED)

    def unmatched(self) -> DataFrame:
        """Keys the source names that the base table does not have."""
        pk = list(self.table.pk)
        if self._source is None:
            return self.base.select(*pk).limit(0)
        return self._source.select(*pk).join(self.base.select(*pk), pk, "left_anti")

    # -- tries of rows that need distinct values ---------------------------------

    @property
    def _unique(self) -> list[ColumnSpec]:
        return [r for r in self.table.columns if r.unique]

    @property
    def resolved(self) -> list[ColumnSpec]:
        """Rules with tries of their own: the UNIQUE columns share those of the first of them."""
        return [*self._unique[:1], *[r for r in self.table.columns if r.force_unique and not r.unique]]

    def _resolve(self, rule: ColumnSpec) -> Attempts:
        found = self._resolve_together() if rule.unique and len(self._unique) > 1 else self._resolve_alone(rule)
        self.keys_checked = True
        return found

    def _resolve_together(self) -> Attempts:
        rules, originals = self._unique, self._originals
        carry = sorted({originals[r.name] for r in rules if self._needs_original(r)})
        # Any column will do to build an expression that never reads it.
        used = {r.name: originals[r.name] if self._needs_original(r) else self.table.pk[0] for r in rules}

        def with_values(df: DataFrame) -> DataFrame:
            out = add_new_values(df, self.table, rules, self.spec, self.types, used, {r.name: "attempt" for r in rules})
            return out.select(*df.columns, F.array(*[F.struct(
                F.lit(i).alias("column"), F.col(new_name(r.name)).cast("string").alias("value"))
                for i, r in enumerate(rules)]).alias("values"))

        taken = None
        if not self.rewrites_everything:
            kept = F.array(*[F.struct(F.lit(i).alias("column"), F.col(r.name).cast("string").alias("value"))
                             for i, r in enumerate(rules)])
            taken = self._untouched().select(F.explode(kept).alias("v")).select("v.*").where("value IS NOT NULL")
        return resolve_joint(self.selected, self.table.pk, carry, with_values, UNIQUE_COLUMN_TRIES, taken,
                             self.keys_checked)

    def _needs_original(self, rule: ColumnSpec) -> bool:
        return rule.by_value or "OriginalValue" in rule.gen.template or rule.gen.type not in GENERATOR_TYPES

    def _resolve_alone(self, rule: ColumnSpec) -> Attempts:
        original = self._originals[rule.name]
        needs_original = self._needs_original(rule)
        alike = rule.by_value and rule.gen.type in GENERATOR_TYPES and "PrimaryKeyValue" not in rule.gen.template

        def with_value(df: DataFrame) -> DataFrame:
            out = add_new_values(df, self.table, [rule], self.spec, self.types, {rule.name: original},
                                 {rule.name: "attempt"})
            return out.withColumnRenamed(new_name(rule.name), "value")

        taken = None
        if rule.unique and not self.rewrites_everything:
            taken = self._untouched().where(F.col(rule.name).isNotNull()).select(F.col(rule.name).alias("value"))
        if not needs_original:
            # Any column will do to build the expression; it is never read.
            original = self.table.pk[0]
        return resolve_attempts(
            self.selected, self.table.pk, [original] if needs_original else [], with_value,
            UNIQUE_COLUMN_TRIES if rule.unique else FORCE_UNIQUE_TRIES,
            taken=taken, alike=alike, keys_checked=self.keys_checked)

    def _untouched(self) -> DataFrame:
        """Base rows the whole source, not just a preview of it, leaves alone."""
        if self._source is not None:
            return self.base.join(self._source.select(*self.table.pk), list(self.table.pk), "left_anti")
        return self.base.where(~F.coalesce(self._filter, F.lit(False)))

    @cached_property
    def wide(self) -> DataFrame:
        """Base columns, original values, new values, tries and flags of all rows."""
        return self._widen(self._frame, self.rewrites_everything or self.limit is not None)

    @cached_property
    def changes(self) -> DataFrame:
        """The same for the selected rows only."""
        return self._widen(self.selected, True)

    def _widen(self, df: DataFrame, all_selected: bool) -> DataFrame:
        table = self.table
        unique = self._unique
        owner_of = {r.name: r.name for r in table.columns if r.resolves}
        if unique:
            # A refused row is generated afresh as a whole, so its columns agree.
            owner_of = {r.name: r.name if r.force_unique and not r.unique else unique[0].name
                        for r in table.columns}
        for rule in self.resolved:
            if rule.name not in self.attempts:
                self.attempts[rule.name] = self._resolve(rule)
        for rule in unique:
            exhausted = self.attempts[unique[0].name].exhausted
            if rule.on_exhausted == "fail" and exhausted:
                raise ExhaustedError(f"{exhausted} rows of {table.name}.{rule.name} have no free value")
        df = self._add_attempts(df, self.resolved)
        failed = self._exhausted
        attempts = {c: attempt_name(o) for c, o in owner_of.items()}
        df = add_new_values(df, table, table.columns, self.spec, self.types, self._originals, attempts,
                            None if all_selected else F.col(SELECTED))
        for rule in unique:
            df = df.withColumn(new_name(rule.name), F.when(~self._exhausted, F.col(new_name(rule.name))))
        return df.withColumn(FAILED, F.col(SELECTED) & failed)

    @property
    def _exhausted(self) -> Column:
        """Whether a row has no free value for its UNIQUE columns."""
        return F.col(f"__exhausted_{self._unique[0].name}") if self._unique else F.lit(False)

    def _add_attempts(self, df: DataFrame, rules: list[ColumnSpec]) -> DataFrame:
        """Tries and exhausted flags of all rules, by one join: their tables are merged by key before."""
        pk = list(self.table.pk)
        parts = None
        for rule in rules:
            table = self.attempts[rule.name].table
            if table is None:
                continue
            part = table.select(*pk, *[
                F.struct("attempt").alias(r.name) if r.name == rule.name else
                F.lit(None).cast("struct<attempt:int>").alias(r.name) for r in rules])
            parts = part if parts is None else parts.unionByName(part)
        if parts is not None:
            listed = parts.groupBy(*pk).agg(*[F.first(r.name, ignorenulls=True).alias(f"__listed_{r.name}") for r in rules])
            df = df.join(listed, pk, "left")
        for rule in rules:
            last = (UNIQUE_COLUMN_TRIES if rule.unique else FORCE_UNIQUE_TRIES) - 1
            name, flag, listed = attempt_name(rule.name), f"__exhausted_{rule.name}", f"__listed_{rule.name}"
            attempt = F.lit(0) if parts is None else F.when(
                F.col(listed).isNotNull(), F.col(listed)["attempt"]).otherwise(F.lit(0))
            df = df.withColumn(name, attempt)
            df = df.withColumns({flag: F.col(SELECTED) & F.col(name).isNull(),
                                 name: F.coalesce(F.col(name), F.lit(last))}).drop(listed)
        return df

    # -- outputs -----------------------------------------------------------------

    def _value(self, rule: ColumnSpec) -> Column:
        """What ends up in the column of a row."""
        new = F.col(new_name(rule.name))
        changed = F.col(SELECTED)
        if any(r.unique and r.on_exhausted == "keep_original" for r in self.table.columns):
            changed = changed & ~F.col(FAILED)
        elif self.rewrites_everything:
            return new
        # A flag, not a coalesce: a generated NULL must replace the value too.
        return F.when(changed, new).otherwise(F.col(rule.name))

    @property
    def flags(self) -> list[str]:
        """Columns of the frame from which the counters of a report are taken."""
        resolved = [r.name for r in self.resolved]
        return [SELECTED, FAILED, *[attempt_name(c) for c in resolved], *[f"__exhausted_{c}" for c in resolved]]

    def output(self, flags: bool = False, only_selected: bool = False) -> DataFrame:
        """The base table with its masked columns replaced; same rows, same schema.

        ``flags`` adds what counters need, ``only_selected`` leaves out the rows
        that the source does not select.
        """
        rules = {r.name: r for r in self.table.columns}
        return (self.changes if only_selected else self.wide).select(
            *[self._value(rules[c]).alias(c) if c in rules else F.col(c) for c in self.base.columns],
            *(self.flags if flags else []))

    def failed(self) -> DataFrame:
        """Rows left without a unique value: key and reason, never the value."""
        parts = None
        for rule in self._unique:
            rows = self.changes.where(self._exhausted).select(
                F.lit(self.table.name).alias("table_name"), F.lit(rule.name).alias("column_name"), *self.table.pk,
                F.lit(f"no unique value after {UNIQUE_COLUMN_TRIES - 1} retries").alias("reason"))
            parts = rows if parts is None else parts.unionByName(rows)
        if parts is None:
            raise ValueError(f"table {self.table.name!r} has no unique column")
        return parts


def mask_table(base: DataFrame, table: TableSpec, spec: MaskSpec, lookup: TableLookup | None = None) -> DataFrame:
    """The masked table."""
    return MaskedTable(base, table, spec, lookup).output()


def mask_all(spec: MaskSpec, lookup: TableLookup) -> dict[str, DataFrame]:
    """Every table of the spec, masked, by name."""
    return {t.name: mask_table(lookup(t.name), t, spec, lookup) for t in spec.tables}


def update_join(base: DataFrame, changes: DataFrame, pk: Sequence[str]) -> DataFrame:
    """``base`` with the non-key columns of ``changes`` set on the rows it names.

    Rows without a change stay, keys unknown to the base are ignored, and a key
    listed twice stops the job.
    """
    pk = list(pk)
    columns = [c for c in changes.columns if c not in pk]
    once = changes.groupBy(*pk).agg(F.count(F.lit(1)).alias("__n"),
                                    *[F.any_value(c).alias(new_name(c)) for c in columns])
    matched = F.when(F.col("__n") > 1, F.raise_error(F.lit("a key is listed more than once")).cast("boolean")
                     ).otherwise(F.col("__n").isNotNull())
    joined = base.join(once, pk, "left").withColumn("__matched", matched)
    return joined.select(*[
        F.when(F.col("__matched"), F.col(new_name(c))).otherwise(F.col(c)).cast(base.schema[c].dataType).alias(c)
        if c in columns else F.col(c) for c in base.columns])
