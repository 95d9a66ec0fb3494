"""Masking rules as plain dataclasses, built from a dictionary.

The dictionary has the shape a user would write in TOML and load with
``tomllib.load``.  Unknown keys raise, so a typo never silently leaves a column
unmasked.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

GENERATOR_TYPES = ("faker", "template", "constant", "null", "hash", "counter")
SEED_BY = ("", "pk", "value")
ON_EXHAUSTED = ("null", "keep_original", "fail")


class SpecError(ValueError):
    """The rule dictionary is malformed."""


def _checked(where: str, raw: Any, allowed: Sequence[str]) -> dict[str, Any]:
    if not isinstance(raw, Mapping):
        raise SpecError(f"{where}: expected a table of settings, got {type(raw).__name__}")
    unknown = sorted(set(raw) - set(allowed))
    if unknown:
        raise SpecError(f"{where}: unknown keys {unknown}")
    return dict(raw)


@dataclass(frozen=True)
class GenSpec:
    """Which generator fills a column, and its parameters."""

    type: str
    provider: str = ""
    value: str = ""
    template: str = ""

    @classmethod
    def from_dict(cls, raw: Any, where: str) -> GenSpec:
        raw = _checked(where, raw, ("type", "provider", "value", "template", "params"))
        raw.pop("params", None)  # accepted for compatibility, carries no meaning
        if not raw.get("type"):
            raise SpecError(f"{where}: 'type' is required")
        return cls(**raw)


@dataclass(frozen=True)
class ColumnSpec:
    """Rule for one column.

    ``force_unique`` asks for distinct masks within the run and keeps a
    duplicate when the tries run out.  ``unique`` declares a UNIQUE column: no
    mask may equal another mask or a value that stays in the table, and rows
    that cannot be resolved are failed according to ``on_exhausted``.
    """

    name: str
    gen: GenSpec
    seed_by: str = ""
    force_unique: bool = False
    unique: bool = False
    on_exhausted: str = "null"
    locale: str | None = None

    @property
    def by_value(self) -> bool:
        return self.seed_by == "value"

    @property
    def resolves(self) -> bool:
        return self.force_unique or self.unique

    @classmethod
    def from_dict(cls, raw: Any, where: str) -> ColumnSpec:
        raw = _checked(where, raw, ("name", "gen", "generator", "seed_by", "force_unique", "unique",
                                    "on_exhausted", "locale"))
        name = raw.get("name")
        if not name:
            raise SpecError(f"{where}: 'name' is required")
        where = f"{where} column {name!r}"
        shorthand, gen = raw.pop("generator", ""), raw.pop("gen", None)
        if gen:
            rule = GenSpec.from_dict(gen, where)
        elif shorthand:
            rule = GenSpec("faker", provider=shorthand)
        else:
            raise SpecError(f"{where}: needs 'gen' or 'generator'")
        if raw.get("on_exhausted", "null") not in ON_EXHAUSTED:
            raise SpecError(f"{where}: on_exhausted must be one of {ON_EXHAUSTED}")
        return cls(gen=rule, **raw)


@dataclass(frozen=True)
class SourceSpec:
    """Which rows of a table are masked.

    ``params`` are the values of ``:name`` markers in the ``sql`` of a query; they
    never become part of its text.  ``watermark`` names an ordering column: a run then takes the rows that came
    since the last run, which it knows from the largest value seen then.
    """

    type: str = "table"
    name: str = ""
    sql: str = ""
    filter: str = ""
    watermark: str = ""
    params: tuple[tuple[str, str], ...] = ()

    @classmethod
    def from_dict(cls, raw: Any, where: str) -> SourceSpec:
        raw = _checked(where, raw, ("type", "name", "sql", "filter", "watermark", "params"))
        params = raw.get("params") or {}
        if not isinstance(params, Mapping):
            raise SpecError(f"{where}: 'params' gives a value to each name")
        raw["params"] = tuple(sorted(params.items()))
        if not raw.get("type"):
            raw["type"] = "table"
        return cls(**raw)


@dataclass(frozen=True)
class TableSpec:
    """Rules for one table, plus the constraints declared for it.

    Files carry no constraints, so ``not_null`` and ``foreign_keys``
    (column -> ``"table.column"``) are stated here and checked by jobs.
    """

    name: str
    columns: tuple[ColumnSpec, ...]
    pk: tuple[str, ...] = ("id",)
    source: SourceSpec = field(default_factory=SourceSpec)
    not_null: tuple[str, ...] = ()
    foreign_keys: tuple[tuple[str, str], ...] = ()

    def __post_init__(self) -> None:
        names = [c.name for c in self.columns]
        if len(set(names)) != len(names):
            raise SpecError(f"table {self.name!r}: a column has more than one rule")

    @classmethod
    def from_dict(cls, raw: Any) -> TableSpec:
        raw = _checked("table", raw, ("name", "pk", "columns", "source", "not_null", "foreign_keys"))
        name = raw.get("name")
        if not name:
            raise SpecError("table: 'name' is required")
        where = f"table {name!r}"
        pk = raw.get("pk") or "id"
        columns = raw.get("columns")
        if not columns:
            raise SpecError(f"{where}: needs at least one column rule")
        return cls(
            name=name,
            columns=tuple(ColumnSpec.from_dict(c, where) for c in columns),
            pk=(pk,) if isinstance(pk, str) else tuple(pk),
            source=SourceSpec.from_dict(raw["source"], f"{where} source") if raw.get("source") else SourceSpec(),
            not_null=tuple(raw.get("not_null", ())),
            foreign_keys=tuple(sorted(dict(raw.get("foreign_keys", {})).items())),
        )

    @property
    def masked(self) -> list[str]:
        return [c.name for c in self.columns]


@dataclass(frozen=True)
class MaskSpec:
    """A whole run: salt, locale, allowed targets, and table rules in order."""

    tables: tuple[TableSpec, ...]
    salt: str = ""
    locale: str = ""
    allowed: tuple[str, ...] = ()

    @classmethod
    def from_dict(cls, raw: Any) -> MaskSpec:
        # Connection settings and the batch size steer a database client; they
        # are accepted so that an existing rule file loads, and have no effect.
        raw = _checked("spec", raw, ("tables", "salt", "locale", "allowed", "safety",
                                     "databases", "database", "batch_size"))
        safety = _checked("safety", raw.get("safety", {}), ("salt", "allowed_db_names"))
        if not raw.get("tables"):
            raise SpecError("spec: needs at least one table")
        return cls(
            tables=tuple(TableSpec.from_dict(t) for t in raw["tables"]),
            salt=raw.get("salt", safety.get("salt", "")),
            locale=raw.get("locale", ""),
            allowed=tuple(raw.get("allowed", safety.get("allowed_db_names", ()))),
        )

    def table(self, name: str) -> TableSpec:
        for t in self.tables:
            if t.name == name:
                return t
        raise KeyError(name)

    def references(self) -> list[tuple[str, str, str, str]]:
        """Declared references as child table and column, parent table and column."""
        return [(t.name, column, *parent.rpartition(".")[::2]) for t in self.tables for column, parent in t.foreign_keys]

    def is_allowed(self, target: str) -> bool:
        return target in self.allowed
