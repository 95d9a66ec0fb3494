"""Shared pieces of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.mask import MaskedTable
from ..plans.spec import MaskSpec
from ..sources.backends import TableLookup, open_tables

SALT = "pepper"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def lookup(spark: SparkSession, sf_dir: str, **views: DataFrame) -> TableLookup:
    files = open_tables(spark, f"parquet:{sf_dir}")
    return lambda name: views[name] if name in views else files(name)


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    find = lookup(spark, sf_dir)
    return {name: find(name) for name in TABLES}


def spec_of(table: str, pk: str | list[str], columns: list[dict], salt: str = SALT, locale: str = "",
            **table_settings: object) -> MaskSpec:
    return MaskSpec.from_dict({"salt": salt, "locale": locale, "allowed": ["testdata"], "tables": [
        {"name": table, "pk": pk, "columns": columns, **table_settings}]})


def masked(spark: SparkSession, sf_dir: str, table: str, pk: str | list[str], columns: list[dict],
           salt: str = SALT, locale: str = "", views: dict[str, DataFrame] | None = None,
           **table_settings: object) -> MaskedTable:
    spec = spec_of(table, pk, columns, salt, locale, **table_settings)
    find = lookup(spark, sf_dir, **(views or {}))
    return MaskedTable(find(table), spec.tables[0], spec, find)


def faker(name: str, provider: str, **settings: object) -> dict:
    return {"name": name, "gen": {"type": "faker", "provider": provider}, **settings}


def rule(name: str, kind: str, **gen: str) -> dict:
    return {"name": name, "gen": {"type": kind, **gen}}
