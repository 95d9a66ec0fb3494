"""Opening tables by address, and choosing the rows a rule masks."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession

from ..plans.spec import TableSpec

TableLookup = Callable[[str], DataFrame]


class SourceError(ValueError):
    """A row source is incomplete or unknown."""


# Backends: address scheme -> function from table name to DataFrame -----------

_backends: dict[str, Callable[[SparkSession, str], TableLookup]] = {}


def register_backend(scheme: str, connect: Callable[[SparkSession, str], TableLookup]) -> None:
    if scheme in _backends:
        raise ValueError(f"another backend handles {scheme!r}")
    _backends[scheme] = connect


def open_tables(spark: SparkSession, address: str) -> TableLookup:
    """``parquet:/data``, ``orc:``, ``json:``, ``csv:``, ``catalog:db`` or a database URL.

    Files take reader options after a question mark; ``schema.<table>`` states the
    columns of a table, so that JSON is not read once more to find them out.
    """
    scheme = address.split(":", 1)[0]
    if scheme not in _backends:
        raise SourceError(f"no backend for scheme {scheme!r}")
    return _backends[scheme](spark, address)


def _files(fmt: str, **options: str) -> Callable[[SparkSession, str], TableLookup]:
    def connect(spark: SparkSession, address: str) -> TableLookup:
        folder, _, rest = address.split(":", 1)[1].partition("?")
        chosen = options | {name: values[-1] for name, values in parse_qs(rest).items()}
        schemas = {name: chosen.pop(name) for name in [*chosen] if name.startswith("schema.")}

        def table(name: str) -> DataFrame:
            reader = spark.read.format(fmt).options(**chosen)
            schema = schemas.get(f"schema.{name}")
            return (reader.schema(schema) if schema else reader).load(f"{folder.rstrip('/')}/{name}.{fmt}")
        return table
    return connect


def _catalog(spark: SparkSession, address: str) -> TableLookup:
    database = address.split(":", 1)[1]
    return lambda name: spark.table(f"{database}.{name}" if database else name)


def jdbc_options(address: str) -> dict[str, str]:
    """JDBC reader options for a ``postgres://user:password@host:port/db?...`` address."""
    url = urlsplit(address)
    options = {"url": f"jdbc:postgresql://{url.hostname}:{url.port or 5432}{url.path}"}
    if url.username:
        options["user"] = unquote(url.username)
    if url.password:
        options["password"] = unquote(url.password)
    for name, values in parse_qs(url.query).items():
        options[name] = values[-1]
    return options


def _postgres(spark: SparkSession, address: str) -> TableLookup:
    # For a parallel read pass partitionColumn, lowerBound, upperBound and
    # numPartitions in the query part of the address.
    options = jdbc_options(address)
    return lambda name: spark.read.format("jdbc").options(**options).option("dbtable", name).load()


for _fmt in ("parquet", "orc", "json"):
    register_backend(_fmt, _files(_fmt))
register_backend("csv", _files("csv", header="true"))
register_backend("catalog", _catalog)
register_backend("postgres", _postgres)
register_backend("postgresql", _postgres)


# Row sources: kind -> function giving the selected rows -----------------------

_sources: dict[str, Callable[[SparkSession, TableSpec, TableLookup], DataFrame]] = {}


def register_source(kind: str, rows: Callable[[SparkSession, TableSpec, TableLookup], DataFrame]) -> None:
    """Add a row source.

    ``rows`` returns a DataFrame with the key of the table and, where they
    differ from the table's own, the original values of masked columns.
    """
    if kind in _sources or kind == "table":
        raise ValueError(f"another row source is called {kind!r}")
    _sources[kind] = rows


def has_source(kind: str) -> bool:
    return kind == "table" or kind in _sources


def source_rows(spark: SparkSession, table: TableSpec, lookup: TableLookup) -> DataFrame | None:
    """Rows named by a view, query or custom source; None for the table itself."""
    kind = table.source.type
    if kind == "table":
        return None
    if kind not in _sources:
        raise SourceError(f"no row source is called {kind!r}")
    rows = _sources[kind](spark, table, lookup)
    missing = [c for c in table.pk if c not in rows.columns]
    if missing:
        raise SourceError(f"source of table {table.name!r} does not return the key {missing}")
    return rows.select(*table.pk, *[c for c in table.masked if c in rows.columns])


def _view(spark: SparkSession, table: TableSpec, lookup: TableLookup) -> DataFrame:
    if not table.source.name:
        raise SourceError("a view source needs the 'name' of its view")
    rows = lookup(table.source.name)
    return rows.where(table.source.filter) if table.source.filter else rows


def _query(spark: SparkSession, table: TableSpec, lookup: TableLookup) -> DataFrame:
    sql = table.source.sql.strip()
    if not sql:
        raise SourceError("a query source needs 'sql'")
    if not sql.upper().startswith("SELECT"):
        raise SourceError("only a SELECT can name the rows")
    if "ORDER BY" not in sql.upper():
        raise SourceError("the query has to state its ORDER BY")
    return spark.sql(sql, args=dict(table.source.params))


register_source("view", _view)
register_source("query", _query)
