"""Reading schemas and data for keys, references and columns worth masking."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.seed import is_seedable
from .keys import Reference, family

# Rule name, column name pattern, generator, provider; first match wins.
RULES = [
    ("Email", "email", "faker", "email"),
    ("First Name", "first_name|fname", "faker", "first_name"),
    ("Last Name", "last_name|lname", "faker", "last_name"),
    ("Full Name", "full_name|fullname|name", "faker", "full_name"),
    ("Phone", "phone|tel|mobile", "faker", "phone_number"),
    ("Company", "company|organization|org", "faker", "company_name"),
    ("IP Address", "ip_address|ipv4|ipv6", "faker", "ipv4_address"),
    ("Address", "address|street|city|zip", "faker", "short_text"),
]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def list_tables(spark: SparkSession, database: str | None = None) -> dict[str, DataFrame]:
    """Base tables of a catalog database by name, sorted."""
    found = spark.catalog.listTables(database) if database else spark.catalog.listTables()
    names = sorted(t.name for t in found if t.tableType in ("MANAGED", "EXTERNAL"))
    return {n: spark.table(f"{database}.{n}" if database else n) for n in names}


def describe_columns(tables: Mapping[str, DataFrame], facts: DataFrame | None = None,
                     references: DataFrame | None = None) -> DataFrame:
    """Table, column, position, type and nullability of every column.

    With ``facts`` (of ``discover_keys``) and checked ``references`` also whether
    it has NULLs, is unique, is the key, and refers to another table; columns
    that cannot be keys are neither unique nor keys.
    """
    spark = next(iter(tables.values())).sparkSession
    rows = [(name, f.name, i, f.dataType.simpleString(), f.nullable)
            for name, df in tables.items() for i, f in enumerate(df.schema.fields)]
    out = spark.createDataFrame(
        rows, "table_name string, column_name string, position int, data_type string, nullable boolean")
    on = ["table_name", "column_name"]
    if facts is not None:
        out = out.join(facts.select(*on, "has_nulls", "is_unique", "is_key"), on, "left").withColumns(
            {c: F.coalesce(c, F.lit(False)) for c in ("is_unique", "is_key")})
    if references is not None:
        refers = references.where("holds").select(F.col("child_table").alias("table_name"),
                                                  F.col("child_column").alias("column_name")).distinct()
        out = out.join(refers.withColumn("is_fk", F.lit(True)), on, "left").withColumn(
            "is_fk", F.coalesce("is_fk", F.lit(False)))
    return out


def _comparable(col: Column, dtype: T.DataType) -> Column:
    """What distinct values are counted on: text of any length by its MD5."""
    return F.unhex(F.md5(col)) if isinstance(dtype, T.StringType) else col


def discover_keys(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per column: rows, non-NULL and distinct values, and whether it is nullable, unique, or the key.

    The key is the first column, in schema order, that is unique without NULLs.
    Each column is read and counted alone, so no row is multiplied by the number
    of columns.  Values are combined per task before the shuffle, so a value held
    by many rows costs no more than any other, and long texts travel as 16-byte
    digests.  Columns of types that cannot be keys (floating point, binary and
    nested ones) are left out.
    """
    return _union([_table_keys(name, df) for name, df in tables.items()])


def _table_keys(name: str, df: DataFrame) -> DataFrame:
    facts = _union([_column_counts(df, f, df.columns.index(f.name))
                    for f in df.schema.fields if is_seedable(f.dataType)])
    unique = F.col("n_distinct") == F.col("n_values")
    first = F.min(F.when(unique & (F.col("n_values") == F.col("n_rows")), F.col("position"))).over(
        Window.partitionBy("table_name"))
    return facts.withColumn("table_name", F.lit(name)).select(
        "table_name", "column_name", "position", "n_rows", "n_values", "n_distinct",
        (F.col("n_values") < F.col("n_rows")).alias("has_nulls"), unique.alias("is_unique"),
        F.coalesce(F.col("position") == first, F.lit(False)).alias("is_key"))


def _column_counts(df: DataFrame, field: T.StructField, position: int) -> DataFrame:
    values = df.groupBy(_comparable(F.col(field.name), field.dataType).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return values.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("n_values"),
        F.count("v").alias("n_distinct")).select(
        F.lit(field.name).alias("column_name"), F.lit(position).alias("position"), "n_rows", "n_values", "n_distinct")


def _singular(table: str) -> set[str]:
    name = table.lower()
    names = {name}
    for ending, instead in (("ies", "y"), ("ses", "s"), ("xes", "x"), ("s", "")):
        if name.endswith(ending):
            names.add(name[:len(name) - len(ending)] + instead)
    return names


def fk_candidates(tables: Mapping[str, DataFrame], keys: Mapping[str, str],
                  key_names: str = r"(key|id|uuid|code)$",
                  declared: Iterable[Reference] = ()) -> list[Reference]:
    """Declared references, then columns named like the key of another table.

    A column ``<table>_<key>`` (singular or plural) refers to that table; else a
    column named like the key itself does, up to a prefix of one or two letters.
    A name that several keys share, like ``id``, says nothing when the column is
    its own table's key.  Integers of any width match.  ``key_names`` says what a
    key is called, so that free text which happens to be unique is not compared.
    """
    def stem(column: str) -> str:
        return re.sub(r"^[a-z]{1,2}_", "", column)

    found = list(declared)
    stems = [stem(k) for k in keys.values()]
    generic = {s for s in stems if s in ("id", "key", "uuid", "code") and stems.count(s) > 1}
    for child, df in tables.items():
        for f in df.schema.fields:
            for parent, key in keys.items():
                if parent == child and f.name == key or not re.search(key_names, key, re.I) \
                        or family(f.dataType) != family(tables[parent].schema[key].dataType):
                    continue
                by_table = f.name.lower() in {f"{t}_{stem(key)}" for t in _singular(parent)}
                alike = parent != child and stem(f.name) == stem(key) and not (
                    stem(key) in generic and keys.get(child) == f.name)
                if (by_table or alike) and (child, f.name, parent, key) not in found:
                    found.append((child, f.name, parent, key))
    return found


def verify_references(tables: Mapping[str, DataFrame], references: Iterable[Reference]) -> DataFrame:
    """Per reference: rows with a value, and rows whose value has no parent.

    Child values are counted before the join, so a parent with very many
    children is one row in it.
    """
    return _union([_reference(tables, r) for r in references])


def _reference(tables: Mapping[str, DataFrame], reference: Reference) -> DataFrame:
    child, column, parent, key = reference
    values = tables[child].where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(
        F.count(F.lit(1)).alias("n"))
    parents = tables[parent].select(F.col(key).alias("v"), F.lit(True).alias("found")).dropna().distinct()
    orphan = F.when(F.col("found").isNull(), F.col("n")).otherwise(0)
    return values.join(parents, "v", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_references"), F.coalesce(F.sum(orphan), F.lit(0)).alias("n_orphans")
    ).select(F.lit(child).alias("child_table"), F.lit(column).alias("child_column"),
             F.lit(parent).alias("parent_table"), F.lit(key).alias("parent_column"),
             "n_references", "n_orphans", (F.col("n_orphans") == 0).alias("holds"))


def discover_fk(tables: Mapping[str, DataFrame], keys: Mapping[str, str],
                declared: Iterable[Reference] = ()) -> DataFrame:
    """Declared and candidate references between the tables, checked against the data."""
    return verify_references(tables, fk_candidates(tables, keys, declared=declared))


def _on_cycles(follow: Mapping[str, set[str]]) -> set[str]:
    """Nodes that can reach themselves."""
    found = set()
    for start in follow:
        seen: set[str] = set()
        waiting = list(follow[start])
        while waiting:
            at = waiting.pop()
            if at not in seen:
                seen.add(at)
                waiting += follow.get(at, ())
        if start in seen:
            found.add(start)
    return found


def fk_cycles(edges: DataFrame, tables: Iterable[str]) -> DataFrame:
    """For every table, its outgoing references and whether they lead back to it.

    Different references are as many as the schema has, so the driver follows
    them; checking them against the data (``edges``) is the part that Spark does.
    """
    follow: dict[str, set[str]] = {}
    for r in edges.select("child_table", "parent_table").distinct().collect():
        follow.setdefault(r["child_table"], set()).add(r["parent_table"])
    circular = _on_cycles(follow)
    return edges.sparkSession.createDataFrame(
        [(n, len(follow.get(n, ())), n in circular) for n in sorted(tables)],
        "table_name string, n_references long, in_cycle boolean")


def suggest(columns: DataFrame) -> DataFrame:
    """Masking suggestions from column names; keys and references are left out.

    ``columns`` has ``table_name, column_name, is_key, is_fk``.
    """
    rule = F.lit(None).cast("struct<rule:string,generator:string,provider:string>")
    for name, pattern, generator, provider in reversed(RULES):
        hit = F.struct(F.lit(name).alias("rule"), F.lit(generator).alias("generator"),
                       F.lit(provider).alias("provider"))
        rule = F.when(F.col("column_name").rlike(f"(?i){pattern}"), hit).otherwise(rule)
    return columns.where(~F.col("is_key") & ~F.col("is_fk")).withColumn("r", rule).where("r is not null").select(
        "table_name", "column_name", "r.generator", "r.provider",
        F.concat(F.lit("Matched rule '"), F.col("r.rule"), F.lit("'")).alias("reason"))


def analyze(tables: Mapping[str, DataFrame], keys: Mapping[str, str], references: DataFrame) -> DataFrame:
    """Suggestions for all tables, given the key column of each and the checked references."""
    fk = references.where("holds").select(F.col("child_table").alias("table_name"),
                                          F.col("child_column").alias("column_name"),
                                          F.lit(True).alias("is_fk")).distinct()
    is_key = F.lit(False)
    for table, column in keys.items():
        is_key = is_key | ((F.col("table_name") == table) & (F.col("column_name") == column))
    flags = describe_columns(tables).select("table_name", "column_name", is_key.alias("is_key")).join(
        fk, ["table_name", "column_name"], "left")
    return suggest(flags.withColumn("is_fk", F.coalesce("is_fk", F.lit(False))))


def suggested_rules(suggestions: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """One rule dictionary per table, as JSON that the spec loader accepts."""
    column = F.struct(F.col("column_name").alias("name"),
                      F.struct(F.col("generator").alias("type"), "provider").alias("gen"))
    grouped = suggestions.groupBy("table_name").agg(F.sort_array(F.collect_list(column)).alias("columns"))
    pk = F.lit("id")
    for table, key in keys.items():
        pk = F.when(F.col("table_name") == table, key).otherwise(pk)
    rule = F.struct(F.col("table_name").alias("name"), pk.alias("pk"), "columns")
    return grouped.select("table_name", F.to_json(rule).alias("rules"))
