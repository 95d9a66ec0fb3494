"""Distinct masks, with and without values already taken."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.providers import register_provider
from ..operators.mask import MaskedTable
from ..operators.verify import duplicates, uniqueness
from . import _sql as sql
from ._common import faker, lookup, masked, rule

CODES = 150
NUMBERED = 200  # "Supplier#000000000" .. "Supplier#000000199"


def _numbered(scope):
    return F.concat(F.lit("Supplier#"), F.lpad(scope.pick(0, NUMBERED).cast("string"), 9, "0"))


def _coded(scope):
    return F.concat(F.lit("C-"), scope.pick(1, CODES).cast("string"))


register_provider("example_numbered", _numbered, domain=NUMBERED)
register_provider("example_coded", _coded, domain=CODES)


def _supplier(column: dict, **settings: object):
    return lambda spark, sf_dir: masked(spark, sf_dir, "supplier", "s_suppkey", [column], **settings).output()


def _short_text(spark: SparkSession, sf_dir: str) -> MaskedTable:
    return masked(spark, sf_dir, "orders", "o_orderkey", [faker("o_orderpriority", "short_text", force_unique=True)])


def _existing(spark: SparkSession, sf_dir: str) -> MaskedTable:
    """Names of some suppliers are redrawn from the numbers the others keep."""
    return masked(spark, sf_dir, "supplier", "s_suppkey", [
        faker("s_name", "example_numbered", unique=True)], source={"filter": "s_nationkey < 12"})


def _failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked(spark, sf_dir, "supplier", "s_suppkey", [faker("s_name", "first_name", unique=True)]).failed()


def _coupled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A refused name takes the other columns of its row along to the next try."""
    base = lookup(spark, sf_dir)("supplier").withColumn("s_mail", F.col("s_name"))
    from ..plans.spec import MaskSpec
    spec = MaskSpec.from_dict({"salt": "pepper", "tables": [{"name": "supplier", "pk": "s_suppkey", "columns": [
        faker("s_name", "example_numbered", unique=True), rule("s_mail", "hash")]}]})
    return MaskedTable(base, spec.tables[0], spec).output()


def _joint(spark: SparkSession, sf_dir: str, **settings: object) -> MaskedTable:
    """Two UNIQUE columns: a row's try counts only if both values are free, also of those that other rows keep."""
    base = lookup(spark, sf_dir)("supplier").withColumn("s_code", F.concat(F.lit("C-"), F.col("s_suppkey").cast("string")))
    from ..plans.spec import MaskSpec
    spec = MaskSpec.from_dict({"salt": "pepper", "tables": [{"name": "supplier", "pk": "s_suppkey", **settings, "columns": [
        faker("s_name", "example_numbered", unique=True), faker("s_code", "example_coded", unique=True)]}]})
    return MaskedTable(base, spec.tables[0], spec)


def _by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal originals share their tries, so a group has at most as many masks as tries."""
    return masked(spark, sf_dir, "part", "p_partkey", [
        faker("p_brand", "phone_number", seed_by="value", force_unique=True)]).output()


def _check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uniqueness(_short_text(spark, sf_dir).output(), ["o_orderpriority"])


def _kept_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values shared by rows of a column that has no rule about uniqueness."""
    return duplicates(masked(spark, sf_dir, "customer", "c_custkey", [faker("c_name", "phone_number")]).output(),
                      ["c_name"])


QUERIES = {
    "uniq_phone": _supplier(faker("s_name", "phone_number", force_unique=True)),
    "uniq_phone_customer": lambda spark, sf: masked(spark, sf, "customer", "c_custkey", [
        faker("c_name", "phone_number", force_unique=True)]).output(),
    "uniq_first_name_exhaust": _supplier(faker("s_name", "first_name", force_unique=True)),
    "uniq_existing": lambda spark, sf: _existing(spark, sf).output(),
    "uniq_failed_rows": _failed,
    "uniq_coupled_columns": _coupled,
    "uniq_joint_columns": lambda spark, sf: _joint(spark, sf).output(),
    "uniq_joint_existing": lambda spark, sf: _joint(spark, sf, source={"filter": "s_nationkey < 20"}).output(),
    "uniq_by_value": _by_value,
    "uniq_short_text": lambda spark, sf: _short_text(spark, sf).output(),
    "uniq_check": _check,
    "uniq_duplicates": _kept_duplicates,
}

_numbered_sql = f"('Supplier#' || printf('%09d', {sql.pick(0, NUMBERED)}))"


def _joint_sql(where: str = "true") -> str:
    """The serial pass with two lists of seen values; ``where`` are the rows masked, the others keep theirs."""
    seed = sql.pk_seed("supplier", "s_suppkey", attempt="i.a")
    kept = f"(SELECT coalesce(list({{}}), []::VARCHAR[]) FROM t WHERE NOT ({where}))"
    return f"""WITH RECURSIVE t AS MATERIALIZED (SELECT *, 'C-' || s_suppkey AS s_code FROM supplier),
options AS MATERIALIZED (
  SELECT s_suppkey AS pk, list({_numbered_sql} ORDER BY a) AS names, list('C-' || {sql.pick(1, CODES)} ORDER BY a) AS codes
  FROM (SELECT t.*, i.a, sha256({seed}) AS h FROM t, range(11) AS i(a) WHERE {where}) GROUP BY 1),
numbered AS MATERIALIZED (SELECT row_number() OVER (ORDER BY pk) AS rn, * FROM options),
walk AS (
  SELECT 0::BIGINT AS rn, {kept.format('s_name')} AS had_names, {kept.format('s_code')} AS had_codes, NULL::BIGINT AS attempt
  UNION ALL
  SELECT rn, CASE WHEN free IS NULL THEN had_names ELSE list_append(had_names, names[free + 1]) END,
    CASE WHEN free IS NULL THEN had_codes ELSE list_append(had_codes, codes[free + 1]) END, free FROM (
    SELECT n.rn, w.had_names, w.had_codes, n.names, n.codes, list_filter(range(11), lambda j:
      NOT list_contains(w.had_names, n.names[j + 1]) AND NOT list_contains(w.had_codes, n.codes[j + 1]))[1] AS free
    FROM walk w JOIN numbered n ON n.rn = w.rn + 1))
SELECT t.* REPLACE (CASE WHEN pk IS NULL THEN s_name ELSE names[attempt + 1] END AS s_name,
  CASE WHEN pk IS NULL THEN s_code ELSE codes[attempt + 1] END AS s_code)
FROM t LEFT JOIN (SELECT n.pk, n.names, n.codes, w.attempt FROM numbered n JOIN walk w USING (rn)) ON pk = s_suppkey"""


def _walked(walk: str, table: str, pk: str, column: str, tries: int) -> str:
    return (f"{walk} SELECT t.* REPLACE (vals[coalesce(attempt, {tries - 1}) + 1] AS {column}) "
            f"FROM {table} t JOIN tries_of ON pk = {pk}")


ORACLES = {
    "uniq_phone": _walked(sql.serial("supplier", "s_suppkey", sql.provider("phone_number"), 10),
                          "supplier", "s_suppkey", "s_name", 10),
    "uniq_phone_customer": _walked(sql.serial("customer", "c_custkey", sql.provider("phone_number"), 10),
                                   "customer", "c_custkey", "c_name", 10),
    "uniq_first_name_exhaust": _walked(sql.serial("supplier", "s_suppkey", sql.provider("first_name"), 10),
                                       "supplier", "s_suppkey", "s_name", 10),
    "uniq_existing": sql.serial(
        "supplier", "s_suppkey", _numbered_sql, 11, where="s_nationkey < 12",
        taken="(SELECT list(s_name) FROM supplier WHERE s_nationkey >= 12)")
        + " SELECT t.* REPLACE (CASE WHEN pk IS NULL THEN s_name ELSE vals[attempt + 1] END AS s_name) "
          "FROM supplier t LEFT JOIN tries_of ON pk = s_suppkey",
    "uniq_failed_rows": sql.serial("supplier", "s_suppkey", sql.provider("first_name"), 11)
        + " SELECT 'supplier' AS table_name, 's_name' AS column_name, pk AS s_suppkey, "
          "'no unique value after 10 retries' AS reason FROM tries_of WHERE attempt IS NULL",
    "uniq_coupled_columns": sql.serial("supplier", "s_suppkey", _numbered_sql, 11)
        + f" SELECT t.* REPLACE (vals[attempt + 1] AS s_name), "
          f"{sql.pk_seed('supplier', 's_suppkey', attempt='coalesce(attempt, 10)')} AS s_mail "
          f"FROM supplier t JOIN tries_of ON pk = s_suppkey",
    "uniq_joint_columns": _joint_sql(),
    "uniq_joint_existing": _joint_sql("s_nationkey < 20"),
    "uniq_by_value": _walked(sql.serial("part", "p_partkey", sql.provider("phone_number"), 10, by_value="p_brand"),
                             "part", "p_partkey", "p_brand", 10),
    # No two first tries are equal in these tables; a row that lost would show as NULL here.
    "uniq_short_text": "SELECT * EXCLUDE (o) REPLACE (CASE WHEN o = 1 THEN o_orderpriority END AS o_orderpriority) "
                       "FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS o FROM ("
                       + sql.masked("orders", "o_orderkey", {"o_orderpriority": sql.provider("short_text")}) + "))",
    "uniq_check": "SELECT count(*) AS n_rows, count(*) AS n_distinct, 0::BIGINT AS n_duplicates FROM orders",
    "uniq_duplicates": "SELECT c_name, count(*) AS n_rows FROM ("
                       + sql.masked("customer", "c_custkey", {"c_name": sql.provider("phone_number")})
                       + ") GROUP BY 1 HAVING count(*) > 1",
}
