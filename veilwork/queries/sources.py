"""Row sources, write-back, previews, change lists, reports and streams."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diff as d
from ..operators.mask import MaskedTable, mask_table, update_join
from ..operators.verify import duplicates
from ..plans.preflight import static_issues
from ..plans.publish import STARTED, DirtyState, acknowledge, apply_spec, latest_state, log_state, published, run_log
from ..plans.spec import MaskSpec
from ..sources.backends import open_tables, register_source
from ..storage import Workspace, scratch_path
from ..streaming.stream import mask_stream, write_stream
from . import _sql as sql
from ._common import SALT, faker, lookup, masked, rule, spec_of, tables

SINCE = "1998-01-01"
RECENT = f"o_orderdate >= '{SINCE}'"
BUILDERS = ("SELECT o_orderkey, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey "
            "WHERE c_mktsegment = 'BUILDING' ORDER BY o_orderkey")
PRIORITY_BY_VALUE = faker("o_orderpriority", "short_text", seed_by="value")


def _views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    find = lookup(spark, sf_dir)
    for name in names:
        find(name).createOrReplaceTempView(name)


def urgent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view that shows the priority without its number."""
    orders = lookup(spark, sf_dir)("orders").where("o_orderpriority = '1-URGENT'")
    return orders.select("o_orderkey", F.substring("o_orderpriority", 3, 100).alias("o_orderpriority"))


def _view_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked(spark, sf_dir, "orders", "o_orderkey", [PRIORITY_BY_VALUE, rule("o_orderstatus", "hash")],
                  views={"urgent": urgent(spark, sf_dir)}, source={"type": "view", "name": "urgent"}).output()


def _view_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = masked(spark, sf_dir, "orders", "o_orderkey", [PRIORITY_BY_VALUE],
                   views={"urgent": urgent(spark, sf_dir)}, source={"type": "view", "name": "urgent"})
    return table.selected.select(*table.base.columns)


def _query_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir, "orders", "customer")
    return masked(spark, sf_dir, "orders", "o_orderkey", [faker("o_orderpriority", "email")],
                  source={"type": "query", "sql": BUILDERS}).output()


def _query_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query whose values come as parameters, one of which would end a literal if it became text."""
    _views(spark, sf_dir, "orders", "customer")
    text = ("SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = :segment "
            "AND o_orderdate >= CAST(:since AS TIMESTAMP) AND c_name <> :nobody ORDER BY o_orderkey")
    params = {"segment": "MACHINERY", "since": SINCE, "nobody": "x' OR '1' = '1"}
    return masked(spark, sf_dir, "orders", "o_orderkey", [faker("o_orderpriority", "email")],
                  source={"type": "query", "sql": text, "params": params}).output()


def _formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table masked from every kind of file and from the catalog: the masks agree."""
    customer, place = lookup(spark, sf_dir)("customer").select("c_custkey", "c_name"), scratch_path(spark, "formats")
    name = f"formats_{uuid.uuid4().hex}"
    spec = spec_of("customer", "c_custkey", [faker("c_name", "full_name")])
    columns = "schema.customer=c_custkey+bigint,+c_name+string"
    addresses = {"orc": f"orc:{place}", "json": f"json:{place}?{columns}", "csv": f"csv:{place}?{columns}",
                 "parquet": f"parquet:{place}"}
    for fmt in addresses:
        customer.write.format(fmt).option("header", fmt == "csv").save(f"{place}/customer.{fmt}")
    spark.catalog.createTable(name, path=f"{place}/customer.orc", source="orc")
    try:
        parts = [mask_table(open_tables(spark, address)("customer"), spec.tables[0], spec).select(
            F.lit(fmt).alias("format"), "*") for fmt, address in addresses.items()]
        listed = open_tables(spark, "catalog:")(name)
        parts.append(mask_table(listed, spec.tables[0], spec).select(F.lit("catalog").alias("format"), "*"))
        return Workspace(spark, "formats").save(reduce(DataFrame.unionByName, parts), "masked")
    finally:
        spark.sql(f"DROP TABLE {name}")


def _filter_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked(spark, sf_dir, "orders", "o_orderkey", [faker("o_orderpriority", "short_text")],
                  source={"filter": RECENT}).output()


def _unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = lookup(spark, sf_dir)("lineitem").select(F.col("l_partkey").alias("s_suppkey")).distinct()
    return masked(spark, sf_dir, "supplier", "s_suppkey", [rule("s_name", "hash")], views={"parts": parts},
                  source={"type": "view", "name": "parts"}).unmatched()


def _duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = lookup(spark, sf_dir)("orders").join(
        lookup(spark, sf_dir)("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return duplicates(source, ["o_orderkey"])


def _top_accounts(spark: SparkSession, table, find) -> DataFrame:
    return find("customer").where("c_acctbal > 5000").select("c_custkey")


def _custom_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked(spark, sf_dir, "customer", "c_custkey", [rule("c_name", "hash")],
                  source={"type": "example_top_accounts"}).output()


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes with NULLs that must win, and keys (of customers) the base may lack."""
    find = lookup(spark, sf_dir)
    low = F.col("o_orderpriority") == "5-LOW"
    listed = find("orders").where("o_orderstatus = 'F'").select(
        "o_orderkey", F.when(~low, F.lower("o_orderpriority")).alias("o_orderpriority"))
    absent = find("customer").select((-F.col("c_custkey") - 1).alias("o_orderkey"),
                                     F.col("c_name").alias("o_orderpriority"))
    return listed.unionByName(absent)


def _update_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return update_join(lookup(spark, sf_dir)("orders"), changes(spark, sf_dir), ["o_orderkey"])


def _incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old orders were masked earlier; new ones are masked and put in their place."""
    find = lookup(spark, sf_dir)
    columns = [faker("o_orderpriority", "full_name"), rule("o_custkey", "counter")]
    def run(filter_: str) -> MaskedTable:
        return masked(spark, sf_dir, "orders", "o_orderkey", columns, source={"filter": filter_})
    earlier = run(f"NOT ({RECENT})").output()
    recent = run(RECENT).output().where(RECENT).select("o_orderkey", "o_orderpriority", "o_custkey")
    return update_join(earlier, recent, ["o_orderkey"])


def _two_tables() -> MaskSpec:
    return MaskSpec.from_dict({"salt": SALT, "allowed": ["testdata"], "tables": [
        {"name": "customer", "pk": "c_custkey", "columns": [
            faker("c_name", "full_name"), {"name": "c_mktsegment", "gen": {"type": "hash"}, "seed_by": "value"}]},
        {"name": "orders", "pk": "o_orderkey", "source": {"filter": RECENT}, "columns": [
            faker("o_orderpriority", "email"), rule("o_custkey", "counter")]},
    ]})


def _preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.preview(_two_tables(), lookup(spark, sf_dir))


def _full_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.dry_run(_two_tables(), lookup(spark, sf_dir))


def _dry_run_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change the dry run announces, against the table a run gives."""
    find, spec = lookup(spark, sf_dir), _two_tables()
    announced = d.dry_run(spec, find)
    counts = None
    for t in spec.tables:
        out = mask_table(find(t.name), t, spec, find)
        cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("written"))
                          for c in t.masked])
        got = out.select(F.lit(t.name).alias("table_name"), F.col(t.pk[0]).cast("string").alias("pk_value"),
                         F.explode(cells).alias("x")).select("table_name", "pk_value", "x.*")
        one = announced.join(got, ["table_name", "pk_value", "column_name"]).groupBy("table_name").agg(
            F.count(F.lit(1)).alias("n_changes"),
            F.count_if(~F.col("new_value").eqNullSafe(F.col("written"))).alias("n_mismatches"))
        counts = one if counts is None else counts.unionByName(one)
    return counts


def reported() -> MaskSpec:
    return MaskSpec.from_dict({"salt": SALT, "allowed": ["testdata"], "tables": [
        {"name": "customer", "pk": "c_custkey", "columns": [faker("c_name", "full_name")]},
        {"name": "orders", "pk": "o_orderkey", "source": {"filter": RECENT}, "columns": [
            faker("o_orderpriority", "email"), rule("o_custkey", "counter")]},
        {"name": "supplier", "pk": "s_suppkey", "columns": [faker("s_name", "first_name", unique=True)]},
        {"name": "nation", "pk": "n_nationkey", "columns": [faker("n_name", "last_name", force_unique=True)]},
    ]})


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.run_report(reported(), lookup(spark, sf_dir))


def _report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = _two_tables()
    return d.report_json(d.run_report(spec, lookup(spark, sf_dir)))


def _plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir, "orders", "customer")
    spec = MaskSpec.from_dict({"tables": [
        {"name": "customer", "pk": "c_custkey", "columns": [faker("c_name", "full_name")]},
        {"name": "lineitem", "pk": "l_orderkey", "columns": [rule("l_returnflag", "hash"), rule("l_linestatus", "hash")]},
        {"name": "orders", "pk": "o_orderkey", "columns": [rule("o_orderpriority", "hash")],
         "source": {"type": "query", "sql": BUILDERS}},
        {"name": "part", "pk": "p_partkey", "columns": [rule("p_name", "hash")],
         "source": {"type": "view", "name": "cheap"}}]})
    cheap = lookup(spark, sf_dir)("part").where("p_retailprice < 1000")
    return d.plan_summary(spec, lookup(spark, sf_dir, cheap=cheap))


def _run_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over two tables: its logged states and what it published."""
    out = scratch_path(spark, "published")
    spec = _two_tables()
    assert not static_issues(spec)
    apply_spec(spark, spec, lookup(spark, sf_dir), out, target="testdata")
    found = run_log(spark, out).groupBy(F.col("status").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    for t in spec.tables:
        rows = published(spark, out, t.name).agg(F.count(F.lit(1)).alias("n"))
        found = found.unionByName(rows.select(F.lit(t.name).alias("item"), "n"))
    latest = latest_state(run_log(spark, out)).select(F.lit("latest ").alias("a"), "status")
    return found.unionByName(latest.select(F.concat("a", "status").alias("item"), F.lit(1).cast("long").alias("n")))


def _acknowledged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that never ended keeps the next one out until somebody acknowledges it."""
    out, find = scratch_path(spark, "published"), lookup(spark, sf_dir)
    spec = spec_of("customer", "c_custkey", [faker("c_name", "full_name")])
    log_state(spark, out, "lost", 0, STARTED)
    try:
        apply_spec(spark, spec, find, out, target="testdata")
        refused = 0
    except DirtyState:
        refused = 1
    acknowledge(spark, out, "looked at")
    apply_spec(spark, spec, find, out, target="testdata")
    states = run_log(spark, out).groupBy(F.col("status").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    rows = published(spark, out, "customer").agg(F.count(F.lit(1)).alias("n"))
    return states.unionByName(rows.select(F.lit("customer").alias("item"), "n")).unionByName(
        spark.createDataFrame([("refused", refused)], "item string, n long"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = lookup(spark, sf_dir)("events").schema
    spec = spec_of("events", "event_id", [faker("event_type", "username"),
                                          faker("props", "short_text", seed_by="value")])
    incoming = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    place = scratch_path(spark, "stream")
    query = write_stream(mask_stream(incoming, spec.tables[0], spec), f"{place}/out", f"{place}/state",
                         available_now=True)
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{place}/out")


register_source("example_top_accounts", _top_accounts)

QUERIES = {
    "src_table_mask": lambda spark, sf: masked(spark, sf, "customer", "c_custkey", [faker("c_name", "full_name")]).output(),
    "src_view_mask": _view_mask,
    "src_view_selected": _view_selected,
    "src_query_mask": _query_mask,
    "src_query_params": _query_params,
    "src_formats": _formats,
    "src_filter_mask": _filter_mask,
    "src_unmatched": _unmatched,
    "src_query_duplicates": _duplicates,
    "src_custom": _custom_source,
    "update_join": _update_join,
    "incremental_orders": _incremental,
    "preview_diff": _preview,
    "full_diff": _full_diff,
    "verify_dry_run": _dry_run_matches,
    "mask_report": _report,
    "report_json": _report_json,
    "row_estimates": lambda spark, sf: d.row_counts(tables(spark, sf)),
    "plan_summary": _plan_summary,
    "run_state": _run_state,
    "run_acknowledge": _acknowledged,
    "stream_mask_events": _stream,
}

# ------------------------------------------------------------------------------

_urgent_rows = "o_orderpriority = '1-URGENT'"
_recent = f"o_orderdate >= TIMESTAMP '{SINCE} 00:00:00'"


def _changes(limit: str) -> str:
    """Change list of the two-table spec; ``limit`` cuts the rows of each source."""
    def part(table: str, pk: str, seeds: str, where: str, cells: list[tuple[int, str, str, str]]) -> str:
        rows = (f"(SELECT *, sha256(seed) AS h FROM (SELECT *, {sql.pk_seed(table, pk)} AS seed{seeds} FROM {table} "
                f"WHERE {where} {f'ORDER BY {pk} {limit}' if limit else ''}))")
        return " UNION ALL ".join(
            f"SELECT '{table}' AS table_name, {pk}::VARCHAR AS pk_value, {i}::INTEGER AS column_position, "
            f"'{c}' AS column_name, {old}::VARCHAR AS old_value, {new}::VARCHAR AS new_value FROM {rows}"
            for i, c, old, new in cells)
    customer = part("customer", "c_custkey", f", {sql.value_seed('c_mktsegment')} AS v", "true", [
        (0, "c_name", "c_name", sql.provider("full_name")), (1, "c_mktsegment", "c_mktsegment", "v")])
    orders = part("orders", "o_orderkey", "", _recent, [
        (0, "o_orderpriority", "o_orderpriority", sql.provider("email")), (1, "o_custkey", "o_custkey", sql.counter())])
    return f"{customer} UNION ALL {orders}"


def _report_sql() -> str:
    walk_s = sql.serial("supplier", "s_suppkey", sql.provider("first_name"), 11)
    walk_n = sql.serial("nation", "n_nationkey", sql.provider("last_name"), 10)
    return f"""WITH s AS ({walk_s} SELECT count(*) AS n, count(attempt) AS ok, sum(coalesce(attempt, 10)) AS tries
                          FROM tries_of),
      n AS ({walk_n} SELECT count(*) AS n, count(*) - count(attempt) AS kept FROM tries_of),
      t AS (
        SELECT 'customer' AS table_name, 'c_name' AS columns, count(*) AS selected, count(*) AS updated, 0 AS retried,
               0 AS failed, 0 AS duplicates_kept FROM customer
        UNION ALL SELECT 'orders', 'o_orderpriority,o_custkey', count(*), count(*), 0, 0, 0 FROM orders WHERE {_recent}
        UNION ALL SELECT 'supplier', 's_name', n, ok, tries, n - ok, 0 FROM s
        UNION ALL SELECT 'nation', 'n_name', n, n, 0, 0, kept FROM n)
      SELECT table_name, columns, selected::BIGINT AS selected, updated::BIGINT AS updated, retried::BIGINT AS retried,
             failed::BIGINT AS failed, duplicates_kept::BIGINT AS duplicates_kept, 0::BIGINT AS unmatched FROM t
      UNION ALL SELECT 'TOTAL', '', sum(selected)::BIGINT, sum(updated)::BIGINT, sum(retried)::BIGINT,
             sum(failed)::BIGINT, sum(duplicates_kept)::BIGINT, 0::BIGINT FROM t"""


_json_row = ("""concat('{"table_name":"', t, '","columns":"', c, '","selected":', n, ',"updated":', n, """
             """',"retried":0,"failed":0,"duplicates_kept":0,"unmatched":0}')""")

ORACLES = {
    "src_table_mask": sql.masked("customer", "c_custkey", {"c_name": sql.provider("full_name")}),
    "src_view_mask": sql.masked(
        "orders", "o_orderkey", {"o_orderpriority": sql.provider("short_text", "h_v"), "o_orderstatus": "seed"},
        where=_urgent_rows, seeds={"v": sql.value_seed("substr(o_orderpriority, 3)")}),
    "src_view_selected": f"SELECT * FROM orders WHERE {_urgent_rows}",
    "src_query_mask": sql.masked(
        "orders", "o_orderkey", {"o_orderpriority": sql.provider("email")},
        where="o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"),
    "src_query_params": sql.masked(
        "orders", "o_orderkey", {"o_orderpriority": sql.provider("email")},
        where=f"{_recent} AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')"),
    "src_formats": "SELECT f.format, m.* FROM (VALUES ('parquet'), ('orc'), ('json'), ('csv'), ('catalog')) f(format), ("
                   + sql.masked("customer", "c_custkey", {"c_name": sql.provider("full_name")},
                                base="(SELECT c_custkey, c_name FROM customer)") + ") m",
    "run_acknowledge": "SELECT item, n::BIGINT AS n FROM (VALUES ('STARTED', 2), ('ACKNOWLEDGED', 1), ('COMPLETED', 1), "
                       "('refused', 1)) t(item, n) UNION ALL SELECT 'customer', count(*) FROM customer",
    "src_filter_mask": sql.masked("orders", "o_orderkey", {"o_orderpriority": sql.provider("short_text")},
                                  where=_recent),
    "src_unmatched": "SELECT DISTINCT l_partkey AS s_suppkey FROM lineitem "
                     "WHERE l_partkey NOT IN (SELECT s_suppkey FROM supplier)",
    "src_query_duplicates": "SELECT o_orderkey, count(*) AS n_rows FROM orders JOIN lineitem ON o_orderkey = l_orderkey "
                            "GROUP BY 1 HAVING count(*) > 1",
    "src_custom": sql.masked("customer", "c_custkey", {"c_name": "seed"}, where="c_acctbal > 5000"),
    "update_join": "SELECT * REPLACE (CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority "
                   "WHEN o_orderpriority = '5-LOW' THEN NULL ELSE lower(o_orderpriority) END AS o_orderpriority) "
                   "FROM orders",
    "incremental_orders": sql.masked("orders", "o_orderkey", {"o_orderpriority": sql.provider("full_name"),
                                                              "o_custkey": sql.counter()}),
    "preview_diff": _changes("LIMIT 5"),
    "full_diff": _changes(""),
    "verify_dry_run": f"SELECT 'customer' AS table_name, 2 * count(*) AS n_changes, 0::BIGINT AS n_mismatches "
                      f"FROM customer UNION ALL SELECT 'orders', 2 * count(*), 0 FROM orders WHERE {_recent}",
    "mask_report": _report_sql(),
    "report_json": f"""WITH r AS (SELECT 'customer' AS t, 'c_name,c_mktsegment' AS c, count(*) AS n FROM customer
        UNION ALL SELECT 'orders', 'o_orderpriority,o_custkey', count(*) FROM orders WHERE {_recent}),
        a AS (SELECT * FROM r UNION ALL SELECT 'TOTAL', '', sum(n) FROM r)
        SELECT t AS table_name, {_json_row} AS report FROM a""",
    "row_estimates": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in [
        "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
        "embeddings", "pages", "benchmark", "labels", "conversations"]),
    "plan_summary": "SELECT 'customer' AS table_name, 'c_name' AS columns, count(*) AS n_rows FROM customer "
                    "UNION ALL SELECT 'lineitem', 'l_returnflag,l_linestatus', count(*) FROM lineitem "
                    "UNION ALL SELECT 'orders', 'o_orderpriority', 0 "
                    "UNION ALL SELECT 'part', 'p_name', count(*) FROM part WHERE p_retailprice < 1000",
    "run_state": "SELECT item, 1::BIGINT AS n FROM (VALUES ('STARTED'), ('COMPLETED'), ('latest COMPLETED')) t(item) "
                 "UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'orders', count(*) FROM orders",
    "stream_mask_events": sql.masked("events", "event_id", {
        "event_type": sql.provider("username"), "props": sql.provider("short_text", "h_v")},
        seeds={"v": sql.value_seed("props")}),
}
