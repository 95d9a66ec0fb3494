"""Discovery, suggestions and preflight over all tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.generators import register_generator
from ..operators import discover as disc
from ..operators import keys as k
from ..plans.preflight import key_counts, preflight
from ..plans.spec import MaskSpec
from ..storage import Workspace, scratch_path
from ._common import SALT, TABLES, faker, lookup, rule, spec_of, tables

# Columns that can be keys (no floating point, no arrays), in schema order.
_KEY_COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", None, "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", None, "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", None, None, None, None, "l_returnflag",
                 "l_linestatus", "l_shipdate"],
    "events": ["event_id", "ts", "user_id", "event_type", None, "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", None, "label"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
}


#: Columns that a composite key may have in the query.
LARGEST_KEY = 3


def _column_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all columns, which several readers share."""
    return Workspace(spark, "facts").save(disc.discover_keys(tables(spark, sf_dir)), "columns")


def _found(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], dict[str, str], DataFrame]:
    """Tables, the key of each, and the references between them."""
    found = tables(spark, sf_dir)
    keys = k.find_keys(found)
    return found, keys, disc.discover_fk(found, keys)


def _fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir)[2]


def _fk_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables whose keys are both called ``id``, and a narrower column named after its table."""
    find = lookup(spark, sf_dir)
    customer = find("customer").select(F.col("c_custkey").alias("id"), "c_name")
    orders = find("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("int").alias("customer_id"))
    return disc.discover_fk({"customers": customer, "orders": orders}, {"customers": "id", "orders": "id"})


def _declared_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declared reference that no name suggests, beside those that names do."""
    find = lookup(spark, sf_dir)
    spec = spec_of("events", "event_id", [rule("props", "hash")], foreign_keys={"user_id": "customer.c_custkey"})
    found = {"customer": find("customer"), "events": find("events")}
    return disc.discover_fk(found, {"customer": "c_custkey", "events": "event_id"}, spec.references())


def _cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _, references = _found(spark, sf_dir)
    return disc.fk_cycles(references.where("holds"), found)


def _suggestions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, str]]:
    found, keys, references = _found(spark, sf_dir)
    return disc.analyze(found, keys, references), keys


def _composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.discover_composite_keys(tables(spark, sf_dir), _column_facts(spark, sf_dir), LARGEST_KEY)


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is known of every column."""
    found, _, references = _found(spark, sf_dir)
    return disc.describe_columns(found, _column_facts(spark, sf_dir), references)


def _by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that only the values show: every column has another name."""
    find = lookup(spark, sf_dir)
    people = find("customer").select(F.col("c_custkey").alias("person_no"), "c_name")
    things = find("orders").select(F.col("o_orderkey").alias("thing_no"), F.col("o_custkey").cast("int").alias("owner"))
    found = {"people": people, "things": things}
    keys = k.find_keys(found)
    return disc.verify_references(found, k.references_by_value(k.discover_inclusions(found), keys))


def _preflight_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    find = lookup(spark, sf_dir)
    spec = MaskSpec.from_dict({"salt": SALT, "allowed": ["testdata"], "tables": [
        {"name": "customer", "pk": "c_custkey", "columns": [faker("c_name", "full_name")]},
        {"name": "orders", "pk": "o_orderkey", "columns": [rule("o_custkey", "counter")]},
        {"name": "conversations", "pk": ["conv_id", "turn"], "columns": [rule("text", "hash")]}]})
    issues = preflight(spark, spec, find, target="testdata").groupBy("table_name").agg(
        F.count(F.lit(1)).alias("n_issues"))
    counts = None
    for t in spec.tables:
        one = key_counts(find(t.name), t.pk).withColumn("table_name", F.lit(t.name))
        counts = one if counts is None else counts.unionByName(one)
    return counts.join(issues, "table_name", "left").select(
        "table_name", "n_rows", "n_null_keys", "n_duplicate_keys",
        F.coalesce("n_issues", F.lit(0)).cast("long").alias("n_issues"))


def _preflight_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = lookup(spark, sf_dir)("lineitem").select(F.col("l_partkey").alias("s_suppkey"), "l_returnflag")
    spec = MaskSpec.from_dict({"tables": [
        {"name": "customer", "pk": "c_custkey", "foreign_keys": {"c_nationkey": "nation.n_nationkey"},
         "not_null": ["c_mktsegment"], "columns": [
             rule("c_custkey", "hash"), faker("c_name", "no_such_provider"), rule("c_mktsegment", "null"),
             rule("c_nationkey", "constant", value="x"), rule("c_phone", "hash"), rule("c_acctbal", "counter")]},
        {"name": "lineitem", "pk": "l_orderkey", "columns": [
            rule("l_returnflag", "template", template="{{ if }}"),
            {**rule("l_quantity", "constant", value="1"), "seed_by": "value"},
            {**rule("l_linestatus", "hash"), "seed_by": "global_id"}]},
        {"name": "supplier", "pk": "s_suppkey", "source": {"type": "view", "name": "parts"}, "columns": [
            faker("s_name", "first_name", force_unique=True), rule("s_nationkey", "counter")]},
        {"name": "missing", "pk": "id", "columns": [rule("a", "hash")]}]})
    return preflight(spark, spec, lookup(spark, sf_dir, parts=parts), target="live_shop")


FILTERS = {
    "customer": "no_such > 1", "orders": "rand() > 0.5", "part": "p_size + 1", "supplier": "count(*) > 1",
    "nation": "n_name >", "region": "r_regionkey < 3 AND r_name IS NOT NULL"}


def _preflight_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters that cannot be resolved, are no conditions or depend on chance, one that is right, and random sources."""
    find = lookup(spark, sf_dir)
    columns = {"customer": ("c_custkey", "c_name"), "orders": ("o_orderkey", "o_orderpriority"), "part": ("p_partkey", "p_name"),
               "supplier": ("s_suppkey", "s_name"), "nation": ("n_nationkey", "n_name"), "region": ("r_regionkey", "r_name")}
    listed = [{"name": t, "pk": columns[t][0], "source": {"filter": f}, "columns": [rule(columns[t][1], "hash")]}
              for t, f in FILTERS.items()]
    listed += [
        {"name": "events", "pk": "event_id", "source": {"type": "view", "name": "drawn"}, "columns": [rule("props", "hash")]},
        {"name": "documents", "pk": "doc_id", "source": {"type": "view", "name": "short", "filter": "nothing = 1"},
         "columns": [rule("text", "hash")]},
        {"name": "benchmark", "pk": "item_id", "source": {"watermark": "text"}, "columns": [rule("text", "hash")]}]
    views = {"drawn": find("events").where(F.rand() < 0.5).select("event_id"), "short": find("documents").where("n_chars < 9")}
    issues = preflight(spark, MaskSpec.from_dict({"salt": SALT, "tables": listed}), lookup(spark, sf_dir, **views))
    return issues.select("severity", "table_name", "column_name", "code")


def _preflight_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings that a strict preflight takes for errors, and a check that a generator brings along."""
    spec = MaskSpec.from_dict({"salt": SALT, "tables": [
        {"name": "supplier", "pk": "s_suppkey", "columns": [faker("s_name", "first_name", force_unique=True)]},
        {"name": "nation", "pk": "n_nationkey", "columns": [rule("n_name", "example_padded", value="3")]},
        {"name": "region", "pk": "r_regionkey", "columns": [rule("r_name", "example_padded", value="many")]}]})
    return preflight(spark, spec, lookup(spark, sf_dir), strict=True)


def _preflight_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared references: one that holds, some whose rows may refer to nothing, one out of reach, and two that lead nowhere."""
    def table(name: str, pk: str, column: str, **references: str) -> dict:
        return {"name": name, "pk": pk, "columns": [rule(column, "hash")], "foreign_keys": references}

    spec = MaskSpec.from_dict({"salt": SALT, "tables": [
        table("orders", "o_orderkey", "o_orderpriority", o_custkey="customer.c_custkey"),
        table("part", "p_partkey", "p_name", p_partkey="supplier.s_suppkey"),
        table("nation", "n_nationkey", "n_name", n_regionkey="area.a_key"),
        table("region", "r_regionkey", "r_name", r_code="nation.n_nationkey"),
        table("supplier", "s_suppkey", "s_name", s_nationkey="nation.n_name")]})
    return preflight(spark, spec, lookup(spark, sf_dir))


register_generator("example_padded", lambda ctx: F.lpad(F.lit("0"), int(ctx.gen.value), "0"),
                   check=lambda gen, dtype: None if gen.value.isdigit() else "the width is no number")


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job that starts from the tables of a database: which there are, and how many suggestions for each."""
    name = f"listed_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{scratch_path(spark, 'listed')}'")
    try:
        for t in ("customer", "orders"):
            place = scratch_path(spark, t)
            lookup(spark, sf_dir)(t).write.parquet(place)
            spark.sql(f"CREATE TABLE {name}.{t} USING parquet LOCATION '{place}'")
        found = disc.list_tables(spark, name)
        keys = k.find_keys(found)
        rows = disc.analyze(found, keys, disc.discover_fk(found, keys)).collect()
        return spark.createDataFrame([(t, keys[t], sum(r["table_name"] == t for r in rows)) for t in found],
                                     "table_name string, key_column string, n_suggestions long")
    finally:
        spark.sql(f"DROP DATABASE {name} CASCADE")


QUERIES = {
    "preflight_filters": _preflight_filters,
    "preflight_strict": _preflight_strict,
    "preflight_references": _preflight_references,
    "list_tables": _listed,
    "discover_keys": lambda spark, sf: disc.discover_keys(tables(spark, sf)),
    "discover_fk": _fk,
    "discover_composite_keys": _composite,
    "discover_inclusions": lambda spark, sf: k.discover_inclusions(tables(spark, sf)),
    "discover_fk_values": _by_value,
    "describe_all": _described,
    "discover_fk_names": _fk_names,
    "declared_fk": _declared_fk,
    "fk_cycles": _cycles,
    "analyze_columns": lambda spark, sf: _suggestions(spark, sf)[0],
    "analyze_json": lambda spark, sf: disc.suggested_rules(*_suggestions(spark, sf)),
    "preflight_ok": _preflight_ok,
    "preflight_issues": _preflight_issues,
}

# ------------------------------------------------------------------------------

_facts = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, {i}::INTEGER AS position, count(*) AS n_rows, "
    f"count({c}) AS n_values, count(DISTINCT {c}) AS n_distinct FROM {t}"
    for t, columns in _KEY_COLUMNS.items() for i, c in enumerate(columns) if c)
_keys = (f"SELECT *, n_values < n_rows AS has_nulls, n_distinct = n_values AS is_unique, "
         f"coalesce(position = min(CASE WHEN n_values = n_rows AND n_distinct = n_rows THEN position END) "
         f"OVER (PARTITION BY table_name), false) AS is_key FROM ({_facts})")

_REFERENCES = [
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("documents", "doc_id", "labels", "doc_id"),
    ("labels", "doc_id", "documents", "doc_id"),
]
_references = " UNION ALL ".join(
    f"SELECT '{ct}' AS child_table, '{cc}' AS child_column, '{pt}' AS parent_table, '{pc}' AS parent_column, "
    f"count(*) AS n_references, count(*) FILTER (WHERE p.k IS NULL) AS n_orphans FROM {ct} c "
    f"LEFT JOIN (SELECT DISTINCT {pc} AS k FROM {pt}) p ON c.{cc} = p.k WHERE c.{cc} IS NOT NULL"
    for ct, cc, pt, pc in _REFERENCES)
_fk_sql = f"SELECT *, n_orphans = 0 AS holds FROM ({_references})"

# Rule name, column name pattern, provider; first match wins.
_RULES = [
    ("Email", "email", "email"),
    ("First Name", "first_name|fname", "first_name"),
    ("Last Name", "last_name|lname", "last_name"),
    ("Full Name", "full_name|fullname|name", "full_name"),
    ("Phone", "phone|tel|mobile", "phone_number"),
    ("Company", "company|organization|org", "company_name"),
    ("IP Address", "ip_address|ipv4|ipv6", "ipv4_address"),
    ("Address", "address|street|city|zip", "short_text"),
]
_rule_case = " ".join(f"WHEN regexp_matches(column_name, '{pattern}', 'i') THEN '{name}'" for name, pattern, _ in _RULES)
_provider_case = " ".join(f"WHEN '{name}' THEN '{provider}'" for name, _, provider in _RULES)
_all_columns = " UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name FROM (DESCRIBE {t})" for t in TABLES)
_analyze_sql = f"""SELECT table_name, column_name, 'faker' AS generator, CASE rule {_provider_case} END AS provider,
    'Matched rule ''' || rule || '''' AS reason FROM (
    SELECT table_name, column_name, CASE {_rule_case} END AS rule FROM ({_all_columns})
    WHERE (table_name, column_name) NOT IN (SELECT (table_name, column_name) FROM ({_keys}) WHERE is_key)
      AND (table_name, column_name) NOT IN (SELECT (child_table, child_column) FROM ({_fk_sql}) WHERE holds))
    WHERE rule IS NOT NULL"""


def _preflight_sql() -> str:
    fixed = [
        ("error", "", "", "missing_salt", "target 'live_shop' looks like production, which needs a salt"),
        ("error", "customer", "c_custkey", "pk_masked", "'c_custkey' belongs to the key, which stays as it is"),
        ("error", "customer", "c_custkey", "type_mismatch",
         "string values do not fit a column of type bigint"),
        ("error", "customer", "c_name", "unknown_provider", "unknown faker provider 'no_such_provider'"),
        ("error", "customer", "c_mktsegment", "not_null", "column 'c_mktsegment' is declared NOT NULL"),
        ("warning", "customer", "c_nationkey", "fk_masked",
         "'c_nationkey' refers to another table; its masks may refer to nothing"),
        ("error", "customer", "c_nationkey", "type_mismatch",
         "string values do not fit a column of type int"),
        ("error", "customer", "c_phone", "column_missing", "table 'customer' has no column 'c_phone'"),
        ("error", "customer", "c_acctbal", "type_mismatch",
         "int64 values do not fit a column of type double"),
        ("error", "lineitem", "l_returnflag", "bad_template", "invalid template: missing value for command"),
        ("error", "lineitem", "l_quantity", "key_type", "values of type double cannot seed masks"),
        ("error", "lineitem", "l_linestatus", "unknown_seed_by", "unknown seed_by 'global_id'"),
        ("error", "supplier", "s_nationkey", "type_mismatch",
         "int64 values do not fit a column of type int"),
        ("error", "missing", "", "table_missing", "there is no table 'missing'"),
    ]
    rows = " UNION ALL ".join(
        "SELECT " + ", ".join("'" + v.replace("'", "''") + f"' AS {n}" for v, n in zip(
            r, ("severity", "table_name", "column_name", "code", "message"))) for r in fixed)
    return f"""{rows}
      UNION ALL SELECT 'error', 'lineitem', 'l_orderkey', 'pk_duplicate', n || ' rows repeat an earlier key'
        FROM (SELECT count(*) - count(DISTINCT l_orderkey) AS n FROM lineitem) WHERE n > 0
      UNION ALL SELECT 'warning', 'supplier', 's_name', 'domain_small', n || ' rows share 6 possible values'
        FROM (SELECT count(*) AS n FROM supplier) WHERE n > 6
      UNION ALL SELECT 'error', 'supplier', 's_suppkey', 'source_duplicate', n || ' source rows repeat an earlier key'
        FROM (SELECT count(*) - count(DISTINCT l_partkey) AS n FROM lineitem) WHERE n > 0
      UNION ALL SELECT 'warning', 'supplier', 's_suppkey', 'source_unmatched', n || ' source rows have no row in the table'
        FROM (SELECT count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT s_suppkey FROM supplier)) WHERE n > 0"""


def _composite_sql() -> str:
    """Counts of all sets of up to three columns; a unique one counts if no unique one is a part of it."""
    sets = [(t, mask) for t, columns in _KEY_COLUMNS.items() for mask in range(1, 1 << len(columns))
            if mask.bit_count() <= LARGEST_KEY and all(c for i, c in enumerate(columns) if mask >> i & 1)]

    def one(t: str, mask: int) -> str:
        chosen = [c for i, c in enumerate(_KEY_COLUMNS[t]) if mask >> i & 1]
        return (f"SELECT '{t}' AS table_name, {mask} AS mask, '{','.join(chosen)}' AS columns, {len(chosen)}::INTEGER AS n_columns, "
                f"count(*) > 0 AND count(DISTINCT ({', '.join(chosen)})) = count(*) AND "
                f"{' AND '.join(f'count({c}) = count(*)' for c in chosen)} AS is_key FROM {t}")

    return (f"WITH s AS MATERIALIZED (SELECT * FROM ({' UNION ALL '.join(one(*x) for x in sets)}) WHERE is_key) "
            "SELECT table_name, columns, n_columns FROM s WHERE NOT EXISTS (SELECT 1 FROM s p WHERE p.table_name = s.table_name "
            "AND p.mask <> s.mask AND (p.mask & s.mask) = p.mask)")


def _inclusions_sql() -> str:
    values = " UNION ALL ".join(
        f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, CASE WHEN typeof({c}) IN ('BIGINT', 'INTEGER', 'SMALLINT') THEN 'integer' "
        f"ELSE typeof({c}) END AS family, {c}::VARCHAR AS v FROM {t} WHERE {c} IS NOT NULL"
        for t, columns in _KEY_COLUMNS.items() for c in columns if c)
    return f"""WITH v AS MATERIALIZED ({values}), n AS (SELECT t, c, count(*) AS n FROM v GROUP BY ALL)
      SELECT a.t AS child_table, a.c AS child_column, b.t AS parent_table, b.c AS parent_column, any_value(n.n) AS n_values
      FROM v a JOIN v b ON a.family = b.family AND a.v = b.v AND (a.t <> b.t OR a.c <> b.c) JOIN n ON n.t = a.t AND n.c = a.c
      GROUP BY a.t, a.c, b.t, b.c HAVING count(*) = any_value(n.n)"""


def _described_part(t: str) -> str:
    return (f"SELECT '{t}' AS table_name, column_name, (row_number() OVER () - 1)::INTEGER AS position, CASE column_type "
            "WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' "
            f"WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' ELSE column_type END AS data_type FROM (DESCRIBE {t})")


_described_sql = f"""SELECT d.table_name, d.column_name, d.position, d.data_type, true AS nullable, f.has_nulls,
      coalesce(f.is_unique, false) AS is_unique, coalesce(f.is_key, false) AS is_key,
      EXISTS (SELECT 1 FROM ({_fk_sql}) r WHERE holds AND r.child_table = d.table_name AND r.child_column = d.column_name) AS is_fk
    FROM ({" UNION ALL ".join(
        _described_part(t) for t in TABLES)}) d
    LEFT JOIN ({_keys}) f ON f.table_name = d.table_name AND f.column_name = d.column_name"""


_filter_issues = [("customer", "", "bad_filter"), ("orders", "", "filter_random"), ("part", "", "filter_type"),
                  ("supplier", "", "bad_filter"), ("nation", "", "bad_filter"), ("events", "", "source_random"),
                  ("documents", "", "bad_source"), ("benchmark", "text", "bad_watermark")]

ORACLES = {
    "preflight_filters": " UNION ALL ".join(
        f"SELECT 'error' AS severity, '{t}' AS table_name, '{c}' AS column_name, '{code}' AS code FROM (SELECT 1 FROM {t} LIMIT 1)"
        for t, c, code in _filter_issues),
    "preflight_strict": """SELECT 'error' AS severity, 'supplier' AS table_name, 's_name' AS column_name, 'domain_small' AS code,
        n || ' rows share 6 possible values' AS message FROM (SELECT count(*) AS n FROM supplier) WHERE n > 6
      UNION ALL SELECT 'error', 'region', 'r_name', 'generator_check', 'the width is no number'""",
    "preflight_references": """SELECT 'warning' AS severity, 'part' AS table_name, 'p_partkey' AS column_name,
        'reference_orphans' AS code, n || ' rows refer to no row of supplier' AS message FROM (
        SELECT count(*) AS n FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier)) WHERE n > 0
      UNION ALL SELECT 'warning', 'orders', 'o_custkey', 'reference_orphans', n || ' rows refer to no row of customer' FROM (
        SELECT count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) WHERE n > 0
      UNION ALL SELECT 'error', 'region', 'r_code', 'bad_reference',
        'region.r_code refers to nation.n_nationkey, and one of them does not exist' FROM (SELECT 1 FROM region LIMIT 1)
      UNION ALL SELECT 'error', 'supplier', 's_nationkey', 'bad_reference',
        'supplier.s_nationkey and nation.n_name are of different types' FROM (SELECT 1 FROM supplier LIMIT 1)""",
    "list_tables": f"""SELECT t.table_name, k.column_name AS key_column, count(s.column_name) AS n_suggestions
      FROM (VALUES ('customer'), ('orders')) t(table_name) JOIN (SELECT * FROM ({_keys}) WHERE is_key) k USING (table_name)
      LEFT JOIN ({_analyze_sql}) s ON s.table_name = t.table_name GROUP BY t.table_name, k.column_name""",
    "discover_composite_keys": _composite_sql(),
    "discover_inclusions": _inclusions_sql(),
    "discover_fk_values": "SELECT 'things' AS child_table, 'owner' AS child_column, 'people' AS parent_table, 'person_no' "
                          "AS parent_column, count(*) AS n_references, 0::BIGINT AS n_orphans, true AS holds FROM orders "
                          "WHERE o_custkey IS NOT NULL HAVING count(*) FILTER (WHERE o_custkey NOT IN "
                          "(SELECT c_custkey FROM customer)) = 0",
    "describe_all": _described_sql,
    "discover_fk_names": "SELECT 'orders' AS child_table, 'customer_id' AS child_column, 'customers' AS parent_table, "
                         "'id' AS parent_column, count(*) AS n_references, count(*) FILTER (WHERE c_custkey IS NULL) "
                         "AS n_orphans, count(*) FILTER (WHERE c_custkey IS NULL) = 0 AS holds FROM orders "
                         "LEFT JOIN customer ON o_custkey = c_custkey WHERE o_custkey IS NOT NULL",
    "declared_fk": "SELECT 'events' AS child_table, 'user_id' AS child_column, 'customer' AS parent_table, "
                   "'c_custkey' AS parent_column, count(*) AS n_references, count(*) FILTER (WHERE c_custkey IS NULL) "
                   "AS n_orphans, count(*) FILTER (WHERE c_custkey IS NULL) = 0 AS holds FROM events "
                   "LEFT JOIN customer ON user_id = c_custkey WHERE user_id IS NOT NULL",
    "discover_keys": _keys,
    "discover_fk": _fk_sql,
    "fk_cycles": f"""WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT child_table AS src, parent_table AS dst
        FROM ({_fk_sql}) WHERE holds),
      reach AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON r.dst = e.src)
      SELECT t.table_name, (SELECT count(*) FROM e WHERE src = t.table_name) AS n_references,
        EXISTS (SELECT 1 FROM reach WHERE src = t.table_name AND dst = t.table_name) AS in_cycle
      FROM (VALUES {', '.join(f"('{t}')" for t in TABLES)}) t(table_name)""",
    "analyze_columns": _analyze_sql,
    "analyze_json": f"""SELECT s.table_name, concat('{{"name":"', s.table_name, '","pk":"', coalesce(k.column_name, 'id'),
        '","columns":[', string_agg(concat('{{"name":"', s.column_name, '","gen":{{"type":"faker","provider":"',
        s.provider, '"}}}}'), ',' ORDER BY s.column_name), ']}}') AS rules
      FROM ({_analyze_sql}) s LEFT JOIN (SELECT table_name, column_name FROM ({_keys}) WHERE is_key) k USING (table_name)
      GROUP BY s.table_name, k.column_name""",
    "preflight_ok": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS n_rows, 0::BIGINT AS n_null_keys, "
        f"count(*) - count(DISTINCT {k}) AS n_duplicate_keys, 0::BIGINT AS n_issues FROM {t}"
        for t, k in (("customer", "c_custkey"), ("orders", "o_orderkey"), ("conversations", "(conv_id, turn)"))),
    "preflight_issues": _preflight_sql(),
}
