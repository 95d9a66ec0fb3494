"""Sources, write-back, previews, reports, preflight, publishing and streams."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from veilwork import (MaskedTable, MaskSpec, apply_spec, check_target, diff, dry_run, latest_state, mask_stream,
                      mask_table, open_tables, preflight, preview, published, register_backend, register_generator,
                      register_source, report, require_clean, run_log, run_report, update_join, write_stream)
from veilwork.operators import discover
from veilwork.operators.keys import find_keys
from veilwork.sources.layout import estimated_rows
from veilwork.operators.verify import checksum, determinism, duplicates, leaks, untouched
from veilwork.plans.preflight import PreflightFailed, TargetNotAllowed, is_production_like, literal_fits
from veilwork.plans.publish import DirtyState, acknowledge, log_state
from veilwork.plans.spec import SpecError
from veilwork.sources.backends import SourceError, jdbc_options
from veilwork.streaming.stream import StreamRuleError
from pyspark.sql import types as T


def spec_of(*tables, **top):
    return MaskSpec.from_dict({"tables": list(tables), **top})


def users_spec(column=None, **settings):
    return spec_of({"name": "users", "pk": "id", "columns": [
        column or {"name": "name", "gen": {"type": "hash"}}], **settings})


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([(i, f"n{i}", i % 3) for i in range(1, 10)], "id long, name string, part int")


def masked(base, spec, **views):
    find = {spec.tables[0].name: base, **views}.__getitem__
    return MaskedTable(base, spec.tables[0], spec, find)


# -- rules ---------------------------------------------------------------------

def test_spec_accepts_the_documented_shape():
    spec = MaskSpec.from_dict({
        "databases": {"local": {"dsn": "postgres://localhost/dev", "default": True}}, "batch_size": 100,
        "locale": "de_DE", "safety": {"salt": "s", "allowed_db_names": ["dev"]},
        "tables": [{"name": "users", "source": {"filter": "id > 0"}, "columns": [
            {"name": "email", "generator": "email"}, {"name": "x", "gen": {"type": "hash", "params": {}}}]}]})
    t = spec.tables[0]
    assert (spec.salt, spec.locale, t.pk, t.source.type) == ("s", "de_DE", ("id",), "table")
    assert (t.columns[0].gen.type, t.columns[0].gen.provider) == ("faker", "email")
    assert spec.is_allowed("dev") and not spec.is_allowed("prod")


@pytest.mark.parametrize("raw", [
    {}, {"tables": []}, {"tables": [{"name": "t"}]}, {"tables": [{"columns": [{"name": "a", "generator": "email"}]}]},
    {"tables": [{"name": "t", "columns": [{"name": "a"}]}]}, {"tabels": []},
    {"tables": [{"name": "t", "columns": [{"name": "a", "generator": "email", "seedby": "value"}]}]},
    {"tables": [{"name": "t", "columns": [{"name": "a", "gen": {"provider": "email"}}]}]},
    {"tables": [{"name": "t", "columns": [{"name": "a", "generator": "email"}, {"name": "a", "generator": "email"}]}]},
    {"tables": [{"name": "t", "source": {"kind": "view"}, "columns": [{"name": "a", "generator": "email"}]}]},
    {"tables": [{"name": "t", "columns": [{"name": "a", "generator": "email", "on_exhausted": "skip"}]}]},
])
def test_malformed_specs(raw):
    with pytest.raises(SpecError):
        MaskSpec.from_dict(raw)


# -- sources ---------------------------------------------------------------------

def test_filter_leaves_other_rows_alone_and_null_is_not_selected(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 0), (3, "c", None)], "id long, name string, part int")
    out = {r.id: r.name for r in masked(df, users_spec(source={"filter": "part > 0"})).output().collect()}
    assert out[2] == "b" and out[3] == "c" and len(out[1]) == 32


def test_view_selects_rows_and_gives_old_values(users):
    view = users.where("part = 1").withColumn("name", F.upper("name"))
    spec = users_spec({"name": "name", "gen": {"type": "template", "template": "{{ .OriginalValue }}!"}},
                      source={"type": "view", "name": "v", "filter": "id > 1"})
    m = masked(users, spec, v=view)
    out = {r.id: r.name for r in m.output().collect()}
    assert out == {i: (f"N{i}!" if i % 3 == 1 and i > 1 else f"n{i}") for i in range(1, 10)}
    assert {(r.old_value, r.new_value) for r in diff(m).collect()} == {("N4", "N4!"), ("N7", "N7!")}


def test_query_returning_only_keys(spark, users):
    users.createOrReplaceTempView("users_q")
    spec = users_spec(source={"type": "query", "sql": "SELECT id FROM users_q WHERE part = 2 ORDER BY id"})
    out = {r.id: r.name for r in masked(users, spec).output().collect()}
    assert all((len(v) == 32) == (k % 3 == 2) for k, v in out.items())


@pytest.mark.parametrize("source", [
    {"type": "query"}, {"type": "query", "sql": "DELETE FROM t ORDER BY 1"}, {"type": "query", "sql": "SELECT 1 AS id"},
    {"type": "view"}, {"type": "nope"}])
def test_bad_sources(users, source):
    with pytest.raises(SourceError):
        masked(users, users_spec(source=source))


def test_query_parameters_are_values(spark, users):
    users.createOrReplaceTempView("users")
    source = {"type": "query", "sql": "SELECT id FROM users WHERE name = :who ORDER BY id"}

    def chosen(who):
        spec = users_spec(source={**source, "params": {"who": who}})
        return [r.id for r in masked(users, spec).selected.collect()]

    assert chosen("n3") == [3] and chosen("n3' OR '1' = '1") == []
    unbound = preflight(spark, users_spec(source=source), {"users": users}.__getitem__)
    assert [r.code for r in unbound.where("severity = 'error'").collect()] == ["bad_source"]
    with pytest.raises(SpecError):
        users_spec(source={**source, "params": "who"})


def test_declared_references_are_checked(spark, users):
    groups = spark.createDataFrame([(0,), (1,)], "part long")
    find = {"users": users, "groups": groups}.__getitem__

    def issues(**references):
        spec = users_spec(foreign_keys=references)
        assert [r[1] for r in spec.references()] == sorted(references)
        return {(r.column_name, r.code, r.message) for r in preflight(spark, spec, find).collect() if "reference" in r.code}

    assert issues(part="groups.part") == {("part", "reference_orphans", "3 rows refer to no row of groups")}
    assert issues(id="users.id") == issues(part="elsewhere.part") == set()
    assert {i[:2] for i in issues(part="groups.gone", gone="groups.part", name="groups.part")} == {
        (c, "bad_reference") for c in ("part", "gone", "name")}


def test_key_named_twice_stops_the_job(users):
    view = users.select("id").unionByName(users.select("id"))
    with pytest.raises(PySparkException, match="more than once"):
        masked(users, users_spec(source={"type": "view", "name": "v"}), v=view).output().collect()


def test_custom_source_and_unmatched_keys(spark, users):
    register_source("test_extra", lambda spark, table, find: find("extra"))
    extra = spark.createDataFrame([(1,), (2,), (99,)], "id long")
    m = masked(users, users_spec(source={"type": "test_extra"}), extra=extra)
    assert [r.id for r in m.unmatched().collect()] == [99]
    assert m.output().where("length(name) = 32").count() == 2 and m.output().count() == 9
    with pytest.raises(ValueError):
        register_source("view", lambda *a: None)


def test_generated_null_wins(users):
    spec = users_spec({"name": "name", "gen": {"type": "null"}}, source={"filter": "part = 0"})
    out = {r.id: r.name for r in masked(users, spec).output().collect()}
    assert out == {i: None if i % 3 == 0 else f"n{i}" for i in range(1, 10)}


def test_update_join(users, spark):
    changes = spark.createDataFrame([(1, None), (2, "x"), (77, "y")], "id long, name string")
    out = {r.id: r.name for r in update_join(users, changes, ["id"]).collect()}
    assert out == {**{i: f"n{i}" for i in range(1, 10)}, 1: None, 2: "x"}
    with pytest.raises(PySparkException):
        update_join(users, changes.unionByName(changes), ["id"]).collect()


def test_backends(spark, users, tmp_path):
    users.write.parquet(f"{tmp_path}/users.parquet")
    users.write.option("header", "true").csv(f"{tmp_path}/users.csv")
    assert open_tables(spark, f"parquet:{tmp_path}")("users").count() == 9
    assert open_tables(spark, f"csv:{tmp_path}")("users").columns == ["id", "name", "part"]
    users.createOrReplaceTempView("users_view")
    assert open_tables(spark, "catalog:")("users_view").count() == 9
    with pytest.raises(SourceError):
        open_tables(spark, "mystery://x")
    with pytest.raises(ValueError):
        register_backend("parquet", None)
    assert jdbc_options("postgres://u:p%40w@db:5433/app?sslmode=disable&numPartitions=8") == {
        "url": "jdbc:postgresql://db:5433/app", "user": "u", "password": "p@w", "sslmode": "disable",
        "numPartitions": "8"}


def test_files_take_options_and_stated_columns(spark, users, tmp_path):
    users.write.option("sep", ";").csv(f"{tmp_path}/users.csv")
    users.write.json(f"{tmp_path}/users.json")
    stated = "schema.users=id+long,+name+string,+part+int&schema.other=x+int"
    csv = open_tables(spark, f"csv:{tmp_path}?header=false&sep=;&{stated}")("users")
    json = open_tables(spark, f"json:{tmp_path}/?{stated}")("users")
    for found in (csv, json):
        assert found.schema == users.schema and sorted(found.collect()) == sorted(users.collect())


def test_catalog_tables_and_estimates(spark, users):
    spark.sql("CREATE DATABASE IF NOT EXISTS listed")
    users.write.mode("overwrite").saveAsTable("listed.people")
    try:
        assert list(discover.list_tables(spark, "listed")) == ["people"]
        assert open_tables(spark, "catalog:listed")("people").count() == 9
        assert estimated_rows(users) == (9, "count")
        spark.sql("ANALYZE TABLE listed.people COMPUTE STATISTICS")
        assert estimated_rows(spark.table("listed.people")) == (9, "statistics")
    finally:
        spark.sql("DROP DATABASE listed CASCADE")


# -- previews, change lists, reports -----------------------------------------------

def test_preview_is_the_beginning_of_the_dry_run(spark, users):
    spec = spec_of({"name": "users", "pk": "id", "columns": [
        {"name": "name", "generator": "first_name", "force_unique": True}], "source": {"filter": "id > 2"}})
    find = {"users": users}.__getitem__
    full = sorted((int(r.pk_value), r.column_name, r.old_value, r.new_value) for r in dry_run(spec, find).collect())
    some = sorted((int(r.pk_value), r.column_name, r.old_value, r.new_value) for r in preview(spec, find).collect())
    assert len(full) == 7 and some == full[:5]


def test_dry_run_writes_nothing_and_differs(spark, users, tmp_path):
    users.write.parquet(f"{tmp_path}/users.parquet")
    before = sorted((p.name, p.stat().st_mtime_ns) for p in (tmp_path / "users.parquet").iterdir())
    changes = dry_run(users_spec(), open_tables(spark, f"parquet:{tmp_path}")).collect()
    assert len(changes) == 9 and all(r.old_value != r.new_value for r in changes)
    assert before == sorted((p.name, p.stat().st_mtime_ns) for p in (tmp_path / "users.parquet").iterdir())


def test_report_counts(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    spec = users_spec({"name": "name", "gen": {"type": "constant", "value": "c"}, "unique": True})
    r = report(masked(df, spec)).first()
    assert (r.selected, r.updated, r.retried, r.failed, r.unmatched) == (2, 1, 10, 1, 0)
    total = run_report(spec, {"users": df}.__getitem__).where("table_name = 'TOTAL'").first()
    assert (total.updated, total.failed) == (1, 1)


# -- preflight -----------------------------------------------------------------------

def test_preflight_and_strict(spark, users):
    find = {"users": users}.__getitem__
    good = users_spec()
    assert preflight(spark, good, find).count() == 0
    warned = users_spec({"name": "part", "gen": {"type": "constant", "value": "1"}},
                        foreign_keys={"part": "parts.id"})
    issues = preflight(spark, warned, find)
    assert [(r.severity, r.code) for r in issues.collect()] == [("warning", "fk_masked")]
    require_clean(issues)
    with pytest.raises(PreflightFailed):
        require_clean(preflight(spark, warned, find, strict=True))


@pytest.mark.parametrize("column, code", [
    ({"name": "name", "generator": "nope"}, "unknown_provider"),
    ({"name": "name", "gen": {"type": "nope"}}, "unknown_generator"),
    ({"name": "name", "gen": {"type": "template", "template": "{{ .X }"}}, "bad_template"),
    ({"name": "name", "gen": {"type": "constant"}}, "missing_parameter"),
    ({"name": "name", "gen": {"type": "null"}, "force_unique": True}, "null_unique"),
    ({"name": "part", "gen": {"type": "hash"}}, "type_mismatch"),
    ({"name": "part", "gen": {"type": "counter"}}, "type_mismatch"),
    ({"name": "id", "gen": {"type": "counter"}}, "pk_masked"),
    ({"name": "gone", "gen": {"type": "hash"}}, "column_missing"),
    ({"name": "name", "generator": "email", "seed_by": "global_id"}, "unknown_seed_by"),
    ({"name": "name", "generator": "first_name", "force_unique": True}, "domain_small"),
    ({"name": "name", "generator": "short_text", "force_unique": True, "seed_by": "value"}, "unique_by_value"),
])
def test_preflight_finds(spark, users, column, code):
    assert code in {r.code for r in preflight(spark, users_spec(column), {"users": users}.__getitem__).collect()}


def test_generators_bring_their_own_checks(spark, users):
    register_generator("test_checked", lambda ctx: ctx.seed,
                       check=lambda gen, dtype: None if gen.value == "ok" else "value must be ok")
    def codes(value):
        spec = users_spec({"name": "name", "gen": {"type": "test_checked", "value": value}})
        return [(r.code, r.message) for r in preflight(spark, spec, {"users": users}.__getitem__).collect()]
    assert codes("ok") == [] and codes("x") == [("generator_check", "value must be ok")]


def test_null_and_repeated_keys(spark):
    df = spark.createDataFrame([(None, "a"), (1, "b"), (1, "c"), (1, "d")], "id long, name string")
    found = {r.code: r.message for r in preflight(spark, users_spec(), {"users": df}.__getitem__).collect()}
    assert found == {"pk_null": "1 rows have a NULL key", "pk_duplicate": "2 rows repeat an earlier key"}


def test_target_guards():
    spec = users_spec()
    with pytest.raises(TargetNotAllowed):
        check_target(spec, "dev")
    check_target(spec, "dev", force=True)
    assert is_production_like("My-PROD-db") and is_production_like("live1") and not is_production_like("dev")


@pytest.mark.parametrize("text, dtype, fits", [
    ("12", T.IntegerType(), True), ("3000000000", T.IntegerType(), False), ("x", T.LongType(), False),
    ("1.5", T.DecimalType(3, 1), True), ("100", T.DecimalType(3, 1), False), ("2024-01-02", T.DateType(), True),
    ("soon", T.TimestampType(), False), ("true", T.BooleanType(), True), ("1e3", T.DoubleType(), True)])
def test_constants_that_fit(text, dtype, fits):
    assert literal_fits(text, dtype) is fits


# -- publishing ------------------------------------------------------------------------

def test_apply_publishes_all_tables(spark, users, tmp_path):
    out = str(tmp_path / "out")
    spec = spec_of({"name": "users", "pk": "id", "columns": [{"name": "name", "gen": {"type": "hash"}}]},
                   allowed=["dev"])
    find = {"users": users}.__getitem__
    assert latest_state(run_log(spark, out)).first()["status"] == "NONE"
    with pytest.raises(TargetNotAllowed):
        apply_spec(spark, spec, find, out, target="other")
    r = apply_spec(spark, spec, find, out, target="dev").first()
    assert (r.table_name, r.updated) == ("users", 9)
    assert latest_state(run_log(spark, out)).first()["status"] == "COMPLETED"
    assert published(spark, out, "users").where("length(name) = 32").count() == 9


def test_failed_run_is_logged_and_must_be_acknowledged(spark, users, tmp_path):
    out = str(tmp_path / "out")
    bad = spec_of({"name": "users", "pk": "id", "columns": [
        {"name": "name", "gen": {"type": "constant", "value": "c"}, "unique": True, "on_exhausted": "fail"}]},
        allowed=["dev"])
    find = {"users": users}.__getitem__
    with pytest.raises(Exception):
        apply_spec(spark, bad, find, out, target="dev")
    assert latest_state(run_log(spark, out)).first()["status"] == "FAILED"
    with pytest.raises(LookupError):
        published(spark, out, "users")
    good = spec_of({"name": "users", "pk": "id", "columns": [{"name": "name", "gen": {"type": "hash"}}]},
                   allowed=["dev"])
    with pytest.raises(DirtyState):
        apply_spec(spark, good, find, out, target="dev")
    acknowledge(spark, out, "looked at")
    assert apply_spec(spark, good, find, out, target="dev").first().updated == 9


def test_interrupted_run_stays_started(spark, tmp_path):
    out = str(tmp_path / "out")
    log_state(spark, out, "r1", 0, "STARTED")
    assert latest_state(run_log(spark, out)).first()["status"] == "STARTED"


# -- discovery ---------------------------------------------------------------------------

def test_cycles_are_exact(spark):
    edges = spark.createDataFrame(
        [("a", "b"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "f"), ("f", "g"), ("g", "h"), ("h", "e"), ("x", "y")],
        "child_table string, parent_table string")
    got = {r.table_name: r.in_cycle for r in discover.fk_cycles(edges, "abcdefghxyz").collect()}
    assert {t for t, c in got.items() if c} == set("abdefgh") and len(got) == 11


def test_suggestions_first_rule_wins(spark):
    names = ["email", "fname", "company_name", "ip_address", "zip", "user_id", "category_org", "LastName_lname", "note"]
    rows = [("t", n, n == "user_id", False) for n in names] + [("t", "phone", False, True)]
    df = spark.createDataFrame(rows, "table_name string, column_name string, is_key boolean, is_fk boolean")
    got = {r.column_name: (r.provider, r.reason) for r in discover.suggest(df).collect()}
    assert {k: v[0] for k, v in got.items()} == {
        "email": "email", "fname": "first_name", "company_name": "full_name", "ip_address": "ipv4_address",
        "zip": "short_text", "category_org": "company_name", "LastName_lname": "last_name"}
    assert got["email"][1] == "Matched rule 'Email'"


def test_suggested_rules_load_as_a_spec(spark, users):
    import json
    tables = {"users": users}
    keys = find_keys(tables)
    none = spark.createDataFrame([], "child_table string, child_column string, holds boolean")
    rules = discover.suggested_rules(discover.analyze(tables, keys, none), keys).first()["rules"]
    spec = MaskSpec.from_dict({"tables": [json.loads(rules)]})
    assert spec.tables[0].pk == ("id",) and spec.tables[0].columns[0].gen.provider == "full_name"


def test_discover_keys_with_nulls(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, None), (3, "a", 5)], "id int, v string, w int")
    got = {r.column_name: (r.n_values, r.n_distinct, r.has_nulls, r.is_unique, r.is_key)
           for r in discover.discover_keys({"t": df}).collect()}
    assert got == {"id": (3, 3, False, True, True), "v": (2, 1, True, False, False), "w": (1, 1, True, True, False)}


# -- verification ---------------------------------------------------------------------------

def test_checks_notice_damage(spark, users):
    damaged = users.where("id < 9").unionByName(users.where("id = 9").withColumn("part", F.lit(7)))
    r = untouched(users, damaged, ["id"], ["name"]).first()
    assert (r.same_schema, r.n_only_before, r.n_only_after) == (True, 1, 1)
    assert checksum(users, ["id", "part"]).first() != checksum(damaged, ["id", "part"]).first()
    assert checksum(users, ["id"]).first() == checksum(users.repartition(3), ["id"]).first()
    assert leaks(users, users, ["id"], ["name"]).first().n_unchanged == 9
    assert [r.part for r in duplicates(users, ["part"]).orderBy("part").collect()] == [0, 1, 2]
    assert determinism([users, damaged]).first().n_only_after == 1


def test_equal_masks_across_tables(spark):
    users = spark.createDataFrame([(1, "alice@x"), (2, "bob@x")], "id int, email string")
    orders = spark.createDataFrame([(7, "bob@x"), (8, "alice@x")], "id int, customer_email string")
    for kind in ({"type": "hash"}, {"type": "faker", "provider": "email"}):
        a = spec_of({"name": "users", "columns": [{"name": "email", "gen": kind, "seed_by": "value"}]})
        b = spec_of({"name": "orders", "columns": [{"name": "customer_email", "gen": kind, "seed_by": "value"}]})
        u = {r.id: r.email for r in mask_table(users, a.tables[0], a).collect()}
        o = {r.id: r.customer_email for r in mask_table(orders, b.tables[0], b).collect()}
        assert u[1] == o[8] and u[2] == o[7]
        assert kind["type"] != "hash" or u[1] != u[2]


def test_same_masks_for_any_partitioning(spark):
    df = spark.createDataFrame([(i, "same") for i in (1, 2, 3)], "id int, name string")
    spec = users_spec({"name": "name", "generator": "first_name"})
    runs = [sorted(map(tuple, masked(df.repartition(n), spec).output().collect())) for n in (1, 4, 16)]
    assert runs[0] == runs[1] == runs[2]


# -- streams ---------------------------------------------------------------------------------

def test_stream_equals_batch(spark, users, tmp_path):
    users.repartition(4).write.parquet(f"{tmp_path}/in")
    spec = users_spec()
    stream = spark.readStream.schema(users.schema).parquet(f"{tmp_path}/in")
    write_stream(mask_stream(stream, spec.tables[0], spec), f"{tmp_path}/out", f"{tmp_path}/state",
                 available_now=True).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == sorted(map(tuple, masked(users, spec).output().collect()))


def test_stream_refuses_rules_that_need_all_rows(spark, users, tmp_path):
    stream = spark.readStream.schema(users.schema).parquet(str(tmp_path))
    for spec in (users_spec({"name": "name", "generator": "short_text", "force_unique": True}),
                 users_spec(source={"type": "view", "name": "v"})):
        with pytest.raises(StreamRuleError):
            mask_stream(stream, spec.tables[0], spec)
