"""Checks that must see damage: publishing, verification, preflight, discovery."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import types as T

from veilwork import MaskedTable, MaskSpec, apply_spec
from veilwork.operators import discover, verify
from veilwork.operators.diff import preview
from veilwork.plans import preflight, publish
from veilwork.storage import scratch_path


def spec_of(columns, **table):
    return MaskSpec.from_dict({"safety": {"salt": "s", "allowed_db_names": ["dev"]}, "tables": [
        {"name": "t", "pk": "id", "columns": columns, **table}]})


def test_kept_original_equal_to_a_mask_is_not_published(spark):
    """A UNIQUE column whose kept originals meet new masks is refused after writing."""
    df = spark.createDataFrame([(i, "John" if i == 28 else f"v{i}") for i in range(29)], "id long, v string")
    spec = spec_of([{"name": "v", "generator": "first_name", "unique": True, "on_exhausted": "keep_original"}])
    out = scratch_path(spark, "refused")
    masked = MaskedTable(df, spec.tables[0], spec).output()
    assert verify.uniqueness(masked, ["v"]).first()["n_duplicates"] == 1
    with pytest.raises(publish.VerificationFailed):
        apply_spec(spark, spec, lambda name: df, out, target="dev")
    assert publish.latest_state(publish.run_log(spark, out)).first()["status"] == "FAILED"
    with pytest.raises(publish.DirtyState):
        apply_spec(spark, spec, lambda name: df, out, target="dev", force=True)
    fine = spec_of([{"name": "v", "gen": {"type": "hash"}, "unique": True}])
    apply_spec(spark, fine, lambda name: df, out, target="other", force=True, over_unfinished=True)
    assert publish.published(spark, out, "t").count() == 29


def test_null_in_not_null_column_is_not_published(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id long, v string, w string")
    spec = spec_of([{"name": "v", "gen": {"type": "hash"}}], not_null=["w"])
    with pytest.raises((publish.VerificationFailed, preflight.PreflightFailed)):
        apply_spec(spark, spec, lambda name: df, scratch_path(spark, "nulls"), target="dev")


def test_checksum_sees_values_move_between_columns(spark):
    one = spark.createDataFrame([(1, None, "x"), (2, "y", None)], "id long, a string, b string")
    two = spark.createDataFrame([(1, "x", None), (2, None, "y")], "id long, a string, b string")
    columns = ["id", "a", "b"]
    assert verify.checksum(one, columns).first() != verify.checksum(two, columns).first()
    assert verify.checksum(one, columns).first() == verify.checksum(one.repartition(3), columns).first()
    assert tuple(verify.difference(one, two, columns).first()) == (2, 2)


def test_maps_are_compared_and_published(spark):
    kind = "id long, v string, m map<string, struct<a: int, n: map<int, string>>>"
    one = spark.createDataFrame([(1, "p", {"k": (1, {1: "a", 2: None}), "l": (None, {})}), (2, "q", None)], kind)
    same = spark.createDataFrame([(2, "q", None), (1, "p", {"l": (None, {}), "k": (1, {2: None, 1: "a"})})], kind)
    other = spark.createDataFrame([(1, "p", {"k": (1, {1: "a", 2: "b"}), "l": (None, {})}), (2, "q", None)], kind)
    sums = [verify.checksum(d, ["id", "m"]).first() for d in (one, same, other)]
    assert sums[0] == sums[1] != sums[2]
    spec = spec_of([{"name": "v", "gen": {"type": "hash"}}])
    out = scratch_path(spark, "maps")
    apply_spec(spark, spec, lambda name: one, out, target="dev")
    assert publish.published(spark, out, "t").count() == 2


def test_leaks_counts_lost_and_added_rows(spark):
    before = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    after = spark.createDataFrame([(1, "a"), (3, "b")], "id long, v string")
    row = verify.leaks(before, after, ["id"], ["v"]).first()
    assert (row.n_rows, row.n_unchanged, row.n_missing, row.n_added) == (1, 1, 1, 1)


def test_run_log_hides_only_a_missing_place(spark, tmp_path, monkeypatch):
    assert publish.run_log(spark, str(tmp_path / "nothing")).count() == 0
    monkeypatch.setattr(publish, "exists", lambda session, path: True)
    with pytest.raises(AnalysisException):
        publish.run_log(spark, str(tmp_path / "nothing"))


def test_preview_refuses_a_repeated_key(spark):
    """What stops the full run stops the preview, also when the repeat is the last row shown."""
    df = spark.range(20).selectExpr("id", "cast(id AS string) AS v")
    df.createOrReplaceTempView("t_preview")
    for key in (0, 4):
        spec = spec_of([{"name": "v", "gen": {"type": "hash"}}],
                       source={"type": "query", "sql": f"SELECT id, v FROM t_preview UNION ALL SELECT {key}L, 'x' ORDER BY id"})
        with pytest.raises(Exception, match="more than once"):
            preview(spec, lambda name: df).collect()


@pytest.mark.parametrize("dtype, fits", [
    (T.StringType(), True), (T.ArrayType(T.StringType()), False), (T.BinaryType(), False),
    (T.MapType(T.StringType(), T.StringType()), False), (T.IntegerType(), False)])
def test_constants_fit_only_known_types(dtype, fits):
    assert preflight.literal_fits("x", dtype) is fits


def test_references_by_table_name(spark):
    """``orders.customer_id`` refers to ``customer.id``, also as int to long; two ``id`` keys do not refer to each other."""
    customers = spark.range(5).selectExpr("id")
    orders = spark.range(9).selectExpr("id", "cast(id % 5 AS int) AS customer_id", "'x' AS note")
    tables = {"customers": customers, "orders": orders}
    keys = {"customers": "id", "orders": "id"}
    assert discover.fk_candidates(tables, keys) == [("orders", "customer_id", "customers", "id")]
    assert discover.discover_fk(tables, keys).first()["holds"]
    declared = [("orders", "note", "customers", "id")]
    assert discover.fk_candidates(tables, keys, declared=declared)[0] == declared[0]


def test_reference_to_the_own_table(spark):
    staff = spark.range(3).selectExpr("id", "id AS staff_id")
    assert discover.fk_candidates({"staff": staff}, {"staff": "id"}) == [("staff", "staff_id", "staff", "id")]


def test_cycles_after_peeling(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("c", "y"), ("d", "d"), ("p", "q"), ("q", "p"), ("q", "a")]
    frame = spark.createDataFrame([(s, "c", d, "k") for s, d in edges],
                                  "child_table string, child_column string, parent_table string, parent_column string")
    found = {r.table_name: r.in_cycle for r in discover.fk_cycles(frame, "abcdpqxyz").collect()}
    assert found == {t: t in "abcdpq" for t in "abcdpqxyz"}
