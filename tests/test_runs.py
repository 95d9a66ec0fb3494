"""Partitions, reports from the write, claims, estimates and watermarks."""

import pathlib

import pytest
from pyspark.sql import functions as F

from veilwork import MaskSpec, apply_spec, published, run_log, update_join
from veilwork.operators import writeback
from veilwork.operators.diff import row_estimates
from veilwork.operators.writeback import LayoutError, touched_partitions, update_partitions
from veilwork.plans import publish
from veilwork.plans.claim import Claim, PlaceTaken
from veilwork.plans.publish import DirtyState, acknowledge, last_mark, latest_state, log_state
from veilwork.sources import layout

HASH = {"name": "name", "gen": {"type": "hash"}}


def spec_of(columns=(HASH,), name="t", pk="id", **settings):
    return MaskSpec.from_dict({"salt": "s", "allowed": ["dev"], "tables": [
        {"name": name, "pk": pk, "columns": list(columns), **settings}]})


def _placed(spark, path, prefix):
    """Forty rows in partitions of two columns, one of them NULL."""
    spark.range(40).select(
        "id", F.concat(F.lit("n"), "id").alias("name"), F.when(F.col("id") % 4 > 0, F.col("id") % 4).cast("int").alias("part"),
        F.concat(F.lit(prefix), (F.col("id") % 2).cast("string")).alias("code")).write.partitionBy("part", "code").parquet(path)
    return path


@pytest.fixture()
def place(spark, tmp_path):
    return _placed(spark, str(tmp_path / "table"), "x")


@pytest.fixture()
def numbered(spark, tmp_path):
    """Folders whose names Spark reads as integers but would not write again."""
    return _placed(spark, str(tmp_path / "numbered"), "0")


def files(path):
    return {str(p.relative_to(path)): (p.read_bytes(), p.stat().st_mtime_ns) for p in pathlib.Path(path).rglob("part-*")}


def folders(path):
    return {str(p.parent.relative_to(path)) for p in pathlib.Path(path).rglob("part-*")}


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def jobs(spark, work):
    """How many jobs ``work`` starts."""
    spark.sparkContext.setJobGroup("counted", "")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    out = work()
    found = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted")) - before
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return found, out


# -- partitions ------------------------------------------------------------------


def test_partitioning_is_known_of_tables_only(spark, place):
    table = spark.read.parquet(place)
    assert layout.partitioning(table) == ["part", "code"] and len(layout.roots(table)) == 1
    table.createOrReplaceTempView("placed")
    assert layout.partitioning(spark.table("placed")) == ["part", "code"]
    assert layout.partitioning(table.where("id > 3")) == [] and layout.partitioning(spark.range(3)) == []


@pytest.mark.parametrize("prefix", ["x", "0"])
def test_update_partitions_touches_only_what_changed(spark, place, numbered, prefix):
    place = numbered if prefix == "0" else place
    base, before = spark.read.parquet(place), files(place)
    changes = spark.createDataFrame([(1, "x"), (5, None), (4, "in the partition of NULL"), (777, "nobody")],
                                    "id long, name string")
    want = rows(update_join(base, changes, ["id"]))
    names = update_partitions(spark, place, changes, ["id"])
    assert len(names) == 2
    after = files(place)
    touched = {f for f in before if f not in after}
    assert {f.split("/part-")[0] for f in touched} == {f"part=1/code={prefix}1", f"part=__HIVE_DEFAULT_PARTITION__/code={prefix}0"}
    assert all(after[f] == before[f] for f in before if f not in touched)
    assert folders(place) == {f.rsplit("/", 1)[0] for f in before}
    assert rows(spark.read.parquet(place)) == want


def test_update_partitions_reads_only_what_changed(spark, place):
    base = spark.read.parquet(place)
    names = touched_partitions(base, spark.createDataFrame([(1,)], "id long"), ["id"])
    part = base.where(layout.in_partitions(["part", "code"], names))
    assert {"/".join(f.split("/")[-3:-1]) for f in part.inputFiles()} >= {"part=1/code=x1"}
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = part._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "part=1/code=x1" in plan and "DataFilters: []" in plan
    assert part.count() == base.where("part = 1 AND code = 'x1'").count()


def test_update_partitions_without_a_hit_writes_nothing(spark, place):
    before = files(place)
    assert update_partitions(spark, place, spark.createDataFrame([(99, "x")], "id long, name string"), ["id"]) == []
    assert files(place) == before


def test_update_partitions_refuses(spark, place, tmp_path):
    with pytest.raises(LayoutError, match="decide"):
        update_partitions(spark, place, spark.createDataFrame([(1, 3)], "id long, part int"), ["id"])
    flat = str(tmp_path / "flat")
    spark.range(3).withColumn("name", F.lit("a")).write.parquet(flat)
    with pytest.raises(LayoutError, match="no partitions"):
        update_partitions(spark, flat, spark.createDataFrame([(1, "x")], "id long, name string"), ["id"])
    before = files(place)
    with pytest.raises(Exception, match="listed more than once"):
        update_partitions(spark, place, spark.createDataFrame([(1, "x"), (1, "y")], "id long, name string"), ["id"])
    assert files(place) == before


def test_a_large_partition_is_written_by_several_tasks(spark, tmp_path):
    out = str(tmp_path / "spread")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        df = spark.range(200_000).select("id", F.md5(F.col("id").cast("string")).alias("v"), F.lit(1).alias("p"))
        writeback.write_partitions(df, out, ["p"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(files(out)) > 1 and spark.read.parquet(out).count() == 200_000


def test_filtered_run_writes_touched_partitions_and_keeps_the_layout(spark, place, tmp_path):
    out, before = str(tmp_path / "out"), files(place)
    spec = spec_of(source={"filter": "part = 1 AND id < 20"})
    report = apply_spec(spark, spec, lambda name: spark.read.parquet(place), out, target="dev").first()
    run = run_log(spark, out).first()["run_id"]
    assert folders(f"{out}/{run}/t") == {"part=1/code=x1"}
    assert (report.partitions_written, report.selected, report.updated) == (1, 5, 5)
    assert files(place) == before
    found = published(spark, out, "t")
    assert found.columns == spark.read.parquet(place).columns
    assert dict(found.dtypes)["code"] == "string" and found.count() == 40
    assert found.where("length(name) = 32").count() == 5
    assert found.where("length(name) < 32").count() == 35


def test_whole_run_keeps_the_layout(spark, place, tmp_path):
    out = str(tmp_path / "out")
    apply_spec(spark, spec_of(), lambda name: spark.read.parquet(place), out, target="dev")
    run = run_log(spark, out).first()["run_id"]
    assert folders(f"{out}/{run}/t") == folders(place)
    assert published(spark, out, "t").where("length(name) = 32").count() == 40


def test_masked_partition_column_rewrites_the_table(spark, place, tmp_path):
    out = str(tmp_path / "out")
    spec = spec_of([{"name": "code", "gen": {"type": "hash"}}], source={"filter": "id < 3"})
    apply_spec(spark, spec, lambda name: spark.read.parquet(place), out, target="dev")
    assert published(spark, out, "t").where("length(code) = 32").count() == 3


# -- reports ---------------------------------------------------------------------


def test_rows_are_masked_by_one_job(spark, tmp_path):
    """Of all jobs of a run, one computes the masks; the report is counted by it."""
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(50).select("id", F.lit("a").alias("name")).write.parquet(path)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string", useArrow=False)
    def counted(value):
        seen.add(1)
        return value

    from veilwork import register_generator
    register_generator("counted_once", lambda ctx: counted(F.col("name")))
    report = apply_spec(spark, spec_of([{"name": "name", "gen": {"type": "counted_once"}}]),
                        lambda name: spark.read.parquet(path), out, target="dev").first()
    assert seen.value == 50
    assert (report.estimate, report.estimated_from, report.types, report.selected) == (50, "footers", "string", 50)
    assert report.started_at <= report.ended_at and report.duration_ms >= 0


def test_report_counts_retries_failures_and_unmatched(spark, tmp_path):
    base = spark.createDataFrame([(i, "v") for i in range(30)], "id long, name string")
    rule = {"name": "name", "generator": "first_name", "unique": True}
    report = apply_spec(spark, spec_of([rule]), lambda name: base, str(tmp_path / "a"), target="dev").first()
    assert (report.selected, report.updated, report.failed) == (30, 6, 24) and report.retried >= 240
    view = spark.createDataFrame([(1,), (2,), (99,)], "id long")
    spec = spec_of(source={"type": "view", "name": "v"})
    report = apply_spec(spark, spec, {"t": base, "v": view}.__getitem__, str(tmp_path / "b"), target="dev").first()
    assert (report.selected, report.unmatched, report.source, report.estimate) == (2, 1, "view", 3)


def test_empty_tables_are_published(spark, tmp_path):
    base = spark.createDataFrame([], "id long, name string")
    report = apply_spec(spark, spec_of(), lambda name: base, str(tmp_path / "out"), target="dev").first()
    assert (report.selected, report.updated) == (0, 0) and published(spark, str(tmp_path / "out"), "t").count() == 0


# -- one writer --------------------------------------------------------------------


def test_of_two_runs_one_raises(spark, tmp_path):
    """A run that starts while another writes, and one after a run that never gave its claim back."""
    base, out = spark.createDataFrame([(1, "a")], "id long, name string"), str(tmp_path / "out")
    tried = []

    def lookup(name):
        if not tried:
            tried.append(True)  # preflight
        elif len(tried) == 1 and latest_state(run_log(spark, out)).first()["status"] == "STARTED":
            tried.append(True)
            with pytest.raises((PlaceTaken, DirtyState)):
                apply_spec(spark, spec_of(), lambda name: base, out, target="dev")
            with pytest.raises(PlaceTaken):
                Claim(spark, out, "other").take()
        return base

    apply_spec(spark, spec_of(), lookup, out, target="dev")
    assert len(tried) == 2
    assert [r.status for r in run_log(spark, out).orderBy("updated_at", "seq").collect()] == ["STARTED", "COMPLETED"]
    Claim(spark, out, "crashed").take()
    with pytest.raises(PlaceTaken, match="crashed"):
        apply_spec(spark, spec_of(), lambda name: base, out, target="dev")
    apply_spec(spark, spec_of(), lambda name: base, out, target="dev", over_unfinished=True)
    assert Claim(spark, out, "x").holder() is None


def test_claims(spark, tmp_path):
    out = str(tmp_path / "claims")
    first, second = Claim(spark, out, "one"), Claim(spark, out, "two")
    first.take()
    with pytest.raises(PlaceTaken, match="one"):
        second.take()
    second.release()
    assert first.holder() == "one"
    second.take(over=True)
    with pytest.raises(PlaceTaken, match="lost"):
        first.check()
    first.release()
    assert second.holder() == "two"
    second.release()
    first.take()
    first.check()


def test_acknowledged_run_leaves_no_claim_in_the_way(spark, tmp_path):
    base, out = spark.createDataFrame([(1, "a")], "id long, name string"), str(tmp_path / "out")
    Claim(spark, out, "dead").take()
    log_state(spark, out, "dead", 0, "STARTED")
    with pytest.raises(DirtyState):
        apply_spec(spark, spec_of(), lambda name: base, out, target="dev")
    acknowledge(spark, out)
    assert apply_spec(spark, spec_of(), lambda name: base, out, target="dev").first().updated == 1


# -- estimates ---------------------------------------------------------------------


def test_statistics_need_no_job(spark, tmp_path):
    spark.range(70).write.parquet(str(tmp_path / "kept"))
    spark.catalog.createTable("with_statistics", path=str(tmp_path / "kept"), source="parquet")
    try:
        spark.sql("ANALYZE TABLE with_statistics COMPUTE STATISTICS")
        table = spark.table("with_statistics")
        assert jobs(spark, lambda: layout.estimated_rows(table)) == (0, (70, "statistics"))
    finally:
        spark.sql("DROP TABLE with_statistics")


def test_footers_of_some_files_stand_for_all(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "many")
    spark.range(4000).repartition(20).write.parquet(path)
    assert layout.estimated_rows(spark.read.parquet(path)) == (4000, "footers")
    monkeypatch.setattr(layout, "SAMPLED_FILES", 5)
    rows, known = layout.estimated_rows(spark.read.parquet(path))
    assert known == "footers" and 3600 < rows < 4400
    found = {r.table_name: (r.n_rows, r.known_from) for r in row_estimates(
        {"a": spark.read.parquet(path).where("id < 10"), "b": spark.range(5)}).collect()}
    assert found == {"a": (10, "count"), "b": (5, "count")}


# -- watermarks ---------------------------------------------------------------------


def _arrived(spark, n):
    """Rows come in order of ``at``, which has ties and NULLs."""
    return spark.createDataFrame([(i, f"n{i}", None if i % 11 == 0 else i // 4) for i in range(n)],
                                 "id long, name string, at int")


def test_runs_continue_at_the_watermark(spark, tmp_path):
    out, spec = str(tmp_path / "out"), spec_of(source={"watermark": "at"})
    selected = []
    for n in (30, 34, 34, 60):
        frame = _arrived(spark, n)
        selected.append(apply_spec(spark, spec, lambda name, now=frame: now, out, target="dev").first().selected)
    assert last_mark(spark, out, spec.tables[0]) == "14"
    whole = str(tmp_path / "whole")
    apply_spec(spark, spec_of(), lambda name: _arrived(spark, 60), whole, target="dev")
    assert rows(published(spark, out, "t")) == rows(published(spark, whole, "t"))
    # Rows of the last value, and those without one, are taken again; nothing else is.
    assert selected[:3] == [30, 5 + 4, 1 + 4] and selected[3] < 40


def test_changed_rows_replace_earlier_ones(spark, tmp_path):
    out, spec = str(tmp_path / "out"), spec_of(
        [{"name": "name", "gen": {"type": "hash"}, "seed_by": "value"}], source={"watermark": "at", "filter": "id < 50"})
    first = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (60, "c", 2)], "id long, name string, at int")
    apply_spec(spark, spec, lambda name: first, out, target="dev")
    later = spark.createDataFrame([(1, "A", 3), (2, "b", 2)], "id long, name string, at int")
    apply_spec(spark, spec, lambda name: later, out, target="dev")
    whole = str(tmp_path / "whole")
    apply_spec(spark, spec_of([{"name": "name", "gen": {"type": "hash"}, "seed_by": "value"}]), lambda name: later, whole,
               target="dev")
    assert rows(published(spark, out, "t")) == rows(published(spark, whole, "t"))


def test_nothing_new_keeps_the_mark(spark, tmp_path):
    out, spec = str(tmp_path / "out"), spec_of(source={"watermark": "at"})
    apply_spec(spark, spec, lambda name: _arrived(spark, 9), out, target="dev")
    empty = _arrived(spark, 9).where("false")
    apply_spec(spark, spec, lambda name: empty, out, target="dev")
    assert last_mark(spark, out, spec.tables[0]) == "2"
    assert published(spark, out, "t").count() == 9


def test_a_failed_run_does_not_move_the_mark(spark, tmp_path, monkeypatch):
    out, spec = str(tmp_path / "out"), spec_of(source={"watermark": "at"})
    apply_spec(spark, spec, lambda name: _arrived(spark, 9), out, target="dev")
    with monkeypatch.context() as m:
        m.setattr(publish, "_verify", lambda *a: (_ for _ in ()).throw(RuntimeError("broken")))
        with pytest.raises(RuntimeError):
            apply_spec(spark, spec, lambda name: _arrived(spark, 30), out, target="dev")
    assert last_mark(spark, out, spec.tables[0]) == "2" and published(spark, out, "t").count() == 9
    apply_spec(spark, spec, lambda name: _arrived(spark, 30), out, target="dev", over_unfinished=True)
    assert published(spark, out, "t").count() == 30


# -- filters and sources on resolved plans -----------------------------------------------


def _codes(spark, spec, lookup):
    from veilwork import preflight
    return sorted((r.code, r.column_name) for r in preflight(spark, spec, lookup, target="dev").collect())


@pytest.mark.parametrize("text, code", [
    ("no_such > 1", "bad_filter"), ("rand() > 0.5", "filter_random"), ("id", "filter_type"), ("count(id) > 1", "bad_filter"),
    ("id >", "bad_filter"), ("row_number() over (order by id) < 3", "bad_filter"), ("uuid() = name", "filter_random"),
    ("id > 3 AND name IS NOT NULL", None)])
def test_filters_are_resolved_before_a_run(spark, tmp_path, text, code):
    base, out = spark.createDataFrame([(i, f"n{i}") for i in range(9)], "id long, name string"), str(tmp_path / "out")
    spec = spec_of(source={"filter": text})
    assert [c for c, _ in _codes(spark, spec, lambda name: base)] == ([code] if code else [])
    if code:
        with pytest.raises(ValueError, match="filter"):
            apply_spec(spark, spec, lambda name: base, out, target="dev")
        assert run_log(spark, out).count() == 0 and Claim(spark, out, "x").holder() is None


def test_random_sources_are_refused(spark):
    base = spark.createDataFrame([(1, "a")], "id long, name string")
    chance = F.udf(lambda: True, "boolean", useArrow=False).asNondeterministic()
    for view in (base.where(F.rand() < 2), base.where(chance())):
        spec = spec_of(source={"type": "view", "name": "v"})
        assert _codes(spark, spec, {"t": base, "v": view}.__getitem__) == [("source_random", "")]
    base.createOrReplaceTempView("drawn_from")
    spec = spec_of(source={"type": "query", "sql": "SELECT id FROM drawn_from WHERE rand() < 2 ORDER BY id"})
    assert _codes(spark, spec, lambda name: base) == [("source_random", "")]


def test_watermark_rules(spark):
    base = spark.createDataFrame([(1, "a", [1])], "id long, name string, list array<int>")
    for column, settings in (("nothing", {}), ("list", {}), ("name", {}), ("id", {"unique": True})):
        spec = spec_of([{**HASH, **settings}], source={"watermark": column})
        assert _codes(spark, spec, lambda name: base) == [("bad_watermark", column)]


# -- streams with sources ----------------------------------------------------------------


def test_stream_with_a_view_publishes_each_batch_once(spark, tmp_path):
    from veilwork import mask_table, publish_stream, published_batches
    from veilwork.streaming.stream import StreamRuleError, publish_batch

    incoming, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    rows_ = spark.createDataFrame([(i, f"n{i}") for i in range(20)], "id long, name string")
    rows_.where("id < 10").coalesce(1).write.parquet(incoming)
    view = spark.createDataFrame([(i, "old") for i in range(0, 40, 3)], "id long, name string")
    spec = spec_of([{"name": "name", "gen": {"type": "hash"}, "seed_by": "value"}], source={"type": "view", "name": "v"})
    table, find = spec.tables[0], {"v": view}.__getitem__

    def run():
        stream = spark.readStream.schema(rows_.schema).parquet(incoming)
        publish_stream(stream, table, spec, find, out, state, available_now=True).awaitTermination()
        return rows(published_batches(spark, out, rows_))

    assert run() == rows(mask_table(rows_.where("id < 10"), table, spec, find))
    rows_.where("id >= 10").coalesce(1).write.mode("append").parquet(incoming)
    whole = rows(mask_table(rows_, table, spec, find))
    assert run() == whole
    # Batch 1 again, as after a driver that died before Spark noted that it was done; then with other rows.
    commit = tmp_path / "state" / "commits" / "1"
    commit.unlink()
    (commit.parent / ".1.crc").unlink(missing_ok=True)
    before = files(out)
    assert run() == whole and files(out) == before
    assert not publish_batch(rows_, 1, table, spec, find, out) and files(out) == before
    # A try that was interrupted is written again.
    log_state(spark, out, "batch-2", 0, "STARTED")
    rows_.limit(3).write.parquet(f"{out}/batch-2")
    assert rows(published_batches(spark, out, rows_)) == whole
    assert publish_batch(rows_.where("id = 3"), 2, table, spec, find, out)
    assert published_batches(spark, out, rows_).count() == 21
    with pytest.raises(StreamRuleError):
        publish_stream(rows_, spec_of([{**HASH, "unique": True}]).tables[0], spec, find, out, state)
