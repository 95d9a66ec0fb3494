"""Distinct masks against a serial loop."""

import random

import pytest
from pyspark.sql import functions as F

import serial
from veilwork import MaskedTable, MaskSpec
from veilwork.functions.providers import register_provider
from veilwork.operators import unique
from veilwork.operators.mask import ExhaustedError


def rule_spec(table, column, pk="id", salt="", **table_settings):
    return MaskSpec.from_dict({"salt": salt, "tables": [
        {"name": table, "pk": pk, "columns": [column], **table_settings}]})


def run(df, spec):
    return MaskedTable(df, spec.tables[0], spec)


def pick_provider(domain):
    name = f"pick_{domain}"
    register_provider(name, lambda s: s.pick(0, domain).cast("string"), domain=domain)
    return name


def picked(domain, salt, table):
    return lambda key, attempt: str(serial.draw(serial.seed(salt, f"{table}:{key}", attempt), 0) % domain)


@pytest.mark.parametrize("n, domain, salt", [(100, 6, ""), (250, 300, "b"), (50, 100000, "e")])
def test_force_unique_equals_serial_loop(spark, n, domain, salt):
    keys = random.Random(n * domain).sample(range(10 * n), n)
    df = spark.createDataFrame([(k, f"v{k}") for k in keys], "id long, v string").repartition(5)
    spec = rule_spec("t", {"name": "v", "generator": pick_provider(domain), "force_unique": True}, salt=salt)
    value = picked(domain, salt, "t")
    want = serial.greedy(sorted(keys), value, 10)
    masked = run(df, spec)
    got = {r.id: r.v for r in masked.output().collect()}
    assert got == {k: value(k, 9 if a is None else a) for k, a in want.items()}
    assert masked.attempts["v"].exhausted == sum(a is None for a in want.values())


def test_unknown_domain_gives_the_same(spark):
    """Without a declared domain nothing is cut short, and nothing changes."""
    register_provider("pick_undeclared", lambda s: s.pick(0, 12).cast("string"))
    df = spark.range(200).select("id", F.lit("x").alias("v"))
    spec = rule_spec("t", {"name": "v", "generator": "pick_undeclared", "force_unique": True})
    value = picked(12, "", "t")
    want = serial.greedy(range(200), value, 10)
    got = {r.id: r.v for r in run(df, spec).output().collect()}
    assert got == {k: value(k, 9 if a is None else a) for k, a in want.items()}


def test_value_seeded_groups_and_hot_values(spark):
    """A third of all rows share one original."""
    rows = [(k, "hot" if k % 3 == 0 else f"v{k % 40}") for k in range(240)]
    df = spark.createDataFrame(rows, "id long, v string")
    domain = 60
    spec = rule_spec("t", {"name": "v", "generator": pick_provider(domain), "force_unique": True, "seed_by": "value"})
    originals = dict(rows)
    def value(k, a):
        return str(serial.draw(serial.seed("", originals[k], a), 0) % domain)
    want = serial.greedy(range(240), value, 10)
    got = {r.id: r.v for r in run(df, spec).output().collect()}
    assert got == {k: value(k, 9 if a is None else a) for k, a in want.items()}


def test_hot_values_of_keys(spark):
    """Few values and no declared domain: every value is asked for by many rows in every round."""
    register_provider("pick_hot", lambda s: s.pick(0, 25).cast("string"))
    df = spark.range(150).select("id", F.lit("x").alias("v"))
    spec = rule_spec("t", {"name": "v", "generator": "pick_hot", "force_unique": True}, salt="h")
    value = picked(25, "h", "t")
    want = serial.greedy(range(150), value, 10)
    got = {r.id: r.v for r in run(df, spec).output().collect()}
    assert got == {k: value(k, 9 if a is None else a) for k, a in want.items()}


def test_composite_key_order(spark):
    rows = [(a, b, "x") for a in range(12) for b in range(12)]
    df = spark.createDataFrame(rows, "a int, b long, v string")
    spec = rule_spec("t", {"name": "v", "generator": pick_provider(150), "force_unique": True}, pk=["a", "b"])
    keys = sorted((a, b) for a, b, _ in rows)
    def value(k, attempt):
        return str(serial.draw(serial.seed("", f"t:{k[0]}:{k[1]}", attempt), 0) % 150)
    want = serial.greedy(keys, value, 10)
    got = {(r.a, r.b): r.v for r in run(df, spec).output().collect()}
    assert got == {k: value(k, 9 if t is None else t) for k, t in want.items()}


def test_saturated_composite_key(spark):
    rows = [(a, b, "x") for a in range(10) for b in range(10)]
    df = spark.createDataFrame(rows, "a int, b long, v string")
    spec = rule_spec("t", {"name": "v", "generator": pick_provider(5), "force_unique": True}, pk=["a", "b"])
    def value(k, attempt):
        return str(serial.draw(serial.seed("", f"t:{k[0]}:{k[1]}", attempt), 0) % 5)
    want = serial.greedy(sorted((a, b) for a, b, _ in rows), value, 10)
    got = {(r.a, r.b): r.v for r in run(df, spec).output().collect()}
    assert got == {k: value(k, 9 if t is None else t) for k, t in want.items()}


@pytest.mark.parametrize("kept_share, domain", [(4, 80)])
def test_unique_column_respects_kept_values(spark, kept_share, domain):
    rows = [(k, str(k % domain) if k % kept_share == 0 else f"old{k}", k % kept_share) for k in range(200)]
    rows = [r for i, r in enumerate(rows) if r[2] or r[1] not in {x[1] for x in rows[:i] if not x[2]}]
    df = spark.createDataFrame(rows, "id long, v string, part int")
    spec = rule_spec("t", {"name": "v", "generator": pick_provider(domain), "unique": True},
                     source={"filter": "part > 0"})
    value = picked(domain, "", "t")
    taken = [v for _, v, part in rows if part == 0]
    want = serial.greedy([k for k, _, part in rows if part], value, 11, taken)
    masked = run(df, spec)
    got = {r.id: r.v for r in masked.output().collect()}
    assert got == {k: v if part == 0 else (None if want[k] is None else value(k, want[k])) for k, v, part in rows}
    assert {r.id for r in masked.failed().collect()} == {k for k, a in want.items() if a is None}


def test_constant_on_unique_column_fails_one_row(spark):
    df = spark.createDataFrame([(1, "alice@real.com"), (2, "bob@real.com")], "id int, email string")
    gen = {"name": "email", "gen": {"type": "constant", "value": "collision@example.com"}, "unique": True}
    spec = rule_spec("users", gen)
    masked = run(df, spec)
    assert [r.email for r in masked.output().orderBy("id").collect()] == ["collision@example.com", None]
    assert [(r.id, r.column_name) for r in masked.failed().collect()] == [(2, "email")]
    keep = rule_spec("users", {**gen, "on_exhausted": "keep_original"})
    assert [r.email for r in run(df, keep).output().orderBy("id").collect()] == ["collision@example.com", "bob@real.com"]
    with pytest.raises(ExhaustedError):
        run(df, rule_spec("users", {**gen, "on_exhausted": "fail"})).output()


def test_nothing_to_resolve_reads_no_extra_table(spark):
    df = spark.range(50).select("id", F.lit("x").alias("v"))
    spec = rule_spec("t", {"name": "v", "generator": "short_text", "force_unique": True})
    masked = run(df, spec)
    assert masked.output().select("v").distinct().count() == 50
    assert masked.attempts["v"].table is None


def test_displaced_holder(spark):
    """A smaller key that arrives on a later try takes the value from its holder."""
    domain = 40
    value = picked(domain, "", "t")
    keys = list(range(30))
    tries = serial.greedy(keys, value, 10)
    moved = {value(k, a): k for k, a in tries.items() if a}
    displaced = [k for k in keys if any(value(k, 0) == v and k > by for v, by in moved.items())]
    assert displaced, "the fixture must contain a displacement"
    df = spark.createDataFrame([(k, "x") for k in keys], "id long, v string")
    spec = rule_spec("t", {"name": "v", "generator": pick_provider(domain), "force_unique": True})
    got = {r.id: r.v for r in run(df, spec).output().collect()}
    assert got == {k: value(k, a) for k, a in tries.items()}


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, v string")
    spec = rule_spec("t", {"name": "v", "generator": "phone_number", "force_unique": True})
    assert run(df, spec).output().count() == 0


def test_string_keys(spark):
    keys = [f"k{i}" for i in range(60)]
    df = spark.createDataFrame([(k, "x") for k in keys], "id string, v string")
    spec = rule_spec("t", {"name": "v", "generator": pick_provider(45), "force_unique": True})
    value = picked(45, "", "t")
    want = serial.greedy(sorted(keys), value, 10)
    got = {r.id: r.v for r in run(df, spec).output().collect()}
    assert got == {k: value(k, 9 if a is None else a) for k, a in want.items()}


def test_understated_domain_changes_nothing(spark):
    """A registered domain is advice for the preflight; the result does not rest on it."""
    register_provider("pick_understated", lambda s: s.pick(0, 500).cast("string"), domain=50)
    df = spark.range(69).select("id", F.lit("x").alias("v"))
    spec = rule_spec("t", {"name": "v", "generator": "pick_understated", "force_unique": True})
    value = picked(500, "", "t")
    want = serial.greedy(range(69), value, 10)
    got = {r.id: r.v for r in run(df, spec).output().collect()}
    assert got == {k: value(k, 9 if a is None else a) for k, a in want.items()}


@pytest.mark.parametrize("keys", [[1, 2, 2, 3], [None, 1, None]])
def test_keys_must_name_one_row(spark, keys):
    df = spark.createDataFrame([(k, f"v{i}") for i, k in enumerate(keys)], "id long, v string")
    for rule in ({"generator": "phone_number", "force_unique": True},
                 {"gen": {"type": "constant", "value": "c"}, "unique": True}):
        with pytest.raises(unique.KeyProblem):
            run(df, rule_spec("t", {"name": "v", **rule})).output()


def test_written_tables_hold_no_originals(spark, monkeypatch):
    """Whatever rounds write has keys, tries and masks only, and all but the outcome is deleted."""
    seen, dropped = {}, []
    save, drop = unique.Workspace.save, unique.Workspace.drop
    monkeypatch.setattr(unique.Workspace, "save", lambda ws, df, name: seen.setdefault(
        (ws.root, name), save(ws, df, name)))
    monkeypatch.setattr(unique.Workspace, "drop", lambda ws: (dropped.append(ws.root), drop(ws)))
    rows = [(k, f"secret{k % 40}") for k in range(200)]
    before = {name for _, name in seen}
    df = spark.createDataFrame(rows, "id long, v string")
    spec = rule_spec("t", {"name": "v", "generator": pick_provider(150), "force_unique": True, "seed_by": "value"})
    run(df, spec).output().collect()
    allowed = {"id", "attempt", "value", "holder", "n", "taken", "idle", "changed", "displaced"}
    assert len(seen) > 4 and not before
    for (root, _), frame in seen.items():
        assert set(frame.columns) <= allowed
        if root not in dropped:
            assert not frame.where(F.array_contains(F.array(*[F.col(c).cast("string") for c in frame.columns]), "secret1")).count()
    assert {root for root, _ in seen} - set(dropped) == {root for root, name in seen if name == "attempts"}


def test_two_force_unique_columns_join_once(spark):
    """Tries of several columns meet the base in one join."""
    df = spark.range(60).select("id", F.lit("x").alias("v"), F.lit("y").alias("w"))
    spec = MaskSpec.from_dict({"tables": [{"name": "t", "pk": "id", "columns": [
        {"name": "v", "generator": pick_provider(80), "force_unique": True},
        {"name": "w", "generator": pick_provider(70), "force_unique": True}]}]})
    masked = run(df, spec)
    got = masked.output().collect()
    for column, domain in (("v", 80), ("w", 70)):
        value = picked(domain, "", "t")
        want = serial.greedy(range(60), value, 10)
        assert {r.id: r[column] for r in got} == {k: value(k, 9 if a is None else a) for k, a in want.items()}
    plan = masked.wide._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def _second(domain):
    """A provider on another draw, NULL for one value of the domain."""
    name = f"second_{domain}"
    register_provider(name, lambda s: F.when(s.pick(1, domain) > 0, s.pick(1, domain)).cast("string"), domain=domain)
    return name


def _joint_values(first, second, salt):
    def values(key, attempt):
        h = serial.seed(salt, f"t:{key}", attempt)
        return str(serial.draw(h, 0) % first), str(serial.draw(h, 1) % second) if serial.draw(h, 1) % second else None
    return values


def _joint_spec(first, second, salt, pk="id", **settings):
    return MaskSpec.from_dict({"salt": salt, "tables": [{"name": "t", "pk": pk, **settings, "columns": [
        {"name": "v", "generator": pick_provider(first), "unique": True},
        {"name": "w", "generator": _second(second), "unique": True},
        {"name": "x", "gen": {"type": "hash"}}]}]})


def _joint_rows(n):
    return F.col("id"), F.lit("x").alias("v"), F.lit("y").alias("w"), F.lit("z").alias("x")


@pytest.mark.parametrize("n, first, second, salt", [(60, 4000, 30, "a"), (70, 90, 5000, "b"), (40, 12, 9, "c"), (150, 3000, 4000, "d")])
def test_joint_columns_equal_serial_loop(spark, n, first, second, salt):
    df = spark.range(n).select(*_joint_rows(n)).repartition(4)
    masked = run(df, _joint_spec(first, second, salt))
    values = _joint_values(first, second, salt)
    want = serial.greedy_joint(range(n), values, 11)
    got = {r.id: r for r in masked.output().collect()}
    for key, attempt in want.items():
        row = got[key]
        assert (row.v, row.w) == ((None, None) if attempt is None else values(key, attempt))
        assert row.x == serial.seed(salt, f"t:{key}", 10 if attempt is None else attempt)
    gone = {k for k, a in want.items() if a is None}
    assert masked.attempts["v"].exhausted == len(gone)
    assert sorted((r.id, r.column_name) for r in masked.failed().collect()) == sorted((k, c) for k in gone for c in "vw")


def test_joint_columns_respect_kept_values(spark):
    """Rows outside the filter keep values that nobody may take, in either column; keys of two columns."""
    df = spark.range(80).select((F.col("id") % 7).alias("a"), F.col("id").alias("b"), (F.col("id") % 40).cast("string").alias("v"),
                                (F.col("id") % 60).cast("string").alias("w"), F.lit("z").alias("x"))
    spec = _joint_spec(100, 90, "k", pk=["a", "b"], source={"filter": "b >= 25"})
    keys = sorted((b % 7, b) for b in range(25, 80))

    def values(key, attempt):
        h = serial.seed("k", f"t:{key[0]}:{key[1]}", attempt)
        return str(serial.draw(h, 0) % 100), str(serial.draw(h, 1) % 90) if serial.draw(h, 1) % 90 else None

    want = serial.greedy_joint(keys, values, 11, {(0, str(b)) for b in range(25)} | {(1, str(b)) for b in range(25)})
    got = {(r.a, r.b): (r.v, r.w) for r in run(df, spec).output().where("b >= 25").collect()}
    assert got == {k: (None, None) if a is None else values(k, a) for k, a in want.items()}


def test_joint_columns_without_conflict_write_no_tries(spark):
    df = spark.range(50).select(*_joint_rows(50))
    masked = run(df, MaskSpec.from_dict({"tables": [{"name": "t", "pk": "id", "columns": [
        {"name": "v", "generator": "short_text", "unique": True}, {"name": "w", "gen": {"type": "hash"}, "unique": True}]}]}))
    assert masked.output().select("v", "w").distinct().count() == 50
    assert masked.attempts["v"].table is None and masked.attempts["v"].rounds == 1


def test_joint_columns_fail_on_request(spark):
    df = spark.range(9).select(*_joint_rows(9))
    with pytest.raises(ExhaustedError):
        run(df, MaskSpec.from_dict({"tables": [{"name": "t", "pk": "id", "columns": [
            {"name": "v", "generator": pick_provider(4), "unique": True},
            {"name": "w", "gen": {"type": "hash"}, "unique": True, "on_exhausted": "fail"}]}]})).output()
    empty = run(df.where("false"), _joint_spec(5, 5, "e"))
    assert empty.output().count() == 0


def test_later_rounds_ask_fewer_rows(spark, monkeypatch):
    """Only rows with a try whose value changed holder are asked again."""
    from functools import partial

    from veilwork.operators import mask

    monkeypatch.setattr(mask, "resolve_attempts", partial(unique.resolve_attempts, count_asked=True))
    df = spark.range(1200).select("id", F.lit("x").alias("v"))
    masked = run(df, rule_spec("t", {"name": "v", "generator": pick_provider(1000), "force_unique": True}, salt="delta"))
    value = picked(1000, "delta", "t")
    want = serial.greedy(range(1200), value, 10)
    assert {r.id: r.v for r in masked.output().collect()} == {k: value(k, 9 if a is None else a) for k, a in want.items()}
    asked = masked.attempts["v"].asked
    assert len(asked) > 4 and asked[0] > 800 and asked[-1] * 5 < asked[0] and list(asked) == sorted(asked, reverse=True)


def test_tries_written_grow_with_the_values_not_the_rows(spark, monkeypatch):
    """Few values and many rows: tries that a smaller key holds after the first round are lost, and not written."""
    saved, real = {}, unique.Workspace.save

    def save(ws, df, name):
        out = real(ws, df, name)
        if name.startswith("tries"):
            saved[name] = out.count()
        return out

    monkeypatch.setattr(unique.Workspace, "save", save)
    df = spark.range(3000).select("id", F.lit("x").alias("v"))
    masked = run(df, rule_spec("t", {"name": "v", "generator": pick_provider(20), "force_unique": True}, salt="few"))
    value = picked(20, "few", "t")
    want = serial.greedy(range(3000), value, 10)
    assert {r.id: r.v for r in masked.output().collect()} == {k: value(k, 9 if a is None else a) for k, a in want.items()}
    assert masked.attempts["v"].exhausted == sum(a is None for a in want.values()) > 2900
    assert 0 < saved["tries-0"] < 600 and max(saved.values()) < 1000


def test_keys_are_checked_once_a_table(spark, monkeypatch):
    from veilwork.operators import joint

    checked, real = [], unique.check_keys
    for module in (unique, joint):
        monkeypatch.setattr(module, "check_keys", lambda rows, pk: checked.append(1) or real(rows, pk))
    spec = MaskSpec.from_dict({"tables": [{"name": "t", "pk": "id", "columns": [
        {"name": "v", "generator": "short_text", "force_unique": True},
        {"name": "w", "generator": "short_text", "unique": True}, {"name": "x", "gen": {"type": "hash"}, "unique": True}]}]})
    run(spark.range(30).select(*_joint_rows(30)), spec).output().count()
    assert len(checked) == 1
