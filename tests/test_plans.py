"""Physical plans: what must be pushed down, and what must not be shuffled."""

import pytest

from veilwork import MaskedTable, MaskSpec, diff, preview
from veilwork.operators.verify import checksum

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def orders(spark):
    return spark.read.parquet(f"{SF}/orders.parquet")


def rules(columns=None, **settings):
    return MaskSpec.from_dict({"tables": [{"name": "orders", "pk": "o_orderkey", "columns": columns or [
        {"name": "o_orderpriority", "generator": "email"}], **settings}]})


def masked(orders, columns=None, **settings):
    spec = rules(columns, **settings)
    return MaskedTable(orders, spec.tables[0], spec)


def test_filtered_source_is_a_narrow_projection(orders):
    plan = plan_of(masked(orders, source={"filter": "o_orderdate >= '1998-01-01'"}).output())
    assert "Exchange" not in plan and "Join" not in plan


def test_change_list_pushes_the_filter_and_prunes_columns(orders):
    plan = plan_of(diff(masked(orders, source={"filter": "o_orderdate >= '1998-01-01'"})))
    assert "GreaterThanOrEqual(o_orderdate" in plan and "Exchange" not in plan
    assert "o_totalprice" not in plan and "o_custkey" not in plan


def test_preview_is_a_top_n(orders):
    plan = plan_of(preview(rules(), lambda name: orders))
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_view_of_keys_shuffles_keys_only(orders):
    spec = rules(source={"type": "view", "name": "v"})
    view = orders.where("o_orderstatus = 'F'")
    m = MaskedTable(orders, spec.tables[0], spec, {"v": view}.__getitem__)
    plan = plan_of(m.output())
    assert "max(" not in plan and "HashAggregate" in plan and "SortAggregate" not in plan


def test_checksum_does_not_shuffle_rows(orders):
    plan = plan_of(checksum(orders, orders.columns))
    assert "hashpartitioning" not in plan and plan.count("Exchange") == 1


def test_equal_tries_are_limited_before_the_shuffle(spark, orders, monkeypatch):
    from veilwork import storage
    plans = {}
    save = storage.Workspace.save

    def record(self, df, name, **options):
        plans[name] = plan_of(df)
        return save(self, df, name, **options)

    monkeypatch.setattr(storage.Workspace, "save", record)
    m = masked(orders, [{"name": "o_orderpriority", "generator": "short_text", "seed_by": "value",
                            "force_unique": True}])
    out = m.output()
    assert out.select("o_orderpriority").distinct().count() == 10 * orders.select("o_orderpriority").distinct().count()
    head, tail = plans["tries-0"].split("Exchange hashpartitioning(o_orderpriority", 1)
    assert "Final" in head and "WindowGroupLimit" in tail and "Partial" in tail
    assert "HashAggregate" in plans["holders"] and "SortAggregate" not in plans["holders"]
