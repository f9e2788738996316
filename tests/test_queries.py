"""Every named query against its SQL, and the order-dependent ones for their invariants."""

import duckdb
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from wayfold.plans.queries import FILTER, QUERIES, fixes
from wayfold.plans.sql import ORACLE_SQL


@pytest.fixture(scope="module")
def views(sf):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf, views, name):
    same_rows(QUERIES[name](spark, sf), views.sql(ORACLE_SQL[name]))


@pytest.mark.parametrize("name", ["pl_filter", "path_sampling_filter", "bootstrap_filter"])
def test_filters_give_a_state_per_fix(spark, sf, name):
    rows = QUERIES[name](spark, sf).collect()
    keys = {(r["source_id"], r["record_number"]) for r in rows}
    assert len(keys) == len(rows) == fixes(spark, sf).count()
    assert {r["event_id"] for r in rows} == {r["event_id"] for r in fixes(spark, sf).select("event_id").collect()}
    assert all(a == r["edge_id"] for r in rows if r["on_road"] for a in r["path"][-1:])
    assert all((r["edge_id"] is not None) == r["on_road"] for r in rows)
    assert all(1 - 1e-9 <= r["ess"] <= FILTER.particles + 1e-9 for r in rows)
    assert all(r["speed"] is None or r["speed"] >= 0 for r in rows)


def test_filters_do_not_depend_on_the_partitioning(spark, sf):
    from wayfold.operators.filters import filter_fixes
    from wayfold.operators.network import RoadNetwork, grid_edges

    net, few = RoadNetwork(grid_edges(spark)), fixes(spark, sf).where("source_id < 12")
    one, two = (sorted(map(repr, filter_fixes(few.repartition(n), net, FILTER).collect())) for n in (1, 5))
    assert one == two


def test_sources_are_dealt_out_anew(spark, sf):
    """Fixes come from a shuffle by source that was brought together into few tasks; the filter has its own."""
    from wayfold.operators.filters import filter_fixes
    from wayfold.operators.network import RoadNetwork, grid_edges

    found = filter_fixes(fixes(spark, sf).where("record_number < 2"), RoadNetwork(grid_edges(spark)), FILTER, "path_sampling")
    assert found.select(F.spark_partition_id().alias("task")).distinct().count() > 4


def test_stream_equals_batch(spark, sf):
    stream = QUERIES["stream_filter"](spark, sf)
    batch = QUERIES["bootstrap_filter"](spark, sf).select(*(c for c in stream.columns if c != "late"))
    assert set(stream.select("late").distinct().collect()) == {(0,)}
    assert sorted((tuple(r) for r in stream.drop("late").collect()), key=repr) == sorted((tuple(r) for r in batch.collect()), key=repr)


def test_plans_prune_and_push_down(spark, sf):
    plan = QUERIES["snap_nearest"](spark, sf)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "event_type" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("name", ["ground_from_road", "road_belief", "road_from_ground", "movements", "crooked_snap"])
def test_snapping_makes_no_row_for_each_near_segment(spark, sf, name):
    """Neither joined to cells nor sorted: the one sort is that of the fixes."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert "cell_x" not in plan and plan.count("row_number") <= 1


@pytest.mark.parametrize("name", ["mixture_mean", "mixture_normalise", "ess_by_fix", "best_state"])
def test_mixtures_are_dealt_out_by_number(spark, sf, monkeypatch, name):
    """Tasks by the number of fixes, not by their size before near segments multiply them; no further shuffle."""
    from wayfold.operators import observations

    monkeypatch.setattr(observations, "FIXES_A_TASK", 100)
    found = QUERIES[name](spark, sf)
    assert found.select("source_id", F.spark_partition_id().alias("task")).distinct().select("task").distinct().count() > 8
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(source_id") == 2 and "REPARTITION_BY_NUM" in plan


def test_simulation_has_all_steps(spark, sf):
    rows = QUERIES["simulate"](spark, sf).collect()
    assert len(rows) == 64 * 120
    assert all(not r["true_on_road"] or (r["true_dist"] >= 0 and r["true_speed"] >= 0) for r in rows)
    assert {r["true_on_road"] for r in rows} == {True, False}


def test_truncated_mean_lies_inside(spark, sf):
    assert QUERIES["truncated_mean"](spark, sf).where("mean < 0 or mean > 100").count() == 0
