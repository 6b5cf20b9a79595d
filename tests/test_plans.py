"""Physical-plan checks: pushdown, pruning, number of shuffles, no
un-keyed windows, no driver collects in operators."""

import ast
import os

from conftest import SF_SMALL
from gridcast.operators.features import build_features
from gridcast.operators.series import select_series
from gridcast.plans import registry

ROOT = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "gridcast")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_series_predicate_reaches_the_scan(spark):
    df = select_series(registry.obs(spark, SF_SMALL), {"name": "click", "unique_id": 1,
                                                      "id_object": 6}, ["ds", "y"])
    p = plan(df)
    pushed = p.split("PushedFilters: [")[1].split("]")[0]
    assert "EqualTo(event_type,click)" in pushed and "IsNotNull(ts)" in pushed
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in p


def test_feature_plan_has_two_shuffles(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = registry.q_features_flagship(spark, SF_SMALL)
        p = plan(df)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # one for the rollup (keys, window), one for the series windows (keys)
    assert p.count("Exchange hashpartitioning") == 2, p
    assert "SortMergeJoin" not in p and "BroadcastHashJoin" not in p
    # one sort of the observations (grid bounds and lead share it), one of
    # the gap-filled grid (lags, trailing mean and rank share it)
    assert p.count("Sort [") == 2, p


def test_rolling_evaluation_adds_no_shuffle(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = plan(registry.q_ar1_rolling(spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert p.count("Exchange hashpartitioning") == 2, p


def test_windows_are_keyed(spark):
    p = plan(build_features(registry.obs(spark, SF_SMALL), "one_hour", h_lags=2, avg_h=2))
    for line in p.splitlines():
        if "Window [" in line:
            assert "name#" in line.split("],")[-2] or "partition" in line.lower(), line
    assert "SinglePartition" not in p


def test_no_collect_in_library():
    for dirpath, _, files in os.walk(ROOT):
        if "llm" in os.path.relpath(dirpath, ROOT).split(os.sep):
            continue  # has its own bounded reads of the driver, tested there
        for f in files:
            if f.endswith(".py"):
                tree = ast.parse(open(os.path.join(dirpath, f)).read())
                for node in ast.walk(tree):
                    if isinstance(node, ast.Attribute) and node.attr in ("collect", "toPandas",
                                                                         "localCheckpoint"):
                        raise AssertionError(f"{node.attr} in {f}")


def test_long_series_mode_has_no_series_window(spark):
    df = registry.q_features_long_series(spark, SF_SMALL)
    p = plan(df)
    assert "Window [" not in p and "Window(" not in p, p
    # the shifted lags aggregate by hash: no sort of the (n + 1)-fold copies
    assert "SortAggregate" not in p, p
    # every shuffle is keyed by the tick as well, except those that carry one
    # row per series (the grid bounds and the rank bounds)
    for line in p.splitlines():
        if "Exchange hashpartitioning(" in line:
            keyed = line.split("hashpartitioning(")[1].split(")")[0]
            assert "ds#" in keyed or "_us#" in keyed or keyed.count("#") == 3, line
    by_series = [line for line in p.splitlines() if "Exchange hashpartitioning(" in line
                 and "ds#" not in line and "_us#" not in line]
    tree = p.splitlines()
    for line in by_series:  # below each, the partial aggregate of the bounds or the bounds' join
        below = " ".join(tree[tree.index(line) + 1:tree.index(line) + 4])
        assert "partial_min" in below or "partial_max" in below or "Project" in below or "HashAggregate" in below, below


def test_observation_scan_prunes_granularity_partitions(spark, tmp_path):
    from gridcast.sources.observations import read_aggregation, write_observations
    root = str(tmp_path / "obs")
    for g in ("one_hour", "one_day"):
        write_observations(registry.obs(spark, SF_SMALL, g), root, g)
    df = read_aggregation(spark, root, "one_day").filter("name = 'click'")
    p = plan(df)
    assert "PartitionFilters: [isnotnull(granularity" in p and "one_day" in p
    assert "EqualTo(name,click)" in p
    assert df.count() == registry.obs(spark, SF_SMALL, "one_day").filter("name = 'click'").count()


def test_metrics_sink_round_trip(spark, tmp_path):
    from pyspark.sql import functions as F
    from gridcast.plans.rolling import evaluate_rolling
    from gridcast.sources.sinks import read_metrics, write_metrics
    path = str(tmp_path / "metrics")
    m = evaluate_rolling(registry.grid(spark, SF_SMALL), "naive", "one_hour", "1_step")
    tagged = m.withColumns({"model": F.lit("naive"), "granularity": F.lit("one_hour"),
                            "forecast": F.lit("1_step")})
    write_metrics(tagged, path)
    write_metrics(tagged, path)  # re-running one configuration replaces it
    back = read_metrics(spark, path)
    assert back.count() == m.count()
    assert {r.model for r in back.select("model").distinct().collect()} == {"naive"}


def test_regression_plan_has_no_series_window_over_folds(spark):
    """Planned as at scale (no broadcast): the Gram rows are keyed by (series,
    fold), their running sums by (series, chunk of folds), and forecasts meet
    their test rows on (series, fold)."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(registry.q_trend_seasonal_rolling(spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    windows = [line for line in p.splitlines() if "Window [" in line]
    # over Gram sums only the chunk totals are ordered per series
    assert all("_chunk#" in line for line in windows if "sum(g#" in line or "sum(" in line and "g#" in line), windows
    assert "FlatMapCoGroupsInPandas" in p or "FlatMapCoGroups" in p
    joins = [line for line in p.splitlines() if "SortMergeJoin" in line]
    assert joins and all("fold#" in line for line in joins), joins


def test_date_ranges_reach_the_raw_scan(spark):
    """Every query over a date range reads the raw table with bounds on ts."""
    for fn in (registry.q_range_after_features, registry.q_resample_from_date, registry.q_resample_off_phase):
        p = plan(fn(spark, SF_SMALL))
        pushed = [x.split("]")[0] for x in p.split("PushedFilters: [")[1:]]
        bounded = [x for x in pushed if "GreaterThanOrEqual(ts," in x and "LessThan(ts," in x]
        assert bounded, pushed
    raw = registry.obs(spark, SF_SMALL, "fifteen_minute", registry.FROM_DATE, registry.TO_DATE)
    assert "GreaterThanOrEqual(ts," in plan(raw)


def test_rollup_of_a_range_equals_the_range_of_the_rollup(spark):
    from gridcast.functions.time import range_filter
    for start, end in ((registry.FROM_DATE, registry.TO_DATE), ("2024-01-03 00:30:00", "2024-01-04 00:10:00")):
        a = registry.obs(spark, SF_SMALL, "one_hour", start, end)
        b = range_filter(registry.obs(spark, SF_SMALL), start, end)
        assert a.exceptAll(b).count() == 0 == b.exceptAll(a).count() and a.count() > 0
