"""Property tests: operators against plain-Python brute force on random
small series (gaps, off-grid rows, duplicate ticks, several series), and
plan properties that keep hot keys out of single tasks."""

from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import SF_SMALL
from gridcast.operators.resample import resample
from gridcast.operators.split import rolling_folds
from gridcast.plans import registry

T0 = datetime(2020, 6, 24, 1)
FILL = 0.1
SETTINGS = settings(max_examples=8, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])

# one observation: (series, tick index, minute offset (0 = on grid), value)
observation = st.tuples(st.sampled_from(["1", "2"]), st.integers(0, 30),
                        st.sampled_from([0, 0, 0, 20]), st.integers(0, 50))


def brute_grid(obs, to_tick=None):
    """Gap fill written as loops. Per series: rows after ``to_date`` are
    dropped; the grid starts at the first remaining observation (on the
    hour or not) and runs in hourly steps to ``to_date`` or to the last
    observation (on the grid or not); every observation on the grid is kept (duplicates
    too), the others are dropped, missing ticks get FILL."""
    out = []
    end_min = None if to_tick is None else to_tick * 60
    for uid in sorted({o[0] for o in obs}):
        mins = [(o[1] * 60 + o[2], float(o[3])) for o in obs if o[0] == uid]
        mins = [m for m in mins if end_min is None or m[0] <= end_min]
        if not mins:
            continue
        start = min(m for m, _ in mins)
        on = [(m, v) for m, v in mins if (m - start) % 60 == 0]
        last = end_min if end_min is not None else max(m for m, _ in mins)
        for t in range(start, last + 1, 60):
            vals = [v for m, v in on if m == t]
            for v in vals or [FILL]:
                out.append((uid, T0 + timedelta(minutes=t), v))
    return sorted(out)


def frame(spark, obs):
    rows = [("a", uid, 6, T0 + timedelta(hours=t, minutes=m), float(v)) for uid, t, m, v in obs]
    return spark.createDataFrame(
        rows, "name string, unique_id string, id_object int, ds timestamp_ntz, y double")


@SETTINGS
@given(obs=st.lists(observation, min_size=1, max_size=25))
def test_resample_equals_brute_force(spark, obs):
    df = frame(spark, obs)
    want = brute_grid(obs)
    for method in ("window", "join"):
        got = sorted((r.unique_id, r.ds, r.y) for r in resample(df, "one_hour", method=method)
                     .collect())
        assert got == want, method


@SETTINGS
@given(obs=st.lists(observation, min_size=1, max_size=25), extra=st.integers(0, 5))
def test_resample_to_date_equals_brute_force(spark, obs, extra):
    to_tick = 30 + extra
    to_date = (T0 + timedelta(hours=to_tick)).isoformat(sep=" ")
    df = frame(spark, obs)
    want = brute_grid(obs, to_tick)
    for method in ("window", "join"):
        got = sorted((r.unique_id, r.ds, r.y)
                     for r in resample(df, "one_hour", to_date=to_date, method=method).collect())
        assert got == want, method


@SETTINGS
@given(n=st.integers(1, 60), h=st.integers(1, 12), step=st.integers(1, 6),
       pct=st.sampled_from([None, 50, 80]))
def test_rolling_folds_equal_the_loop(spark, n, h, step, pct):
    df = frame(spark, [("1", t, 0, t) for t in range(n)])
    initial = max(1, n // 3) if pct is None else n * pct // 100
    want = []
    if initial >= 1:
        fold, end = 0, initial
        while end + h <= n:
            want += [(fold, i) for i in range(end, end + h)]
            fold, end = fold + 1, end + step
    got = rolling_folds(df, h, step, initial_pct=pct).collect()
    assert sorted((r.fold, r.idx) for r in got) == sorted(want)
    # a test row is never in the training part of its own fold
    assert all(r.idx >= r.initial + r.fold * step for r in got)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rollup_combines_map_side_before_the_shuffle(spark):
    """A hot series in the raw table is pre-aggregated in every map task:
    the shuffle carries at most one row per (series, window) per task."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = _plan(registry.q_rollup_one_hour(spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    lines = p.splitlines()
    ex = next(i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line)
    below = "\n".join(lines[ex:])
    assert "partial_avg" in below and "partial_sum" in below and "partial_count" in below


def test_raw_table_selection_has_no_series_window(spark):
    """On a raw table a series may hold a third of all rows: the semi-join
    variant counts with a partial aggregate and never windows a series."""
    from gridcast.operators.series import select_time_series
    from gridcast.sources.tables import raw_events
    p = _plan(select_time_series(raw_events(spark, SF_SMALL), 10, method="semi_join"))
    assert "Window" not in p and "partial_count" in p
