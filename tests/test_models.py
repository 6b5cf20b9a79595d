import math
from datetime import datetime, timedelta

import numpy as np
import pytest

from conftest import SF_SMALL, hourly, series_df
from gridcast.operators.metrics import fold_metrics
from gridcast.plans import registry
from gridcast.plans.grouped import forecast_groups, make_forecaster
from gridcast.plans.regression import rolling_regression
from gridcast.plans.rolling import evaluate_rolling, rolling_forecast
from gridcast.plans.trees import evaluate_holdout


def preds(df):
    return {(r.name, r.fold, r.d): (r.y, r.yhat) for r in df.collect()}


def test_trend_recovers_a_line(spark):
    df = series_df(spark, hourly("2020-06-24 00:00", [2 + 3 * t for t in range(50)]))
    for (_, _, _), (y, yhat) in preds(rolling_forecast(df, "trend", 3, 1)).items():
        assert abs(y - yhat) < 1e-8


def test_ar1_matches_direct_least_squares(spark):
    rng = np.random.default_rng(7)
    y = [5.0]
    for _ in range(79):
        y.append(1.0 + 0.6 * y[-1] + rng.normal())
    df = series_df(spark, hourly("2020-06-24 00:00", y))
    got = preds(rolling_forecast(df, "ar1", 4, 2))
    y = np.array(y)
    initial = 80 * 80 // 100
    for (_, fold, d), (_, yhat) in got.items():
        e = initial + fold * 2
        b, a = np.polyfit(y[: e - 1], y[1:e], 1)
        want = y[e - 1]
        for _ in range(d + 1):
            want = a + b * want
        assert abs(want - yhat) < 1e-8


def _calendar(ep):
    hour = (ep // 3600) % 24
    wd = (ep // 86400 + 3) % 7
    x = np.zeros(26)
    x[hour] = 1.0
    x[24], x[25] = float(wd >= 5), float(wd)
    return x


def _hourly_with_profile(n, seed=3):
    rng = np.random.default_rng(seed)
    e = [0.0]
    for _ in range(n - 1):
        e.append(0.6 * e[-1] + rng.normal())
    return np.array([10 + 3 * math.sin(2 * math.pi * i / 24) + e[i] for i in range(n)])


def _refit_arx(y, ep, initial, h, step, p_max, pick=True, difference=False):
    """Forecasts per (fold, d) by a direct ``lstsq`` at every origin."""
    z = np.concatenate([[np.nan], np.diff(y)]) if difference else y
    lag = np.stack([np.concatenate([np.full(j, np.nan), z[:-j]]) for j in range(1, p_max + 1)], 1)
    X = np.concatenate([np.array([_calendar(t) for t in ep]), lag], 1)
    whole = ~np.isnan(X).any(1) & ~np.isnan(z)

    def fit(upto, p):
        rows = np.flatnonzero(whole[:upto])
        A = X[rows][:, :26 + p]
        beta = np.linalg.lstsq(A, z[rows], rcond=None)[0]
        return beta, float(((z[rows] - A @ beta) ** 2).sum()), len(rows)

    def aic(p):
        _, rss, n = fit(initial, p)
        return n * math.log(rss / n) + 2 * (26 + p)

    p = min(range(p_max + 1), key=aic) if pick else p_max
    out = {}
    for fold, e in enumerate(range(initial, len(y) - h + 1, step)):
        beta, _, _ = fit(e, p)
        hist, level = list(z[e - 1:e - 1 - p:-1]), y[e - 1]
        for d in range(h):
            value = _calendar(ep[e + d]) @ beta[:26] + np.dot(hist, beta[26:])
            hist = ([value] + hist)[:p]
            level = level + value if difference else value
            out[fold, d] = level
    return out


@pytest.mark.parametrize("scale,shift,difference", [(1, 0, False), (1000, 0, False), (1, 100_000, False), (1, 0, True)])
def test_arx_matches_per_fold_least_squares(spark, scale, shift, difference):
    n, h, step, p_max = 500, 12, 5, 3
    t0 = datetime(2020, 6, 24)
    y = _hourly_with_profile(n) * scale + shift
    df = series_df(spark, [(t0 + timedelta(hours=i), v) for i, v in enumerate(y)])
    got = preds(rolling_regression(df, "arx", "one_hour", h, step, p_max=p_max, difference=difference, chunk=4))
    ep = np.array([int((t0 + timedelta(hours=i) - datetime(1970, 1, 1)).total_seconds()) for i in range(n)])
    want = _refit_arx(y, ep, n * 80 // 100, h, step, p_max, difference=difference)
    assert {k[1:] for k in got} == set(want)
    for (_, fold, d), (_, yhat) in got.items():
        assert abs(yhat - want[fold, d]) <= 1e-6 * max(1.0, abs(want[fold, d])), (fold, d)


def test_arx_uses_the_hour_profile(spark):
    """The forecast error stays near the noise, whatever the unit of y."""
    t0, n = datetime(2020, 6, 24), 600
    errors = []
    for scale, shift in ((1, 0), (1000, 0), (1, 100_000)):
        y = _hourly_with_profile(n, 5) * scale + shift
        df = series_df(spark, [(t0 + timedelta(hours=i), v) for i, v in enumerate(y)])
        got = preds(rolling_regression(df, "arx", "one_hour", 12, 12))
        errors.append(math.sqrt(np.mean([(a - b) ** 2 for a, b in got.values()])) / scale)
    assert max(errors) < 1.6 and max(errors) - min(errors) < 1e-5


def test_trend_seasonal_recovers_ten_years_of_its_own_model(spark):
    t0 = datetime(2010, 1, 1)
    rows = [(t0 + timedelta(days=i), 100 + 0.24 * i + 10 * math.sin(2 * math.pi * i / 7)) for i in range(3653)]
    got = preds(rolling_regression(series_df(spark, rows), "trend_seasonal", "one_day", 1, 30, harmonics=(0, 3)))
    assert len(got) > 20 and max(abs(a - b) for a, b in got.values()) < 1e-6


def test_trend_seasonal_follows_changepoints(spark):
    t0, n = datetime(2020, 1, 1), 1000
    initial = n * 80 // 100
    kink = [i + (5.0 * max(i - initial / 2, 0)) for i in range(n)]
    df = series_df(spark, [(t0 + timedelta(hours=i), v) for i, v in enumerate(kink)])
    got = preds(rolling_regression(df, "trend_seasonal", "one_hour", 12, 12, changepoints=1))
    assert max(abs(a - b) for a, b in got.values()) < 1e-5
    bent = preds(rolling_regression(df, "trend_seasonal", "one_hour", 12, 12))
    assert max(abs(a - b) for a, b in bent.values()) > 10


def test_regression_chunks_do_not_matter(spark):
    df = registry.grid(spark, SF_SMALL)

    def run(**kw):
        out = rolling_regression(df, "trend_seasonal", "one_hour", 12, 1, harmonics=(1, 0), **kw).collect()
        return {(r.name, r.unique_id, r.fold, r.d): r.yhat for r in out}

    a, b = run(chunk=7), run()
    assert a.keys() == b.keys() and len(a) > 100
    assert all(math.isclose(a[k], b[k], rel_tol=1e-7, abs_tol=1e-7) for k in a)


def test_constant_and_short_series_have_forecasts(spark):
    for values in ([5.0] * 60, [1.0, 2.0, 3.0, 4.0, 5.0]):
        df = series_df(spark, hourly("2020-06-24 00:00", values))
        for model in ("arx", "trend_seasonal"):
            got = preds(rolling_regression(df, model, "one_hour", 1, 1))
            assert got and all(b is not None and math.isfinite(b) for _, b in got.values())
            if values[0] == values[1]:
                assert all(abs(a - b) < 1e-9 for a, b in got.values())


def test_off_grid_rows_take_no_part_in_any_model(spark):
    from gridcast.operators.resample import resample
    from gridcast.plans.long_series import rolling_forecast_long
    y = _hourly_with_profile(120)
    rows = [(datetime(2020, 6, 24) + timedelta(hours=i), v) for i, v in enumerate(y)]
    rows += [(datetime(2020, 6, 24, 0, 30) + timedelta(hours=7 * i), 500.0) for i in range(17)]
    df = series_df(spark, rows)
    keep, drop = (resample(df, "one_hour", off_grid=p) for p in ("keep", "drop"))
    for model in ("naive", "mean", "ar1", "trend", "arx", "trend_seasonal"):
        a, b = (evaluate_rolling(x, model, "one_hour", "12_hour").collect() for x in (keep, drop))
        assert len(a) == len(b) == 1 and all(math.isclose(a[0][c], b[0][c], rel_tol=1e-9) for c in ("mse", "mae", "mape")), model
        assert a[0]["n"] == b[0]["n"]
    a, b = (rolling_forecast_long(x, ("mean", "ar1"), {"f": (3, 1)}, "one_hour").count() for x in (keep, drop))
    assert a == b > 0


@pytest.mark.parametrize("log", ["log", "log1p"])
def test_log_option_inverts_before_the_errors(spark, log):
    from gridcast.plans.long_series import rolling_forecast_long
    into, back = (math.log, math.exp) if log == "log" else (math.log1p, math.expm1)
    y = list(np.exp(np.random.default_rng(4).normal(2, 0.5, 60)))
    df = series_df(spark, hourly("2020-06-24 00:00", y))
    got = preds(rolling_forecast(df, "mean", 2, 1, log=log))
    for (_, fold, d), (actual, yhat) in got.items():
        e = 48 + fold
        assert math.isclose(actual, y[e + d], rel_tol=1e-9)
        assert math.isclose(yhat, back(np.mean([into(v) for v in y[:e]])), rel_tol=1e-9)
    long = {(r.fold, r.d): r.yhat for r in rolling_forecast_long(df, ("mean",), {"f": (2, 1)}, "one_hour", log=log).collect()}
    assert all(math.isclose(long[k[1:]], v[1], rel_tol=1e-9) for k, v in got.items())
    grouped = forecast_groups(df, make_forecaster("mean", "one_hour", "1_step", log=log)).first()
    rolled = evaluate_rolling(df, "mean", "one_hour", "1_step", log=log).first()
    assert math.isclose(grouped.MSE, rolled.mse, rel_tol=1e-9)
    reg = preds(rolling_regression(df, "trend_seasonal", "one_hour", 2, 1, log=log))
    assert all(math.isclose(v[0], y[48 + k[1] + k[2]], rel_tol=1e-9) for k, v in reg.items())


def test_on_short_reaches_every_evaluation(spark):
    from gridcast.plans.long_series import evaluate_rolling_long
    df = series_df(spark, hourly("2020-06-24 00:00", [1.0, 2.0, 3.0]))
    calls = [lambda o: evaluate_rolling(df, "mean", "one_hour", "12_hour", on_short=o),
             lambda o: evaluate_rolling(df, "arx", "one_hour", "12_hour", on_short=o),
             lambda o: evaluate_rolling_long(df, ("mean",), "one_hour", ("12_hour",), on_short=o),
             lambda o: forecast_groups(df, make_forecaster("mean", "one_hour", "12_hour", on_short=o))]
    for call in calls:
        assert call("skip").count() == 0
        with pytest.raises(Exception, match="exceeds the series"):
            call("raise").collect()


@pytest.mark.parametrize("model", ["naive", "mean", "trend", "ar1"])
def test_grouped_models_equal_the_rolling_ones(spark, model):
    grid = registry.grid(spark, SF_SMALL)
    g = {(r.name, r.unique_id): (r.MAPE, r.RMSE, r.MSE, r.MAE)
         for r in forecast_groups(grid, make_forecaster(model, "one_hour", "12_hour")).collect()}
    m = {(r.name, r.unique_id): (r.mape, r.rmse, r.mse, r.mae)
         for r in evaluate_rolling(grid, model, "one_hour", "12_hour").collect()}
    assert g.keys() == m.keys() and len(g) > 0
    for k in g:
        assert all(math.isclose(x, z, rel_tol=1e-6) for x, z in zip(g[k], m[k]))


def test_grouped_forecaster_date_range(spark):
    rows = hourly("2020-06-24 00:00", list(range(100)))
    part = forecast_groups(series_df(spark, rows), make_forecaster(
        "naive", "one_hour", from_date="2020-06-25 00:00:00", to_date="2020-06-26 23:00:00")).first()
    want = forecast_groups(series_df(spark, rows[24:72]), make_forecaster("naive", "one_hour")).first()
    assert part == want


def test_trees_per_series_and_with_a_key_feature(spark):
    feats = registry._tree_features(spark, SF_SMALL)
    keys = registry.MANY_SERIES[:2]
    pred, metrics = evaluate_holdout(feats, registry.TREE_FEATURES, "decision_tree", per_series=keys)
    alone, _ = evaluate_holdout(registry.select_series(feats, keys[0]), registry.TREE_FEATURES, "decision_tree")
    assert metrics.count() == 2
    first = pred.filter(f"unique_id = '{keys[0]['unique_id']}'")
    assert first.exceptAll(alone).count() == 0 == alone.exceptAll(first).count()
    keyed, _ = evaluate_holdout(feats, registry.TREE_FEATURES, "decision_tree", key_feature=True)
    assert keyed.count() == evaluate_holdout(feats, registry.TREE_FEATURES, "decision_tree")[0].count()


def test_trend_seasonal_recovers_a_sinusoid(spark):
    t0 = datetime(2020, 6, 1)
    rows = [(t0 + timedelta(hours=i), 5 + 0.2 * i / 24 + 2 * math.sin(2 * math.pi * i / 24))
            for i in range(24 * 21)]
    df = series_df(spark, rows)
    got = preds(rolling_regression(df, "trend_seasonal", "one_hour", 12, 12))
    assert got and max(abs(y - yhat) for y, yhat in got.values()) < 1e-3


def test_no_leakage_from_the_future(spark):
    rng = np.random.default_rng(1)
    y = list(rng.normal(10, 2, 60))
    changed = y[:-1] + [1000.0]
    a = preds(rolling_forecast(series_df(spark, hourly("2020-06-24 00:00", y)), "ar1", 1, 1))
    b = preds(rolling_forecast(series_df(spark, hourly("2020-06-24 00:00", changed)), "ar1", 1, 1))
    last = max(f for _, f, _ in a)
    for key, (_, yhat) in a.items():
        if key[1] < last:
            assert b[key][1] == yhat


def test_many_series_equal_single_series(spark):
    rng = np.random.default_rng(2)
    a = series_df(spark, hourly("2020-06-24 00:00", list(rng.normal(5, 1, 40))), name="a")
    b = series_df(spark, hourly("2020-06-25 00:00", list(rng.normal(9, 1, 55))), name="b")
    both = preds(rolling_forecast(a.unionByName(b), "ar1", 2, 1))
    single = {**preds(rolling_forecast(a, "ar1", 2, 1)), **preds(rolling_forecast(b, "ar1", 2, 1))}
    assert both.keys() == single.keys()
    assert all(abs(both[k][1] - single[k][1]) < 1e-12 for k in both)


def test_grouped_forecaster_equals_rolling_mean(spark):
    grid = registry.grid(spark, SF_SMALL)
    g = {(r.name, r.unique_id): (r.MAPE, r.RMSE, r.MSE, r.MAE)
         for r in forecast_groups(grid, make_forecaster("mean")).collect()}
    m = {(r.name, r.unique_id): (r.mape, r.rmse, r.mse, r.mae)
         for r in evaluate_rolling(grid, "mean", "one_hour", "1_step").collect()}
    assert g.keys() == m.keys() and len(g) > 0
    for k in g:
        assert all(math.isclose(x, z, rel_tol=1e-9) for x, z in zip(g[k], m[k]))


def test_metric_properties(spark):
    grid = registry.grid(spark, SF_SMALL)
    for r in evaluate_rolling(grid, "naive", "one_hour", "12_hour").collect():
        assert math.isclose(r.mse, r.rmse ** 2, rel_tol=1e-12)
        assert r.mape_low <= r.mape <= r.mape_high
    one_step = evaluate_rolling(grid, "ar1", "one_hour", "1_step")
    one_hour = evaluate_rolling(grid, "ar1", "one_hour", "1_hour")
    assert one_step.exceptAll(one_hour).count() == 0


def test_decision_tree_holdout(spark):
    feats = registry._tree_features(spark, SF_SMALL)
    pred, metrics = evaluate_holdout(feats, registry.TREE_FEATURES, "decision_tree")
    from gridcast.operators.split import split_by_rank
    assert pred.count() == split_by_rank(feats, 80).filter("not is_train").count()
    assert metrics.count() == feats.select("name", "unique_id", "id_object").distinct().count()


def test_unknown_model(spark):
    df = series_df(spark, hourly("2020-06-24 00:00", [1.0] * 10))
    with pytest.raises(ValueError):
        evaluate_rolling(df, "prophet", "one_hour")
    with pytest.raises(ValueError):
        fold_metrics(df, level="day")


def test_long_series_mode_equals_windowed_rolling(spark):
    """Prefix-sum states (no per-series window) give the same forecasts as
    the running-window states, for every model, forecast kind and fold."""
    from gridcast.operators.resample import resample
    from gridcast.plans.long_series import rolling_forecast_long
    from gridcast.plans.rolling import rolling_forecast_many
    series = resample(registry.obs(spark, SF_SMALL), "one_hour")
    models = ("naive", "mean", "ar1", "trend")
    horizons = {"1_step": (1, 1), "12_hour": (12, 1)}
    cols = ["name", "unique_id", "id_object", "forecast", "model", "fold", "d"]

    def table(df):
        return {tuple(r[c] for c in cols): (r.idx, r.ds, r.y, r.yhat) for r in df.collect()}

    # a small chunk forces several chunks per series, so offsets are exercised
    got = table(rolling_forecast_long(series, models, horizons, "one_hour", chunk=64))
    want = table(rolling_forecast_many(series, models, horizons))
    assert got.keys() == want.keys() and len(got) > 100
    for k, (idx, ds, y, yhat) in want.items():
        g = got[k]
        assert (g[0], g[1], g[2]) == (idx, ds, y)
        assert (g[3] is None) == (yhat is None), k
        if yhat is not None:
            assert abs(g[3] - yhat) <= 1e-7 * max(1.0, abs(yhat)), (k, g[3], yhat)


def test_ar1_closed_form_equals_the_iteration(spark):
    from pyspark.sql import functions as F
    from gridcast.functions.recursion import ar1_ahead
    cases = [(a, b, y0, k) for a in (0.0, 1.5, -2.0) for b in
             (0.0, 1.0, 1 - 1e-9, 1 + 1e-7, 0.6, -0.7, 0.999, 1.02, -1.0, 2.0)
             for y0 in (3.0, -1.0) for k in (1, 2, 12, 48)]
    df = spark.createDataFrame(cases, "a double, b double, y0 double, k int")
    got = df.select("a", "b", "y0", "k", ar1_ahead(F.col("a"), F.col("b"), F.col("y0"),
                                                   F.col("k")).alias("x")).collect()
    for r in got:
        want = r.y0
        for _ in range(r.k):
            want = r.a + r.b * want
        assert abs(r.x - want) <= 1e-9 * max(1.0, abs(want)), (r, want)
    nulls = spark.createDataFrame([(None, 0.5, 1.0, 3)], "a double, b double, y0 double, k int")
    assert nulls.select(ar1_ahead(F.col("a"), F.col("b"), F.col("y0"), F.col("k"))).first()[0] is None


def test_tree_holdout_on_log_target_reports_original_scale(spark):
    """log1p before the lags (F8); y and the prediction go back through
    expm1 before the errors (F9), so metrics are on the original scale."""
    from gridcast.operators.features import build_features
    o = registry.obs(spark, SF_SMALL)
    kw = dict(h_lags=2, avg_h=2, use_hour=True)
    logged = build_features(o, "one_hour", log=True, **kw)
    plain = build_features(o, "one_hour", **kw)
    pred, metrics = evaluate_holdout(logged, registry.TREE_FEATURES, "decision_tree", log=True)
    keys = ["name", "unique_id", "id_object", "ds"]
    got = {tuple(r[k] for k in keys): r.y for r in pred.collect()}
    want = {tuple(r[k] for k in keys): r.y for r in plain.collect()}
    assert got and all(abs(v - want[k]) <= 1e-9 * max(1.0, abs(v)) for k, v in got.items())
    # errors recomputed from the returned pairs agree with the metrics table
    by = {}
    for r in pred.collect():
        by.setdefault((r.name, r.unique_id, r.id_object), []).append((r.y - r.prediction) ** 2)
    for m in metrics.collect():
        errs = by[(m.name, m.unique_id, m.id_object)]
        assert math.isclose(m.mse, sum(errs) / len(errs), rel_tol=1e-9)
