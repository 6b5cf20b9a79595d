"""DuckDB SQL twins of the registered queries (the correctness oracle).

Written independently of the Spark code, straight from the semantics:
``time_bucket`` for the rollup, ``generate_series`` + LEFT/FULL JOIN for the
grid, window functions for features, splits and running fits.
"""

from __future__ import annotations

KEYS = "name, unique_id, id_object"
PART = "PARTITION BY name, unique_id, id_object"
W = f"({PART} ORDER BY ds)"
PAST = f"({PART} ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
FROM_DATE = "TIMESTAMP '2024-01-02 00:00:00'"
TO_DATE = "TIMESTAMP '2024-01-29 23:00:00'"
SECONDS = {"one_minute": 60, "fifteen_minute": 900, "one_hour": 3600, "one_day": 86400}


def _iv(s: int) -> str:
    return f"INTERVAL '{s} seconds'"


def obs(g: str = "one_hour", name: str = "obs") -> str:
    s = SECONDS[g]
    return (f"{name} AS (SELECT event_type AS name, CAST(user_id % 3 AS VARCHAR) AS unique_id, "
            f"CAST(6 AS INTEGER) AS id_object, time_bucket({_iv(s)}, ts) + {_iv(s)} AS ds, "
            f"avg(value) AS y, count(value) AS n, sum(value) AS total FROM events GROUP BY 1, 2, 3, 4)")


def grid(src: str = "obs", g: str = "one_hour", name: str = "r", start: str = "min(ds)",
         end: str = "max(ds)", where: str = "TRUE") -> str:
    """Tick grid per series LEFT JOINed with the observations."""
    s = SECONDS[g]
    return (f"{name}_g AS (SELECT {KEYS}, unnest(generate_series({start}, {end}, {_iv(s)})) AS ds "
            f"FROM {src} WHERE {where} GROUP BY 1, 2, 3), "
            f"{name} AS (SELECT g.name, g.unique_id, g.id_object, g.ds, coalesce(o.y, 0.1) AS y "
            f"FROM {name}_g g LEFT JOIN (SELECT * FROM {src} WHERE {where}) o "
            f"ON g.name = o.name AND g.unique_id = o.unique_id AND g.id_object = o.id_object "
            f"AND g.ds = o.ds)")


def _with(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


def _r6(c: str) -> str:
    # same tie-safe cut as the Spark side (offset 0.5002)
    return f"CASE WHEN abs({c}) < 1e12 THEN floor({c} * 1e6 + 0.5002) / 1e6 ELSE {c} END"


def _round(*cols: str) -> str:
    return ", ".join(f"{_r6(c)} AS {c}" for c in cols)


def folds(src: str, h: int, step: int, name: str = "f", extra: str = "") -> str:
    """Rolling-origin test rows per fold, initial = floor(0.8 n)."""
    return (f"{name}_a AS (SELECT *, row_number() OVER {W} - 1 AS idx, count(*) OVER ({PART}) AS n "
            f"{extra} FROM {src}), "
            f"{name}_b AS (SELECT *, CAST(floor(n * 80 / 100) AS BIGINT) AS initial FROM {name}_a), "
            f"{name}_c AS (SELECT *, CASE WHEN n - initial - {h} >= 0 "
            f"THEN (n - initial - {h}) // {step} + 1 ELSE 0 END AS n_folds FROM {name}_b), "
            f"{name} AS (SELECT * EXCLUDE (lo, hi), idx - initial - fold * {step} AS d FROM ("
            f"SELECT *, unnest(generate_series(lo, hi)) AS fold FROM ("
            f"SELECT *, CAST(greatest(0, ceil((idx - initial - {h} + 1) / {step})) AS BIGINT) AS lo, "
            f"CAST(least(n_folds - 1, floor((idx - initial) / {step})) AS BIGINT) AS hi "
            f"FROM {name}_c WHERE idx >= initial AND initial >= 1) WHERE lo <= hi))")


PE = ("CASE WHEN y <> 0 THEN abs((y - yhat) / y) * 100 WHEN y = yhat THEN CAST('nan' AS DOUBLE) "
      "ELSE CAST('inf' AS DOUBLE) END")
METRICS = (f"min({PE}) AS mape_low, avg({PE}) AS mape, max({PE}) AS mape_high, "
           "avg((y - yhat) * (y - yhat)) AS mse, avg(abs(y - yhat)) AS mae, count(*) AS n, "
           "sqrt(avg((y - yhat) * (y - yhat))) AS rmse")
METRIC_OUT = _round("mape_low", "mape", "mape_high", "mse", "mae", "rmse") + ", n"


def fold_mean_cte(src: str, name: str = "fm") -> str:
    return (f"{name} AS (SELECT {KEYS}, fold, max(ds) AS ds, avg(y) AS y, avg(yhat) AS yhat "
            f"FROM {src} GROUP BY 1, 2, 3, 4)")


def fold_metric_sql(src: str) -> str:
    return f"SELECT {KEYS}, {METRIC_OUT} FROM (SELECT {KEYS}, {METRICS} FROM {src} GROUP BY 1, 2, 3)"


def naive_pred(src: str, h: int, step: int, name: str = "p") -> str:
    return (folds(src, h, step, name + "_f", extra=f", lag(y) OVER {W} AS last") + ", "
            f"{name} AS (SELECT *, first_value(last) OVER ({PART}, fold ORDER BY idx) AS yhat "
            f"FROM {name}_f)")


def mean_pred(src: str, h: int, step: int, name: str = "p") -> str:
    return (folds(src, h, step, name + "_f", extra=f", avg(y) OVER {PAST} AS a") + ", "
            f"{name} AS (SELECT *, first_value(a) OVER ({PART}, fold ORDER BY idx) AS yhat "
            f"FROM {name}_f)")


def ar1_pred(src: str, h: int, step: int, name: str = "p") -> str:
    return (f"{name}_x AS (SELECT *, lag(y) OVER {W} AS x FROM {src}), "
            f"{name}_s AS (SELECT *, regr_intercept(y, x) OVER {PAST} AS a, "
            f"regr_slope(y, x) OVER {PAST} AS b, x AS last FROM {name}_x), "
            + folds(f"{name}_s", h, step, name + "_f") + ", "
            f"{name}_o AS (SELECT *, first_value(a) OVER ({PART}, fold ORDER BY idx) AS a0, "
            f"first_value(b) OVER ({PART}, fold ORDER BY idx) AS b0, "
            f"first_value(last) OVER ({PART}, fold ORDER BY idx) AS l0 FROM {name}_f), "
            f"{name} AS (SELECT *, list_reduce(list_prepend(l0, list_transform(range(d + 1), "
            f"lambda i: CAST(0 AS DOUBLE))), lambda acc, v: a0 + b0 * acc) AS yhat FROM {name}_o)")


def trend_pred(src: str, h: int, step: int, name: str = "p") -> str:
    return (f"{name}_x AS (SELECT *, CAST(row_number() OVER {W} - 1 AS DOUBLE) AS x FROM {src}), "
            f"{name}_s AS (SELECT *, regr_intercept(y, x) OVER {PAST} AS a, "
            f"regr_slope(y, x) OVER {PAST} AS b FROM {name}_x), "
            + folds(f"{name}_s", h, step, name + "_f") + ", "
            f"{name} AS (SELECT *, first_value(a) OVER ({PART}, fold ORDER BY idx) "
            f"+ first_value(b) OVER ({PART}, fold ORDER BY idx) * CAST(idx AS DOUBLE) AS yhat "
            f"FROM {name}_f)")


def least_squares_pred(src: str, h: int, columns: dict[str, str]) -> str:
    """CTEs up to ``fm`` (fold means) of a least-squares forecaster refitted
    at every origin (step 1): running sums of the products of the columns
    and the centred target, one Gaussian elimination step per CTE, and the
    forecast from the test row's own columns (so lags need h = 1)."""
    x = list(columns)
    k = len(x)
    cols = ", ".join(f"{e.replace('{W}', W)} AS {c}" for c, e in columns.items())
    full = " AND ".join(f"{c} IS NOT NULL" for c in x)

    def total(a: str, b: str) -> str:
        return f"sum(CASE WHEN {full} THEN {a} * {b} END) OVER {PAST}"

    terms = [f"{total(x[i], x[j])} AS a0_{i}_{j}" for i in range(k) for j in range(k)]
    terms += [f"{total(x[i], 'z')} AS a0_{i}_{k}" for i in range(k)]
    ctes = [
        f"ls_n AS (SELECT *, row_number() OVER {W} - 1 AS i, CAST(floor(count(*) OVER ({PART}) * 80 / 100) AS BIGINT) AS i0 FROM {src})",
        f"ls_c AS (SELECT *, avg(y) FILTER (WHERE i < i0) OVER ({PART}) AS c FROM ls_n)",
        f"ls_x AS (SELECT *, y - c AS z, {cols} FROM ls_c)",
        f"ls_0 AS (SELECT *, {', '.join(terms)} FROM ls_x)"]
    for p in range(k):
        rows = [f"a{p}_{p}_{j} AS a{p + 1}_{p}_{j}" for j in range(p, k + 1)]
        rows += [f"a{p}_{i}_{j} - a{p}_{i}_{p} * a{p}_{p}_{j} / a{p}_{p}_{p} AS a{p + 1}_{i}_{j}"
                 for i in range(p + 1, k) for j in range(p + 1, k + 1)]
        ctes.append(f"ls_{p + 1} AS (SELECT *, {', '.join(rows)} FROM ls_{p})")
    last = f"ls_{k}"
    for i in reversed(range(k)):
        rest = "".join(f" - a{i + 1}_{i}_{j} * b{j}" for j in range(i + 1, k))
        ctes.append(f"ls_b{i} AS (SELECT *, (a{i + 1}_{i}_{k}{rest}) / a{i + 1}_{i}_{i} AS b{i} FROM {last})")
        last = f"ls_b{i}"
    at = ", ".join(f"first_value(b{i}) OVER ({PART}, fold ORDER BY idx) AS o{i}" for i in range(k))
    value = " + ".join(f"o{i} * {x[i]}" for i in range(k))
    return ", ".join([*ctes, folds(last, h, 1), f"ls_o AS (SELECT *, {at} FROM f)",
                      f"p AS (SELECT *, c + {value} AS yhat FROM ls_o)", fold_mean_cte("p")])


def _features(end: str = "max(ds)", where: str = "TRUE") -> str:
    return (_with(obs(), grid(end=end, where=where),
                  f"f AS (SELECT *, CAST(hour(ds) AS INTEGER) AS hour, lag(y, 1) OVER {W} AS lag_1, "
                  f"lag(y, 2) OVER {W} AS lag_2, avg(y) OVER ({PART} ORDER BY ds ROWS BETWEEN 2 "
                  f"PRECEDING AND 1 PRECEDING) AS avg_2 FROM r), "
                  "ff AS (SELECT * FROM f WHERE lag_1 IS NOT NULL AND lag_2 IS NOT NULL "
                  "AND avg_2 IS NOT NULL AND hour IS NOT NULL)"))


def kpss_ctes(src: str, max_order: int = 2, most: int = 12) -> str:
    """Statistics of ``src`` (keys, ds, y) at every order as ``kp`` and the
    chosen order as ``ko``."""
    diffs = ["y", f"y - lag(y, 1) OVER {W}", f"y - 2 * lag(y, 1) OVER {W} + lag(y, 2) OVER {W}"][:max_order + 1]
    stacked = " UNION ALL ".join(f"SELECT {KEYS}, ds, {d} AS o, d{d} AS v FROM kd WHERE d{d} IS NOT NULL" for d in range(max_order + 1))
    by = "PARTITION BY name, unique_id, id_object, o"
    lagged = ", ".join(f"e * lag(e, {j}) OVER ({by} ORDER BY ds) AS p{j}" for j in range(1, most + 1))
    long_run = " + ".join(f"2 * greatest(1 - {j}.0::DOUBLE / (lags + 1), 0) * coalesce(sum(p{j}), 0)" for j in range(1, most + 1))
    wide = ", ".join(f"max(CASE WHEN o = {d} THEN statistic END) AS statistic_{d}" for d in range(max_order + 1))
    chosen = " ".join(f"WHEN coalesce(statistic_{d} <= 0.463, TRUE) THEN {d}" for d in range(max_order))
    return (f"kd AS (SELECT {KEYS}, ds, {', '.join(f'{x} AS d{d}' for d, x in enumerate(diffs))} FROM {src}), ks AS ({stacked}), "
            f"km AS (SELECT *, count(*) OVER ({by}) AS n, v - avg(v) OVER ({by}) AS e FROM ks), "
            f"kl AS (SELECT *, floor(4 * pow(n / 100.0::DOUBLE, 0.25)) AS lags, sum(e) OVER ({by} ORDER BY ds) AS s, {lagged} FROM km), "
            f"kp AS (SELECT {KEYS}, o, n, CASE WHEN n >= 3 THEN CASE WHEN sum(e * e) > 0 THEN sum(s * s) / (n * (sum(e * e) + {long_run})) "
            f"ELSE 0 END END AS statistic FROM kl GROUP BY {KEYS}, o, n, lags), "
            f"kw AS (SELECT {KEYS}, {wide} FROM kp GROUP BY 1, 2, 3), "
            f"ko AS (SELECT *, CAST(CASE {chosen} ELSE {max_order} END AS INTEGER) AS \"order\" FROM kw)")


TREE_COLUMNS = ("lag_1", "lag_2", "avg_2", "hour")


def _units(c: str) -> str:
    return f"CAST(floor(CAST({c} AS DOUBLE) * 1e6 + 0.5002) AS BIGINT)"


def tree_ctes(depth: int, target: str, name: str, bins: int = 32) -> str:
    """One tree per series level by level: ``{name}`` has every row (k) of
    ``base`` with the leaf it reaches. ``target`` has k and y (units) of the
    training rows; ``parts`` has k, f and u (units) of all rows."""
    out = [f"{name}_lim AS MATERIALIZED (SELECT {KEYS}, f, min(u) AS lo, max(u) AS hi FROM parts JOIN base USING (k) "
           f"JOIN {target} USING (k) GROUP BY ALL)",
           f"{name}_n0 AS (SELECT k, {KEYS}, CAST(1 AS INTEGER) AS node, FALSE AS done FROM base)"]
    for d in range(depth):
        n = f"{name}_n{d}"
        out.append(
            f"{name}_s{d} AS (SELECT {KEYS}, node, f, b, lo, hi, count(*) AS n, sum(CAST(y AS HUGEINT)) AS s FROM ("
            f"SELECT a.name, a.unique_id, a.id_object, a.node, p.f, l.lo, l.hi, t.y, "
            f"CAST((p.u - l.lo) * {bins} // (l.hi - l.lo + 1) AS INTEGER) AS b FROM {n} a JOIN {target} t USING (k) "
            f"JOIN parts p USING (k) JOIN {name}_lim l ON l.name = a.name AND l.unique_id = a.unique_id "
            f"AND l.id_object = a.id_object AND l.f = p.f WHERE NOT a.done) GROUP BY ALL), "
            f"{name}_c{d} AS (SELECT *, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER g AS nn, sum(s) OVER g AS ss "
            f"FROM {name}_s{d} WINDOW w AS ({PART}, node, f ORDER BY b), g AS ({PART}, node, f)), "
            f"{name}_g{d} AS (SELECT *, CAST(sl AS DOUBLE) * CAST(sl AS DOUBLE) / CAST(nl AS DOUBLE) "
            f"+ CAST(ss - sl AS DOUBLE) * CAST(ss - sl AS DOUBLE) / CAST(nn - nl AS DOUBLE) "
            f"- CAST(ss AS DOUBLE) * CAST(ss AS DOUBLE) / CAST(nn AS DOUBLE) AS gain, "
            f"lo + ((b + 1) * (hi - lo + 1) + {bins - 1}) // {bins} - 1 AS cut FROM {name}_c{d} WHERE nn > nl), "
            f"{name}_b{d} AS MATERIALIZED (SELECT {KEYS}, node, f, cut FROM {name}_g{d} WHERE gain > 0 "
            f"QUALIFY row_number() OVER ({PART}, node ORDER BY gain DESC, f, cut) = 1), "
            f"{name}_n{d + 1} AS MATERIALIZED (SELECT a.k, a.name, a.unique_id, a.id_object, "
            f"CASE WHEN b.f IS NULL THEN a.node WHEN p.u > b.cut THEN a.node * 2 + 1 ELSE a.node * 2 END AS node, "
            f"b.f IS NULL AS done FROM {n} a LEFT JOIN {name}_b{d} b ON b.name = a.name AND b.unique_id = a.unique_id "
            f"AND b.id_object = a.id_object AND b.node = a.node AND NOT a.done LEFT JOIN parts p ON p.k = a.k AND p.f = b.f)")
    out.append(f"{name}_v AS (SELECT {KEYS}, node, CAST(sum(CAST(y AS HUGEINT)) AS DOUBLE) / count(*) * 1e-6 AS value "
               f"FROM {name}_n{depth} JOIN {target} USING (k) GROUP BY 1, 2, 3, 4)")
    out.append(f"{name} AS MATERIALIZED (SELECT a.k, v.value FROM {name}_n{depth} a JOIN {name}_v v "
               "USING (name, unique_id, id_object, node))")
    return ", ".join(out)


def tree_base() -> str:
    units = ", ".join(_units(c) for c in TREE_COLUMNS)
    return (_features() + "").rstrip() + (
        f", ranked AS (SELECT *, percent_rank() OVER {W} <= CAST(0.8 AS DOUBLE) AS is_train FROM ff), "
        f"base AS MATERIALIZED (SELECT row_number() OVER () AS k, {KEYS}, ds, y, is_train, [{units}] AS x FROM ranked), "
        f"parts AS MATERIALIZED (SELECT k, unnest(range({len(TREE_COLUMNS)})) AS f, unnest(x) AS u FROM base), "
        f"t0 AS (SELECT k, {_units('y')} AS y FROM base WHERE is_train), ")


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    roll = _round("y", "total")
    q["rollup_one_hour"] = _with(obs("one_hour")) + f"SELECT {KEYS}, ds, {roll}, n FROM obs"
    q["rollup_fifteen_minute"] = _with(obs("fifteen_minute")) + f"SELECT {KEYS}, ds, {roll}, n FROM obs"
    q["rollup_one_day"] = (
        "WITH d AS (SELECT o_orderpriority AS name, o_orderstatus AS unique_id, "
        "CAST(1 AS INTEGER) AS id_object, time_bucket(INTERVAL '86400 seconds', o_orderdate) "
        "+ INTERVAL '86400 seconds' AS ds, avg(o_totalprice) AS y, count(o_totalprice) AS n, "
        f"sum(o_totalprice) AS total FROM orders GROUP BY 1, 2, 3, 4) SELECT {KEYS}, ds, {roll}, n FROM d")
    q["rollup_coarsen"] = (
        f"WITH base AS (SELECT event_type AS name, CAST(user_id % 3 AS VARCHAR) AS unique_id, "
        f"CAST(6 AS INTEGER) AS id_object, ts, value FROM events) "
        f"SELECT {KEYS}, time_bucket(INTERVAL '3600 seconds', ts) + INTERVAL '3600 seconds' AS ds, "
        f"{_r6('sum(value) / count(value)')} AS y, count(value) AS n, {_r6('sum(value)')} AS total "
        f"FROM base GROUP BY 1, 2, 3, 4")
    q["read_observations"] = _with(obs()) + f"SELECT {KEYS}, ds, {_round('y')} FROM obs"
    q["select_series"] = (_with(obs()) + f"SELECT ds, {_round('y')} FROM obs "
                          "WHERE name = 'click' AND unique_id = '1' AND id_object = 6")
    q["select_many"] = (_with(obs()) + f"SELECT {KEYS}, ds, {_round('y')} FROM obs "
                        "WHERE name = 'view' AND unique_id IN ('0', '1', '2') AND id_object = 6")
    q["select_long_list"] = (_with(obs()) + f"SELECT {KEYS}, ds, {_round('y')} FROM obs "
                             "WHERE name IN ('view', 'click')")
    q["min_raw_rows"] = (
        "WITH e AS (SELECT event_type AS name, CAST(user_id % 3 AS VARCHAR) AS unique_id, CAST(6 AS INTEGER) AS id_object, "
        f"ts, value FROM events) SELECT * FROM e WHERE ({KEYS}) IN (SELECT ({KEYS}) FROM e GROUP BY {KEYS} HAVING count(*) > 650)")
    q["series_counts"] = _with(obs("one_minute")) + f"SELECT {KEYS}, count(*) AS n_obs FROM obs GROUP BY 1, 2, 3"
    minobs = (f"m AS (SELECT * FROM obs WHERE ({KEYS}) IN (SELECT ({KEYS}) FROM obs "
              f"GROUP BY {KEYS} HAVING count(*) > 430))")
    q["min_observations"] = _with(obs(), minobs) + f"SELECT {KEYS}, ds, {_round('y')} FROM m"
    q["count_series"] = (_with(obs(), minobs)
                         + f"SELECT count(*) AS n_series FROM (SELECT DISTINCT {KEYS} FROM m)")
    q["resample_grid"] = _with(obs(), grid()) + f"SELECT {KEYS}, ds, {_round('y')} FROM r"
    q["resample_grid_join"] = q["resample_grid"]
    in_range = f"ds >= {FROM_DATE} AND ds <= {TO_DATE}"
    q["resample_keep_off_grid"] = _with(
        obs("fifteen_minute"),
        f"o AS (SELECT * FROM obs WHERE {in_range}), "
        f"g AS (SELECT {KEYS}, unnest(generate_series({FROM_DATE}, {TO_DATE}, {_iv(3600)})) AS ds "
        f"FROM o GROUP BY 1, 2, 3)") + (
        f"SELECT coalesce(g.name, o.name) AS name, coalesce(g.unique_id, o.unique_id) AS unique_id, "
        f"coalesce(g.id_object, o.id_object) AS id_object, g.ds AS ds, {_r6('coalesce(o.y, 0.1)')} AS y, "
        f"g.ds IS NOT NULL AS on_grid FROM g FULL OUTER JOIN o ON g.name = o.name AND "
        f"g.unique_id = o.unique_id AND g.id_object = o.id_object AND g.ds = o.ds")
    q["resample_from_date"] = (_with(obs(), grid(start=FROM_DATE, end=TO_DATE, where=in_range))
                               + f"SELECT {KEYS}, ds, {_round('y')} FROM r")
    for name, start, end in (("resample_off_phase", "2024-01-02 00:30:00", "2024-01-05 23:30:00"),
                             ("resample_empty_range", "2024-03-01 00:00:00", "2024-03-02 12:00:00")):
        q[name] = (_with(obs()) + f"SELECT {KEYS}, unnest(generate_series(TIMESTAMP '{start}', TIMESTAMP '{end}', "
                   f"{_iv(3600)})) AS ds, CAST(0.1 AS DOUBLE) AS y FROM (SELECT DISTINCT {KEYS} FROM obs)")
    q["range_before_fill"] = (_with(obs("fifteen_minute"), grid(g="fifteen_minute", start=FROM_DATE,
                                                                 end=TO_DATE, where=in_range))
                              + f"SELECT {KEYS}, ds, {_round('y')} FROM r")
    q["range_after_features"] = (
        _features(end=TO_DATE, where=f"ds <= {TO_DATE}")
        + f"SELECT {KEYS}, ds, {_round('y', 'lag_1', 'lag_2', 'avg_2')}, hour FROM ff WHERE {in_range}")
    lags3 = ", ".join(f"lag(y, {i}) OVER {W} AS lag_{i}" for i in (1, 2, 3))
    avg3 = f"avg(y) OVER ({PART} ORDER BY ds ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS avg_3"
    q["lag_features"] = (_with(obs(), grid(), f"l AS (SELECT *, {lags3} FROM r)")
                         + f"SELECT {KEYS}, ds, {_round('y', 'lag_1', 'lag_2', 'lag_3')} FROM l")
    q["moving_average"] = (_with(obs(), grid(), f"l AS (SELECT *, {avg3} FROM r)")
                           + f"SELECT {KEYS}, ds, {_round('y', 'avg_3')} FROM l")
    q["lag_features_shift"] = q["lag_features"]
    q["moving_average_shift"] = q["moving_average"]
    q["lag_features_halo"], q["moving_average_halo"] = q["lag_features"], q["moving_average"]
    day = ", ".join(f"lag(y, {i}) OVER {W} AS lag_{i}" for i in range(1, 25))
    q["features_halo"] = (_with(obs(), grid(), f"l AS (SELECT *, {day}, avg(y) OVER ({PART} ORDER BY ds ROWS BETWEEN 12 "
                                f"PRECEDING AND 1 PRECEDING) AS avg_12, y - lag(y, 24) OVER {W} AS diff_24 FROM r)")
                          + f"SELECT {KEYS}, ds, {_round('y', *[f'lag_{i}' for i in range(1, 25)], 'avg_12', 'diff_24')} FROM l")
    q["drop_nulls"] = (_with(obs(), grid(), f"l AS (SELECT *, {lags3}, {avg3} FROM r)")
                       + f"SELECT {KEYS}, ds, {_round('y', 'lag_1', 'lag_2', 'lag_3', 'avg_3')} FROM l "
                       "WHERE lag_1 IS NOT NULL AND lag_2 IS NOT NULL AND lag_3 IS NOT NULL "
                       "AND avg_3 IS NOT NULL")
    weekend = "CAST(CASE WHEN dayofweek(ds) IN (0, 6) THEN 1 ELSE 0 END AS INTEGER)"
    q["time_features"] = (_with(obs(), grid())
                          + f"SELECT {KEYS}, ds, {_round('y')}, CAST(hour(ds) AS INTEGER) AS hour, "
                          f"{weekend} AS weekend FROM r")
    hours = ", ".join(f"CAST(hour(ds) = {i} AS INTEGER) AS hour_{i}" for i in range(24))
    q["exogenous_features"] = (_with(obs(), grid())
                               + f"SELECT {KEYS}, ds, {_round('y')}, {hours}, {weekend} AS weekend, "
                               "CAST(isodow(ds) - 1 AS INTEGER) AS week_day FROM r")
    q["epoch_roundtrip"] = (_with(obs()) + f"SELECT {KEYS}, ds, epoch, "
                            "TIMESTAMP '1970-01-01 00:00:00' + epoch * INTERVAL '1 second' AS ds_back "
                            f"FROM (SELECT *, date_diff('second', TIMESTAMP '1970-01-01 00:00:00', ds) "
                            "AS epoch FROM obs)")
    q["log1p_roundtrip"] = (_with(obs(), grid())
                            + f"SELECT {KEYS}, ds, {_round('y_raw', 'y_log', 'y_back')} FROM ("
                            "SELECT *, y AS y_raw, ln(1 + y) AS y_log, exp(ln(1 + y)) - 1 AS y_back FROM r)")
    q["log_roundtrip"] = (_with(obs(), grid())
                          + f"SELECT {KEYS}, ds, {_round('y_raw', 'y_log', 'y_back')} FROM ("
                          "SELECT *, y AS y_raw, ln(y) AS y_log, exp(ln(y)) AS y_back FROM r)")
    q["features_flagship"] = (
        _features() + f"SELECT {KEYS}, ds, {_round('y', 'lag_1', 'lag_2', 'avg_2', 'pr')}, hour, "
        "pr <= CAST(0.8 AS DOUBLE) AS is_train FROM (SELECT *, percent_rank() OVER "
        f"{W} AS pr FROM ff)")
    q["features_long_series"] = q["features_flagship"]
    q["split_by_rank"] = (_with(obs(), grid())
                          + f"SELECT {KEYS}, ds, {_round('y', 'pr')}, pr <= CAST(0.8 AS DOUBLE) AS is_train "
                          f"FROM (SELECT *, percent_rank() OVER {W} AS pr FROM r)")
    q["split_by_position"] = (_with(obs(), grid())
                              + f"SELECT {KEYS}, ds, {_round('y')}, idx, n, "
                              "idx < CAST(floor(n * 80 / 100) AS BIGINT) AS is_train FROM ("
                              f"SELECT *, row_number() OVER {W} - 1 AS idx, count(*) OVER ({PART}) AS n "
                              "FROM r)")
    q["train_fraction"] = (_with(obs(), grid(), f"k AS (SELECT *, percent_rank() OVER {W} AS pr FROM r)")
                           + f"SELECT {KEYS}, CAST(m AS INTEGER) AS multiplier, "
                           "count(*) FILTER (WHERE pr <= m * 25 / 100) AS n_train "
                           "FROM k, (VALUES (1), (2), (3), (4)) t(m) GROUP BY 1, 2, 3, 4")
    q["split_by_position_long"] = q["split_by_position"]
    q["rolling_folds"] = (_with(obs("fifteen_minute"),
                                grid(g="fifteen_minute"), folds("r", 4, 4))
                          + f"SELECT {KEYS}, fold, d, idx, ds, {_round('y')} FROM f")
    q["rolling_folds_long"] = q["rolling_folds"]
    def counts(*ctes: str, table: str) -> str:
        return (_with(*ctes, f"c AS (SELECT {KEYS}, count(*) AS n FROM r GROUP BY 1, 2, 3)")
                + f"SELECT {KEYS}, n, forecast, CAST(h AS INTEGER) AS h, CAST(step AS INTEGER) "
                "AS step, CAST(floor(n * 80 / 100) AS BIGINT) AS initial, "
                "CASE WHEN n - floor(n * 80 / 100) - h >= 0 "
                "THEN (n - CAST(floor(n * 80 / 100) AS BIGINT) - h) // step + 1 ELSE 0 END AS n_folds "
                f"FROM c, (VALUES {table}) t(forecast, h, step)")

    q["fold_counts"] = counts(obs(), grid(), table="('1_step', 1, 1), ('1_hour', 1, 1), ('12_hour', 12, 1)")
    q["fold_counts_fifteen_minute"] = counts(obs("fifteen_minute"), grid(g="fifteen_minute"),
                                             table="('1_step', 1, 1), ('1_hour', 4, 4), ('12_hour', 48, 4)")
    daily = q["rollup_one_day"].removeprefix("WITH ").split(" SELECT " + KEYS)[0]
    q["fold_counts_one_day"] = counts(daily, grid("d", "one_day"), table="('1_step', 1, 1)")
    q["skipped_series"] = _with(obs()) + (
        f"SELECT {KEYS}, n, initial, CAST(10 AS BIGINT) AS h, 'initial training size + horizon exceeds the series' AS reason "
        f"FROM (SELECT {KEYS}, count(*) AS n, CAST(floor(count(*) * 98 / 100) AS BIGINT) AS initial FROM obs GROUP BY 1, 2, 3) "
        "WHERE n < initial + 10 AND initial >= 1")
    keep = [obs("fifteen_minute"), grid(g="one_hour")]
    q["keep_grid_folds"] = _with(*keep, naive_pred("r", 12, 1, "p1"), fold_mean_cte("p1", "m1"),
                                 mean_pred("r", 12, 1, "p2"), fold_mean_cte("p2", "m2")) + " UNION ALL ".join(
        f"SELECT {KEYS}, '12_hour' AS forecast, '{m}' AS model, {METRIC_OUT} FROM (SELECT {KEYS}, {METRICS} FROM {t} GROUP BY 1, 2, 3)"
        for m, t in (("naive", "m1"), ("mean", "m2")))
    for name, h, pred, into, back in (("rolling_naive_log", 12, naive_pred, "ln(y)", "exp({})"),
                                      ("ar1_rolling_log", 1, ar1_pred, "ln(1 + y)", "exp({}) - 1")):
        q[name] = (_with(obs(), grid(name="r0"), f"r AS (SELECT {KEYS}, ds, {into} AS y FROM r0)", pred("r", h, 1, "p0"),
                         f"p AS (SELECT * REPLACE ({back.format('y')} AS y, {back.format('yhat')} AS yhat) FROM p0)",
                         fold_mean_cte("p")) + fold_metric_sql("fm"))
    q["align_predictions"] = _with(obs(), grid()) + (
        f"SELECT {KEYS}, ds, {_round('y', 'yhat')} FROM (SELECT *, lag(y) OVER {W} AS yhat FROM r) WHERE yhat IS NOT NULL")
    q["tree_test_rows"] = _features() + (
        f"SELECT {KEYS}, ds, {_round('y')} FROM (SELECT *, percent_rank() OVER {W} AS pr FROM ff) "
        "WHERE NOT (pr <= CAST(0.8 AS DOUBLE))")
    q["difference_order"] = _with(obs(), grid(), kpss_ctes("r")) + (
        f'SELECT {KEYS}, {_round("statistic_0", "statistic_1", "statistic_2")}, "order" FROM ko')
    q["differenced_series"] = _with(obs(), grid(), f"r2 AS (SELECT {KEYS}, ds, sum(y) OVER {W} AS y FROM r)", kpss_ctes("r2")) + (
        f'SELECT {KEYS}, ds, "order", {_round("y")} FROM (SELECT {KEYS}, ds, "order", CASE "order" WHEN 0 THEN d0 WHEN 1 THEN d1 '
        f'ELSE d2 END AS y FROM kd JOIN ko USING (name, unique_id, id_object)) WHERE y IS NOT NULL')
    tree_rows = "(SELECT b.name, b.unique_id, b.id_object, ds, y, value AS prediction FROM base b JOIN tr USING (k) WHERE NOT is_train)"
    for name, depth in (("tree_all_series_stumps", 1), ("tree_all_series", 5)):
        q[name] = (tree_base() + tree_ctes(depth, "t0", "tr")
                   + f" SELECT {KEYS}, ds, {_round('y', 'prediction')} FROM {tree_rows}")
    q["tree_all_series_metrics"] = (tree_base() + tree_ctes(2, "t0", "tr") + f" SELECT {KEYS}, {METRIC_OUT} FROM (SELECT {KEYS}, "
                                    f"{METRICS} FROM (SELECT *, prediction AS yhat FROM {tree_rows}) GROUP BY 1, 2, 3)")
    boosted = tree_base() + tree_ctes(2, "t0", "r0")
    for k, weight in ((1, 1.0), (2, 0.1)):
        boosted += (f", t{k} AS (SELECT k, t.y - {_units(f'value * {weight}')} AS y FROM t{k - 1} t JOIN r{k - 1} USING (k)), "
                    + tree_ctes(2, f"t{k}", f"r{k}"))
    q["boosted_trees_all_series"] = boosted + (
        f" SELECT {KEYS}, ds, {_round('y', 'prediction')} FROM (SELECT b.name, b.unique_id, b.id_object, ds, y, "
        "r0.value + 0.1 * r1.value + 0.1 * r2.value AS prediction FROM base b JOIN r0 USING (k) JOIN r1 USING (k) "
        "JOIN r2 USING (k) WHERE NOT is_train)")
    q["log_stage"] = _with(obs(), grid(), "l AS (SELECT * REPLACE (ln(1 + y) AS y) FROM r)") + (
        f"SELECT {KEYS}, ds, {_round('y')} FROM l")
    q["assembled_features"] = _features() + (
        "SELECT " + KEYS + ", ds, f_lag_1, f_lag_2, f_avg_2, f_hour FROM (SELECT " + KEYS + ", ds, "
        + ", ".join(f"{_r6(c)} AS f_{c}" for c in ("lag_1", "lag_2", "avg_2")) + ", CAST(hour AS DOUBLE) AS f_hour FROM ff)")
    q["ar2_rolling"] = (_with(obs(), grid(), least_squares_pred(
        "r", 1, {"x0": "1.0", "x1": "lag(y, 1) OVER {W} - c", "x2": "lag(y, 2) OVER {W} - c"})) + fold_metric_sql("fm"))
    wave = "2 * pi() * date_diff('second', TIMESTAMP '1970-01-01 00:00:00', ds) / 86400"
    q["trend_daily_rolling"] = (_with(obs(), grid(), least_squares_pred(
        "r", 12, {"x0": "1.0", "x1": "(i - i0 / 2.0) / i0", "x2": f"sin({wave})", "x3": f"cos({wave})"})) + fold_metric_sql("fm"))
    q["evaluation_matrix_one_minute"] = evaluation_matrix_sql(("naive", "mean", "trend"), ("one_minute",), ("1_step", "1_hour"))
    holdout = (f"t AS (SELECT * FROM (SELECT *, lag(y, 1) OVER {W} AS yhat, "
               f"percent_rank() OVER {W} AS pr FROM r) WHERE NOT (pr <= CAST(0.8 AS DOUBLE)))")
    q["regression_metrics"] = (_with(obs(), grid(), holdout)
                               + f"SELECT {KEYS}, {_round('rmse', 'mse', 'mae')}, n FROM "
                               f"(SELECT {KEYS}, {METRICS} FROM t GROUP BY 1, 2, 3)")
    q["mape"] = (_with(obs(), grid(), holdout)
                 + f"SELECT {KEYS}, {_round('mape_low', 'mape', 'mape_high')} FROM "
                 f"(SELECT {KEYS}, {METRICS} FROM t GROUP BY 1, 2, 3)")
    q["fold_means"] = (_with(obs(), grid(), naive_pred("r", 12, 1), fold_mean_cte("p"))
                       + f"SELECT {KEYS}, fold, ds, {_round('y', 'yhat')} FROM fm")
    q["fold_metrics"] = (_with(obs(), grid(), naive_pred("r", 1, 1), fold_mean_cte("p"))
                         + fold_metric_sql("fm"))
    q["rolling_naive"] = (_with(obs("fifteen_minute"), grid(g="fifteen_minute"), naive_pred("r", 48, 4),
                                fold_mean_cte("p")) + fold_metric_sql("fm"))
    q["predictions_table"] = (_with(obs(), grid(), naive_pred("r", 12, 1))
                              + f"SELECT {KEYS}, fold, ds, {_round('y', 'yhat')} FROM p")
    q["metrics_sink"] = (
        _with(obs(), grid(), mean_pred("r", 1, 1, "p1"), fold_mean_cte("p1", "m1"),
              mean_pred("r", 12, 1, "p12"), fold_mean_cte("p12", "m12"))
        + f"SELECT {KEYS}, 'mean' AS model, 'one_hour' AS granularity, '1_step' AS forecast, {METRIC_OUT} "
        f"FROM (SELECT {KEYS}, {METRICS} FROM m1 GROUP BY 1, 2, 3) UNION ALL "
        f"SELECT {KEYS}, 'mean' AS model, 'one_hour' AS granularity, '12_hour' AS forecast, {METRIC_OUT} "
        f"FROM (SELECT {KEYS}, {METRICS} FROM m12 GROUP BY 1, 2, 3)")
    q["ar1_rolling"] = (_with(obs(), grid(), ar1_pred("r", 12, 1), fold_mean_cte("p"))
                        + fold_metric_sql("fm"))
    q["trend_rolling"] = (_with(obs(), grid(), trend_pred("r", 1, 1), fold_mean_cte("p"))
                          + fold_metric_sql("fm"))
    q["grouped_forecast"] = (
        _with(obs(), grid(), mean_pred("r", 1, 1), fold_mean_cte("p"))
        + f"SELECT {KEYS}, {_r6('mape')} AS MAPE, {_r6('rmse')} AS RMSE, {_r6('mse')} AS MSE, "
        f"{_r6('mae')} AS MAE FROM (SELECT {KEYS}, {METRICS} FROM fm GROUP BY 1, 2, 3)")
    q["rollup_stream"] = q["rollup_one_hour"]
    q["feature_stages"] = (_features() + f"SELECT {KEYS}, ds, {_round('y', 'lag_1', 'lag_2', 'avg_2')}, "
                           "hour FROM ff")
    q["evaluation_matrix"] = evaluation_matrix_sql()
    q["rolling_long_series"] = (
        f"SELECT * EXCLUDE (granularity) FROM ("
        + evaluation_matrix_sql(granularities=("one_hour",), forecasts=("1_step", "12_hour")) + ")")
    return q


_PRED = {"naive": naive_pred, "mean": mean_pred, "ar1": ar1_pred, "trend": trend_pred}
# Fixed values: (h, step) per forecast kind at one hour and fifteen minutes.
_MATRIX_HORIZONS = {"one_minute": {"1_step": (1, 1), "1_hour": (60, 60)},
                    "one_hour": {"1_step": (1, 1), "1_hour": (1, 1), "12_hour": (12, 1)},
                    "fifteen_minute": {"1_step": (1, 1), "1_hour": (4, 4), "12_hour": (48, 4)}}


def evaluation_matrix_sql(models=("naive", "mean", "ar1", "trend"),
                          granularities=("one_hour", "fifteen_minute"),
                          forecasts=("1_step", "1_hour", "12_hour")) -> str:
    ctes, selects = [], []
    for g in granularities:
        ctes += [obs(g, f"obs_{g}"), grid(f"obs_{g}", g, f"r_{g}")]
        for fc, (h, step) in _MATRIX_HORIZONS[g].items():
            if fc not in forecasts:
                continue
            for m in models:
                tag = f"{m}_{g}_{fc}"
                ctes += [_PRED[m](f"r_{g}", h, step, f"p_{tag}"), fold_mean_cte(f"p_{tag}", f"fm_{tag}")]
                selects.append(f"SELECT {KEYS}, '{m}' AS model, '{g}' AS granularity, "
                               f"'{fc}' AS forecast, {METRIC_OUT} FROM (SELECT {KEYS}, {METRICS} "
                               f"FROM fm_{tag} GROUP BY 1, 2, 3)")
    return _with(*ctes) + " UNION ALL ".join(selects)
