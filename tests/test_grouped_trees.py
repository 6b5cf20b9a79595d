"""Trees of all series in one plan against plain Python trees."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridcast.plans import grouped_trees as gt

SCHEMA = "name string, unique_id string, id_object int, ds timestamp_ntz, y double, a double, b double"
COLS = ["a", "b"]


def table(spark, seed=1):
    """Series of 200, 40, 1 rows, one with null keys, some null features and labels."""
    r, rows = random.Random(seed), []
    for name, n in (("long", 200), ("short", 40), ("one", 1), (None, 30)):
        for i in range(n):
            a, b = r.choice([0.0, 1.0, 2.5, 7.0]), round(r.uniform(-3, 3), 2)
            y = round((10 if a > 1 else -5) + (3 if b > 0.5 else 0) + r.uniform(-1, 1), 3)
            rows.append((name, "1", 6, datetime(2024, 1, 1) + timedelta(hours=i), y, a, b))
    rows.append(("long", "1", 6, datetime(2025, 1, 1), 1.0, None, 0.0))
    rows.append(("long", "1", 6, datetime(2025, 1, 2), None, 0.0, 0.0))
    rows.append(("empty", "1", 6, datetime(2025, 1, 2), None, 0.0, 0.0))
    r.shuffle(rows)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def units(v):
    return math.floor(v * 1e6 + 0.5002)


def slow_tree(x, y, depth, bins=32, min_rows=1):
    """{node: (feature, cut, n, value)} by trying every cut."""
    lo, hi = [min(c) for c in zip(*x)], [max(c) for c in zip(*x)]
    out = {}

    def grow(at, rows, level):
        s = sum(y[i] for i in rows)
        best = None
        if level < depth:
            for f in range(len(lo)):
                for b in range(bins):
                    cut = lo[f] + -(-(b + 1) * (hi[f] - lo[f] + 1) // bins) - 1
                    left = [i for i in rows if x[i][f] <= cut]
                    n, m, sl = len(left), len(rows) - len(left), sum(y[i] for i in left)
                    if n < min_rows or m < min_rows or not any((x[i][f] - lo[f]) * bins // (hi[f] - lo[f] + 1) == b for i in rows):
                        continue
                    gain = float(sl) * float(sl) / n + float(s - sl) * float(s - sl) / m - float(s) * float(s) / len(rows)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = (gain, f, cut)
        out[at] = (best[1] if best else None, best[2] if best else None, len(rows), s / len(rows) * 1e-6)
        if best:
            grow(2 * at, [i for i in rows if x[i][best[1]] <= best[2]], level + 1)
            grow(2 * at + 1, [i for i in rows if x[i][best[1]] > best[2]], level + 1)

    grow(1, list(range(len(x))), 0)
    return out


def by_series(rows):
    out = {}
    for r in rows:
        if r[4] is not None and r[5] is not None and r[6] is not None:
            out.setdefault(r[0], ([], []))
            out[r[0]][0].append((units(r[5]), units(r[6])))
            out[r[0]][1].append(units(r[4]))
    return out


@pytest.mark.parametrize("depth,min_rows,bins", [(0, 1, 32), (1, 1, 32), (3, 1, 32), (4, 5, 8)])
def test_trees_against_plain_python(spark, depth, min_rows, bins):
    rows, df = table(spark)
    got = {r["name"]: r["tree"] for r in gt.fit_trees(df, COLS, max_depth=depth, min_rows=min_rows, bins=bins).collect()}
    want = {k: slow_tree(x, y, depth, bins, min_rows) for k, (x, y) in by_series(rows).items()}
    assert set(got) == set(want)  # a series without a usable row has no tree
    for k, tree in want.items():
        assert {n: (v["feature"], v["cut"], v["n"]) for n, v in got[k].items()} == {n: v[:3] for n, v in tree.items()}
        for n, v in tree.items():
            assert got[k][n]["value"] == pytest.approx(v[3], abs=1e-9)


def test_planted_steps_are_found_and_predicted(spark):
    rows = [(s, "1", 6, datetime(2024, 1, 1) + timedelta(hours=i), float(c if i % 24 < h else 9 * c), float(i % 24), 0.0)
            for s, c, h in (("x", 1, 8), ("y", 5, 17)) for i in range(480)]
    df = spark.createDataFrame(rows, SCHEMA)
    trees = gt.fit_trees(df, COLS, max_depth=1)
    assert {r["name"]: r["tree"][1]["feature"] for r in trees.collect()} == {"x": 0, "y": 0}
    pred = gt.predict_trees(df, trees, COLS, max_depth=1)
    assert pred.filter(F.abs(F.col("prediction") - F.col("y")) > 1e-9).count() == 0 and pred.count() == len(rows)


def test_rows_without_a_prediction(spark):
    rows, df = table(spark)
    trees = gt.fit_trees(df.filter("name = 'long'"), COLS, max_depth=2)
    pred = gt.predict_trees(df, trees, COLS, max_depth=2)
    assert {r["name"] for r in pred.select("name").distinct().collect()} == {"long"}
    assert pred.filter("a IS NULL").count() == 0 and pred.filter("y IS NULL").count() == 1
    assert gt.fit_trees(df.limit(0), COLS).count() == 0


def test_boosting_against_plain_python(spark):
    rows, df = table(spark)
    depth, rate = 2, 0.5
    ensemble = gt.boost_trees(df, COLS, rounds=3, rate=rate, max_depth=depth)
    got = {(r["name"], r["ds"]): r["prediction"] for r in gt.predict_boosted(df, ensemble, COLS, depth).collect()}
    for k, (x, y) in by_series(rows).items():
        total, left = [0.0] * len(x), list(y)
        for i in range(3):
            tree, weight = slow_tree(x, left, depth), 1.0 if i == 0 else rate
            for j, v in enumerate(x):
                at = 1
                while tree[at][0] is not None:
                    at = 2 * at + (v[tree[at][0]] > tree[at][1])
                total[j] += weight * tree[at][3]
                left[j] -= units(tree[at][3] * weight)
        kept = [r for r in rows if r[0] == k and None not in (r[4], r[5], r[6])]
        assert [got[(k, r[3])] for r in kept] == pytest.approx(total, abs=1e-9)


def test_sums_do_not_depend_on_the_rows_order(spark):
    _, df = table(spark)
    one = gt.fit_trees(df.coalesce(1), COLS, max_depth=3)
    two = gt.fit_trees(df.repartition(7, "b"), COLS, max_depth=3)
    key = lambda t: sorted(((r["name"], sorted((n, tuple(v)) for n, v in r["tree"].items())) for r in t.collect()), key=repr)
    assert key(one) == key(two)


def test_holdout_of_logged_labels_is_on_the_original_scale(spark):
    rows = [("x", "1", 6, datetime(2024, 1, 1) + timedelta(hours=i), math.log1p(100.0 + i % 2), float(i % 2), 0.0) for i in range(100)]
    pred, metrics = gt.evaluate_trees(spark.createDataFrame(rows, SCHEMA), COLS, log=True, max_depth=1)
    assert pred.agg(F.min("prediction"), F.max("prediction")).first()[0] == pytest.approx(100, abs=1e-3)
    assert metrics.first()["n"] == 20 and metrics.first()["mae"] < 1e-3
    with pytest.raises(ValueError):
        gt.evaluate_trees(spark.createDataFrame(rows, SCHEMA), COLS, kind="forest")
