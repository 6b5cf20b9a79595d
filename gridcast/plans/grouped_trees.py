"""Regression trees for all series at once (M1-M3).

One tree per series, all grown in the same plan, level by level, as histograms:
every feature of a series is cut into ``bins`` equal steps between its smallest
and largest training value; a level's split statistics are one grouped sum keyed
by (series, node, feature, bin), added up on the rows' side before the shuffle, and
the best split of each node is a window over at most features x bins sums.
The number of jobs depends on the depth, not on the number of series, and a long
series' rows are spread over all tasks in every pass.

Training rows are written once and never moved by series: the trees so far, one
row per series with a map of its nodes (at most 2^(depth + 1)), are copied to
``SALTS`` places and meet the rows by (series, place).

Values are counted in whole units (``unit``, a millionth by default): sums of
whole numbers do not depend on the order of rows, so neither do the trees. A
split's gain is the fall of the squared error; ties go to the first feature and
the smallest cut. Rows with a null feature or label take no part in the fit and
get no prediction. A node is split if both sides keep ``min_rows`` rows and the
error falls; a series without training rows has no tree and no predictions.

``boost_trees`` fits each next tree to what the trees before leave, weighted by
``rate``; the first tree counts whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.functions.transforms import inverse_transform
from gridcast.operators.chunked import attach
from gridcast.operators.metrics import regression_metrics
from gridcast.operators.split import split_by_rank
from gridcast.schema import KEYS
from gridcast.session import forget, written

#: places that a series' tree is copied to
SALTS = 16
BINS = 32
UNIT = 1e-6
#: exact halves of a unit are kept away from the rounding boundary (see registry)
_HALF = 0.5002
_NODE = "struct<feature:int,cut:bigint,n:bigint,value:double>"


def units(c: Column, unit: float = UNIT) -> Column:
    return F.floor(c.cast("double") * F.lit(float(round(1 / unit))) + F.lit(_HALF)).cast("long")


def _table(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], unit: float) -> DataFrame:
    """keys, _x (feature values in units), _y, _salt and the other columns."""
    x = df.withColumns({"_x": F.array(*[units(F.col(f), unit) for f in features]), "_y": units(F.col(label), unit)})
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c not in keys]), F.lit(SALTS)).cast("int")
    return x.withColumn("_salt", spread)


def _descend(tree: Column, x: Column, depth: int) -> Column:
    """The node that a row reaches: from the root, left if the split's
    feature is at most its cut."""
    def down(node: Column, _: Column) -> Column:
        at = tree[node]
        right = F.get(x, at["feature"]) > at["cut"]
        return F.when(at["feature"].isNotNull(), node * 2 + right.cast("int")).otherwise(node)

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), down) if depth else F.lit(1)


def _salted(trees: DataFrame) -> DataFrame:
    return trees.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))


def _splits(stats: DataFrame, keys: list[str], bins: int, min_rows: int) -> DataFrame:
    """keys, node, n, s and the best split (feature, cut) or nulls."""
    node = [*keys, "node"]
    ordered = Window.partitionBy(*node, "f").orderBy("b")
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*node, "f")
    x = stats.withColumns({"nl": F.sum("n").over(upto), "sl": F.sum("s").over(upto),
                           "nn": F.sum("n").over(whole), "ss": F.sum("s").over(whole)})
    left, right, all_ = (c.cast("double") for c in (F.col("sl"), F.col("ss") - F.col("sl"), F.col("ss")))
    nr = F.col("nn") - F.col("nl")
    gain = F.when((F.col("nl") >= min_rows) & (nr >= min_rows),
                  left * left / F.col("nl") + right * right / nr - all_ * all_ / F.col("nn"))
    # b-th cut: the largest unit that falls into bin b or below
    step = (F.col("b") + 1) * (F.col("hi") - F.col("lo") + 1)
    cut = F.col("lo") + F.floor((step + (bins - 1)) / F.lit(bins)).cast("long") - 1
    found = F.when(gain > 0, F.struct((-gain).alias("g"), F.col("f").alias("feature"), cut.alias("cut")))
    return (x.withColumn("found", found).groupBy(*node).agg(
        F.min("found").alias("best"),  # of structs: the largest gain, then feature, then cut; nulls are left out
        F.max("nn").alias("n"), F.max("ss").alias("s"))
        .select(*node, "n", "s", "best.feature", "best.cut"))


def fit_trees(rows: DataFrame, features: Sequence[str], label: str = "y", max_depth: int = 5, bins: int = BINS,
              min_rows: int = 1, keys: Sequence[str] = KEYS, unit: float = UNIT) -> DataFrame:
    """One row per series: keys and ``tree``, a map from node number (1 the
    root, 2k and 2k + 1 the sides of k) to feature (place in ``features``, null
    for a leaf), cut (in units), n and value."""
    keys = list(keys)
    table = _table(rows, features, label, keys, unit)
    known = table.filter(F.col("_y").isNotNull() & ~F.exists("_x", lambda v: v.isNull()))
    data, path = written(known.select(*keys, "_x", "_y", "_salt"), "tree-rows")
    tree = _grow(data, len(features), max_depth, bins, min_rows, keys, unit)
    forget(rows.sparkSession, path)
    return tree


def _grow(data: DataFrame, n_features: int, max_depth: int, bins: int, min_rows: int, keys: list[str],
          unit: float) -> DataFrame:
    places = range(n_features)
    limits = data.groupBy(*keys).agg(F.array(*[F.min(F.col("_x")[i]) for i in places]).alias("los"),
                                     F.array(*[F.max(F.col("_x")[i]) for i in places]).alias("his"))
    empty = F.create_map().cast(f"map<int,{_NODE}>")
    trees, at = written(limits.withColumn("tree", empty), "trees-0")
    for level in range(max_depth + 1):
        near = attach(data, _salted(trees), [*keys, "_salt"])
        node = _descend(F.col("tree"), F.col("_x"), level)
        deepest = level == max_depth
        cells = F.transform(F.col("_x"), lambda v, i: F.struct(
            i.alias("f"), F.get("los", i).alias("lo"), F.get("his", i).alias("hi"),
            F.floor((v - F.get("los", i)) * bins / (F.get("his", i) - F.get("los", i) + 1)).cast("int").alias("b")))
        at_node = near.withColumn("node", node).filter(F.col("node") >= 2 ** level)
        if deepest:
            found = at_node.groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_y").cast("decimal(38,0)")).alias("s"))
            found = found.select(*keys, "node", "n", "s", F.lit(None).cast("int").alias("feature"),
                                 F.lit(None).cast("long").alias("cut"))
        else:
            stats = (at_node.select(*keys, "node", "_y", F.explode(cells).alias("c"))
                     .groupBy(*keys, "node", "c.f", "c.b", "c.lo", "c.hi")
                     .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_y").cast("decimal(38,0)")).cast("decimal(38,0)").alias("s")))
            found = _splits(stats, keys, bins, min_rows)
        value = F.col("s").cast("double") / F.col("n") * F.lit(unit)
        entry = F.struct(F.col("node").alias("key"), F.struct(
            F.col("feature").alias("feature"), F.col("cut").cast("long").alias("cut"), F.col("n").alias("n"),
            value.alias("value")).alias("value"))
        nodes = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("more"))  # at most 2^level
        grown = attach_left(trees, nodes, keys).withColumn(
            "tree", F.when(F.col("more").isNull(), F.col("tree")).otherwise(F.map_concat("tree", "more"))).drop("more")
        last = at
        trees, at = written(grown, f"trees-{level + 1}")
        forget(data.sparkSession, last)
    return trees.select(*keys, "tree")


def attach_left(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    right = table.select(*[F.col(c).alias(f"_r_{c}") for c in keys], *[c for c in table.columns if c not in keys])
    on = F.lit(True)
    for c in keys:
        on = on & rows[c].eqNullSafe(right[f"_r_{c}"])
    return rows.join(right, on, "left").drop(*[f"_r_{c}" for c in keys])


def predict_trees(rows: DataFrame, trees: DataFrame, features: Sequence[str], max_depth: int = 5,
                  label: str = "y", keys: Sequence[str] = KEYS, unit: float = UNIT,
                  out: str = "prediction") -> DataFrame:
    """``rows`` with the value of the leaf that each reaches; series without
    a tree and rows with a null feature have no row in the result."""
    keys = list(keys)
    x = _table(rows, features, label, keys, unit).filter(~F.exists("_x", lambda v: v.isNull()))
    x = attach(x, _salted(trees), [*keys, "_salt"])
    leaf = _descend(F.col("tree"), F.col("_x"), max_depth)
    return x.withColumn(out, F.col("tree")[leaf]["value"]).select(*rows.columns, out)


def boost_trees(rows: DataFrame, features: Sequence[str], label: str = "y", rounds: int = 20, rate: float = 0.1,
                max_depth: int = 5, bins: int = BINS, min_rows: int = 1, keys: Sequence[str] = KEYS,
                unit: float = UNIT) -> DataFrame:
    """One row per series: keys and ``trees``, an array of (weight, tree)."""
    keys, ensemble = list(keys), None
    table = _table(rows, features, label, keys, unit)
    known = table.filter(F.col("_y").isNotNull() & ~F.exists("_x", lambda v: v.isNull()))
    data, at = written(known.select(*keys, "_x", "_y", "_salt"), "boost-rows")
    for k in range(rounds):
        trees = _grow(data, len(features), max_depth, bins, min_rows, keys, unit)
        weight = 1.0 if k == 0 else rate
        one = trees.select(*keys, F.array(F.struct(F.lit(weight).alias("weight"), "tree")).alias("trees"))
        ensemble = one if ensemble is None else attach(
            ensemble, one.withColumnRenamed("trees", "more"), keys).select(*keys, F.concat("trees", "more").alias("trees"))
        ensemble, _ = written(ensemble, "ensemble")
        if k + 1 < rounds:
            near = attach(data, _salted(trees), [*keys, "_salt"])
            got = F.col("tree")[_descend(F.col("tree"), F.col("_x"), max_depth)]["value"] * weight
            left = F.col("_y") - units(got, unit)
            last = at
            data, at = written(near.withColumn("_y", left).select(*keys, "_x", "_y", "_salt"), "boost-rows")
            forget(rows.sparkSession, last)
    forget(rows.sparkSession, at)
    return ensemble


def predict_boosted(rows: DataFrame, ensemble: DataFrame, features: Sequence[str], max_depth: int = 5, label: str = "y",
                    keys: Sequence[str] = KEYS, unit: float = UNIT, out: str = "prediction") -> DataFrame:
    keys = list(keys)
    x = _table(rows, features, label, keys, unit).filter(~F.exists("_x", lambda v: v.isNull()))
    x = attach(x, _salted(ensemble), [*keys, "_salt"])
    value = F.aggregate("trees", F.lit(0.0), lambda s, t: s + t["weight"] * t["tree"][
        _descend(t["tree"], F.col("_x"), max_depth)]["value"])
    return x.withColumn(out, value).select(*rows.columns, out)


def evaluate_trees(features_table: DataFrame, feature_cols: Sequence[str], kind: str = "decision_tree",
                   train_pct: float = 80, log: bool = False, keys: Sequence[str] = KEYS, max_depth: int = 5,
                   bins: int = BINS, min_rows: int = 1, rounds: int = 20, rate: float = 0.1,
                   unit: float = UNIT) -> tuple[DataFrame, DataFrame]:
    """Percent-rank split per series, one tree (or boosted trees) per
    series, predictions on the test rows: (keys, ds, y, prediction; metrics)."""
    keys, cols = list(keys), list(feature_cols)
    rows, _ = written(split_by_rank(features_table, train_pct, keys), "tree-features")
    train, test = rows.filter("is_train"), rows.filter("NOT is_train").select(*keys, "ds", "y", *cols)
    if kind == "decision_tree":
        trees = fit_trees(train, cols, "y", max_depth, bins, min_rows, keys, unit)
        pred = predict_trees(test, trees, cols, max_depth, "y", keys, unit)
    elif kind == "gbt":
        trees = boost_trees(train, cols, "y", rounds, rate, max_depth, bins, min_rows, keys, unit)
        pred = predict_boosted(test, trees, cols, max_depth, "y", keys, unit)
    else:
        raise ValueError(f"unknown tree model {kind!r}")
    pred = pred.select(*keys, "ds", "y", "prediction")
    if log:
        pred = inverse_transform(pred, "log1p")
    return pred, regression_metrics(pred, "y", "prediction", by=keys)
