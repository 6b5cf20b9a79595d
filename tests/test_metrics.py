import math

from gridcast.operators.metrics import fold_metrics, regression_metrics


def frame(spark, rows):
    return spark.createDataFrame([("a", "1", 6, float(y), float(p)) for y, p in rows],
                                 "name string, unique_id string, id_object int, y double, yhat double")


def test_metrics_values(spark):
    (r,) = regression_metrics(frame(spark, [(2, 1), (4, 5), (10, 10)])).collect()
    assert math.isclose(r.mse, 2 / 3) and math.isclose(r.rmse, math.sqrt(2 / 3))
    assert math.isclose(r.mae, 2 / 3)
    assert math.isclose(r.mape, (50 + 25 + 0) / 3)
    assert r.mape_low == 0.0 and r.mape_high == 50.0 and r.n == 3


def test_zero_actual_policy(spark):
    df = frame(spark, [(0, 1), (2, 1)])
    (inf,) = regression_metrics(df, zero="inf").collect()
    assert math.isinf(inf.mape_high) and math.isinf(inf.mape)
    (skip,) = regression_metrics(df, zero="skip").collect()
    assert skip.mape == 50.0 and skip.mape_high == 50.0


def test_fold_level_uses_fold_means(spark):
    rows = [("a", "1", 6, 0, "2020-06-24 01:00:00", 2.0, 1.0),
            ("a", "1", 6, 0, "2020-06-24 02:00:00", 4.0, 3.0),
            ("a", "1", 6, 1, "2020-06-24 03:00:00", 6.0, 6.0)]
    df = spark.createDataFrame(rows, "name string, unique_id string, id_object int, fold long, "
                               "ds string, y double, yhat double")
    df = df.withColumn("ds", df.ds.cast("timestamp_ntz"))
    (f,) = fold_metrics(df).collect()
    assert f.n == 2 and math.isclose(f.mse, 0.5)
    (p,) = fold_metrics(df, level="point").collect()
    assert p.n == 3 and math.isclose(p.mse, 2 / 3)
