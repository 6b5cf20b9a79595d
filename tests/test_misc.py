import os
from datetime import datetime

import pytest
from pyspark.ml import Pipeline, PipelineModel

from conftest import hourly, series_df
from gridcast.functions.transforms import inverse_transform, log_transform
from gridcast.operators.resample import resample
from gridcast.operators.series import count_series, select_series, select_time_series
from gridcast.operators.stages import (DropNullsStage, LagStage, LogStage, MovingAverageStage,
                                       ResampleStage, TimeInfoStage)
from gridcast.sources.sinks import align_predictions

D = datetime.fromisoformat


def test_default_from_date_is_first_observation_in_range(spark):
    obs = series_df(spark, [(D("2020-06-24 03:00"), 3.0), (D("2020-06-24 05:00"), 5.0),
                            (D("2020-06-24 09:00"), 9.0)])
    out = resample(obs, "one_hour", to_date="2020-06-24 06:00:00", anchor="from_date")
    assert sorted((r.ds.hour, r.y) for r in out.collect()) == [(3, 3.0), (4, 0.1), (5, 5.0), (6, 0.1)]


def test_align_predictions_by_key_and_time_not_position(spark):
    actual = series_df(spark, hourly("2020-06-24 00:00", [1.0, 2.0, 3.0]))
    pred = spark.createDataFrame(
        [("a", "1", 6, D("2020-06-24 02:00"), 2.5), ("a", "1", 6, D("2020-06-24 01:00"), 1.5)],
        "name string, unique_id string, id_object int, ds timestamp_ntz, yhat double")
    got = sorted((r.ds.hour, r.y, r.yhat) for r in align_predictions(pred, actual).collect())
    assert got == [(1, 2.0, 1.5), (2, 3.0, 2.5)]


def test_min_observations_is_strict_and_counted(spark):
    a = series_df(spark, hourly("2020-06-24 00:00", [1.0] * 3), name="a")
    b = series_df(spark, hourly("2020-06-24 00:00", [1.0] * 4), name="b")
    kept = select_time_series(a.unionByName(b), 3)
    assert {r.name for r in kept.collect()} == {"b"}
    assert count_series(kept).first().n_series == 1


def test_select_many_series_above_in_list_limit(spark):
    rows = [(f"s{i}", "1", 6, D("2020-06-24 00:00"), float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "name string, unique_id string, id_object int, "
                                     "ds timestamp_ntz, y double")
    keys = [{"name": f"s{i}", "unique_id": 1, "id_object": 6} for i in range(0, 300, 2)]
    assert select_series(df, keys).count() == 150
    assert select_series(df, keys[:5]).count() == 5


def test_log_check_rejects_non_positive(spark):
    df = series_df(spark, hourly("2020-06-24 00:00", [1.0, 0.0]))
    with pytest.raises(Exception):
        log_transform(df, "log", check=True).collect()
    back = inverse_transform(log_transform(df, "log1p"), "log1p", cols=("y",))
    assert sorted(r.y for r in back.collect()) == [0.0, 1.0]


def test_pipeline_stages_round_trip(spark, tmp_path):
    obs = series_df(spark, hourly("2020-06-24 00:00", [1.0, 2.0, 4.0, 8.0]))
    pipe = Pipeline(stages=[ResampleStage(granularity="one_hour"), TimeInfoStage(info=["hour"]),
                            LogStage(kind="log1p"), LagStage(lags=1), MovingAverageStage(n=2),
                            DropNullsStage(cols=["lag_1"])])
    model = pipe.fit(obs)
    path = str(tmp_path / "pipe")
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    a = sorted(tuple(r) for r in model.transform(obs).collect())
    b = sorted(tuple(r) for r in again.transform(obs).collect())
    assert a == b and len(a) == 3


def test_min_observations_semi_join_variant(spark):
    a = series_df(spark, hourly("2020-06-24 00:00", [1.0] * 3), name="a")
    b = series_df(spark, hourly("2020-06-24 00:00", [1.0] * 4), name="b")
    kept = select_time_series(a.unionByName(b), 3, method="semi_join")
    assert {r.name for r in kept.collect()} == {"b"}


def test_checkpoint_dir_comes_from_the_session():
    """The session's setting, else a folder of its (shared) warehouse; never
    a folder of one machine, and the same rule for every master."""
    from gridcast.session import ensure_checkpoint_dir

    class Ctx:
        def __init__(self):
            self.dir = None

        def getCheckpointDir(self):
            return self.dir

        def setCheckpointDir(self, d):
            self.dir = d

    class Conf:
        def __init__(self, values):
            self.values = {"spark.sql.warehouse.dir": "hdfs:///shared/warehouse", **values}

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Session:
        def __init__(self, values):
            self.sparkContext, self.conf = Ctx(), Conf(values)

    assert ensure_checkpoint_dir(Session({"spark.checkpoint.dir": "hdfs:///shared/ckpt"})) == "hdfs:///shared/ckpt"
    assert ensure_checkpoint_dir(Session({})) == "hdfs:///shared/warehouse/_scratch"


def test_written_tables_can_be_forgotten(spark):
    from gridcast.session import forget, written
    df, path = written(spark.range(5), "t-written")
    assert df.count() == 5 and os.path.exists(path.removeprefix("file:"))
    forget(spark, path)
    assert not os.path.exists(path.removeprefix("file:"))


def test_selection_has_one_path_for_any_list(spark):
    import pytest
    from gridcast.operators.series import select_series
    df = spark.createDataFrame([("a", "1", 1, 1.0), ("b", "1", 1, 2.0), ("b", "2", 1, 3.0)],
                               "name string, unique_id string, id_object int, y double")
    for extra in (0, 200):
        keys = [{"name": "b", "unique_id": 1, "id_object": "1"}]
        keys += [{"name": f"n{i}", "unique_id": i, "id_object": i} for i in range(extra)]
        assert [r.y for r in select_series(df, keys).collect()] == [2.0]
    twice = [{"name": "a"}, {"name": "a"}]
    assert [r.y for r in select_series(df, twice).collect()] == [1.0]
    with pytest.raises(ValueError, match="same columns"):
        select_series(df, [{"name": "a"}, {"name": "b", "unique_id": 1}])
    with pytest.raises(ValueError, match="no value"):
        select_series(df, {"name": None})
    with pytest.raises(ValueError, match="empty"):
        select_series(df, [])


def test_a_cluster_does_not_write_to_a_local_warehouse():
    from gridcast.session import ensure_checkpoint_dir

    class Session:
        def __init__(self, values):
            self.dir = None
            self.sparkContext = self
            self.conf = self
            self.values = values

        def getCheckpointDir(self):
            return self.dir

        def setCheckpointDir(self, d):
            self.dir = d

        def get(self, key, default=None):
            return self.values.get(key, default)

    local = {"spark.sql.warehouse.dir": "file:/home/x/warehouse"}
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session({**local, "spark.master": "spark://host:7077"}))
    assert ensure_checkpoint_dir(Session({**local, "spark.master": "local[4]"})).endswith("_scratch")
    assert ensure_checkpoint_dir(Session({**local, "spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///c"})) == "hdfs:///c"
