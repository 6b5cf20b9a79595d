import os

from conftest import SF_SMALL
from gridcast.operators.rollup import rollup_batch, rollup_coarsen
from gridcast.session import scratch_path
from gridcast.sources.observations import read_aggregation
from gridcast.sources.tables import raw_events, raw_from_events, table
from gridcast.streaming.rollup import rollup_stream
from pyspark.sql import functions as F


def test_stream_rollup_equals_batch_on_closed_windows(spark):
    events = table(spark, SF_SMALL, "events")
    sink, ckpt = scratch_path(spark, "t-sink"), scratch_path(spark, "t-ckpt")
    q = rollup_stream(spark, SF_SMALL, events.schema, raw_from_events, sink, ckpt,
                      "one_hour", "10 minutes", file_glob="events.parquet")
    q.awaitTermination()
    streamed = read_aggregation(spark, sink, "one_hour", with_counts=True)
    watermark = events.agg(F.max("ts")).first()[0]
    batch = rollup_batch(raw_events(spark, SF_SMALL), "one_hour")
    closed = batch.filter(F.col("ds") <= F.lit(watermark) - F.expr("INTERVAL 10 MINUTES"))
    cols = ["name", "unique_id", "id_object", "ds", "n"]
    assert streamed.count() > 0
    assert streamed.select(cols).exceptAll(closed.select(cols)).count() == 0
    assert closed.select(cols).exceptAll(streamed.select(cols)).count() == 0
    # restart from the same checkpoint: nothing new, nothing duplicated
    q2 = rollup_stream(spark, SF_SMALL, events.schema, raw_from_events, sink, ckpt,
                       "one_hour", "10 minutes", file_glob="events.parquet")
    q2.awaitTermination()
    assert read_aggregation(spark, sink, "one_hour").count() == streamed.count()


def _daily_files(spark, folder):
    """Three days of hourly rows, one file a day, not in the order of time."""
    from datetime import datetime, timedelta
    for i, day in enumerate((2, 0, 1)):
        rows = [("a", "1", 6, datetime(2024, 1, 1 + day) + timedelta(hours=h, minutes=5), float(h)) for h in range(24)]
        spark.createDataFrame(rows, "name string, unique_id string, id_object int, ts timestamp_ntz, value double").coalesce(
            1).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


def _run(spark, folder, schema, **kw):
    sink, ckpt = scratch_path(spark, "t-sink"), scratch_path(spark, "t-ckpt")
    q = rollup_stream(spark, folder, schema, lambda df: df, sink, ckpt, "one_hour", **kw)
    q.awaitTermination()
    return q, sink


def test_partial_mode_loses_no_late_row(spark, tmp_path):
    raw = _daily_files(spark, str(tmp_path / "in"))
    want = rollup_batch(raw, "one_hour")
    for files in (None, 1):
        _, sink = _run(spark, str(tmp_path / "in"), raw.schema, max_files_per_trigger=files, mode="partial")
        got = read_aggregation(spark, sink, "one_hour", with_counts=True, partial=True).select(*want.columns)
        assert got.count() == 72
        assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()


def test_append_mode_tells_what_it_drops_and_what_is_open(spark, tmp_path):
    from gridcast.streaming.rollup import dropped_rows, open_windows
    raw = _daily_files(spark, str(tmp_path / "in"))
    q, sink = _run(spark, str(tmp_path / "in"), raw.schema, max_files_per_trigger=None, lateness="3 days")
    written = read_aggregation(spark, sink, "one_hour").count() if os.path.exists(sink + "/granularity=one_hour") else 0
    assert dropped_rows(q) == 0
    assert written + open_windows(q, raw).count() == 72
    q, sink = _run(spark, str(tmp_path / "in"), raw.schema, max_files_per_trigger=1, lateness="10 minutes")
    kept = read_aggregation(spark, sink, "one_hour", with_counts=True)
    lost = 72 - kept.agg(F.sum("n")).first()[0] - open_windows(q, raw).agg(F.sum("n")).first()[0]
    assert lost == dropped_rows(q)


def test_coarsen_equals_direct_rollup(spark):
    raw = raw_events(spark, SF_SMALL)
    fine = rollup_batch(raw, "fifteen_minute")
    a = rollup_coarsen(fine, "one_hour").select("name", "unique_id", "ds", "n",
                                                 F.round("total", 6).alias("t"))
    b = rollup_batch(raw, "one_hour").select("name", "unique_id", "ds", "n",
                                              F.round("total", 6).alias("t"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_rollup_independent_of_session_zone(spark):
    raw = raw_events(spark, SF_SMALL)
    base = sorted(rollup_batch(raw, "one_day").select("name", "unique_id", "ds", "n").collect())
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        other = sorted(rollup_batch(raw, "one_day").select("name", "unique_id", "ds", "n").collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert base == other


def test_coarsened_series_equal_direct_rollup_grids(spark):
    """The evaluation matrix reads the raw table once: coarser grids come
    from the finest rollup and equal grids of direct rollups."""
    import pytest
    from gridcast.operators.resample import resample
    from gridcast.plans.matrix import coarsened_series
    raw = raw_events(spark, SF_SMALL)
    series_for = coarsened_series(rollup_batch(raw, "fifteen_minute"), "fifteen_minute")
    for g in ("fifteen_minute", "one_hour", "one_day"):
        a = series_for(g).select("name", "unique_id", "ds", F.round("y", 9).alias("y"))
        b = resample(rollup_batch(raw, g), g).select("name", "unique_id", "ds",
                                                     F.round("y", 9).alias("y"))
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0, g
    with pytest.raises(ValueError):
        coarsened_series(rollup_batch(raw, "one_hour"), "one_hour")("fifteen_minute")
