"""Streaming tumbling-window rollup (T2, S6): the producer of the
observation table. Two modes:

``mode="partial"``: no state and no loss. Each Arrow batch of the stream is
summed up per (keys, window) and the partial sums (``n``, ``total``) are
appended to the parquet sink; ``read_aggregation(partial=True)`` adds them up.
However late a row comes, it only adds a partial; a bounded run is complete as
soon as it ends.

``mode="append"``: one final row per window. Event time as TIMESTAMP
(watermarks refuse TIMESTAMP_NTZ; the conversion goes through epoch
microseconds, so no session time zone shifts a window) -> ``withWatermark`` ->
``groupBy(keys, window)`` -> append. A window is written once the watermark
passes its end, and state for older windows is dropped, so the state size is
bounded by the lateness. Rows later than that are lost: ``dropped_rows`` tells
how many. The windows still open when a bounded run ends are not written:
``open_windows`` gives them.

Both write the observation layout (``window_end``, ``average_count``, ``n``,
``total``, partitioned by ``granularity``). Checkpoints go to the shared
checkpoint folder, so a restarted query resumes exactly once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridcast.functions.time import epoch_micros, from_epoch_micros
from gridcast.operators.rollup import rollup_batch
from gridcast.schema import KEYS, Granularity
from gridcast.sources.observations import to_sink_layout

_EPOCH_NTZ = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def _to_instant(ntz: str) -> Column:
    return F.timestamp_micros(epoch_micros(ntz))


def _to_ntz(instant: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.expr(_EPOCH_NTZ))


def rollup_stream_df(raw: DataFrame, granularity: str | Granularity = "one_hour",
                     lateness: str = "10 minutes") -> DataFrame:
    """Streaming (or batch) rollup of ``keys, ts, value`` rows with a
    watermark; same columns as ``rollup_batch``."""
    g = granularity if isinstance(granularity, Granularity) else Granularity.of(granularity)
    x = raw.withColumn("_et", _to_instant("ts")).withWatermark("_et", lateness)
    agg = (x.groupBy(*KEYS, F.window("_et", g.interval).alias("w"))
           .agg(F.avg("value").alias("y"), F.count("value").alias("n"),
                F.sum("value").alias("total")))
    return agg.select(*KEYS, _to_ntz(F.col("w.end")).alias("ds"), "y", "n", "total")


def partial_sums_df(raw: DataFrame, granularity: str | Granularity = "one_hour") -> DataFrame:
    """Partial (keys, ds, y, n, total) of ``keys, ts, value`` rows, one per
    Arrow batch and window; the same on a stream and on a table."""
    g = granularity if isinstance(granularity, Granularity) else Granularity.of(granularity)
    step = g.seconds * 1_000_000
    us = epoch_micros("ts")
    end = from_epoch_micros(us - F.pmod(us, F.lit(step)) + step)
    x = raw.filter("ts is not null").select(*KEYS, end.alias("ds"), F.col("value").cast("double").alias("value"))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch]).group_by([*KEYS, "ds"]).aggregate([("value", "sum"), ("value", "count")])
            yield from t.select([*KEYS, "ds", "value_sum", "value_count"]).rename_columns(
                [*KEYS, "ds", "total", "n"]).to_batches()

    types = {f.name: f.dataType.simpleString() for f in x.schema.fields}
    schema = ", ".join(f"{c} {types[c]}" for c in (*KEYS, "ds")) + ", total double, n long"
    sums = x.mapInArrow(add_up, schema)
    return sums.select(*KEYS, "ds", F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("y"), "n", "total")


def rollup_stream(spark: SparkSession, source: str, schema: StructType,
                  mapper: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str,
                  granularity: str | Granularity = "one_hour", lateness: str = "10 minutes",
                  available_now: bool = True, max_files_per_trigger: int | None = None,
                  file_glob: str | None = None, mode: str = "append"):
    """Start the rollup stream from the parquet files in directory ``source``
    (optionally only those matching ``file_glob``); with
    ``available_now`` it processes what is there and stops. Returns the
    StreamingQuery. The sink folder belongs to the stream (its file log
    lists the committed files); read it with ``read_aggregation``, in partial
    mode with ``partial=True``."""
    if mode not in ("append", "partial"):
        raise ValueError(f"unknown mode {mode!r}")
    reader = spark.readStream.schema(schema)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = mapper(reader.parquet(source))
    obs = rollup_stream_df(raw, granularity, lateness) if mode == "append" else partial_sums_df(raw, granularity)
    writer = (to_sink_layout(obs, granularity).writeStream.outputMode("append").format("parquet")
              .partitionBy("granularity").option("path", sink).option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="1 minute")
    return writer.start()


def dropped_rows(query) -> int:
    """Groups of rows that an append-mode query lost as later than its
    lateness, over the progress reports that Spark still keeps."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress
               for op in p["stateOperators"])


def open_windows(query, raw: DataFrame, granularity: str | Granularity = "one_hour") -> DataFrame:
    """Rollup of the windows that an ended append-mode run left open: those
    that end after its last watermark. ``raw`` is the same input as a table;
    its ``ts`` bound reaches the scan."""
    g = granularity if isinstance(granularity, Granularity) else Granularity.of(granularity)
    marks = [p["eventTime"]["watermark"] for p in query.recentProgress if "watermark" in (p["eventTime"] or {})]
    last = max(marks, default="1970-01-01T00:00:00.000Z").rstrip("Z").replace("T", " ")
    out = rollup_batch(raw, g, from_date=last)
    return out.filter(F.col("ds") > F.lit(last).cast("timestamp_ntz"))
