"""Observation sink and scan.

Layout: one parquet dataset partitioned by ``granularity``, columns
``name, unique_id, id_object, window_end, average_count`` (+ n, total).
Reading one granularity prunes the other partitions; key and time
predicates added later reach the scan as pushed filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.schema import KEYS, Granularity


def to_sink_layout(obs: DataFrame, granularity: str | Granularity) -> DataFrame:
    """Observations (keys, ds, y[, n, total]) in the sink layout; used by the
    batch writer and by the streaming rollup alike."""
    g = granularity if isinstance(granularity, Granularity) else Granularity.of(granularity)
    return obs.select(*KEYS, F.col("ds").alias("window_end"), F.col("y").alias("average_count"),
                      *[c for c in ("n", "total") if c in obs.columns],
                      F.lit(g.name).alias("granularity"))


def write_observations(obs: DataFrame, root: str, granularity: str | Granularity) -> None:
    (to_sink_layout(obs, granularity).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("granularity").parquet(root))


def read_aggregation(spark: SparkSession, root: str,
                     granularity: str | Granularity = "one_hour",
                     with_counts: bool = False, partial: bool = False) -> DataFrame:
    """Scan one granularity as ``name, unique_id, id_object, ds, y`` (plus
    the additive ``n, total`` with ``with_counts``). Reads a batch-written
    root or a streaming sink alike; ``partial`` adds up the partial sums of a
    partial-mode stream."""
    g = granularity if isinstance(granularity, Granularity) else Granularity.of(granularity)
    extra = ["n", "total"] if with_counts else []
    rows = (spark.read.parquet(root).filter(F.col("granularity") == g.name)
            .withColumnsRenamed({"window_end": "ds", "average_count": "y"}))
    if partial:
        rows = (rows.groupBy(*KEYS, "ds").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
                .withColumn("y", F.when(F.col("n") > 0, F.col("total") / F.col("n"))))
    return rows.select(*KEYS, "ds", "y", *extra)
