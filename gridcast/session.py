"""Session helpers: a tuned local session for tests and benches, and the
shared scratch folder every written intermediate goes to.

Library code never creates a session; it receives one. The scratch folder
is always the session's ``spark.checkpoint.dir`` (a shared file system on a
cluster); only where that is unset do we use a folder of the session's
warehouse. On a cluster a warehouse on a local disk is refused, as executors
would not see each other's files there.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale as much as locally: AQE re-plans shuffles
# from measured sizes (broadcast only when the measured side is small,
# coalesce tiny partitions, split skewed join partitions).
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Python call-site capture for error messages: several py4j round trips
    # per column expression while a plan is built (seconds for the wide
    # model plans); plans and results are unaffected.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "gridcast") -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "8g")
               .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="gridcast-ckpt-")))
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    # Local test data is a few MB: with AQE's default 1 MB floor every
    # coalesced stage becomes one task, and the CPU-heavy model stages
    # (window fits, Arrow-batched solves) then use one core of the local
    # machine. A lower floor keeps several tasks. Cluster sessions keep
    # their own settings; at scale partitions are sized by the advisory
    # 64 MB target anyway.
    builder = builder.config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder: the one of the context, else
    ``spark.checkpoint.dir``, else a folder of the warehouse."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        given, warehouse = spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if not given and not spark.conf.get("spark.master", "local").startswith("local") and urlparse(warehouse).scheme in ("", "file"):
            raise ValueError(f"set spark.checkpoint.dir to a shared folder: the warehouse {warehouse} is local to each machine")
        sc.setCheckpointDir(given or f"{warehouse}/_scratch")
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for a written table."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "gridcast", f"{name}-{uuid.uuid4().hex[:12]}")


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written once to the shared scratch folder and read again, and
    its path: cuts the lineage, and a lost executor reads the table anew."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def forget_scratch(spark: SparkSession) -> None:
    """Delete all tables that this session's queries left for their lazy
    results to read; call it once the results are taken."""
    forget(spark, os.path.join(ensure_checkpoint_dir(spark), "gridcast"))
