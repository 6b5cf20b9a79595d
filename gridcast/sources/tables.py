"""Map the driver's raw tables onto the series model.

A raw table becomes ``name, unique_id, id_object, ts, value``: one row per
measurement, not yet on any grid. ``rollup_batch`` / ``rollup_stream`` turn
that into observations.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# How the driver tables map onto series keys.
# events: name = event_type, unique_id = user bucket (user_id mod 3), id_object = 6
# orders: name = o_orderpriority, unique_id = o_orderstatus, id_object = 1
EVENT_USER_BUCKETS = 3
EVENT_ID_OBJECT = 6
ORDER_ID_OBJECT = 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def raw_from_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_type").alias("name"),
        F.pmod("user_id", F.lit(EVENT_USER_BUCKETS)).cast("string").alias("unique_id"),
        F.lit(EVENT_ID_OBJECT).cast("int").alias("id_object"),
        F.col("ts"),
        F.col("value"),
    )


def raw_from_orders(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_orderpriority").alias("name"),
        F.col("o_orderstatus").alias("unique_id"),
        F.lit(ORDER_ID_OBJECT).cast("int").alias("id_object"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_totalprice").alias("value"),
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_from_events(table(spark, sf_dir, "events"))


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_from_orders(table(spark, sf_dir, "orders"))
