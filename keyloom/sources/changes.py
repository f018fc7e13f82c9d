"""Change logs derived from tables: text keys, as the registered queries use them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.model import DELETE, PUT
from keyloom.operators.resolve import winners


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One change for each event: a user's key, an ``error`` deletes it, anything else puts ``props``."""
    return changes(spark.read.parquet(f"{sf_dir}/events.parquet"))


def changes(events: DataFrame) -> DataFrame:
    deleted = F.col("event_type") == "error"
    return events.select(
        F.format_string("user-%08d", "user_id").alias("key"),
        F.col("event_id").alias("seq"),
        F.when(deleted, DELETE).otherwise(PUT).alias("type"),
        F.when(deleted, "").otherwise(F.col("props")).alias("value"),
    )


def from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide key space: one put for each order, by customer and order; an order with status P counts as deleted."""
    deleted = F.col("o_orderstatus") == "P"
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.format_string("cust-%08d/%010d", "o_custkey", "o_orderkey").alias("key"),
        F.col("o_orderkey").alias("seq"),
        F.when(deleted, DELETE).otherwise(PUT).alias("type"),
        F.when(deleted, "").otherwise(F.col("o_orderpriority")).alias("value"),
    )


def level0(log: DataFrame, changes_per_file: int = 1000) -> DataFrame:
    """The log flushed every so many changes: level-0 files with the newest version of each key in them."""
    cut = log.withColumn("file_number", F.floor(F.col("seq") / changes_per_file).cast("bigint") + 1).withColumn("level", F.lit(0))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("file_number", "key").orderBy(F.desc("seq")))
    return cut.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def memtable(log: DataFrame) -> DataFrame:
    """One entry for each key, deletes included."""
    return winners(log)
