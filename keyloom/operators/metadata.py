"""Metadata relations: tables, levels, their order, overlap and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.scalar import output_cost


def table_metadata(segments: DataFrame) -> DataFrame:
    """Smallest and largest key, entries and logical bytes of every file."""
    return segments.groupBy("level", "file_number").agg(
        F.min("key").alias("smallest_key"),
        F.max("key").alias("largest_key"),
        F.count("*").alias("entry_count"),
        F.sum(output_cost(F.col("key"), F.col("value"))).cast("bigint").alias("file_size_bytes"),
    )


def level_summary(tables: DataFrame) -> DataFrame:
    return tables.groupBy("level").agg(F.count("*").alias("files"), F.sum("file_size_bytes").alias("bytes"), F.sum("entry_count").alias("entries"))


def overlaps(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    return (a_low <= b_high) & (b_low <= a_high)


def overlap_pairs(tables: DataFrame) -> DataFrame:
    """Pairs of files of one level whose key ranges meet: a range join on file metadata, never on entries.

    The level is an equi-join key and the ranges a filter, so the work grows with the square of a level's number of files.
    :func:`sorted_level_conflicts` tells in one ordered pass whether there is any pair.
    """
    a = tables.select("level", F.col("file_number").alias("a"), F.col("smallest_key").alias("a_low"), F.col("largest_key").alias("a_high"))
    b = tables.select("level", F.col("file_number").alias("b"), F.col("smallest_key").alias("b_low"), F.col("largest_key").alias("b_high"))
    return a.join(b, "level").where((F.col("a") < F.col("b")) & overlaps(F.col("a_low"), F.col("a_high"), F.col("b_low"), F.col("b_high"))).select("level", "a", "b")


def sorted_level_conflicts(tables: DataFrame) -> DataFrame:
    """Files at level 1 or deeper that begin before the furthest end of the files ahead of them: there should be none."""
    w = Window.partitionBy("level").orderBy("smallest_key", "file_number").rowsBetween(Window.unboundedPreceding, -1)
    return tables.where("level >= 1").withColumn("_end", F.max("largest_key").over(w)).where("_end >= smallest_key").drop("_end")


def files_for_key(tables: DataFrame, key: Column) -> DataFrame:
    """Files that may hold the key, by their range."""
    return tables.where((F.col("smallest_key") <= key) & (key <= F.col("largest_key")))


def first_file_from(tables: DataFrame, level: int, key: Column) -> DataFrame:
    """The first file of a sorted level that can hold the key or one after it: the index seek."""
    return tables.where((F.col("level") == level) & (F.col("largest_key") >= key)).orderBy("smallest_key").limit(1)


def in_read_order(tables: DataFrame) -> DataFrame:
    """Level 0 newest first, then each sorted level by key."""
    return tables.orderBy("level", F.when(F.col("level") == 0, -F.col("file_number")), "smallest_key")


def read_positions(tables: DataFrame) -> DataFrame:
    """The place of each file in read order, within its level."""
    order = [F.when(F.col("level") == 0, -F.col("file_number")), F.col("smallest_key")]
    return tables.withColumn("position", F.row_number().over(Window.partitionBy("level").orderBy(*order)).cast("bigint"))


def order_violations(entries: DataFrame, by: str = "file_number") -> DataFrame:
    """Entries whose key is not above the one before, in the stored order ``position`` of their file."""
    before = F.lag("key").over(Window.partitionBy(by).orderBy("position"))
    return entries.withColumn("_before", before).where("_before >= key").drop("_before")


def metadata_mismatches(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """File numbers on which the manifest and the files disagree (range, entries, size), or that only one of them knows.

    Files are matched by level and number: numbers of two levels may meet. A file on another level than listed counts on both.
    """
    cols = ["smallest_key", "largest_key", "entry_count", "file_size_bytes"]
    f = files.select("level", "file_number", *[F.col(c).alias(f"_{c}") for c in cols])
    same = F.lit(True)
    for c in cols:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return manifest.join(f, ["level", "file_number"], "full_outer").where(~same).select("file_number")


def may_contain(keys: DataFrame, bits: DataFrame, probes: Column) -> DataFrame:
    """The keys whose every probe is among the set ``bits`` (one column): a superset of the keys the filter was built from."""
    each = keys.select("key", F.explode(probes).alias("bit")).distinct()
    return each.join(bits, "bit", "left_semi").groupBy("key").agg(F.count("*").alias("hit")).join(each.groupBy("key").agg(F.count("*").alias("all")), "key").where("hit = all").select("key")


def folded(edits: DataFrame) -> DataFrame:
    """The active file numbers: the last edit of each wins, and an ``add`` keeps it."""
    last = F.row_number().over(Window.partitionBy("file_number").orderBy(F.desc("edit_no")))
    return edits.withColumn("_rank", last).where("_rank = 1 AND op = 'add'").drop("_rank")
