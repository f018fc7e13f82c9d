"""Compaction: which files, what they merge to, and how the output is cut."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.scalar import output_cost
from keyloom.model import PUT
from keyloom.operators.metadata import overlaps
from keyloom.operators.resolve import BY_FILE, winners

U64_MAX = (1 << 64) - 1


def level_target(level: int, base: int, multiplier: int) -> int:
    """Bytes a level may hold: ``base`` at level 1, growing by the multiplier (2 at least), saturating."""
    return min(U64_MAX, base * max(2, multiplier) ** (level - 1))


def level_scores(tables: DataFrame, base: int, multiplier: int, max_level: int) -> DataFrame:
    """(level, bytes, score) of the levels 1 to ``max_level`` - 1 that hold files; a ``base`` of 0 switches scoring off."""
    if not base or max_level < 2:
        return tables.select("level").limit(0).select("level", F.lit(0).cast("bigint").alias("bytes"), F.lit(0.0).alias("score"))
    target = F.element_at(F.array(*[F.lit(float(level_target(n, base, multiplier))) for n in range(1, max_level)]), F.col("level"))
    held = tables.where((F.col("level") >= 1) & (F.col("level") < max_level)).groupBy("level").agg(F.sum("file_size_bytes").alias("bytes"))
    return held.select("level", "bytes", (F.col("bytes") / target).alias("score"))


def picked_level(scores: DataFrame) -> DataFrame:
    """The level of the highest score above 1; the lower level of equal ones."""
    return scores.where("score > 1").orderBy(F.desc("score"), "level").limit(1)


def oldest(tables: DataFrame, level: int, n: int) -> DataFrame:
    return tables.where(F.col("level") == level).orderBy("file_number").limit(n)


def key_range(tables: DataFrame) -> DataFrame:
    return tables.agg(F.min("smallest_key").alias("low"), F.max("largest_key").alias("high"))


def overlapping(tables: DataFrame, level: int, rng: DataFrame) -> DataFrame:
    """Files of a level whose range meets the one-row ``rng``; one row is broadcast."""
    meet = overlaps(F.col("smallest_key"), F.col("largest_key"), F.col("low"), F.col("high"))
    return tables.where(F.col("level") == level).join(F.broadcast(rng), meet, "left_semi")


def deeper_overlap(tables: DataFrame, level: int, rng: DataFrame) -> DataFrame:
    """Files below ``level`` that meet the range: while there is one, deletes have to stay."""
    meet = overlaps(F.col("smallest_key"), F.col("largest_key"), F.col("low"), F.col("high"))
    return tables.where(F.col("level") > level).join(F.broadcast(rng), meet, "left_semi")


def merge(entries: DataFrame, drop_deletes: bool, by: tuple[str, ...] = BY_FILE) -> DataFrame:
    """Winners of the chosen files; with ``drop_deletes`` only the puts among them."""
    out = winners(entries, by)
    return out.where(F.col("type") == PUT) if drop_deletes else out


def greedy_files(entries: DataFrame, most_bytes: int, first: int = 0, cost: Column | None = None) -> DataFrame:
    """(key, file): consecutive keys share a file until the next one would exceed ``most_bytes`` (0: one file).

    Where a file ends depends on all files before it, so one task folds the keys in order. It sees keys and costs only, as a
    stream with constant memory; a compaction job's inputs bound it. Engine outputs are cut by range partitions instead.
    """
    sized = entries.select("key", (cost if cost is not None else output_cost(F.col("key"), F.col("value"))).cast("bigint").alias("cost"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = 0, first
        for b in batches:
            out = []
            for c in b.column("cost").to_pylist():
                if most_bytes and held and held + c > most_bytes:
                    held, number = 0, number + 1
                held += c
                out.append(number)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(out, pa.int64())], ["key", "file"])

    kind = entries.schema["key"].dataType.simpleString()
    return sized.repartition(1).sortWithinPartitions("key").mapInArrow(run, f"key {kind}, file bigint")


def blocks(entries: DataFrame, target_bytes: int, cost: Column | None = None) -> DataFrame:
    """(key, file): a block is closed by the entry that brings it to ``target_bytes``; the next entry opens another.

    The same ordered fold as :func:`greedy_files`, but over the entries of one file.
    """
    sized = entries.select("key", (cost if cost is not None else output_cost(F.col("key"), F.col("value"))).cast("bigint").alias("cost"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = 0, 0
        for b in batches:
            out = []
            for c in b.column("cost").to_pylist():
                if held >= target_bytes:
                    held, number = 0, number + 1
                held += c
                out.append(number)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(out, pa.int64())], ["key", "block"])

    kind = entries.schema["key"].dataType.simpleString()
    return sized.repartition(1).sortWithinPartitions("key").mapInArrow(run, f"key {kind}, block bigint")


def input_order(tables: DataFrame, source_level: int) -> DataFrame:
    """The inputs of a compaction by rising precedence: the destination's files by key, then the source's from old to new."""
    from pyspark.sql import Window

    by = [F.desc("level"), F.when(F.col("level") > source_level, F.col("smallest_key")), "file_number"]
    return tables.withColumn("precedence", F.row_number().over(Window.orderBy(*by)).cast("bigint"))  # a compaction's inputs: a few rows


def job_totals(jobs: DataFrame) -> DataFrame:
    """Totals of all compaction jobs."""
    return jobs.agg(F.count("*").alias("jobs"), *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("input_files", "output_files", "bytes_read", "bytes_written")])


def jobs_by_level(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("input_level", "output_level").agg(F.count("*").alias("jobs"), *[F.sum(c).cast("bigint").alias(c) for c in ("input_files", "output_files", "bytes_read", "bytes_written")])


def write_amplification(written: Column, logical: Column) -> Column:
    """Bytes that compactions wrote for each logical byte; 0 without logical bytes."""
    return F.coalesce(written / F.when(logical > 0, logical), F.lit(0.0))


def nearest_rank(df: DataFrame, value: str, p: float, by: list[str]) -> DataFrame:
    """The value at place min(n - 1, floor(p n)) of each group's ascending values, without gathering a group in one array.

    Distinct values are counted first, so equal values collapse before the window orders what is left of a group.
    """
    from pyspark.sql import Window

    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    run = counts.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*by).orderBy(value))).withColumn("_n", F.sum("_c").over(Window.partitionBy(*by)))
    place = F.least(F.col("_n") - 1, F.floor(F.lit(p) * F.col("_n")))
    return run.where((F.col("_upto") > place) & (F.col("_upto") - F.col("_c") <= place)).select(*by, F.col(value).alias("value"))
