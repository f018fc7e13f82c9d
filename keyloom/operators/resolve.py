"""Version resolution: the newest version of each key wins, and a delete hides the key.

``row_number() = 1`` over the key is planned with a group limit on both sides of the exchange, so a key with very many
versions sends one row from each map task. Filters on the key move below it; the filter on ``type`` stays above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.model import DELETE, PUT

#: The order of versions in a raw log, and among segments (the memtable is level -1).
BY_SEQUENCE = ("seq",)
BY_FILE = ("level", "file_number")


def _newest(by: tuple[str, ...]) -> list[Column]:
    return [F.desc("seq")] if by == BY_SEQUENCE else [F.asc("level"), F.desc("file_number"), F.desc("seq")]


def winners(versions: DataFrame, by: tuple[str, ...] = BY_SEQUENCE) -> DataFrame:
    """The newest version of every key, deletes included."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy(*_newest(by)))
    return versions.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def live(versions: DataFrame, by: tuple[str, ...] = BY_SEQUENCE) -> DataFrame:
    """The visible view: (key, value)."""
    return winners(versions, by).where(F.col("type") == PUT).select("key", "value")


def tombstones(versions: DataFrame, by: tuple[str, ...] = BY_SEQUENCE) -> DataFrame:
    return winners(versions, by).where(F.col("type") == DELETE)


def shadowed(versions: DataFrame, by: tuple[str, ...] = BY_SEQUENCE) -> DataFrame:
    """Versions that a newer one hides."""
    newest = winners(versions, by).select("key", F.col("seq").alias("_seq"))
    return versions.join(newest, "key").where("seq < _seq").drop("_seq")


def merged(sources: list[DataFrame], by: tuple[str, ...] = BY_FILE) -> DataFrame:
    """The ordered union of sources (memtable, level 0, sorted levels): winners of all of them, by key."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return winners(out, by).orderBy("key")
