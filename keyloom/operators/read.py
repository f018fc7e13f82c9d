"""Reads over versions: point, batch, range, prefix and seek. Bounds are plain comparisons on ``key``, so they reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.model import InvalidArgument, ReadOptions, successor
from keyloom.operators.resolve import BY_SEQUENCE, live


def _like(column: Column, df: DataFrame, bound: bytes | str) -> Column:
    """A literal of the key column's own type, so that the comparison needs no cast of the column."""
    text = df.schema["key"].dataType.typeName() == "string"
    raw = bound if isinstance(bound, bytes) else bound.encode()
    return F.lit(raw.decode()) if text else F.lit(bytearray(raw))


def bounded(versions: DataFrame, options: ReadOptions) -> DataFrame:
    """Versions inside all bounds. A prefix becomes a range, which is pushed down for binary keys too."""
    key, out = F.col("key"), versions
    least = [b for b in (options.lower_bound, options.prefix) if b not in (None, "", b"")]
    raw = [b.encode() if isinstance(b, str) else b for b in least]
    if raw:
        out = out.where(key >= _like(key, versions, max(raw)))
    if options.upper_bound is not None:
        out = out.where(key < _like(key, versions, options.upper_bound))
    if options.prefix:
        prefix = options.prefix.encode() if isinstance(options.prefix, str) else options.prefix
        if versions.schema["key"].dataType.typeName() == "string":
            out = out.where(key.startswith(prefix.decode()))
        elif (end := successor(prefix)) is not None:
            out = out.where(key < _like(key, versions, end))
    return out


def scan(versions: DataFrame, options: ReadOptions = ReadOptions(), by: tuple[str, ...] = BY_SEQUENCE) -> DataFrame:
    """Visible (key, value) inside the bounds, in key order."""
    return live(bounded(versions, options), by).orderBy("key")


def get(versions: DataFrame, key: bytes | str, by: tuple[str, ...] = BY_SEQUENCE) -> DataFrame:
    """One row or none; bounds do not apply to point reads."""
    if not key:
        raise InvalidArgument("a key is not empty")
    return live(versions.where(F.col("key") == _like(F.col("key"), versions, key)), by)


def multi_get(versions: DataFrame, keys: DataFrame, by: tuple[str, ...] = BY_SEQUENCE) -> DataFrame:
    """(key, value) of every wanted key, value null where it is absent or deleted.

    The keys cut the versions by a semi join before versions are resolved, so only their versions are shuffled twice.
    """
    wanted = keys.select("key").distinct()
    return wanted.join(live(versions.join(wanted, "key", "left_semi"), by), "key", "left")


def negative_get(versions: DataFrame, keys: DataFrame, by: tuple[str, ...] = BY_SEQUENCE) -> DataFrame:
    """The wanted keys that are not visible."""
    wanted = keys.select("key").distinct()
    return wanted.join(live(versions.join(wanted, "key", "left_semi"), by), "key", "left_anti")


def seek(versions: DataFrame, target: bytes | str, options: ReadOptions = ReadOptions(), by: tuple[str, ...] = BY_SEQUENCE) -> DataFrame:
    """Visible (key, value) from the first key at or after ``target``, inside the bounds, in key order."""
    inside = bounded(versions, options)
    return live(inside.where(F.col("key") >= _like(F.col("key"), versions, target)), by).orderBy("key")
