"""Schemas, options and errors of the versioned key-value engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

PUT, DELETE = 1, 2

#: One change: ``seq`` orders changes, the newest of a key wins, a DELETE hides the key.
LOG = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("type", T.IntegerType(), False),
        T.StructField("value", T.BinaryType(), False),
    ]
)
#: One entry of an immutable segment; precedence is by level, then by file number.
SEGMENT = T.StructType([*LOG.fields, T.StructField("level", T.IntegerType(), False), T.StructField("file_number", T.LongType(), False)])
TABLES = T.StructType(
    [
        T.StructField("file_number", T.LongType(), False),
        T.StructField("level", T.IntegerType(), False),
        T.StructField("smallest_key", T.BinaryType(), False),
        T.StructField("largest_key", T.BinaryType(), False),
        T.StructField("entry_count", T.LongType(), False),
        T.StructField("file_size_bytes", T.LongType(), False),
    ]
)
JOBS = T.StructType([T.StructField(n, T.LongType(), False) for n in ("job_id", "input_level", "output_level", "input_files", "output_files", "bytes_read", "bytes_written", "elapsed_ns")])


class KeyloomError(Exception):
    """Base of the engine's errors."""


class InvalidArgument(KeyloomError):
    """A request that can never succeed: an empty key, a table without entries, a file number of zero."""


class Corruption(KeyloomError):
    """Stored data that contradicts itself."""


class CommitConflict(KeyloomError):
    """Another writer published the version first, or an input of a compaction is no longer current."""


class NotFound(KeyloomError):
    """No database at the path."""


@dataclass(frozen=True)
class Options:
    """Defaults that callers of the reference's options rely on."""

    create_if_missing: bool = True
    error_if_exists: bool = False
    write_buffer_size: int = 64 << 20
    level0_compaction_trigger: int = 4
    level0_write_stall_trigger: int = 12
    max_compaction_output_file_size: int = 2 << 20
    level1_compaction_trigger_bytes: int = 16 << 20
    level_compaction_size_multiplier: int = 10
    max_compaction_level: int = 6
    max_record_size: int = 64 << 20
    bloom_filter: bool = True


@dataclass(frozen=True)
class ReadOptions:
    """Bounds of a scan: inclusive lower, exclusive upper, prefix; all that are set apply together."""

    lower_bound: bytes | str | None = None
    upper_bound: bytes | str | None = None
    prefix: bytes | str | None = None


def key_bytes(key: bytes | str) -> bytes:
    raw = key.encode() if isinstance(key, str) else bytes(key)
    if not raw:
        raise InvalidArgument("a key is not empty")
    return raw


def successor(prefix: bytes) -> bytes | None:
    """The smallest byte string above every string that starts with ``prefix``; None if there is none."""
    stem = prefix.rstrip(b"\xff")
    return stem[:-1] + bytes([stem[-1] + 1]) if stem else None
