"""Import of binary files: write-ahead logs, manifests and sorted tables, read through ``binaryFile`` and parsed per file.

Fixed values (formats; all integers little-endian):
  log record       u32 payload length, u32 FNV-1a of the payload; payload: u8 type, u64 sequence, u32 key length, u32 value length, key, value
  manifest record  the same header; type 3 add: u64 file, u32 level, u64 entries, u64 bytes, u32 + u32 key lengths, smallest, largest;
                   type 1 add without the level; type 2 delete: u64 file
  table footers    STKV0004: u64 entries, u64 index offset, u64 index length, u32 index checksum, the same three for the filter, magic (56 bytes)
                   STKV0003 and STKV0002: without the filter (36 bytes); STKV0001: one block (28 bytes: u64 entries, u64 block length, u32 checksum, magic)
  block            versions 3 and 4: entries of u32 shared, u32 suffix, u32 value length, u8 type, suffix, value; then u32 restart offsets, u32 their
                   count, u32 checksum; versions 1 and 2: entries of u8 type, u32 key length, u32 value length, key, value
  index entry      u32 key length, last key, u64 offset, u64 size, u64 entries
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from keyloom.functions.scalar import FNV_BASIS, FNV_PRIME, U32
from keyloom.model import DELETE, PUT, Corruption


def checksum(data: bytes) -> int:
    h = FNV_BASIS
    for b in data:
        h = (h ^ b) * FNV_PRIME & U32
    return h


class _Reader:
    """Takes fixed-size fields off a byte string; a short read is corruption."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def left(self) -> int:
        return len(self.data) - self.at

    def take(self, n: int) -> bytes:
        if self.left() < n:
            raise Corruption("a field is cut short")
        self.at += n
        return self.data[self.at - n : self.at]

    def numbers(self, layout: str) -> tuple:
        return struct.unpack("<" + layout, self.take(struct.calcsize("<" + layout)))


def _records(data: bytes, most: int, torn_tail: bool) -> Iterator[bytes]:
    """Checked payloads. A torn tail ends a log quietly; anywhere else it is corruption."""
    r = _Reader(data)
    while r.left():
        if r.left() < 8:
            if torn_tail:
                return
            raise Corruption("a record header is cut short")
        size, want = r.numbers("II")
        if size > most:
            raise Corruption(f"a record of {size} bytes exceeds the limit of {most}")
        if r.left() < size:
            if torn_tail:
                return
            raise Corruption("a record is cut short")
        if checksum(payload := r.take(size)) != want:
            raise Corruption("a record's checksum differs")
        yield payload


def log_changes(data: bytes, most: int = 64 << 20) -> Iterator[dict]:
    for payload in _records(data, most, torn_tail=True):
        r = _Reader(payload)
        kind, seq, n_key, n_value = r.numbers("BQII")
        key, value = r.take(n_key), r.take(n_value)
        if kind not in (PUT, DELETE) or r.left() or not key or (kind == DELETE and value):
            raise Corruption("a log record contradicts itself")
        yield {"key": key, "seq": seq, "type": kind, "value": value}


def manifest_edits(data: bytes, most: int = 64 << 20) -> Iterator[dict]:
    for n, payload in enumerate(_records(data, most, torn_tail=False), 1):
        r = _Reader(payload)
        (kind,) = r.numbers("B")
        edit = {"edit_no": n, "op": "delete" if kind == 2 else "add", "level": 0, "entry_count": 0, "file_size_bytes": 0, "smallest_key": b"", "largest_key": b""}
        (edit["file_number"],) = r.numbers("Q")
        if kind == 3:
            (edit["level"],) = r.numbers("I")
        if kind in (1, 3):
            edit["entry_count"], edit["file_size_bytes"], low, high = r.numbers("QQII")
            edit["smallest_key"], edit["largest_key"] = r.take(low), r.take(high)
        if kind not in (1, 2, 3) or r.left() or not edit["file_number"]:
            raise Corruption("a manifest record contradicts itself")
        yield edit


def _plain(block: bytes) -> Iterator[tuple[bytes, int, bytes]]:
    r = _Reader(block)
    while r.left():
        kind, n_key, n_value = r.numbers("BII")
        yield r.take(n_key), kind, r.take(n_value)


def _compressed(block: bytes) -> Iterator[tuple[bytes, int, bytes]]:
    if len(block) < 8:
        raise Corruption("a block is cut short")
    (restarts,) = struct.unpack("<I", block[-4:])
    end = len(block) - 4 - 4 * restarts
    if end < 0 or not restarts:
        raise Corruption("a block's restarts do not fit")
    starts = set(struct.unpack(f"<{restarts}I", block[end:-4]))
    r, key, seen = _Reader(block[:end]), b"", 0
    while r.left():
        begins = r.at in starts
        shared, suffix, n_value, kind = r.numbers("IIIB")
        if shared > len(key) or (begins and shared):
            raise Corruption("an entry shares more than the key before it has")
        key = key[:shared] + r.take(suffix)
        seen += begins
        yield key, kind, r.take(n_value)
    if seen != len(starts):
        raise Corruption("a restart is not at an entry")


def table_entries(data: bytes) -> Iterator[dict]:
    """Entries of a sorted table of any version, tombstones included, in key order."""
    magic = data[-8:]
    if len(data) < {b"STKV0001": 28, b"STKV0004": 56}.get(magic, 36):
        raise Corruption("the table is shorter than its footer")
    if magic == b"STKV0001":
        entries, size, want = struct.unpack("<QQI", data[-28:-8])
        if checksum(block := data[:size]) != want:
            raise Corruption("the block's checksum differs")
        found = list(_plain(block))
    elif magic in (b"STKV0002", b"STKV0003", b"STKV0004"):
        foot = 56 if magic == b"STKV0004" else 36
        entries, at, size, want = struct.unpack("<QQQI", data[-foot : -foot + 28])
        if checksum(index := data[at : at + size]) != want:
            raise Corruption("the index's checksum differs")
        if foot == 56:
            f_at, f_size, f_want = struct.unpack("<QQI", data[-28:-8])
            if checksum(data[f_at : f_at + f_size]) != f_want:
                raise Corruption("the filter's checksum differs")
        found, r, begin = [], _Reader(index), 0
        while r.left():
            (n,) = r.numbers("I")
            last = r.take(n)
            offset, length, count = r.numbers("QQQ")
            if offset != begin or offset + length > at:
                raise Corruption("blocks do not follow each other")
            begin += length
            raw = data[offset : offset + length]
            if len(raw) < 4 or checksum(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
                raise Corruption("a block's checksum differs")
            own = list((_plain if magic == b"STKV0002" else _compressed)(raw[:-4]))
            if len(own) != count or not own or own[-1][0] != last:
                raise Corruption("a block and its index entry disagree")
            found += own
    else:
        raise Corruption(f"unknown table format {magic!r}")
    keys = [k for k, _, _ in found]
    if len(found) != entries or any(a >= b for a, b in zip(keys, keys[1:], strict=False)) or any(t not in (PUT, DELETE) or not k or (t == DELETE and v) for k, t, v in found):
        raise Corruption("the table's entries contradict its footer or their order")
    return iter({"key": k, "type": t, "value": v} for k, t, v in found)


_PARSERS = {
    "log": (log_changes, "path string, key binary, seq bigint, type int, value binary"),
    "manifest": (manifest_edits, "path string, edit_no bigint, op string, file_number bigint, level int, entry_count bigint, file_size_bytes bigint, smallest_key binary, largest_key binary"),
    "table": (table_entries, "path string, key binary, type int, value binary"),
}


def read_binary(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The rows of all files at ``path``: ``kind`` is ``log``, ``manifest`` or ``table``. One file is parsed by one task."""
    parse, schema = _PARSERS[kind]
    from pyspark.sql.types import StructType

    arrow = {"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64(), "int": pa.int32()}
    target = StructType.fromDDL(schema)
    fields = pa.schema([(f.name, arrow[f.dataType.simpleString()]) for f in target])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                held = []
                for row in parse(data):
                    held.append({"path": name, **row})
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_pylist(held, fields)
                        held = []
                yield pa.RecordBatch.from_pylist(held, fields)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)
