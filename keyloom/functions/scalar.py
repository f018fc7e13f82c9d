"""Column functions of the storage layer: checksums, Bloom probes, prefixes, costs. All run inside the JVM.

Constants here are fixed values: the FNV-1a basis and prime, seven probes over ten bits a key, 16 entries between restarts, and the
overheads of an entry in memory (12 bytes) and in a compaction output (16 bytes).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FNV_BASIS, FNV_PRIME, U32 = 2166136261, 16777619, 4294967295
BLOOM_BITS_PER_KEY, BLOOM_PROBES, BLOOM_LEAST_BITS = 10, 7, 64
RESTART_INTERVAL = 16
MEMORY_OVERHEAD, OUTPUT_OVERHEAD = 12, 16


def byte_values(b: Column) -> Column:
    """The bytes of a binary column as an array of BIGINT."""
    one = lambda i: F.conv(F.hex(F.substring(b, i, F.lit(1))), 16, 10).cast("bigint")
    some = F.transform(F.sequence(F.lit(1), F.octet_length(b)), one)
    return F.when(F.octet_length(b) == 0, F.array().cast("array<bigint>")).when(F.octet_length(b) > 0, some)


def fnv1a32(key: Column) -> Column:
    """32-bit FNV-1a of a string or binary column, as BIGINT."""
    step = lambda h, x: (h.bitwiseXOR(x) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(U32))
    return F.aggregate(byte_values(key.cast("binary")), F.lit(FNV_BASIS).cast("bigint"), step)


def bloom_size(keys: Column) -> Column:
    """Bits of a filter over so many keys: ten a key, 64 at least, a whole number of bytes."""
    return F.ceil(F.greatest(F.lit(BLOOM_LEAST_BITS), keys * BLOOM_BITS_PER_KEY) / 8).cast("bigint") * 8


def bloom_probes(hash_: Column, bits: Column) -> Column:
    """The bits that a key sets or tests: double hashing by the hash rotated left by 15."""
    step = F.shiftright(hash_, 17).bitwiseOR(F.shiftleft(hash_, 15).bitwiseAND(F.lit(U32)))
    return F.transform(F.sequence(F.lit(0), F.lit(BLOOM_PROBES - 1)), lambda i: (hash_ + i * step).bitwiseAND(F.lit(U32)) % bits)


def shared_prefix(a: Column, b: Column) -> Column:
    """Length in bytes of the common prefix; 0 where either is null."""
    x, y = a.cast("binary"), b.cast("binary")
    n = F.least(F.octet_length(x), F.octet_length(y))
    same = lambda i: F.substring(x, i, F.lit(1)) == F.substring(y, i, F.lit(1))
    run = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda got, i: F.when((got == i - 1) & same(i), i).otherwise(got))
    return F.coalesce(F.when(n > 0, run), F.lit(0))


def memory_cost(key: Column, value: Column) -> Column:
    return F.octet_length(key) + F.octet_length(value) + MEMORY_OVERHEAD


def output_cost(key: Column, value: Column) -> Column:
    return F.octet_length(key) + F.octet_length(value) + OUTPUT_OVERHEAD


def file_name(file_number: Column) -> Column:
    return F.format_string("%06d.sst", file_number)
