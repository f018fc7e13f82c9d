"""Benchmark decontamination with DataFrame operations only.

Every benchmark item is cut into windows of ``width`` consecutive words (an item of fewer words is one window). The windows'
64-bit hashes become a broadcast hash set: a bitmap literal of a bounded size that the scan of the training texts probes at
each word position whose first two words begin some window, which a smaller hash set tells first. Positions that the sets let through
are few; their words are then compared as strings with the windows (the verification), which also names the items. A benchmark with
more windows than ``block`` is taken in blocks, one scan of the training texts each, so what is broadcast never grows with the data.

Defined results: a null or empty text, or one without words, has no hits; an item without words has no window; equal windows
of several items count for each of them; rows that share a doc_id are told apart by their texts, and identical rows each get
the same result; null ids are kept; an empty table on either side gives no hits; extra columns of either table are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import ascii_lower, broadcast_if_small, stored, table

#: Words of the contract: runs of 0-9, a-z (after lower-casing) and characters beyond ASCII.
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 13
#: Windows per scan, and bits per window of the bitmap (so at most 1/32 of foreign positions pass the first test).
BLOCK, BITS = 500_000, 32
#: A verification table of up to so many windows is broadcast (at ``width`` words of some 8 bytes); a larger one is joined by shuffle.
BROADCAST_WINDOWS = 100_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(PATTERN), 0)


def _pair(w: Column, i: Column) -> Column:
    """The hash of the words at places ``i`` and ``i`` + 1, from 0."""
    return F.xxhash64(F.get(w, i), F.get(w, i + 1))


def _windows(bench: DataFrame, width: int) -> DataFrame:
    """(window, m, h, p, items): the distinct windows, their number of words, their hash, that of their first two words, and the items that
    have them (one array: as long as the items that share a window)."""
    w = F.col("_kl_w")
    m = F.least(F.size(w), F.lit(width))
    cut = F.transform(F.sequence(F.lit(1), F.size(w) - m + 1), lambda i: F.struct(F.array_join(F.slice(w, i, m), " ").alias("window"), m.alias("m"), F.xxhash64(F.slice(w, i, m)).alias("h"), _pair(w, i - 1).alias("p")))
    return (
        bench.select(F.col("item_id"), words(F.col("text")).alias("_kl_w"))
        .where(F.size("_kl_w") > 0)
        .select("item_id", F.explode(cut).alias("_kl_x"))
        .groupBy("_kl_x.window", "_kl_x.m", "_kl_x.h", F.col("_kl_x.p").alias("p"))
        .agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    )


def _bitmap(hashes: np.ndarray) -> tuple[np.ndarray, int]:
    """64-bit words of a bitmap with a power of two of them, and the shift that turns a hash into a word's index."""
    log = max(6, int(np.ceil(np.log2(max(1, len(hashes)) * BITS / 64))))
    h = hashes.astype(np.int64).view(np.uint64)
    out = np.zeros(1 << log, np.uint64)
    np.bitwise_or.at(out, (h >> np.uint64(64 - log)).astype(np.int64), np.uint64(1) << (h & np.uint64(63)))
    return out.view(np.int64), 64 - log


def _passes(h: Column, hashes: np.ndarray) -> Column:
    bits, shift = _bitmap(hashes)
    held = F.split(F.lit(",".join(map(str, bits.tolist()))), ",").cast("array<bigint>")  # folded into one literal
    return F.getbit(F.get(held, F.shiftrightunsigned(h, shift).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")) == 1


def _spans(w: Column, near: Column, m: int, hashes: np.ndarray) -> Column:
    """(start, m, window) of the positions that the hash set of windows of ``m`` words lets through; ``near``: where it looks."""
    at = F.filter(near, lambda i: (i + m <= F.size(w)) & _passes(F.xxhash64(F.slice(w, i + 1, m)), hashes))
    return F.transform(at, lambda i: F.struct(i.alias("start"), F.lit(m).alias("m"), F.array_join(F.slice(w, i + 1, m), " ").alias("window")))


def scan(docs: DataFrame, bench: DataFrame, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_words, hits (array of start and length in words), items (sorted array), text hash."""
    windows = stored(_windows(bench.select("item_id", "text"), width), "decontamination-windows")
    shape = windows.groupBy("m").agg(F.countDistinct("h").alias("n")).collect()  # at most ``width`` rows
    lengths, total = sorted(r["m"] for r in shape), sum(r["n"] for r in shape)
    blocks = max(1, -(-total // block))
    key = ["doc_id", "_kl_t"]
    base = docs.select("doc_id", F.xxhash64("text").alias("_kl_t"), words(F.col("text")).alias("_kl_w"))
    out = None
    for b in range(blocks):
        part = windows.where(F.pmod(F.col("h"), F.lit(blocks)) == b) if blocks > 1 else windows
        hashes = lambda m, c: np.array([r[c] for r in part.where(m).select(c).distinct().collect()], np.int64)  # noqa: E731 - at most ``block``
        w, every = F.col("_kl_w"), F.col("_kl_every")
        places = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1)).otherwise(F.array().cast("array<int>"))
        begins = hashes(F.col("m") > 1, "p")
        found = base.withColumn("_kl_every", places).withColumn("_kl_near", F.filter(every, lambda i: _passes(_pair(w, i), begins)))
        spans = [_spans(w, F.col("_kl_near") if m > 1 else every, m, hashes(F.col("m") == m, "h")) for m in lengths]
        passed = F.concat(F.array().cast("array<struct<start:int,m:int,window:string>>"), *spans)
        found = found.select(*key, F.size("_kl_w").cast("long").alias("n_words"), F.lit(b).alias("_kl_b"), passed.alias("_kl_passed"))
        out = found if out is None else out.unionByName(found)
    seen = stored(out, "decontamination-scan")
    known = windows.select("window", "items")
    known = F.broadcast(known) if total <= BROADCAST_WINDOWS else known
    hit = (
        seen.where(F.size("_kl_passed") > 0)
        .select(*key, F.explode("_kl_passed").alias("x"))
        .select(*key, "x.start", "x.m", "x.window")
        .join(known, "window")
        .groupBy(*key)
        .agg(F.sort_array(F.collect_set(F.struct("start", "m"))).alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
        .withColumnsRenamed({k: f"_kl_{k}" for k in key})
    )
    rows = seen.where(F.col("_kl_b") == 0).drop("_kl_passed", "_kl_b")
    both = rows.join(hit, F.col("doc_id").eqNullSafe(F.col("_kl_doc_id")) & (F.col("_kl_t") == F.col("_kl__kl_t")), "left")
    return both.select(
        *key,
        "n_words",
        F.coalesce("hits", F.array().cast("array<struct<start:int,m:int>>")).alias("hits"),
        F.coalesce("items", F.array().cast(both.schema["items"].dataType)).alias("items"),
    )


def covered(hits: Column) -> Column:
    """Words inside any hit; ``hits`` is sorted by start, and equal starts by length."""
    return F.aggregate(
        hits,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["start"] + x["m"] - F.greatest(a["end"], x["start"]))).alias("n"), F.greatest(a["end"], x["start"] + x["m"]).alias("end")),
        lambda a: a["n"],
    )


def judged(scanned: DataFrame, percent: int = 5) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated (at least ``percent`` of the words are hit)."""
    ids = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    return scanned.withColumn("n_hit", covered(F.col("hits"))).select(
        "*",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))).alias("contaminated"),
    )


def _without(text: Column, hits: Column) -> Column:
    """``text`` without the words inside ``hits`` and the separators between two of them."""
    low = ascii_lower(text)
    pieces = F.regexp_extract_all(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), 0)
    first = F.when(F.regexp_like(low, F.lit("^" + PATTERN)), 0).otherwise(1)  # pieces alternate between words and separators
    inside = lambda k: F.exists(hits, lambda x: (x["start"] <= k) & (k < x["start"] + x["m"]))
    keep = lambda k: F.when((k + first) % 2 == 0, ~inside(((k - first) / 2).cast("int"))).otherwise(~(inside(((k - first - 1) / 2).cast("int")) & inside(((k - first + 1) / 2).cast("int"))))
    return F.array_join(F.filter(pieces, lambda _, k: keep(k)), "")


def decontaminate(docs: DataFrame, bench: DataFrame, remove: str = "documents", percent: int = 5, width: int = WIDTH) -> DataFrame:
    """``docs`` without its contaminated documents, or (``remove="spans"``) with the hit words cut out of every text."""
    found = judged(scan(docs, bench, width), percent).select(F.col("doc_id").alias("_kl_id"), "_kl_t", F.col("hits").alias("_kl_hits"), F.col("contaminated").alias("_kl_bad")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_kl_id")) & (F.xxhash64("text") == F.col("_kl_t"))
    if remove == "documents":
        gone = broadcast_if_small(stored(found.where("_kl_bad").select("_kl_id", "_kl_t"), "decontamination-gone"))
        return docs.join(gone, same, "left_anti").select(docs.columns)
    if remove != "spans":
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    cut = F.when(F.size("_kl_hits") > 0, _without(F.col("text"), F.col("_kl_hits"))).otherwise(F.col("text"))
    return docs.join(found.where(F.size("_kl_hits") > 0), same, "left").withColumn("text", cut).select(docs.columns)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


SQL = r"""
WITH up AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a, 'abcdefghijklmnopqrstuvwxyz' AS b),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, up),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, up),
iw AS (SELECT DISTINCT item_id, m, array_to_string(w[p:p + m - 1], ' ') AS k
       FROM (SELECT item_id, w, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, p, m, array_to_string(w[p:p + m - 1], ' ') AS k
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)),
h AS (SELECT DISTINCT doc_id, item_id, p, dw.m FROM dw JOIN iw USING (k)),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM h) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""
