"""Small cases of version resolution, reads, metadata and compaction."""

import pytest
from pyspark.sql import functions as F

from keyloom.functions import scalar
from keyloom.model import ReadOptions, successor
from keyloom.operators import compaction, metadata, read, resolve


def log(spark, *changes):
    rows = [(k, i + 1, 2 if v is None else 1, v or "") for i, (k, v) in enumerate(changes)]
    return spark.createDataFrame(rows, "key string, seq bigint, type int, value string")


def pairs(df):
    return [(r["key"], r["value"]) for r in df.collect()]


def tables(spark, *rows):
    return spark.createDataFrame([(n, level, a, b, 1, size[0] if size else 100) for n, level, a, b, *size in rows], "file_number bigint, level int, smallest_key string, largest_key string, entry_count bigint, file_size_bytes bigint")


def test_deleted_keys_are_hidden_and_newest_wins(spark):
    assert pairs(read.scan(log(spark, ("c", "3"), ("a", "1"), ("b", "2"), ("b", None)))) == [("a", "1"), ("c", "3")]
    versions = log(spark, ("a", "old-a"), ("b", "old-b"), ("a", "new-a"), ("b", None), ("d", "four"))
    assert pairs(read.scan(versions)) == [("a", "new-a"), ("d", "four")]
    assert pairs(read.seek(versions, "b")) == [("d", "four")]
    assert pairs(read.get(versions, "b")) == [] and pairs(read.get(versions, "a")) == [("a", "new-a")]


def test_many_versions(spark):
    versions = log(spark, *[(f"key-{k:02d}", f"version-{v}") for v in range(32) for k in range(8)])
    assert pairs(read.scan(versions)) == [(f"key-{k:02d}", "version-31") for k in range(8)]


@pytest.mark.parametrize("binary", [False, True])
def test_bounds_and_prefix(spark, binary):
    versions = log(spark, *[(k, k) for k in ("aa", "app-1", "app-2", "app-3", "banana", "carrot")], ("app-2", None))
    if binary:
        versions = versions.withColumn("key", F.col("key").cast("binary"))
    keys = lambda o: [bytes(r["key"]).decode() if binary else r["key"] for r in read.scan(versions, o).collect()]
    assert keys(ReadOptions("app-1", "banana")) == ["app-1", "app-3"]
    assert keys(ReadOptions("app-2", prefix="app-")) == ["app-3"]
    assert keys(ReadOptions("app-2", "app-3", "app-")) == []


def test_prefix_of_high_bytes(spark):
    assert successor(b"a\xff\xff") == b"b" and successor(b"\xff") is None and successor(b"") is None
    versions = spark.createDataFrame([(bytearray(k), 1, 1, bytearray(b"")) for k in (b"\xfe", b"\xff", b"\xff\x00", b"a")], "key binary, seq bigint, type int, value binary")
    assert [bytes(r["key"]) for r in read.scan(versions, ReadOptions(prefix=b"\xff")).collect()] == [b"\xff", b"\xff\x00"]
    assert [bytes(r["key"]) for r in read.scan(versions).collect()] == [b"a", b"\xfe", b"\xff", b"\xff\x00"]


def test_batch_gets(spark):
    versions = log(spark, ("a", "1"), ("b", "2"), ("b", None))
    wanted = spark.createDataFrame([("a",), ("b",), ("z",), ("a",)], "key string")
    assert sorted(pairs(read.multi_get(versions, wanted)), key=str) == [("a", "1"), ("b", None), ("z", None)]
    assert sorted(r["key"] for r in read.negative_get(versions, wanted).collect()) == ["b", "z"]


def test_key_filters_reach_the_scan(spark, tmp_path):
    log(spark, *[(f"k{i}", "v") for i in range(50)]).write.parquet(str(tmp_path / "log"))
    plan = read.scan(spark.read.parquet(str(tmp_path / "log")), ReadOptions("k2", prefix="k"))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(key,k2)" in plan and "WindowGroupLimit" in plan


def test_precedence_by_file(spark):
    rows = [("alpha", 1, 1, "one", 0, 1), ("beta", 2, 1, "two", 0, 1), ("alpha", 3, 2, "", 0, 2), ("gamma", 4, 1, "three", 0, 2), ("beta", 0, 1, "deep", 1, 9)]
    e = spark.createDataFrame(rows, "key string, seq bigint, type int, value string, level int, file_number bigint")
    assert sorted(r["key"] for r in compaction.merge(e, True).collect()) == ["beta", "gamma"]
    kept = {r["key"]: (r["type"], r["value"]) for r in compaction.merge(e, False).collect()}
    assert kept == {"alpha": (2, ""), "beta": (1, "two"), "gamma": (1, "three")}


def test_shadowed(spark):
    assert resolve.shadowed(log(spark, ("a", "1"), ("a", "2"), ("b", "1"))).select("key", "seq").collect() == [("a", 1)]


def test_greedy_files(spark):
    e = spark.createDataFrame([(c, n) for c, n in zip("abcde", (15, 15, 16, 40, 5), strict=True)], "key string, cost bigint")
    cut = lambda most: [r["file"] for r in compaction.greedy_files(e, most, cost=F.col("cost")).orderBy("key").collect()]
    assert cut(30) == [0, 0, 1, 2, 3] and cut(0) == [0] * 5
    named = log(spark, ("alpha", "11111"), ("bravo", "22222"), ("charlie", "33333"))
    assert [r["file"] for r in compaction.greedy_files(named, 30).orderBy("key").collect()] == [0, 1, 2]


def test_read_order_selection_and_conflicts(spark):
    t = tables(spark, (1, 0, "b", "z"), (2, 0, "a", "c"), (3, 1, "a", "m"), (4, 1, "n", "z"))
    assert [r["file_number"] for r in metadata.in_read_order(t).collect()] == [2, 1, 3, 4]
    assert {r["level"]: (r["files"], r["bytes"]) for r in metadata.level_summary(t).collect()} == {0: (2, 200), 1: (2, 200)}
    first = compaction.oldest(t, 0, 1)
    assert sorted(r["file_number"] for r in compaction.overlapping(t, 1, compaction.key_range(first)).collect()) == [3, 4]
    assert metadata.sorted_level_conflicts(t).isEmpty()
    assert [r["file_number"] for r in metadata.sorted_level_conflicts(t.unionByName(tables(spark, (5, 1, "m", "q")))).collect()] == [5, 4]
    assert [tuple(r) for r in metadata.overlap_pairs(t).collect()] == [(0, 1, 2)]


def test_scoring(spark):
    t = tables(spark, (40, 1, "a", "b", 150), (41, 2, "c", "d", 2500))
    pick = lambda base, deepest: [r["level"] for r in compaction.picked_level(compaction.level_scores(t, base, 10, deepest)).collect()]
    assert pick(100, 4) == [2] and pick(100, 2) == [1] and pick(0, 4) == []


def test_manifest_fold(spark):
    e = spark.createDataFrame([(1, "add", 1), (2, "add", 2), (3, "delete", 1)], "edit_no bigint, op string, file_number bigint")
    assert [r["file_number"] for r in metadata.folded(e).collect()] == [2]


def test_metadata_mismatches(spark):
    t = tables(spark, (1, 0, "a", "b"), (2, 0, "a", "b"))
    other = tables(spark, (1, 0, "a", "c"), (3, 0, "a", "b"))
    assert sorted(r["file_number"] for r in metadata.metadata_mismatches(t, other).collect()) == [1, 2, 3]


def test_metadata_mismatches_of_equal_numbers(spark):
    listed = tables(spark, (1, 0, "a", "b"), (1, 1, "c", "d"), (2, 0, "a", "b"), (2, 1, "c", "d"))
    files = tables(spark, (1, 0, "a", "b"), (1, 1, "c", "d"), (2, 0, "a", "x"), (2, 1, "c", "x"))
    assert [r["file_number"] for r in metadata.metadata_mismatches(listed, listed).collect()] == []
    assert [r["file_number"] for r in metadata.metadata_mismatches(listed, files).collect()] == [2, 2]


def test_functions(spark):
    df = spark.createDataFrame([("alpine", "alps"), ("a", "a"), ("", "x"), (None, "x")], "a string, b string")
    rows = df.select(scalar.fnv1a32(F.col("a")).alias("h"), scalar.shared_prefix(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r["s"] for r in rows] == [3, 1, 0, 0]
    assert rows[0]["h"] == 2102627806 and rows[2]["h"] == 2166136261 and rows[3]["h"] is None
    n = spark.range(1).select(scalar.bloom_size(F.lit(1)).alias("a"), scalar.bloom_size(F.lit(150)).alias("b"), scalar.bloom_size(F.lit(151)).alias("c")).first()
    assert tuple(n) == (64, 1504, 1512)


def test_nearest_rank(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(10)] + [("b", 5.0), ("b", None)], "g string, v double")
    got = {p: {r["g"]: r["value"] for r in compaction.nearest_rank(df, "v", p, ["g"]).collect()} for p in (0.0, 0.5, 0.95, 1.0)}
    assert [got[p]["a"] for p in (0.0, 0.5, 0.95, 1.0)] == [0.0, 5.0, 9.0, 9.0] and got[0.5]["b"] == 5.0
