"""The stored engine: durability, flush, compaction, snapshots, conflicts, streaming, random operations against a dictionary."""

import random
import threading
import uuid
from dataclasses import replace

import pytest

from keyloom.model import CommitConflict, Corruption, InvalidArgument, NotFound, Options, ReadOptions
from keyloom.plans.engine import Engine
from keyloom.streaming.ingest import drain

TINY = Options(level0_compaction_trigger=3, level1_compaction_trigger_bytes=1, max_compaction_level=2)


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


def shown(df):
    return [(bytes(r["key"]).decode(), bytes(r["value"]).decode()) for r in df.collect()]


def write(engine, *changes):
    rows = [(k.encode(), 2 if v is None else 1, (v or "").encode(), i) for i, (k, v) in enumerate(changes)]
    engine.apply(engine.spark.createDataFrame(rows, "key binary, type int, value binary, o int"), "o")


def test_put_get_delete_reopen(spark, root):
    e = Engine.open(spark, root)
    write(e, ("alpha", "one"), ("beta", "two"))
    assert shown(e.get("alpha")) == [("alpha", "one")]
    e.delete("alpha")
    again = Engine.open(spark, root)
    assert shown(again.get("alpha")) == [] and shown(again.get("beta")) == [("beta", "two")]
    assert again.version().last_sequence == 3
    with pytest.raises(InvalidArgument):
        again.get("")
    with pytest.raises(InvalidArgument):
        write(again, ("", "x"))
    assert shown(again.scan()) == [("beta", "two")]


def test_open_options(spark, root):
    with pytest.raises(NotFound):
        Engine.open(spark, root, Options(create_if_missing=False))
    Engine.open(spark, root)
    with pytest.raises(InvalidArgument):
        Engine.open(spark, root, Options(error_if_exists=True))


def test_compaction_hides_drops_and_keeps(spark, root):
    e = Engine.open(spark, root, Options(level0_compaction_trigger=3))
    for change in (("alpha", "one"), ("alpha", None), ("beta", "two")):
        write(e, change)
        e.flush(one_file=True)
    before = e.version().number
    assert [s.level for s in e.version().segments] == [0, 0, 0]
    assert e.compact() and not e.compact()
    v = e.version()
    assert [(s.level, s.entry_count) for s in v.segments] == [(1, 1)]
    assert shown(e.scan()) == [("beta", "two")] == shown(e.scan(at=before))  # the old version is a snapshot
    assert [tuple(r)[1:5] for r in e.jobs().collect()] == [(0, 1, 3, 1)]
    assert e.vacuum() > 0 and shown(e.scan()) == [("beta", "two")]
    Engine.open(spark, root).verify()


def test_segments(spark, root):
    e = Engine.open(spark, root)
    write(e, ("b", "1"), ("a", None))
    e.flush(one_file=True)
    assert [bytes(r["key"]) for r in e.entries(1).collect()] == [b"a", b"b"]
    assert [bytes(r["key"]) for r in e.entries(1, only_live=True).collect()] == [b"b"]
    (r,) = e.stored_files().collect()
    assert (r["file_number"], r["files"]) == (1, 1) and r["bytes"] > 0
    with pytest.raises(InvalidArgument):
        e.entries(9)


def test_cascade(spark, root):
    e = Engine.open(spark, root, TINY)
    for k in ("alpha", "bravo", "charlie"):
        write(e, (k, "1"))
        e.flush(one_file=True)
    e.compact_until_quiet()
    assert {s.level for s in e.version().segments} == {2}
    for change in (("alpha", None), ("delta", "2"), ("echo", "3")):
        write(e, change)
        e.flush(one_file=True)
    e.compact_until_quiet()
    assert {s.level for s in e.version().segments} == {2}
    assert [k for k, _ in shown(e.scan())] == ["bravo", "charlie", "delta", "echo"]
    assert shown(e.scan(ReadOptions("c", "e"))) == [("charlie", "1"), ("delta", "2")]


def test_two_writers_cannot_publish_one_version(spark, root):
    a, b = Engine.open(spark, root), Engine.open(spark, root)
    v = a.version()

    a.manifest.publish(replace(v, number=v.number + 1))
    with pytest.raises(CommitConflict):
        b.manifest.publish(replace(v, number=v.number + 1))


def test_of_threads_one_publishes(spark, root):
    engines = [Engine.open(spark, root) for _ in range(6)]
    for _ in range(5):
        v, start, said = engines[0].version(), threading.Barrier(6), []

        def publish(e, k, v=v, start=start, said=said):
            start.wait()
            try:
                e.manifest.publish(replace(v, number=v.number + 1, next_file_number=100 + k))
                said.append(k)
            except CommitConflict:
                pass

        threads = [threading.Thread(target=publish, args=(e, k)) for k, e in enumerate(engines)]
        [t.start() for t in threads]
        [t.join() for t in threads]
        assert len(said) == 1 and engines[0].version().next_file_number == 100 + said[0]


def test_numbers_are_reserved_once(spark, root):
    engines, got = [Engine.open(spark, root) for _ in range(4)], []
    threads = [threading.Thread(target=lambda e=e: got.extend(e._reserved(2) for _ in range(3))) for e in engines]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(got) == list(range(1, 25, 2))


def test_a_store_without_atomic_names_is_refused(spark):
    from keyloom.sources.manifest import Manifest

    spark._jsc.hadoopConfiguration().set("fs.bucket.impl", "org.apache.hadoop.fs.RawLocalFileSystem")
    m = Manifest(spark, "file:///tmp")
    assert m.scheme == "file"
    with pytest.raises(Exception, match="publish|scheme|FileSystem"):
        Manifest(spark, "s3a://bucket/x")


def test_full_buffer_is_flushed_into_one_segment(spark, root):
    e = Engine.open(spark, root, Options(write_buffer_size=60, level0_compaction_trigger=0))
    write(e, ("a", "1"), ("b", "2"))
    assert e.version().log and not e.version().segments
    for i in range(4):
        write(e, ("a", str(i)), ("b", str(i)))  # overwritten keys do not fill the buffer
    assert not e.version().segments and e.memtable_usage() == 28
    write(e, ("c", "3" * 40), ("d", "4"))
    v = e.version()
    assert not v.log and v.log_bytes == 0 and [(s.level, s.file_number, s.entry_count) for s in v.segments] == [(0, 1, 4)]
    e.put("e", "5" * 60)
    assert [s.file_number for s in e.version().segments] == [1, 2]


def test_writes_wait_while_level_0_is_full(spark, root):
    e = Engine.open(spark, root, Options(write_buffer_size=1, level0_compaction_trigger=2, level0_write_stall_trigger=2))
    for i in range(5):
        write(e, (f"k{i}", "v"))
        assert sum(s.level == 0 for s in e.version().segments) <= 2
    assert [k for k, _ in shown(e.scan())] == [f"k{i}" for i in range(5)] and e.version().jobs >= 2


def test_background_compaction(spark, root):
    e = Engine.open(spark, root, Options(write_buffer_size=1, level0_compaction_trigger=2, level0_write_stall_trigger=3), background=True)
    for i in range(6):
        write(e, (f"k{i % 4}", str(i)))
    e.close()  # drains
    assert sum(s.level == 0 for s in e.version().segments) < 2
    assert shown(Engine.open(spark, root).scan()) == [("k0", "4"), ("k1", "5"), ("k2", "2"), ("k3", "3")]


@pytest.mark.parametrize("background", [False, True])
def test_a_stall_that_no_compaction_ends_does_not_hang(spark, root, background):
    e = Engine.open(spark, root, Options(write_buffer_size=1, level0_compaction_trigger=9, level0_write_stall_trigger=1), background=background)
    for k in "abc":
        write(e, (k, "1"))
    e.close()
    assert [k for k, _ in shown(e.scan())] == ["a", "b", "c"]


def test_background_error_sticks(spark, root):
    e = Engine.open(spark, root, Options(write_buffer_size=1, level0_compaction_trigger=1), background=True)

    def fails(*_):
        raise OSError("no space")

    e._merged = fails
    write(e, ("a", "1"))
    e.worker.thread.join(60)
    for _ in range(2):
        with pytest.raises(OSError, match="no space"):
            write(e, ("b", "2"))
    with pytest.raises(OSError, match="no space"):
        e.close()
    assert shown(Engine.open(spark, root).scan()) == [("a", "1")]


def test_compaction_keeps_what_is_flushed_meanwhile(spark, root):
    e = Engine.open(spark, root, Options(write_buffer_size=1, level0_compaction_trigger=2))
    write(e, ("a", "1"), ("b", "1"))
    write(e, ("a", None))
    merged = e._merged

    def beside(*args):
        made = merged(*args)
        write(Engine.open(spark, root, e.options), ("a", "new"))
        return made

    e._merged = beside
    assert e.compact()
    assert sorted((s.level, s.entry_count) for s in e.version().segments) == [(0, 1), (1, 1)]
    assert shown(e.scan()) == [("a", "new"), ("b", "1")]
    numbers = [s.file_number for s in e.version().segments]
    assert len(set(numbers)) == len(numbers)


def test_lost_inputs_refuse_the_compaction(spark, root):
    e = Engine.open(spark, root, Options(write_buffer_size=1, level0_compaction_trigger=2))
    write(e, ("a", "1"))
    write(e, ("b", "1"))
    merged, other = e._merged, Engine.open(spark, root, e.options)

    def beside(*args):
        made = merged(*args)
        other.compact()
        return made

    e._merged = beside
    with pytest.raises(CommitConflict):
        e.compact()
    assert shown(e.scan()) == [("a", "1"), ("b", "1")] and e.jobs().count() == 1


def test_open_finds_changed_files(spark, root):
    import glob
    import os

    e = Engine.open(spark, root)
    write(e, ("a", "1"), ("b", "2"))
    e.flush(one_file=True)
    Engine.open(spark, root).verify()
    (part,) = glob.glob(f"{root[7:]}/segments/*/_dir=1/*.parquet")
    os.remove(part)
    with pytest.raises(Corruption):
        Engine.open(spark, root)


def test_full_verification_compares_sizes(spark, root):
    e = Engine.open(spark, root)
    write(e, ("a", "1"), ("b", "2"))
    e.flush()
    v = e.version()
    wrong = replace(v.segments[0], file_size_bytes=v.segments[0].file_size_bytes + 1)
    e.manifest.publish(replace(v, number=v.number + 1, segments=(wrong,)))
    Engine.open(spark, root)
    with pytest.raises(Corruption):
        e.verify()


def test_vacuum_spares_snapshots(spark, root):
    e = Engine.open(spark, root, Options(level0_compaction_trigger=2))
    for k in "ab":
        write(e, (k, "1"))
        e.flush()
    with e.snapshot() as n:
        write(e, ("a", None))
        e.flush()
        e.compact_until_quiet()
        Engine.open(spark, root).vacuum()
        assert shown(e.scan(at=n)) == [("a", "1"), ("b", "1")]
    e.vacuum()
    assert len(e.manifest.numbers()) == 1 and shown(e.scan()) == [("b", "1")]


def test_equal_order_values_are_numbered_alike(spark, root):
    rows = [(b"k", 1, str(i).encode(), 0) for i in range(20)]
    seen = set()
    for k in range(2):
        e = Engine.open(spark, f"{root}-{k}")
        e.apply(spark.createDataFrame(rows[:: 1 - 2 * k], "key binary, type int, value binary, o int").repartition(3), "o")
        seen.add(tuple(shown(e.scan())))
    assert seen == {(("k", "9"),)}


def test_stream_applies_a_batch_once(spark, root, tmp_path):
    e = Engine.open(spark, root)
    rows = spark.createDataFrame([(b"a", 1, b"1", 0)], "key binary, type int, value binary, o int")
    e.apply(rows, "o", stream="s", batch=0)
    e.apply(rows, "o", stream="s", batch=0)
    assert e.version().last_sequence == 1
    src = str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame([(f"k{i}".encode(), 1, b"v", i), (b"k0", 2, b"", i + 100)], "key binary, type int, value binary, o int").coalesce(1).write.mode("append").parquet(src)
    drain(spark.readStream.schema("key binary, type int, value binary, o int").option("maxFilesPerTrigger", 1).parquet(src), e, "o")
    assert [k for k, _ in shown(e.scan())] == ["a", "k1", "k2"]


def test_random_operations_match_a_dictionary(spark, root):
    rng, e, want = random.Random(7), Engine.open(spark, root, Options(level0_compaction_trigger=2, level1_compaction_trigger_bytes=60, max_compaction_output_file_size=80)), {}
    for _ in range(5):
        changes = [(f"k{rng.randrange(20):02d}", None if rng.random() < 0.3 else str(rng.random())) for _ in range(15)]
        write(e, *changes)
        for k, v in changes:
            want.pop(k, None) if v is None else want.__setitem__(k, v)
        if rng.random() < 0.8:
            e.flush(one_file=True)
        if rng.random() < 0.6:
            e.compact_until_quiet()
        assert shown(e.scan()) == sorted(want.items())


class Faulty:
    """A file system that fails in one of its calls."""

    def __init__(self, fs, call):
        self.fs, self.call = fs, call

    def __getattr__(self, name):
        if name == self.call:
            raise OSError(f"{name} fails")
        return getattr(self.fs, name)


@pytest.mark.parametrize("call", ["create", "mkdirs", "getContentSummary"])
def test_a_failing_store_leaves_the_last_version(spark, root, call):
    e = Engine.open(spark, root, Options(write_buffer_size=1 << 20, level0_compaction_trigger=1))
    write(e, ("a", "1"))
    e.flush()
    before = e.version()
    write(e, ("b", "2"))
    e.manifest.fs = Faulty(e.manifest.fs, call)
    for act in (lambda: write(e, ("c", "3")), e.flush, e.compact):
        try:
            act()
        except OSError as x:
            assert call in str(x)
    again = Engine.open(spark, root)  # whatever was half done is not seen
    again.verify()
    assert again.version().segments == before.segments or call == "getContentSummary"
    assert dict(shown(again.scan()))["a"] == "1" and dict(shown(again.scan()))["b"] == "2"
    write(again, ("d", "4"))
    assert dict(shown(again.scan()))["d"] == "4"
