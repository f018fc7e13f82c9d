"""The stored engine: change log, level-0 flushes, levelled compaction, snapshot reads, all as Parquet under one root.

Writes append a batch to the log and publish a version. A batch that fills the write buffer flushes the log into one level-0 segment:
one file number, whose sorted parts have disjoint key ranges. Compaction merges chosen segments and cuts the output by key ranges, so
sorted levels hold disjoint segments. Every change of state is one manifest version; it is made from the newest version and made again
if another writer published first. File numbers are reserved before their segments are written, so flushes and compactions run side
by side, and a compaction keeps what was flushed meanwhile. Level 0 has to fall below the stall trigger before a write goes on.
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.scalar import memory_cost, output_cost
from keyloom.model import DELETE, JOBS, LOG, PUT, SEGMENT, TABLES, CommitConflict, Corruption, InvalidArgument, NotFound, Options, ReadOptions, key_bytes
from keyloom.operators import compaction, metadata, read, resolve
from keyloom.plans.worker import Worker
from keyloom.sources.manifest import Manifest, Segment, Version

MEMTABLE_LEVEL = -1
#: Publications tried before a writer gives up against others.
ATTEMPTS = 50


class Engine:
    """``background``: compactions run on a thread of their own, writes wait for them only when they stall; else a write that meets a full
    level 0 compacts by itself, and other compactions are the caller's."""

    def __init__(self, spark: SparkSession, path: str, options: Options, manifest: Manifest, background: bool = False):
        self.spark, self.path, self.options, self.manifest = spark, path, options, manifest
        self.worker = Worker(self.compact) if background else None

    # --- opening and closing ---

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: Options = Options(), background: bool = False) -> Engine:
        manifest = Manifest(spark, path)
        there = manifest.exists()
        if there and options.error_if_exists:
            raise InvalidArgument(f"{path} exists")
        if not there and not options.create_if_missing:
            raise NotFound(path)
        engine = cls(spark, path, options, manifest, background)
        if there:
            engine.verify(full=False)
        else:
            manifest.publish(Version(number=1))
        return engine

    def close(self) -> None:
        """Finish the compactions that are due in the background; raises what stopped them."""
        if self.worker:
            self.worker.close()

    def version(self, number: int | None = None) -> Version:
        return self.manifest.load(number)

    def verify(self, full: bool = True) -> None:
        """Hold the manifest against the files: what segments take on disk has to agree, sorted levels have to be disjoint, and with ``full``,
        which reads every entry, key ranges, entry counts and logical sizes too."""
        v = self.version()
        if not v.segments:
            return
        if bad := [s.file_number for s in v.segments if self.manifest.stored_bytes(s.path) != s.stored_bytes][:5]:
            raise Corruption(f"the manifest and the stored files disagree on {bad}")
        listed = self.tables(v)
        if full and (bad := metadata.metadata_mismatches(listed, metadata.table_metadata(self._entries(v))).limit(5).collect()):
            raise Corruption(f"the manifest and the segments disagree on {[r['file_number'] for r in bad]}")
        if bad := metadata.sorted_level_conflicts(listed).limit(5).collect():
            raise Corruption(f"overlapping files in a sorted level: {[r['file_number'] for r in bad]}")

    def _commit(self, change: Callable[[Version], Version]) -> Version:
        """Publish ``change`` of the newest version, again as long as other writers publish first. ``change`` raises what makes it void."""
        for _ in range(ATTEMPTS):
            v = self.version()
            try:
                return self.manifest.publish(replace(change(v), number=v.number + 1))
            except CommitConflict:
                if self.version().number == v.number:  # raised by ``change``
                    raise
        raise CommitConflict(f"no version of this writer was published in {ATTEMPTS} attempts")

    def _reserved(self, files: int) -> int:
        """The first of ``files`` file numbers that nobody else gets."""
        return self._commit(lambda v: replace(v, next_file_number=v.next_file_number + files)).next_file_number - files

    # --- writing ---

    def apply(self, changes: DataFrame, order_by: str, stream: str | None = None, batch: int | None = None) -> None:
        """Append (key, type, value) rows as changes in the order of a column; a stream's batch is applied once, however often it comes.

        Sequence numbers are dense: rows are range-partitioned by the order, and each partition starts after those before it. Rows of equal
        order follow their key, type and value, so that a retry numbers them alike. A full write buffer is flushed; a write waits while
        level 0 is full. One writer at a time: changes that another writer appends meanwhile are a CommitConflict.
        """
        self._wait()
        v = self.version()
        if stream is not None and v.batches.get(stream, -1) >= batch:
            return
        raw = changes.select(F.col("key").cast("binary").alias("key"), F.col("type").cast("int").alias("type"), F.col("value").cast("binary").alias("value"), F.col(order_by).alias("_order"))
        path = f"{self.path}/log/{uuid.uuid4().hex}"
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        raw.orderBy("_order", "key", "type", "value").withColumn("_part", F.spark_partition_id()).withColumn("_place", place).drop("_order").write.parquet(f"{path}/staged")
        staged = self.spark.read.parquet(f"{path}/staged")
        too_large = F.octet_length("key") + F.octet_length("value") > self.options.max_record_size
        bad = F.col("key").isNull() | (F.octet_length("key") == 0) | F.col("value").isNull() | ~F.col("type").isin(PUT, DELETE) | ((F.col("type") == DELETE) & (F.octet_length("value") > 0)) | too_large
        cost = F.sum(memory_cost(F.col("key"), F.col("value"))).alias("cost")
        sizes = staged.groupBy("_part").agg(F.count("*").alias("n"), F.sum(F.when(F.coalesce(bad, F.lit(True)), 1).otherwise(0)).alias("bad"), cost).orderBy("_part").collect()
        if any(r["bad"] for r in sizes):
            self.manifest.remove(path)
            raise InvalidArgument("changes need a non-empty key, a type, a value (empty for a delete), and the size limit")
        starts, total = [], v.last_sequence
        for r in sizes:
            starts.append((r["_part"], total))
            total += r["n"]
        rows = ()
        if total > v.last_sequence:
            begin = self.spark.createDataFrame(starts, "_part int, _start bigint")
            numbered = staged.join(F.broadcast(begin), "_part").select("key", (F.col("_start") + F.col("_place") + 1).alias("seq"), "type", "value")
            numbered.write.parquet(f"{path}/rows")
            rows = (f"{path}/rows",)

        def appended(now: Version) -> Version:
            if now.last_sequence != v.last_sequence or now.batches != v.batches:
                raise CommitConflict("another writer appended changes")
            batches = v.batches | ({stream: batch} if stream is not None else {})
            return replace(now, last_sequence=total, log=(*now.log, *rows), log_bytes=now.log_bytes + sum(r["cost"] for r in sizes), batches=batches)

        v = self._commit(appended)
        self.manifest.remove(f"{path}/staged" if rows else path)
        # Overwritten keys count once in the buffer: the exact size is asked for only when the sum reaches it.
        if rows and v.log_bytes >= self.options.write_buffer_size and self.memtable_usage() >= self.options.write_buffer_size:
            self.flush()

    def _wait(self) -> None:
        """Hold a write until level 0 is below the stall trigger, or no compaction is due that could bring it there."""
        if self.worker:
            self.worker.check()
        turn = self.worker.wait_turn if self.worker else self.compact
        while self.stalled() and turn():
            pass

    def _one(self, key: bytes | str, kind: int, value: bytes | str) -> None:
        raw = value.encode() if isinstance(value, str) else bytes(value)
        row = self.spark.createDataFrame([(bytearray(key_bytes(key)), kind, bytearray(raw), 0)], "key binary, type int, value binary, o int")
        self.apply(row, "o")

    def put(self, key: bytes | str, value: bytes | str) -> None:
        self._one(key, PUT, value)

    def delete(self, key: bytes | str) -> None:
        self._one(key, DELETE, b"")

    # --- relations ---

    def log(self, v: Version | None = None) -> DataFrame:
        """Changes that no segment holds yet."""
        v = v or self.version()
        return self.spark.read.schema(LOG).parquet(*v.log) if v.log else self.spark.createDataFrame([], LOG)

    def _entries(self, v: Version, segments: tuple[Segment, ...] | None = None) -> DataFrame:
        """Entries of segments, tombstones included. Level and number come with the rows, as written."""
        chosen = v.segments if segments is None else segments
        if not chosen:
            return self.spark.createDataFrame([], SEGMENT)
        place = self.spark.createDataFrame([(s.file_number, s.level) for s in chosen], "file_number bigint, level int")
        rows = self.spark.read.schema("key binary, seq bigint, type int, value binary, file_number bigint").parquet(*[s.path for s in chosen])
        return rows.join(F.broadcast(place), "file_number").select(*SEGMENT.names)

    def versions(self, v: Version | None = None, inside: ReadOptions = ReadOptions()) -> DataFrame:
        """All versions that a reader has to resolve: memtable and segments whose key range can meet the bounds."""
        v = v or self.version()
        mem = self.log(v).withColumn("level", F.lit(MEMTABLE_LEVEL)).withColumn("file_number", F.lit(0).cast("bigint"))
        return self._entries(v, tuple(s for s in v.segments if _meets(s, inside))).unionByName(mem)

    def tables(self, v: Version | None = None) -> DataFrame:
        v = v or self.version()
        rows = [(s.file_number, s.level, bytearray.fromhex(s.smallest_key), bytearray.fromhex(s.largest_key), s.entry_count, s.file_size_bytes) for s in v.segments]
        return self.spark.createDataFrame(rows, TABLES)

    def jobs(self, v: Version | None = None) -> DataFrame:
        """Finished compactions, one file each."""
        v = v or self.version()
        return self.spark.read.schema(JOBS).json(f"{self.path}/jobs").where(F.col("job_id") <= v.jobs) if v.jobs else self.spark.createDataFrame([], JOBS)

    def memtable_usage(self) -> int:
        return self.log().transform(resolve.winners).agg(F.sum(memory_cost(F.col("key"), F.col("value"))).alias("n")).first()["n"] or 0

    def entries(self, file_number: int, only_live: bool = False) -> DataFrame:
        """One segment in key order, tombstones included unless ``only_live``."""
        v = self.version()
        chosen = tuple(s for s in v.segments if s.file_number == file_number)
        if not chosen:
            raise InvalidArgument(f"no current file {file_number}")
        rows = self._entries(v, chosen).orderBy("key")
        return rows.where(F.col("type") == PUT) if only_live else rows

    def stored_files(self) -> DataFrame:
        """(file_number, files, bytes): what the segments take on disk, from Spark's file metadata."""
        v = self.version()
        if not v.segments:
            return self.spark.createDataFrame([], "file_number bigint, files bigint, bytes bigint")
        rows = self.spark.read.schema("file_number bigint").parquet(*[s.path for s in v.segments])
        each = rows.select("file_number", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).distinct()
        return each.groupBy("file_number").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))

    # --- reading; ``at`` is a version number, for a snapshot ---

    def scan(self, options: ReadOptions = ReadOptions(), at: int | None = None) -> DataFrame:
        return read.scan(self.versions(self.version(at), options), options, resolve.BY_FILE)

    def get(self, key: bytes | str, at: int | None = None) -> DataFrame:
        raw = key_bytes(key)
        return read.get(self.versions(self.version(at), ReadOptions(raw, raw + b"\0")), raw, resolve.BY_FILE)

    def multi_get(self, keys: DataFrame, at: int | None = None) -> DataFrame:
        return read.multi_get(self.versions(self.version(at)), keys.select(F.col("key").cast("binary").alias("key")), resolve.BY_FILE)

    def seek(self, target: bytes | str, options: ReadOptions = ReadOptions(), at: int | None = None) -> DataFrame:
        return read.seek(self.versions(self.version(at), options), target, options, resolve.BY_FILE)

    # --- flushing and compacting ---

    def _writer(self, rows: DataFrame, path: str):
        writer = rows.write.partitionBy("_dir")
        if self.options.bloom_filter:
            writer = writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        return writer.parquet(path)

    def _stats(self) -> list:
        size = F.sum(output_cost(F.col("key"), F.col("value"))).cast("bigint")
        return [F.hex(F.min("key")).alias("low"), F.hex(F.max("key")).alias("high"), F.count("*").alias("n"), size.alias("size")]

    def _segment(self, number: int, level: int, path: str, r: dict) -> Segment:
        at = f"{path}/_dir={number}"
        return Segment(number, level, at, r["low"], r["high"], r["n"], r["size"], self.manifest.stored_bytes(at))

    def flush(self, one_file: bool = False) -> None:
        """Resolve the unflushed log into one level-0 segment and forget it; changes appended meanwhile stay. ``one_file``: in one part.

        The segment's statistics are observed while it is written, so nothing is read again.
        """
        if not self.version().log:
            return
        number = self._reserved(1)
        v = self.version()
        entries = resolve.winners(self.log(v)).select("key", "seq", "type", "value")
        parts = 1 if one_file else max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        cut = entries.coalesce(1) if one_file else entries.repartitionByRange(parts, "key")
        path, seen = f"{self.path}/segments/{uuid.uuid4().hex}", Observation()
        made = cut.sortWithinPartitions("key").observe(seen, *self._stats())
        self._writer(made.withColumn("file_number", F.lit(number).cast("bigint")).withColumn("_dir", F.lit(number).cast("bigint")), path)
        segment = self._segment(number, 0, path, seen.get)

        def installed(now: Version) -> Version:
            if now.log[: len(v.log)] != v.log:
                raise CommitConflict("another writer flushed the log")
            return replace(now, log=now.log[len(v.log) :], log_bytes=now.log_bytes - v.log_bytes, segments=(*now.segments, segment))

        self._commit(installed)
        if self.worker:
            self.worker.schedule()

    def _merged(self, entries: DataFrame, level: int, files: int) -> tuple[Segment, ...]:
        """Write entries as up to ``files`` sorted segments with disjoint key ranges and numbers of their own."""
        first = self._reserved(files)
        path = f"{self.path}/segments/{uuid.uuid4().hex}"
        cut = entries.select("key", "seq", "type", "value").repartitionByRange(files, "key").sortWithinPartitions("key")
        self._writer(cut.withColumn("file_number", F.spark_partition_id().cast("bigint") + first).withColumn("_dir", F.col("file_number")), path)
        rows = self.spark.read.schema("key binary, value binary, file_number bigint").parquet(path)
        made = rows.groupBy("file_number").agg(*self._stats()).orderBy("file_number").collect()
        return tuple(self._segment(r["file_number"], level, path, r.asDict()) for r in made)

    def _choice(self, v: Version) -> tuple[list[Segment], int] | None:
        """The inputs of the next compaction and its output level; level 0 and sorted levels take turns when both are due."""
        o = self.options
        level0 = sorted((s for s in v.segments if s.level == 0), key=lambda s: s.file_number)
        due0 = 0 < o.level0_compaction_trigger <= len(level0)
        picked = compaction.picked_level(compaction.level_scores(self.tables(v), o.level1_compaction_trigger_bytes, o.level_compaction_size_multiplier, o.max_compaction_level)).first() if v.segments else None
        if picked is not None and (v.prefer_sorted or not due0):
            level = picked["level"]
            own = [min((s for s in v.segments if s.level == level), key=lambda s: s.file_number)]
        elif due0:
            level, own = 0, level0[: o.level0_compaction_trigger]
        else:
            return None
        low, high = min(s.smallest_key for s in own), max(s.largest_key for s in own)
        for s in sorted((s for s in v.segments if s.level == level + 1), key=lambda s: s.smallest_key):
            if s.smallest_key <= high and low <= s.largest_key:
                own.append(s)
                low, high = min(low, s.smallest_key), max(high, s.largest_key)
        return own, level + 1

    def compact(self) -> bool:
        """One compaction, if one is due. What others flush meanwhile stays; that an input is gone meanwhile is a CommitConflict."""
        v = self.version()
        choice = self._choice(v)
        if choice is None:
            return False
        began = time.perf_counter_ns()
        inputs, level = choice
        low, high = min(s.smallest_key for s in inputs), max(s.largest_key for s in inputs)
        deeper = any(s.level > level and s.smallest_key <= high and low <= s.largest_key for s in v.segments)
        older = level == 1 and any(s.level == 0 and s not in inputs and s.file_number < max(i.file_number for i in inputs if i.level == 0) for s in v.segments)
        entries = compaction.merge(self._entries(v, tuple(inputs)), drop_deletes=not (deeper or older))
        size = sum(s.file_size_bytes for s in inputs)
        files = max(1, -(-size // self.options.max_compaction_output_file_size)) if self.options.max_compaction_output_file_size else 1
        made = self._merged(entries, level, files)
        gone = {s.file_number for s in inputs}
        written, source = [], min(s.level for s in inputs)

        def installed(now: Version) -> Version:
            if len([s for s in now.segments if s in inputs]) != len(inputs):
                raise CommitConflict("an input of the compaction is no longer current")
            job = dict(zip(JOBS.names, (now.jobs + 1, source, level, len(inputs), len(made), size, sum(s.file_size_bytes for s in made), time.perf_counter_ns() - began), strict=True))
            written.append(f"{self.path}/jobs/{uuid.uuid4().hex}.json")
            self.manifest.write(self.manifest.jvm.org.apache.hadoop.fs.Path(written[-1]), json.dumps(job))
            return replace(now, segments=(*[s for s in now.segments if s.file_number not in gone], *made), jobs=now.jobs + 1, prefer_sorted=source == 0)

        try:
            self._commit(installed)
        except CommitConflict:
            for path in written:
                self.manifest.remove(path)
            raise
        for path in written[:-1]:  # of attempts that came too late
            self.manifest.remove(path)
        return True

    def compact_until_quiet(self) -> int:
        done = 0
        while self.compact():
            done += 1
        return done

    def stalled(self) -> bool:
        """Whether a writer should wait for compaction before it goes on."""
        o = self.options
        return bool(o.level0_write_stall_trigger and o.level0_compaction_trigger) and sum(s.level == 0 for s in self.version().segments) >= o.level0_write_stall_trigger

    @contextlib.contextmanager
    def snapshot(self) -> Iterator[int]:
        """The number of the newest version, for ``at``; inside, no process's ``vacuum`` deletes what the version refers to."""
        pin, number = f"{self.path}/_pins/{uuid.uuid4().hex}", None
        while number is None:
            number = self.version().number
            self.manifest.write(self.manifest.jvm.org.apache.hadoop.fs.Path(f"{pin}-{number}"), "")
            if number not in self.manifest.numbers():  # vacuumed before it was pinned
                self.manifest.remove(f"{pin}-{number}")
                number = None
        try:
            yield number
        finally:
            self.manifest.remove(f"{pin}-{number}")

    def vacuum(self, keep_versions: int = 1) -> int:
        """Delete versions but the newest and those that a :meth:`snapshot` holds, and segments and log batches that no kept version refers to.

        A reader outside a snapshot is on its own: its files go with its version.
        """
        held = set(self.manifest.pinned(f"{self.path}/_pins"))
        numbers = self.manifest.numbers()
        kept = {n: self.version(n) for n in numbers if n in held or n in numbers[-keep_versions:]}
        needed = {s.path for v in kept.values() for s in v.segments} | {p for v in kept.values() for p in v.log}
        gone = 0
        for n in (n for n in numbers if n not in kept):
            old = self.version(n)
            for p in {s.path for s in old.segments} | set(old.log):
                if p not in needed:
                    self.manifest.remove(p)
                    needed.add(p)
                    gone += 1
            self.manifest.remove(f"{self.path}/_manifest/v{n:012d}.json")
        return gone


def _meets(s: Segment, o: ReadOptions) -> bool:
    low, high = bytes.fromhex(s.smallest_key), bytes.fromhex(s.largest_key)
    raw = lambda b: b.encode() if isinstance(b, str) else b
    if o.lower_bound is not None and high < raw(o.lower_bound) or o.upper_bound is not None and low >= raw(o.upper_bound):
        return False
    prefix = raw(o.prefix) if o.prefix else b""
    return not prefix or (high >= prefix and low[: len(prefix)] <= prefix)


def scratch(spark: SparkSession, options: Options = Options(level0_compaction_trigger=4)) -> Engine:
    """An engine of its own under the shared folder that the session names (in local mode, if it names none, under the SQL warehouse)."""
    have = spark.sparkContext._jsc.sc().getCheckpointDir()
    root = have.get() if have.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise InvalidArgument("set spark.checkpoint.dir to a folder that all executors share")
    root = root or spark.conf.get("spark.sql.warehouse.dir")
    return Engine.open(spark, f"{root.rstrip('/')}/keyloom-{uuid.uuid4().hex}", options)
