"""Registered queries of the key-value engine and their DuckDB equivalents.

Mapping: ``events`` is the change log (``sources.changes``); its level-0 files hold 1,000 changes each; files 1 to 4 have been
compacted into level-1 files of at most 400 bytes (numbers from 1,001), so that every metadata relation is populated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions import scalar
from keyloom.model import Options, ReadOptions
from keyloom.operators import compaction, metadata, read, resolve
from keyloom.sources import changes

COMPACTED, SPLIT_BYTES, L1_FIRST = 4, 400, 1001
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Common table expressions that the SQL of the queries is built on.
LOG = """log AS (SELECT printf('user-%08d', user_id) AS key, event_id AS seq, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS type,
    CASE WHEN event_type = 'error' THEN '' ELSE props END AS value FROM events),
winners AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1),
l0 AS (SELECT *, 0 AS level, (seq // 1000 + 1)::BIGINT AS file_number FROM log
       QUALIFY row_number() OVER (PARTITION BY seq // 1000, key ORDER BY seq DESC) = 1)"""
SPLIT = """kept AS (SELECT * FROM l0 WHERE file_number <= 4 QUALIFY row_number() OVER (PARTITION BY key ORDER BY file_number DESC) = 1),
puts AS (SELECT key, strlen(key) + strlen(value) + 16 AS cost, row_number() OVER (ORDER BY key) AS i, seq, type, value FROM kept WHERE type = 1),
cut(i, held, file) AS (SELECT i, cost, 0 FROM puts WHERE i = 1 UNION ALL
    SELECT p.i, CASE WHEN c.held + p.cost > 400 THEN p.cost ELSE c.held + p.cost END, CASE WHEN c.held + p.cost > 400 THEN c.file + 1 ELSE c.file END
    FROM cut c JOIN puts p ON p.i = c.i + 1),
l1 AS (SELECT key, seq, type, value, 1 AS level, (1001 + file)::BIGINT AS file_number FROM puts JOIN cut USING (i)),
entries AS (SELECT key, seq, type, value, level, file_number FROM l0 WHERE file_number > 4 UNION ALL SELECT * FROM l1),
tables AS (SELECT level, file_number, min(key) AS smallest_key, max(key) AS largest_key, count(*)::BIGINT AS entry_count,
    sum(strlen(key) + strlen(value) + 16)::BIGINT AS file_size_bytes FROM entries GROUP BY level, file_number)"""
FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, strlen(key) + 1), lambda i: ascii(substr(key, i, 1))::BIGINT)), lambda h, x: (xor(h, x) * 16777619) & 4294967295)"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.from_events(spark, sf_dir)


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level-1 entries that the first files were compacted to."""
    merged = compaction.merge(changes.level0(_log(spark, sf_dir)).where(F.col("file_number") <= COMPACTED), drop_deletes=True)
    files = compaction.greedy_files(merged, SPLIT_BYTES, L1_FIRST)
    return merged.drop("level", "file_number").join(files.withColumnRenamed("file", "file_number"), "key").withColumn("level", F.lit(1))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.level0(_log(spark, sf_dir)).where(F.col("file_number") > COMPACTED).unionByName(_split(spark, sf_dir))


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.table_metadata(_entries(spark, sf_dir))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.format_string("user-%08d", "c_custkey").alias("key"))


def query(sql: str | None, *ctes: str):
    """Register a query under its function's name; ``sql`` may build on the common table expressions."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (f"WITH RECURSIVE {', '.join(ctes)} " if ctes else "") + sql
        return f

    return add


# --- reads --------------------------------------------------------------------------------------------------------


@query("SELECT key, value FROM winners WHERE type = 1", LOG)
def scan_full(spark, sf_dir):
    return read.scan(_log(spark, sf_dir))


@query("SELECT key, value FROM winners WHERE type = 1 AND key >= 'user-00000030' AND key < 'user-00000060'", LOG)
def scan_range(spark, sf_dir):
    return read.scan(_log(spark, sf_dir), ReadOptions("user-00000030", "user-00000060"))


@query("SELECT key, value FROM winners WHERE type = 1 AND starts_with(key, 'user-0000001')", LOG)
def scan_prefix(spark, sf_dir):
    return read.scan(_log(spark, sf_dir), ReadOptions(prefix="user-0000001"))


@query("SELECT key, value FROM winners WHERE type = 1 AND starts_with(key, 'user-0000001') AND key >= 'user-00000015' AND key < 'user-00000018'", LOG)
def scan_intersect(spark, sf_dir):
    return read.scan(_log(spark, sf_dir), ReadOptions("user-00000015", "user-00000018", "user-0000001"))


@query("SELECT key, value FROM winners WHERE type = 1 AND key >= 'user-00000031x' ORDER BY key LIMIT 1", LOG)
def seek_first(spark, sf_dir):
    return read.seek(_log(spark, sf_dir), "user-00000031x").limit(1)


@query("SELECT key, value FROM winners WHERE type = 1 AND key = 'user-00000007'", LOG)
def get_point(spark, sf_dir):
    return read.get(_log(spark, sf_dir), "user-00000007")


@query("SELECT c.key, w.value FROM (SELECT DISTINCT printf('user-%08d', c_custkey) AS key FROM customer) c LEFT JOIN (SELECT * FROM winners WHERE type = 1) w USING (key)", LOG)
def multi_get(spark, sf_dir):
    return read.multi_get(_log(spark, sf_dir), _customers(spark, sf_dir))


@query("SELECT c.key FROM (SELECT DISTINCT printf('user-%08d', c_custkey) AS key FROM customer) c WHERE c.key NOT IN (SELECT key FROM winners WHERE type = 1)", LOG)
def negative_get(spark, sf_dir):
    return read.negative_get(_log(spark, sf_dir), _customers(spark, sf_dir))


@query("SELECT key, seq FROM winners WHERE type = 2", LOG)
def tombstones(spark, sf_dir):
    return resolve.tombstones(_log(spark, sf_dir)).select("key", "seq")


@query("SELECT key, seq, type, value FROM winners", LOG)
def memtable_entries(spark, sf_dir):
    return changes.memtable(_log(spark, sf_dir))


@query("SELECT key, seq, type, value FROM l0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY file_number DESC) = 1", LOG)
def merge_files(spark, sf_dir):
    """The k-way merge of all files, by level and file number instead of by sequence."""
    return resolve.merged([changes.level0(_log(spark, sf_dir))]).select("key", "seq", "type", "value")


@query(
    "SELECT printf('cust-%08d/%010d', o_custkey, o_orderkey) AS key, o_orderpriority AS value FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderkey ORDER BY o_orderkey DESC) = 1) WHERE o_orderstatus <> 'P'"
)
def scan_orders(spark, sf_dir):
    return read.scan(changes.from_orders(spark, sf_dir))


@query("SELECT type, count(*)::BIGINT AS versions FROM log JOIN (SELECT key, max(seq) AS newest FROM log GROUP BY key) USING (key) WHERE seq < newest GROUP BY type", LOG)
def shadowed_versions(spark, sf_dir):
    return resolve.shadowed(_log(spark, sf_dir)).groupBy("type").agg(F.count("*").alias("versions"))


@query("SELECT max(seq)::BIGINT AS last_sequence, max(seq // 1000 + 2)::BIGINT AS next_file_number FROM log", LOG)
def recovered_state(spark, sf_dir):
    log = _log(spark, sf_dir)
    return log.agg(F.max("seq").alias("last_sequence"), (F.max(F.floor(F.col("seq") / 1000)) + 2).cast("bigint").alias("next_file_number"))


# --- functions ----------------------------------------------------------------------------------------------------


@query(f"SELECT key, {FNV} AS hash FROM winners", LOG)
def fnv1a(spark, sf_dir):
    return changes.memtable(_log(spark, sf_dir)).select("key", scalar.fnv1a32(F.col("key")).alias("hash"))


@query(
    """SELECT key, coalesce(list_reduce(list_prepend(0::BIGINT, range(1, least(strlen(key), strlen(before)) + 1)), lambda a, i: CASE WHEN a = i - 1 AND substr(key, i, 1) = substr(before, i, 1) THEN i ELSE a END), 0)::INTEGER AS shared
    FROM (SELECT key, lag(key) OVER (ORDER BY key) AS before FROM winners)""",
    LOG,
)
def shared_prefix_len(spark, sf_dir):
    """Length of the prefix that each key shares with the key before it, inside ranges of the first five digits."""
    return _with_previous(changes.memtable(_log(spark, sf_dir))).select("key", scalar.shared_prefix(F.col("before"), F.col("key")).alias("shared"))


def _with_previous(entries: DataFrame) -> DataFrame:
    """Each key with the one before it, over all keys, without one global window: a window inside ranges of keys, and the last key of
    the nearest earlier range for the first key of a range."""
    from pyspark.sql import Window

    ranged = entries.select("key", F.substring("key", 1, 10).alias("range"))
    own = ranged.withColumn("before", F.lag("key").over(Window.partitionBy("range").orderBy("key")))
    last = ranged.groupBy("range").agg(F.max("key").alias("last"))
    follows = last.select(F.lead("range").over(Window.orderBy("range")).alias("range"), "last").where("range IS NOT NULL")  # one row for each range
    return own.join(follows, "range", "left").select("key", F.coalesce("before", "last").alias("before"))


@query("SELECT file_number, key, (row_number() OVER (PARTITION BY file_number ORDER BY key) - 1) % 16 = 0 AS restart FROM l0", LOG)
def restart_flags(spark, sf_dir):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("file_number").orderBy("key")) - 1
    return changes.level0(_log(spark, sf_dir)).select("file_number", "key", (place % scalar.RESTART_INTERVAL == 0).alias("restart"))


@query(
    """SELECT file_number, key, shared, substr(key, shared + 1) AS suffix FROM (SELECT file_number, key, CASE WHEN place % 16 = 0 THEN 0 ELSE
        coalesce(list_reduce(list_prepend(0::BIGINT, range(1, least(strlen(key), strlen(before)) + 1)), lambda a, i: CASE WHEN a = i - 1 AND substr(key, i, 1) = substr(before, i, 1) THEN i ELSE a END), 0) END::INTEGER AS shared
    FROM (SELECT file_number, key, lag(key) OVER (PARTITION BY file_number ORDER BY key) AS before, row_number() OVER (PARTITION BY file_number ORDER BY key) - 1 AS place FROM l0))""",
    LOG,
)
def prefix_encoding(spark, sf_dir):
    """Every entry's key as the prefix it shares with the key before it and its suffix; a restart entry is whole."""
    from pyspark.sql import Window

    own = Window.partitionBy("file_number").orderBy("key")
    placed = changes.level0(_log(spark, sf_dir)).select("file_number", "key", F.lag("key").over(own).alias("before"), ((F.row_number().over(own) - 1) % scalar.RESTART_INTERVAL == 0).alias("restart"))
    shared = F.when(F.col("restart"), 0).otherwise(scalar.shared_prefix(F.col("before"), F.col("key"))).cast("int")
    return placed.select("file_number", "key", shared.alias("shared")).withColumn("suffix", F.substring("key", F.col("shared") + 1, F.length("key")))


@query(
    f"""SELECT DISTINCT (((h + i * (((h >> 17) | ((h << 15) & 4294967295)))) & 4294967295) % m)::BIGINT AS bit
    FROM (SELECT {FNV} AS h FROM winners), (SELECT greatest(64, 10 * count(*))::BIGINT AS n, ((greatest(64, 10 * count(*)) + 7) // 8 * 8)::BIGINT AS m FROM winners), (SELECT unnest(range(0, 7)) AS i)""",
    LOG,
)
def bloom_bits(spark, sf_dir):
    """The set bits of the filter over all live and deleted keys; the size is a one-row relation."""
    keys = changes.memtable(_log(spark, sf_dir)).select("key")
    size = keys.agg(scalar.bloom_size(F.count("*")).alias("bits"))
    probes = keys.select(scalar.fnv1a32(F.col("key")).alias("h")).join(F.broadcast(size)).select(F.explode(scalar.bloom_probes(F.col("h"), F.col("bits"))).alias("bit"))
    return probes.distinct()


BITS = f"""sized AS (SELECT ((greatest(64, 10 * count(*)) + 7) // 8 * 8)::BIGINT AS m FROM winners WHERE type = 1),
probe AS (SELECT key, type, ((h + i * ((h >> 17) | ((h << 15) & 4294967295))) & 4294967295) % m AS bit
    FROM (SELECT key, 1 AS type, {FNV} AS h FROM winners WHERE type = 1 UNION ALL SELECT key, 0, {FNV} FROM (SELECT DISTINCT printf('user-%08d', c_custkey) AS key FROM customer)), sized, (SELECT unnest(range(0, 7)) AS i))"""


@query("SELECT key FROM probe WHERE type = 0 GROUP BY key HAVING bool_and(bit IN (SELECT bit FROM probe WHERE type = 1))", LOG, BITS)
def bloom_membership(spark, sf_dir):
    """Customers' keys that a filter over the live keys lets through."""
    live = resolve.live(_log(spark, sf_dir)).select("key")
    size = live.agg(scalar.bloom_size(F.count("*")).alias("m"))
    probes = scalar.bloom_probes(scalar.fnv1a32(F.col("key")), F.col("m"))
    bits = live.join(F.broadcast(size)).select(F.explode(probes).alias("bit")).distinct()
    wanted = _customers(spark, sf_dir).distinct().join(F.broadcast(size))
    return metadata.may_contain(wanted, bits, probes)


@query("SELECT key, (strlen(key) + strlen(value) + 12)::INTEGER AS memory_bytes, (strlen(key) + strlen(value) + 16)::INTEGER AS output_bytes FROM winners", LOG)
def entry_cost(spark, sf_dir):
    e = changes.memtable(_log(spark, sf_dir))
    return e.select("key", scalar.memory_cost(F.col("key"), F.col("value")).alias("memory_bytes"), scalar.output_cost(F.col("key"), F.col("value")).alias("output_bytes"))


@query("SELECT sum(strlen(key) + strlen(value) + 12)::BIGINT AS bytes FROM winners", LOG)
def memtable_usage(spark, sf_dir):
    return changes.memtable(_log(spark, sf_dir)).agg(F.sum(scalar.memory_cost(F.col("key"), F.col("value"))).alias("bytes"))


# --- metadata -----------------------------------------------------------------------------------------------------


@query("SELECT level, file_number, smallest_key, largest_key, entry_count, file_size_bytes FROM tables", LOG, SPLIT)
def table_metadata(spark, sf_dir):
    return _tables(spark, sf_dir)


@query("SELECT level, count(*)::BIGINT AS files, sum(file_size_bytes)::BIGINT AS bytes, sum(entry_count)::BIGINT AS entries FROM tables GROUP BY level", LOG, SPLIT)
def level_summary(spark, sf_dir):
    return metadata.level_summary(_tables(spark, sf_dir))


@query(
    "SELECT a.level, a.file_number AS a, b.file_number AS b FROM tables a JOIN tables b ON a.level = b.level AND a.file_number < b.file_number AND a.smallest_key <= b.largest_key AND b.smallest_key <= a.largest_key",
    LOG,
    SPLIT,
)
def overlap_pairs(spark, sf_dir):
    return metadata.overlap_pairs(_tables(spark, sf_dir))


@query("SELECT level, file_number FROM tables WHERE smallest_key <= 'user-00000042' AND largest_key >= 'user-00000042'", LOG, SPLIT)
def file_prune_for_key(spark, sf_dir):
    return metadata.files_for_key(_tables(spark, sf_dir), F.lit("user-00000042")).select("level", "file_number")


@query("SELECT level, file_number, row_number() OVER (PARTITION BY level ORDER BY CASE WHEN level = 0 THEN -file_number END, smallest_key) AS position FROM tables", LOG, SPLIT)
def read_order(spark, sf_dir):
    return metadata.read_positions(_tables(spark, sf_dir)).select("level", "file_number", "position")


@query("SELECT file_number, row_number() OVER (ORDER BY file_number) AS position FROM tables", LOG, SPLIT)
def manifest_order(spark, sf_dir):
    """The files in the order of their numbers, as a manifest lists them."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy("file_number"))  # file metadata: one row for each file
    return _tables(spark, sf_dir).select("file_number", place.cast("bigint").alias("position"))


@query("SELECT file_number, key FROM (SELECT file_number, key, seq, lag(key) OVER (PARTITION BY file_number ORDER BY seq) AS before FROM l0) WHERE before >= key", LOG)
def order_check(spark, sf_dir):
    """Where files would break the key order, had they been written in the order of arrival."""
    e = changes.level0(_log(spark, sf_dir)).withColumn("position", F.col("seq"))
    return metadata.order_violations(e).select("file_number", "key")


@query("SELECT level, file_number FROM tables WHERE false", LOG, SPLIT)
def sorted_level_check(spark, sf_dir):
    """Overlaps inside sorted levels: none, as the outputs of a compaction are disjoint."""
    return metadata.sorted_level_conflicts(_tables(spark, sf_dir)).select("level", "file_number")


@query(
    "SELECT file_number FROM (SELECT file_number, count(*) AS n FROM log2 GROUP BY file_number) JOIN tables USING (file_number) WHERE n <> entry_count",
    LOG,
    SPLIT,
    "log2 AS (SELECT *, (seq // 1000 + 1)::BIGINT AS file_number FROM log)",
)
def metadata_check(spark, sf_dir):
    """Files whose entry count differs from the number of changes they were flushed from (several versions of one key)."""
    raw = _log(spark, sf_dir).groupBy((F.floor(F.col("seq") / 1000).cast("bigint") + 1).alias("file_number")).agg(F.count("*").alias("n"))
    return raw.join(_tables(spark, sf_dir), "file_number").where("n <> entry_count").select("file_number")


@query(
    """SELECT level, file_number FROM (SELECT *, max(largest_key) OVER (ORDER BY smallest_key, file_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS furthest FROM tables)
    WHERE furthest >= smallest_key""",
    LOG,
    SPLIT,
)
def sorted_level_conflicts(spark, sf_dir):
    """The same check over files that do overlap: all of them taken for one sorted level."""
    t = _tables(spark, sf_dir)
    found = metadata.sorted_level_conflicts(t.withColumn("own", F.col("level")).withColumn("level", F.lit(1)))
    return found.select(F.col("own").alias("level"), "file_number")


@query("SELECT file_number FROM tables WHERE file_number % 7 IN (1, 2, 3, 4, 5)", LOG, SPLIT)
def manifest_file_check(spark, sf_dir):
    """Files that the manifest describes otherwise than they are, or that are missing: faults planted by file number, one kind each."""
    t = _tables(spark, sf_dir)
    kind = F.col("file_number") % 7
    listed = (
        t.withColumn("entry_count", F.col("entry_count") + (kind == 1).cast("int"))
        .withColumn("file_size_bytes", F.col("file_size_bytes") + (kind == 2).cast("int"))
        .withColumn("smallest_key", F.concat(F.col("smallest_key"), F.when(kind == 3, "x").otherwise("")))
        .withColumn("largest_key", F.concat(F.col("largest_key"), F.when(kind == 4, "x").otherwise("")))
    )
    return metadata.metadata_mismatches(listed, t.where(kind != 5))


@query("SELECT printf('%06d.sst', file_number) AS name, level FROM tables", LOG, SPLIT)
def file_names(spark, sf_dir):
    return _tables(spark, sf_dir).select(scalar.file_name(F.col("file_number")).alias("name"), "level")


@query("SELECT file_number, coalesce(sum(entry_count) OVER (PARTITION BY level ORDER BY smallest_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_entry FROM tables WHERE level = 1", LOG, SPLIT)
def running_offsets(spark, sf_dir):
    """The place of each level-1 file's first entry: a running sum over the files before it."""
    from pyspark.sql import Window

    w = Window.partitionBy("level").orderBy("smallest_key").rowsBetween(Window.unboundedPreceding, -1)
    return _tables(spark, sf_dir).where("level = 1").select("file_number", F.coalesce(F.sum("entry_count").over(w), F.lit(0)).cast("bigint").alias("first_entry"))


# --- picking and merging --------------------------------------------------------------------------------------------

PICKED = "picked AS (SELECT * FROM tables WHERE level = 0 ORDER BY file_number LIMIT 4), rng AS (SELECT min(smallest_key) AS low, max(largest_key) AS high FROM picked)"


@query("SELECT file_number, smallest_key, largest_key FROM picked", LOG, SPLIT, PICKED)
def l0_pick(spark, sf_dir):
    return compaction.oldest(_tables(spark, sf_dir), 0, 4).select("file_number", "smallest_key", "largest_key")


@query("SELECT low, high FROM rng", LOG, SPLIT, PICKED)
def picked_range(spark, sf_dir):
    return compaction.key_range(compaction.oldest(_tables(spark, sf_dir), 0, 4))


@query("SELECT file_number FROM tables, rng WHERE level = 1 AND smallest_key <= high AND low <= largest_key", LOG, SPLIT, PICKED)
def l1_overlap(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return compaction.overlapping(t, 1, compaction.key_range(compaction.oldest(t, 0, 4))).select("file_number")


@query("SELECT level, file_number FROM tables, rng WHERE level > 0 AND smallest_key <= high AND low <= largest_key", LOG, SPLIT, PICKED)
def deeper_overlap(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return compaction.deeper_overlap(t, 0, compaction.key_range(compaction.oldest(t, 0, 4))).select("level", "file_number")


SCORES = "scores AS (SELECT level, sum(file_size_bytes)::BIGINT AS bytes, sum(file_size_bytes) / (400.0 * 10 ** (level - 1)) AS score FROM tables WHERE level BETWEEN 1 AND 5 GROUP BY level)"


@query("SELECT level, bytes, score::DOUBLE AS score FROM scores", LOG, SPLIT, SCORES)
def level_score(spark, sf_dir):
    return compaction.level_scores(_tables(spark, sf_dir), 400, 10, 6)


@query("SELECT level FROM scores WHERE score > 1 ORDER BY score DESC, level LIMIT 1", LOG, SPLIT, SCORES)
def pick_level(spark, sf_dir):
    return compaction.picked_level(compaction.level_scores(_tables(spark, sf_dir), 400, 10, 6)).select("level")


def _oldest_files(spark, sf_dir):
    return changes.level0(_log(spark, sf_dir)).where(F.col("file_number") <= COMPACTED)


@query("SELECT key, type, value FROM kept", LOG, SPLIT)
def compact_keep_tombstones(spark, sf_dir):
    return compaction.merge(_oldest_files(spark, sf_dir), drop_deletes=False).select("key", "type", "value")


@query("SELECT key, value FROM kept WHERE type = 1", LOG, SPLIT)
def compact_drop_tombstones(spark, sf_dir):
    return compaction.merge(_oldest_files(spark, sf_dir), drop_deletes=True).select("key", "value")


@query("SELECT key, file::BIGINT AS file FROM puts JOIN cut USING (i)", LOG, SPLIT)
def output_split(spark, sf_dir):
    return compaction.greedy_files(compaction.merge(_oldest_files(spark, sf_dir), drop_deletes=True), SPLIT_BYTES)


@query(
    "SELECT key, block::BIGINT AS block FROM puts JOIN filled USING (i)",
    LOG,
    SPLIT,
    "filled(i, held, block) AS (SELECT i, cost, 0 FROM puts WHERE i = 1 UNION ALL SELECT p.i, CASE WHEN f.held >= 400 THEN p.cost ELSE f.held + p.cost END, CASE WHEN f.held >= 400 THEN f.block + 1 ELSE f.block END FROM filled f JOIN puts p ON p.i = f.i + 1)",
)
def block_cut(spark, sf_dir):
    return compaction.blocks(compaction.merge(_oldest_files(spark, sf_dir), drop_deletes=True), SPLIT_BYTES)


BLOCKS = """filled(i, held, block) AS (SELECT i, cost, 0 FROM puts WHERE i = 1 UNION ALL SELECT p.i, CASE WHEN f.held >= 400 THEN p.cost ELSE f.held + p.cost END, CASE WHEN f.held >= 400 THEN f.block + 1 ELSE f.block END FROM filled f JOIN puts p ON p.i = f.i + 1),
blocks AS (SELECT block, max(key) AS last_key, count(*) AS n, sum(cost) AS bytes FROM puts JOIN filled USING (i) GROUP BY block)"""


def _blocks(spark, sf_dir):
    merged = compaction.merge(_oldest_files(spark, sf_dir), drop_deletes=True)
    cost = scalar.output_cost(F.col("key"), F.col("value"))
    return compaction.blocks(merged, SPLIT_BYTES).join(merged.select("key", cost.alias("cost")), "key").groupBy("block").agg(F.max("key").alias("last_key"), F.count("*").alias("n"), F.sum("cost").alias("bytes"))


@query("SELECT block::BIGINT AS block, (sum(bytes) OVER (ORDER BY block) - bytes)::BIGINT AS first_byte, n::BIGINT AS entries FROM blocks", LOG, SPLIT, BLOCKS)
def block_offsets(spark, sf_dir):
    """Where each block of one file begins: a running sum over the file's blocks."""
    from pyspark.sql import Window

    before = F.sum("bytes").over(Window.orderBy("block")) - F.col("bytes")  # the blocks of one file
    return _blocks(spark, sf_dir).select("block", before.cast("bigint").alias("first_byte"), F.col("n").alias("entries"))


@query("SELECT block::BIGINT AS block, last_key FROM blocks WHERE last_key >= 'user-00000042' ORDER BY block LIMIT 1", LOG, SPLIT, BLOCKS)
def block_seek(spark, sf_dir):
    """The block that a seek inside a file reads: the first whose last key is not below the target."""
    return _blocks(spark, sf_dir).where("last_key >= 'user-00000042'").orderBy("block").limit(1).select("block", "last_key")


DEEP = """deep AS (SELECT * REPLACE (CASE WHEN level = 1 THEN 2 ELSE 1 END AS level) FROM tables),
own AS (SELECT * FROM deep WHERE level = 1 ORDER BY file_number LIMIT 1)"""


@query("SELECT level, file_number FROM own UNION ALL SELECT d.level, d.file_number FROM deep d, own WHERE d.level = 2 AND d.smallest_key <= own.largest_key AND own.smallest_key <= d.largest_key", LOG, SPLIT, DEEP)
def deep_pick(spark, sf_dir):
    """The inputs of a compaction below level 0: the oldest file of the level and the files of the next that it meets (levels as if one deeper)."""
    t = _tables(spark, sf_dir).withColumn("level", F.when(F.col("level") == 1, 2).otherwise(1))
    own = compaction.oldest(t, 1, 1)
    return own.unionByName(compaction.overlapping(t, 2, compaction.key_range(own))).select("level", "file_number")


@query("SELECT file_number, smallest_key FROM tables WHERE level = 1 AND largest_key >= 'user-00000042' ORDER BY smallest_key LIMIT 1", LOG, SPLIT)
def index_seek(spark, sf_dir):
    return metadata.first_file_from(_tables(spark, sf_dir), 1, F.lit("user-00000042")).select("file_number", "smallest_key")


@query(
    "SELECT file_number, level, row_number() OVER (ORDER BY level DESC, CASE WHEN level > 0 THEN smallest_key END, file_number) AS precedence FROM (SELECT level, file_number, smallest_key FROM picked UNION ALL SELECT level, file_number, smallest_key FROM tables, rng WHERE level = 1 AND smallest_key <= high AND low <= largest_key)",
    LOG,
    SPLIT,
    PICKED,
)
def compaction_inputs(spark, sf_dir):
    t = _tables(spark, sf_dir)
    own = compaction.oldest(t, 0, 4)
    both = own.unionByName(compaction.overlapping(t, 1, compaction.key_range(own)))
    return compaction.input_order(both, 0).select("file_number", "level", "precedence")


EDITS = """edits AS (SELECT file_number AS edit_no, 'add' AS op, file_number FROM (SELECT DISTINCT file_number FROM l0)
    UNION ALL SELECT 1000000 + file_number, 'delete', file_number FROM (SELECT DISTINCT file_number FROM l0 WHERE file_number <= 4)
    UNION ALL SELECT 2000000 + file_number, 'add', file_number FROM (SELECT DISTINCT file_number FROM l1))"""


def _edits(spark, sf_dir):
    old = changes.level0(_log(spark, sf_dir)).select("file_number").distinct()
    new = _split(spark, sf_dir).select("file_number").distinct()
    edit = lambda df, base, op: df.select((F.col("file_number") + base).alias("edit_no"), F.lit(op).alias("op"), "file_number")
    return edit(old, 0, "add").unionByName(edit(old.where(F.col("file_number") <= COMPACTED), 1_000_000, "delete")).unionByName(edit(new, 2_000_000, "add"))


@query("SELECT file_number FROM (SELECT * FROM edits QUALIFY row_number() OVER (PARTITION BY file_number ORDER BY edit_no DESC) = 1) WHERE op = 'add'", LOG, SPLIT, EDITS)
def manifest_fold(spark, sf_dir):
    return metadata.folded(_edits(spark, sf_dir)).select("file_number")


@query("SELECT DISTINCT file_number FROM l0 WHERE file_number > 4 UNION ALL SELECT DISTINCT file_number FROM l1", LOG, SPLIT)
def version_update(spark, sf_dir):
    """The new version: current files without a compaction's inputs, with its outputs."""
    current = changes.level0(_log(spark, sf_dir)).select("file_number").distinct()
    inputs = current.where(F.col("file_number") <= COMPACTED)
    return current.join(inputs, "file_number", "left_anti").unionByName(_split(spark, sf_dir).select("file_number").distinct())


@query("SELECT DISTINCT file_number FROM l0 WHERE file_number <= 4", LOG, SPLIT)
def stale_inputs(spark, sf_dir):
    """Inputs of the first compaction that the current version no longer holds: running it again has to be refused."""
    inputs = _oldest_files(spark, sf_dir).select("file_number").distinct()
    return inputs.join(_tables(spark, sf_dir).select("file_number"), "file_number", "left_anti")


# --- statistics ---------------------------------------------------------------------------------------------------

JOBS = """jobs AS (SELECT (file_number - 1) // 4 AS job_id, 0 AS input_level, 1 AS output_level, count(DISTINCT file_number) AS input_files, 1 AS output_files,
    sum(strlen(key) + strlen(value) + 16) AS bytes_read FROM l0 GROUP BY (file_number - 1) // 4),
outs AS (SELECT (file_number - 1) // 4 AS job_id, strlen(key) + strlen(value) + 16 AS cost FROM l0 QUALIFY row_number() OVER (PARTITION BY (file_number - 1) // 4, key ORDER BY file_number DESC) = 1),
done AS (SELECT * FROM jobs JOIN (SELECT job_id, sum(cost) AS bytes_written FROM outs GROUP BY job_id) USING (job_id))"""


def _jobs(spark, sf_dir):
    """A job for every four level-0 files, deletes kept."""
    from pyspark.sql import Window

    e = changes.level0(_log(spark, sf_dir)).withColumn("job_id", F.floor((F.col("file_number") - 1) / 4)).withColumn("cost", scalar.output_cost(F.col("key"), F.col("value")))
    kept = F.row_number().over(Window.partitionBy("job_id", "key").orderBy(F.desc("file_number"))) == 1
    return (
        e.withColumn("kept", kept)
        .groupBy("job_id")
        .agg(
            F.lit(0).alias("input_level"),
            F.lit(1).alias("output_level"),
            F.countDistinct("file_number").alias("input_files"),
            F.lit(1).alias("output_files"),
            F.sum("cost").alias("bytes_read"),
            F.sum(F.when(F.col("kept"), F.col("cost")).otherwise(0)).alias("bytes_written"),
        )
    )


@query(
    "SELECT input_level, output_level, count(*)::BIGINT AS jobs, sum(input_files)::BIGINT AS input_files, sum(output_files)::BIGINT AS output_files, sum(bytes_read)::BIGINT AS bytes_read, sum(bytes_written)::BIGINT AS bytes_written FROM done GROUP BY input_level, output_level",
    LOG,
    JOBS,
)
def compaction_stats(spark, sf_dir):
    return compaction.jobs_by_level(_jobs(spark, sf_dir))


@query(
    "SELECT count(*)::BIGINT AS jobs, coalesce(sum(input_files), 0)::BIGINT AS input_files, coalesce(sum(output_files), 0)::BIGINT AS output_files, coalesce(sum(bytes_read), 0)::BIGINT AS bytes_read, coalesce(sum(bytes_written), 0)::BIGINT AS bytes_written FROM done",
    LOG,
    JOBS,
)
def compaction_totals(spark, sf_dir):
    return compaction.job_totals(_jobs(spark, sf_dir))


@query("SELECT (SELECT sum(bytes_written) FROM done) / (SELECT sum(strlen(key) + strlen(value)) FROM log)::DOUBLE AS ratio", LOG, JOBS)
def write_amplification(spark, sf_dir):
    written = _jobs(spark, sf_dir).agg(F.sum("bytes_written").alias("written"))
    logical = _log(spark, sf_dir).agg(F.sum(F.octet_length("key") + F.octet_length("value")).alias("logical"))
    return written.join(F.broadcast(logical)).select(compaction.write_amplification(F.col("written"), F.col("logical")).alias("ratio"))


@query("SELECT event_type, list_sort(list(value))[least(count(*), floor(0.95 * count(*))::BIGINT + 1)] AS value FROM events GROUP BY event_type")
def latency_percentile(spark, sf_dir):
    return compaction.nearest_rank(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", 0.95, ["event_type"])


# --- the stored engine ----------------------------------------------------------------------------------------------


@query("SELECT key, value FROM winners WHERE type = 1", LOG)
def engine_scan(spark, sf_dir):
    """The log written to a stored engine, flushed, compacted until quiet, and scanned."""
    from keyloom.plans.engine import scratch

    engine = scratch(spark)
    log = _log(spark, sf_dir)
    engine.apply(log.select("key", "type", "value", "seq"), order_by="seq")
    engine.flush()
    engine.compact_until_quiet()
    return engine.scan().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def _in_batches(engine, log: DataFrame, batches: int = 4) -> None:
    """Write the log in the order of its sequence numbers, one batch after the other."""
    for k in range(batches):
        engine.apply(log.where(F.floor(F.col("seq") / 1000) % batches == k).select("key", "type", "value", "seq"), order_by="seq")


@query("SELECT k + 1 AS file_number, count(DISTINCT key)::BIGINT AS entries FROM (SELECT *, seq // 1000 % 4 AS k FROM log) GROUP BY k", LOG)
def flush_trigger(spark, sf_dir):
    """Level-0 segments after four writes that each fill the write buffer: one segment for each."""
    from keyloom.plans.engine import scratch

    engine = scratch(spark, Options(write_buffer_size=1, level0_compaction_trigger=0))
    _in_batches(engine, _log(spark, sf_dir))
    return engine.tables().select("file_number", F.col("entry_count").alias("entries"))


@query("SELECT arg_max(value, (k, seq)) AS value, key FROM (SELECT *, seq // 1000 % 6 AS k FROM log) GROUP BY key HAVING arg_max(type, (k, seq)) = 1", LOG)
def write_stall(spark, sf_dir):
    """The live view after six writes against a level 0 that is full with two segments: writes wait for compactions."""
    from keyloom.plans.engine import scratch

    engine = scratch(spark, Options(write_buffer_size=1, level0_compaction_trigger=2, level0_write_stall_trigger=2))
    _in_batches(engine, _log(spark, sf_dir), 6)
    return engine.scan().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query("SELECT key, arg_max(value, (k, seq)) AS value FROM (SELECT *, seq // 1000 % 5 AS k FROM log) GROUP BY key HAVING arg_max(type, (k, seq)) = 1", LOG)
def compaction_beside_flush(spark, sf_dir):
    """The live view after a compaction whose output was written while another segment was flushed: that one stays in level 0."""
    from keyloom.plans.engine import scratch

    engine = scratch(spark, Options(write_buffer_size=1, level0_compaction_trigger=4))
    log = _log(spark, sf_dir)
    part = lambda k: log.where(F.floor(F.col("seq") / 1000) % 5 == k).select("key", "type", "value", "seq")
    for k in range(4):
        engine.apply(part(k), order_by="seq")
    merged = engine._merged

    def beside(*args):
        made = merged(*args)
        engine.apply(part(4), order_by="seq")
        return made

    engine._merged = beside
    engine.compact()
    return engine.scan().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query("SELECT key, value FROM winners WHERE type = 1", LOG)
def stream_scan(spark, sf_dir):
    """The same view, fed by a stream that flushes each micro-batch to a level-0 segment."""
    from keyloom.plans.engine import scratch
    from keyloom.streaming.ingest import drain

    engine = scratch(spark)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    drain(changes.changes(stream), engine, order_by="seq")
    return engine.scan().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
