"""N-gram Jaccard join: documents whose sets of word shingles overlap by 80 per cent or more, and the groups they form.

Method. A document's shingles are hashed into groups; the counts per group are a point. Over the points stands an R-tree whose
nodes keep the largest coordinate of each group, so the sum over groups of the smaller coordinate bounds the overlap of a
document with everything below a node. Pairs that survive the bound are verified on the exact sets.

Distribution. An R-tree over all documents would be one task, so trees are built over blocks that no link crosses:

1. Documents with equal sets are one node (the smallest doc_id stands for them).
2. Prefix filter: under any one order of all shingles, two sets of 80 % overlap share a shingle among the first
   n - ceil(0.8 n) + 1 of each. The order is by hash, except that shingles of over ``FREQUENT`` documents come last, the rarer of them
   first: then copies of a text meet at shingles of their own before they meet others at a passage that many texts have. Frequencies
   of all shingles and shared shingles of prefixes are counted over all documents in blobs of packed hashes.
3. Documents that share a prefix shingle are candidates. Up to ``FREQUENT`` documents, all their pairs are, if their sizes, the places of
   the shingle and the count vectors allow 80 %; more documents, all of them but 80 % frequent shingles, are sorted by size, cut where
   one size is below 80 % of the next, and tied to the first of their run without a test. Nothing is dropped.
4. Components of the candidate pairs are the blocks: no link leaves one. A block of up to ``BLOCK`` documents and
   ``BLOCK_SHINGLES`` shingles is one task's R-tree; a larger one is dealt by size class, so that links are inside a class or between
   neighbours (``CLASSES``), and each class into parts of that size. Every document is sent to its part alone, which is written once
   into the shared folder; each pair of parts that may hold links is a piece of work of its own that reads both files, so that no work
   grows with a group and disk grows with the documents only. The more of all sets are in blocks, the more turns (up to ``TURNS``) they
   are sent in, as the shuffle of a turn is on disk beside the files. The files go when the links are known. Every link of a group is
   verified and counted, and a group of n different texts may have n * n / 2 of them.
5. Every pair of different sets that passes the bound is verified. Tasks emit a spanning forest of the links and, for every set,
   the number of documents it is linked with, never the pairs; components of the forest are the groups.

Hash arrays that workers probe (ids of representatives, frequent and shared shingles, blocks) are files in the shared folder,
mapped into memory; nothing of the size of the corpus is broadcast or brought to the driver.

Shingles are compared by 64-bit hashes. Defined results: a text without words, empty or null has no shingles and is linked
with nothing; one of fewer words than a shingle has one, the whole sequence; a null doc_id is linked with nothing, its component_id is
null and its n_links 0; rows that share a doc_id are one node, linked with whatever one of their texts is linked with (n_links then
counts links of texts); a doc_id that is not an integer is an error; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import functools
import os
import shutil
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import kernel
from keyloom.llm.common import shared_dir, shuffles_removed, stored, table, workers_find_package
from keyloom.llm.kernel import U64
from keyloom.llm.language_model import _LEADING, _blobs, _by_part, _cuts, _done_with, _grouped, _mapped, _mapping, _mounted, _save, _unpacked, parts_for

WIDTH, PERCENT = 5, 80
FREQUENT, LEAF = 8, 64
#: Documents and shingles of a block that is not dealt into parts.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
GATHER = 2_000_000
#: Passes in which the sets are sent to their blocks, if all sets are in blocks.
TURNS = 4


def _classes() -> np.ndarray:
    least = [1]
    while least[-1] < 2**40:
        least.append(least[-1] * 100 // PERCENT + 1)
    return np.array(least, np.int64)


#: The smallest size of each class of sizes: two sets that link are of one class or of neighbours.
CLASSES = _classes()


def need(a, b):
    """The smallest overlap of sets of ``a`` and ``b`` shingles that reaches the threshold."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def prefix_size(n):
    return n - -(-PERCENT * n // 100) + 1


def sets(col: pa.Array) -> list[np.ndarray]:
    """The ascending distinct shingle hashes of every text."""
    data, offsets = kernel.buffers(col)
    data = kernel.lowered(data)
    starts, ends, docs = kernel.spans(data, offsets)
    h, at = kernel.shingles(kernel.hashes(data, starts, ends), docs, WIDTH)
    return [np.unique(h[at[i] : at[i + 1]]) for i in range(len(at) - 1)]


def group_counts(s: np.ndarray) -> np.ndarray:
    """Counts of a set's shingles by group; about one group for every eight shingles, 64 to 1,024 of them."""
    bits = int(min(10, max(6, np.ceil(np.log2(max(1, len(s)) / 8)))))
    return np.bincount((s & U64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits).astype(np.uint32)


def folded(v: np.ndarray, groups: int) -> np.ndarray:
    """The counts over fewer groups: the group is the hash's low bits, so halves add up."""
    while v.shape[-1] > groups:
        half = v.shape[-1] // 2
        v = v[..., :half] + v[..., half:]
    return v


class RTree:
    """Leaves of similar points; a node keeps the largest coordinates and the extreme sizes of what is below it."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        self.leaves: list[np.ndarray] = []
        self.root = self._node(np.arange(len(sizes)))

    def _node(self, rows: np.ndarray) -> tuple:
        top = (self.points[rows].max(axis=0), int(self.sizes[rows].min()), int(self.sizes[rows].max()))
        if len(rows) <= LEAF:
            self.leaves.append(rows)
            return (*top, rows, None, None)
        spread = self.sizes[rows].max() > 1.25 * self.sizes[rows].min()
        axis = self.sizes[rows] if spread else self.points[rows][:, int(np.argmax(self.points[rows].var(axis=0)))]
        order = rows[np.argsort(axis, kind="stable")]
        half = len(rows) // 2
        return (*top, None, self._node(order[:half]), self._node(order[half:]))

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        """Rows whose bound reaches the threshold."""
        found, stack = [], [self.root]
        while stack:
            top, least, most, rows, left, right = stack.pop()
            if 100 * most < PERCENT * size or PERCENT * least > 100 * size or np.minimum(point, top).sum() < need(size, max(least, -(-PERCENT * size // 100))):
                continue
            if rows is None:
                stack += [left, right]
                continue
            bound = np.minimum(point, self.points[rows]).sum(axis=1)
            found.append(rows[bound >= need(size, self.sizes[rows])])
        return np.concatenate(found) if found else np.zeros(0, np.int64)


class _Overlaps:
    """The shingles of some sets, each with the sets that hold it."""

    def __init__(self, own: list[np.ndarray]):
        self.own, self.n = own, len(own)
        every = np.concatenate(own)
        order = np.argsort(every, kind="stable")
        every = every[order]
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        self.keys, self.at = every[first], np.concatenate([first, [len(every)]])
        self.holders = np.repeat(np.arange(self.n, dtype=np.int32), [len(s) for s in own])[order]

    def count(self, s: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """How many shingles of ``s`` each of the sets ``rows`` holds."""
        place = np.minimum(np.searchsorted(self.keys, s), len(self.keys) - 1)
        place = place[self.keys[place] == s]
        start, size = self.at[place], self.at[place + 1] - self.at[place]
        if size.sum() > 40 * sum(len(self.own[j]) for j in rows.tolist()) + 1000:  # few rows to look at: merge with each
            return np.array([np.isin(self.own[j], s, assume_unique=True).sum() for j in rows.tolist()], np.int64)
        both, done = np.zeros(self.n, np.int64), 0
        ends = np.cumsum(size)
        while done < len(size):  # a bounded number of holders at once
            to = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + GATHER, "right")))
            n = size[done:to]
            index = np.arange(int(n.sum())) + np.repeat(start[done:to] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            both += np.bincount(self.holders[index], minlength=self.n)
            done = to
        return both[rows]


def linked_pairs(own: list[np.ndarray], first: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Every link between sets once, as a set and the later sets it is linked with; with ``first``, only links between the first sets and the others."""
    n = len(own)
    sizes = np.array([len(s) for s in own], np.int64)
    groups = 1 << int(min(10, max(6, np.ceil(np.log2(max(1, np.median(sizes)) / 8)))))
    points = np.stack([folded(np.bincount((s & U64(1023)).astype(np.int64), minlength=1024), groups) for s in own]).astype(np.int32)
    begin = first or 0
    tree, overlaps = RTree(points[begin:], sizes[begin:]), _Overlaps(own[begin:])
    for i in range(n if first is None else first):
        rows = tree.search(points[i], int(sizes[i]))
        rows = rows[rows + begin > i]
        if len(rows):
            both = overlaps.count(own[i], rows)
            yes = rows[100 * both >= PERCENT * (sizes[i] + sizes[rows + begin] - both)]
            if len(yes):
                yield i, np.sort(yes) + begin


def links(own: list[np.ndarray], first: int | None = None, copies: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links of ``linked_pairs``; ``copies``, if given, is (documents of each set, documents linked with it), of which the second is filled."""
    root = np.arange(len(own))
    members: dict[int, list[int]] = {i: [i] for i in range(len(own))}
    forest: list[tuple[int, int]] = []
    for i, found in linked_pairs(own, first):
        if copies is not None:
            copies[1, i] += copies[0, found].sum()
            copies[1, found] += copies[0, i]
        for j in found[root[found] != root[i]].tolist():
            a, b = int(root[i]), int(root[j])
            if a == b:
                continue
            forest.append((i, j))
            if len(members[a]) < len(members[b]):
                a, b = b, a
            root[members[b]] = a
            members[a] += members.pop(b)
    return forest


class _Files:
    """Sorted hash arrays of one kind in the shared folder, cut by ranges of the hash. A file that was written and is gone is an error."""

    def __init__(self, path: str, parts: int):
        self.path, self.parts = path, parts
        self.written = np.zeros(parts, bool)

    def take(self, sent: DataFrame, merge) -> _Files:
        """Write the files from blobs: ``merge`` turns the rows of a part into its arrays."""

        def into(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, rows in _by_part(batches):
                _save(f"{self.path}-{part:06d}", **merge(rows))
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32())})

        done = sent.repartitionById(self.parts, "part").sortWithinPartitions("part").mapInArrow(kernel.trimmed(into), "part int").collect()  # a number for each part
        self.written[[r["part"] for r in done]] = True
        return self

    def find(self, h: np.ndarray, column: str | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is there, and the column beside it."""
        order = np.argsort(h)
        ordered = h[order]
        cuts = _cuts(ordered, self.parts)
        there, value = np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        for p in np.flatnonzero((np.diff(cuts) > 0) & self.written).tolist():
            keys = _mapped(f"{self.path}-{p:06d}.keys.npy")
            if not len(keys):
                continue
            q = ordered[cuts[p] : cuts[p + 1]]
            at = np.minimum(np.searchsorted(keys, q), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == q)
            there[order[cuts[p] + hit]] = True
            if column:
                beside = _mapped(f"{self.path}-{p:06d}.{column}.npy")
                value[order[cuts[p] + hit]] = beside[at[hit]]
                _done_with(_mapping(beside))
            _done_with(_mapping(keys))
        return there, value


def _id_hash(ids: np.ndarray) -> np.ndarray:
    return kernel.mix(np.ascontiguousarray(ids, np.int64).view(U64) + U64(0x9E3779B97F4A7C15))


def _ids(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids (0 for null), and which are not null."""
    col = b.column("doc_id")
    return np.asarray(pc.fill_null(col.cast(pa.int64()), 0)), ~np.asarray(col.is_null())


def _files(df: DataFrame, parts: int, label: str, columns: tuple[str, ...] = ()) -> _Files:
    """Write rows of (doc_id, columns) as files keyed by the id's hash."""
    files = _Files(f"{_mounted(shared_dir(df.sparkSession))}/{label}-{uuid.uuid4().hex}", parts)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                h = _id_hash(_ids(b)[0])
                order = np.argsort(h)
                yield from _blobs(h[order], [np.asarray(b.column(c).cast(pa.int64()))[order] for c in columns], parts)

    def merge(rows: list[dict]) -> dict[str, np.ndarray]:
        keys = np.concatenate([_unpacked(r["keys"]) for r in rows])
        order = np.argsort(keys)
        return {c: np.concatenate([np.frombuffer(r[f"v{i}"], np.int64) for r in rows])[order] for i, c in enumerate(columns)} | {"keys": keys[order]}

    blobs = "part int, keys binary" + "".join(f", v{i} binary" for i in range(len(columns)))
    return files.take(df.select("doc_id", *columns).mapInArrow(kernel.trimmed(out), blobs), merge)


def _prefixes(docs: DataFrame, reps: _Files, frequent: _Files | None, emit, schema: str) -> DataFrame:
    """``emit(ids, sizes, prefixes)`` for gathered prefixes of representatives, frequent shingles ordered last; for whole sets without ``frequent``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray]] = []
        n = 0
        for b in kernel.slices(batches):
            ids, real = _ids(b)
            chosen = np.flatnonzero(real & reps.find(_id_hash(ids))[0])
            if not len(chosen):
                continue
            own = sets(b.column("text").take(pa.array(chosen)))
            if frequent is not None:
                count = frequent.find(np.concatenate(own) & _LEADING, "count")[1]
                ends = np.cumsum([len(s) for s in own])
                own = [s[np.argsort(c, kind="stable")] if (c := count[e - len(s) : e]).any() else s for s, e in zip(own, ends, strict=True)]
            for i, s in zip(chosen.tolist(), own, strict=True):
                if len(s):
                    held.append((int(ids[i]), len(s), s if frequent is None else s[: prefix_size(len(s))]))
                    n += len(held[-1][2])
            if n >= GATHER:
                yield from emit(*zip(*held, strict=True))
                held, n = [], 0
        if held:
            yield from emit(*zip(*held, strict=True))

    return docs.select("doc_id", "text").mapInArrow(kernel.trimmed(run), schema)


def _counted(docs: DataFrame, reps: _Files, frequent: _Files | None, parts: int, over: int, label: str) -> _Files:
    """The hashes in the prefixes of more than ``over`` representatives; without ``frequent``, the leading 56 bits of those in whole sets, with their counts."""
    files = _Files(f"{_mounted(shared_dir(docs.sparkSession))}/{label}-{uuid.uuid4().hex}", parts)

    def emit(ids, sizes, prefixes) -> Iterator[pa.RecordBatch]:
        every = np.concatenate(prefixes)
        keys, c = np.unique(every & _LEADING if frequent is None else every, return_counts=True)
        return _blobs(keys, [np.minimum(c, 255).astype(np.uint8)], parts)

    def merge(rows: list[dict]) -> dict[str, np.ndarray]:
        keys = np.concatenate([_unpacked(r["keys"]) for r in rows])
        c = np.concatenate([np.frombuffer(r["v0"], np.uint8) for r in rows]).astype(np.int64)
        order, first = _grouped(keys)
        c = np.add.reduceat(c[order], first)
        return {"keys": keys[order][first][c > over]} | ({"count": np.minimum(c[c > over], 65_535).astype(np.uint16)} if frequent is None else {})

    return files.take(_prefixes(docs, reps, frequent, emit, "part int, keys binary, v0 binary"), merge)


def _candidates(docs: DataFrame, reps: _Files, frequent: _Files, shared: _Files, parts: int) -> DataFrame:
    """(a, b, tested): pairs that share a prefix shingle; ``tested`` ones still have to pass the bound."""

    def emit(ids, sizes, prefixes) -> Iterator[pa.RecordBatch]:
        lengths = [len(p) for p in prefixes]
        keys = np.concatenate(prefixes)
        doc, size = np.repeat(np.array(ids, np.int64), lengths), np.repeat(np.array(sizes, np.int32), lengths)
        place = np.concatenate([np.arange(n, dtype=np.int32) for n in lengths])
        both = np.flatnonzero(shared.find(keys)[0])
        if len(both):
            order = both[np.argsort(keys[both])]
            yield from _blobs(keys[order], [doc[order], size[order], place[order]], parts)

    def into(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_part(batches):
            keys = np.concatenate([_unpacked(r["keys"]) for r in rows])
            doc = np.concatenate([np.frombuffer(r["v0"], np.int64) for r in rows])
            size = np.concatenate([np.frombuffer(r["v1"], np.int32) for r in rows]).astype(np.int64)
            spare = size - np.concatenate([np.frombuffer(r["v2"], np.int32) for r in rows])  # the shingles from this one on
            order = np.lexsort((doc, size, keys))
            keys, doc, size, spare = keys[order], doc[order], size[order], spare[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            count = np.diff(np.concatenate([first, [len(keys)]]))
            place = np.arange(len(keys)) - np.repeat(first, count)
            few = np.repeat(count <= FREQUENT, count)
            pairs = []
            for step in range(1, FREQUENT):  # all pairs of few documents: each with the one ``step`` places later
                i = np.flatnonzero(few & (place + step < np.repeat(count, count)))
                i = i[np.minimum(spare[i], spare[i + step]) >= need(size[i], size[i + step])]  # else no link whose first common shingle this is
                pairs.append(np.stack([doc[i], doc[i + step]]))
            tested = np.unique(np.concatenate(pairs, axis=1), axis=1)
            run = np.concatenate([[True], (keys[1:] != keys[:-1]) | (100 * size[:-1] < PERCENT * size[1:])])  # no link crosses such a gap of sizes
            head = np.flatnonzero(run)[np.cumsum(run) - 1]
            i = np.flatnonzero(~few & ~run)
            star = np.unique(np.stack([doc[head[i]], doc[i]]), axis=1)
            a, b = np.concatenate([tested, star], axis=1)
            flag = np.concatenate([np.ones(tested.shape[1], bool), np.zeros(star.shape[1], bool)])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(flag)], ["a", "b", "tested"])

    sent = _prefixes(docs, reps, frequent, emit, "part int, keys binary, v0 binary, v1 binary, v2 binary")
    return sent.repartitionById(parts, "part").sortWithinPartitions("part").mapInArrow(kernel.trimmed(into), "a bigint, b bigint, tested boolean").where("a <> b")


def _passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose count vectors allow the threshold."""
    for b in batches:
        keep = []
        for va, vb, na, nb in zip(*(b.column(c).to_pylist() for c in ("va", "vb", "na", "nb")), strict=True):
            x, y = np.frombuffer(va, np.uint32), np.frombuffer(vb, np.uint32)
            groups = min(len(x), len(y))
            keep.append(bool(np.minimum(folded(x, groups), folded(y, groups)).sum() >= need(na, nb)))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], ["a", "b"])


def components(edges: DataFrame, label: str = "components", most: int = 60) -> DataFrame:
    """(node, component): every node with an edge and the smallest node it reaches, by alternating large and small stars."""
    now = stored(edges.select("a", "b").where("a <> b").distinct(), label)
    seen = None
    for _ in range(most):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or state == seen:
            break
        seen = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        now = stored(small.select("a", F.col("m").alias("b")).unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(), label)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def _size_class(n):
    return np.searchsorted(CLASSES, n, "right") - 1


def _blocks(blocks: DataFrame, same: DataFrame, parts: int) -> tuple[_Files, _Files]:
    """By node its block, whether that is dealt into parts, and its copies; by ``_dealt_key`` of a dealt block and a size class the parts."""
    rows, shingles = F.count("*"), F.sum("n")
    k = F.greatest(F.ceil(rows / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("bigint").alias("k")
    dealt = blocks.groupBy("component").agg(k).select("component", (F.col("k") > 1).cast("bigint").alias("dealt"))
    blocks = blocks.join(dealt, "component")
    known = _files(blocks.select(F.col("node").alias("doc_id"), "component", "dealt", "copies"), parts, "jaccard-blocks", ("component", "dealt", "copies"))
    own = blocks.where("dealt = 1").select(F.col("node").alias("rep"), "component").join(same.select("rep", "n"), "rep")
    size_class = F.size(F.filter(F.lit(CLASSES.tolist()), lambda least: least <= F.col("n"))) - 1
    key = F.shiftleft("component", 7).bitwiseXOR(size_class.cast("bigint")).alias("doc_id")
    return known, _files(own.select(key, "n").groupBy("doc_id").agg(k), parts, "jaccard-parts", ("k",))


def _dealt_key(component: np.ndarray, size_class: np.ndarray) -> np.ndarray:
    return (component << np.int64(7)) ^ size_class


def _solved(ids: list[int], own: list[np.ndarray], documents: list[int], first: int | None, schema: list[str]) -> pa.RecordBatch:
    """Rows (a, b, n) of the links between sets, null in the other columns of ``schema``."""
    copies = np.array([documents, [0] * len(ids)], np.int64)
    pairs = links(own, first, copies) if len(ids) > 1 else []
    some = np.flatnonzero(copies[1]).tolist()
    a, b = [ids[i] for i, _ in pairs] + [ids[i] for i in some], [ids[j] for _, j in pairs] + [None] * len(some)
    cols = [pa.array(x, pa.int64()) for x in (a, b, [None] * len(pairs) + copies[1, some].tolist())]
    return pa.RecordBatch.from_arrays(cols + [pa.nulls(len(a), pa.int64())] * (len(schema) - 3), schema)


def _read(path: str) -> tuple[list[int], list[np.ndarray], list[int]]:
    ids, documents, ends, shingles = (_mapped(f"{path}.{c}.npy") for c in ("ids", "documents", "ends", "shingles"))
    return ids.tolist(), [shingles[e - n : e] for e, n in zip(ends.tolist(), np.diff(ends, prepend=0).tolist(), strict=True)], documents.tolist()


def _turn(component: np.ndarray, size_class, part, turns: int) -> np.ndarray:
    return (kernel.mix(_id_hash(component) ^ _id_hash(_dealt_key(np.asarray(part, np.int64), size_class))) % U64(turns)).astype(np.int64)


def _verified(docs: DataFrame, blocks: DataFrame, same: DataFrame, parts: int) -> DataFrame:
    """(a, b, n): a spanning forest of the verified links inside every block, and with a null ``b`` numbers of documents that ``a`` is linked with."""
    known, dealt = _blocks(blocks, same, parts)
    folder = f"{_mounted(shared_dir(docs.sparkSession))}/jaccard-sets-{uuid.uuid4().hex}"
    os.makedirs(folder)
    place, result = ["component", "class", "part"], ["a", "b", "n"]
    inside, every = blocks.agg(F.sum("n")).first()[0] or 0, same.agg(F.sum("n")).first()[0] or 1
    turns = max(1, min(TURNS, -(-TURNS * inside // every)))

    def out(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
        for b in kernel.slices(batches):
            ids, real = _ids(b)
            h = _id_hash(ids)
            there, component = known.find(h, "component")
            _, cut = known.find(h, "dealt")
            _, copies = known.find(h, "copies")
            chosen = np.flatnonzero(real & there & ((cut == 1) | (_turn(component, -1, -1, turns) == turn)))
            if not len(chosen):
                continue
            own = sets(b.column("text").take(pa.array(chosen)))
            chosen, own = chosen[[len(s) > 0 for s in own]], [s for s in own if len(s)]
            component, cut = component[chosen], cut[chosen] == 1
            size_class = np.where(cut, _size_class(np.array([len(s) for s in own])), -1)
            _, k = dealt.find(_id_hash(_dealt_key(component, size_class)), "k")
            part = np.where(cut, (h[chosen] % np.maximum(k, 1).astype(U64)).astype(np.int64), -1)
            now = _turn(component, size_class, part, turns) == turn
            own = [s for s, x in zip(own, now.tolist(), strict=True) if x]
            cols = [pa.array(x[now], pa.int64()) for x in (component, size_class, part, ids[chosen], copies[chosen])]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([s.tobytes() for s in own], pa.binary())], [*place, "doc_id", "copies", "shingles"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links inside whole blocks and inside parts; a part is written too, for its tasks with other parts, and told."""

        def done(key: tuple, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            rows = list({(r[0], r[2]): r for r in rows}.values())  # repeated rows
            ids, documents, own = [r[0] for r in rows], [r[1] for r in rows], [np.frombuffer(r[2], U64) for r in rows]
            if key[2] >= 0:
                ends = np.cumsum([len(s) for s in own])
                _save(_part_path(folder, *key), ids=np.array(ids, np.int64), documents=np.array(documents, np.int64), ends=ends, shingles=np.concatenate(own))
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 3 + [pa.array([x], pa.int64()) for x in key], [*result, *place])
            yield _solved(ids, own, documents, None, [*result, *place])

        at, rows = None, []
        for b in batches:
            for c, size_class, part, *row in zip(*(b.column(x).to_pylist() for x in (*place, "doc_id", "copies", "shingles")), strict=True):
                if (c, size_class, part) != at and rows:
                    yield from done(at, rows)
                    rows = []
                at = (c, size_class, part)
                rows.append(tuple(row))
        if rows:
            yield from done(at, rows)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links between two parts, which are read from their files."""
        for b in batches:
            for r in b.to_pylist():
                ids, own, documents = _read(_part_path(folder, r["component"], r["class"], r["part"]))
                others = _read(_part_path(folder, r["component"], r["with_class"], r["with_part"]))
                yield _solved(ids + others[0], own + others[1], documents + others[2], len(ids), result)

    found = None
    for turn in range(turns):
        sent = docs.select("doc_id", "text").mapInArrow(kernel.trimmed(functools.partial(out, turn=turn)), "component bigint, class bigint, part bigint, doc_id bigint, copies bigint, shingles binary")
        dealt_out = sent.repartition(parts, *place).sortWithinPartitions(*place)
        solved = stored(dealt_out.mapInArrow(kernel.trimmed(within), "a bigint, b bigint, n bigint, component bigint, class bigint, part bigint"), "jaccard-links")
        found = solved if found is None else found.unionByName(solved)
    told = found.where("component IS NOT NULL").select(*place)
    if told.isEmpty():
        return found.select(*result)
    near = told.select("*", F.explode(F.array("class", F.col("class") + 1)).alias("with_class"))
    pairs = near.join(told.select("component", F.col("class").alias("with_class"), F.col("part").alias("with_part")), ["component", "with_class"])
    pairs = pairs.where("with_class > class OR with_part > part").repartition(parts, *place, "with_class", "with_part")
    more = stored(pairs.mapInArrow(kernel.trimmed(across), "a bigint, b bigint, n bigint"), "jaccard-links")
    shutil.rmtree(folder, ignore_errors=True)
    return found.where("component IS NULL").select(*result).unionByName(more)


def _part_path(folder: str, component: int, size_class: int, part: int) -> str:
    return f"{folder}/{component}_{size_class}_{part}"


def jaccard_groups(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, and n_links, the number of other documents that the document is linked with, of every row."""
    with shuffles_removed(workers_find_package(docs.sparkSession)):
        return _groups(docs, parts)


def _groups(docs: DataFrame, parts: int | None) -> DataFrame:
    spark = docs.sparkSession
    parts = parts or parts_for(docs)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in kernel.slices(batches):
            own = sets(b.column("text"))
            with np.errstate(over="ignore"):
                sums = [np.array([kernel.mix(s).sum(), np.bitwise_xor.reduce(kernel.mix(s ^ U64(0x5851F42D4C957F2D)))], U64).view(np.int64) if len(s) else (0, 0) for s in own]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(s) for s in own], pa.int64()), pa.array([int(x[0]) for x in sums]), pa.array([int(x[1]) for x in sums]), pa.array([group_counts(s).tobytes() for s in own], pa.binary())],
                ["doc_id", "n", "s1", "s2", "v"],
            )

    measured = stored(docs.mapInArrow(kernel.trimmed(measure), "doc_id bigint, n bigint, s1 bigint, s2 bigint, v binary"), "jaccard-measured")
    same = measured.where("n > 0 AND doc_id IS NOT NULL").select("n", "s1", "s2", "doc_id").distinct().groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    same = stored(same, "jaccard-same")
    reps = _files(same.select(F.col("rep").alias("doc_id")).distinct(), parts, "jaccard-reps")
    frequent = _counted(docs, reps, None, parts, FREQUENT, "jaccard-frequent")
    shared = _counted(docs, reps, frequent, parts, 1, "jaccard-shared")
    pairs = stored(_candidates(docs, reps, frequent, shared, parts).distinct(), "jaccard-candidates")
    point = measured.where("doc_id IS NOT NULL").select("doc_id", "n", "v")
    wanted = pairs.where("tested").select("a", "b")
    some = point.join(wanted.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "doc_id", "left_semi")
    some = stored(some.distinct(), "jaccard-points")
    left = some.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("v").alias("va"))
    right = some.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("v").alias("vb"))
    passed = wanted.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "va", "vb").mapInArrow(kernel.trimmed(_passing), "a bigint, b bigint")
    blocks = stored(components(passed.unionByName(pairs.where("NOT tested").select("a", "b")), "jaccard-blocks"), "jaccard-blocks")
    copies = same.groupBy("rep").agg(F.max("copies").alias("copies"), F.sum("n").alias("n")).withColumnRenamed("rep", "node")
    found = _verified(docs, blocks.join(copies, "node"), same, parts)
    groups = components(found.where("b IS NOT NULL"), "jaccard-groups").withColumnRenamed("node", "rep")
    linked = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("linked"))
    n_links = (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")
    of = same.join(groups, "rep", "left").join(linked, "rep", "left").select("n", "s1", "s2", F.coalesce("component", "rep").alias("component_id"), n_links)
    done = measured.drop("v").join(of, ["n", "s1", "s2"], "left")
    real = F.col("doc_id").isNotNull()
    return done.select("doc_id", F.col("n").alias("n_shingles"), F.when(real, F.coalesce("component_id", "doc_id")).alias("component_id"), F.coalesce(F.when(real, F.col("n_links")), F.lit(0)).alias("n_links"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id WHERE r.c < e.y)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.c) AS component_id, (SELECT count(*) FROM e WHERE e.x = w.doc_id)::BIGINT AS n_links
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN r ON r.doc_id = w.doc_id GROUP BY w.doc_id, n.n"""
