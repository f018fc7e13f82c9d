"""Language-model scoring: an interpolated modified Kneser-Ney model of order 2 or 3, counted in Spark over all training documents.

The model is a table of sorted hashes for each order, cut by ranges of the hash into ``parts`` files each in the shared folder, which
workers map into memory, so neither driver nor workers hold the model:

* n-grams of the highest order: a 56-bit hash and the count. Map tasks send, for each part, blobs of sorted distinct hashes (five bytes
  each; those counted once apart from the others, which carry a 64-bit count), a reduce task merges the blobs of a part.
* with order 3, pairs: hash, count, number of distinct left neighbours, and the discounted mass D1 N1 + D2 N2 + D3 N3 of the pair as a
  context. They come from a second pass that looks every triple up: each of a triple's ``c`` occurrences adds 1/c to a number of
  distinct triples, so no triple has to carry its pairs through a shuffle. A pair that occurs once in a map task's share is sent with
  two small counts, any other with its sums.
* words: the same over pairs, from a last pass; hot words meet as sums of one row per map task.

The lower orders count distinct left neighbours; start tokens stand before a text. A file has the low bytes of the hashes, an index over
their leading bits, and values only for n-grams that are not ``plain``: seen once, with one left neighbour, and as a context followed by
one word once. Shuffle files go when their pass ends.

Hash parts balance whatever the words are, and their number follows the text, so that a task sorts about as much whatever the table. A
worker gives up the pages of mapped files after every ``READ_BYTES`` of them. Files are written under a temporary name and renamed, so a
task may run again; a file that was written and is gone is an error. Memory mapping needs the shared folder as a mounted path; another
kind of store is refused.

Scores are log10. A text is its words and one end token; the first word's context is a start token.

Defined results: a null or empty text is the end token alone; texts are counted and scored whole, however long; repeated rows count as
often as they occur; without training documents every token has probability 1 / (V + 1) = 1; null ids are scored like others; extra
columns are ignored.
"""

from __future__ import annotations

import functools
import json
import mmap
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import kernel
from keyloom.llm.common import shared_dir, shuffles_removed, table, workers_find_package
from keyloom.llm.kernel import U64

#: Words and n-grams are told apart by the leading 56 bits of their hash.
_LEADING = ~U64(255)
START, END = U64(0x535441525400), U64(0x454E4400)
#: The order of the model in production.
ORDER = 3
#: Tokens gathered before a map task sends its blobs, and bytes of text scored at once.
GATHER, SCORE_BYTES = 3_000_000, 6_000_000
#: Bytes of text for each part, and bytes of files read before a worker gives up their pages.
PART_BYTES, READ_BYTES = 16_000_000, 64_000_000


def _mounted(uri: str) -> str:
    scheme, _, path = uri.partition(":") if ":" in uri else ("file", "", uri)
    if scheme != "file":
        raise ValueError(f"the language model maps files into memory, so spark.checkpoint.dir has to be a mounted path, not {uri}")
    return "/" + path.lstrip("/")


def _sequences(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with an end token after each text, the word before each (or the start token), and offsets."""
    data, offsets = kernel.buffers(col)
    data = kernel.lowered(data)
    starts, ends, docs = kernel.spans(data, offsets)
    n = len(docs) - 1
    out = docs + np.arange(n + 1)
    word = np.empty(out[-1], U64)
    last = out[1:] - 1
    word[last] = END
    inner = np.ones(len(word), bool)
    inner[last] = False
    word[inner] = kernel.hashes(data, starts, ends) & _LEADING
    before = np.empty(len(word), U64)
    before[1:] = word[:-1]
    before[out[:-1]] = START
    return word, before, out


def _pair(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return kernel.mix(kernel.mix(before + U64(0x9E3779B97F4A7C15)) ^ word) & _LEADING


def _second(before: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The word before the word before (or the start token)."""
    out = np.empty(len(before), U64)
    out[1:] = before[:-1]
    out[docs[:-1]] = START
    return out


def _gram(word: np.ndarray, before: np.ndarray, docs: np.ndarray, order: int) -> np.ndarray:
    return _pair(before if order == 2 else _pair(_second(before, docs), before), word)


def _first(part: int | np.ndarray, parts: int):
    """The smallest hash of a part; parts are ranges of the leading 32 bits."""
    return (-(-(np.asarray(part, dtype=object) << 32) // parts)) << 32


@functools.lru_cache(maxsize=16)
def _bounds(parts: int) -> np.ndarray:
    return np.array([int(x) for x in _first(np.arange(parts), parts)], U64)


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part begins among ascending ``keys``, and their end."""
    return np.concatenate([np.searchsorted(keys, _bounds(parts)), [len(keys)]])


def _packed(keys: np.ndarray) -> bytes:
    """Ascending hashes in six bytes each, or five if the lowest byte is 0 in all: the two leading bytes are kept as run lengths."""
    lead, runs = np.unique((keys >> U64(48)).astype(np.uint16), return_counts=True)
    spare = 0 if (keys & U64(255)).any() else 1
    low = np.ascontiguousarray(np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, spare:6])
    return np.array([len(lead), len(keys), spare], np.int64).tobytes() + lead.tobytes() + runs.astype(np.int32).tobytes() + low.tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    n_lead, n, spare = np.frombuffer(blob, np.int64, 3)
    lead = np.frombuffer(blob, np.uint16, n_lead, 24)
    runs = np.frombuffer(blob, np.int32, n_lead, 24 + 2 * n_lead)
    out = np.zeros((n, 8), np.uint8)
    out[:, spare:6] = np.frombuffer(blob, np.uint8, (6 - spare) * n, 24 + 6 * n_lead).reshape(-1, 6 - spare)
    return out.reshape(-1).view(U64) | (np.repeat(lead, runs).astype(U64) << U64(48))


def parts_for(docs: DataFrame) -> int:
    """Parts of the hash arrays over ``docs.text``: one for each shuffle partition, and more where these would hold over ``PART_BYTES`` of
    text, as a task sorts a part in memory."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


def _save(path: str, **arrays: np.ndarray) -> None:
    for name, a in arrays.items():
        part = f"{path}.{name}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            np.save(f, a)
        os.replace(part, f"{path}.{name}.npy")


def _save_table(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of several arrays: the length of a header, the header (type, place and length of each array), and the arrays."""
    arrays = {c: np.ascontiguousarray(a) for c, a in arrays.items()}
    at, places = 4096, {}
    for c, a in arrays.items():
        places[c] = (a.dtype.str, at, len(a))
        at += -(-a.nbytes // 64) * 64
    head = json.dumps(places).encode()
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(len(head).to_bytes(8, "little") + head)
        for c, a in arrays.items():
            f.seek(places[c][1])
            f.write(a)
        f.truncate(at)
    os.replace(part, path)


@functools.lru_cache(maxsize=4096)
def _table(path: str) -> tuple[mmap.mmap, dict[str, np.ndarray]]:
    with open(path, "rb") as f:
        data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    places = json.loads(data[8 : 8 + int.from_bytes(data[:8], "little")])
    return data, {c: np.frombuffer(data, kind, n, at) for c, (kind, at, n) in places.items()}


@functools.lru_cache(maxsize=4096)
def _mapped(path: str) -> np.ndarray:
    return np.asarray(np.load(path, mmap_mode="r"))


def _mapping(a: np.ndarray) -> mmap.mmap:
    """The file behind an array of ``_mapped``."""
    while not isinstance(a, mmap.mmap):
        a = a.base
    return a


_read: set[mmap.mmap] = set()


def _done_with(*data: mmap.mmap) -> None:
    """Files that were just read. Beyond ``READ_BYTES`` of them, their pages leave this worker's memory (the system may still keep them)."""
    _read.update(data)
    if sum(map(len, _read)) > READ_BYTES:
        for d in _read:
            d.madvise(mmap.MADV_DONTNEED)
        _read.clear()


kernel.FORGET += [_mapped.cache_clear, _table.cache_clear, _read.clear]


def _begins(ordered: np.ndarray) -> np.ndarray:
    """The places where a new key begins."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sorting order and the places where a new key begins in it."""
    order = np.argsort(keys)
    return order, _begins(keys[order])


def _taken(held: list[tuple[np.ndarray, ...]]) -> Iterator[np.ndarray]:
    """The columns of what was gathered, one at a time; ``held`` is empty afterwards, and no column stays when the next is made."""
    columns = [list(x) for x in zip(*held, strict=True)]
    held.clear()
    while columns:
        yield np.concatenate(columns.pop(0))


def _store(base: str, keys: np.ndarray, lead_from: int, parts: int, plain: np.ndarray, **columns: np.ndarray) -> None:
    """The file of one part: low bytes of ascending ``keys``, an index over some leading bits, a bitmap of the rows that are not plain,
    and the columns of those."""
    bits = int(min(40, max(4, np.round(np.log2(len(keys) * parts / 16))))) if len(keys) else 4
    shift = U64(64 - bits)
    first = lead_from >> int(shift)
    lead = (keys >> shift).astype(np.int64) - first
    index = np.searchsorted(lead, np.arange(int(lead[-1]) + 2 if len(lead) else 1))
    low = np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, 1 : 8 - bits // 8]
    rich = np.zeros(-(-len(keys) // 64) * 64, bool)
    rich[: len(keys)] = ~plain
    words = np.packbits(rich, bitorder="little").view(U64)
    rank = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
    narrow = lambda v: v.astype(np.uint32) if not len(v) or 0 <= v.min() and v.max() < 2**32 else v
    kept = {c: v[~plain] if v.dtype.kind == "f" else narrow(v[~plain]) for c, v in columns.items()}
    _save_table(base, kept | {"low": np.concatenate([low.reshape(-1), np.zeros(8, np.uint8)]), "index": narrow(np.concatenate([[bits, first], index])), "rich": words, "rank": narrow(rank)})


def _sought(low: np.ndarray, index: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the hashes ``q`` those (as places in ``q``) that the file has, and their rows."""
    bits, first = int(index[0]), int(index[1])
    lead = (q >> U64(64 - bits)).astype(np.int64) - first
    own = np.flatnonzero(lead < len(index) - 3)
    lo, hi = index[lead[own] + 2].astype(np.int64), index[lead[own] + 3].astype(np.int64)
    width = 7 - bits // 8
    mask = U64((1 << (8 * width)) - 1)
    # Eight bytes from each row's place: its own are the low ones. The row after the last is all padding.
    value = np.ndarray(((len(low) - 8) // width + 1,), U64, low, strides=(width,))
    wanted = (q[own] >> U64(8)) & mask
    end = hi
    for _ in range(int((hi - lo).max(initial=0)).bit_length()):
        mid = (lo + hi) >> 1
        less = ((value[mid] & mask) < wanted) & (mid < hi)
        lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
    hit = np.flatnonzero((lo < end) & ((value[lo] & mask) == wanted))
    return own[hit], lo[hit]


@dataclass
class Model:
    path: str
    parts: int
    tokens: int = 0
    words: int = 0
    pairs: int = 0
    pair_discounts: list[float] = field(default_factory=lambda: [0.0] * 4)
    word_discounts: list[float] = field(default_factory=lambda: [0.0] * 4)
    word_kinds: list[int] = field(default_factory=lambda: [0] * 4)
    order: int = 2
    triple_discounts: list[float] = field(default_factory=lambda: [0.0] * 4)
    #: The parts that have a file, by table.
    written: dict[str, list[int]] = field(default_factory=dict)

    def file(self, kind: str, part: int) -> str:
        return f"{self.path}/{kind}-{part:06d}"

    def _plain(self, kind: str, column: str) -> float:
        """What a plain row has: once, one left neighbour, and as a context one follower once."""
        return {"pairs": self.triple_discounts, "words": self.pair_discounts}[kind][1] if column == "mass" else 1

    def store(self, kind: str, part: int, keys: np.ndarray, **columns: np.ndarray) -> None:
        plain = np.ones(len(keys), bool)
        for c, v in columns.items():
            plain &= np.abs(v - self._plain(kind, c)) < 1e-9
        _store(self.file(kind, part), keys, int(_bounds(self.parts)[part]), self.parts, plain, **columns)

    def _lookup(self, kind: str, h: np.ndarray, columns: tuple[str, ...]) -> list[np.ndarray]:
        """The columns beside each hash, 0 where it is unknown. Each distinct hash is sought once."""
        order = np.argsort(h)
        ordered = h[order]
        fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(h)]
        some = ordered[fresh]
        place = np.empty(len(h), np.int64)
        place[order] = np.cumsum(fresh) - 1
        return [v[place] for v in self._sorted_lookup(kind, some, columns)]

    def _sorted_lookup(self, kind: str, ordered: np.ndarray, columns: tuple[str, ...]) -> list[np.ndarray]:
        cuts = _cuts(ordered, self.parts)
        out = [np.zeros(len(ordered), np.float64 if c == "mass" else np.int64) for c in columns]
        there = np.zeros(self.parts, bool)
        there[self.written.get(kind, [])] = True
        for p in np.flatnonzero((np.diff(cuts) > 0) & there).tolist():
            data, held = _table(self.file(kind, p))
            found, at = _sought(held["low"], held["index"], ordered[cuts[p] : cuts[p + 1]])
            to = cuts[p] + found
            for o, c in zip(out, columns, strict=True):
                o[to] = self._plain(kind, c)
            word = held["rich"][at >> 6]
            bit = (at & 63).astype(U64)
            some = np.flatnonzero((word >> bit) & U64(1))
            if len(some):
                below = word[some] & ((U64(1) << bit[some]) - U64(1))
                row = held["rank"][at[some] >> 6].astype(np.int64) + np.bitwise_count(below)
                for o, c in zip(out, columns, strict=True):
                    o[to[some]] = held[c][row]
            _done_with(data)
        return out

    def counts(self, grams: np.ndarray) -> np.ndarray:
        """Counts of n-grams of the highest order."""
        return self._lookup("pairs" if self.order == 2 else "triples", grams, ("count",))[0]

    def score(self, texts: pa.Array) -> dict[str, np.ndarray]:
        word, before, docs = _sequences(texts)

        def earlier(v: np.ndarray) -> np.ndarray:
            """Of each token's predecessor; the last of ``v`` belongs to the start of a text."""
            out = np.concatenate([v[-1:], v[:-2]])
            out[docs[:-1]] = v[-1]
            return out

        c, left, context, mass = self._lookup("words", np.append(word, START), ("count", "left", "context", "mass"))
        c, left, context, mass = c[:-1], left[:-1], earlier(context), earlier(mass)
        pairs = _pair(before, word)
        if self.order == 2:
            pair = self.counts(pairs)
        else:
            held, pair, third = self._lookup("pairs", np.append(pairs, _pair(np.array([START]), np.array([START]))), ("count", "left", "mass"))
            held, pair, third = earlier(held), pair[:-1], earlier(third)
        d2, d1 = np.array(self.pair_discounts), np.array(self.word_discounts)
        uniform = 1.0 / (self.words + 1)
        low = np.full(len(word), uniform)
        if self.pairs:
            spare = float(np.dot(d1, self.word_kinds)) / self.pairs
            low = np.maximum(left - d1[np.minimum(left, 3)], 0) / self.pairs + spare * uniform
        seen = context > 0
        high = np.maximum(pair - d2[np.minimum(pair, 3)], 0)
        p = np.where(seen, (high + mass * low) / np.maximum(context, 1), low)
        if self.order == 3:
            triple, d3 = self.counts(_gram(word, before, docs, 3)), np.array(self.triple_discounts)
            high = np.maximum(triple - d3[np.minimum(triple, 3)], 0)
            p = np.where(held > 0, (high + third * p) / np.maximum(held, 1), p)
        base = np.log10((c + 0.1) / (self.tokens + 0.1 * (self.words + 1)))
        return {
            "n_tokens": np.diff(docs),
            "n_known": kernel.sums((c > 0).astype(np.int64), docs),
            "base_score": kernel.sums(base, docs),
            "score": kernel.sums(np.log10(p), docs),
        }


def _discounts(kinds: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 0, 1, 2, and 3 or more, from the numbers of n-grams seen 1 to 4 times."""
    n1, n2, n3, n4 = kinds
    if not (n1 and n2):
        return [0.0, 0.5, 0.5, 0.5] if n1 else [0.0, 0.0, 0.0, 0.0]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0]
    return [0.0, *[min(max(d, 0.05), k) for d, k in zip(raw, (0.95, 1.9, 2.9), strict=True)]]


def _blobs(keys: np.ndarray, values: list[np.ndarray], parts: int, columns: int | None = None) -> Iterator[pa.RecordBatch]:
    """One row for each part of ascending ``keys``: part, packed keys, and each value column's bytes (null beyond ``values``)."""
    cuts = _cuts(keys, parts)
    some = np.flatnonzero(np.diff(cuts)).tolist()
    cols = [pa.array(some, pa.int32()), pa.array([_packed(keys[cuts[p] : cuts[p + 1]]) for p in some], pa.binary())]
    ends = np.append(cuts[some], len(keys))
    cols += [pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((ends * v.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(v))]) for v in values]
    cols += [pa.nulls(len(some), pa.binary())] * ((columns or len(values)) - len(values))
    yield pa.RecordBatch.from_arrays(cols, ["part", "keys", *[f"v{i}" for i in range(len(cols) - 2)]])


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each part, with views of their blobs; the input is sorted by part."""
    at, rows = None, []
    for b in batches:
        names = b.schema.names
        views = [[x.as_buffer() for x in b.column(c)] if c != "part" else b.column(c).to_pylist() for c in names]  # no buffer: null
        for row in zip(*views, strict=True):
            r = dict(zip(names, row, strict=True))
            if r["part"] != at and rows:
                yield at, rows
                rows = []
            at = r["part"]
            rows.append(r)
    if rows:
        yield at, rows


def train(docs: DataFrame, parts: int | None = None, order: int = 2) -> Model:
    """Count the model over every row of ``docs.text``; one Spark job for each order, one row for each part comes to the driver."""
    if order not in (2, 3):
        raise ValueError(f"the order of the language model is 2 or 3, not {order}")
    spark = workers_find_package(docs.sparkSession)
    parts = parts or parts_for(docs)
    model = Model(f"{_mounted(shared_dir(spark))}/language-model-{uuid.uuid4().hex}", parts, order=order)
    os.makedirs(model.path, exist_ok=True)
    with shuffles_removed(spark):
        return _train(docs.select("text"), model)


def _train(text: DataFrame, model: Model) -> Model:
    parts, order = model.parts, model.order

    def grams_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def send() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate(held)
            held.clear()
            keys.sort()
            first = _begins(keys)
            keys, c = keys[first], np.diff(first, append=len(keys))
            yield from _blobs(keys[c == 1], [], parts, 1)
            yield from _blobs(keys[c > 1], [c[c > 1].astype(np.int64)], parts)

        for b in kernel.slices(batches):
            held.append(_gram(*_sequences(b.column("text")), order))
            n += len(held[-1])
            if n >= GATHER:
                yield from send()
                n = 0
        if held:
            yield from send()

    def grams_in(part: int, rows: list[dict]) -> dict:
        keys = [_unpacked(r["keys"]) for r in rows]
        ends = np.cumsum([len(k) for k in keys]).tolist()
        counts = np.ones(ends[-1], np.int64)
        for r, k, end in zip(rows, keys, ends, strict=True):
            if r["v0"] is not None:
                counts[end - len(k) : end] = np.frombuffer(r["v0"], np.int64)
        keys = np.concatenate(keys)
        sort, first = _grouped(keys)
        keys, counts = keys[sort[first]], np.add.reduceat(counts[sort], first)
        model.store("pairs" if order == 2 else "triples", part, keys, count=counts)
        return {"n": len(keys), "tokens": int(counts.sum()), "kinds": [int((counts == k).sum()) for k in (1, 2, 3, 4)]}

    def reduced(kind: str, out, columns: int, merge) -> list:
        def into(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, rows in _by_part(batches):
                yield pa.RecordBatch.from_pylist([{"part": part, **merge(part, rows)}])

        sent = text.mapInArrow(kernel.trimmed(out), "part int, keys binary" + "".join(f", v{i} binary" for i in range(columns)))
        done = sent.repartitionById(parts, "part").sortWithinPartitions("part").mapInArrow(kernel.trimmed(into), "part bigint, n bigint, tokens bigint, kinds array<bigint>").collect()
        model.written[kind] = [r["part"] for r in done]
        return done

    done = reduced("pairs" if order == 2 else "triples", grams_out, 1, grams_in)
    model.tokens = sum(r["tokens"] for r in done)
    discounts = _discounts([sum(r["kinds"][k] for r in done) for k in range(4)])

    def middle_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def send() -> Iterator[pa.RecordBatch]:
            columns = _taken(held)
            keys = next(columns)
            sort, first = _grouped(keys)
            keys = keys[sort[first]]
            right, follow = (v[sort] for v in columns)
            n = np.diff(first, append=len(sort))
            del sort
            once = (n == 1) & (right[first] < 256) & (follow[first] < 256)
            at = first[once]
            yield from _blobs(keys[once], [right[at].astype(np.uint8), follow[at].astype(np.uint8)], parts, 3)
            share = lambda c, d: np.where(c > 0, d / np.maximum(c, 1), 0.0)
            sums = [n[~once], np.add.reduceat(share(right, 1.0), first)[~once], np.add.reduceat(share(follow, np.array(model.triple_discounts)[np.minimum(follow, 3)]), first)[~once]]
            yield from _blobs(keys[~once], sums, parts)

        for b in kernel.slices(batches, limit=SCORE_BYTES):
            word, before, at = _sequences(b.column("text"))
            if not len(word):
                continue
            c = model.counts(_gram(word, before, at, 3))
            # A text's pairs: that of the start tokens, which only is a context, and one for each token. The triple that ends with a pair
            # counts its left neighbour; the triple after it counts it as a context (none follows the last pair, whose 1 is never read).
            places = np.arange(len(word)) + np.repeat(np.arange(1, len(at)), np.diff(at))
            keys, right, follow = (np.empty(len(word) + len(at) - 1, t) for t in (U64, np.int64, np.int64))
            begins = at[:-1] + np.arange(len(at) - 1)
            keys[places], right[places] = _pair(before, word), c
            keys[begins], right[begins] = _pair(np.array([START]), np.array([START])), 0
            follow[places - 1], follow[at[1:] + np.arange(len(at) - 1)] = c, 1
            held.append((keys, right, follow))
            n += len(keys)
            if n >= GATHER // 2:
                yield from send()
                n = 0
        if held:
            yield from send()

    def middle_in(part: int, rows: list[dict]) -> dict:
        discount = np.array(model.triple_discounts)
        keys, columns = [], []
        for r in rows:
            keys.append(_unpacked(r["keys"]))
            if r["v2"] is None:  # one occurrence: the counts of the triples that end with it and follow it
                right, follow = (np.frombuffer(r[v], np.uint8).astype(np.int64) for v in ("v0", "v1"))
                columns.append((np.ones(len(right)), np.where(right > 0, 1.0 / np.maximum(right, 1), 0.0), discount[np.minimum(follow, 3)] / follow))
            else:
                columns.append((np.frombuffer(r["v0"], np.int64).astype(float), np.frombuffer(r["v1"]), np.frombuffer(r["v2"])))
        keys = np.concatenate(keys)
        sort, first = _grouped(keys)
        count, left, mass = (np.add.reduceat(np.concatenate(v)[sort], first) for v in zip(*columns, strict=True))
        count, left = (np.rint(v).astype(np.int64) for v in (count, left))
        model.store("pairs", part, keys[sort][first], count=count, left=left, mass=mass)
        n = left[left > 0]  # the pair of start tokens is a context only
        return {"n": len(n), "tokens": int(count.sum()), "kinds": [int((n == k).sum()) for k in (1, 2, 3, 4)]}

    if order == 3:
        model.triple_discounts = discounts
        done = reduced("pairs", middle_out, 3, middle_in)
        discounts = _discounts([sum(r["kinds"][k] for r in done) for k in range(4)])
    model.pairs, model.pair_discounts = sum(r["n"] for r in done), discounts

    def merged(columns: Iterator[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Distinct keys of the first column, and the sums of the others."""
        keys = next(columns)
        sort, first = _grouped(keys)
        return keys[sort[first]], [np.add.reduceat(v[sort], first) for v in columns]

    def words_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def send() -> Iterator[pa.RecordBatch]:
            return _blobs(*merged(_taken(held)), parts)

        for b in kernel.slices(batches, limit=SCORE_BYTES):
            word, before, _ = _sequences(b.column("text"))
            if not len(word):
                continue
            pair = _pair(before, word)
            c, value = model._lookup("pairs", pair, ("count", "left")) if order == 3 else [model.counts(pair)] * 2
            one = 1.0 / c
            words, ends = merged(iter([word, np.ones(len(word)), one]))
            contexts, begins = merged(iter([before, value * one, np.array(model.pair_discounts)[np.minimum(value, 3)] * one]))
            none = lambda keys: [np.zeros(len(keys))] * 2
            keys, values = merged(map(np.concatenate, zip([words, *ends, *none(words)], [contexts, *none(contexts), *begins], strict=True)))
            held.append((keys, *values))
            n += len(keys)
            if n >= GATHER // 2:
                yield from send()
                n = 0
        if held:
            yield from send()

    def words_in(part: int, rows: list[dict]) -> dict:
        keys = np.concatenate([_unpacked(r["keys"]) for r in rows])
        sort, first = _grouped(keys)
        count, left, context, mass = (np.add.reduceat(np.concatenate([np.frombuffer(r[f"v{i}"]) for r in rows])[sort], first) for i in range(4))
        count, left, context = (np.rint(v).astype(np.int64) for v in (count, left, context))
        model.store("words", part, keys[sort][first], count=count, left=left, context=context, mass=mass)
        n = left[count > 0]  # the start token is a context only
        return {"n": len(n), "tokens": int(count.sum()), "kinds": [int((n == k).sum()) for k in (1, 2, 3, 4)]}

    done = reduced("words", words_out, 4, words_in)
    model.words = sum(r["n"] for r in done)
    kinds = [sum(r["kinds"][k] for r in done) for k in range(4)]
    model.word_discounts = _discounts(kinds)
    model.word_kinds = [0, kinds[0], kinds[1], model.words - kinds[0] - kinds[1]]
    return model


def score(docs: DataFrame, model: Model, keep: str = "doc_id") -> DataFrame:
    """``keep``, n_tokens, n_known, train_tokens, base_score, score (log10) and perplexity of every row."""
    workers_find_package(docs.sparkSession)
    kind = docs.schema[keep].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in kernel.slices(batches, limit=SCORE_BYTES):
            got = model.score(b.column("text"))
            cols = [b.column(keep), pa.array(got["n_tokens"]), pa.array(got["n_known"]), pa.array(np.full(b.num_rows, model.tokens)), pa.array(got["base_score"]), pa.array(got["score"])]
            yield pa.RecordBatch.from_arrays(cols, [keep, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = docs.select(keep, "text").mapInArrow(kernel.trimmed(run), f"`{keep}` {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs.where(~held_out()), order=ORDER)).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def base_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op2 that SQL can tell: token counts and the add-0.1 base score, rounded."""
    return op2_language_model(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(i) + 1), lambda k: ascii(i[k])::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, r: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"
BASE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(xor({_CRC}, 4294967295) % 10 = 0, false) AS held_out,
                  list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS w
           FROM (SELECT *, doc_id::VARCHAR AS i FROM documents)),
t AS (SELECT doc_id, held_out, unnest(w) AS k FROM d),
c AS (SELECT k, count(*) AS c FROM t WHERE NOT held_out GROUP BY k),
n AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*)::BIGINT AS n_tokens, count(c.c)::BIGINT AS n_known, any_value(n.n) AS train_tokens,
       round(sum(log10((coalesce(c.c, 0) + 0.1::DOUBLE) / (n.n + 0.1::DOUBLE * (n.v + 1)))), 4) AS base_score
FROM t LEFT JOIN c USING (k), n GROUP BY doc_id, held_out"""
