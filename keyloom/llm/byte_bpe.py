"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside each partition.

A text is cut by the tokenizer's pattern; every distinct piece becomes rows (piece, position, token, next position, next
token), at first one for each byte. One step of the recursive query joins the rows with the merge table, takes each piece's
leftmost pair of minimum rank, and contracts it; pieces without a pair leave the recursion. Ids are joined back to the places of
the pieces, and ordered aggregation gives the ids of a text and, through the vocabulary, its decoded bytes.

The vocabulary file's path is a parameter and has to be readable by every worker; the merge table is derived from its ranks: a
pair may merge if the two tokens' bytes together are a token. A worker keeps a bounded dictionary of pieces already encoded.
Pieces are taken in groups of ``GROUP_BYTES``, so memory follows the longest piece.

Contracting a piece costs the square of its length. A piece of more than ``LONG`` bytes is therefore cut into chunks that are contracted
by the same query and joined: tokens in a row are the encoding of their bytes if every two neighbours are that of theirs (then no merge
crosses a border), so at each seam the query encodes the tokens on both sides anew, more of them each time, until both ends fit.

Defined results: a null or empty text has no tokens, the digests are those of the empty string; special tokens are ordinary
text; texts are encoded whole; repeated rows are encoded one by one; null ids are kept; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import kernel
from keyloom.llm.common import table, workers_find_package

GROUP_BYTES, KEPT = 400_000, 400_000
#: Bytes from which a piece is cut, and of each chunk; tokens at each side of a seam that are tried first.
LONG, CHUNK, SEAM = 4096, 1024, 8

#: Rows: piece, pos, tok, npos, ntok (-1 after the last). A pair's key is tok * 2^20 + ntok, a choice is rank * 2^31 + pos.
CONTRACT = """
WITH RECURSIVE steps(piece, pos, tok, npos, ntok, done) AS (
    SELECT piece, pos, tok, npos, ntok, false FROM bytes
    UNION ALL
    (WITH best AS (
        SELECT s.piece, min(m.id * 2147483648 + s.pos) AS choice
        FROM steps s LEFT JOIN merges m ON m.pair = s.tok * 1048576 + s.ntok
        WHERE NOT s.done GROUP BY s.piece),
     chosen AS (
        SELECT b.piece, b.choice & 2147483647 AS pos, b.choice >> 31 AS id, l.npos AS gone, r.npos AS npos, r.ntok AS ntok
        FROM best b JOIN steps l ON l.piece = b.piece AND l.pos = (b.choice & 2147483647) JOIN steps r ON r.piece = b.piece AND r.pos = l.npos
        WHERE b.choice IS NOT NULL)
     SELECT s.piece, s.pos,
            CASE WHEN s.pos = c.pos THEN c.id ELSE s.tok END,
            CASE WHEN s.pos = c.pos THEN c.npos ELSE s.npos END,
            CASE WHEN s.pos = c.pos THEN c.ntok WHEN s.npos = c.pos THEN c.id ELSE s.ntok END,
            c.piece IS NULL
     FROM steps s LEFT JOIN chosen c ON c.piece = s.piece
     WHERE NOT s.done AND (c.piece IS NULL OR s.pos <> c.gone)))
SELECT piece, tok FROM steps WHERE done ORDER BY piece, pos
"""
DECODED = "SELECT doc, unhex(string_agg(hex, '' ORDER BY pos)) AS bytes FROM tokens JOIN vocabulary USING (id) GROUP BY doc"


class Codec:
    """One worker's DuckDB database with the merge table and the vocabulary of one file of ranks."""

    def __init__(self, path: str, pattern: str, memory: str = "250MB"):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern, self.memory = regex.compile(pattern), memory
        pairs = {(ranks[t[:i]] << 20) + ranks[t[i:]]: n for t, n in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.tables = {
            "merges": pa.table({"pair": np.fromiter(pairs.keys(), np.int64, len(pairs)), "id": np.fromiter(pairs.values(), np.int64, len(pairs))}),
            "vocabulary": pa.table({"id": np.fromiter(ranks.values(), np.int64, len(ranks)), "hex": pa.array([t.hex() for t in ranks], pa.string())}),
        }
        self._db = None
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.bytes = {n: t for t, n in ranks.items()}
        self.decimal = [str(i) for i in range(max(ranks.values(), default=0) + 1)]
        self._forget()

    @property
    def db(self) -> duckdb.DuckDBPyConnection:
        """The database with the merge table and the vocabulary, made when it is first asked for after :meth:`close`."""
        if self._db is None:
            self._db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": self.memory, "temp_directory": ""})
            for name, source in self.tables.items():
                self._db.register("source", source)
                self._db.execute(f"CREATE TABLE {name} AS SELECT * FROM source")
                self._db.unregister("source")
        return self._db

    def close(self) -> None:
        """Give up the database and the pieces encoded so far; the codec may go on."""
        if self._db is not None:
            self._db.close()
            self._db = None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def _contract(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after the other, and the number of each."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        first = np.concatenate([[0], np.cumsum(sizes)])
        piece = np.repeat(np.arange(len(pieces)), sizes)
        pos = np.arange(len(data)) - first[piece]
        tok = self.single[data]
        last = first[1:] - 1
        npos, ntok = pos + 1, np.concatenate([tok[1:], [-1]])
        npos[last], ntok[last] = -1, -1
        rows = pa.table({"piece": piece, "pos": pos, "tok": tok, "npos": npos, "ntok": ntok})
        self.db.register("bytes", rows)
        got = self.db.execute(CONTRACT).fetchnumpy()
        self.db.unregister("bytes")
        return np.asarray(got["tok"], np.int64), np.bincount(np.asarray(got["piece"], np.int64), minlength=len(pieces))

    def _each(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each of some short pieces."""
        out: list[list[int]] = []
        at = 0
        while at < len(pieces):
            to, held = at, 0
            while to < len(pieces) and (to == at or held + len(pieces[to]) <= GROUP_BYTES):
                held += len(pieces[to])
                to += 1
            ids, sizes = self._contract(pieces[at:to])
            out += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
            at = to
        return out

    def _long(self, piece: bytes) -> np.ndarray:
        """The ids of a long piece, joined from those of its chunks."""
        parts = self._each([piece[i : i + CHUNK] for i in range(0, len(piece), CHUNK)])
        plain = lambda ids: b"".join(self.bytes[i] for i in ids)

        def fits(pairs: list[tuple[int, int]]) -> list[bool]:
            some = list(dict.fromkeys(pairs))
            good = {p for p, ids in zip(some, self._each([plain(p) for p in some]), strict=True) if ids == list(p)} if some else set()
            return [p in good for p in pairs]

        seams: dict[int, tuple[int, list[int]]] = {}  # after part i: tokens taken from each side, and what stands in their place
        open_ = []
        for i, good in enumerate(fits([(a[-1], b[0]) for a, b in zip(parts, parts[1:], strict=False)])):
            if good:
                seams[i] = (0, [])
            else:
                open_.append(i)
        k = SEAM
        while open_:
            if any(2 * k + 2 > min(len(parts[i]), len(parts[i + 1])) for i in open_):
                return self._contract([piece])[0]  # the seams reach across whole chunks
            tried = self._each([plain(parts[i][-k:] + parts[i + 1][:k]) for i in open_])
            ends = fits([p for i, x in zip(open_, tried, strict=True) for p in ((parts[i][-k - 1], x[0]), (x[-1], parts[i + 1][k]))])
            for i, x, left, right in zip(open_, tried, ends[::2], ends[1::2], strict=True):
                if left and right:
                    seams[i] = (k, x)
            open_ = [i for i in open_ if i not in seams]
            k *= 2
        out: list[int] = []
        for i, ids in enumerate(parts):
            first, last = (seams[i - 1][0] if i else 0), (seams[i][0] if i in seams else 0)
            out += ids[first : len(ids) - last] + (seams[i][1] if i in seams else [])
        return np.array(out, np.int64)

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and n + 1 offsets."""
        if len(self.known) > KEPT:
            self._forget()
        known, fresh, places, counts = self.known, [], [], []
        for text in texts:
            found = self.pattern.findall(text)
            counts.append(len(found))
            for x in found:
                if (n := known.get(x)) is None:
                    n = known[x] = len(known)
                    fresh.append(x.encode())
                places.append(n)
        at = 0
        while at < len(fresh):
            to, held = at, 0
            while to < len(fresh) and len(fresh[to]) <= LONG and (to == at or held + len(fresh[to]) <= GROUP_BYTES):
                held += len(fresh[to])
                to += 1
            if to == at:
                ids = self._long(fresh[at])
                sizes, to = np.array([len(ids)]), at + 1
            else:
                ids, sizes = self._contract(fresh[at:to])
            self.ids.append(ids)
            self.sizes.append(sizes)
            at = to
        if len(self.ids) > 1:
            self.ids, self.sizes = [np.concatenate(self.ids)], [np.concatenate(self.sizes)]
        if not places:
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        place = np.array(places)
        first = np.concatenate([[0], np.cumsum(self.sizes[0])])
        size = self.sizes[0][place]
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = self.ids[0][np.repeat(first[place] - ends[:-1], size) + np.arange(ends[-1])]
        return flat, ends[np.concatenate([[0], np.cumsum(counts)])]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The bytes of each text, joined by ordered aggregation."""
        out = [b""] * (len(offsets) - 1)
        rows = pa.table({"doc": np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), "pos": np.arange(len(ids)), "id": ids})
        self.db.register("tokens", rows)
        for doc, data in self.db.execute(DECODED).fetchall():
            out[doc] = data
        self.db.unregister("tokens")
        return out

    def digests(self, ids: np.ndarray, offsets: np.ndarray) -> list[tuple[int, str, str]]:
        """Number of ids, SHA-256 of the decimal ids joined by a space, SHA-256 of the decoded bytes."""
        out = []
        for k, data in enumerate(self.decode(ids, offsets)):
            own = ids[offsets[k] : offsets[k + 1]].tolist()
            out.append((len(own), hashlib.sha256(" ".join([self.decimal[i] for i in own]).encode()).hexdigest(), hashlib.sha256(data).hexdigest()))
        return out


_codecs: dict[tuple[str, str], Codec] = {}


kernel.FORGET.append(lambda: [c.close() for c in _codecs.values()])


def codec(path: str, pattern: str) -> Codec:
    """This worker's codec, made once; its database goes at the end of a partition."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _texts(b: pa.RecordBatch) -> list[str]:
    return ["" if x is None else x for x in b.column("text").to_pylist()]


def digest(docs: DataFrame, path: str, pattern: str, keep: str = "doc_id") -> DataFrame:
    """``keep``, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    workers_find_package(docs.sparkSession)
    kind = docs.schema[keep].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in kernel.slices(batches, limit=1_000_000):
            n, ids, data = zip(*own.digests(*own.tokens(_texts(b))), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(keep), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(data, pa.string())], [keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(keep, "text").mapInArrow(kernel.trimmed(run), f"`{keep}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, pattern: str, keep: str = "doc_id") -> DataFrame:
    """``keep`` and ``ids`` (array of int) of every row."""
    workers_find_package(docs.sparkSession)
    kind = docs.schema[keep].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in kernel.slices(batches, limit=1_000_000):
            ids, offsets = own.tokens(_texts(b))
            yield pa.RecordBatch.from_arrays([b.column(keep), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], [keep, "ids"])

    return docs.select(keep, "text").mapInArrow(kernel.trimmed(run), f"`{keep}` {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, keep: str = "doc_id") -> DataFrame:
    """``keep`` and ``text`` of every row of ``ids``; a null array is an empty text, bytes that are not UTF-8 are replaced."""
    workers_find_package(encoded.sparkSession)
    kind = encoded.schema[keep].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            lists = [x or [] for x in b.column("ids").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
            data = own.decode(np.array([i for x in lists for i in x], np.int64), offsets.astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(keep), pa.array([x.decode("utf-8", "replace") for x in data], pa.string())], [keep, "text"])

    return encoded.select(keep, "ids").mapInArrow(kernel.trimmed(run), f"`{keep}` {kind}, text string")


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path and pattern of an installed public tokenizer."""
    import public_tokenizers

    return str(public_tokenizers.path(name)), public_tokenizers.PATTERN


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"), *vocabulary())
