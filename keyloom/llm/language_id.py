"""Language identification by interpolated Kneser-Ney character models, one per language, in sorted hash arrays.

A text becomes a sequence of lower-cased letters, with one space for every run of other characters. For each language an
interpolated Kneser-Ney model of order ``ORDER`` is built from the n-grams of a bounded sample; the n-grams of all languages
share one sorted hash array per order, with a log-probability for each language beside each n-gram (interpolation done), and
one sorted hash array of contexts with the back-off weights. A text gets the language of the lowest cross-entropy per
character. Rejection is calibrated on documents that were not counted: a logistic curve of the margin between the two best
languages gives the confidence, and a quantile of the winners' cross-entropies says what is foreign to all languages.

The sample: for each of the ``LANGS`` most common languages at most about ``DOCS`` labelled documents of at most ``CHARS`` characters,
``ALL_DOCS`` in all, chosen by a hash of doc_id; so neither the corpus nor a noisy lang column makes the model or its broadcast grow. Every
text is scored whole.

Defined results: ``und`` with score 0 for a null text, an empty one or one without a letter, and for every text if nothing
could be learned; ties go to the language that sorts first; repeated rows and null ids are predicted like any other row; extra
columns are ignored.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import kernel
from keyloom.llm.common import table, workers_find_package
from keyloom.llm.kernel import U64, HashArray

ORDER, BITS = 5, 12  # symbols of 12 bits: five of them make a key of 60 bits
DOCS, CHARS, SYMBOLS = 1000, 20_000, (1 << BITS) - 2
#: The languages learnt are the most common ones, and all of them share so many documents.
LANGS, ALL_DOCS = 400, 20_000
#: Rows of a language from which some are held for the calibration.
HOLD = 10
_SPREAD = U64(0x9E3779B97F4A7C15)  # odd: multiplying by it is a bijection, so hashed n-grams never collide
_MASK = [U64((1 << (BITS * n)) - 1) for n in range(ORDER + 1)]


@functools.cache
def _letters() -> np.ndarray:
    """For every code point its lower-case code point if it is a letter or a mark inside words, else 0."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(ch := chr(c))
        if kind[0] == "L":
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
        elif kind[0] == "M":
            out[c] = c
    return out


@functools.cache
def _marks() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] == "M" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _points(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts (null: none), and n + 1 offsets."""
    texts = ["" if x is None else x for x in col.to_pylist()]
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def _folded(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters with single zeros between words, offsets, and whether a text has a letter."""
    points, offsets = _points(col)
    low = _letters()[points]
    first = np.zeros(len(low), bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    before = np.concatenate([[0], low[:-1]]).astype(np.uint32)
    before[first] = 0
    keep = (low != 0) | (before != 0)  # a leading or second space goes
    has = kernel.sums(((low != 0) & ~_marks()[points]).astype(np.int64), offsets) > 0
    return low[keep], np.concatenate([[0], np.cumsum(keep)])[offsets], has


def _keys(symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The last ``ORDER`` symbols at each place as one number; before a text there are spaces."""
    place = np.arange(len(symbols)) - np.repeat(offsets[:-1], np.diff(offsets))
    key = np.zeros(len(symbols), U64)
    for k in range(ORDER):
        shifted = np.zeros(len(symbols), U64)
        shifted[k:] = symbols[: len(symbols) - k]
        shifted[place < k] = 0
        key |= shifted << U64(BITS * k)
    return key


def _chunks(rows: np.ndarray, size: int = 200) -> Iterator[np.ndarray]:
    for at in range(0, len(rows), size):
        yield rows[at : at + size]


class Model:
    def __init__(self, texts: pa.Array, langs: list[str]):
        self.langs = sorted(set(langs))
        if not self.langs:
            return
        lang = np.array([self.langs.index(x) for x in langs])
        held = np.zeros(len(langs), bool)  # for the calibration
        for k in range(len(self.langs)):
            own = np.flatnonzero(lang == k)
            if len(langs) >= 50 and len(own) >= HOLD:
                held[own[::5]] = True
        counts = np.zeros(sys.maxunicode + 1, np.int64)
        for part in _chunks(np.flatnonzero(~held)):
            low, _, _ = _folded(texts.take(pa.array(part)))
            points, n = np.unique(low, return_counts=True)
            counts[points] += n
        counts[0] = 0
        common = np.argsort(-counts, kind="stable")[:SYMBOLS]
        common = common[counts[common] > 0]
        self.code = np.full(sys.maxunicode + 1, SYMBOLS + 1, np.uint16)  # the last symbol: letters never seen
        self.code[common] = np.arange(1, len(common) + 1, dtype=np.uint16)
        self.code[0] = 0
        seen = []
        for k in range(len(self.langs)):
            keys, n = np.zeros(0, U64), np.zeros(0, np.int64)
            for part in _chunks(np.flatnonzero((lang == k) & ~held)):
                low, offsets, _ = _folded(texts.take(pa.array(part)))
                more, m = np.unique(_keys(self.code[low].astype(U64), offsets), return_counts=True)
                keys, at = np.unique(np.concatenate([keys, more]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n, m]), len(keys)).astype(np.int64)
            seen.append((keys, n))
        self._build(seen, len(common) + 2)
        self.weights, self.foreign = np.array([0.0, 8.0]), np.inf
        if held.any():
            entropy, n, has = [], [], []
            for part in _chunks(np.flatnonzero(held)):
                e, m, h = self._measured(texts.take(pa.array(part)))
                entropy.append(e), n.append(m), has.append(h)
            entropy, n, has = (np.concatenate(v) for v in (entropy, n, has))
            entropy, n, true = entropy[has], n[has], lang[held][has]
            right = entropy.argmin(axis=1) == true
            x = self._margins(entropy, n)
            self.weights = _curve(x, right.astype(float))
            self.foreign = float(np.quantile(entropy.min(axis=1)[right], 0.999)) * 1.25 if right.any() else np.inf

    def _build(self, seen: list[tuple[np.ndarray, np.ndarray]], vocabulary: int) -> None:
        """Interpolated Kneser-Ney: raw counts at the highest order, numbers of distinct left neighbours below."""
        n_langs = len(seen)
        counts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER + 1)]
        for keys, c in seen:
            counts[ORDER].append((keys, c.astype(np.float64)))
            for n in range(ORDER - 1, 0, -1):
                keys, c = np.unique(keys & _MASK[n], return_counts=True)
                counts[n].append((keys, c.astype(np.float64)))
        self.grams: list[tuple[HashArray, np.ndarray]] = []
        self.backs: list[tuple[HashArray, np.ndarray]] = []
        lower_keys, lower = np.zeros(1, U64), np.full((1, n_langs), 1.0 / vocabulary)
        for n in range(1, ORDER + 1):
            union = np.unique(np.concatenate([k for k, _ in counts[n]]))
            contexts = np.unique(union >> U64(BITS)) if n > 1 else np.zeros(1, U64)
            back = np.ones((len(contexts), n_langs))
            p = np.zeros((len(union), n_langs))
            of = np.searchsorted(contexts, union >> U64(BITS)) if n > 1 else np.zeros(len(union), np.int64)
            for k, (keys, c) in enumerate(counts[n]):
                one, two = (c == 1).sum(), (c == 2).sum()
                d = min(0.95, max(0.1, one / (one + 2 * two))) if one + two else 0.5
                at = np.searchsorted(union, keys)
                total = np.bincount(of[at], c, len(contexts))
                kinds = np.bincount(of[at], minlength=len(contexts))
                full = total > 0
                back[full, k] = d * kinds[full] / total[full]
                p[at, k] = np.maximum(c - d, 0) / total[of[at]]
            p += back[of] * lower[np.searchsorted(lower_keys, union & _MASK[n - 1])]
            for pairs, keys, values in ((self.grams, union, p), (self.backs, contexts, back)):
                h = keys * _SPREAD
                order = np.argsort(h)
                pairs.append((HashArray(h[order]), np.concatenate([np.log2(values[order]), np.zeros((1, n_langs))]).astype(np.float32)))
            lower_keys, lower = union, p
        self.floor = float(np.log2(1.0 / vocabulary))

    def _measured(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits per character of every text under every language, its length, and whether it has a letter."""
        low, offsets, has = _folded(texts)
        keys = _keys(self.code[low].astype(U64), offsets)
        bits = np.zeros((len(keys), len(self.langs)), np.float32)
        left = np.arange(len(keys))
        for n in range(ORDER, 0, -1):
            key = keys[left] & _MASK[n]
            arr, values = self.grams[n - 1]
            at, hit = arr.find(key * _SPREAD)
            bits[left[hit]] += values[at[hit]]
            left, key = left[~hit], key[~hit]
            if not len(left):
                break
            arr, values = self.backs[n - 1]
            at, hit = arr.find((key >> U64(BITS)) * _SPREAD)
            bits[left[hit]] += values[at[hit]]
        bits[left] += self.floor
        n = np.diff(offsets)
        return -kernel.sums(bits, offsets) / np.maximum(1, n)[:, None], n, has

    def _margins(self, entropy: np.ndarray, n: np.ndarray) -> np.ndarray:
        two = np.sort(entropy, axis=1)[:, :2]
        gap = two[:, 1] - two[:, 0] if two.shape[1] > 1 else np.full(len(two), 5.0)
        return np.stack([np.ones(len(gap)), gap * np.sqrt(np.minimum(n, 400))], axis=1)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, confidence, and whether the calibrated rejection would turn the text down."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        entropy, n, has = self._measured(texts)
        best = entropy.argmin(axis=1)
        sure = 1 / (1 + np.exp(-np.clip(self._margins(entropy, n) @ self.weights, -30, 30)))
        rejected = ~has | (sure < 0.5) | (entropy.min(axis=1) > self.foreign)
        return [self.langs[b] if h else "und" for b, h in zip(best, has, strict=True)], np.where(has, sure, 0.0), rejected


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Logistic curve through margins; the ridge keeps it finite when all are right."""
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(2), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -2, 2)
    return np.array([w[0], max(w[1], 0.0)])


def train(docs: DataFrame, docs_per_lang: int = DOCS, chars: int = CHARS) -> Model:
    """A model of the languages in ``docs.lang``; rows without text or lang teach nothing.

    Texts over ``chars`` characters are used only for a language that has no others, and of them the beginning.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    short = F.length("text") <= chars
    found = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(short.cast("long")).alias("short")).orderBy(F.desc("n"), "lang").limit(LANGS).collect()
    sizes = {r["lang"]: r["short"] or r["n"] for r in found}
    known = known.where(short | F.col("lang").isin([r["lang"] for r in found if not r["short"]])).withColumn("text", F.substring("text", 1, chars))
    docs_per_lang = max(1, min(docs_per_lang, ALL_DOCS // max(1, len(sizes))))
    if not sizes:
        return Model(pa.array([], pa.string()), [])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    below = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, int((1 << 20) * min(1.0, docs_per_lang / n)))])
    chosen = draw < F.coalesce(F.element_at(below, F.col("lang")), F.lit(0))
    rows = known.where(chosen).orderBy(F.xxhash64("doc_id", F.lit(1)), F.xxhash64("text")).limit(2 * docs_per_lang * len(sizes)).toArrow()
    return Model(rows.column("text").combine_chunks(), rows.column("lang").to_pylist())


def identify(docs: DataFrame, model: Model, keep: str = "doc_id") -> DataFrame:
    """``keep``, lang_pred, score and rejected for every row."""
    shared = workers_find_package(docs.sparkSession).sparkContext.broadcast(model)
    kind = docs.schema[keep].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in kernel.slices(batches):
            lang, sure, rejected = shared.value.predict(pc.fill_null(b.column("text"), ""))
            yield pa.RecordBatch.from_arrays([b.column(keep), pa.array(lang, pa.string()), pa.array(sure), pa.array(rejected)], [keep, "lang_pred", "score", "rejected"])

    return docs.select(keep, "text").mapInArrow(kernel.trimmed(run), f"`{keep}` {kind}, lang_pred string, score double, rejected boolean")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
