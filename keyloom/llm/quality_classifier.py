"""Quality classifier: heuristic labellers, a weak-label model over their votes, and a hashed linear scorer.

1. Overlapping heuristics vote good, bad or abstain on every document (``LABELLERS``: a measure, when it is bad, when it is good).
2. Documents with equal votes form a pattern; patterns are counted in Spark over all documents (at most 3 to the number of
   labellers, so the table is bounded). Expectation-maximisation over the counts estimates the share of good documents and, for
   each labeller, how often it votes good on good and on bad documents, under priors that it is better than chance.
3. The posteriors of a bounded sample (``TRAIN_DOCS`` documents of at most ``TRAIN_CHARS`` characters, chosen by a hash of doc_id)
   are the soft labels of a logistic scorer over hashed features: words, word shapes, and buckets of the measures.

Defined results: a null or empty text has no words and is scored by the measures of nothing; texts are measured whole; repeated
rows and null ids are scored like others; without documents to learn from every score is 0.5; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import kernel
from keyloom.llm.common import table, workers_find_package
from keyloom.llm.kernel import U64, HashArray
from keyloom.llm.quality_rules import STOP_WORDS

TRAIN_DOCS, TRAIN_CHARS, BUCKETS = 4_000, 50_000, 4096
#: Rows of the sample whose feature matrix is made at once.
MATRIX_ROWS = 250
#: Measure, (bad below, good from), (good up to, bad above); None: that side never votes.
LABELLERS = {
    "words": ((3, 50), (None, None)),
    "word_bytes": ((2.5, 3.0), (9.0, 13.0)),
    "symbols_per_word": ((None, None), (0.02, 0.1)),
    "shouted": ((None, None), (0.12, 0.4)),
    "exclaimed": ((None, None), (0.03, 0.2)),
    "repeated": ((None, None), (0.15, 0.5)),
    "dup_lines": ((None, None), (0.15, 0.5)),
    "top_word": ((None, None), (0.15, 0.3)),
    "distinct": ((0.15, 0.3), (None, None)),
    "stop_words": ((0.005, 0.05), (None, None)),
}
_NAMES = tuple(LABELLERS)
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>{}")] = True
_UPPER, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = ord("a")
_SHAPE[65:91], _SHAPE[48:58] = ord("A"), ord("0")


def _stop_hashes() -> HashArray:
    words = sorted({w for line in STOP_WORDS.values() for w in line.split()})
    data, offsets = kernel.buffers(pa.array(words))
    return HashArray(np.unique(kernel.hashes(data, offsets[:-1], offsets[1:])))


def _measured(col: pa.Array, stops: HashArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Measures of every document (columns as ``LABELLERS``), and for the features: word hashes, shape hashes, word offsets."""
    data, offsets = kernel.buffers(col)
    low = kernel.lowered(data)
    starts, ends, docs = kernel.spans(low, offsets)
    h = kernel.hashes(low, starts, ends)
    n = np.diff(docs)
    some = np.maximum(n, 1)
    count = lambda mask: kernel.sums(mask[: offsets[-1]].astype(np.int64), offsets)
    letters = np.maximum(count(_LETTER[data]), 1)
    tri, tri_at = kernel.shingles(h, docs, 3)
    l_starts, l_ends, lines = kernel.spans(low, offsets, _NEWLINE)
    line = kernel.hashes(low, l_starts, l_ends)
    distinct, top, repeated, dups = (np.zeros(len(n)) for _ in range(4))
    for i in range(len(n)):
        if n[i]:
            _, c = np.unique(h[docs[i] : docs[i + 1]], return_counts=True)
            # long texts repeat words by nature: the share of distinct words is held against its square-root growth
            distinct[i], top[i] = min(1.0, len(c) / n[i] * max(1.0, np.sqrt(n[i] / 200))), c.max() / n[i]
            own = tri[tri_at[i] : tri_at[i + 1]]
            u, c = np.unique(own, return_counts=True)
            if len(u) < len(own):
                repeated[i] = c[c > 1].sum() / len(own)
            own = line[lines[i] : lines[i + 1]]
            dups[i] = 1 - len(np.unique(own)) / max(1, len(own))
    exclaim = count(data == ord("!"))
    out = np.stack(
        [n, kernel.sums(ends - starts, docs) / some, count(_SYMBOL[data]) / some, count(_UPPER[data]) / letters, exclaim / some, repeated, dups, np.where(n >= 20, top, 0.1), np.where(n >= 20, distinct, 0.5), kernel.sums(stops.find(h)[1].astype(np.int64), docs) / some],
        axis=1,
    )
    shape = _SHAPE[data]
    fresh = np.ones(len(shape), bool)
    fresh[1:] = shape[1:] != shape[:-1]
    fresh[starts] = True
    moved = np.concatenate([[0], np.cumsum(fresh)])
    short = np.concatenate([shape[fresh], np.zeros(16, np.uint8)])
    return out, h, kernel.hashes(short, moved[starts], moved[ends]), docs


def votes(measures: np.ndarray) -> np.ndarray:
    """1 good, 0 bad, -1 abstained; documents by labellers."""
    out = np.full(measures.shape, -1, np.int8)
    for k, (low, high) in enumerate(LABELLERS.values()):
        x = measures[:, k]
        good = np.ones(len(x), bool)
        if low[0] is not None:
            out[x < low[0], k] = 0
            good &= x >= low[1]
        if high[0] is not None:
            out[x > high[1], k] = 0
            good &= x <= high[0]
        out[good, k] = 1
    return out


def weak_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float, np.ndarray]:
    """Posterior of good for each vote pattern, the share of good documents, and accuracies (votes good on good, on bad)."""
    cast, good = patterns >= 0, patterns == 1
    p = np.where((patterns == 0).any(axis=1), 0.1, 0.95)  # a labeller looks for one fault: its vote of bad counts first
    for _ in range(rounds):
        w = np.stack([p * counts, (1 - p) * counts])
        share = (w[0].sum() + 5) / (counts.sum() + 10)
        # Beta priors worth 50 documents: a labeller votes bad on one of fifty good documents, and on one of four bad ones
        rate = np.stack([(w[k] @ good + prior) / (w[k] @ cast + 50) for k, prior in enumerate((49.0, 37.5))])
        log = [np.where(cast, np.where(good, np.log(r), np.log(1 - r)), 0).sum(axis=1) for r in rate]
        new = 1 / (1 + np.exp(np.clip(log[1] + np.log(1 - share) - log[0] - np.log(share), -50, 50)))
        if np.abs(new - p).max(initial=0) < 1e-7:
            break
        p = new
    return p, float(share), rate


def _bucket(h: np.ndarray) -> np.ndarray:
    return (kernel.mix(h) >> U64(52)).astype(np.int64)


def _step(measures: np.ndarray, k: int) -> np.ndarray:
    """The bucket of each document's measure ``k``, cut into steps of half a power of two."""
    return _bucket((np.floor(np.log2(measures[:, k] + 2.0**-7) * 2).astype(np.int64) + 64 + 1000 * (k + 1)).astype(U64))


class Scorer:
    """Hashed linear model; the bucket of a feature is the top bits of its hash."""

    def __init__(self) -> None:
        self.stops = _stop_hashes()
        self.weights = np.zeros(BUCKETS + 1)

    def features(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Feature matrix (documents by buckets, a constant last) and measures."""
        measures, h, shape, docs = _measured(texts, self.stops)
        n = len(docs) - 1
        doc = np.repeat(np.arange(n), np.diff(docs))
        size = np.maximum(np.diff(docs), 1)
        x = np.zeros(n * BUCKETS)
        for values, salt in ((h, 1), (shape, 2)):
            x += np.bincount(doc * BUCKETS + _bucket(values + U64(salt)), 3.0 / size[doc], n * BUCKETS)
        x = x.reshape(n, BUCKETS)
        for k in range(measures.shape[1]):
            x[np.arange(n), _step(measures, k)] += 1.0
        return np.concatenate([x, np.ones((n, 1))], axis=1).astype(np.float32), measures

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 300, ridge: float = 1e-4) -> None:
        """Logistic regression on soft labels by accelerated gradient descent."""
        w = look = np.zeros(x.shape[1], np.float32)
        rate = np.float32(4.0 / max(1e-6, float((x * x).sum(axis=1).mean()) * 1.5))
        for t in range(1, rounds + 1):
            p = 1 / (1 + np.exp(-np.clip(x @ look, -30, 30)))
            new = look - rate * (x.T @ (p - y).astype(np.float32) / len(y) + ridge * look)
            look, w = new + (t - 1) / (t + 2) * (new - w), new
        self.weights = w

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Scores and measures; the sums over a text's features are taken without the matrix, so memory follows the texts."""
        measures, h, shape, docs = _measured(texts, self.stops)
        w, size = np.asarray(self.weights, np.float64), np.maximum(np.diff(docs), 1)
        z = np.full(len(docs) - 1, w[-1])
        for values, salt in ((h, 1), (shape, 2)):
            z += kernel.sums(w[_bucket(values + U64(salt))], docs) * 3.0 / size
        for k in range(measures.shape[1]):
            z += w[_step(measures, k)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), measures


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[Scorer, dict[str, float]]:
    """The scorer, and the posterior of every vote pattern."""
    spark = workers_find_package(docs.sparkSession)
    stops = _stop_hashes()

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in kernel.slices(batches):
            v = votes(_measured(b.column("text"), stops)[0])
            yield pa.RecordBatch.from_arrays([pa.array(_names(v), pa.string())], ["pattern"])

    counted = docs.select("text").mapInArrow(kernel.trimmed(cast), "pattern string").groupBy("pattern").count().collect()  # at most 3 to the power of the labellers
    scorer = Scorer()
    if not counted:
        return scorer, {}
    names = [r["pattern"] for r in counted]
    patterns = np.array([[{"b": 0, "g": 1, "-": -1}[c] for c in x] for x in names], np.int8)
    posterior, _, _ = weak_labels(patterns, np.array([r["count"] for r in counted], float))
    known = dict(zip(names, posterior.tolist(), strict=True))
    n = sum(r["count"] for r in counted)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, train_docs / n))
    sample = docs.where(draw & (F.length("text") <= TRAIN_CHARS)).select("doc_id", "text").orderBy(F.xxhash64("doc_id", F.lit(1)), F.xxhash64("text")).limit(train_docs).toArrow()
    if sample.num_rows:
        batches = (b.slice(at, MATRIX_ROWS) for b in kernel.slices(iter(sample.combine_chunks().to_batches())) for at in range(0, b.num_rows, MATRIX_ROWS))
        parts = [scorer.features(b.column("text")) for b in batches]
        x, measures = (np.concatenate(v) for v in zip(*parts, strict=True))
        scorer.fit(x, np.array([known[p] for p in _names(votes(measures))]))
    return scorer, known


def _names(v: np.ndarray) -> list[str]:
    return ["".join(x) for x in np.array(["b", "g", "-"])[v].tolist()]


def classify(docs: DataFrame, scorer: Scorer, known: dict[str, float], keep: str = "doc_id") -> DataFrame:
    """``keep``, score (0 to 1, higher is better), weak_label (the labellers' posterior alone) and kept (score of 0.5 or more)."""
    shared = workers_find_package(docs.sparkSession).sparkContext.broadcast((scorer, known))
    kind = docs.schema[keep].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, known = shared.value
        for b in kernel.slices(batches, limit=1_000_000):
            score, measures = scorer.scores(b.column("text"))
            weak = [known.get(p, 0.5) for p in _names(votes(measures))]
            yield pa.RecordBatch.from_arrays([b.column(keep), pa.array(score), pa.array(weak), pa.array(score >= 0.5)], [keep, "score", "weak_label", "kept"])

    return docs.select(keep, "text").mapInArrow(kernel.trimmed(run), f"`{keep}` {kind}, score double, weak_label double, kept boolean")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, *train(docs))
