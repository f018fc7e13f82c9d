"""Toxicity: maximum-scoring segments over token log-odds, calibrated by extreme-value statistics.

1. Tokens are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. A token's features are its
   prefixes of 4 to 8 bytes and itself. Each feature's share of toxic documents has a mixture of two Dirichlet priors centred on
   the share of the next shorter prefix, so an unseen token inherits what is known of its stem, and a feature needs several toxic
   documents before it counts. The score of a token is the log-odds of that share against the base rate, less a drift that makes
   ordinary text lose.
2. A linear-time scan finds every maximal-scoring segment of a text.
3. The largest segment of clean texts follows a Gumbel distribution whose mode grows with the logarithm of the text's
   length. It turns a segment's score into a p-value; the evidence of a text (its best segment and all significant ones) goes
   through a logistic curve without negative weights, fitted on documents measured by counts that left them out.

The model is fitted in one task from a bounded sample of labelled rows (``TRAIN_DOCS`` documents of each class, of at most
``TRAIN_CHARS`` characters) and broadcast; its size is bounded by that sample, and no text comes to the driver. Every text is scored whole.

Defined results: a null or empty text has no token and gets the score of no evidence; without any label (or with one class
only) every score is the share of toxic labels (0 without labels); null ids and repeated rows are scored like any other row;
extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import kernel
from keyloom.llm.common import table, workers_find_package
from keyloom.llm.kernel import U64, HashArray

TRAIN_DOCS, TRAIN_CHARS = 3_000, 20_000
PREFIXES = (4, 5, 6, 7, 8)
#: Weights in documents of the two Dirichlet priors, and the share of features that the loose one is for.
TIGHT, LOOSE, OWN = 200.0, 1.0, 0.03
DRIFT, SIGNIFICANT, FOLDS = 0.8, 0.01, 4
#: A document of this score or more is toxic, in the query as in the pipeline.
TOXIC = 0.3
_APART = np.ones(256, bool)
_APART[128:] = False
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _APART[_c] = False
_WHOLE = U64(0xA5A5A5A5A5A5A5A5)


class _Tokens:
    """The tokens of some texts; features are made one level at a time, from the shortest prefix to the whole token."""

    levels = len(PREFIXES) + 1

    def __init__(self, col: pa.Array):
        data, offsets = kernel.buffers(col)
        self.data = kernel.lowered(data)
        self.starts, self.ends, self.docs = kernel.spans(self.data, offsets, _APART)

    def __len__(self) -> int:
        return len(self.starts)

    def level(self, i: int) -> np.ndarray:
        """Feature hashes at this level; 0 where a token is too short for it."""
        if i == len(PREFIXES):
            return kernel.hashes(self.data, self.starts, self.ends) ^ _WHOLE
        long = self.ends - self.starts >= PREFIXES[i]
        h = np.zeros(len(self), U64)
        h[long] = kernel.hashes(self.data, self.starts[long], self.starts[long] + PREFIXES[i])
        return h


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """Every maximal-scoring segment as (score, start, end), by the linear scan of Ruzzo and Tompa."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    left: list[float] = []
    right: list[float] = []
    begin: list[int] = []
    end: list[int] = []
    link: list[int] = []
    for i in np.flatnonzero(scores > 0).tolist():
        low, high, first = float(total[i]), float(total[i + 1]), i
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= low:
                j = link[j]
            if j < 0 or right[j] >= high:
                left.append(low), right.append(high), begin.append(first), end.append(i + 1), link.append(j)
                break
            low, first = left[j], begin[j]
            del left[j:], right[j:], begin[j:], end[j:], link[j:]
    return [(r - l, b, e) for l, r, b, e in zip(left, right, begin, end, strict=True)]


class Model:
    """Sorted feature hashes with log-odds; Gumbel parameters; logistic weights."""

    def __init__(self, texts: pa.Array, toxic: np.ndarray, share: float | None = None):
        """``share``: of toxic rows among all labelled ones, if the sample was drawn at other rates."""
        self.share = share if share is not None else float(toxic.mean()) if len(toxic) else 0.0
        self.keys, self.odds = HashArray(np.zeros(0, U64)), np.zeros(1)
        self.mode, self.scale, self.weights = 0.0, 1.0, None
        if 0 < toxic.sum() < len(toxic):
            self._fit(texts, toxic.astype(bool))

    def _fit(self, texts: pa.Array, toxic: np.ndarray) -> None:
        fold = np.zeros(len(texts), np.int64)  # every document is measured by counts that leave its fold out
        for kind in (True, False):
            fold[toxic == kind] = np.arange((toxic == kind).sum()) % FOLDS
        measured = []
        for k in range(FOLDS):
            own = fold == k
            if own.any() and 0 < toxic[~own].sum() < (~own).sum():
                self._count(texts.filter(pa.array(~own)), toxic[~own])
                measured.append((np.flatnonzero(own), *self._measured(_Tokens(texts.filter(pa.array(own))))))
        self._count(texts, toxic)
        if not measured:
            return
        rows, best, n = (np.concatenate([m[k] for m in measured]) for k in (0, 1, 3))
        every = [x for m in measured for x in m[2]]
        toxic = toxic[rows]
        clean = ~toxic & (best > 0)
        x = best[clean]
        if len(x) > 1:  # a Gumbel distribution by its quartiles: a few wrongly labelled documents must not stretch it
            self.scale = max(0.2, float(np.subtract(*np.quantile(x, [0.75, 0.25]))) / (np.log(np.log(4)) - np.log(np.log(4 / 3))))
            self.mode = float(np.median(x - self.scale * np.log(np.maximum(n[clean], 1)))) + np.log(np.log(2)) * self.scale
        drawn = toxic.mean()
        weight = np.where(toxic, self.share / max(drawn, 1e-9), (1 - self.share) / max(1 - drawn, 1e-9))
        self.weights = _logistic(self._evidence(best, every, n), toxic, weight)

    def _count(self, texts: pa.Array, toxic: np.ndarray) -> None:
        """The log-odds of every feature against the base rate; only those that differ from their prior stay."""
        tokens = _Tokens(texts)
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(tokens.docs))
        base = float(toxic.mean())
        keys, odds = [], []
        prior_of = np.full(len(doc), base)  # of each token: the share of its longest known shorter prefix
        for level in range(_Tokens.levels):
            h = tokens.level(level)
            order = np.argsort(h, kind="stable").astype(np.int32)[int((h == 0).sum()) :]  # stable, and tokens are in the order of documents
            hh, dd = h[order], doc[order]
            once = np.concatenate([[True], (hh[1:] != hh[:-1]) | (dd[1:] != dd[:-1])])[: len(hh)]
            order, hh, dd = order[once], hh[once], dd[once]
            del once
            first = np.flatnonzero(np.concatenate([[True], hh[1:] != hh[:-1]])[: len(hh)])
            if not len(first):
                continue
            prior = prior_of[order[first]]
            share = _share(np.add.reduceat(toxic[dd].astype(float), first), np.diff(np.concatenate([first, [len(hh)]])), prior)
            odd = _logit(share) - _logit(base)
            known = np.abs(odd - _logit(prior) + _logit(base)) > 0.02
            keys.append(hh[first][known])
            odds.append(odd[known])
            del order, hh, dd
            at, hit = HashArray(keys[-1]).find(h)
            hit &= h != 0
            prior_of[hit] = share[known][at[hit]]
        if keys:
            key, odd = np.concatenate(keys), np.concatenate(odds)
            order = np.argsort(key)
            self.keys, self.odds = HashArray(key[order]), np.concatenate([odd[order], [0.0]])

    def _measured(self, tokens: _Tokens) -> tuple[np.ndarray, list[list[float]], np.ndarray]:
        """Best segment and all segments' scores of every document, and the number of tokens."""
        score, docs = np.full(len(tokens), -DRIFT), tokens.docs
        for level in range(_Tokens.levels):  # the longest known feature decides
            h = tokens.level(level)
            at, hit = self.keys.find(h)
            hit &= h != 0
            score[hit] = self.odds[at[hit]] - DRIFT
        some = kernel.sums((score > 0).astype(np.int64), docs)
        every = [[s for s, _, _ in segments(score[docs[i] : docs[i + 1]])] if some[i] else [] for i in range(len(docs) - 1)]
        return np.array([max(x, default=0.0) for x in every]), every, np.diff(docs)

    def _p(self, s: np.ndarray, n: np.ndarray) -> np.ndarray:
        """P-value of a segment of score ``s`` in a text of ``n`` tokens."""
        return -np.expm1(-np.exp(np.clip(-(s - self.mode - self.scale * np.log(np.maximum(n, 1))) / self.scale, -700, 30)))

    def _evidence(self, best: np.ndarray, every: list[list[float]], n: np.ndarray) -> np.ndarray:
        """A constant, the surprise of the best segment, and that of all significant ones together; both grow with every toxic passage."""
        top = np.where(best > 0, np.minimum(-np.log10(np.maximum(self._p(best, n), 1e-30)), 12), 0.0)
        more = np.zeros(len(best))
        for i, x in enumerate(every):
            if x:
                p = self._p(np.array(x), np.full(len(x), n[i]))
                more[i] = np.log1p(np.sum(-np.log10(np.maximum(p[p < SIGNIFICANT], 1e-30))))
        return np.stack([np.ones(len(best)), top, more], axis=1)

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.share)
        x = self._evidence(*self._measured(_Tokens(texts)))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def _logit(p: np.ndarray | float) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function of positive numbers, by Stirling's series beyond 8."""
    below, y = np.zeros(np.shape(x)), np.asarray(x, float)
    for _ in range(8):
        below, y = below + np.log(y), y + 1
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - below


def _share(k: np.ndarray, n: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Share of toxic documents among those with a feature, ``k`` of ``n`` seen, under a mixture of two Dirichlet priors around ``prior``:
    most features keep close to it (``TIGHT``), a few go their own way (``LOOSE``)."""
    prior = np.clip(prior, 1e-6, 1 - 1e-6)

    def seen(weight: float) -> np.ndarray:
        a, b = weight * prior, weight * (1 - prior)
        return _lgamma(a + b) - _lgamma(a) - _lgamma(b) + _lgamma(a + k) + _lgamma(b + n - k) - _lgamma(a + b + n)

    own = 1 / (1 + np.exp(np.clip(seen(TIGHT) - seen(LOOSE) - np.log(OWN / (1 - OWN)), -50, 50)))
    return own * (k + LOOSE * prior) / (n + LOOSE) + (1 - own) * (k + TIGHT * prior) / (n + TIGHT)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of a logistic curve, none but the constant's below 0."""
    used = list(range(x.shape[1]))
    while True:
        z, w = x[:, used], np.zeros(len(used))
        penalty = np.diag([1e-6] + [ridge] * (len(used) - 1))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ z + penalty, z.T @ (weight * (y - p)) - penalty @ w)
            w += np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-6:
                break
        if len(used) == 1 or w[1:].min() >= 0:
            out = np.zeros(x.shape[1])
            out[used] = w
            return out
        del used[1 + int(np.argmin(w[1:]))]


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> Model:
    """A model from about ``train_docs`` labelled documents of each class at most, chosen by a hash of doc_id."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    draw, chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)), F.lit(False)
    for kind, count in sorted(n.items()):
        chosen = chosen | ((F.col("toxic") == kind) & (draw < int((1 << 20) * min(1.0, train_docs / count))))
    part = known.where(chosen).limit(4 * train_docs)
    text = docs.where(F.col("text").isNotNull() & (F.length("text") <= train_chars)).select("doc_id", "text")
    rows = text.join(F.broadcast(part), "doc_id").orderBy(F.xxhash64("doc_id", F.lit(1)), F.xxhash64("text")).limit(2 * train_docs).select("text", F.col("toxic").cast("int").alias("toxic"))
    share = n.get(1, 0) / max(1, sum(n.values()))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = pa.Table.from_batches(batches, pa.schema([("text", pa.string()), ("toxic", pa.int32())])).combine_chunks()  # bounded, in one partition
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(_fitted(sample, share))]})

    workers_find_package(docs.sparkSession)
    made = rows.mapInArrow(kernel.trimmed(fit), "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else Model(pa.array([], pa.string()), np.zeros(0, np.int64), share)


def _fitted(sample: pa.Table, share: float) -> Model:
    text = sample.column("text")
    return Model(text.combine_chunks() if text.num_chunks != 1 else text.chunk(0), sample.column("toxic").to_numpy().astype(np.int64), share)


def score(docs: DataFrame, model: Model, keep: str = "doc_id") -> DataFrame:
    """``keep`` and ``score`` of every row."""
    shared = workers_find_package(docs.sparkSession).sparkContext.broadcast(model)
    kind = docs.schema[keep].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in kernel.slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(keep), pa.array(shared.value.scores(b.column("text")))], [keep, "score"])

    return docs.select(keep, "text").mapInArrow(kernel.trimmed(run), f"`{keep}` {kind.simpleString()}, score double")


def filtered(docs: DataFrame, model: Model, toxic: float) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``toxic``."""
    shared = workers_find_package(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in kernel.slices(batches):
            yield b.filter(pa.array(shared.value.scores(b.column("text")) < toxic))

    return docs.mapInArrow(kernel.trimmed(run), docs.schema)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))
