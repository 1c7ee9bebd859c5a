"""A quality classifier: random-indexing word vectors pooled per document, then a two-layer network in numpy.

Every word and every word ending has a bucket by its hash, and every bucket a fixed sparse ternary index vector. One pass
over all texts adds up, per bucket, the index vectors of the neighbouring words: the bucket's word vector. A document is
the mean of its words' index and word vectors, and of the products of neighbouring words' index vectors, which stand for
word order and runs of one word. The network is fitted on the driver on at most ``MAX_LABELLED`` labelled
documents (those with the least hashes of their ids); a part of them, kept from the fit, sets the temperature of its
probabilities. The word vectors (``BUCKETS`` x ``DIM`` numbers) and the weights are of fixed size, so they are broadcast.

Defined cases: a null or empty text has a zero vector and is scored; repeated rows are scored each; of several texts of
one labelled id the one with the least hash teaches; rows without a label,
with a null one, or with labels that disagree teach nothing; with fewer than two classes among the labels every score is
the share of label 1 (0.5 without labels); an empty table gives an empty one; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .storage import stored

BUCKETS, DIM, REACH, ENDING = 1 << 13, 32, 2, 3
MAX_LABELLED, HIDDEN, EPOCHS, BATCH, RATE, DECAY = 20_000, 32, 30, 128, 2e-3, 1e-4
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1
FEATURES = 5 * DIM
#: Words of zero vector that every document is given, so a few words make no extreme mean.
PRIOR = 8


def index_vectors() -> np.ndarray:
    """Sparse ternary vectors, the same in every run."""
    rng = np.random.default_rng(7)
    return rng.choice(np.array([-1, 0, 1], np.int8), (BUCKETS, DIM), p=[0.1, 0.8, 0.1])


def _buckets(chunk: W.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of each word and of its ending."""
    values = W._BYTE_VALUES[chunk.bytes]
    words = W.span_hashes(values, chunk.starts, chunk.ends)
    endings = W.mix(W.span_hashes(values, np.maximum(chunk.starts, chunk.ends - ENDING), chunk.ends) + np.uint64(1))
    return (words % np.uint64(BUCKETS)).astype(np.int64), (endings % np.uint64(BUCKETS)).astype(np.int64)


def _neighbours(index: np.ndarray, words: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Sum of the index vectors of the words within reach, in the same document."""
    own = index[words].astype(np.int32)
    out = np.zeros_like(own)
    for step in range(1, REACH + 1):
        same = (docs[step:] == docs[:-step])[:, None]
        out[step:] += own[:-step] * same
        out[:-step] += own[step:] * same
    return out


def _add(totals: np.ndarray, buckets: np.ndarray, rows: np.ndarray) -> None:
    order = np.argsort(buckets, kind="stable")
    ranked = buckets[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    totals[ranked[first]] += np.add.reduceat(rows[order], first, axis=0)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task, the sums of each bucket it has seen."""
    index, totals = index_vectors(), np.zeros((BUCKETS, DIM), np.int64)
    for batch in batches:
        for chunk in W.chunks(batch.column(0)):
            if len(chunk.starts):
                words, endings = _buckets(chunk)
                around = _neighbours(index, words, chunk.word_docs())
                _add(totals, words, around)
                _add(totals, endings, around)
    seen = np.flatnonzero(totals.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), *[pa.array(totals[seen, d]) for d in range(DIM)]],
                                     names=["bucket", *[f"d{d}" for d in range(DIM)]])


def word_vectors(texts: DataFrame) -> np.ndarray:
    """Unit word vectors of all buckets, from all texts (one column): BUCKETS x DIM numbers."""
    sums = W.small_batches(texts).mapInArrow(_gather, "bucket int, " + ", ".join(f"d{d} long" for d in range(DIM)))
    rows = sums.groupBy("bucket").agg(*[F.sum(f"d{d}").alias(f"d{d}") for d in range(DIM)]).toPandas()
    out = np.zeros((BUCKETS, DIM), np.float32)
    found = rows[[f"d{d}" for d in range(DIM)]].to_numpy(np.float64)
    out[rows["bucket"].to_numpy()] = found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)
    return out


def pooled(chunk: W.Chunk, index: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """FEATURES numbers per document: the means of its words' vectors and of the products of neighbours."""
    out = np.zeros((chunk.n_docs, FEATURES), np.float32)
    some = np.flatnonzero(np.diff(chunk.first_word))
    if len(some):
        words, endings = _buckets(chunk)
        counts = np.diff(chunk.first_word)[some][:, None] + PRIOR
        for i, (table, which) in enumerate(((index, words), (index, endings), (vectors, words), (vectors, endings))):
            sums = np.add.reduceat(table[which], chunk.first_word[some], axis=0, dtype=np.float32)
            out[some, i * DIM:(i + 1) * DIM] = sums / counts
        own = index[words]
        pairs = np.zeros_like(own)
        pairs[1:] = own[1:] * own[:-1]
        pairs[chunk.first_word[some]] = 0
        out[some, 4 * DIM:] = np.add.reduceat(pairs, chunk.first_word[some], axis=0, dtype=np.float32) / counts
    return out


@dataclass
class Network:
    """Standardizing, one hidden layer, a probability at a temperature."""

    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.center) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, calibration: np.ndarray) -> Network:
    """Fit on the rows outside ``calibration``, then set the temperature on those inside."""
    rng, train = np.random.default_rng(11), ~calibration
    if len(np.unique(y[train])) < 2:  # nothing to tell apart
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
        return Network(np.zeros(FEATURES), np.ones(FEATURES), np.zeros((FEATURES, HIDDEN)), np.zeros(HIDDEN),
                       np.zeros(HIDDEN), float(np.log(share / (1 - share))))
    tx, ty = x[train].astype(np.float64), y[train].astype(np.float64)
    center, scale = tx.mean(axis=0), np.maximum(tx.std(axis=0), 1e-3)
    tx = (tx - center) / scale
    params = [rng.normal(0, (2 / FEATURES) ** 0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN),
              rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(ty))
        for a in range(0, len(order), BATCH):
            rows = order[a:a + BATCH]
            hidden = np.maximum(tx[rows] @ params[0] + params[1], 0)
            gap = 1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3], -30, 30))) - ty[rows]
            gap /= len(rows)
            back = np.outer(gap, params[2]) * (hidden > 0)
            slopes = [tx[rows].T @ back + DECAY * params[0], back.sum(axis=0), hidden.T @ gap + DECAY * params[2],
                      np.array([gap.sum()])]
            step += 1
            for p, g, m, v in zip(params, slopes, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    net = Network(center, scale, params[0], params[1], params[2], float(params[3][0]))
    if calibration.any():
        raw, truth = net.logits(x[calibration].astype(np.float64)), y[calibration]
        tries = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        losses = [np.mean(np.logaddexp(0, np.where(truth == 1, -raw, raw) / t)) for t in tries]
        net.temperature = float(tries[int(np.argmin(losses))])
    return net


def _features(vectors):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, table = index_vectors(), vectors.value
        for batch in batches:
            for chunk in W.chunks(batch.column(0)):
                rows = batch.slice(chunk.first_row, chunk.n_docs)
                x = pooled(chunk, index, table)
                offsets = np.arange(0, x.size + 1, FEATURES, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(1), rows.column(2), pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))],
                    names=["fold", "label", "x"])

    return run


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors()
        vectors, net = model.value
        for batch in batches:
            for chunk in W.chunks(batch.column(1)):
                rows = batch.slice(chunk.first_row, chunk.n_docs)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(net.scores(pooled(chunk, index, vectors)))], names=["_id", "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality"
          ) -> tuple[np.ndarray, Network]:
    """Word vectors from all texts, and a network from labelled documents outside the held-out fold."""
    spark = docs.sparkSession
    vectors = word_vectors(docs.select(text))
    given = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    key = F.col("_labelled").cast("string").cast("binary")
    agreed = labels.select(F.col(doc_id).alias("_labelled"), F.col(label).cast("int").alias("label")).filter(
        "label in (0, 1) and _labelled is not null").groupBy("_labelled").agg(
        F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other")
    chosen = stored(agreed.select("_labelled", "label", (F.crc32(key) % FOLDS).alias("fold"))
                    .filter(F.col("fold") != HELD_OUT).orderBy(F.md5(key), "_labelled").limit(MAX_LABELLED), "labelled")
    rows = given.join(F.broadcast(chosen), given["_id"] == chosen["_labelled"]).groupBy("_labelled", "fold", "label").agg(
        F.min(F.struct(F.md5(F.col("_text").cast("binary")).alias("h"), "_text")).alias("least")).select(
        F.col("least._text").alias("_text"), "fold", "label")  # one text per id, so at most MAX_LABELLED rows
    found = rows.mapInArrow(_features(spark.sparkContext.broadcast(vectors)),
                            "fold long, label int, x array<float>").toPandas()
    x = np.stack(found["x"].to_numpy()) if len(found) else np.empty((0, FEATURES), np.float32)
    order = np.lexsort((*x.T[:4], found["label"].to_numpy()))  # the same fit whatever the order of arrival
    x, y = x[order], found["label"].to_numpy()[order]
    return vectors, fit(x, y, found["fold"].to_numpy()[order] == CALIBRATION)


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
          threshold: float = 0.3) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (probability of label 1) and ``predicted`` of every document."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, doc_id, text, label))
    kind = docs.schema[doc_id].dataType.simpleString()
    scored = W.small_batches(docs.select(F.col(doc_id).alias("_id"), text)).mapInArrow(
        _scorer(model), f"_id {kind}, score double")
    fold = F.crc32(F.coalesce(F.col("_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    return scored.select(F.col("_id").alias(doc_id), (fold == HELD_OUT).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
