"""A quality classifier with supervised subword embeddings.

A document is the average of the vectors of its features: words, pairs of neighbouring words and the strings of GRAMS
characters (blanks among them, for layout and punctuation tell quality too), hashed into buckets. A softmax over the average gives the label. Vectors and weights are learned by plain stochastic gradient
descent in numpy on the driver, over a bounded hash sample of labelled rows outside the held-out fold (``Settings.rows``
documents, whole texts). Only the text is looked at.

Since the output is linear in the average, each bucket's contribution to the difference of both logits is one
number. Executors get that table (``Settings.buckets`` floats, a fixed size) and score whole texts in Arrow batches.

Defined cases: null is the empty text; a text without features scores the prior; a null id is never in the held-out
fold and never used to learn; rows without a label (or a null one) are scored and not learned from; of several
labels of one id the largest counts, of several texts the smallest is learned from; repeated rows are scored one by one; without any label of either class the
score is the share of label 1 seen, or 0.5; other columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import wordbytes as wb

GRAMS = (3, 5)
FOLDS = 5


@dataclass(frozen=True)
class Settings:
    """rows: labelled documents to learn from at most; buckets: a power of two."""

    rows: int = 5000
    buckets: int = 1 << 16
    dim: int = 12
    epochs: int = 6
    rate: float = 0.3
    #: Steps of the vectors over those of the weights: a feature's part in an average is small.
    boost: float = 60.0
    seed: int = 11
    threshold: float = 0.3


def held_out(key: Column) -> Column:
    """The fold that is never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def features(c: wb.Chunk, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of each kind of feature, in order of document, and where each document's begin."""
    mask = np.uint64(buckets - 1)
    words = c.word_hashes()
    yield words & mask, c.word_at
    inside = np.flatnonzero(wb.runs_inside(c.word_at, 2, len(words)))
    yield wb.runs(words, 2)[inside] & mask, np.searchsorted(inside, c.word_at)
    # characters, blanks among them: where each begins, and its document
    start = np.flatnonzero((c.data & 0xC0) != 0x80)
    end = np.append(start[1:], len(c.data))
    doc = np.searchsorted(c.offsets, start, "right")
    for size in GRAMS:
        n = len(start) - size + 1
        if n > 0:
            held = np.flatnonzero(doc[:n] == doc[size - 1 :])
            first = start[held]
            yield wb.mixed(c.span_hashes(first, end[held + size - 1]) + np.uint64(size)) & mask, np.searchsorted(first, c.offsets)


class Model:
    """What scoring needs: a number for each bucket, and the bias."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table, bias

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = []
        for i, j in wb.chunks(offsets):
            c = wb.Chunk(data[offsets[i] : offsets[j]], offsets[i : j + 1])
            total, n = np.zeros(c.n_docs), np.zeros(c.n_docs, np.int64)
            for bucket, at in features(c, len(self.table)):
                sums = np.concatenate([[0.0], np.cumsum(self.table[bucket], dtype=np.float64)])
                total += np.diff(sums[at])
                n += np.diff(at)
            out.append(total / np.maximum(n, 1))
        raw = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(raw + self.bias, -30, 30)))


def learned(texts: pa.Array, labels: np.ndarray, s: Settings) -> Model:
    """Fits the vectors; see the module's text."""
    ones = float(labels.mean()) if len(labels) else 0.5
    prior = float(np.log(max(ones, 1e-3) / max(1 - ones, 1e-3)))
    if not len(labels) or ones in (0.0, 1.0):
        return Model(np.zeros(s.buckets, np.float32), prior)
    data, offsets = wb.text_bytes(texts)
    docs: list[tuple[np.ndarray, np.ndarray]] = []
    for i, j in wb.chunks(offsets):
        c = wb.Chunk(data[offsets[i] : offsets[j]], offsets[i : j + 1])
        kinds = list(features(c, s.buckets))
        bucket = np.concatenate([b for b, _ in kinds])
        doc = np.concatenate([np.repeat(np.arange(c.n_docs), np.diff(at)) for _, at in kinds])
        key, n = np.unique(doc * s.buckets + bucket.astype(np.int64), return_counts=True)
        at = np.searchsorted(key, np.arange(c.n_docs + 1) * s.buckets)
        for d in range(c.n_docs):
            part = slice(at[d], at[d + 1])
            docs.append((key[part] % s.buckets, (n[part] / max(1, n[part].sum())).astype(np.float32)))
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1 / s.dim, 1 / s.dim, (s.buckets, s.dim)).astype(np.float32)
    weights = rng.uniform(-1, 1, (2, s.dim)).astype(np.float32)
    bias = np.array([0, prior], np.float32)
    steps, step = s.epochs * len(docs), 0
    for _ in range(s.epochs):
        for d in rng.permutation(len(docs)).tolist():
            rate = s.rate * (1 - step / steps)
            step += 1
            ids, share = docs[d]
            mean = share @ vectors[ids]
            logits = weights @ mean + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[d]] -= 1
            back = weights.T @ p
            weights -= rate * np.outer(p, mean)
            bias -= rate * 0.1 * p
            vectors[ids] -= rate * s.boost * share[:, None] * back
    return Model((vectors @ (weights[1] - weights[0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Learns from at most ``s.rows`` labelled documents outside the held-out fold."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(label).alias("label"))
    chosen = known.where(~held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").limit(s.rows)
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label")).select("text", "label", F.xxhash64("id").alias("h"))
    t = rows.toArrow().sort_by([("h", "ascending"), ("text", "ascending")])
    return learned(t.column("text").combine_chunks() if t.num_rows else pa.array([], pa.string()), t.column("label").to_numpy().astype(np.int64), s)


def scored(docs: DataFrame, model: Model, s: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(*wb.text_bytes(b.column(1))))], names=[key, "score"])

    rows = docs.select(F.col(key), F.col(text).cast("string"))
    out = rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")
    return out.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= s.threshold).cast("int").alias("predicted"))
