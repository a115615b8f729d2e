"""Text quality by supervised subword embeddings (operator 4).

Words and character 3- and 4-grams are hashed to vectors; a document is their average, and a softmax layer on it gives
the class. Vectors and layer are trained together by stochastic gradient descent in numpy on a bounded sample of labelled
rows; a fifth of it is kept apart to move the bias so that the cut with the fewest errors scores the threshold. As the
average and the layer are linear, a trained model is one number per hashed feature, and a whole text, however long, is
scored by summing them in its task.

Null and empty texts get the score of the bias alone; without labelled rows every score is 0.5; duplicated ids are scored
row by row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .learn import Adagrad, best_cut, held_out, sigmoid, taught

BITS, DIM, EPOCHS, RATE, SEED, THRESHOLD = 17, 8, 4, 0.05, 7, 0.3
GRAMS = (3, 4)


def grams(buf: np.ndarray, n: int) -> np.ndarray:
    """The hashed byte n-grams of buf, n at most 4."""
    if len(buf) < n:
        return np.zeros(0, np.int64)
    x = np.zeros(len(buf) - n + 1, np.uint32)
    for j in range(n):
        x |= buf[j : len(buf) - n + 1 + j].astype(np.uint32) << np.uint32(8 * j)
    x *= np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77 + 2 * n)
    return (x >> np.uint32(32 - BITS)).astype(np.int64)


def word_ids(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, and a feature of its own for each word that repeats the one before; and their rows."""
    s, e, row = C.words(buf, off)
    h = C.span_hash(C.prefix_hash(buf), s, e)
    again = np.flatnonzero((h[1:] == h[:-1]) & (row[1:] == row[:-1]))
    return np.concatenate([(h >> C.U64(64 - BITS)).astype(np.int64), np.zeros(len(again), np.int64)]), np.concatenate([row, row[again]])


def features(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(distinct feature, its share of the average) of one text."""
    buf = np.frombuffer(body, np.uint8)
    ids = np.concatenate([word_ids(buf, np.array([0, len(buf)]))[0], *(grams(buf, n) for n in GRAMS)])
    u, c = np.unique(ids, return_counts=True)
    return u, (c / max(1, len(ids))).astype(np.float32)


def train(rows: list[tuple[bytes, int]], classes: int = 2):
    """(vectors, layer, bias) of the softmax classifier."""
    r = np.random.default_rng(SEED)
    vec = r.uniform(-0.5, 0.5, (1 << BITS, DIM)).astype(np.float32) / DIM
    layer, bias = np.zeros((DIM, classes), np.float32), np.zeros(classes, np.float32)
    layer += r.uniform(-0.5, 0.5, layer.shape).astype(np.float32)
    data = [(*features(b), int(y)) for b, y in rows]
    opt = Adagrad(RATE)
    for _ in range(EPOCHS):
        for i in r.permutation(len(data)):
            u, share, y = data[i]
            h = share @ vec[u] if len(u) else np.zeros(DIM, np.float32)
            z = h @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1.0
            back = layer @ p
            opt.step("layer", layer, np.outer(h, p))
            opt.step("bias", bias, p)
            if len(u):
                opt.step("vec", vec, np.outer(share, back), u)
    return vec, layer, bias


def scalars(model) -> tuple[np.ndarray, float]:
    """What each feature adds to the log odds of class 1, and the bias."""
    vec, layer, bias = model
    return (vec @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def fit(rows: list[tuple[bytes, int]], threshold: float) -> tuple[np.ndarray, float]:
    keep = [x for i, x in enumerate(rows) if i % 5 or len(rows) < 200]
    apart = [x for i, x in enumerate(rows) if i % 5 == 0 or len(rows) < 200]
    table, bias = scalars(train(keep))
    y = np.array([int(y) for _, y in apart])
    if 0 < y.sum() < len(y):
        z = [float(log_odds(np.frombuffer(b, np.uint8), np.array([0, len(b)]), table, bias)[0]) for b, _ in apart]
        bias += np.log(threshold / (1 - threshold)) - best_cut(np.array(z), y)
    return table, bias


def sums_by_row(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
    return upto[np.maximum(end, start)] - upto[start]


def log_odds(buf: np.ndarray, off: np.ndarray, table: np.ndarray, bias: float) -> np.ndarray:
    w, row = word_ids(buf, off)
    total = np.bincount(row, table[w], minlength=len(off) - 1).astype(np.float64)
    count = np.bincount(row, minlength=len(off) - 1).astype(np.float64)
    for n in GRAMS:
        x = table[grams(buf, n)]
        end = np.maximum(off[1:] - n + 1, off[:-1])
        end = np.where(off[1:] - off[:-1] < n, off[:-1], end)
        total += sums_by_row(x, np.minimum(off[:-1], len(x)), np.minimum(end, len(x)))
        count += end - off[:-1]
    return total / np.maximum(count, 1) + bias


def score_texts(docs: DataFrame, model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score) of every row: the probability of class 1."""
    told = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            buf, off = C.flat(batch.column(1))
            out = np.full(len(batch), 0.5)
            if told.value is not None:
                for lo, hi in C.pieces(off):
                    out[lo:hi] = sigmoid(log_odds(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], *told.value))
            yield pa.record_batch([batch.column(0), pa.array(out)], [key, "score"])

    return C.short_batches(docs).select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, score double")


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    rows = taught(docs, labels, label, text, key)
    scored = score_texts(docs, fit(rows, threshold) if rows else None, text, key)
    return scored.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
