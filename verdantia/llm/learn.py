"""What the trained classifiers share: which rows may teach, and a bounded sample of them for the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled texts that a model is fitted on, at most. The only bound here: scoring covers every text.
SAMPLE = 4000
#: Bytes of the sampled texts that reach the driver, at most, and of one text; rows come in the order of a hash of their id.
SAMPLE_BYTES, TEXT_BYTES = 40_000_000, 1_000_000


def held_out(key: str = "doc_id") -> Column:
    """The fifth of rows that no model learns from; rows without an id are among them."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def taught(docs: DataFrame, labels: DataFrame, label: str, text: str = "text", key: str = "doc_id", most: int = SAMPLE) -> list[tuple[bytes, object]]:
    """(text, label) of at most `most` ids that may teach, in the order of a hash of the id.

    A repeated id teaches once, with its smallest label and text. Texts above TEXT_BYTES, and those that would pass
    SAMPLE_BYTES together, teach nothing; later ones still do.
    """
    ids = labels.select(F.col(key), F.col(label).alias("label")).filter(F.col("label").isNotNull()).filter(~held_out(key))
    order = F.xxhash64(key, F.lit("sample"))
    ids = ids.groupBy(key).agg(F.min("label").alias("label")).withColumn("place", order).orderBy("place", key).limit(most)
    body = docs.select(F.col(key), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("body")).filter(F.length("body") <= TEXT_BYTES)
    # `most` bounds the ids, so they may be broadcast, and what comes back of them is small
    rows = body.join(F.broadcast(ids), key).groupBy("place", key, "label").agg(F.min("body").alias("body"))
    sizes = rows.select("place", key, F.length("body").alias("size")).orderBy("place", key).collect()
    held, pick = 0, []
    for r in sizes:
        if held + r["size"] <= SAMPLE_BYTES:
            held += r["size"]
            pick.append((r[key],))
    if not pick:
        return []
    told = docs.sparkSession.createDataFrame(pick, docs.select(key).schema)
    rows = rows.join(F.broadcast(told), key, "left_semi").orderBy("place", key)
    return [(bytes(r.body), r.label) for r in rows.select("body", "label").collect()]


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def best_cut(z: np.ndarray, y: np.ndarray, alike: bool = True) -> float:
    """Midpoint of the gap with the fewest errors, the widest of equals; alike: classes weigh the same, else rows do."""
    order = np.argsort(z)
    z, y = z[order], y[order]
    pos, neg = (max(1, y.sum()), max(1, (1 - y).sum())) if alike else (1, 1)
    cost = np.concatenate([[0], np.cumsum(y)]) / pos + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]]) / neg
    ends = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    gap = np.diff(ends)
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    i = best[gap[best].argmax()]
    return float((ends[i] + ends[i + 1]) / 2)


class Adagrad:
    """Per-value steps for arrays, whole or by rows."""

    def __init__(self, rate: float):
        self.rate, self.seen = rate, {}

    def step(self, name: str, x: np.ndarray, grad: np.ndarray, rows=None) -> None:
        g2 = self.seen.setdefault(name, np.full(x.shape, 1e-8, x.dtype))
        if rows is None:
            g2 += grad * grad
            x -= self.rate * grad / np.sqrt(g2)
        else:  # rows are distinct
            g2[rows] += grad * grad
            x[rows] -= self.rate * grad / np.sqrt(g2[rows])
