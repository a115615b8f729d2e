"""Toxicity by a convolutional text classifier (operator 10).

A word's vector is the sum of the hashed vectors of the word and of its first five and seven bytes. Filters over one, two
and three neighbouring words are max-pooled over the whole text into a logistic output, trained in numpy by stochastic
gradient descent on a bounded sample of labelled rows. On rows kept apart from that sample, a threshold is calibrated for
each language, which is guessed from function words of the text itself; scores are shifted so that it falls on 0.5.

A trained filter is a table by hashed word, so scoring a text is looking up and adding. Null and empty texts get the
score of no evidence; without labelled rows every score is 0; duplicated ids are scored row by row; equally likely languages
are the first of the list; very long texts are scored whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .learn import Adagrad, best_cut, held_out, sigmoid, taught

BITS, DIM, FILTERS, WIDTHS, EPOCHS, RATE, SEED, THRESHOLD = 15, 12, 8, (1, 2, 3), 5, 0.05, 11, 0.5
HEADS = (5, 7)
#: Frequent function words, for the language of a text.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it with as was on are this",
    "de": "der die und in den von zu das mit sich des auf ist im nicht ein eine",
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas",
    "es": "de la que el en y a los del se las por un para con no una su al",
}
LANGUAGES = (*FUNCTION_WORDS, "other")


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of the word and its heads, 64-bit word hash, row); letters are lower-cased, up to five signs at the end fall off."""
    s, e, row = C.words(buf, off)
    low = C.LOWER[buf]
    edge = np.zeros(256, bool)
    edge[list(b".,;:!?\"'()%&$#*|")] = True
    for _ in range(5):
        e = e - ((e - s > 1) & edge[low[e - 1]]) if len(e) else e
    p = C.prefix_hash(low)
    h = C.span_hash(p, s, e)
    ids = [h] + [C.mix(C.span_hash(p, s, np.minimum(e, s + n)) + C.U64(n)) for n in HEADS]
    return np.stack([(x >> C.U64(64 - BITS)).astype(np.int32) for x in ids], axis=1), h, row


def language_table() -> tuple[np.ndarray, np.ndarray]:
    pairs = []
    for k, ws in enumerate(FUNCTION_WORDS.values()):
        for w in ws.split():
            b = np.frombuffer(w.encode(), np.uint8)
            pairs.append((int(C.span_hash(C.prefix_hash(b), np.array([0]), np.array([len(b)]))[0]), k))
    keys = np.array(sorted({h for h, _ in pairs}), C.U64)
    votes = np.zeros((len(keys), len(LANGUAGES)), np.float32)
    for h, k in pairs:
        votes[np.searchsorted(keys, C.U64(h)), k] += 1
    return keys, votes / votes.sum(axis=1, keepdims=True)


def languages(h: np.ndarray, row: np.ndarray, n: int, table) -> np.ndarray:
    """The guessed language's place in LANGUAGES for each of n rows."""
    keys, votes = table
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    hit = keys[at] == h
    count = np.stack([np.bincount(row[hit], votes[at[hit], k], minlength=n) for k in range(len(LANGUAGES))], axis=1)
    count[:, -1] = 0.5
    return count.argmax(axis=1)


class Network:
    def __init__(self):
        r = np.random.default_rng(SEED)
        self.vec = (r.standard_normal((1 << BITS, DIM)) * 0.1).astype(np.float32)
        self.conv = {k: (r.standard_normal((k, DIM, FILTERS)) * 0.3).astype(np.float32) for k in WIDTHS}
        self.shift = {k: np.zeros(FILTERS, np.float32) for k in WIDTHS}
        self.out = np.abs(r.standard_normal(FILTERS * len(WIDTHS)) * 0.3).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    def pooled(self, ids: np.ndarray):
        """Filter maxima, where they are, and the word vectors of one text."""
        x = self.vec[ids].sum(axis=1)
        value, at = [], []
        for k in WIDTHS:
            n = len(x) - k + 1
            if n < 1:
                value.append(np.zeros(FILTERS, np.float32))
                at.append(None)
                continue
            z = sum(x[j : n + j] @ self.conv[k][j] for j in range(k)) + self.shift[k]
            i = z.argmax(axis=0)
            at.append(i)
            value.append(np.maximum(z[i, np.arange(FILTERS)], 0))
        return np.concatenate(value), at, x

    def learn(self, ids: np.ndarray, y: int, weight: float, opt: Adagrad) -> None:
        v, at, x = self.pooled(ids)
        err = np.float32(weight * (sigmoid(v @ self.out + self.bias[0]) - y))
        back = err * self.out * (v > 0)
        opt.step("out", self.out, err * v)
        np.maximum(self.out, 0, out=self.out)  # filters find evidence for, so that a short text has the least
        opt.step("bias", self.bias, np.array([err], np.float32))
        rows, grads = [], []
        for i, k in enumerate(WIDTHS):
            if at[i] is None:
                continue
            g = back[i * FILTERS : (i + 1) * FILTERS]
            gc = np.zeros_like(self.conv[k])
            for j in range(k):
                gc[j] = (x[at[i] + j] * g[:, None]).T
                rows.append(ids[at[i] + j])
                grads.append(self.conv[k][j].T * g[:, None])
            opt.step(f"conv{k}", self.conv[k], gc)
            opt.step(f"shift{k}", self.shift[k], g)
        if rows:
            r, g = np.concatenate(rows), np.concatenate(grads)
            u, inv = np.unique(r.ravel(), return_inverse=True)
            total = np.zeros((len(u), DIM), np.float32)
            np.add.at(total, inv.reshape(r.shape).ravel(), np.repeat(g, r.shape[1], axis=0))
            opt.step("vec", self.vec, total, u)

    def tables(self):
        """For each width and place: what each hashed word adds to the filters."""
        return {k: [self.vec @ self.conv[k][j] for j in range(k)] for k in WIDTHS}, self.shift, self.out, float(self.bias[0])


def log_odds(ids: np.ndarray, row: np.ndarray, n: int, tables) -> np.ndarray:
    look, shift, out, bias = tables
    pooled = np.zeros((n, FILTERS * len(WIDTHS)), np.float32)
    for i, k in enumerate(WIDTHS):
        m = len(ids) - k + 1
        if m < 1:
            continue
        inside = np.flatnonzero(row[:m] == row[k - 1 :])
        if not len(inside):
            continue
        z = np.zeros((len(inside), FILTERS), np.float32)
        for j in range(k):
            for h in range(ids.shape[1]):
                z += look[k][j][ids[inside + j, h]]
        r = row[inside]
        first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        pooled[r[first], i * FILTERS : (i + 1) * FILTERS] = np.maximum(np.maximum.reduceat(z, first, axis=0) + shift[k], 0)
    return pooled @ out + bias


def fit(rows: list[tuple[bytes, int]]):
    """(tables, thresholds by language)."""
    r = np.random.default_rng(SEED)
    table, data = language_table(), []
    for body, y in rows:
        buf = np.frombuffer(body, np.uint8)
        ids, h, row = tokens(buf, np.array([0, len(buf)]))
        data.append((ids, int(y), int(languages(h, row, 1, table)[0])))
    keep = [i for i in range(len(data)) if i % 5 or len(data) < 200]
    apart = [i for i in range(len(data)) if i % 5 == 0 or len(data) < 200]
    ones = [i for i in keep if data[i][1] == 1]
    zeros = [i for i in keep if data[i][1] == 0]
    net, opt = Network(), Adagrad(RATE)
    if ones and zeros:
        for _ in range(EPOCHS):
            seen = zeros + list(r.choice(ones, max(len(ones), len(zeros) // 3)))
            for i in r.permutation(seen):
                net.learn(data[i][0], data[i][1], 1.0, opt)
    tables = net.tables()
    z = np.array([log_odds(data[i][0], np.zeros(len(data[i][0]), np.int64), 1, tables)[0] for i in apart])
    y, lang = np.array([data[i][1] for i in apart]), np.array([data[i][2] for i in apart])
    whole = best_cut(z, y, alike=False) if len(set(y.tolist())) == 2 else 0.0
    cuts = np.full(len(LANGUAGES), whole)
    for k in range(len(LANGUAGES)):
        own = lang == k
        few = min(y[own].sum(), (1 - y[own]).sum())
        if few >= 5:
            trust = few / (few + 20)  # with few cases, most of the common threshold stays
            cuts[k] = trust * best_cut(z[own], y[own], alike=False) + (1 - trust) * whole
    return tables, cuts


def score_texts(docs: DataFrame, model, text: str = "text", key: str = "doc_id") -> DataFrame:
    told = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        table = language_table()
        for batch in batches:
            buf, off = C.flat(batch.column(1))
            out = np.zeros(len(batch))
            if told.value is not None:
                tables, cuts = told.value
                for lo, hi in C.pieces(off):
                    ids, h, row = tokens(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                    z = log_odds(ids, row, hi - lo, tables)
                    out[lo:hi] = sigmoid(z - cuts[languages(h, row, hi - lo, table)])
            yield pa.record_batch([batch.column(0), pa.array(out)], [key, "score"])

    return C.short_batches(docs).select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    rows = taught(docs, labels, label, text, key)
    scored = score_texts(docs, fit(rows) if rows else None, text, key)
    return scored.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
