import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdantia.llm import language_id as L
from verdantia.llm import quality as Q
from verdantia.llm import toxicity as T

BIG = "/root/testdata/sf0.01"


def is_held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def accuracy(found, labels, column):
    rows = found.join(labels, "doc_id").filter("held_out").select("predicted", column, "score").collect()
    return np.mean([r.predicted == r[column] for r in rows])


@pytest.mark.parametrize("run,column,least", [(Q.op4_quality, "quality", 0.95), (T.op10_toxicity, "toxic", 0.85)])
def test_held_out_accuracy(spark, run, column, least):
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    found = run(spark, BIG).cache()
    rows = found.collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == is_held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    assert accuracy(found, labels, column) >= least


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    rows = L.op6_language_id(spark, BIG).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert np.mean([r.lang == r.lang_pred for r in rows if r.held_out]) >= 0.98
    assert all(r.held_out == is_held(r.doc_id) for r in rows)


def small(spark):
    r = random.Random(2)
    vocab = [f"{a}{b}" for a in ("ba", "ko", "ti", "ru") for b in ("ne", "ma", "lo")]
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = [r.choice(vocab) for _ in range(r.randint(5, 60))]
        if bad:
            w[r.randrange(len(w))] = r.choice(["grobblix", "grobbler"])
        docs.append((i, " ".join(w), "xx" if i % 2 else "yy", "s"))
        labels.append((i, int(not bad), int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learns_a_planted_word(spark):
    docs, labels = small(spark)
    assert accuracy(T.toxicity(docs, labels), labels, "toxic") >= 0.97


def test_held_out_labels_teach_nothing(spark):
    docs, labels = small(spark)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = labels.select("doc_id", F.when(fold, 1 - F.col("quality")).otherwise(F.col("quality")).alias("quality"), F.when(fold, 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("toxic"))
    for run in (Q.quality, T.toxicity):
        assert sorted(run(docs, labels).collect()) == sorted(run(docs, flipped).collect())


def test_odd_rows(spark):
    docs, labels = small(spark)
    odd = spark.createDataFrame([(None, "a b"), (-1, None), (-2, ""), (-2, ""), (-3, " \t"), (-4, "123 !!"), (-5, "é" * 5000)], "doc_id long, text string")
    for run in (Q.quality, T.toxicity):
        got = run(docs.select("doc_id", "text").unionByName(odd), labels).filter("doc_id is null or doc_id < 0").collect()
        assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
        assert run(odd.limit(0), labels).count() == 0
        assert run(odd, labels.limit(0)).count() == 7
    model = L.learn_languages(docs)
    got = {(r.doc_id, r.lang_pred) for r in L.predict(odd, model).collect()}
    assert {(-1, "und"), (-2, "und"), (-3, "und"), (-4, "und")} <= got
    assert {x for _, x in got} <= {"xx", "yy", "und"} and dict(got)[-5] != "und"
    assert [r.lang_pred for r in L.predict(odd, None).collect()] == ["und"] * 7


def test_backpropagation_matches_differences():
    """Gradients through time against finite differences of the loss."""
    r = np.random.default_rng(0)
    net = L.Network(3)
    x, size, y = r.integers(97, 105, (5, 4)), np.array([4, 3, 4, 1, 2]), np.array([0, 1, 2, 1, 0])
    mask = (np.arange(4) < size[:, None]).astype(np.float32)

    def loss():
        z = net.states(x, mask)[0].astype(np.float64) @ net.out + net.bias
        p = np.exp(z - z.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        return -(np.log(p[np.arange(5), :, y]) * mask).sum() / mask.sum()

    class Catch:
        def __init__(self):
            self.seen = {}

        def step(self, name, value, grad, rows=None):
            self.seen[name] = grad

    got = Catch()
    net.learn(x, size, y, got)
    for name, part in (("aheadback", net.ahead.back), ("behindlook", net.behind.look), ("aheadbias", net.ahead.bias), ("out", net.out)):
        spots = [(100, 3), (101, 20)] if name == "behindlook" else [(2, 1), (5, 2)] if part.ndim == 2 else [(3,), (40,)]
        for s in spots:
            keep, e = part[s], 1e-2
            part[s] = keep + e
            up = loss()
            part[s] = keep - e
            down = loss()
            part[s] = keep
            assert got.seen[name][s] == pytest.approx((up - down) / (2 * e), rel=0.05, abs=2e-4)


def plain_shares(net, text: bytes):
    """One byte at a time, in plain floats: both layers over their stretch with its warm-up, probabilities summed."""

    def run(layer, body):
        h, out = [0.0] * L.HIDDEN, []
        for b in body:
            a = layer.look[b].astype(float) + layer.bias
            g = [1 / (1 + np.exp(-(a[j] + sum(h[i] * layer.back[i, j] for i in range(L.HIDDEN))))) for j in range(2 * L.HIDDEN)]
            z, r = g[: L.HIDDEN], g[L.HIDDEN :]
            n = [np.tanh(a[2 * L.HIDDEN + j] + sum(r[i] * h[i] * layer.back[i, 2 * L.HIDDEN + j] for i in range(L.HIDDEN))) for j in range(L.HIDDEN)]
            h = [h[i] + z[i] * (n[i] - h[i]) for i in range(L.HIDDEN)]
            out.append(h)
        return out

    total = np.zeros(len(net.bias))
    for lo in range(0, len(text), L.CORE):
        hi = min(len(text), lo + L.CORE)
        before, after = max(0, lo - L.WARM), hi if hi == len(text) else min(len(text), hi + L.WARM)
        ahead = run(net.ahead, text[before:hi])[lo - before :]
        behind = run(net.behind, text[lo:after][::-1])[::-1][: hi - lo]
        for b, f, g in zip(text[lo:hi], ahead, behind):
            if chr(b) not in " \t\n\v\f\r":
                p = np.exp(np.concatenate([f, g]) @ net.out + net.bias)
                total += p / p.sum()
    return total


def test_stretches_match_a_plain_network():
    """Texts below, at and above the limits of stretches, read together, against one byte at a time."""
    net = L.Network(3)
    net.out *= 20
    r = np.random.default_rng(5)
    texts = [bytes(r.choice([97, 98, 99, 32, 195, 169], n).astype(np.uint8)) for n in (1, 0, 40, L.CORE - 1, L.CORE, L.CORE + 1, L.CORE + L.WARM + 5, 2 * L.CORE + 3)]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = L.shares(net, np.frombuffer(b"".join(texts), np.uint8), off)
    for row, text in zip(got, texts):
        assert row == pytest.approx(plain_shares(net, text), rel=1e-4, abs=1e-4)


def test_language_of_very_long_texts_and_other_columns(spark):
    docs, _ = small(spark)
    model = L.learn_languages(docs)
    long = spark.createDataFrame([(1, "né" * 400_000, "a", 5), (1, "né" * 400_000, "b", 6), (2, "1 " * 300_000, "c", 7)], "doc_id long, text string, rest string, LANG_PRED int")
    got = L.predict(long, model).orderBy("doc_id", "rest").collect()
    assert [r.rest for r in got] == ["a", "b", "c"] and "LANG_PRED" not in got[0].asDict()
    assert got[0].lang_pred == got[1].lang_pred != "und" and got[0].score == got[1].score and got[2].lang_pred == "und"
    assert L.predict(long.limit(0), model).count() == 0
