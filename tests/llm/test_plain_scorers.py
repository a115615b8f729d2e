"""The classifiers' scores, and the stages of the pipeline that change texts, against plain Python."""

import re

import numpy as np
import pytest

import corpus_pipeline as P
from tests.llm import test_suffix_dedup as suffix
from verdantia.llm import common as C
from verdantia.llm import quality as Q
from verdantia.llm import toxicity as T

FULL = (1 << 64) - 1
TEXTS = ["", " \t\n", "one", "one one two", "Été à Paris, été!", "x" * 7, "a b c d e f", "The THE the.", "word!?,.;:,", "(quoted) \"so\"", "é" * 40, "ab " * 50_000, "日本 語 語"]


def mixed(x):
    x ^= x >> 31
    x = x * int(C.MIX_A) & FULL
    x ^= x >> 29
    x = x * int(C.MIX_B) & FULL
    return x ^ (x >> 32)


def hashed(word: bytes) -> int:
    return mixed(sum((b + 1) * pow(C.BASE, k, 1 << 64) for k, b in enumerate(word)) & FULL)


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", text.encode())


def joined(texts):
    body = [t.encode() for t in texts]
    return np.frombuffer(b"".join(body), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in body])])


def plain_quality(text, table, bias):
    """The mean over words, repeats and character n-grams of what each adds."""
    w, body = words(text), text.encode()
    spots = [hashed(x) >> (64 - Q.BITS) for x in w] + [0 for a, b in zip(w, w[1:]) if a == b]
    for n in Q.GRAMS:
        for i in range(len(body) - n + 1):
            x = int.from_bytes(body[i : i + n], "little") * 0x9E3779B1 & 0xFFFFFFFF
            x = (x ^ (x >> 15)) * (0x85EBCA77 + 2 * n) & 0xFFFFFFFF
            spots.append(x >> (32 - Q.BITS))
    return sum(float(table[i]) for i in spots) / max(1, len(spots)) + bias


def test_quality_scores_match_a_plain_scorer():
    table = np.random.default_rng(1).standard_normal(1 << Q.BITS).astype(np.float32)
    got = Q.log_odds(*joined(TEXTS), table, 0.25)
    assert got == pytest.approx([plain_quality(t, table, 0.25) for t in TEXTS], abs=1e-5)


def plain_toxicity(text, net):
    """Filters over the sums of word and head vectors, their largest values, one layer."""
    vectors = []
    for w in words(text):
        w = bytes(b + 32 if 65 <= b <= 90 else b for b in w)
        for _ in range(5):
            if len(w) > 1 and w[-1:] in b".,;:!?\"'()%&$#*|":
                w = w[:-1]
        spots = [hashed(w)] + [mixed((hashed(w[:n]) + n) & FULL) for n in T.HEADS]
        vectors.append(sum(net.vec[s >> (64 - T.BITS)].astype(float) for s in spots))
    pooled = []
    for k in T.WIDTHS:
        for f in range(T.FILTERS):
            seen = [sum(float(vectors[i + j] @ net.conv[k][j][:, f]) for j in range(k)) + float(net.shift[k][f]) for i in range(len(vectors) - k + 1)]
            pooled.append(max(0.0, *seen) if seen else 0.0)
    return float(np.dot(pooled, net.out)) + float(net.bias[0])


def test_toxicity_scores_match_a_plain_scorer():
    net = T.Network()
    r = np.random.default_rng(2)
    net.bias[:] = -0.5
    for k in T.WIDTHS:
        net.shift[k] = r.standard_normal(T.FILTERS).astype(np.float32)
    texts = [t if len(t) < 10_000 else t[:1500] for t in TEXTS]
    buf, off = joined(texts)
    ids, _, row = T.tokens(buf, off)
    got = T.log_odds(ids, row, len(texts), net.tables())
    assert got == pytest.approx([plain_toxicity(t, net) for t in texts], abs=1e-4)
    long = joined(["ab " * 400_000])
    ids, _, row = T.tokens(*long)
    assert T.log_odds(ids, row, 1, net.tables())[0] == pytest.approx(plain_toxicity("ab ab ab ab", net), abs=1e-4)


def test_toxicity_finds_the_toxic(spark):
    """Recall, precision and area under the curve on held-out rows, where a guess of 'never' has recall 0 and area 0.5."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = T.op10_toxicity(spark, "/root/testdata/sf0.1").filter("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    bad, good = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    hit = sum(r.predicted for r in rows if r.toxic)
    assert len(bad) > 50 and hit / len(bad) >= 0.8 and hit / sum(r.predicted for r in rows) >= 0.85
    order = np.argsort(np.argsort(np.array(bad + good)))
    assert (order[: len(bad)].sum() - len(bad) * (len(bad) - 1) / 2) / (len(bad) * len(good)) >= 0.92


def removed(texts):
    """What is left of texts, as bytes: each byte in a 200-byte string that starts anywhere else too goes."""
    seen = {}
    for i, t in enumerate(texts):
        for at in range(len(t) - 199):
            seen.setdefault(t[at : at + 200], []).append((i, at))
    gone = [np.zeros(len(t), bool) for t in texts]
    for spots in seen.values():
        if len(spots) > 1:
            for i, at in spots:
                gone[i][at : at + 200] = True
    return gone


def test_passages_go_exactly_and_characters_stay_whole(spark):
    """The stage drops what the brute force drops, and besides that at most the rest of a character that was cut."""
    passage = "Ein Satz für alle Dokumente, der überall wörtlich steht und lang genug ist. " * 4
    texts = {1: "Anfang. " + passage + "Ende eins é.", 2: passage, 3: "ö" + passage + "ü", 4: "nichts davon " * 9, 5: "x" * 900, 6: "é" * 300, 7: ""}
    docs = spark.createDataFrame([(k, t, "de", "s", len(t)) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in P.repeated_passages(spark, docs, "").collect()}
    ids = sorted(texts)
    for k, gone in zip(ids, removed([texts[i].encode() for i in ids])):
        body = np.frombuffer(texts[k].encode(), np.uint8)
        rest = body[~gone].tobytes().decode("utf-8", "ignore")
        if not gone.any():
            assert got[k].text == texts[k]
        elif rest:
            assert got[k].text == rest and got[k].n_chars == len(rest)
        else:
            assert k not in got
    assert suffix.brute([texts[4].encode()], 200)[0][1] == int(removed([texts[4].encode()])[0].sum())


def test_mixture_takes_what_the_schedule_says(spark, sf):
    from verdantia.llm import mixing

    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("n_chars < 4000").dropDuplicates(["doc_id"])
    taken = {r.doc_id: (r.taken, r["size"]) for r in mixing.mix(docs).collect()}
    count = {}
    for r in P.mixture(spark, docs, sf).select("doc_id").collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert set(count.values()) <= {1, 2}
    # whole documents are repeated, so the stage gives at most the rest of the documents at the ends of sources more
    words = sum(n for n, _ in taken.values())
    mixed = sum(c * taken[k][1] for k, c in count.items())
    assert words <= mixed <= words + 2 * sum(sorted((s for _, s in taken.values()), reverse=True)[:40])
