import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from verdantia.llm import collocations as C

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "text string, lang string, phrase string, n long, k string"


def phrases_of(rows):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    return f, n


def by_hand(rows, least, top):
    f, n = phrases_of(rows)
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = []
    for lang in {k for k, _ in cand}:
        own = []
        for (la, w), a in cand.items():
            if la != lang:
                continue
            inside = any(q == lang and len(v) > len(w) and 100 * b >= 100 * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (q, v), b in cand.items())
            if not inside:
                score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
                own.append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(own)[:top])]
    return sorted(out)


def rows(n, seed):
    r = random.Random(seed)
    fixed = ["as a matter of fact", "New York", "san francisco bay area", "été à la mer", "to be or not to be that is it", "x y x y x y x y"]
    words = [f"w{i}" for i in range(25)] + ["the", "of", "é", "\x00", "日本"]
    text = lambda: "".join((r.choice(fixed) if r.random() < 0.3 else r.choice(words)) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " "]) for _ in range(r.randrange(60)))
    out = [(text(), r.choice(["en", "en", "fr", None])) for _ in range(n)]
    copy = text()
    return out + [(copy, "en")] * 40 + [(None, "en"), ("", None), (".,;", "fr"), ("the " * 60_000 + "end", "de"), ("one. two", "xx"), ("Same same same same same same same", "und")]


def found(spark, data, **more):
    df = C.mine(spark.createDataFrame([(*r, "z", 1, "q") for r in data], SCHEMA).repartition(5), **more)
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, df.collect()))


def test_against_brute_force(spark):
    data = rows(120, 1)
    assert found(spark, data, least=6, top=40) == by_hand(data, 6, 40)


def test_saturated_bitmap_and_low_threshold(spark, monkeypatch):
    monkeypatch.setattr(C, "MANY", 6)
    monkeypatch.setattr(C, "FEW", 6)
    data = rows(40, 2)
    assert found(spark, data, least=2, top=10_000) == by_hand(data, 2, 10_000)


def test_empty_table(spark):
    assert C.mine(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("mod", [1, 2, 7, 1 << 40])
def test_every_phrase_is_in_one_chunk(monkeypatch, mod):
    monkeypatch.setattr(C, "MOD", mod)
    data = rows(60, 3)
    batch = pa.RecordBatch.from_pylist([{"lang": "und" if la is None else la, "text": t or ""} for t, la in data])
    freq = Counter()
    for b in C.parse([batch]):
        freq.update(tuple(r.values()) for r in b.to_pylist())
    chunks = pa.RecordBatch.from_pylist([{"lang": a, "owned": o, "chunk": c, "freq": n} for (a, o, c), n in freq.items()])
    got = Counter()
    for b in C.counts((1, 2, 3, 4, 5), None, 0)([chunks]):
        for r in b.to_pylist():
            got[r["lang"], tuple(r["phrase"].split(" "))] += r["f"]
    assert got == phrases_of(data)[0]


def test_equal_passages_share_chunks():
    r = random.Random(5)
    passage = " ".join(f"p{r.randrange(50)}" for _ in range(600))
    texts = [f"{' '.join(f'q{r.randrange(10**6)}' for _ in range(r.randrange(9)))} {passage}" for _ in range(50)]
    batch = pa.RecordBatch.from_pylist([{"lang": "en", "text": t} for t in texts])
    freq = Counter(tuple(x.values()) for b in C.parse([batch]) for x in b.to_pylist())
    assert sum(n for n in freq.values() if n == 50) > 0.8 * sum(freq.values())


def test_products_beyond_64_bits(spark):
    a, l, r, n = 9 * 10**11, 10**12, 95 * 10**10, 8 * 10**14
    found = spark.createDataFrame([("en", "u v", a), ("en", "u", l), ("en", "v", r)], "lang string, phrase string, f long")
    row = C.scored(found, spark.createDataFrame([("en", n)], "lang string, n long"), 5).first()
    assert row.score == 1000 * a * n // (l * r)
