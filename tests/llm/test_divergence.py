import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from verdantia.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, least, top):
    docs, counts, groups = Counter(), defaultdict(Counter), set()
    for text, lang, source in ((t or "", la or "", s or "") for t, la, s in rows):
        terms = TERM.findall(text.translate(LOW))
        groups.add((lang, source))
        docs.update({(lang, t) for t in terms})
        counts[lang, source].update(terms)
        counts[lang].update(terms)
    kept = defaultdict(list)
    for (lang, t), n in docs.items():
        if n >= least:
            kept[lang].append(t)
    p = lambda key, lang, t: 1 + 10**9 * (counts[key][t] + 5) // (sum(counts[key][x] for x in kept[lang]) + 5 * len(kept[lang]))
    out = []
    for lang, source in groups:
        apart = sorted((-sum(abs(p((lang, source), lang, t) - p((lang, o), lang, t)) for t in kept[lang]), o) for la, o in groups if la == lang and o != source)
        out += [(lang, source, "pair", o, -v, i + 1) for i, (v, o) in enumerate(apart)]
        high = sorted((p(lang, lang, t) - p((lang, source), lang, t), t.encode()) for t in kept[lang] if counts[lang, source][t])
        out += [(lang, source, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(high[:top]) if v < 0]
    return sorted(out)


def rows(n, seed):
    r = random.Random(seed)
    words = ["the", "The", "été", "naïve", "x1y", "don't", "日本", "z"] + [f"{a}{b}" for a in "abcdefgh" for b in "ijklm"]
    out = [(" ".join(r.choices(words, weights=[9] * 8 + [1] * 40, k=r.randrange(30))), r.choice(["en", "fr", None]), r.choice(["a", "b", "c", None, "hot", "hot", "hot"])) for _ in range(n)]
    out += [(None, "en", "a"), ("", "xx", None), ("only once", "yy", "q"), ("?", "yy", "r"), ("same same", "en", "tie1"), ("same same", "en", "tie2"), ("\x00A\tÀ{b}", "en", "a"), ("long " * 200_000, "fr", "big")]
    return out


SCHEMA = "text string, lang string, source string, term string, n long, slot long"


def found(spark, data, **more):
    df = D.audit(spark.createDataFrame([(*r, "x", 1, 2) for r in data], SCHEMA).repartition(5), **more)
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, df.collect()))


def test_whole_audit(spark):
    data = rows(150, 1)
    assert found(spark, data, least=3, top=7) == by_hand(data, 3, 7)


def test_many_shards_passes_and_tiles(spark, monkeypatch):
    data = rows(120, 2)
    monkeypatch.setattr(D, "SOURCE_TILE", 2)
    monkeypatch.setattr(D, "TERM_TILE", 8)
    assert found(spark, data, least=2, top=5, shard=5, at_once=300) == by_hand(data, 2, 5)


def test_slots_leave_a_task_early(spark, monkeypatch):
    monkeypatch.setattr(D, "SLOTS", 100)
    data = rows(60, 3)
    batch = pa.RecordBatch.from_pylist([{"lang": la or "", "source": s or "", "text": t or ""} for t, la, s in data])
    terms = pa.array(sorted({t for x, la, _ in data for t in TERM.findall((x or "").translate(LOW)) if la == "en"}))
    made = D.PerfectHash.build(terms)

    class Held:
        value = {"en": {0: (0, [x.tobytes() for x in made.levels], made.terms.to_pylist())}}

    got = Counter()
    for b in D.recount(Held, {"en": 1})([batch]):
        for r in b.to_pylist():
            got[r["source"], made.terms[r["slot"]].as_py()] += r["n"]
    want = Counter((s or "", t) for x, la, s in data if la == "en" for t in TERM.findall((x or "").translate(LOW)))
    assert got == want


def test_empty_table(spark):
    assert D.audit(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 30_000])
def test_perfect_hash(n):
    terms = pa.array([f"w{i * 7919}é" for i in range(n)], pa.string())
    made = D.PerfectHash.build(terms)
    slots = made.slots(terms, D.keys_of(terms))
    assert sorted(slots) == list(range(n))
    assert made.terms.take(pa.array(slots)).equals(terms)
    other = pa.array([f"v{i}" for i in range(2000)])
    assert (made.slots(other, D.keys_of(other)) == -1).all()


def test_equal_keys_are_told_apart(monkeypatch):
    monkeypatch.setattr(D, "keys_of", lambda terms: np.zeros(len(terms), np.uint64))
    terms = pa.array(["a", "b", "c"])
    made = D.PerfectHash.build(terms)
    assert sorted(made.slots(terms, D.keys_of(terms))) == [0, 1, 2]
    assert made.slots(pa.array(["d"]), D.keys_of(pa.array(["d"]))).tolist() == [-1]


def test_scaled_is_exact(spark):
    r = random.Random(4)
    data = [(min(n, of), of) for n, of in ((r.randrange(10**k), r.randrange(1, 10**k) + 5) for k in range(1, 16) for _ in range(20))]
    want = [1 + 10**9 * (n + 5) // of for n, of in data]
    assert D.scaled_array(np.array([n for n, _ in data]), np.array([of for _, of in data])).tolist() == want
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(data)], "i int, n long, of long")
    assert [x.p for x in df.select("i", D.scaled("n", "of").alias("p")).orderBy("i").collect()] == want
