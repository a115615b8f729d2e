import random
import re

import numpy as np
import pyarrow as pa
import pytest

from verdantia.llm import jaccard_join as J


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            both = len(x & y)
            if x and y and 100 * both >= 75 * (len(x) + len(y) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(k, least.get(find(i), k))
    return sorted((k, len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(rows))


def near_copies(seed, n):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(200)]
    bases = [[r.choice(vocab) for _ in range(r.choice([3, 5, 6, 8, 9, 12, 20, 60, 150, 400]))] for _ in range(30)]
    passage = [r.choice(vocab) for _ in range(25)]
    rows = []
    for i in range(n):
        x = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5, 9])):
            p = r.randrange(len(x))
            x[p : p + r.randint(0, 1)] = [r.choice(vocab)] * r.randint(0, 2) or [r.choice(vocab)]
        if r.random() < 0.3:
            x = x[: r.randint(0, 30)] + passage + [r.choice(vocab) for _ in range(r.randint(0, 12))]
        rows.append((i, " ".join(w.upper() if r.random() < 0.1 else w for w in x)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "one two"), (n + 4, "ONE\ttwo"), (n + 5, "ONE two")]


def got(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


@pytest.mark.parametrize("seed,hot,block", [(1, 32, 1000), (2, 3, 7), (3, 2, 2)])
def test_same_as_brute_force(spark, monkeypatch, seed, hot, block):
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "HOT", hot)
    rows = near_copies(seed, 500)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(J.jaccard_components(df)) == brute(rows)


def test_index_misses_no_pair():
    r = random.Random(9)
    for _ in range(400):
        n = r.choice([3, 4, 5, 6, 7, 8, 10, 13, 20, 45, 100, 333])
        a = [r.getrandbits(64) for _ in range(n)]
        b = list(a)
        for _ in range(r.randint(0, n // 3 + 1)):
            if r.random() < 0.5 and len(b) > 1:
                b.pop(r.randrange(len(b)))
            else:
                b.append(r.getrandbits(64))
        x, y = set(a), set(b)
        if x == y or 4 * len(x & y) < 3 * len(x | y):
            continue
        tok = np.array(sorted(x) + sorted(y), np.uint64)
        key, row = J.index_keys(tok, np.array([0, len(x), len(x) + len(y)]))
        assert set(key[row == 0].tolist()) & set(key[row == 1].tolist()), (len(x), len(y), len(x ^ y))


def test_members_of_an_entry_share_a_group(monkeypatch):
    monkeypatch.setattr(J, "HOT", 4)
    line = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    text = [" ".join(f"{line} {i}" for line in (line, line.upper(), line)) for i in range(24)]
    tasks, made, by_key = [text[:12], text[12:15], text[15:]], [], {}
    for i, own in enumerate(tasks):
        made += J.map_index(1, 5, 3, 4)([pa.record_batch([pa.array(range(100 * i, 100 * i + len(own))), pa.array(own)], ["id", "body"])])
        buf, off = J.C.flat(pa.array(own))
        tok, o = J.shingles(buf, off)
        key, row = J.index_keys(tok, o)
        for k, s in zip(key.tolist(), J.set_ids(tok, o)[row].tolist()):
            by_key.setdefault(k, [set(), set(), set()])[i].add(s)
    groups = {}
    for b in J.meet_index(made):
        for r in b.to_pylist():
            if r["kind"] == J.GROUP:
                groups.setdefault(r["b"], set()).update(r["members"])
    mixed = [x for x in by_key.values() if len(x[0]) > 4 and x[1]]  # hot in one task and cold in another
    assert mixed
    for x in mixed:
        assert any(set.union(*x) <= g for g in groups.values())


def test_doubt_opens_all_rows_of_a_group(spark):
    groups = spark.createDataFrame([(1, 7, [1, 2]), (3, 7, [3, 4]), (1, 8, [1, 9]), (5, 9, [5, 6, 7])], "a long, b long, members array<long>")
    found = J.doubtful(groups, spark.createDataFrame([(3,)], "a long")).collect()
    assert sorted((r.unit, r.sid) for r in found) == [(1, 1), (1, 2), (1, 3), (1, 4)]


def test_united(spark):
    comp = J.united(spark.createDataFrame([(2, 1), (3, 1), (6, 5)], "sid long, comp long"), spark.createDataFrame([(3, 6), (7, 6), (8, 9), (2, 3)], "a long, b long"))
    assert sorted((r.sid, r.comp) for r in comp.collect()) == [(2, 1), (3, 1), (5, 1), (6, 1), (7, 1), (9, 8)]


def bridges():
    """Six families: 58 near copies of a base (each with its own end), and one text that is similar to the base only."""
    r = random.Random(11)
    family, bridge = [], []
    for f in range(6):
        base = [f"f{f}x{i}" for i in range(104)]
        for i in range(58):
            family.append((1000 * f + i, " ".join([*base, *(f"f{f}y{i}z{j}" for j in range(r.randint(1, 14)))] if i else base)))
        bridge.append((1000 * f + 900, " ".join([*base[:80], *(f"f{f}b{i}" for i in range(0, 4))])))
    return family, bridge


@pytest.mark.parametrize("tasks", [1, 2, 8])
def test_no_link_is_lost_between_tasks(spark, tasks):
    family, bridge = bridges()
    want = brute(family + bridge)
    make = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    df = make(family + bridge).coalesce(1) if tasks == 1 else make(family).repartition(tasks - 1).unionByName(make(bridge).coalesce(1))
    assert got(J.jaccard_components(df)) == want


@pytest.mark.parametrize("nearest", [(1, None), (1, 2, 4, None)])
def test_rounds_of_nearest_partners(spark, monkeypatch, nearest):
    """Near copies of one base that are mostly just below the similarity of each other: links are sparse."""
    monkeypatch.setattr(J, "NEAREST", nearest)
    monkeypatch.setattr(J, "BLOCK", 40)
    r = random.Random(3)
    base, rows = [f"w{i}" for i in range(70)], []
    for i in range(300):
        x = list(base)
        for _ in range(r.randint(1, 3)):
            x[r.randrange(70)] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(x)))
    want = brute(rows)
    assert 1 < len({c for _, _, c in want}) < 300
    assert got(J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == want


def test_very_long_texts(spark):
    r = random.Random(5)
    x = [f"v{r.randrange(5000)}" for _ in range(200_000)]
    y = list(x)
    for i in range(0, 200_000, 40):
        y[i] = "other"
    rows = [(1, " ".join(x)), (2, " ".join(y)), (3, " ".join(x[:100_000])), (4, "short text of five words")]
    assert got(J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_hot_and_cold_tasks(spark, monkeypatch):
    monkeypatch.setattr(J, "HOT", 2)
    monkeypatch.setattr(J, "FLUSH", 10)
    rows = near_copies(4, 600)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    assert got(J.jaccard_components(df)) == brute(rows)


def test_on_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(J.jaccard_components(df)) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_odd_tables(spark):
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "A B C D E F")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, sid int, comp string")
    out = J.jaccard_components(df).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in out) == [(False, 3)] * 3 + [(True, 3)]
