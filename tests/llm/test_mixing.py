import random
import re
from collections import defaultdict

import duckdb
import pytest

from verdantia.llm import mixing as M


def want_targets(sizes):
    """By the words of the contract: shares by weight, excess shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, out, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        left = total - sum(out.values())
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if t[s] >= 2 * sizes[s]}
        if not over:
            return out | t
        out |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    return out


def check(rows, texts):
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, (t, _) in texts.items()}
    by = defaultdict(int)
    for k, (_, s) in texts.items():
        by[s] += size[k]
    goal, took = want_targets(by), defaultdict(int)
    assert len(rows) == len(texts)
    for r in rows:
        s = texts[r.doc_id][1]
        assert r.size == size[r.doc_id] and r.source_size == by[s] and r.target == pytest.approx(goal[s])
        assert 0 <= r.taken <= 2 * r.size
        took[s] += r.taken
    step = max(1.5 * sum(by.values()) / 65536, 1)
    for s in by:
        assert abs(took[s] - goal[s]) <= 2 * step + 1, s


def test_targets_and_takes(spark):
    r = random.Random(1)
    texts = {i: (" ".join("x" for _ in range(r.choice([0, 1, 5, 300]))), r.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(600)}
    texts[600] = (None, "b")
    texts[601] = ("one", "z")
    df = spark.createDataFrame([(k, *v, "q") for k, v in texts.items()], "doc_id long, text string, source string, ord string").repartition(3)
    rows = M.mix(df).collect()
    check(rows, texts)
    assert sorted(rows) == sorted(M.mix(df.repartition(7)).collect())


def test_schedule_is_even(spark):
    df = spark.createDataFrame([(i, "w " * 50, "abc"[i % 3]) for i in range(90)], "doc_id long, text string, source string")
    planned = M.plan(M.targets(M.sizes(df, "text", "source", "doc_id")), 1.5)
    slots = sorted((x.slot, x.source, x.block) for x in M.schedule(planned).collect())
    assert [x[0] for x in slots] == list(range(65536))
    n = {s: [b for _, x, b in slots if x == s] for s in "abc"}
    assert all(sorted(b) == list(range(len(b))) for b in n.values())
    for at in range(0, 65536, 4096):  # each stretch of the mix has the target shares
        here = [s for _, s, _ in slots[at : at + 4096]]
        assert all(abs(here.count(s) - len(n[s]) / 16) <= 3 for s in "abc")


def test_oracle(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(con.execute(M.ORACLE).fetchall())
    got = sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in M.op3_mixing(spark, sf).collect())
    assert [x[:3] + x[4:] for x in got] == [tuple(x[:3] + x[4:]) for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want])


def test_odd_tables(spark):
    assert M.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    df = spark.createDataFrame([(None, None, None), (1, "", "a"), (1, "", "a")], "doc_id long, text string, source string")
    assert [r.taken for r in M.mix(df).collect()] == [0, 0, 0]
    df = spark.createDataFrame([(1, "a b c", "a")] * 5, "doc_id long, text string, source string")
    assert sum(r.taken for r in M.mix(df).collect()) in (22, 23)
