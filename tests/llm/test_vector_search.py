import math
import time
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verdantia.llm import anisotropic_ann as A
from verdantia.llm import max_score as M
from verdantia.llm import vectors as V


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def odd_rows():
    r = np.random.default_rng(1)
    x = r.standard_normal((700, 16)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(700 + i, x[3].tolist(), 0) for i in range(300)]  # a very common vector
    rows += [(5, x[5].tolist(), 1), (5, x[6].tolist(), 1)]
    rows += [(1000, None, 0), (1050, [0.0] * 16, 0), (1100, [float("nan")] * 16, 0), (1101, [float("inf")] + [0.5] * 15, 0), (1102, [None] + [0.5] * 15, 0), (None, x[0].tolist(), 0), (1103, [1.0], 0)]
    return rows


def good(rows, zero):
    ok = [(i, np.array(v, np.float64)) for i, v, _ in rows if i is not None and v and len(v) == 16 and all(c is not None and math.isfinite(c) for c in v)]
    return [(i, v) for i, v in ok if zero or v.any()]


def test_max_score_is_exact(spark, monkeypatch):
    monkeypatch.setattr(V, "ROW_BLOCK", 200)
    rows = odd_rows()
    x = [(i, np.floor(256 * v).astype(np.int64)) for i, v in good(rows, True)]
    want = []
    for q_id, q in {i: min((tuple(w) for j, w in x if j == i)) for i, _ in x if i % 50 == 0}.items():
        best = {}
        for i, v in x:
            if i != q_id:
                best[i] = max(best.get(i, -(10**9)), int(v @ np.array(q)))
        for rank, (i, s) in enumerate(sorted(best.items(), key=lambda p: (-p[1], p[0]))[:5], 1):
            want.append((q_id, rank, i, s))
    assert sorted(map(tuple, M.top_k(table(spark, rows)).collect())) == sorted(want)


def test_max_score_oracle(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert sorted(map(tuple, M.op7_max_score(spark, sf).collect())) == sorted(con.execute(M.ORACLE).fetchall())


def exact_nearest(x, step, k):
    out = {}
    for q_id, q in [(i, v) for i, v in x if i % step == 0]:
        best = {}
        for i, v in x:
            if i != q_id:
                best[i] = min(best.get(i, np.inf), float(np.sqrt(((v - q) ** 2).sum())))
        out[q_id] = sorted(best.items(), key=lambda p: (p[1], p[0]))[:k]
    return out


def test_ann_recall_and_ties(spark, monkeypatch):
    monkeypatch.setattr(V, "ROW_BLOCK", 300)
    monkeypatch.setattr(A, "RERANK", 40)
    rows = odd_rows()
    want = exact_nearest(good(rows, False), 100, 10)
    got = {}
    for r in A.nearest(table(spark, rows)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    vec = dict(good(rows, False))
    for q, near in got.items():
        assert near == sorted(near, key=lambda p: (p[1], p[0])) and len(near) == 10
        assert all(s == pytest.approx(np.sqrt(((vec[i] - vec[q]) ** 2).sum()), abs=1e-12) for i, s in near if i != 5)


def test_ann_recall_in_a_cluster_of_near_copies(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((4000, 16))
    x[::3] = x[0] + 1e-3 * r.standard_normal((len(x[::3]), 16))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x.astype(np.float32))]
    want = exact_nearest(good(rows, False), 100, 10)
    got = A.nearest(table(spark, rows)).collect()
    for q in want:
        assert {i.vec_id for i in got if i.query_id == q} == {i for i, _ in want[q]}


def test_ann_recall_on_table(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    want = exact_nearest([(r.vec_id, np.array(r.embedding, np.float64)) for r in e], 100, 10)
    got = A.op5_anisotropic_ann(spark, sf).collect()
    hits = sum(r.vec_id in {i for i, _ in want[r.query_id]} for r in got)
    assert hits >= 0.95 * sum(map(len, want.values()))


def test_empty(spark):
    assert M.top_k(table(spark, [])).count() == 0 and A.nearest(table(spark, [])).count() == 0
    assert A.nearest(table(spark, [(0, [1.0, 2.0], 1), (3, [1.0, 2.5], 1)])).collect()[0].vec_id == 3


def test_clashing_columns_and_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "ROW_BLOCK", 150)
    monkeypatch.setattr(V, "QUERY_BLOCK", 3)
    rows = odd_rows()
    plain = table(spark, rows)
    named = plain.withColumns({c: F.lit(c) for c in ("codes", "norm", "block", "salt", "score", "rank", "query_id", "vec")})
    for find in (M.top_k, A.nearest):
        assert sorted(map(tuple, find(named).collect())) == sorted(map(tuple, find(plain).collect()))


def integer_scores(rows):
    """{(query, other): score} in unbounded integers, held to the ends of a long."""
    x = {i: [math.floor(Fraction(float(np.float32(c))) * 256) for c in v] for i, v, _ in rows}
    held = lambda s: max(-(2**63), min(2**63 - 1, s))
    return {(q, i): held(sum(a * b for a, b in zip(x[q], v))) for q in x if q % 50 == 0 for i, v in x.items() if i != q}


@pytest.mark.parametrize("large", [1e6, 3e9, 1e14, 1e30])
def test_large_components_are_exact(spark, large):
    r = np.random.default_rng(7)
    rows = [(0, [1.0] * 8, 0), (50, [large, *([-2.0] * 7)], 0), (100, [0.5, -large, *([0.25] * 6)], 0)]
    rows += [(i, [float(v) for v in r.standard_normal(8) * (large if i % 9 == 1 else 1)], 0) for i in range(1, 49)]
    want = integer_scores(rows)
    got = M.top_k(table(spark, rows)).collect()
    for q in (0, 50, 100):
        best = sorted(((s, -i) for (a, i), s in want.items() if a == q), reverse=True)[:5]
        mine = sorted((r.rank, r.score, r.vec_id) for r in got if r.query_id == q)
        assert [s for _, s, _ in mine] == [s for s, _ in best]
        if abs(best[0][0]) < 2**63 - 1:
            assert [-i for _, _, i in mine] == [i for _, i in best]


def test_reported_large_components(spark):
    """One component of 2e6 and 1.5e6 against 64 ones: both scores fit a long."""
    rows = [(0, [1.0] * 64, 0), (1, [2e6, *([0.0] * 63)], 0), (2, [1.5e6, *([0.0] * 63)], 0)]
    assert [(r.vec_id, r.score) for r in M.top_k(table(spark, rows)).orderBy("rank").collect()] == [(1, 131_072_000_000), (2, 98_304_000_000)]


def test_float_tables_cover_an_odd_number_of_codes(spark):
    r = np.random.default_rng(4)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(r.standard_normal((500, 9)).astype(np.float32))]
    want = exact_nearest([(i, np.array(v)) for i, v, _ in rows], 100, 10)
    got = A.nearest(table(spark, rows)).collect()
    assert {(r.query_id, r.vec_id) for r in got} == {(q, i) for q, near in want.items() for i, _ in near}


def block(ids, x):
    return pa.table({"vec_id": pa.array(ids, pa.int64()), "vec": pa.array(list(x.astype(np.float64)), pa.list_(pa.float64()))})


def by_products(ids, x, q_ids, q, k):
    out = []
    for q_id, row in zip(q_ids, q):
        best = {}
        for i, s in zip(ids.tolist(), (x @ row).tolist()):
            if i != q_id:
                best[i] = max(s, best.get(i, s))
        out += [(int(q_id), i, s) for i, s in sorted(best.items(), key=lambda p: (-p[1], p[0]))[:k]]
    return out


@pytest.mark.parametrize("size,share,n,k", [(40, 1, 900, 5), (40, 0.03, 900, 5), (40, 0.2, 900, 60), (1 << 27, 1, 900, 5), (1 << 27, 0.1, 900, 5), (3, 1, 7, 5), (1, 0.01, 400, 5)])
def test_long_and_short_lists_in_batches(size, share, n, k):
    """Doubles and 64-bit integers, dense and sparse vectors, ties, repeated ids, queries in none of the rows."""
    r = np.random.default_rng(n + k)
    x = np.rint(r.standard_normal((n, 24)).clip(-2, 2) * size / 2).astype(np.int64) * (r.random((n, 24)) < share)
    x[:, 20:] *= r.random((n, 4)) < 0.02
    x[n // 2 : n // 2 + n // 10] = x[0]
    for ids in (np.arange(n), np.arange(n) // 2):
        q_ids, q = np.append(ids[::7], -50), np.vstack([x[::7], x[:1]])
        got = M.search(k)(block(ids, x), block(q_ids, q))
        assert list(zip(*(got.column(c).to_pylist() for c in range(3)))) == by_products(ids, x, q_ids, q, k)


def test_a_query_costs_no_more_than_a_few_plain_products():
    """CPU time of this thread against the plain products of the same integers."""
    r = np.random.default_rng(3)
    x = r.standard_normal((4096, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None]).astype(np.int64)
    left, right = block(np.arange(4096), x), block(np.arange(0, 4096, 10), x[::10])
    cost = lambda f: min(-time.thread_time() + (f(), time.thread_time())[1] for _ in range(3))
    assert cost(lambda: M.search(5)(left, right)) < 4 * cost(lambda: x @ x[::10].T)
