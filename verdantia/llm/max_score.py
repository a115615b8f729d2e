"""Exact top-k inner products by MaxScore (operator 7).

Components become integers; every dimension has two posting lists, of its positive and of its negative values. A query's
terms are the lists whose products with it are positive; a list's largest product is its bound. In the order of their
bounds, the lists whose bounds together stay below the k-th best score so far are non-essential: a row found in no other
list cannot compete. Essential lists are traversed and add up; rows whose sum with the non-essential bounds still competes
are probed in the remaining lists, one at a time while they compete, and then scored exactly. Row blocks are shards whose
best are merged.

Vectors that are null, of another length than most, or hold null or non-finite components take no part; a repeated id
counts once, at its best row; equal scores go to smaller ids; an empty table gives an empty result; other columns are
ignored. Scores are exact for components of any size: rows and queries with one beyond the square root of 2**62 / dimensions
(2**28 at 64) are multiplied in unbounded integers, apart from the lists. A score that no long holds is shown, and ranked
among others of the kind, as the nearest long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from .common import cut

SCALE, K = 256, 5
#: The largest double, which components count as if their multiple by SCALE is beyond it.
FAR = float(np.finfo(np.float64).max)
#: Rows at the head of a query's strongest lists that set its first threshold; best rows so far that raise it.
HEAD, TRY = 32, 32
#: Lists with one of so many rows at least are held as columns, which a batch of queries (fewer beyond 64 dimensions) traverses together.
LONG, BATCH = 16, 64
#: Rows that are scored without probing further lists; if one of so many rows competes, long lists aren't probed but traversed.
FEW, MANY = 64, 8
#: Whole numbers to which doubles are exact.
EXACT = 1 << 53


class Shard:
    """The posting lists of a block of rows: list t has the positive values of dimension t, list d + t the negative ones.

    x holds whole numbers, as doubles if no product of a query is beyond EXACT, else as 64-bit integers.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.repeats = len(np.unique(ids)) < len(ids)
        self.low = -np.inf if x.dtype.kind == "f" else np.iinfo(np.int64).min
        n, d = x.shape
        self.top, self.long = np.zeros(2 * d, x.dtype), np.zeros(2 * d, bool)
        self.head = np.zeros((2 * d, min(n, HEAD)), np.int64)
        self.short, columns = {}, []
        for t in range(2 * d):
            v = np.maximum(x[:, t] if t < d else -x[:, t - d], 0)
            if not n or not v.any():
                continue
            self.head[t] = np.argpartition(v, n - self.head.shape[1])[n - self.head.shape[1] :]
            self.top[t] = v.max()
            r = np.flatnonzero(v)
            if len(r) * LONG >= n:
                self.long[t] = True
                columns.append(v)
            else:
                self.short[t] = r, v[r]
        self.columns = np.stack(columns) if columns else np.zeros((0, n), x.dtype)

    def best(self, q_ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[list[tuple[int, int]]]:
        """For each query the k best (id, score) but its own, exactly."""
        weight = np.hstack([np.maximum(q, 0), np.maximum(-q, 0)])
        most = weight * self.top
        order = np.argsort(most, axis=1, kind="stable")
        bound = np.zeros((len(q), most.shape[1] + 1), most.dtype)
        np.cumsum(np.take_along_axis(most, order, 1), axis=1, out=bound[:, 1:])
        least = self.thresholds(q_ids, q, order[:, -3:], k)
        # the first lists of a query are non-essential: together they stay below its threshold
        first = (bound < least[:, None]).sum(axis=1) - 1
        place = np.argsort(order, axis=1)
        essential = np.where(place >= first[:, None], weight, 0)
        total = essential[:, self.long] @ self.columns
        for i, t in zip(*np.nonzero(np.where(self.long, 0, essential))):
            if t in self.short:
                r, v = self.short[t]
                total[i, r] += v * essential[i, t]
        rest = np.take_along_axis(bound, np.maximum(first, 0)[:, None], 1)
        many = (total >= least[:, None] - rest).sum() * MANY > total.size
        if many:  # probing would meet most rows one by one
            total += (weight - essential)[:, self.long] @ self.columns
        for i, q_id in enumerate(q_ids):
            if least[i] <= 0:  # a row in no list at all may compete
                yield self.ranked(np.arange(len(self.ids)), q_id, q[i], k)
                continue
            lists = order[i, : first[i]]
            lists = lists[~self.long[lists] if many else most[i, lists] > 0]
            open_ = np.append(0, np.cumsum(most[i, lists]))
            live = np.flatnonzero(total[i] >= least[i] - open_[-1])
            now, goal = total[i, live], least[i]
            if len(live) > 2 * TRY:  # the best so far raise the threshold
                some = live[np.argpartition(now, len(now) - TRY)[len(now) - TRY :]]
                goal = max(goal, self.kth(some, q_id, q[i], k))
                keep = now >= goal - open_[-1]
                live, now = live[keep], now[keep]
            yield self.ranked(self.probed(live, now, lists, open_, weight[i], goal), q_id, q[i], k)

    def thresholds(self, q_ids: np.ndarray, q: np.ndarray, lists: np.ndarray, k: int) -> np.ndarray:
        """The k-th best score of each query among the heads of its strongest lists, a bound for all other rows."""
        rows = self.head[lists].reshape(len(q), -1)
        if rows.shape[1] < k:
            return np.full(len(q), self.low, self.x.dtype)
        score = np.matmul(self.x[rows], q[:, :, None])[:, :, 0]
        ids = self.ids[rows]
        order = np.lexsort((-score, ids), axis=1)
        ids, score = np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)
        again = ids == q_ids[:, None]
        again[:, 1:] |= ids[:, 1:] == ids[:, :-1]
        score[again] = self.low
        return np.partition(score, score.shape[1] - k, axis=1)[:, -k]

    def probed(self, live: np.ndarray, now: np.ndarray, lists: np.ndarray, bound: np.ndarray, weight: np.ndarray, least: int) -> np.ndarray:
        """Rows that still compete when the non-essential lists have been probed, the strongest first."""
        d = self.x.shape[1]
        for j in range(len(lists) - 1, -1, -1):
            if len(live) <= FEW:
                break
            t = lists[j]
            v = self.x[live, t] if t < d else -self.x[live, t - d]
            now = now + np.maximum(v, 0) * weight[t]
            keep = now >= least - bound[j]
            live, now = live[keep], now[keep]
        return live

    def kth(self, rows: np.ndarray, q_id: int, q: np.ndarray, k: int):
        """The k-th best score of different ids among rows, a bound for all others; the lowest value of fewer."""
        found = self.ranked(rows, q_id, q, k)
        return found[k - 1][1] if len(found) == k else self.low

    def ranked(self, rows: np.ndarray, q_id: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (id, score) of different ids among rows, scored exactly."""
        rows = rows[self.ids[rows] != q_id]
        score = self.x[rows] @ q
        if not self.repeats and len(rows) > k:
            keep = score >= np.partition(score, len(rows) - k)[len(rows) - k]
            rows, score = rows[keep], score[keep]
        ids = self.ids[rows]
        order = np.lexsort((ids, -score))
        if self.repeats:
            _, one = np.unique(ids[order], return_index=True)
            order = order[np.sort(one)]
        order = order[:k]
        return list(zip(ids[order].tolist(), score[order].astype(np.int64).tolist()))


def whole(x: np.ndarray) -> np.ndarray:
    """Integers of any size from doubles that hold whole numbers."""
    return np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)


def large(x: np.ndarray) -> np.ndarray:
    """Rows that may overflow 64 bits in a product with a row that isn't large itself."""
    return (np.abs(x) > math.isqrt((1 << 62) // max(1, x.shape[1]))).any(axis=1) if len(x) else np.zeros(0, bool)


def in_doubles(x: np.ndarray, q: np.ndarray) -> bool:
    """Whether doubles hold every sum of products of a row and a query exactly, in any order."""
    return not len(x) or not len(q) or float((np.abs(q).max(axis=0) * np.abs(x).max(axis=0)).sum()) < EXACT / 2


def search(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            ids = left.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], V.matrix(left.column("vec"))[order]
            q_ids, q = right.column("vec_id").to_numpy(), V.matrix(right.column("vec"))
            high, high_q = large(x), large(q)
            far, far_ids = whole(x[high]), ids[high]
            near, near_ids, plain = x[~high], ids[~high], np.flatnonzero(~high_q)
            kind = np.float64 if in_doubles(near, q[plain]) else np.int64
            shard = Shard(near_ids, near.astype(kind))
            step = max(1, BATCH * 64 // max(64, x.shape[1]))
            batches = (plain[s : s + step] for s in range(0, len(plain), step))
            found = (x for p in batches for x in zip(p, shard.best(q_ids[p], q[p].astype(kind), k)))
            if high_q.any():
                near = whole(near)
                found = chain(found, ((i, [*zip(near_ids.tolist(), near @ whole(q[i][None])[0])]) for i in np.flatnonzero(high_q)))
            for i, best in found:
                if len(far):
                    best = [*best, *zip(far_ids.tolist(), far @ whole(q[i][None])[0])]
                out += [(q_ids[i], j, s) for j, s in top(best, q_ids[i], k)]
        cols = list(zip(*out)) if out else [[], [], []]
        cols[2] = [max(-(1 << 63), min((1 << 63) - 1, s)) for s in cols[2]]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), cols)})

    return run


def top(found: list[tuple[int, int]], q_id: int, k: int) -> list[tuple[int, int]]:
    """The k best (id, score) of different ids but q_id."""
    best: dict[int, int] = {}
    for i, s in found:
        if i != q_id and (i not in best or s > best[i]):
            best[i] = int(s)
    return sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]


def top_k(df: DataFrame, key: str = "vec_id", vector: str = "embedding", step: int = 50, k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query row, exactly."""
    rows = V.clean(df, key, vector, zero=True)
    rows = cut(rows.select("vec_id", F.transform("vec", lambda v: F.when(F.abs(v) < 2.0**52, F.floor(v * scale).cast("double")).otherwise(F.greatest(F.least(v * scale, F.lit(FAR)), F.lit(-FAR)))).alias("vec")))
    return V.meet(rows, V.one_each(rows, step), search(k), k, "query_id long, vec_id long, score long", "desc")


def op7_max_score(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM ok q JOIN ok c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores) WHERE rank <= 5
"""
