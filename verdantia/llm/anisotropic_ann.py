"""Approximate nearest neighbours by score-aware anisotropic quantisation (operator 5).

Euclidean neighbours are a maximum inner product: 2 q.x - |x|^2. Vectors are coded by subspace in four bits; codes and
codebooks minimise a loss in which the residual's part along the vector weighs more than the part across it, because that
part moves the inner products that matter. Codebooks are fitted in numpy on a bounded sample; every row is coded. A query
looks its tables up for all codes of a block, and the best of the block are ranked again by exact distances; so are all
rows that their code and the length of its residual still allow nearer than the k-th of those.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part; a repeated
id counts once, at its nearest row; an empty table gives an empty result; equal distances go to smaller ids; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from .common import cut

#: Rows the codebooks are fitted on, at most; the only sample.
SAMPLE = 8000
CODES, ROUNDS, SEED, K = 16, 6, 5, 10
#: Share of a vector's length from which inner products count in full; sets the weight of the parallel residual.
THRESHOLD = 0.2
#: Candidates of a block that are ranked by exact distances first.
RERANK = 128


def weight(d: int) -> float:
    return max(1.0, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))


def split(d: int) -> list[slice]:
    return [slice(i, min(i + 2, d)) for i in range(0, d, 2)]


def assign(x: np.ndarray, books: list[np.ndarray], codes: np.ndarray, sweeps: int) -> np.ndarray:
    """Codes by coordinate descent on |r|^2 + (w - 1)(r.u)^2, u the vector's direction."""
    parts, w = split(x.shape[1]), weight(x.shape[1]) - 1
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    part = [((x[:, s] - b[c]) * u[:, s]).sum(axis=1) for s, b, c in zip(parts, books, codes.T)]
    along = sum(part)
    for _ in range(sweeps):
        for m, (s, b) in enumerate(zip(parts, books)):
            r = x[:, s][:, None] - b[None]
            ru = (r * u[:, s][:, None]).sum(axis=2)
            rest = along - part[m]
            codes[:, m] = ((r * r).sum(axis=2) + w * (rest[:, None] + ru) ** 2).argmin(axis=1)
            part[m] = ru[np.arange(len(x)), codes[:, m]]
            along = rest + part[m]
    return codes


def start_codes(x: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    return np.stack([((x[:, s][:, None] - b[None]) ** 2).sum(axis=2).argmin(axis=1) for s, b in zip(split(x.shape[1]), books)], axis=1)


def train(x: np.ndarray) -> list[np.ndarray]:
    """A codebook of 16 centres for each pair of dimensions."""
    r = np.random.default_rng(SEED)
    parts, w = split(x.shape[1]), weight(x.shape[1]) - 1
    books = [x[r.integers(0, len(x), CODES)][:, s].copy() for s in parts]
    for _ in range(4):  # plain k-means to start from
        codes = start_codes(x, books)
        for m, s in enumerate(parts):
            n = np.bincount(codes[:, m], minlength=CODES)
            for j in range(books[m].shape[1]):
                total = np.bincount(codes[:, m], x[:, s.start + j], minlength=CODES)
                books[m][n > 0, j] = total[n > 0] / n[n > 0]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for _ in range(ROUNDS):
        codes = assign(x, books, codes, 1)
        part = [((x[:, s] - b[c]) * u[:, s]).sum(axis=1) for s, b, c in zip(parts, books, codes.T)]
        along = sum(part)
        for m, s in enumerate(parts):
            rest = along - part[m]
            us, xs, d = u[:, s], x[:, s], x[:, s].shape[1]
            right = xs + w * us * (rest + (xs * us).sum(axis=1))[:, None]
            for c in range(CODES):
                own = codes[:, m] == c
                if own.any():
                    a = own.sum() * np.eye(d) + w * us[own].T @ us[own]
                    books[m][c] = np.linalg.solve(a, right[own].sum(axis=0))
            part[m] = ((xs - books[m][codes[:, m]]) * us).sum(axis=1)
            along = rest + part[m]
    return books


def index(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """rows with their codes (two to a byte) and squared length."""
    told = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            x = V.matrix(batch.column(1))
            packed, norms = [], []
            for i in range(0, len(x), 2048):
                c = assign(x[i : i + 2048], told.value, start_codes(x[i : i + 2048], told.value), 2).astype(np.uint8)
                if c.shape[1] % 2:
                    c = np.pad(c, ((0, 0), (0, 1)))
                packed += [p.tobytes() for p in c[:, ::2] | c[:, 1::2] << 4]
                norms.append((x[i : i + 2048] ** 2).sum(axis=1))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(packed, pa.binary()), pa.array(np.concatenate(norms) if norms else np.zeros(0))], ["vec_id", "vec", "codes", "norm"])

    return rows.mapInArrow(run, "vec_id long, vec array<double>, codes binary, norm double")


def first_best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores; among equals the first places."""
    if len(score) <= k:
        return np.arange(len(score))
    at = np.partition(score, len(score) - k)[len(score) - k]
    above = np.flatnonzero(score > at)
    return np.concatenate([above, np.flatnonzero(score == at)[: k - len(above)]])


def ranked(x: np.ndarray, ids: np.ndarray, near: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact distances of rows near, and the places of the k nearest ids among them."""
    dist = np.sqrt(((x[near] - q) ** 2).sum(axis=1))
    top = np.lexsort((ids[near], dist))
    _, one = np.unique(ids[near][top], return_index=True)
    return dist, top[np.sort(one)[:k]]


def scan(books: list[np.ndarray], k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            ids = left.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], V.matrix(left.column("vec"))[order]
            norm = left.column("norm").to_numpy()[order]
            two = np.frombuffer(b"".join(left.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)[order]
            packed = [np.ascontiguousarray(c) for c in two.T]  # two codes to a byte: one lookup for both
            parts = split(x.shape[1])
            codes = [c for p in packed for c in (p & 15, p >> 4)][: len(books)]
            inner = sum((b * b).sum(axis=1)[c] for b, c in zip(books, codes))
            gap = np.sqrt(sum(((x[:, s] - b[c]) ** 2).sum(axis=1) for s, b, c in zip(parts, books, codes)))
            del codes
            length, none = np.sqrt(norm), np.zeros(CODES)
            for q_id, q in zip(right.column("vec_id").to_numpy(), V.matrix(right.column("vec"))):
                table = [2 * (b @ q[s]) for s, b in zip(parts, books)] + [none] * (len(books) % 2)
                score = -norm
                for p, low, high in zip(packed, table[::2], table[1::2]):
                    score = score + (high[:, None] + low[None]).ravel()[p]
                far = np.sqrt(np.maximum(q @ q + inner - score - norm, 0))  # from the query to the coded row
                score[ids == q_id] = -np.inf
                near = first_best(score, RERANK)
                near = near[ids[near] != q_id]
                dist, top = ranked(x, ids, near, q, k)
                if len(near) < len(ids):
                    kth = dist[top[-1]] if len(top) == k else np.inf
                    maybe = (far - gap <= kth + 1e-6 * (np.sqrt(q @ q) + length)) & (ids != q_id)  # a margin for rounding
                    maybe[near] = False
                    near = np.concatenate([near, np.flatnonzero(maybe)])
                    dist, top = ranked(x, ids, near, q, k)
                out += [(q_id, i, d) for i, d in zip(ids[near][top], dist[top])]
        cols = list(zip(*out)) if out else [[], [], []]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    return run


def nearest(df: DataFrame, key: str = "vec_id", vector: str = "embedding", step: int = 100, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query row, by Euclidean distance."""
    rows = V.clean(df, key, vector, zero=False)
    sample = rows.select("vec").orderBy(F.xxhash64("vec_id", F.lit("sample")), "vec_id").limit(SAMPLE).toArrow()
    if not len(sample):
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    books = train(V.matrix(sample.column(0)))
    coded = cut(index(rows, books))
    return V.meet(coded, V.one_each(coded, step), scan(books, k), k, "query_id long, vec_id long, score double", "asc")


def op5_anisotropic_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
