"""Sampled segmentation into the pieces of a SentencePiece vocabulary, and lossless decoding (operator 9).

Texts split into units: a run of spaces with the characters up to the next space or line feed, `UNIT` of them at most (a
longer run is several units, so that no text takes more than UNIT steps). Each different unit's
lattice of pieces is filtered forward once per task and kept; every occurrence is then sampled backward from it, all
occurrences of a batch together, one piece a step. A draw depends on the row key, the place of the unit in its text, the
step and the seed alone, so reruns and other partitionings give the same pieces. Piece i has a probability in proportion to
1 / (i + 10): the files rank pieces by id and hold none. A segmentation is drawn in proportion to its probability to the
power `ALPHA`; at 1 nearly every draw would be the one with the fewest pieces. Characters outside the vocabulary, and literal U+2581, are their UTF-8 bytes.

Decoding maps U+2581 back to a space and byte pieces to bytes, so any text comes back exactly. A null text has null
pieces; an empty text has none; the vocabulary is read on the driver (its size is the file's) and broadcast. Rows with the
same key and text get the same pieces; equal draws go to the arc that comes first; other columns stay, except those with
the names of the result; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MODEL, SEED, ALPHA = "piece_bpe_32k.model", 1, 0.3
#: Characters of a unit, at most.
UNIT = 256
#: Units, and their characters, that a task keeps; when more have been seen, it starts over.
KEEP, KEEP_STATES = 250_000, 4_000_000
SPACE_MARK = "▁"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def read_pieces(path: str) -> list[tuple[str, int]]:
    """(text or byte, kind) by id; kind: 1 a piece, 6 a byte, else control or unknown."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(sp.get_piece_size()):
        kind = 6 if sp.is_byte(i) else 3 if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else 1
        out.append((sp.id_to_piece(i), kind))
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Lattices:
    """Sampling tables of the units seen so far. State s = first[unit] + characters before; its arcs end there."""

    def __init__(self, pieces: list[tuple[str, int]]):
        self.ids = {p.replace(SPACE_MARK, " "): i for i, (p, kind) in enumerate(pieces) if kind == 1}
        self.bytes = {int(p[3:5], 16): i for i, (p, kind) in enumerate(pieces) if kind == 6}
        self.weight = 1.0 / (np.arange(len(pieces)) + 10.0)
        self.weight = (self.weight / self.weight[sorted(self.ids.values())].sum()) ** ALPHA
        # every beginning of a piece, by hash: the piece's id, or -1 where only longer pieces go on
        ends: dict[str, int] = {t[:m]: -1 for t in self.ids for m in range(1, len(t))}
        ends.update(self.ids)
        off = np.concatenate([[0], np.cumsum([len(t) for t in ends])])
        h = C.span_hash(prefix(code_points("".join(ends))), off[:-1], off[1:])
        order = np.argsort(h)
        self.heads, self.head_ids = h[order], np.array(list(ends.values()))[order]
        self.slots = np.searchsorted(self.heads >> C.U64(46), np.arange((1 << 18) + 1, dtype=C.U64))
        self.probes = int(np.diff(self.slots).max())
        self.clear()

    def clear(self):
        self.first: dict[int, int] = {}
        self.count = self.size = 0
        self.table = [np.zeros(1 << 16), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int8)]
        self.arc = np.zeros(1 << 16, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Where in heads each hash is, or -1."""
        slot = (h >> C.U64(46)).astype(np.int64)
        at, to = self.slots[slot], self.slots[slot + 1]
        out = np.full(len(h), -1)
        live = np.flatnonzero(at < to)
        for j in range(self.probes):
            x = at[live] + j
            hit = self.heads[x] == h[live]
            out[live[hit]] = x[hit]
            live = live[~hit & (x + 1 < to[live])]
            if not len(live):
                break
        return out

    def add(self, keys: np.ndarray, cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Forward filtering of new units cp[start:end]: alpha, and the cumulative share of each arc into each state."""
        size = end - start
        off = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(off[-1]) - np.repeat(off[:-1] - start, size)
        u = cp[at]
        left = np.repeat(off[1:], size) - np.arange(len(u))  # characters up to the unit's end
        state = np.arange(len(u)) + np.repeat(np.arange(len(size)), size)  # before each character; a unit has size + 1
        p = prefix(u)
        froms, pids, steps = [], [], []
        s, m = np.arange(len(u)), 1
        while len(s):
            spot = self.find(C.span_hash(p, s, s + m))
            s, spot = s[spot >= 0], spot[spot >= 0]
            ids = self.head_ids[spot]
            froms.append(s[ids >= 0])
            pids.append(ids[ids >= 0])
            steps.append(np.full(len(pids[-1]), m))
            m += 1
            s = s[left[s] >= m]
        s, pid, step = np.concatenate(froms), np.concatenate(pids), np.concatenate(steps)
        bare = np.ones(len(u) + 1, bool)
        bare[s + step] = False
        bare = np.flatnonzero(bare[1:])  # characters that no piece ends with
        logw = np.concatenate([np.log(self.weight[pid]), np.full(len(bare), -20.0)])
        s, pid, step = np.concatenate([s, bare]), np.concatenate([pid, -1 - u[bare].astype(np.int64)]), np.concatenate([step, np.ones(len(bare), np.int64)])
        to, level = state[s] + step, (s - off[:-1][np.searchsorted(off, s, side="right") - 1]) + step
        order = np.lexsort((to, level))
        s, pid, step, to, level, logw = s[order], pid[order], step[order], to[order], level[order], logw[order]
        alpha = np.zeros(len(u) + len(size))
        share = np.zeros(len(s))
        edge = np.searchsorted(level, np.arange(1, int(size.max()) + 2))
        for i, j in zip(edge[:-1], edge[1:]):
            if i == j:
                continue
            v = alpha[to[i:j] - step[i:j]] + logw[i:j]
            new = np.flatnonzero(np.append(True, to[i + 1 : j] != to[i : j - 1]))
            n = np.diff(np.append(new, j - i))
            top = np.maximum.reduceat(v, new)
            v = np.exp(v - np.repeat(top, n))
            total = np.add.reduceat(v, new)
            alpha[to[i:j][new]] = top + np.log(total)
            run = np.cumsum(v)
            share[i:j] = (run - np.repeat(run[new] - v[new], n)) / np.repeat(total, n)
        order = np.argsort(to, kind="stable")
        final = np.append(to[order][1:] != to[order][:-1], True)
        need = self.size + len(s)
        if need > len(self.table[0]):
            for i, t in enumerate(self.table):  # one after another; what is not used yet is not touched
                self.table[i] = np.empty(need * 3 // 2, t.dtype)
                self.table[i][: self.size] = t[: self.size]
        for t, values in zip(self.table, ((to + np.clip(share, 0, 1 - 1e-9))[order] + self.count, pid[order], step[order], final)):
            t[self.size : need] = values
        states = len(u) + len(size)
        if self.count + states > len(self.arc):
            arc = np.empty((self.count + states) * 3 // 2, np.int32)
            arc[: self.count] = self.arc[: self.count]
            self.arc = arc
        n = np.bincount(to, minlength=states)
        self.arc[self.count : self.count + states] = self.size + np.cumsum(n) - n
        for k, f in zip(keys.tolist(), (off[:-1] + np.arange(len(size)) + self.count).tolist()):
            self.first[k] = f
        self.size, self.count = need, self.count + states

    def arrays(self):
        """(state + cumulative share, piece, length, whether it is its state's last) of all arcs."""
        return [t[: self.size] for t in self.table]


def prefix(cp: np.ndarray) -> np.ndarray:
    """As prefix_hash, over code points."""
    up, _ = C.powers(len(cp) + 1)
    return C.running((cp.astype(C.U64) + C.U64(1)) * up[: len(cp)])


def unit_bounds(cp: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of the units: a space after another character, a line feed, what follows one, every row, and each UNIT more."""
    start = np.zeros(len(cp), bool)
    start[off[:-1][off[:-1] < len(cp)]] = True
    start[1:] |= ((cp[1:] == 32) & (cp[:-1] != 32)) | (cp[1:] == 10) | (cp[:-1] == 10)
    start = np.flatnonzero(start)
    n = -(-np.diff(np.append(start, len(cp))) // UNIT)
    return np.repeat(start, n) + UNIT * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))


def uniform(row: np.ndarray, place: np.ndarray, step: int, seed: int) -> np.ndarray:
    x = C.mix(row + place.astype(C.U64) * C.MIX_A + C.U64((step * 0x9E3779B97F4A7C15 + seed * 0xD6E8FEB86659FD93) % (1 << 64)))
    return (x >> C.U64(11)).astype(np.float64) * 2.0**-53


def sample(texts: list[str], keys: np.ndarray, lat: Lattices, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, row offsets) of the texts."""
    raw = code_points("".join(texts))
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    if not len(raw):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    start = unit_bounds(raw, off)
    end = np.append(start[1:], len(raw))
    row = np.searchsorted(off, start, side="right") - 1
    h = C.span_hash(prefix(raw), start, end)
    uniq, one, at = np.unique(h, return_index=True, return_inverse=True)
    if len(lat.first) > KEEP or lat.count > KEEP_STATES:
        lat.clear()
    new = np.array([u not in lat.first for u in uniq.tolist()], bool)
    if new.any():
        lat.add(uniq[new], raw, start[one[new]], end[one[new]])
    upto, piece, length, last = lat.arrays()
    base = np.array([lat.first[u] for u in uniq.tolist()], np.int64)[at]
    state = base + end - start
    first_unit = np.searchsorted(row, np.arange(len(texts)))
    place = np.arange(len(start)) - first_unit[row]
    salt = keys[row]
    live, got, step = np.arange(len(start)), [], 0
    while len(live):
        s = state[live]
        draw = s + uniform(salt[live], place[live], step, seed)
        a = lat.arc[s].astype(np.int64)
        more = np.flatnonzero((upto[a] <= draw) & (last[a] == 0))
        while len(more):
            a[more] += 1
            more = more[(upto[a[more]] <= draw[more]) & (last[a[more]] == 0)]
        got.append((live, piece[a]))
        state[live] = s - length[a]
        live = live[state[live] > base[live]]
        step += 1
    occ = np.concatenate([x for x, _ in got])
    pid = np.concatenate([x for _, x in got])
    back = np.repeat(np.arange(len(got)), [len(x) for x, _ in got])
    order = np.lexsort((-back, occ))
    occ, pid = occ[order], pid[order]
    odd = np.flatnonzero(pid < 0)
    if len(odd):  # characters by their bytes
        spelled = [[lat.bytes[b] for b in chr(-int(pid[i]) - 1).encode("utf-8", "surrogatepass")] for i in odd]
        n = np.ones(len(pid), np.int64)
        n[odd] = [len(x) for x in spelled]
        to = np.cumsum(n)
        wide = np.repeat(pid, n)
        wide[np.concatenate([np.arange(to[i] - n[i], to[i]) for i in odd])] = np.concatenate(spelled)
        pid, occ = wide, np.repeat(occ, n)
    return pid.astype(np.int32), np.searchsorted(row[occ], np.arange(len(texts) + 1))


def decode(ids: np.ndarray, table: list[bytes]) -> str:
    return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "surrogatepass")


def byte_table(pieces: list[tuple[str, int]]) -> list[bytes]:
    return [bytes([int(p[3:5], 16)]) if kind == 6 else p.replace(SPACE_MARK, " ").encode() if kind == 1 else b"" for p, kind in pieces]


def _encode(pieces, seed: int, digest: bool):
    def run(batches):
        lat, table = Lattices(pieces.value), byte_table(pieces.value)
        size = np.array([len(t) for t in table], np.int64)
        whole = np.frombuffer(b"".join(table), np.uint8)
        at = np.concatenate([[0], np.cumsum(size)])
        for batch in batches:
            column = batch.column("body")
            buf, off = C.flat(column)
            for lo, hi in C.pieces(off):
                part = column.slice(lo, hi - lo)
                texts = [t or "" for t in part.to_pylist()]
                ids, o = sample(texts, batch.column("rid").slice(lo, hi - lo).to_numpy().view(C.U64), lat, seed)
                null = part.is_null().to_numpy(zero_copy_only=False)
                rest = [batch.column(0).slice(lo, hi - lo)]
                if not digest:
                    o32 = pa.array(np.where(np.append(null, False), 0, o).astype(np.int32), mask=np.append(null, False))
                    yield pa.record_batch([*rest, pa.ListArray.from_arrays(o32, pa.array(ids)) if len(ids) else pa.array([None if x else [] for x in null], pa.list_(pa.int32()))], ["rest", "pieces"])
                    continue
                n = size[ids]
                to = np.cumsum(n)
                back = whole[np.arange(to[-1] if len(to) else 0) - np.repeat(to - n - at[ids], n)].tobytes()  # decoding, all rows at once
                edge = np.concatenate([[0], to])[o]
                same = [back[edge[i] : edge[i + 1]] == t.encode("utf-8", "surrogatepass") for i, t in enumerate(texts)]
                crc = [zlib.crc32(ids[o[i] : o[i + 1]].tobytes()) for i in range(len(texts))]
                yield pa.record_batch([*rest, pa.array(np.diff(o)), pa.array(crc, pa.int64()), pa.array(same)], ["rest", "n_pieces", "pieces_crc32", "lossless"])

    return run


OWN = {"pieces", "n_pieces", "pieces_crc32", "lossless"}


def _rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    rest = [c for c in docs.columns if c.lower() not in OWN]
    return C.short_batches(docs).select(F.struct(*rest).alias("rest"), F.xxhash64(key).alias("rid"), F.col(text).alias("body"))


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """docs with pieces array<int>, a sampled segmentation of each text."""
    rows = _rows(docs, text, key)
    pieces = docs.sparkSession.sparkContext.broadcast(read_pieces(path))
    return rows.mapInArrow(_encode(pieces, seed, False), f"rest {rows.dtypes[0][1]}, pieces array<int>").select("rest.*", "pieces")


def decoded(coded: DataFrame, path: str, column: str = "pieces", text: str = "text") -> DataFrame:
    """coded with its pieces put back together as `text`."""
    pieces = coded.sparkSession.sparkContext.broadcast(read_pieces(path))
    rest = [c for c in coded.columns if c != text]
    rows = C.short_batches(coded).select(F.struct(*rest).alias("rest"), F.col(column).alias("ids"))

    def run(batches):
        table = byte_table(pieces.value)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            yield pa.record_batch([batch.column(0), pa.array([None if x is None else decode(np.array(x, np.int64), table) for x in ids], pa.string())], ["rest", "text"])

    return rows.mapInArrow(run, f"rest {rows.dtypes[0][1]}, text string").select("rest.*", F.col("text").alias(text))


def digests(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """docs with the number of pieces, their CRC-32 as little-endian int32, and whether decoding gave the text back."""
    rows = _rows(docs, text, key)
    pieces = docs.sparkSession.sparkContext.broadcast(read_pieces(path))
    made = rows.mapInArrow(_encode(pieces, seed, True), f"rest {rows.dtypes[0][1]}, n_pieces long, pieces_crc32 long, lossless boolean")
    return made.select("rest.*", "n_pieces", "pieces_crc32", "lossless")


def op9_piece_sampling(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs, model_path()).drop("text")
