"""Exact Jaccard self-join on word shingles (operator 2).

Universe-partition pigeonhole. Sets of sizes a and b with Jaccard similarity p/q or more differ in at most
H = (a + b)(q - p) / (q + p) elements. Sizes fall into bands; a band splits the hash universe into m segments, so a pair
that differs in H elements agrees on all but H of them. A set is indexed by the sum of the hashes in each segment:

* allocation by cost: an empty segment is shared by everyone and costs the most, so it gets nothing, and any H + 1 filled
  segments suffice, one of which must be equal in the partner;
* a set with fewer filled segments indexes its one-deletion neighbourhoods too (and then its empty segments), which
  makes each filled segment count twice.

Sets are collapsed to their hash first: copies are one node. Candidates that share an index entry are linked through
their smallest member only, and verified exactly on the shingles. Where such a check fails, the members of all groups with
that smallest member form one unit, and those still in different components are told apart by sizes and parity bitmaps,
which bound a difference from below (block by block if there are many). Each member first brings its nearest partner to
the exact check, then its nearest few; what these link needs no further pair, and the last round brings all that is left,
so no link between components is missed. An entry that a map task sees more than `HOT` times is combined there.

Null or empty texts have no shingles and are their own component; a null id stays null but its text still links; other
columns are ignored; an empty table gives an empty result. Shingles are compared as 64-bit hashes.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WORDS, P, Q = 5, 3, 4
#: Sizes of a band grow by this ratio; segments beyond H + 1, so that empty ones can be left out.
RATIO, SPARE = 1.5, 1.25
HOT, BLOCK = 32, 4000
#: How many nearest partners each member brings to the exact check, round by round; the last round brings all.
NEAREST = (1, 8, 64, None)
#: Pairs that are told apart by bitmaps in one step.
STEP = 500_000
#: Index records that a map task combines before they are sent on.
FLUSH = 600_000
#: Representatives that are broadcast at most (24 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000
SIG_SALT = C.U64(0xD6E8FEB86659FD93)
#: The bits of a key that pack() sends; they name a hot entry's group for map tasks and the reducer alike.
LOW = C.U64((1 << 40) - 1)


# --- shingles -----------------------------------------------------------------------------------------------------------


def shingles(buf: np.ndarray, off: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row offsets): the distinct k-word shingles of each row, ascending."""
    n = len(off) - 1
    s, e, row = C.words(buf, off)
    w = C.span_hash(C.prefix_hash(C.LOWER[buf]), s, e)
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    long = count >= k
    room = np.where(long, count - k + 1, (count > 0).astype(np.int64))
    to = np.cumsum(room)
    at = np.arange(to[-1] if n else 0) - np.repeat(to - room - first, room)
    h = np.zeros(len(at), C.U64)
    if len(at):
        full = np.repeat(long, room)
        x = at[full]
        acc = np.zeros(len(x), C.U64)
        for j in range(k):
            acc = (acc + w[x + j]) * C.MIX_B
        h[full] = acc
        for i in np.flatnonzero(~long & (count > 0)):
            acc = C.U64(0)
            with np.errstate(over="ignore"):
                for y in w[first[i] : first[i] + count[i]]:
                    acc = (acc + y) * C.MIX_B
                h[to[i] - 1] = acc + C.U64(count[i])
        h = C.mix(h)
    out, size = [], np.zeros(n + 1, np.int64)
    for i in np.flatnonzero(room):
        x = np.sort(h[to[i] - room[i] : to[i]])
        x = x[np.append(True, x[1:] != x[:-1])]
        out.append(x)
        size[i + 1] = len(x)
    return (np.concatenate(out) if out else h), np.cumsum(size)


def set_ids(tok: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One 64-bit id for each non-empty row's set."""
    acc = C.running(C.mix(tok ^ SIG_SALT))
    n = np.diff(off).astype(C.U64)
    return C.mix(acc[off[1:]] - acc[off[:-1]] + n * C.MIX_A).view(np.int64)


def bitmap(tok: np.ndarray) -> bytes:
    """Parity bits, two to four for each element: two sets differ in at least as many elements as their bitmaps in bits.

    The number of bits is a power of two, so a larger bitmap folds onto a smaller one by exclusive or.
    """
    bits = max(256, 1 << int(2 * len(tok) - 1).bit_length()) if len(tok) else 256
    odd = np.bincount((C.mix(tok + SIG_SALT) >> C.U64(32)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def gaps(bits: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many bits bitmaps i and j differ, the larger folded onto the smaller."""
    wide = np.array([len(b) for b in bits])
    place, stacks = np.zeros(len(bits), np.int64), {}
    for w in np.unique(wide).tolist():
        own = np.flatnonzero(wide == w)
        place[own] = np.arange(len(own))
        stacks[w] = np.frombuffer(b"".join([bits[x] for x in own]), C.U64).reshape(len(own), w // 8)

    def fold(x: np.ndarray, w: int) -> np.ndarray:
        while x.shape[1] * 8 > w:
            x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
        return x

    out = np.zeros(len(i), np.int64)
    kind = wide[i] * (1 << 32) + wide[j]
    for k in np.unique(kind).tolist():
        own = np.flatnonzero(kind == k)
        a, b = stacks[k >> 32], stacks[k & 0xFFFFFFFF]
        least = min(k >> 32, k & 0xFFFFFFFF)
        a, b = fold(a, least), fold(b, least)
        some = max(1, (1 << 22) // least)
        for s in range(0, len(own), some):
            x = own[s : s + some]
            out[x] = np.bitwise_count(a[place[i[x]]] ^ b[place[j[x]]]).sum(axis=1, dtype=np.int64)
    return out


# --- pigeonhole index ---------------------------------------------------------------------------------------------------


@functools.cache
def bands(p: int = P, q: int = Q) -> np.ndarray:
    edge = [1]
    while edge[-1] < 1 << 31:
        edge.append(max(edge[-1] + 1, int(edge[-1] * RATIO)))
    return np.array(edge, np.int64)


def differ(a, b, p: int, q: int):
    return (a + b) * (q - p) // (q + p)


def index_keys(tok: np.ndarray, off: np.ndarray, p: int = P, q: int = Q) -> tuple[np.ndarray, np.ndarray]:
    """(key, row): the index entries of every row's set."""
    size = np.diff(off)
    edge = bands(p, q)
    own = np.searchsorted(edge, size, side="right") - 1
    weight = C.mix(tok + C.MIX_B)
    keys, rows = [], []
    for back in range(0, 8):
        band = own - back
        top = edge[np.maximum(band, 0) + 1] - 1
        use = (size > 0) & (band >= 0) & (size <= top * q // p)
        most = np.where(back == 0, size * q // p, top)  # size of the largest partner that this band brings
        h = differ(size, np.minimum(most, size * q // p), p, q)
        m = np.ceil(SPARE * (differ(top, top * q // p, p, q) + 1)).astype(np.int64)
        use &= h > 0  # else only an equal set would do
        if not use.any():
            break
        t = np.flatnonzero(np.repeat(use, size))
        r = np.repeat(np.arange(len(size)), size)[t]
        seg = ((tok[t] >> C.U64(32)) * m[r].astype(C.U64) >> C.U64(32)).astype(np.int64)
        new = np.append(True, (r[1:] != r[:-1]) | (seg[1:] != seg[:-1]))
        start = np.flatnonzero(new)
        total = np.add.reduceat(weight[t], start)
        key = lambda total, r, seg: C.mix(total + C.mix((band[r] * (1 << 32) + seg).astype(C.U64) + SIG_SALT))  # noqa: B023, E731
        keys.append(key(total, r[start], seg[start]))
        rows.append(r[start])
        filled = np.bincount(r[start], minlength=len(size))
        poor = use & (filled <= h)
        if poor.any():
            run = np.cumsum(new) - 1
            x = np.flatnonzero(poor[r])
            keys.append(key(total[run[x]] - weight[t[x]], r[x], seg[x]))
            rows.append(r[x])
            gap_r = np.repeat(np.flatnonzero(poor), m[poor])
            gap_s = np.arange(len(gap_r)) - np.repeat(np.cumsum(m[poor]) - m[poor], m[poor])
            there = set(zip(r[start[poor[r[start]]]].tolist(), seg[start[poor[r[start]]]].tolist()))
            empty = np.array([(a, b) not in there for a, b in zip(gap_r.tolist(), gap_s.tolist())], bool)
            keys.append(key(np.zeros(int(empty.sum()), C.U64), gap_r[empty], gap_s[empty]))
            rows.append(gap_r[empty])
    if not keys:
        return np.zeros(0, C.U64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(rows)


ENTRY, PAIR, GROUP, DOC = 0, 1, 2, 3
OUT = "kind byte, bucket int, a long, b long, n int, members array<long>, data binary"
NAMES = [f.split()[0] for f in OUT.split(", ")]
TYPES = [pa.int8(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary()]


def batch_of(kind: int, rows: int, /, **cols) -> pa.RecordBatch:
    made = {"kind": np.full(rows, kind, np.int8), **cols}
    return pa.record_batch([pa.array(made[c], t) if c in made else pa.nulls(rows, t) for c, t in zip(NAMES, TYPES)], NAMES)


def pack(key: np.ndarray, sid: np.ndarray, hot: np.ndarray, n: int):
    """Blobs for each bucket: a table of set ids, 40 bits of each key, and where in the table its set is."""
    order = np.argsort(key, kind="stable")
    key, sid, hot = key[order], sid[order], hot[order]
    b = C.bucket_of(key, n)
    edge = np.searchsorted(b, np.arange(n + 1))
    for i in np.flatnonzero(edge[1:] > edge[:-1]):
        s, e = edge[i], edge[i + 1]
        table, at = np.unique(sid[s:e], return_inverse=True)
        low = key[s:e].view(np.uint8).reshape(-1, 8)[:, :5]
        head = np.array([len(table), e - s], "<u4")
        yield int(i), b"".join(x.tobytes() for x in (head, table, low, (at.astype("<u4") << 1) | hot[s:e]))


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t, k = np.frombuffer(data, "<u4", 2)
    table = np.frombuffer(data, "<i8", t, 8)
    key = np.zeros((k, 8), np.uint8)
    key[:, :5] = np.frombuffer(data, np.uint8, 5 * k, 8 + 8 * t).reshape(-1, 5)
    at = np.frombuffer(data, np.uint8, 4 * k, 8 + 8 * t + 5 * k).view("<u4")
    return key.view("<u8").ravel(), table[at >> 1], (at & 1).astype(bool)


def runs_of(key: np.ndarray, sid: np.ndarray, hot: np.ndarray):
    """Distinct (key, set) in order, and the bounds of each key's run; hot marks add up."""
    order = np.lexsort((~hot, sid, key))
    key, sid, hot = key[order], sid[order], hot[order]
    keep = np.append(True, (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])) if len(key) else np.zeros(0, bool)
    key, sid, hot = key[keep], sid[keep], hot[keep]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key, sid, hot, start, np.append(start[1:], len(key))


def star(sid: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Each distinct (smallest member, other member) of the runs."""
    n = end - start - 1
    at = np.repeat(start, n)
    x = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + at + 1
    ab = np.unique(np.stack([sid[at], sid[x]], axis=1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
    return batch_of(PAIR, len(ab), a=ab[:, 0], b=ab[:, 1], bucket=C.bucket_of(C.mix(ab[:, 1].astype(np.int64).view(C.U64)), 1 << 20))


def map_index(n: int, k: int, p: int, q: int):
    def flush(keys, sids):
        key, sid, hot, start, end = runs_of(np.concatenate(keys), np.concatenate(sids), np.zeros(sum(map(len, keys)), bool))
        many = end - start > HOT
        if many.any():
            s, e = start[many], end[many]
            yield star(sid, s, e)
            yield batch_of(GROUP, len(s), a=sid[s], b=(key[s] & LOW).view(np.int64), members=[sid[i:j] for i, j in zip(s, e)], bucket=C.bucket_of(key[s], n))
            hot[s] = True
            drop = np.zeros(len(key) + 1, np.int8)
            np.add.at(drop, s + 1, 1)
            np.add.at(drop, e, -1)
            keep = np.cumsum(drop[:-1]) == 0
            key, sid, hot = key[keep], sid[keep], hot[keep]
        pairs = list(pack(key, sid, hot, n))
        yield batch_of(ENTRY, len(pairs), bucket=[b for b, _ in pairs], data=[d for _, d in pairs])

    def run(batches):
        keys, sids, held = [], [], 0
        for batch in batches:
            buf, off = C.flat(batch.column(1))
            for lo, hi in C.pieces(off):
                tok, o = shingles(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], k)
                size, sid = np.diff(o), set_ids(tok, o)
                ids = batch.column(0).slice(lo, hi - lo)
                yield batch_of(DOC, hi - lo, a=ids, n=size.astype(np.int32), b=pa.array(sid, mask=size == 0), data=[bitmap(tok[i:j]) for i, j in zip(o[:-1], o[1:])], bucket=C.bucket_of(C.mix(sid.view(C.U64)), n))
                key, row = index_keys(tok, o, p, q)
                keys.append(key)
                sids.append(sid[row])
                held += len(key)
                if held > FLUSH:
                    yield from flush(keys, sids)
                    keys, sids, held = [], [], 0
        if held:
            yield from flush(keys, sids)

    return run


def meet_index(batches):
    keys, sids, hots = [], [], []
    for batch in batches:
        t = pa.Table.from_batches([batch])
        entry = t.column("kind").to_numpy() == ENTRY
        if not entry.all():
            yield from t.filter(pa.array(~entry)).to_batches()
        for d in t.filter(pa.array(entry)).column("data").to_pylist():
            key, sid, hot = unpack(d)
            keys.append(key)
            sids.append(sid)
            hots.append(hot)
    if not keys:
        return
    key, sid, hot, start, end = runs_of(np.concatenate(keys), np.concatenate(sids), np.concatenate(hots))
    del keys, sids, hots
    any_hot = np.maximum.reduceat(hot, start)
    two = end - start > 1
    yield star(sid, start[two], end[two])
    # groups of three and more, or that a map task has combined; equal lists of members need one row
    more = (end - start > 2) | (any_hot & two)
    s, e, warm = start[more], end[more], any_hot[more]
    acc = C.running(C.mix(sid.view(C.U64)))
    gid = np.where(warm, key[s], C.mix(acc[e] - acc[s]))
    _, one = np.unique(gid, return_index=True)
    for i in range(0, len(one), 2000):
        pick = one[i : i + 2000]
        yield batch_of(GROUP, len(pick), a=sid[s[pick]], b=gid[pick].view(np.int64), members=[sid[x:y] for x, y in zip(s[pick], e[pick])])


# --- verification -------------------------------------------------------------------------------------------------------


def map_sets(k: int):
    def run(batches):
        for batch in batches:
            buf, off = C.flat(batch.column(0))
            for lo, hi in C.pieces(off):
                tok, o = shingles(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], k)
                rows = [tok[i:j] for i, j in zip(o[:-1], o[1:])]
                yield pa.record_batch([pa.array(set_ids(tok, o)), pa.array(np.diff(o).astype(np.int32)), pa.array([x.tobytes() for x in rows], pa.binary())], ["sid", "n", "tok"])

    return run


def similar(p: int, q: int):
    def run(batches):
        for batch in batches:
            xs, ys = batch.column(2), batch.column(3)
            ok = np.zeros(len(batch), bool)
            for i in range(len(batch)):
                x, y = np.frombuffer(xs[i].as_buffer(), C.U64), np.frombuffer(ys[i].as_buffer(), C.U64)
                if len(x) < len(y):
                    x, y = y, x
                if p * len(x) <= q * len(y):
                    at = np.searchsorted(x, y)
                    at[at == len(x)] = 0
                    both = int((x[at] == y).sum())
                    ok[i] = both * q >= p * (len(x) + len(y) - both)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(ok)], ["a", "b", "ok"])

    return run


def plausible(p: int, q: int):
    """Pairs whose sizes and bitmaps leave room for the similarity; the others are told apart without their sets."""

    def run(batches):
        for batch in batches:
            na, nb = batch.column("a_n").to_numpy(), batch.column("b_n").to_numpy()
            bits = batch.column("a_bits").to_pylist() + batch.column("b_bits").to_pylist()
            gap = gaps(bits, np.arange(len(na)), len(na) + np.arange(len(na)))
            ok = (gap <= differ(na, nb, p, q)) & (p * np.maximum(na, nb) <= q * np.minimum(na, nb))
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(ok)], ["a", "b", "maybe"])

    return run


def screen(pairs: DataFrame, nodes: DataFrame, p: int, q: int) -> DataFrame:
    side = lambda c: nodes.select(F.col("sid").alias(c), F.col("n").alias(f"{c}_n"), F.col("bits").alias(f"{c}_bits"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(plausible(p, q), "a long, b long, maybe boolean")


def verify(pairs: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    side = lambda c: sets.select(F.col("sid").alias(c), F.col("tok").alias(f"{c}_tok"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_tok", "b_tok").mapInArrow(similar(p, q), "a long, b long, ok boolean")


def nearest_few(i: np.ndarray, j: np.ndarray, gap: np.ndarray, sid: np.ndarray, most: int) -> np.ndarray:
    """Which pairs (i, j) are among the `most` nearest of one of their ends; equal gaps by the other end's id."""
    own, other = np.concatenate([i, j]), np.concatenate([j, i])
    order = np.lexsort((sid[other], np.concatenate([gap, gap]), own))
    new = np.append(True, own[order][1:] != own[order][:-1])
    rank = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    keep = np.zeros(len(i), bool)
    keep[order[rank < most] % len(i)] = True
    return keep


def cross_pairs(p: int, q: int, most: int | None):
    """Over members sorted by block: pairs in different components that sizes and bitmaps don't rule out.

    With `most`, only the nearest of each member; a row without a pair names each block that has more.
    """

    def told_apart(rows: tuple, i: list[np.ndarray], j: list[np.ndarray]) -> pa.RecordBatch:
        block, sid, n, bits = rows
        i, j = np.concatenate(i), np.concatenate(j)
        use = np.unique(np.concatenate([i, j]))
        spot = np.zeros(len(sid), np.int64)
        spot[use] = np.arange(len(use))
        gap = gaps([bits[x].as_py() for x in use.tolist()], spot[i], spot[j])
        near = gap <= differ(n[i].astype(np.int64), n[j], p, q)
        i, j, gap, left = i[near], j[near], gap[near], np.zeros(0, np.int64)
        if most is not None and len(i):
            keep = nearest_few(i, j, gap, sid, most)
            left = np.unique(block[i[~keep]])
            i, j = i[keep], j[keep]
        ab = np.unique(np.stack([np.minimum(sid[i], sid[j]), np.maximum(sid[i], sid[j])], axis=1), axis=0)
        none = pa.nulls(len(left), pa.int64())
        return pa.record_batch([pa.concat_arrays([pa.nulls(len(ab), pa.int64()), pa.array(left)]), *(pa.concat_arrays([pa.array(np.ascontiguousarray(c)), none]) for c in ab.T)], ["more", "a", "b"])

    def run(batches):
        carry = None
        for last, batch in marked(batches):
            t = pa.Table.from_batches([batch]) if carry is None else pa.concat_tables([carry, pa.Table.from_batches([batch])])
            carry = None
            block = t.column("block").to_numpy()
            edge = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, np.int64)
            if not last and len(edge):
                carry, t = t.slice(edge[-1]), t.slice(0, edge[-1])
                block, edge = block[: edge[-1]], edge[:-1]
            t = t.combine_chunks()
            if not len(t):
                continue
            sid, comp, n, part = (t.column(c).to_numpy() for c in ("sid", "comp", "n", "part"))
            rows, held, gi, gj = (block, sid, n, t.column("bits").chunk(0)), 0, [], []
            for s, e in zip(edge, np.append(edge[1:], len(block))):
                one = part[s] == 0  # a block with itself: each pair once
                x, y = s + np.flatnonzero(part[s:e] != 2), s + np.flatnonzero(part[s:e] != 1)
                for at in range(0, len(x), 500):
                    xs = x[at : at + 500]
                    ok = (comp[xs][:, None] != comp[y]) & (p * np.maximum(n[xs][:, None], n[y]) <= q * np.minimum(n[xs][:, None], n[y]))
                    if one:
                        ok &= xs[:, None] < y
                    a, b = np.nonzero(ok)
                    gi.append(xs[a])
                    gj.append(y[b])
                    held += len(a)
                    if held > STEP:
                        yield told_apart(rows, gi, gj)
                        held, gi, gj = 0, [], []
            if held:
                yield told_apart(rows, gi, gj)

    return run


def marked(batches):
    """(whether it is the last, batch)."""
    it = iter(batches)
    now = next(it, None)
    while now is not None:
        nxt = next(it, None)
        yield nxt is None, now
        now = nxt


def components(edges: DataFrame) -> DataFrame:
    """(sid, comp) of every node of edges (a, b): smallest node of its component, by alternating star contraction."""
    now = C.cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u != v").distinct()
        made = C.cut(small)
        size = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if size(made) == size(now):
            return made.select(F.col("u").alias("sid"), F.col("v").alias("comp"))
        now = made


def united(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp (sid, comp) after more links (a, b)."""
    root = lambda c: comp.select(F.col("sid").alias(c), F.col("comp").alias(f"{c}_comp"))
    ends = links.join(root("a"), "a", "left").join(root("b"), "b", "left")
    edges = ends.select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b")).filter("a != b")
    # components() names no node that is its own root, so a node moved now is no sid of comp
    moved = components(edges)
    now = comp.join(moved.select(F.col("sid").alias("comp"), F.col("comp").alias("to")), "comp", "left")
    return C.cut(now.select("sid", F.coalesce("to", "comp").alias("comp")).unionByName(moved))


def doubtful(groups: DataFrame, doubt: DataFrame) -> DataFrame:
    """(unit, sid): the members of all groups in doubt, put together by the smallest member of each group.

    A hot entry has a row, and a centre, for each flush: all its rows are opened if one centre is in doubt.
    """
    rows = groups.select("a", F.col("b").alias("gid"), "members")
    gids = rows.select("a", "gid").join(doubt, "a", "left_semi").select("gid").distinct()
    unit = rows.select("a", "gid").join(gids, "gid", "left_semi").groupBy("gid").agg(F.min("a").alias("unit"))
    return rows.join(unit, "gid").select("unit", F.explode("members").alias("sid")).distinct()


def blocks_apart(apart: DataFrame, comp: DataFrame) -> DataFrame:
    """(block, sid, part) of units in several components; large ones in all pairs of their blocks."""
    now = apart.join(comp, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    sizes = now.groupBy("unit").agg(F.count("*").alias("m"), F.min("comp").alias("x"), F.max("comp").alias("y"))
    sizes = C.cut(sizes.filter("x < y").select("unit", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")))
    mine = F.pmod(F.xxhash64("sid"), "blocks").cast("int")
    spread = apart.join(sizes, "unit").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.select(
        F.xxhash64("unit", F.least("mine", "other"), F.greatest("mine", "other")).alias("block"), "sid",
        F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).alias("part"),
    )


def sets_of(rows: DataFrame, members: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(sid, n, tok) of every set in pairs, made again from the text of one of its documents."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    one = C.cut(members.join(ends, "sid", "left_semi").groupBy("sid").agg(F.min("id").alias("id")).select("id").distinct())
    n = one.count()
    twice = members.select("id").join(one, "id", "left_semi").groupBy("id").count().filter("count > 1")
    told = F.broadcast(one) if n <= BROADCAST_ROWS else one
    sets = rows.join(told, rows["id"].eqNullSafe(told["id"]), "left_semi").select("body").mapInArrow(C.in_steps(map_sets(k)), "sid long, n int, tok binary").filter("n > 0")
    return sets if twice.isEmpty() and one.filter("id is null").isEmpty() else sets.dropDuplicates(["sid"])


def jaccard_components(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = WORDS, p: int = P, q: int = Q) -> DataFrame:
    """(key, n_shingles, component_id) of every row; key is a long."""
    spark: SparkSession = docs.sparkSession
    n = 2 * C.parts(spark)
    rows = C.short_batches(docs).select(F.col(key).cast("long").alias("id"), F.col(text).alias("body"))
    met = C.cut(rows.mapInArrow(C.in_steps(map_index(n, k, p, q)), OUT).repartitionById(n, "bucket").mapInArrow(C.in_steps(meet_index), OUT).drop("bucket"))
    members = met.filter(f"kind = {DOC}").select(F.col("a").alias("id"), F.col("b").alias("sid"), "n")
    nodes = C.cut(met.filter(f"kind = {DOC} and b is not null").select(F.col("b").alias("sid"), "n", F.col("data").alias("bits")).dropDuplicates(["sid"]))
    screened = C.cut(screen(met.filter(f"kind = {PAIR}").select("a", "b").distinct(), nodes, p, q))
    pairs = screened.filter("maybe").select("a", "b")
    sets = C.cut(sets_of(rows, members, pairs, k))
    checked = C.cut(verify(pairs, sets, p, q).unionByName(screened.filter("not maybe").select("a", "b", F.lit(False).alias("ok"))))
    C.drop_cut(sets)
    C.drop_cut(screened)
    comp = components(checked.filter("ok").select("a", "b"))
    doubt = checked.filter("not ok").select("a").distinct()
    open_ = C.cut(blocks_apart(C.cut(doubtful(met.filter(f"kind = {GROUP}"), doubt)), comp))
    for most in NEAREST:
        blocks = open_.join(comp, "sid", "left").join(nodes, "sid").select("block", "sid", F.coalesce("comp", "sid").alias("comp"), "n", "bits", "part")
        near = C.cut(blocks.repartition(n, "block").sortWithinPartitions("block").mapInArrow(C.in_steps(cross_pairs(p, q, most)), "more long, a long, b long").distinct())
        new = C.cut(near.filter("more is null").select("a", "b").join(checked, ["a", "b"], "left_anti"))
        if not new.isEmpty():
            told = C.cut(verify(new, sets_of(rows, members, new, k), p, q))
            checked = checked.unionByName(told)
            comp = united(comp, told.filter("ok").select("a", "b"))
        left = near.filter("more is not null").select(F.col("more").alias("block"))
        if left.isEmpty():
            break
        open_ = open_.join(left, "block", "left_semi")
    whole = members.join(comp, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    # a table of its own, so that a hot component's side of the join can be split
    least = C.cut(whole.groupBy("comp").agg(F.min("id").alias("least")))
    out = whole.join(least, "comp", "left")
    return out.select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("sid").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))


def op2_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
