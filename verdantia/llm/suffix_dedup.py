"""Suffix-array removal of long repeated byte strings (operator 1).

Every maximal run of bytes covered by a `length`-byte string that also starts anywhere else is found exactly:

1. Each window of `length` bytes has one anchor: its first minimal k-gram. Equal windows have equal anchors at equal
   offsets, so suffixes meet only where their anchors' k-grams are equal; all others are never sorted.
2. Neighbouring windows with the same anchor form one slice. Slices that occur twice are repeats as a whole; counts are
   combined in each map task before the shuffle, so a hot passage sends one record from a task.
3. The other slices of a k-gram are sorted as suffixes, to the right of the anchor and, reversed, to its left:
   multikey quicksort to a shallow depth, then a blind trie for each group that still shares its prefix. The common
   prefix lengths of neighbours tell which windows have a twin. A k-gram with more than `group` different slices is
   decided window by window in a distributed count instead, with the same result.

Rows are identified by a hash of id and text. Null or empty texts have no bytes and lose nothing; identical rows are
copies of each other and each gets the same result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LENGTH, GROUP = 200, 4096
#: Words of eight bytes that multikey quicksort looks at before blind tries take over.
SHALLOW = 2
#: Map-side records that are combined before they are sent on.
FLUSH = 200_000
#: Bytes of slices, or of texts, that leave a task at once.
OUTPUT = 4 << 20
ANCHOR = np.dtype([("kh", "<u8"), ("sh", "<u8"), ("rid", "<i8"), ("a", "<i4"), ("lo", "<i4"), ("hi", "<i4"), ("done", "u1")])
WINDOW = np.dtype([("h", "<u8"), ("rid", "<i8"), ("p", "<i4")])


# --- suffix sorting -------------------------------------------------------------------------------------------------


def common_prefix(x: bytes, y: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be at least start."""
    hi = min(len(x), len(y))
    if x[start:hi] == y[start:hi]:
        return hi
    lo = start
    while hi - lo > 8:
        mid = (lo + hi) // 2
        if x[lo:mid] == y[lo:mid]:
            lo = mid
        else:
            hi = mid
    while x[lo] == y[lo]:
        lo += 1
    return lo


def blind_trie(items: list[int], text: list[bytes], depth: int) -> list[int]:
    """Order strings that agree on their first depth bytes: a trie of branching depths only, checked against one leaf."""
    root: list = [None, None, items[0]]  # [depth, {byte: child}, a leaf below]; a leaf has no children
    same: dict[int, list[int]] = {items[0]: [items[0]]}
    at = lambda s, d: s[d] if d < len(s) else -1
    for i in items[1:]:
        s, node, path = text[i], root, []
        while node[1] is not None:
            path.append(node)
            nxt = node[1].get(at(s, node[0]))
            if nxt is None:
                break
            node = nxt
        leaf = node[2]
        n = common_prefix(s, text[leaf], depth)
        if n == len(s) == len(text[leaf]):
            same[leaf].append(i)
            continue
        same[i] = [i]
        spot = next((x for x in [*path, node] if x[1] is None or x[0] >= n), node)
        if spot[1] is not None and spot[0] == n:
            spot[1][at(s, n)] = [None, None, i]
        else:
            spot[:] = [n, {at(text[spot[2]], n): [*spot], at(s, n): [None, None, i]}, spot[2]]
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node[1] is None:
            out += same[node[2]]
        else:
            stack += [node[1][b] for b in sorted(node[1], reverse=True)]
    return out


def deep_shallow(text: list[bytes], depth: int) -> list[int]:
    """Indices in the order of their strings, which agree on the first depth bytes."""
    out: list[int] = []
    stack = [(list(range(len(text))), depth)]
    word = lambda i, d: (text[i][d : d + 8].ljust(8, b"\0"), len(text[i][d : d + 8]))
    while stack:
        items, d = stack.pop()
        if len(items) < 2:
            out += items
        elif d - depth >= 8 * SHALLOW:
            out += blind_trie(items, text, d)
        else:
            keys = {i: word(i, d) for i in items}
            pivot = sorted((keys[items[0]], keys[items[len(items) // 2]], keys[items[-1]]))[1]
            less, equal, more = [], [], []
            for i in items:
                (less if keys[i] < pivot else equal if keys[i] == pivot else more).append(i)
            stack.append((more, d))
            if pivot[1] < 8:  # all of these ended here
                stack += [([i], d) for i in reversed(equal)]
            else:
                stack.append((equal, d + 8))
            stack.append((less, d))
    return out


def neighbour_lcp(text: list[bytes], order: list[int], depth: int) -> np.ndarray:
    return np.array([common_prefix(text[x], text[y], depth) for x, y in zip(order, order[1:])], np.int64)


def repeated_windows(slices: list[tuple[int, int, int, bytes]], length: int, k: int) -> list[list[tuple[int, int]]]:
    """For each slice (a, lo, hi, bytes from lo to hi + length): runs of window starts with a twin in another slice."""
    left = [s[a - lo + k - 1 :: -1] if a - lo + k > 0 else b"" for a, lo, _, s in slices]
    right = [s[a - lo :] for a, lo, _, s in slices]
    m, span = len(slices), length - k + 1
    r = np.arange(span)  # offset of the anchor in a window
    if m == 2:
        at = common_prefix(left[0], left[1], k) - k
        to = common_prefix(right[0], right[1], k)
        hit = np.broadcast_to((r >= length - to) & (r <= at), (2, span))
    else:
        orders = [deep_shallow(x, k) for x in (left, right)]
        lcps = [neighbour_lcp(x, o, k) for x, o in zip((left, right), orders)]
        if m <= 64:
            near = []
            for order, lcp in zip(orders, lcps):
                full = np.zeros((m, m), np.int64)
                for i in range(m - 1):
                    full[i, i + 1 :] = np.minimum.accumulate(lcp[i:])
                full += full.T
                place = np.empty(m, np.int64)
                place[order] = np.arange(m)
                near.append(full[np.ix_(place, place)])
            lm, rm = near[0] - k, near[1]
            np.fill_diagonal(lm, -1)
            hit = ((r >= (length - rm)[:, :, None]) & (r <= lm[:, :, None])).any(axis=1)
        else:
            hit = np.zeros((m, span), bool)
            cls = [np.zeros(m, np.int64), np.zeros(m, np.int64)]
            for x in range(span):
                for side, most in ((0, x + k), (1, length - x)):
                    cls[side][orders[side]] = np.concatenate([[0], np.cumsum(lcps[side] < most)])
                key = cls[0] * m + cls[1]
                _, inv, n = np.unique(key, return_inverse=True, return_counts=True)
                hit[:, x] = n[inv] > 1
    out = []
    for (a, lo, hi, _), row in zip(slices, hit):
        on = np.concatenate([[0], row[a - hi : a - lo + 1].view(np.int8), [0]])  # by rising offset
        edge = np.flatnonzero(np.diff(on))
        out.append([(hi - int(e) + 1, hi - int(s)) for s, e in zip(edge[::2], edge[1::2])])
    return out


# --- anchors ----------------------------------------------------------------------------------------------------------


def anchors(buf: np.ndarray, off: np.ndarray, rid: np.ndarray, shift: int, length: int, k: int) -> np.ndarray:
    """A record for each run of windows with the same anchor in the rows off[i]:off[i+1] of buf; shift: of positions."""
    n, w = len(buf), length - k + 1
    if n < length:
        return np.zeros(0, ANCHOR)
    p = C.prefix_hash(buf)
    _, down = C.powers(n + 1)
    low = C.U64((1 << 28) - 1)
    gram = C.mix((p[k:] - p[:-k]) * down[: n - k + 1])
    key = (gram & ~low) | np.arange(len(gram), dtype=C.U64)
    step = 1
    while 2 * step <= w:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    if w > step:
        key = np.minimum(key[: -(w - step)], key[w - step :])
    at = (key & low).astype(np.int64)  # the anchor of the window that starts here
    room = np.maximum(np.diff(off) - length + 1, 0)
    row = np.repeat(np.arange(len(room)), room)
    start = np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room) + off[row]
    at = at[start]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    out = np.zeros(len(first), ANCHOR)
    a, lo, hi, base = at[first], start[first], start[last], off[row[first]]
    out["kh"] = gram[a]
    out["sh"] = C.mix(C.span_hash(p, lo, hi + length) + (a - lo).astype(C.U64) * C.MIX_A + (hi - a + w).astype(C.U64) * C.MIX_B)
    out["rid"] = rid[row[first]]
    out["a"], out["lo"], out["hi"] = a - base + shift, lo - base + shift, hi - base + shift
    return out


def of_texts(rid: np.ndarray, buf: np.ndarray, off: np.ndarray, length: int, k: int) -> Iterator[np.ndarray]:
    for lo, hi in C.pieces(off):
        b = buf[off[lo] : off[hi]]
        if len(b) <= 2 * C.CHUNK:
            yield anchors(b, off[lo : hi + 1] - off[lo], rid[lo:hi], 0, length, k)
        else:  # one very long text: overlapping pieces, each window in one of them
            for s in range(0, len(b), C.CHUNK):
                part = b[s : s + C.CHUNK + length - 1]
                yield anchors(part, np.array([0, len(part)]), rid[lo:hi], s, length, k)


def classes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Records in the order of k-gram and slice; first of each slice, its count, and the number of slices of its k-gram."""
    x = x[np.lexsort((x["sh"], x["kh"]))]
    gram = np.ones(len(x), bool)
    gram[1:] = x["kh"][1:] != x["kh"][:-1]
    new = gram.copy()
    new[1:] |= x["sh"][1:] != x["sh"][:-1]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(x)))
    g = np.cumsum(gram[first]) - 1
    return x, first, count, np.bincount(g)[g] if len(g) else g


def joined(x: np.ndarray) -> np.ndarray:
    """Records whose runs hold the same windows: those of a row that touch or overlap are one, of copies of a row too."""
    x = x[np.lexsort((x["lo"], x["rid"]))]
    row = np.append(0, np.cumsum(x["rid"][1:] != x["rid"][:-1])) << 32
    end = np.maximum.accumulate(row + x["hi"])
    first = np.flatnonzero(np.append(True, row[1:] + x["lo"][1:] > end[:-1] + 1))
    out = x[first]
    out["hi"] = (end - row)[np.append(first[1:], len(x)) - 1]
    return out


OUT = "kind byte, bucket int, rid long, kh long, a int, lo int, hi int, data binary"
NAMES = [f.split()[0] for f in OUT.split(", ")]
TYPES = [pa.int8(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
RUN, DECIDE, COMPARE, BLOB = 0, 1, 2, 3


def records(kind: int, x: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    n = len(x)
    cols = [np.full(n, kind, np.int8), bucket, x["rid"], x["kh"].view(np.int64), x["a"], x["lo"], x["hi"]]
    return pa.record_batch([pa.array(np.ascontiguousarray(c), t) for c, t in zip(cols, TYPES)] + [pa.nulls(n, pa.binary())], NAMES)


def blobs(pairs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    n = len(pairs)
    cols = [pa.array(np.full(n, BLOB, np.int8)), pa.array([b for b, _ in pairs], pa.int32())]
    return pa.record_batch(cols + [pa.nulls(n, t) for t in TYPES[2:-1]] + [pa.array([d for _, d in pairs], pa.binary())], NAMES)


def map_anchors(length: int, k: int, n: int):
    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        x, first, count, _ = classes(np.concatenate(held))
        again = np.repeat(count > 1, count)
        x["done"] = again
        if again.any():
            one = joined(x[again])
            yield records(RUN, one, C.bucket_of(C.mix(one["rid"].view(C.U64)), n))
        x = x[first]
        # anchors are minima, so nearly all of their hashes are small: mixed again, they fill all buckets alike
        yield blobs(list(C.packed(C.bucket_of(C.mix(x["kh"]), n), x, n)))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            buf, off = C.flat(batch.column(1))
            for got in of_texts(batch.column(0).to_numpy(zero_copy_only=False), buf, off, length, k):
                held.append(got)
                size += len(got)
                if size > FLUSH:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    return run


def meet_anchors(batches):
    """Slices that occur twice become runs; the others of a k-gram with several slices are to be decided."""
    held = []
    for batch in batches:
        t = pa.Table.from_batches([batch])
        blob = t.column("kind").to_numpy() == BLOB
        if not blob.all():
            yield from t.filter(pa.array(~blob)).to_batches()
        held += [np.frombuffer(b, ANCHOR) for b in t.filter(pa.array(blob)).column("data").to_pylist()]
    if not held:
        return
    x, first, count, slices = classes(np.concatenate(held))
    none = lambda s: np.zeros(len(s), np.int32)
    again = np.repeat(count > 1, count) & (x["done"] == 0)
    yield records(RUN, x[again], none(x[again]))
    rep, several = x[first], slices > 1
    known = (count > 1) | (rep["done"] == 1)
    for kind, pick in ((DECIDE, several & ~known), (COMPARE, several & known)):
        yield records(kind, rep[pick], none(rep[pick]))


# --- slices -------------------------------------------------------------------------------------------------------------


def cut_slices(length: int):
    """The bytes of the slices of each row; slices overlap, so they leave in steps of about `OUTPUT` bytes."""

    def run(batches):
        for batch in batches:
            buf, off = C.flat(batch.column("body"))
            spots = batch.column("spots")
            flat, soff = spots.flatten(), spots.offsets.to_numpy()
            row = np.repeat(np.arange(len(batch)), np.diff(soff))
            kind, kh, a, lo, hi = (x.to_numpy(zero_copy_only=False) for x in flat.flatten())
            rid, view = batch.column("rid").to_numpy()[row], memoryview(buf)
            s, e = off[row] + lo, off[row] + hi + length
            for x, y in C.pieces(np.append(0, np.cumsum(e - s)), OUTPUT):
                data = pa.array([view[i:j] for i, j in zip(s[x:y].tolist(), e[x:y].tolist())], pa.binary())
                yield pa.record_batch([*(pa.array(c[x:y]) for c in (kh, rid, kind == DECIDE, a, lo, hi)), data], ["kh", "rid", "decide", "a", "lo", "hi", "data"])

    return run


SLICE = "kh long, rid long, decide boolean, a int, lo int, hi int, data binary"


def sort_slices(length: int, k: int):
    """Over slices sorted by k-gram: the runs of repeated windows of those to be decided."""

    def decide(group: list[tuple], out: list[tuple[int, int, int]]) -> None:
        if len(group) > 1:
            for g, runs in zip(group, repeated_windows([x[2:] for x in group], length, k)):
                if g[1]:
                    out += [(g[0], s, e) for s, e in runs]

    def run(batches):
        last, group = None, []
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            cols = [batch.column(i).to_pylist() for i in range(7)]
            for kh, *x in zip(*cols):
                if kh != last:
                    decide(group, out)
                    last, group = kh, []
                group.append(tuple(x))
            yield of_runs(out)
        out = []
        decide(group, out)
        yield of_runs(out)

    return run


def of_runs(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
    x = np.array(out, np.int64).reshape(-1, 3)
    return pa.record_batch([pa.array(x[:, 0]), pa.array(x[:, 1].astype(np.int32)), pa.array(x[:, 2].astype(np.int32))], ["rid", "lo", "hi"])


def single_windows(length: int, n: int):
    """Every window of the slices of a hot k-gram as a hash record, for the distributed count."""

    def run(batches):
        for batch in batches:
            got = []
            for _, rid, _, _, lo, hi, data in zip(*(batch.column(i).to_pylist() for i in range(7))):
                p = C.prefix_hash(np.frombuffer(data, np.uint8))
                s = np.arange(hi - lo + 1)
                w = np.zeros(len(s), WINDOW)
                w["h"], w["rid"], w["p"] = C.span_hash(p, s, s + length), rid, s + lo
                got.append(w)
            if got:
                x = np.concatenate(got)
                x = x[np.argsort(x["h"], kind="stable")]
                new = np.append(True, x["h"][1:] != x["h"][:-1])
                count = np.diff(np.append(np.flatnonzero(new), len(x)))
                many = np.repeat(count > 1, count)
                x["p"] = np.where(many, -1 - x["p"], x["p"])  # negative: has a twin already
                keep = new | many
                x = x[keep]
                pairs = list(C.packed(C.bucket_of(x["h"], n), x, n))
                yield pa.record_batch([pa.array([b for b, _ in pairs], pa.int32()), pa.array([d for _, d in pairs], pa.binary())], ["bucket", "data"])

    return run


def meet_windows(batches):
    held = [np.frombuffer(d, WINDOW) for b in batches for d in b.column("data").to_pylist()]
    if held:
        x = np.concatenate(held)
        x = x[np.argsort(x["h"], kind="stable")]
        count = np.diff(np.append(np.flatnonzero(np.append(True, x["h"][1:] != x["h"][:-1])), len(x)))
        x = x[np.repeat(count > 1, count)]
        p = np.where(x["p"] < 0, -1 - x["p"], x["p"])
        yield pa.record_batch([pa.array(x["rid"]), pa.array(p, pa.int32()), pa.array(p, pa.int32())], ["rid", "lo", "hi"])


# --- result -------------------------------------------------------------------------------------------------------------


def merged(runs: np.ndarray, length: int) -> np.ndarray:
    """Maximal byte spans (start, end) of window runs (first, last)."""
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    end = np.maximum.accumulate(runs[:, 1] + length)
    new = np.append(True, runs[1:, 0] > end[:-1])
    first = np.flatnonzero(new)
    return np.stack([runs[first, 0], end[np.append(first[1:], len(runs)) - 1]], axis=1)


def strip_spans(length: int, keep_text: bool, whole: bool):
    def run(batches):
        for batch in batches:
            buf, off = C.flat(batch.column("body"))
            for x, y in C.pieces(off, OUTPUT):
                yield stripped(batch.slice(x, y - x), memoryview(buf), off[x : y + 1].tolist())

    def stripped(batch: pa.RecordBatch, view: memoryview, off: list[int]) -> pa.RecordBatch:
        out = []
        for i, runs in enumerate(batch.column("runs").to_pylist()):
            body, spans = view[off[i] : off[i + 1]], []
            if runs:
                spans = merged(np.array([(x["lo"], x["hi"]) for x in runs], np.int64), length).tolist()
            cut, kept = 0, []
            for s, e in spans:
                kept.append(body[cut:s])
                cut = e
            kept.append(body[cut:])
            data = b"".join(kept)
            kept = b"".join(bytes(x).decode("utf-8", "ignore").encode() for x in kept) if whole and spans else data
            out.append((len(body), len(body) - len(data), len(spans), hashlib.sha256(data).hexdigest(), kept if keep_text else None))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        return pa.record_batch([batch.column(c) for c in range(batch.num_columns - 2)] + [pa.array(c, t) for c, t in zip(zip(*out), types)], [*batch.schema.names[:-2], "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


#: Columns of the result; columns of the input with these names give way.
OWN = {"n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"}


def repeated_runs(docs: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """docs (rid, body): (rid, lo, hi) for every run of window starts lo..hi whose windows occur elsewhere."""
    spark = docs.sparkSession
    n, k = 2 * C.parts(spark), max(1, length * 8 // 25)
    met = docs.select("rid", "body").filter(F.length("body") >= length).mapInArrow(C.in_steps(map_anchors(length, k, n)), OUT)
    met = C.cut(met.repartitionById(n, "bucket").mapInArrow(C.in_steps(meet_anchors), OUT).drop("data", "bucket"))
    runs = met.filter(f"kind = {RUN}").select("rid", "lo", "hi")
    open_ = met.filter(f"kind in ({DECIDE}, {COMPARE})")
    spots = open_.groupBy("rid").agg(F.collect_list(F.struct("kind", "kh", "a", "lo", "hi")).alias("spots"))
    slices = C.cut(docs.select("rid", "body").join(spots, "rid").select("rid", "body", "spots").mapInArrow(C.in_steps(cut_slices(length)), SLICE))
    # identical rows share rid; one of their equal slices is enough
    hot = slices.groupBy("kh").count().filter(F.col("count") > group).select("kh")
    if hot.isEmpty():
        few = slices
    else:
        few = slices.join(hot, "kh", "left_anti")
        many = slices.join(hot, "kh", "left_semi").mapInArrow(C.in_steps(single_windows(length, n)), "bucket int, data binary")
        runs = runs.unionByName(many.repartitionById(n, "bucket").mapInArrow(C.in_steps(meet_windows), "rid long, lo int, hi int"))
    few = few.repartition(n, "kh").sortWithinPartitions("kh")
    return runs.unionByName(few.mapInArrow(sort_slices(length, k), "rid long, lo int, hi int"))


def dedup_substrings(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, keep_text: bool = True, group: int = GROUP, whole: bool = False) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256 and, if keep_text, the remaining bytes as kept.

    With `whole`, kept lacks the halves of UTF-8 characters that the removed spans have cut.
    """
    rest = [c for c in docs.columns if c.lower() not in OWN and c != text] if keep_text else [key]
    rows = C.short_batches(docs).select(F.xxhash64(key, text).alias("rid"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("body"), F.struct(*rest).alias("rest"))
    runs = C.cut(repeated_runs(rows, length, group)).groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    full = rows.join(runs, "rid", "left").select("rest", "body", "runs")
    out = full.mapInArrow(C.in_steps(strip_spans(length, keep_text, whole)), f"rest {full.dtypes[0][1]}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    out = out.select("rest.*", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    return out if keep_text else out.drop("kept")


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs, keep_text=False)
