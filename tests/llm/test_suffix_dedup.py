import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from verdantia.llm import suffix_dedup as S


def brute(texts, length):
    """By the definition: where every string of `length` bytes starts."""
    seen = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            seen.setdefault(t[p : p + length], []).append((i, p))
    gone = [bytearray(len(t)) for t in texts]
    for spots in seen.values():
        if len(spots) > 1:
            for i, p in spots:
                gone[i][p : p + length] = b"\1" * length
    out = []
    for t, g in zip(texts, gone):
        kept = bytes(b for b, x in zip(t, g) if not x)
        out.append((len(t), sum(g), bytes(g).count(b"\0\1") + (g[:1] == b"\1"), hashlib.sha256(kept).hexdigest()))
    return out


def fixture(seed, n=60, letters="ab cé"):
    r = random.Random(seed)
    make = lambda k: "".join(r.choice(letters) for _ in range(k))
    shared = [make(r.randint(30, 120)) for _ in range(6)]
    base = make(400)
    docs = []
    for i in range(n):
        kind = r.randint(0, 4)
        if kind == 0:
            x = list(base)
            for _ in range(r.randint(0, 4)):
                x[r.randrange(len(x))] = r.choice(letters)
            docs.append("".join(x))
        elif kind == 1:
            docs.append(make(r.randint(0, 80)) + r.choice(shared) + make(r.randint(0, 80)) + r.choice(shared))
        elif kind == 2:
            docs.append(docs[r.randrange(i)] if i else "")
        elif kind == 3:
            docs.append("z" * r.randint(0, 90))
        else:
            docs.append(make(r.randint(0, 300)))
    return docs + [None, "", base, base]


def rows_of(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("length,group", [(40, 4096), (40, 3), (25, 70)])
def test_same_as_brute_force(spark, length, group):
    texts = fixture(length)
    want = [(i, *x) for i, x in enumerate(brute([(t or "").encode() for t in texts], length))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert rows_of(S.dedup_substrings(docs, length=length, group=group, keep_text=False)) == want


def test_same_as_brute_force_on_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").filter("length(text) < 6000")
    rows = sorted((r.doc_id, (r.text or "").encode()) for r in docs.collect())
    want = [(i, *x) for (i, _), x in zip(rows, brute([t for _, t in rows], 200))]
    assert rows_of(S.dedup_substrings(docs, keep_text=False)) == want


def test_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.dedup_substrings(none).count() == 0
    docs = spark.createDataFrame([(None, "x" * 500, 1), (None, "x" * 500, 1), (7, None, 2), (7, "", 3)], "doc_id long, text string, kept int")
    got = S.dedup_substrings(docs.withColumnRenamed("kept", "Rid"), length=200).collect()
    assert sorted(r.n_removed for r in got) == [0, 0, 500, 500] and all(bytes(r.kept) == b"" for r in got)
    assert S.dedup_substrings(docs).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]


def test_deep_shallow_sorts():
    r = random.Random(5)
    text = [b"k" * 6 + bytes(r.choice(b"ab") for _ in range(r.randint(0, 60))) for _ in range(300)]
    text += [t[:30] + b"x" for t in text[:50]] + text[:20] + [b"k" * 6 + b"a" * i for i in range(50)]
    assert [text[i] for i in S.deep_shallow(text, 6)] == sorted(text)


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(S.C, "CHUNK", 1000)
    r = random.Random(3)
    t = "".join(r.choice("abcdefgh ") for _ in range(4000))
    texts = [(t + "-" + t).encode(), t[500:3500].encode(), t[:1200].encode()]
    import numpy as np
    off = np.cumsum([0, *map(len, texts)])
    got = np.concatenate(list(S.of_texts(np.arange(3), np.frombuffer(b"".join(texts), np.uint8), off, 200, 64)))
    spans = {(int(x["rid"]), p) for x in got for p in range(x["lo"], x["hi"] + 1)}
    assert spans == {(i, p) for i, x in enumerate(texts) for p in range(len(x) - 199)}


def mapped(texts, n):
    """What map_anchors sends: (bytes of anchors by bucket, runs)."""
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.binary())], ["rid", "body"])
    sizes, runs = np.zeros(n, np.int64), []
    for r in pa.Table.from_batches(S.map_anchors(200, 64, n)(iter([batch]))).to_pylist():
        if r["kind"] == S.BLOB:
            sizes[r["bucket"]] += len(r["data"])
        else:
            runs.append((r["rid"], r["lo"], r["hi"]))
    return sizes, runs


def test_anchors_fill_all_buckets():
    r = random.Random(11)
    sizes, _ = mapped([r.randbytes(20_000) for _ in range(60)], 100)
    assert sizes.sum() > 10_000 * S.ANCHOR.itemsize and sizes.max() < 2 * sizes.mean() and sizes.min() > 0


def test_runs_that_touch_leave_as_one():
    r = random.Random(12)
    a, b = r.randbytes(5000), r.randbytes(3000)
    _, runs = mapped([a, a, b[:1000] + a + b[1000:], b], 7)
    # a twice as a whole; the third text holds a between the two parts of b, the fourth these parts alone
    assert {x for x in runs if x[0] < 2} == {(0, 0, 4800), (1, 0, 4800)} and len(runs) == 7
    x = np.zeros(6, S.ANCHOR)
    x["rid"], x["lo"], x["hi"] = [5, 5, 5, 5, -3, 5], [10, 0, 0, 30, 0, 4], [20, 9, 9, 40, 2, 6]
    assert [(int(y["rid"]), int(y["lo"]), int(y["hi"])) for y in S.joined(x)] == [(-3, 0, 2), (5, 0, 20), (5, 30, 40)]
