import math
from collections import Counter

import numpy as np
import pytest

from verdantia.llm import piece_sampling as S

PATH = S.model_path()
TEXTS = ["", "hello world", "  two  spaces \n\n tabs\t", "▁literal ▁", "naïve façade Ünïcödé 漢字 😀", " ", "a" * 3000, "x " * 500, "\x00\x01 z", "line\nline\r\n", "internationalisation", "the same words are here again " * 3]


@pytest.fixture(scope="module")
def lat():
    return S.Lattices(S.read_pieces(PATH))


def test_round_trip(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*TEXTS, None])], "doc_id long, text string, pieces int")
    coded = S.encode(df, PATH)
    back = {r.doc_id: r.text for r in S.decoded(coded, PATH).collect()}
    assert back == dict(enumerate([*TEXTS, None]))
    again = {r.doc_id: r.pieces for r in S.encode(df.repartition(7), PATH).collect()}
    assert again == {r.doc_id: r.pieces for r in coded.collect()}
    assert again[len(TEXTS)] is None and again[0] == []
    other = {r.doc_id: r.pieces for r in S.encode(df, PATH, seed=2).collect()}
    assert all(other[TEXTS.index(t)] != again[TEXTS.index(t)] for t in ("x " * 500, "a" * 3000, "the same words are here again " * 3))


def test_shares_follow_the_lattice(lat):
    """Segmentations of one unit come as often as the product of their weights says."""
    unit = " there"
    n = 40_000
    ids, off = S.sample([unit] * n, np.arange(n, dtype=np.uint64) * np.uint64(7919), lat, 5)
    seen = Counter(tuple(ids[off[i] : off[i + 1]].tolist()) for i in range(n))

    def ways(i):
        if i == len(unit):
            yield ()
        for j in range(i + 1, len(unit) + 1):
            p = lat.ids.get(unit[i:j])
            if p is not None:
                for rest in ways(j):
                    yield (p, *rest)

    weight = {w: math.prod(lat.weight[p] for p in w) for w in ways(0)}
    total = sum(weight.values())
    assert set(seen) <= set(weight)
    for w, x in weight.items():
        assert abs(seen[w] / n - x / total) < 4 * math.sqrt(x / total / n) + 1e-3


def test_query(spark, sf):
    rows = S.op9_piece_sampling(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.lossless for r in rows)


def test_empty_table(spark):
    assert S.digests(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_long_units(lat):
    """A run without spaces takes no more steps than a unit's, and comes back whole."""
    texts = ["b" * 300_000, "  " + "née" * 5000, "y" * S.UNIT + "z"]
    ids, off = S.sample(texts, np.arange(3, dtype=np.uint64), lat, 1)
    table = S.byte_table(S.read_pieces(PATH))
    assert [S.decode(ids[off[i] : off[i + 1]], table) for i in range(3)] == texts
    starts = S.unit_bounds(S.code_points("a" * 600 + " b" + "c" * 254 + " d\n"), np.array([0, 858 + 1]))
    assert starts.tolist() == [0, 256, 512, 600, 856, 858]
