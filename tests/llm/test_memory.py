import numpy as np
import pyarrow as pa

from verdantia.llm import common as C
from verdantia.llm import piece_sampling as S


def test_batches_to_python(spark):
    """Blobs and long texts reach Python in batches of few bytes, and every row does."""
    own = spark.newSession()

    def measure(batches):
        for b in batches:
            yield pa.record_batch([pa.array([len(b)]), pa.array([b.nbytes])], ["n", "size"])

    for rows, size in ((120, 100_000), (3, 3 * C.BATCH_BYTES)):
        docs = own.range(0, rows, 1, 1).selectExpr("id", f"repeat('x', {size}) as body")
        got = C.short_batches(docs).mapInArrow(measure, "n long, size long").collect()
        assert sum(r.n for r in got) == rows and all(r["size"] <= C.BATCH_BYTES + 2 * size for r in got)
    assert len(got) == 3
    kept = spark.newSession()
    kept.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
    assert C.short_batches(kept.range(1)).sparkSession.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1m"


def test_batches_from_python():
    rows = pa.record_batch([pa.array(np.arange(2_000_000)), pa.nulls(2_000_000, pa.binary())], ["a", "data"])
    wide = pa.record_batch([pa.array([1, 2]), pa.array([b"x" * 3 * C.BATCH_BYTES] * 2)], ["a", "data"])
    none = rows.slice(0, 0)
    got = list(C.in_steps(lambda batches: batches)([rows, none, wide]))
    assert all(b.nbytes <= 1.1 * C.BATCH_BYTES or len(b) == 1 for b in got)
    assert pa.Table.from_batches(got).equals(pa.Table.from_batches([rows, wide]))


def test_lattices_grow_without_waste():
    pieces = [(chr(c), 1) for c in range(97, 123)] + [(chr(a) + chr(b), 1) for a in range(97, 123) for b in range(97, 123)]
    r = np.random.default_rng(5)
    lat, whole = S.Lattices(pieces), S.Lattices(pieces)
    cp = r.integers(97, 123, 600_000).astype(np.uint32)
    start = np.arange(0, len(cp), 20)
    keys = start.astype(C.U64)
    for i in range(0, len(start), 500):
        lat.add(keys[i : i + 500], cp, start[i : i + 500], start[i : i + 500] + 20)
        assert max(len(t) for t in lat.table) <= max(1 << 16, 1.6 * lat.size) and len(lat.arc) <= max(1 << 16, 1.6 * lat.count)
    whole.add(keys, cp, start, start + 20)
    for x, y in zip(lat.arrays(), whole.arrays()):
        np.testing.assert_allclose(x, y, rtol=0, atol=1e-6)
    assert (lat.arc[: lat.count] == whole.arc[: whole.count]).all() and lat.first == whole.first
