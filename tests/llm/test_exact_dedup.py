import hashlib
import tempfile

from verdantia.llm import exact_dedup as X

SCHEMA = "doc_id long, text string, digest string, id string"


def by_hand(rows):
    out, groups = [], {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    for i, t in ((r[0], r[1] or "") for r in rows):
        ids = groups[t]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def check(found, rows):
    got = found.collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == by_hand(rows)
    stays = [(r.text_sha256, r.doc_id) for r in got if r.kept]
    assert len(stays) == len({d for d, _ in stays}) == len({r[1] or "" for r in rows})  # one of each group
    keep = {r.text_sha256: r.keep_id for r in got}
    assert all(i == keep[d] for d, i in stays)


ROWS = [(1, "a"), (2, "a"), (3, ""), (4, None), (5, "b" * 300_000), (6, "b" * 300_000), (7, "A"), (8, "a "), (9, "c"), (9, "c"), (9, "d"), (None, "e"), (None, "e"), (None, "a"), (10, "é")]
ROWS += [(100 + i, "hot") for i in range(400)] + [(700, "hot")] * 50 + [(1000 + i, f"t{i % 90}") for i in range(300)]


def test_whole_table_in_any_deliveries(spark):
    docs = spark.createDataFrame([(*r, "x", "y") for r in ROWS], SCHEMA).repartition(5)
    for n in (1, 2, 5):
        check(X.dedup(docs, deliveries=n), ROWS)


def test_empty_table(spark):
    assert X.dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_index_persists_and_grows(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/index"
    parts = [ROWS[::3], ROWS[1::3], ROWS[2::3]]
    seen = []
    for i, part in enumerate(parts):
        rows = X.digests(spark.createDataFrame([(*r, "x", "y") for r in part], SCHEMA))
        index = X.DigestIndex(spark, path, 1000)
        spark.sql(f"DROP TABLE {index.first}")  # another session knows no table, only the folder
        spark.sql(f"DROP TABLE {index.again}")
        index = X.DigestIndex(spark, path)
        index.add(rows, i)
        index.add(rows, i)  # run again: adds nothing
        seen += part
        sizes = {r.digest.hex(): r.group_size for r in index.groups().collect()}
        assert sizes == {d: n for _, _, n, d in by_hand(seen)}
        assert spark.table(index.first).count() == len({r[1] or "" for r in seen})
        check_ids = {r.text_sha256: r.keep_id for r in index.resolve(rows.withColumn("delivery", X.F.lit(i))).collect()}
        assert check_ids.items() <= {d: k for _, k, _, d in by_hand(seen)}.items()


def test_plan_is_a_merge_join_without_python(spark):
    rows = X.digests(spark.createDataFrame([(*r, "x", "y") for r in ROWS], SCHEMA))
    index = X.DigestIndex(spark, tempfile.mkdtemp(prefix="spark-") + "/index", 1000)
    index.add(rows, 0)
    index.add(rows, 1)
    plan = index.groups()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Python" not in plan
