import re

import corpus_pipeline as P
from tests.llm import test_jaccard_join as near
from tests.llm import test_suffix_dedup as suffix
from verdantia.llm import language_id, piece_sampling


def rows_of(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("n_chars < 4000")
    long = docs.filter("n_chars > 1500").limit(1).first()
    odd = [(900001, None, "en", "src1", 0), (900002, "123 --", "en", "src1", 6), (900003, long.text, "en", "src1", len(long.text)), (900004, "und dann auch " * 80, "de", None, 1)]
    return docs.unionByName(spark.createDataFrame(odd, docs.schema))


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs = rows_of(spark, sf)
    seen = [docs]
    for i, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, seen[-1], sf)
        out.write.parquet(str(tmp_path / str(i)))
        seen.append(spark.read.parquet(str(tmp_path / str(i))))
    assert all(d.columns == list(P.COLUMNS) for d in seen[:-1])
    table = [{r.doc_id: r for r in d.collect()} for d in seen[:4]]
    # language: what has no letter goes, clean texts stay
    assert not {900001, 900002} & set(table[1]) and len(table[1]) >= 0.98 * (len(table[0]) - 2)
    pred = language_id.predict(docs, language_id.learn_languages(docs)).collect()
    assert set(table[1]) == {r.doc_id for r in pred if r.lang_pred != "und" and r.score >= P.LEAST_LANGUAGE}
    # one document of each group
    groups = near.brute([(k, r.text) for k, r in table[1].items()])
    assert set(table[2]) == {c for _, _, c in groups}
    # passages
    ids = sorted(table[2])
    want = suffix.brute([table[2][k].text.encode() for k in ids], 200)
    gone = {k: w for k, w in zip(ids, want)}
    for k in ids:
        if gone[k][1] == 0:
            assert table[3][k].text == table[2][k].text
        elif k in table[3]:
            assert len(table[3][k].text.encode()) <= gone[k][0] - gone[k][1] and table[3][k].n_chars == len(table[3][k].text)
    # mixing: copies of whole documents, at most two
    mixed = seen[4].collect()
    count = {}
    for r in mixed:
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
        assert r.text == table[3][r.doc_id].text
    assert set(count.values()) <= {1, 2}
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    total = sum(words(r.text) for r in table[3].values())
    assert 1.4 * total <= sum(words(r.text) for r in mixed) <= 1.7 * total
    # pieces decode to the texts
    back = piece_sampling.decoded(seen[5], piece_sampling.model_path()).collect()
    assert sorted((r.doc_id, r.text) for r in back) == sorted((r.doc_id, r.text) for r in mixed)


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_repeated_ids_and_signs(spark, sf):
    """Stages tell rows apart by id and text; replacement characters that a text had from the start stay."""
    text = ["".join(f"{c}{i} " for i in range(40)) for c in "abcd"]
    rows = [(1, text[0]), (2, text[0]), (2, text[1]), (2, text[1]), (None, text[2]), (None, text[3]), (5, text[3]), (6, None), (7, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = P.near_duplicates(spark, docs, sf).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in kept) == sorted([("1", text[0]), ("2", text[1]), ("None", text[2]), ("5", text[3]), ("6", ""), ("7", "")])
    passage = "é" * 150
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in ((1, "� one " + passage), (2, "x�" + passage + " � two"), (3, "�"))], docs.schema)
    assert {r.doc_id: r.text for r in P.repeated_passages(spark, docs, sf).collect()} == {1: "� one ", 2: "x� � two", 3: "�"}
