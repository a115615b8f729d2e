"""A corpus pipeline: each stage takes (spark, docs, sf_dir) and returns the documents it keeps.

Stages are written as Parquet and reread, so a lost executor costs no earlier stage. All but the last return the columns
of documents (doc_id, text, lang, source, n_chars).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdantia.llm import jaccard_join, language_id, mixing, piece_sampling, suffix_dedup
from verdantia.llm.common import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Texts whose most likely language has less than this share of the bytes are rejected.
LEAST_LANGUAGE = 0.3


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that are null, have no letter, or have no language that stands out."""
    model = language_id.learn_languages(docs)
    found = language_id.predict(docs.select(*COLUMNS), model)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the smallest id, of each group that links join.

    Documents are told apart by id and text: one text of a repeated id may go and another stay; rows equal in both are one.
    """
    rows = docs.select(*COLUMNS).withColumn("row", F.xxhash64("doc_id", "text"))
    groups = jaccard_join.jaccard_components(rows.select("row", "text"), key="row").select("row", "component_id").distinct()
    ids = rows.select("row", "doc_id").distinct()
    stays = groups.join(ids, "row").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")).select("first.row")
    return rows.dropDuplicates(["row"]).join(stays, "row", "left_semi").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes bytes in strings of 200 bytes that start elsewhere too; cut characters and texts left empty go."""
    found = suffix_dedup.dedup_substrings(docs.select(*COLUMNS), whole=True)
    clean = found.withColumn("text", F.col("kept").cast("string"))
    clean = clean.filter((F.length("text") > 0) | (F.col("n_removed") == 0))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix begins to take it; those it takes no word of go."""
    keyed = cut(docs.select(*COLUMNS).withColumn("row", F.xxhash64(*COLUMNS)))
    taken = mixing.mix(keyed, key="row").groupBy("row").agg(F.max("taken").alias("taken"), F.max("size").alias("size"))
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")).otherwise(F.lit(1))
    rows = keyed.join(taken.withColumn("copies", copies).filter("copies > 0"), "row")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of every text."""
    return piece_sampling.encode(docs.select("doc_id", "text", "source"), piece_sampling.model_path()).select("doc_id", "source", "pieces")


STAGES = [
    ("language_id", languages),
    ("jaccard_join", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("mixing", mixture),
    ("piece_sampling", pieces),
]
#: SQL expresses neither the recurrent network nor the sampled pieces; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
