"""Readers and writers: CSV, GeoJSON, pixel tables, published tables, upserts, manifests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FACTOR_SCHEMA = T.StructType([T.StructField("block_id", T.StringType())] + [T.StructField(c, T.DoubleType()) for c in ("ndvi", "tree_density", "pm25", "temperature", "impervious_surfaces", "population_exposure")])
POINT = "struct<type:string,coordinates:array<double>>"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share: spark.checkpoint.dir. Only a local session may have none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "round") -> DataFrame:
    """df as a table in the shared folder: its lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed CSV; empty fields, nan and NaN become NULL."""
    df = spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)
    return df.select(*(F.nanvl(f.name, F.lit(None).cast("double")).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in schema))


def read_geojson_collection(spark: SparkSession, path: str, properties: str, coordinates: str = "array<double>") -> DataFrame:
    """One row for each feature of FeatureCollection files."""
    schema = f"type string, features array<struct<type:string,properties:struct<{properties}>,geometry:struct<type:string,coordinates:{coordinates}>>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.properties.*", F.col("f.geometry").alias("geometry"))


def parse_geojson_lines(lines: DataFrame, properties: str, coordinates: str = "array<double>") -> DataFrame:
    """One feature to a line of column `value`; a trailing comma is dropped, lines that are no feature are dropped."""
    schema = f"type string, properties struct<{properties}>, geometry struct<type:string,coordinates:{coordinates}>"
    text = F.regexp_replace("value", r",\s*$", "")
    return lines.select(F.from_json(text, schema, {"mode": "PERMISSIVE"}).alias("f")).filter(F.col("f.type") == "Feature").select("f.properties.*", "f.geometry")


def pixel_layer(df: DataFrame, column: str, nodata) -> DataFrame:
    """(r, c, value) with nodata as NULL."""
    return df.select("r", "c", F.nullif(F.col(column), F.lit(nodata)).alias("value"))


def windowed(df: DataFrame, r0: int, c0: int, r1: int, c1: int, tile: int = 256) -> DataFrame:
    """Pixels of a window; the tile columns prune partitions of a table laid out by tile."""
    tr, tc = F.floor(F.col("r") / tile), F.floor(F.col("c") / tile)
    return df.filter(tr.between(r0 // tile, (r1 - 1) // tile) & tc.between(c0 // tile, (c1 - 1) // tile) & F.col("r").between(r0, r1 - 1) & F.col("c").between(c0, c1 - 1))


def export_csv(df: DataFrame, columns: list[str], path: str) -> str:
    """Write those of the columns that exist."""
    df.select([c for c in columns if c in df.columns]).write.mode("overwrite").option("header", True).csv(path)
    return path


def publish(df: DataFrame, path: str, run: str = "run_id") -> str:
    """A table partitioned by run."""
    df.write.mode("overwrite").partitionBy(run).parquet(path)
    return path


def upsert(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Rows of batch replace or join those of target; columns that batch lacks, or has as NULL, keep target's values."""
    t = target.select([F.col(key)] + [F.col(c).alias(f"t_{c}") for c in target.columns if c != key])
    b = batch.select([F.col(key)] + [F.col(c).alias(f"b_{c}") for c in batch.columns if c != key])
    both = t.join(b, key, "full_outer")
    value = lambda c: F.coalesce(*(F.col(f"{p}_{c}") for p, d in (("b", batch), ("t", target)) if c in d.columns))
    return both.select(key, *(value(c).alias(c) for c in target.columns if c != key))


def insert_ignore(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    return target.unionByName(batch.join(target, key, "left_anti").dropDuplicates([key]).select(target.columns))


def scoped_delete(table: DataFrame, runs: list[str], run: str = "run_id") -> DataFrame:
    """Without the rows of these runs; rows of no run stay."""
    return table.filter(~F.coalesce(F.col(run).isin(runs), F.lit(False)))


def manifest(df: DataFrame, score: str, key: str) -> DataFrame:
    """One row: counts and a hash of the ids and scores, which doesn't depend on their order and so needs no sort.

    It is the exclusive or, and the number, of 60-bit beginnings of the rows' digests; each task sends one number.
    """
    line = F.concat_ws(",", key, F.when(F.col(score).isNotNull(), F.format_string("%.2f", score)).otherwise(""))
    return df.agg(
        F.count("*").alias("blocks"), F.count(score).alias("scorable"), F.count_if(F.col(score).isNull()).alias("excluded"),
        F.round(F.avg(score), 6).alias("mean_score"), F.concat_ws("-", F.count("*").cast("string"), F.lower(F.hex(F.bit_xor(F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("long"))))).alias("content_hash"),
    )
