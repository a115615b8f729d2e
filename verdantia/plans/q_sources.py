"""Queries of the readers and writers."""

from pyspark.sql import functions as F

from ..sources import io
from .catalog import query


@query("SELECT block_id, round(ndvi, 6) AS ndvi, tree_density IS NULL AS no_trees, CAST(temperature * 10 AS BIGINT) AS t10 FROM factors")
def src_csv_factors(v):
    path = io.export_csv(v.factors, io.FACTOR_SCHEMA.names, io.scratch(v.spark, "factors"))
    df = io.read_csv(v.spark, path, io.FACTOR_SCHEMA)
    return df.select("block_id", F.round("ndvi", 6).alias("ndvi"), F.col("tree_density").isNull().alias("no_trees"), (F.col("temperature") * 10).cast("decimal(20,0)").cast("long").alias("t10"))


def features_json(v):
    return v.units.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("unit_id", "segment").alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(F.col("x").cast("double"), F.col("y").cast("double")).alias("coordinates")).alias("geometry"))).alias("value"), "c_custkey")


@query("SELECT unit_id, segment, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM units")
def src_geojson_collection(v):
    """One collection file for each ten thousand features, written and read back."""
    path = io.scratch(v.spark, "geojson")
    whole = features_json(v).groupBy(F.floor(F.col("c_custkey") / 10_000)).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("value"), ","), F.lit("]}")).alias("value")).select("value")
    whole.write.option("maxRecordsPerFile", 1).text(path)
    return io.read_geojson_collection(v.spark, path, "unit_id:string,segment:string").select("unit_id", "segment", F.col("geometry.coordinates")[0].alias("x"), F.col("geometry.coordinates")[1].alias("y"))


@query("SELECT unit_id, segment, CAST(x AS DOUBLE) AS x FROM units WHERE c_custkey % 10 <> 3")
def src_geojson_lines(v):
    line = F.when(F.col("c_custkey") % 10 == 3, F.lit('{"type": "Feature", "prop')).when(F.col("c_custkey") % 2 == 0, F.concat("value", F.lit(","))).otherwise(F.col("value"))
    return io.parse_geojson_lines(features_json(v).select(line.alias("value")), "unit_id:string,segment:string").select("unit_id", "segment", F.col("geometry.coordinates")[0].alias("x"))


@query("SELECT r, c, CASE WHEN coalesce(seg, 255) <> 255 THEN CAST(seg AS BIGINT) END AS value FROM px")
def src_pixel_layer(v):
    return io.pixel_layer(v.px.withColumn("seg", F.coalesce("seg", F.lit(255)).cast("long")), "seg", 255)


@query("SELECT count(*) AS n, count(*) - count(DISTINCT block_id) AS repeated, CAST(count(CASE WHEN (maxx - minx) * (maxy - miny) <> 62500 THEN 1 END) AS BIGINT) AS wrong_area FROM blocks")
def src_block_table(v):
    return v.blocks.agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct("block_id")).alias("repeated"), F.count_if((F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny")) != 62500).alias("wrong_area"))


@query("SELECT r, c, people FROM px WHERE r BETWEEN 40 AND 119 AND c BETWEEN 200 AND 279")
def src_windowed_bbox(v):
    return io.windowed(v.px, 40, 200, 120, 280).select("r", "c", "people")


@query("SELECT block_id, score FROM scored")
def sink_csv_export(v):
    path = io.export_csv(v.scored, ["block_id", "score", "not_there"], io.scratch(v.spark, "export"))
    return v.spark.read.schema("block_id string, score double").option("header", True).csv(path)


@query("SELECT run_id, block_id, score FROM scored WHERE run_id = 'run_1'")
def sink_partitioned_table(v):
    path = io.publish(v.scored, io.scratch(v.spark, "table"))
    return v.spark.read.parquet(path).filter("run_id = 'run_1'").select("run_id", "block_id", "score")


@query("SELECT block_id, coalesce(CASE WHEN bi % 3 = 0 OR bi > 10 THEN score + 1 END, CASE WHEN bi <= 10 THEN score END) AS score, CASE WHEN bi <= 10 THEN old_score END AS old_score FROM scored")
def sink_upsert(v):
    target = v.scored.filter("bi <= 10").select("block_id", "score", "old_score")
    return io.upsert(target, v.scored.filter("bi % 3 = 0 or bi > 10").select("block_id", (F.col("score") + 1).alias("score")), "block_id")


@query("SELECT block_id, CASE WHEN bi <= 6 THEN score ELSE old_score END AS score FROM scored")
def sink_insert_ignore(v):
    batch = v.scored.filter("bi >= 3").select("block_id", F.col("old_score").alias("score"))
    return io.insert_ignore(v.scored.filter("bi <= 6").select("block_id", "score"), batch.unionByName(batch), "block_id")


@query("SELECT block_id, run_id FROM scored WHERE run_id <> 'run_0'")
def sink_scoped_delete(v):
    return io.scoped_delete(v.scored.select("block_id", "run_id"), ["run_0"])


@query("""SELECT count(*) AS blocks, count(score) AS scorable, CAST(count(*) - count(score) AS BIGINT) AS excluded, round(avg(score), 6) AS mean_score,
  count(*) || '-' || lower(printf('%x', bit_xor(CAST('0x' || substr(md5(block_id || ',' || coalesce(printf('%.2f', score), '')), 1, 15) AS BIGINT)))) AS content_hash FROM scored""")
def sink_manifest(v):
    return io.manifest(v.scored, "score", "block_id")
