"""Exact deduplication against a persistent digest index (operator 12), with DataFrame functions and SQL only.

The index is a table in the shared folder, bucketed and sorted by SHA-256 digest. A delivery is first reduced to one row for
each digest, by partial aggregates before the shuffle; a sort-merge anti-join leaves the digests that the index lacks, and
these are appended. Digests that it has are appended to a second table, of repeats, bucketed alike, so that sizes of groups
and the row that stays follow from both without a shuffle of either. A delivery that is added again, as after a crash, adds
only what is still missing of it.

Of equal texts the row with the largest id stays; rows equal in id too are told apart by their delivery and place, and one of
them stays. Null text counts as empty; a null id is below all others. Texts of any length are hashed whole. An empty
delivery gives an empty result and leaves the index as it is; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, parts, shared_dir

#: Rows of the index for a bucket, about.
BUCKET_ROWS = 1 << 21
#: A digest is hot in a delivery if it has at least one row in HOT of it; so there are at most HOT of these.
HOT = 4096


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, row, digest) of every row, written once: rows keep their number if a task runs again."""
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    return cut(docs.select(F.col(key).alias("id"), F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2(body, 256)).alias("digest")))


class DigestIndex:
    """The index in the folder `path`; made if it isn't there, else opened with the buckets it has."""

    def __init__(self, spark: SparkSession, path: str, rows: int = 0, key_type: str = "bigint"):
        self.spark, self.path = spark, path
        about = f"{path}/about"
        where = spark._jvm.org.apache.hadoop.fs.Path(about)
        if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            buckets = max(parts(spark), math.ceil(rows / BUCKET_ROWS))
            spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(key_type).alias("key_type")).coalesce(1).write.parquet(about)
        self.buckets, self.key_type = spark.read.parquet(about).first()
        self.first, self.again = self._table("first"), self._table("again")

    def _table(self, name: str) -> str:
        table = f"digests_{hashlib.md5(self.path.encode()).hexdigest()}_{name}"
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} (digest BINARY, delivery INT, id {self.key_type}, row BIGINT, n BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'"
        )
        return table

    def add(self, delivered: DataFrame, delivery: int) -> None:
        """Append what `delivered` (id, row, digest) holds: new digests to the index, known ones to the repeats."""
        last = F.max(F.struct("id", "row")).alias("last")
        each = delivered.groupBy("digest").agg(last, F.count("*").alias("n")).select("digest", F.lit(delivery).alias("delivery"), "last.id", "last.row", "n")
        each = cut(each.repartition(self.buckets, "digest"))
        for table in (self.again, self.first):
            dealt = each.repartition(self.buckets, "digest")  # one task for each bucket writes its file
            known = self.spark.table(self.first)
            if table == self.again:
                dealt = dealt.join(known.filter(F.col("delivery") != delivery).select("digest").hint("merge"), "digest", "left_semi")
                known = self.spark.table(table).filter(F.col("delivery") == delivery)
            new = dealt.join(known.select("digest").hint("merge"), "digest", "left_anti")
            new.select("digest", "delivery", "id", "row", "n").write.insertInto(table)
            self.spark.catalog.refreshTable(table)

    def groups(self) -> DataFrame:
        """(digest, keep, group_size): keep is the (id, delivery, row) that stays; neither table is shuffled."""
        keep = F.struct("id", "delivery", "row")
        more = self.spark.table(self.again).groupBy("digest").agg(F.max(keep).alias("later"), F.sum("n").alias("more"))
        first = self.spark.table(self.first).select("digest", keep.alias("keep"), "n")
        both = first.join(more.hint("merge"), "digest", "left")
        return both.select("digest", F.greatest("keep", F.coalesce("later", "keep")).alias("keep"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("group_size"))

    def resolve(self, delivered: DataFrame, key: str = "doc_id") -> DataFrame:
        """(key, keep_id, group_size, kept, text_sha256) of every row of `delivered` (id, row, digest, delivery).

        Rows of a hot digest meet its group by broadcast: at most HOT digests have a HOT-th of the rows each. The others
        meet the index by sort-merge join, where no key has more rows than that.
        """
        groups = self.groups()
        least = math.ceil(max(delivered.count(), 1) / HOT)
        hot = cut(delivered.groupBy("digest").count().filter((F.col("count") >= least) & (F.col("count") > 1)).select("digest"))
        few = cut(groups.join(F.broadcast(hot), "digest", "left_semi"))
        often = delivered.join(F.broadcast(few), "digest")
        rest = delivered.join(F.broadcast(hot), "digest", "left_anti").join(groups.hint("merge"), "digest")
        kept = F.struct("id", "delivery", "row").eqNullSafe(F.col("keep"))
        return often.unionByName(rest).select(
            F.col("id").alias(key), F.col("keep.id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
        )


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", deliveries: int = 2, path: str | None = None) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) of every row of docs.

    The rows arrive in `deliveries`, so that later ones meet an index that holds earlier ones; the result doesn't depend
    on how many there are. path: the index's folder, a new one in the shared folder if not given.
    """
    spark = docs.sparkSession
    all_ = digests(docs, text, key).withColumn("delivery", (F.col("row") % deliveries).cast("int"))
    path = path or f"{shared_dir(spark)}/digests-{uuid.uuid4().hex}"
    index = DigestIndex(spark, path, all_.count(), dict(all_.dtypes)["id"])
    for i in range(deliveries):
        index.add(all_.filter(F.col("delivery") == i), i)
    return index.resolve(all_, key)


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op12_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
