"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by the SHA-256 of the normalised text. New rows
are digested, pre-aggregated by digest, sort-merge anti-joined with the index (which is read without a
shuffle, as its buckets match the batch's partitions) and the digests not yet known are appended. Each row of the
index names the batch that it came with, so a batch that is run again gets the verdicts that it got before.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierloom.llm.shared import Scratch, attach, path_exists

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_digest(text: str = "text") -> Column:
    """SHA-256 in hex of the text with A-Z lower-cased; null counts as empty."""
    return F.sha2(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), 256)


class DigestIndex:
    """Digests that have been kept, at `location`, in `buckets` buckets sorted by digest.

    An index that exists is opened with the number of buckets it was made with; a new one takes
    `buckets`, by default the session's number of shuffle partitions. An append that is repeated after a
    failure adds what is missing, since the anti-join finds what was written. There may be one writer at a time: two
    appends at once could both add a digest. The session knows the table by a name made from the location; `close` (or
    the end of a with block) forgets the name and leaves the files.
    """

    def __init__(self, spark: SparkSession, location: str, buckets: int | None = None):
        self.spark, self.location = spark, location.rstrip("/")
        meta = f"{self.location}/meta"
        if path_exists(spark, f"{meta}/_SUCCESS"):
            self.buckets = spark.read.schema("buckets int").parquet(meta).first()[0]
        else:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1).select(F.lit(self.buckets).alias("buckets")).write.mode("overwrite").parquet(meta)
        self.name = f"digest_index_{hashlib.sha1(self.location.encode()).hexdigest()}"
        self.close()
        spark.sql(
            f"CREATE TABLE {self.name} (digest STRING, keep_id BIGINT, n BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.location}/digests'"
        )

    def __enter__(self) -> DigestIndex:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, groups: DataFrame, batch: str) -> None:
        """Add the groups (digest, keep_id, n) whose digest is new, as those of `batch`; a sort-merge anti-join."""
        known = self.table().select("digest").hint("merge")
        new = groups.join(known, "digest", "left_anti").select("digest", "keep_id", "n", F.lit(batch).alias("batch"))
        new.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """Verdict on each row: (id, keep_id, group_size, kept, text_sha256).

    Of the rows of this batch with equal texts that with the largest id stays, unless an earlier batch
    put the text into the index: then keep_id is that batch's row and all of these go. A batch is known by its name
    `batch`, by default a fingerprint of its ids and texts: one that is run again, whether it was appended in whole, in part or
    not at all, finds its own rows in the index and gets the same verdicts. Null texts
    are empty texts. Rows that repeat id and text count in group_size, and one of them stays. Null
    ids lose to any id; in a group that has no other id one row stays. An empty table gives an empty
    result and other columns are ignored.
    """
    spark = docs.sparkSession
    work = Scratch(spark, "exact")
    own = index or DigestIndex(spark, work.path("index"))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_digest(text_col).alias("digest"), F.monotonically_increasing_id().alias("row"))
    # numbers are fixed as they are written; these aggregates of hashes don't depend on the order of rows
    some = lambda k: F.xxhash64(F.lit(k), "_id", "digest")
    mark = F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(some(1)).alias("xor"), F.sum(F.pmod(some(2), F.lit(1 << 20))).alias("sum"))
    rows, seen = work.measured(rows, "rows", mark)
    n_rows = seen["n"]
    batch = batch or "rows-" + "-".join(str(x) for x in seen)
    top = F.max(F.struct("_id", "row"))
    groups = rows.groupBy("digest").agg(top.alias("top"), F.count(F.lit(1)).alias("n"))
    groups = work.save(groups.select("digest", F.col("top._id").alias("keep_id"), F.col("top.row").alias("keep_row"), "n"), "groups")
    before = own.table().where(F.col("batch") != batch).select("digest", F.col("keep_id").alias("old_id"), F.lit(True).alias("old"))
    told = groups.join(before.hint("merge"), "digest", "left")
    told = told.select("digest", "n", F.when(F.col("old"), F.col("old_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.when(F.col("old").isNull(), F.col("keep_row")).alias("keep_row"))
    told = work.save(told, "verdicts")
    own.append(groups, batch)
    if index is None:
        own.close()
    work.drop("groups", "index")
    found = attach(rows, told.withColumnRenamed("n", "group_size"), ["digest"], ["row"], n_rows, size="group_size")
    kept = F.col("row").eqNullSafe(F.col("keep_row"))
    return found.select(F.col("_id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))
