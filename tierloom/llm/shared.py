"""Helpers that several corpus operators use: shared storage, folds and joins on skewed keys."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: A key is hot if it has more rows than this, or than the 20,000th part of all rows if that is more.
HOT_ROWS = 64
#: So at most this many keys can be hot, which bounds what `attach` broadcasts.
HOT_KEYS = 20_000
#: Up to so many classes a table with a row for each is broadcast.
MOST_CLASSES = 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir` of the session.

    Where it is unset (tests, one machine) a temporary folder is made and set for later calls.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tierloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


_SCOPE: ContextVar[list[Scratch] | None] = ContextVar("_SCOPE", default=None)


@contextmanager
def dropping() -> Iterator[None]:
    """Delete all scratch tables that are made within, at the end: for callers who have saved the results that read them."""
    made: list[Scratch] = []
    token = _SCOPE.set(made)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        for work in made:
            work.drop()


class Scratch:
    """Intermediate tables of one run, written to the shared folder.

    A written table cuts the lineage and outlives lost executors. `save` writes and rereads a
    DataFrame; `drop` deletes tables that no later step reads, `drop_but` all others. The tables that an operator's
    result reads stay until the caller's `dropping` block ends, or the folder is cleared.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables: set[str] = set()
        if (scope := _SCOPE.get()) is not None:
            scope.append(self)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def save(self, df: DataFrame, table: str) -> DataFrame:
        self.tables.add(table)
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def measured(self, df: DataFrame, table: str, value: Column) -> tuple[DataFrame, Any]:
        """`save`, and an aggregate of the rows, taken as they are written."""
        seen = Observation()
        self.tables.add(table)
        df.observe(seen, value.alias("value")).write.mode("overwrite").option("compression", "zstd").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table)), seen.get["value"]

    def release(self) -> None:
        """Let Spark delete the shuffle files of finished steps, which otherwise stay until the driver happens to collect its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *tables: str) -> None:
        """Delete tables, or all of them if none is named."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables or ("",):
            self.tables.discard(table)
            at = jvm.org.apache.hadoop.fs.Path(self.path(table))
            at.getFileSystem(conf).delete(at, True)


    def drop_but(self, *tables: str) -> None:
        if others := sorted(self.tables - set(tables)):
            self.drop(*others)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send at most `rows` rows at once to Python workers: whole texts are large, and a batch is held several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, mod 5: rows with 0 are held out, rows with null ids have null."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % 5


def held_out(doc_id: str | Column = "doc_id") -> Column:
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def first_by_hash(rows: DataFrame, cls: str, most: Column | int, order: list[str]) -> DataFrame:
    """The `most` rows of each class whose `order` comes first, with their number `k` from 1; `order` begins with a uniform hash.

    Rows whose hash is far beyond what the class's size lets expect are left out before the shuffle, so what is sorted
    doesn't grow with the input. Classes that then have too few are too few in any case, with a chance of 1 in a billion.
    """
    sizes = rows.groupBy(cls).agg(F.count(F.lit(1)).alias("_n"))
    want = F.lit(most).cast("double") if isinstance(most, int) else most.cast("double")
    share = (want + 6 * F.sqrt(want) + 40) / F.col("_n")
    # hashes are signed: -2**63 is the first
    bound = F.when(share >= 1, F.lit(2**63 - 1)).otherwise((F.least(share, F.lit(1.0)) * 2.0**64 - 2.0**63).cast("long"))
    bounds = sizes.select(cls, bound.alias("_bound"))
    few = sizes.count() <= MOST_CLASSES  # then they are broadcast, and rows stay where they are
    near = rows.join(F.broadcast(bounds) if few else bounds, cls).where(F.col(order[0]) <= F.col("_bound")).drop("_bound")
    number = F.row_number().over(Window.partitionBy(cls).orderBy(*order))
    return near.withColumn("k", number).where(F.col("k") <= want)


def hot_rows(n_rows: int) -> int:
    return max(HOT_ROWS, n_rows // HOT_KEYS)


def attach(rows: DataFrame, table: DataFrame, keys: list[str], spread: list[str | Column], n_rows: int, size: str = "n", how: str = "left", hint: str | None = None) -> DataFrame:
    """Join `rows` to `table`, which has one row per key and the key's number of rows in `size`.

    A key with more than `hot_rows(n_rows)` rows is cut into as many parts by a hash of `spread`, and
    its row of `table` is repeated for each. Sizes add up to `n_rows`, so at most HOT_KEYS keys are
    cut: the broadcast of their parts has a fixed bound. All else is one shuffled join.
    """
    limit = hot_rows(n_rows)
    parts = F.ceil(F.col(size) / F.lit(limit)).cast("int")
    hot = table.where(F.col(size) > limit).select(*keys, parts.alias("_parts"))
    salt = F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread), F.col("_parts"))).cast("int")
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_parts")
    right = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return left.join(right.hint(hint) if hint else right, [*keys, "_salt"], how).drop("_salt")


def counted(rows: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """One row per key with its number of rows `n`: summed before the shuffle, so hot keys don't meet."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *aggs)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
