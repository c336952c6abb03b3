"""Incremental corpus work: what is still to be done, metadata, label translation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `todo` without an output in `done`."""
    return todo.join(done.select(*keys), list(keys), "left_anti")


def with_metadata(files: DataFrame, metadata: DataFrame, keys: Sequence[str]) -> DataFrame:
    return files.join(metadata, list(keys), "left")


def translate(df: DataFrame, symbols: DataFrame, col: str, to: str) -> DataFrame:
    """Add the column `to` of a symbol table by equal `col`; unknown symbols give null."""
    return df.join(symbols.select(col, to), col, "left")


def process_missing(todo: DataFrame, keys: Sequence[str], output: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run `work` on the rows whose outputs aren't in the Parquet table `output` yet, append them and return all outputs."""
    spark = todo.sparkSession
    try:
        done = spark.read.parquet(output)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        work(todo).write.mode("append").parquet(output)
    else:
        work(missing(todo, done, keys)).write.mode("append").parquet(output)
    return spark.read.parquet(output)


def read_measures(spark, path: str, schema: str, root: str, sep: str = "\t", errors: str = "raise") -> DataFrame:
    """Delimited measurement files with `dirname`, `relpath` and `barename` of the file that each row is from."""
    mode = {"raise": "FAILFAST", "ignore": "DROPMALFORMED"}[errors]
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").option("ignoreCorruptFiles", errors == "ignore").csv(path, sep=sep, header=True, mode=mode)
    full = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    inside = F.regexp_replace(full, r"^\Q" + root.rstrip("/") + r"\E/?", "")
    return df.withColumns({"dirname": F.lit(root), "relpath": F.regexp_extract(inside, "^(.*?)/?[^/]*$", 1), "barename": F.regexp_extract(inside, r"([^/]*?)(\.[^./]*)?$", 1)})


def measure_texts(df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[str], sep: str = "\t") -> DataFrame:
    """(*keys, content): the rows of each key as the text of a delimited file with a header, as `read_measures` reads it; nulls are empty.

    A file is one row, so it's for one recording or session. `sources.files.write_files` writes them; for one table of all
    rows use Spark's own writers. Texts that hold the separator, a quote or a line break are quoted.
    """
    quote = lambda c: F.when(c.rlike(f'["\\n\\r{sep}]'), F.concat(F.lit('"'), F.regexp_replace(c, '(["\\\\])', r"\\$1"), F.lit('"'))).otherwise(c)
    line = F.concat_ws(sep, *[quote(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])
    place = F.struct(*[F.col(c).alias(f"o{k}") for k, c in enumerate(order)], line.alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(place)), lambda p: p["line"])
    return df.groupBy(*keys).agg(F.concat(F.lit(sep.join(columns) + "\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("content"))
