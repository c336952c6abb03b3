"""Subtitles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierloom.sources.files import packed

STAMP = r"(\d+):(\d\d):(\d\d)[,.](\d{1,3})"
LINE = rf"(?s)^\s*(?:\d+\s*\n)?\s*{STAMP}\s*-->\s*{STAMP}[^\n]*(?:\n(.*))?$"


def _seconds(block: Column, first: int) -> Column:
    part = lambda k: F.regexp_extract(block, LINE, first + k)
    whole = part(0).cast("long") * 3600 + part(1).cast("long") * 60 + part(2).cast("long")
    return whole.cast("double") + F.rpad(part(3), 3, "0").cast("double") / 1000


def parse_blocks(df: DataFrame, block: str) -> DataFrame:
    """Add t1, t2 in seconds and `text` for each subtitle block; other text is left out."""
    b = F.regexp_replace(F.col(block), "\r", "")
    rows = df.withColumn("_b", b).where(F.col("_b").rlike(LINE))
    return rows.withColumns({"t1": _seconds(F.col("_b"), 1), "t2": _seconds(F.col("_b"), 5), "text": F.regexp_replace(F.regexp_extract("_b", LINE, 9), r"\s+$", "")}).drop("_b", block)


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq, t1, t2, text) of all subtitles in the files."""
    files = packed(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿|\r", "").alias("value")))
    blocks = files.select("path", F.posexplode(F.split("value", r"\n[ \t]*\n\s*")).alias("seq", "block"))
    return parse_blocks(blocks, "block").select("path", "seq", "t1", "t2", "text")
