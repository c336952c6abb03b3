"""Corpus pipeline: language ID, exact and near deduplication, substring deduplication, packing.

Each stage reads what the one before kept, as Parquet in the shared folder, and its own scratch tables are deleted as soon as its
result is saved. All but the last return the columns of `documents`; other columns of the input are left out, so their names
can't clash. All stages take null ids, null and empty texts, rows that repeat and empty tables (which give empty tables).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierloom.llm.exact_dedup import exact_dedup, text_digest
from tierloom.llm.language import fit_language, language
from tierloom.llm.near_dedup import near_classes
from tierloom.llm.packing import pack_documents
from tierloom.llm.shared import Scratch, attach, dropping, table
from tierloom.llm.substring import substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, whose language can't be told, go: null and empty texts among them.

    All others stay, whatever their id and lang; where no row has a label nothing can be told, and all stay that have a letter.
    """
    found = language(docs, fit_language(docs), keep=COLUMNS[1:])
    return found.where("has_letter").select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased, null as empty) the row with the largest doc_id stays; null ids lose to any id.

    Of rows that repeat that id too, the first in the order of text, lang, source and n_chars stays.
    """
    key = lambda doc_id, sha: F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), sha)
    work = Scratch(spark, "exact-kept")
    verdicts = exact_dedup(docs).groupBy(key(F.col("doc_id"), F.col("text_sha256")).alias("_key")).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("copies"))
    kept, n_rows = work.measured(verdicts.where("kept").select("_key", "copies"), "keys", F.sum("copies"))
    # texts are shuffled once and pass by the keys unsorted; only rows that repeat, id and all, are grouped, summed up before the shuffle
    rows = docs.select(*COLUMNS, key(F.col("doc_id"), text_digest()).alias("_key"))
    found = attach(rows, kept, ["_key"], [F.spark_partition_id()], n_rows or 0, size="copies", how="inner", hint="shuffle_hash")
    first = F.min(F.struct(*COLUMNS[1:], "doc_id")).alias("row")
    again = found.where("copies > 1").groupBy("_key").agg(first).select("row.*")
    return found.where("copies = 1").select(*COLUMNS).unionByName(again.select(*COLUMNS))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest doc_id stays, with all rows that have this id.

    A class without any id keeps the texts whose words are those of one of them. Texts without words are one class.
    """
    key = [F.coalesce("doc_id", F.lit(0)).alias("_at"), F.col("doc_id").isNull().alias("_none")]
    kept = near_classes(docs).where("kept").select(*key, F.col("text_hash").alias("_hash")).distinct()
    rows = docs.select(*COLUMNS, *key, F.xxhash64(F.col("text").cast("string")).alias("_hash"))
    return rows.join(kept.hint("shuffle_hash"), ["_at", "_none", "_hash"], "left_semi").select(*COLUMNS)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats of 20 words and more are cut from the texts; documents of which nothing is left go.

    Rows that repeat an id are documents of their own, null ids come first; documents without words stay.
    """
    cut = substring_dedup(docs, keep=("lang", "source")).where("n_removed < n_words OR n_words = 0")
    text = F.col("kept_text").cast("string")
    return cut.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, as `op10_packing` returns them: one row or more for each row, whatever its id and text."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language_id), ("exact", exact), ("near", near), ("substring", substring), ("packing", packing)]

#: Language ID, near-duplicates and packing aren't expressible in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in their order, over the whole of `documents`."""
    work = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for i, (name, stage) in enumerate(STAGES):
        with dropping():
            docs = work.save(stage(spark, docs, sf_dir), name)
        if i:
            work.drop(STAGES[i - 1][0])
    return docs
