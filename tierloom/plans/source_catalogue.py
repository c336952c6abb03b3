"""Round trips through files: what is written from the test tables is read back by the readers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierloom.operators import workflow
from tierloom.plans.catalogue import EVENTS, SQL_R, WAVE, events, query, r4, read
from tierloom.sources import files, listing, srt, textgrid, wav


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share, or a temporary one on one machine."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(shared or 'file://' + tempfile.mkdtemp(prefix='tierloom-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> str:
    """Write files (name, content) to a new folder."""
    at = folder(df.sparkSession, name)
    files.write_files(df, at).count()
    return at


NEXT = f"(SELECT user_id, event_type, t, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS t2 FROM {EVENTS})"


@query(f"""SELECT user_id, 0 AS tier_no, 'event' AS tier, 'IntervalTier' AS kind, t / 1e6::DOUBLE AS t1, t2 / 1e6::DOUBLE AS t2, event_type AS label FROM {NEXT} WHERE t2 IS NOT NULL
UNION ALL SELECT user_id, 1, 'view "x"', 'TextTier', t / 1e6::DOUBLE, NULL, event_type FROM {EVENTS} WHERE event_type = 'view'""")
def textgrid_files(spark, d):
    """Tiers of intervals and points, one file for each user, written and read."""
    rows = events(spark, d)
    ends = rows.select("user_id", (F.col("t") / 1e6).alias("t1"), (F.expr("lead(t) OVER (PARTITION BY user_id ORDER BY t)") / 1e6).alias("t2"), F.col("event_type").alias("label")).where("t2 IS NOT NULL")
    intervals = ends.select("user_id", F.lit(0).alias("tier_no"), F.lit("event").alias("tier"), "t1", "t2", "label")
    points = rows.where("event_type = 'view'").select("user_id", F.lit(1).alias("tier_no"), F.lit('view "x"').alias("tier"), (F.col("t") / 1e6).alias("t1"), F.lit(None).cast("double").alias("t2"), F.col("event_type").alias("label"))
    texts = textgrid.textgrid_text(intervals.unionByName(points), ["user_id"], "long")
    at = written(texts.select(F.format_string("user%d.TextGrid", "user_id").alias("name"), F.col("text").alias("content")), "textgrids")
    user = F.regexp_extract("path", r"user(\d+)\.TextGrid$", 1).cast("long").alias("user_id")
    return textgrid.read_textgrid(spark, at).select(user, "tier_no", "tier", "kind", "t1", "t2", "label")


SAMPLE = "(round_even(greatest(least(y, 1), -1) * 32767, 0) / 32768)::FLOAT::DOUBLE"


@query(f"SELECT vec_id, 0 AS chan, i, 64::DOUBLE AS fs, {SQL_R.format(SAMPLE)} AS v FROM {WAVE}")
def wav_files(spark, d):
    """Signals as 16-bit files, one for each vector, written and read."""
    encode = F.udf(lambda y: wav.to_bytes(y, 64), "binary", useArrow=True)
    rows = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("y"))
    at = written(rows.select(F.format_string("v%d.wav", "vec_id").alias("name"), encode("y").alias("content")), "wavs")
    found = wav.load_signals(spark, at).select(F.regexp_extract("path", r"v(\d+)\.wav$", 1).cast("long").alias("vec_id"), "chan", "fs", F.posexplode("y").alias("i", "v"))
    return found.select("vec_id", "chan", F.col("i").cast("long").alias("i"), "fs", r4(F.col("v").cast("double")).alias("v"))


@query(f"SELECT vec_id, chan, chunk, chunk * 0.25::DOUBLE AS start, count(*) AS n, {SQL_R.format('sum(v)')} AS total FROM (SELECT vec_id, 0 AS chan, i, {SAMPLE} AS v FROM {WAVE} UNION ALL SELECT vec_id, 1, i, {SAMPLE.replace('least(y', 'least(-y')} FROM {WAVE}), range(4) z(chunk) WHERE i >= chunk * 16 AND i < chunk * 16 + 24 GROUP BY ALL")
def wav_chunks(spark, d):
    """Overlapping chunks of two-channel files, as long recordings are read."""
    encode = F.udf(lambda y: wav.to_bytes([y, [-v for v in y]], 64), "binary", useArrow=True)
    rows = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("y"))
    at = written(rows.select(F.format_string("v%d.wav", "vec_id").alias("name"), encode("y").alias("content")), "wavs")
    total = F.aggregate("y", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return wav.load_chunks(spark, at, 0.25, 0.125).select(F.regexp_extract("path", r"v(\d+)\.wav$", 1).cast("long").alias("vec_id"), "chan", F.col("chunk").cast("long").alias("chunk"), "start", F.size("y").cast("long").alias("n"), r4(total).alias("total"))


@query("SELECT conv_id, turn + 1 AS seq, turn * 2.0::DOUBLE AS t1, turn * 2.0::DOUBLE + 1.5 AS t2, role AS text FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn FROM conversations)")
def subtitle_files(spark, d):
    """A file of subtitles for each conversation, written and read."""
    number = F.expr("row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1")
    rows = read(spark, d, "conversations").select("conv_id", "role", number.alias("turn"))
    stamp = lambda ms: F.format_string("%02d:%02d:%02d,%03d", (ms / 3600000).cast("int"), (ms / 60000).cast("int") % 60, (ms / 1000).cast("int") % 60, (ms % 1000).cast("int"))
    start = F.col("turn") * 2000
    block = F.concat_ws("\r\n", (F.col("turn") + 1).cast("string"), F.concat(stamp(start), F.lit(" --> "), stamp(start + 1500)), "role")
    blocks = F.array_sort(F.collect_list(F.struct("turn", block.alias("block"))))
    texts = rows.groupBy("conv_id").agg(F.array_join(F.transform(blocks, lambda b: b["block"]), "\r\n\r\n").alias("content"))
    at = written(texts.select(F.format_string("c%d.srt", "conv_id").alias("name"), "content"), "subtitles")
    return srt.read_srt(spark, at).select(F.regexp_extract("path", r"c(\d+)\.srt$", 1).cast("long").alias("conv_id"), (F.col("seq") + 1).cast("long").alias("seq"), "t1", "t2", "text")


@query("SELECT 'r' || n_regionkey || '/x' AS relpath, 'n' || n_nationkey || '.txt' AS fname, 'n' || n_nationkey AS barename, '.txt' AS ext, length(n_name) AS bytes, n_regionkey::VARCHAR AS region_key, n_nationkey::VARCHAR AS nation_key FROM nation WHERE n_regionkey <> 2")
def listed_files(spark, d):
    """A tree of files with names in groups of a pattern; a folder with the sentinel is left out."""
    rows = read(spark, d, "nation").select(F.format_string("r%d/x/n%d.txt", F.col("n_regionkey").cast("long"), F.col("n_nationkey").cast("long")).alias("name"), F.col("n_name").alias("content"))
    bad = spark.createDataFrame([("r2/x/.bad.txt", "")], "name string, content string")
    at = written(rows.unionByName(bad), "tree")
    return listing.list_files(spark, at, r"^n(?P<nation_key>\d+)\.txt$", r"^r(?P<region_key>\d+)/", ["barename", "ext", "bytes"])


@query("SELECT 'm' AS relpath, 's' || s_nationkey AS barename, s_suppkey AS sec, s_acctbal::DOUBLE AS f0 FROM supplier")
def measure_files(spark, d):
    """Tab-separated measures, a file for each nation, read with the names of their files."""
    rows = read(spark, d, "supplier").select("s_nationkey", F.col("s_suppkey").alias("sec"), F.col("s_acctbal").alias("f0"))
    texts = workflow.measure_texts(rows, ["s_nationkey"], ["sec", "f0"], ["sec"])
    at = written(texts.select(F.format_string("m/s%d.ifc", F.col("s_nationkey").cast("long")).alias("name"), "content"), "measures")
    found = workflow.read_measures(spark, at, "sec long, f0 double", at.removeprefix("file://"))
    return found.select("relpath", "barename", "sec", "f0")
