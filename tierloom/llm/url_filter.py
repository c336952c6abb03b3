"""Allow and block rules on hosts and paths, applied by a sort-merge range join.

A rule `host/path` becomes the prefix `reversed.host/path`: `net/de/` is the key interval that starts
with `net/de/`. A url becomes one key for each host depth that any rule has: blog.a.example.net/de/1
is looked up as `net/de/1` and as `net.example/de/1`. Keys are range-partitioned at sampled
boundaries, rules are copied to the ranges that their interval meets, and a sorted sweep over each range
keeps a stack of the nested rules that are active.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierloom.llm.shared import Scratch, attach

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys sampled for each range; the sample is ranges x SAMPLE keys, whatever the input.
SAMPLE = 16
EVENT = ["key", "is_url", "rule", "verdict", "host", "path"]


def url_host(url: str = "url") -> Column:
    """What stands between the first `://` and `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: str = "url") -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://`."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def reversed_host(labels: Column) -> Column:
    return F.array_join(F.reverse(labels), ".")


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(verdict, rule) pairs, such as ("block", "net/de/"), as a DataFrame for `url_filter`."""
    return spark.createDataFrame(rules, "verdict string, rule string")


def _ranges(bounds: list[bytes]) -> tuple[list[bytes], list[int]]:
    """Distinct boundaries, and how many parts the range that starts at each is dealt to: one for each time it was sampled."""
    distinct: list[bytes] = [b""]
    parts = [1]
    for b in bounds:
        if b == distinct[-1]:
            parts[-1] += 1
        else:
            distinct.append(b)
            parts.append(1)
    return distinct, parts


def _dealer(distinct: list[bytes], first: list[int], parts: list[int]):
    """Assigns url keys to one part of their range, and rules to all parts of all ranges that they meet."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, (key, is_url, spread) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "is_url", "spread")))):
                raw = key.encode("utf-8", "surrogatepass")
                low = bisect_right(distinct, raw) - 1
                if is_url:
                    at.append(first[low] + spread % parts[low])
                    rows.append(i)
                else:
                    high = low
                    while high + 1 < len(distinct) and distinct[high + 1].startswith(raw):
                        high += 1
                    span = range(first[low], first[high] + parts[high])
                    at += span
                    rows += [i] * len(span)
            taken = batch.select(EVENT).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(at, pa.int32())], names=[*EVENT, "part"])

    return deal


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (part, key, rules first); the stack holds the rules whose prefix the current key has, shortest first."""
    stack: list[tuple[str, str, str]] = []
    part = None
    for batch in batches:
        found, rows = [], []
        for i, (at, key, is_url, rule, verdict) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("part", "key", "is_url", "rule", "verdict")))):
            if at != part:
                stack, part = [], at
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not is_url:
                if stack and stack[-1][0] == key:
                    continue  # the same rule again: the first in order (allow before block) stays
                stack.append((key, rule, verdict))
            elif stack:
                rows.append(i)
                found.append(stack[-1])
        taken = batch.select(["host", "path"]).take(pa.array(rows, pa.int64()))
        more = [pa.array([len(x[0]) for x in found], pa.int32()), *(pa.array([x[k] for x in found], pa.string()) for k in (1, 2))]
        yield pa.RecordBatch.from_arrays([*taken.columns, *more], names=["host", "path", "size", "rule", "verdict"])


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Verdict on each row's url: (*keep, host, path, rule, verdict).

    `rules` has (verdict, rule); a rule without `/` covers its host and subdomains whole. Of the rules
    that fit, the one with the longest canonical key wins; of two verdicts on one rule, allow. Null
    urls and urls without `://` have an empty host and path and get `default`, as do urls that no rule
    fits. Null rules are ignored. Rows that repeat stay as they are; an empty table gives an empty result; an
    empty rule table gives `default` everywhere.
    """
    spark = pages.sparkSession
    work = Scratch(spark, "urls")
    cut = F.locate("/", F.col("rule"))
    hosts = F.translate(F.when(cut > 0, F.expr("left(rule, locate('/', rule) - 1)")).otherwise(F.col("rule")), UPPER, LOWER)
    paths = F.when(cut > 0, F.expr("substr(rule, locate('/', rule))")).otherwise(F.lit("/"))
    fit = rules.where(F.col("rule").isNotNull() & F.col("verdict").isNotNull()).select("verdict", "rule", F.split(hosts, r"\.").alias("labels"), paths.alias("p"))
    fit = fit.select("verdict", "rule", F.concat(reversed_host(F.col("labels")), "p").alias("key"), F.size("labels").alias("depth"))
    fit = work.save(fit.dropDuplicates(["key", "verdict"]), "rules")
    deepest = fit.agg(F.max("depth")).first()[0] or 0

    rows = work.save(pages.select(*keep, url_host(url_col).alias("host"), url_path(url_col).alias("path")), "pages")
    urls = work.save(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")), "urls")
    labels = F.split("host", r"\.")
    # a rule on a bare host also fits a url without a path: its key gets the slash
    tail = F.when(F.col("path") == "", F.lit("/")).otherwise(F.col("path"))
    # a url has a key for each depth of its host that a rule may have: its labels at most, whatever the rules
    depths = F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest)))
    keys = F.transform(depths, lambda d: F.struct(d.alias("depth"), F.concat(reversed_host(F.slice(labels, F.size(labels) - d + 1, d)), tail).alias("key")))
    some = fit.select("depth").distinct()
    looked = urls.where((F.col("host") != "") & F.lit(deepest > 0)).select("host", "path", F.explode(keys).alias("k")).select("host", "path", "k.key", "k.depth")
    looked = looked.join(some, "depth", "left_semi").drop("depth")
    looked = looked.withColumn("spread", F.abs(F.xxhash64("host", "path") % 1_000_003))

    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = sorted(r.key.encode() for r in looked.orderBy(F.xxhash64("host", "path", "key")).select("key").limit(ranges * SAMPLE).collect())
    distinct, parts = _ranges([sample[i * len(sample) // ranges] for i in range(1, ranges)] if sample else [])
    first = [sum(parts[:i]) for i in range(len(parts))]
    none = F.lit(None).cast("string")
    events = looked.select("key", F.lit(True).alias("is_url"), none.alias("rule"), none.alias("verdict"), "host", "path", "spread").unionByName(
        fit.select("key", F.lit(False).alias("is_url"), "rule", "verdict", none.alias("host"), none.alias("path"), F.lit(0).cast("long").alias("spread"))
    )
    shape = "key string, is_url boolean, rule string, verdict string, host string, path string, part int"
    dealt = events.mapInArrow(_dealer(distinct, first, parts), shape).repartition("part").sortWithinPartitions("part", "key", "is_url", "verdict")
    hits = dealt.mapInArrow(_sweep, "host string, path string, size int, rule string, verdict string")
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), "size").alias("best"))
    judged = urls.join(best, ["host", "path"], "left")
    out = attach(rows, judged, ["host", "path"], list(keep), rows.count())
    return out.select(*keep, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
