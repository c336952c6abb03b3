"""TextGrid files: parser of the long and short forms, and writer."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierloom.sources.files import binary_files

TIERS = "path string, tier_no int, tier string, kind string, seq int, t1 double, t2 double, label string, xmin double, xmax double"
#: Numbers, quoted strings and flags that stand alone; the words and indexes of the long form are passed over.
TOKEN = re.compile(r'"((?:[^"]|"")*)"|<(exists|absent)>|(?<![\w\[.:])(-?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?)(?![\w\].:])')


#: Rows are handed back in batches of about so many.
BATCH = 20_000


def decode(raw: bytes) -> str:
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16")
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def parse(text: str) -> list[tuple]:
    """Rows (tier_no, tier, kind, seq, t1, t2, label, xmin, xmax); points have no t2. Empty tiers give no rows."""
    body = re.sub(r"(?m)^(\s*(?:item|intervals|points)\s*)\[\d*\]", r"\1", text)
    tokens = [m for m in TOKEN.finditer(body)]
    values: list[str | float] = [m[1].replace('""', '"') if m[1] is not None else m[2] if m[2] else float(m[3]) for m in tokens]
    if len(values) < 2 or "TextGrid" not in (values[1], values[0]):
        raise ValueError("not a TextGrid")
    it = iter(values[values.index("TextGrid") + 1 :])
    xmin, xmax, flag = next(it), next(it), next(it)
    rows: list[tuple] = []
    if flag != "exists":
        return rows
    for tier_no in range(int(next(it))):
        kind, name, _, _, n = next(it), next(it), next(it), next(it), int(next(it))
        for seq in range(n):
            if kind == "IntervalTier":
                t1, t2, label = next(it), next(it), next(it)
            else:
                t1, label = next(it), next(it)
                t2 = None
            rows.append((tier_no, name, kind, seq, t1, t2, label, xmin, xmax))
    return rows


def read_textgrid(spark: SparkSession, path: str, tiers: Sequence[str | int] = (), names: Sequence[str] | str | None = None, errors: str = "raise") -> DataFrame:
    """All tiers of the files, or those chosen by name or number, in order of choice; `names` renames the chosen ones.

    A file that isn't a whole TextGrid fails the job, or gives no rows with errors="ignore".
    """
    if errors not in ("raise", "ignore"):
        raise ValueError(f"unknown errors {errors}")

    def rows_of(raw: bytes) -> list[tuple]:
        try:
            return parse(decode(raw))
        except (ValueError, TypeError, StopIteration) as e:
            if errors == "ignore":
                return []
            raise ValueError(f"not a whole TextGrid: {e}") from None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split()[0] for c in TIERS.split(", ")]
        for pdf in frames:
            rows: list[tuple] = []
            for p, raw in zip(pdf.path, pdf.content):
                rows += [(p, *r) for r in rows_of(raw)]
                if len(rows) >= BATCH:
                    yield pd.DataFrame(rows, columns=cols)
                    rows = []
            yield pd.DataFrame(rows, columns=cols)

    files = binary_files(spark, path).select("path", "content")
    out = files.mapInPandas(run, TIERS)
    chosen = list(tiers)
    if not chosen:
        return out
    if isinstance(names, str):
        names = [names] * len(chosen)
    if names is not None and len(names) < len(chosen):
        raise ValueError("fewer names than tiers")
    pick = [F.when(F.col("tier_no" if isinstance(t, int) else "tier") == t, F.struct(F.lit(k).alias("tier_no"), (F.lit(names[k]) if names else F.col("tier")).alias("tier"))) for k, t in enumerate(chosen)]
    return out.withColumn("_p", F.explode(F.array_compact(F.array(*pick)))).withColumns({"tier_no": F.col("_p.tier_no"), "tier": F.col("_p.tier")}).drop("_p")


def number(fmt: str, col: str) -> Column:
    """A time as text. Fixed formats round the number that is stored, as C and Python do: Java's round its shortest decimal form, which may be the other way."""
    if fmt == "%.15g":
        return F.format_string("%s", F.col(col))

    @F.pandas_udf("string")
    def formatted(x: pd.Series) -> pd.Series:
        return x.map(lambda v: fmt % v, na_action="ignore")

    return formatted(F.col(col).cast("double"))


def quoted(label: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(label.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def tier_blocks(df: DataFrame, keys: Sequence[str], t1: str = "t1", t2: str | None = "t2", label: str = "label", fmt: str = "%.15g", style: str = "short", name: str = "block") -> DataFrame:
    """The text of each tier's entries, in order of time."""
    num = lambda c: number(fmt, c)
    w = Window.partitionBy(*keys).orderBy(t1, *([t2] if t2 else []))
    rows = df.withColumn("_k", F.row_number().over(w))
    if style == "short":
        text = F.concat_ws("\n", num(t1), *([num(t2)] if t2 else []), quoted(F.col(label)))
    else:
        pad = "            "
        head = F.concat(F.lit(f"        {'intervals' if t2 else 'points'} ["), F.col("_k").cast("string"), F.lit("]:"))
        times = [F.concat(F.lit(f"{pad}xmin = "), num(t1)), F.concat(F.lit(f"{pad}xmax = "), num(t2))] if t2 else [F.concat(F.lit(f"{pad}number = "), num(t1))]
        text = F.concat_ws("\n", head, *times, F.concat(F.lit(f"{pad}{'text' if t2 else 'mark'} = "), quoted(F.col(label))))
    sorted_ = F.array_sort(F.collect_list(F.struct("_k", text.alias("x"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(sorted_, lambda e: e["x"]), "\n").alias(name))


def textgrid_text(tiers: DataFrame, keys: Sequence[str], style: str = "short", fmt: str = "%.15g", start: float | None = None, end: float | None = None, fill_gaps: str | None = "", check: bool = True) -> DataFrame:
    """(*keys, text): one TextGrid for each key, from rows (*keys, tier_no, tier, t1, t2, label); tiers without t2 are point tiers.

    With `check`, tiers whose times don't increase, whose intervals don't end after they start, or overlap, raise RuntimeError. Gaps
    between intervals are filled with the label `fill_gaps` unless it is None.
    """
    from tierloom.operators import tiers as ops

    by = [*keys, "tier_no", "tier"]
    span = Window.partitionBy(*keys)
    low = F.lit(float(start)) if start is not None else F.min("t1").over(span)
    high = F.lit(float(end)) if end is not None else F.max(F.coalesce("t2", "t1")).over(span)
    rows = tiers.select(*by, "t1", "t2", "label", low.alias("_low"), high.alias("_high"))
    intervals, points = rows.where("t2 IS NOT NULL"), rows.where("t2 IS NULL")
    if check:
        bad = ops.validate_tier(intervals, by).where("bad_starts + bad_ends + bad_lengths + overlaps > 0").limit(1).collect()
        if bad:
            raise RuntimeError(f"invalid tier: {bad[0].asDict()}")
    bounds = rows.groupBy(*keys).agg(F.max("_low").alias("_low"), F.max("_high").alias("_high"))
    if fill_gaps is not None:
        w = Window.partitionBy(*by).orderBy("t1")
        nxt = F.coalesce(F.lead("t1").over(w), F.col("_high"))
        cols = [*by, "t1", "t2", "label"]
        gaps = intervals.select(*by, F.col("t2").alias("t1"), nxt.alias("t2"), F.lit(fill_gaps).alias("label")).where("t1 < t2")
        first = intervals.groupBy(*by).agg(F.max("_low").alias("t1"), F.min("t1").alias("t2"), F.lit(fill_gaps).alias("label")).where("t1 < t2")
        intervals = intervals.select(*cols).unionByName(gaps).unionByName(first)
    num = lambda c: number(fmt, c)

    def tier(df: DataFrame, kind: str, t2: str | None) -> DataFrame:
        blocks = tier_blocks(df, by, "t1", t2, "label", fmt, style)
        sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
        return blocks.join(sizes, by).withColumn("kind", F.lit(kind))

    both = tier(intervals, "IntervalTier", "t2").unionByName(tier(points, "TextTier", None)).join(bounds, list(keys))
    if style == "short":
        text = F.concat_ws("\n", F.concat(F.lit('"'), "kind", F.lit('"')), quoted(F.col("tier")), num("_low"), num("_high"), F.col("n").cast("string"), "block")
    else:
        unit = F.when(F.col("kind") == "IntervalTier", "intervals").otherwise("points")
        text = F.concat_ws("\n", F.concat(F.lit("    item ["), (F.col("tier_no") + 1).cast("string"), F.lit("]:")), F.concat(F.lit('        class = "'), "kind", F.lit('"')), F.concat(F.lit("        name = "), quoted(F.col("tier"))),
                           F.concat(F.lit("        xmin = "), num("_low")), F.concat(F.lit("        xmax = "), num("_high")), F.concat(F.lit("        "), unit, F.lit(": size = "), F.col("n").cast("string")), "block")
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tier_no", text.alias("x")))), lambda e: e["x"]), "\n")
    whole = both.groupBy(*keys, "_low", "_high").agg(F.count(F.lit(1)).alias("n"), parts.alias("body"))
    head = F.concat_ws("\n", F.lit('File type = "ooTextFile"'), F.lit('Object class = "TextGrid"'), F.lit(""))
    if style == "short":
        text = F.concat_ws("\n", head, num("_low"), num("_high"), F.lit("<exists>"), F.col("n").cast("string"), "body", F.lit(""))
    else:
        text = F.concat_ws("\n", head, F.concat(F.lit("xmin = "), num("_low")), F.concat(F.lit("xmax = "), num("_high")), F.lit("tiers? <exists>"), F.concat(F.lit("size = "), F.col("n").cast("string")), F.lit("item []:"), "body", F.lit(""))
    return whole.select(*keys, text.alias("text"))


def write_textgrids(texts: DataFrame, key: str, folder: str) -> None:
    """One folder `key=value` for each key, with its TextGrid as one text file."""
    texts.select(key, "text").write.mode("overwrite").partitionBy(key).option("lineSep", "\n").text(folder)
