"""Named queries over the test tables, each with the DuckDB SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierloom.functions import arrays, scales
from tierloom.operators import asof, norm, series, tiers

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Rounding that both engines do alike.
SQL_R = "floor(({}) * 1e4 + 0.5) / 1e4"
HOUR = 3_600_000_000
EVENTS = "(SELECT *, epoch_us(ts) AS t FROM events)"
WAVE = "(SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS y FROM embeddings)"


def r4(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.floor(col * F.lit(1e4) + F.lit(0.5)) / F.lit(1e4)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    df = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return df.where(F.col("event_type").isin(*kinds)) if kinds else df


def wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.samples(read(spark, sf_dir, "embeddings"), "embedding", ["vec_id"])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each click: the event before and after, the view that was open, and the value at quarters of the gap to the next event."""
    every = events(spark, sf_dir)
    with_next = every.withColumn("t2", F.lead("t").over(Window.partitionBy("user_id").orderBy("t", "event_id")))
    labelled = tiers.add_context(with_next, "event_type", 1, 1, ["user_id"], ["t", "event_id"])
    clicks = labelled.where("event_type = 'click' AND t2 IS NOT NULL")
    views = every.where("event_type = 'view'").select("user_id", F.col("t").alias("view_t"), F.col("event_id").alias("view_id"))
    merged = asof.merge_tiers(clicks, views, ["user_id"], "t", "view_t")
    parts = tiers.explode_intervals(merged, [0.25, 0.5, 0.75], "t", "t2").drop("value")
    measures = every.select("user_id", "t", "value")
    found = asof.interpolate(measures, parts, ["user_id"], "t", "obs_t", default_tolerance=False)
    return found.groupBy("prev_event_type1", "next_event_type1", "obs_id").agg(F.count(F.lit(1)).alias("n"), F.count("view_id").alias("n_viewed"), r4(F.avg("value") + F.lit(1e-6)).alias("mean_value"))


@query(f"""
WITH e AS (SELECT *, lead(t) OVER w AS t2, coalesce(lag(event_type) OVER w, '') AS p, coalesce(lead(event_type) OVER w, '') AS x
  FROM {EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
c AS (SELECT * FROM e WHERE event_type = 'click' AND t2 IS NOT NULL),
v AS (SELECT user_id, t AS view_t, event_id AS view_id FROM {EVENTS} WHERE event_type = 'view'),
m AS (SELECT c.*, v.view_id FROM c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.t >= v.view_t),
o AS (SELECT m.user_id, p, x, view_id, q AS obs_id, m.t + (t2 - m.t) * q AS obs_t FROM m, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) z(q)),
b AS (SELECT o.*, a.t AS t0, a.value AS v0 FROM o ASOF LEFT JOIN {EVENTS} a ON o.user_id = a.user_id AND o.obs_t >= a.t),
f AS (SELECT b.*, a.t AS t1, a.value AS v1 FROM b ASOF LEFT JOIN {EVENTS} a ON b.user_id = a.user_id AND b.obs_t <= a.t)
SELECT p AS prev_event_type1, x AS next_event_type1, obs_id, count(*) AS n, count(view_id) AS n_viewed,
  {SQL_R.format("avg(CASE WHEN t1 = t0 THEN v0 ELSE coalesce(v0 + (v1 - v0) * (obs_t - t0) / (t1 - t0), v0, v1) END) + 1e-6::DOUBLE")} AS mean_value FROM f GROUP BY ALL
""")
def flagship_click_context(spark, d):
    return flagship(spark, d)


VIEWS = f"(SELECT user_id, t AS view_t, event_id AS view_id, value FROM {EVENTS} WHERE event_type = 'view')"
CLICKS = f"(SELECT user_id, t, event_id, value FROM {EVENTS} WHERE event_type = 'click')"


def views(spark, d):
    return events(spark, d, "view").select("user_id", F.col("t").alias("view_t"), F.col("event_id").alias("view_id"), "value")


def clicks(spark, d):
    return events(spark, d, "click").select("user_id", "t", "event_id", "value")


@query(f"""SELECT c.user_id, t, event_id, c.value AS value_inner, coalesce(view_t, -1) AS view_t, view_id, v.value AS value_outer
FROM {CLICKS} c ASOF LEFT JOIN {VIEWS} v ON c.user_id = v.user_id AND c.t >= v.view_t""")
def asof_merge_tiers(spark, d):
    return asof.merge_tiers(clicks(spark, d), views(spark, d), ["user_id"], "t", "view_t").withColumn("view_t", F.coalesce("view_t", F.lit(-1)))


@query(f"""SELECT c.user_id, t, event_id, coalesce(view_t, -1) AS view_t, view_id, v.value AS value
FROM {CLICKS} c ASOF LEFT JOIN {VIEWS} v ON c.user_id = v.user_id AND c.t >= v.view_t""")
def asof_drop_common(spark, d):
    return asof.merge_tiers(clicks(spark, d), views(spark, d), ["user_id"], "t", "view_t", drop_repeated="inner", width=24.0 * HOUR).withColumn("view_t", F.coalesce("view_t", F.lit(-1)))


NEAREST = f"""WITH b AS (SELECT v.*, c.t AS t0, c.event_id AS e0 FROM {VIEWS} v ASOF LEFT JOIN {CLICKS} c ON v.user_id = c.user_id AND v.view_t >= c.t),
f AS (SELECT b.*, c.t AS t1, c.event_id AS e1 FROM b ASOF LEFT JOIN {CLICKS} c ON b.user_id = c.user_id AND b.view_t <= c.t),
n AS (SELECT *, t0 IS NULL OR (t1 IS NOT NULL AND t1 - view_t <= view_t - t0) AS later FROM f)
SELECT user_id, view_t, view_id, CASE WHEN later THEN e1 ELSE e0 END AS near_event_id, CASE WHEN later THEN t1 ELSE t0 END AS near_t,
  CASE WHEN later THEN t1 - view_t ELSE view_t - t0 END AS distance FROM n"""


@query(f"SELECT user_id, view_t, view_id, CASE WHEN distance <= {6 * HOUR} THEN near_t ELSE -1 END AS snapped FROM ({NEAREST})")
def nearest_snap(spark, d):
    inner = clicks(spark, d).select("user_id", "t")
    return asof.adjust_boundaries(inner=inner, outer=views(spark, d).drop("value"), keys=["user_id"], tolerance=6 * HOUR, outer_t="view_t", on_error="flag").withColumn("snapped", F.coalesce("snapped", F.lit(-1)))


@query(NEAREST)
def nearest_match(spark, d):
    return asof.nearest(views(spark, d).drop("value"), clicks(spark, d).drop("value"), ["user_id"], "view_t", "t").drop("within")


@query(f"""SELECT p.event_id, count(*) AS n, {SQL_R.format('avg(c.value)')} AS mean_value FROM {EVENTS} p JOIN {CLICKS} c
ON p.user_id = c.user_id AND c.t BETWEEN p.t AND p.t + {24 * HOUR} WHERE p.event_type = 'purchase' GROUP BY p.event_id""")
def range_join_measures(spark, d):
    spans = events(spark, d, "purchase").select("user_id", F.col("event_id").alias("id"), F.col("t").alias("t1"), (F.col("t") + 24 * HOUR).alias("t2"))
    found = asof.contained(clicks(spark, d), spans, ["user_id"], "t", "t1", "t2", bin_width=24.0 * HOUR)
    return found.groupBy(F.col("id").alias("event_id")).agg(F.count(F.lit(1)).alias("n"), r4(F.avg("value")).alias("mean_value"))


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_outputs(spark, d):
    from tierloom.operators.workflow import missing

    return missing(read(spark, d, "documents").select("doc_id", "source"), read(spark, d, "labels"), ["doc_id"])


@query("SELECT s_suppkey, s_name, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def metadata_left_join(spark, d):
    # nation and region have 25 and 5 rows at every scale; Spark broadcasts them by their size
    s, n, r = (read(spark, d, x) for x in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").select("s_suppkey", "s_name", "n_name", "r_name")


@query("SELECT o_orderkey, o_custkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def inner_cache_join(spark, d):
    o, line = read(spark, d, "orders"), read(spark, d, "lineitem")
    return o.join(line, o.o_orderkey == line.l_orderkey).select("o_orderkey", "o_custkey", "l_linenumber", "l_quantity")


@query("""SELECT conv_id, turn, coalesce(lag(role, 2) OVER w, '') AS prev_role2, coalesce(lag(role) OVER w, '') AS prev_role1, role,
coalesce(lead(role) OVER w, '') AS next_role1, concat_ws(' ', coalesce(lag(role, 2) OVER w, ''), coalesce(lag(role) OVER w, ''), role, coalesce(lead(role) OVER w, '')) AS ctx
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def context_prev_next(spark, d):
    rows = read(spark, d, "conversations").select("conv_id", "turn", "role")
    return tiers.add_context(rows, "role", 2, 1, ["conv_id"], ["turn"], context="ctx")


SPANS = f"(SELECT user_id, event_type, t AS t1, t + {2 * HOUR} AS t2 FROM {EVENTS})"


def spans(spark, d):
    return events(spark, d).select("user_id", "event_type", F.col("t").alias("t1"), (F.col("t") + 2 * HOUR).alias("t2"))


@query(f"""WITH s AS (SELECT *, lead(t1) OVER (PARTITION BY user_id ORDER BY t1, t2) AS n FROM {SPANS})
SELECT user_id, t1, t2, event_type FROM s UNION ALL SELECT user_id, t2, n, '' FROM s WHERE t2 < n
UNION ALL SELECT user_id, 0, min(t1), '' FROM s GROUP BY user_id HAVING min(t1) > 0""")
def gap_fill(spark, d):
    return tiers.fill_gaps(spans(spark, d), ["user_id"], "event_type", start=0)


@query(f"""WITH s AS (SELECT *, lag(t1) OVER w AS p1, lag(t2) OVER w AS p2 FROM {SPANS} WINDOW w AS (PARTITION BY user_id ORDER BY t1, t2))
SELECT user_id, count_if(t1 <= p1) AS bad_starts, count_if(t2 <= p2) AS bad_ends, count_if(t2 <= t1) AS bad_lengths, count_if(t1 < p2) AS overlaps FROM s GROUP BY user_id""")
def tier_validate(spark, d):
    return tiers.validate_tier(spans(spark, d), ["user_id"])


@query(f"""WITH s AS (SELECT *, max(t2) OVER (PARTITION BY user_id ORDER BY t1, t2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end FROM {SPANS})
SELECT * FROM s WHERE prev_end > t1""")
def overlap_check(spark, d):
    return tiers.overlaps(spans(spark, d), ["user_id"])


@query(f"""WITH a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS pos, value > 50 AS flag FROM {EVENTS}),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS g FROM a WHERE flag),
r AS (SELECT user_id, min(pos) AS first, max(pos) AS last, count(*) AS length FROM g GROUP BY user_id, g HAVING count(*) >= 2)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY first) - 1 AS run, first, last, length FROM r""")
def runs_threshold(spark, d):
    return tiers.nonzero_runs(events(spark, d), ["user_id"], ["t", "event_id"], F.col("value") > 50, 2)


@query("""SELECT o_orderkey, k AS obs_id, o_custkey + o_totalprice * k / 4 AS obs_t FROM (SELECT o_orderkey, o_custkey, o_totalprice::DOUBLE AS o_totalprice FROM orders), range(5) z(k)"""
       .replace("o_custkey + o_totalprice * k / 4", SQL_R.format("o_custkey + o_totalprice * k / 4")))
def explode_int(spark, d):
    rows = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("double").alias("t1"), (F.col("o_custkey") + F.col("o_totalprice").cast("double")).alias("t2"))
    return tiers.explode_intervals(rows, 4).select("o_orderkey", F.col("obs_id").cast("long").alias("obs_id"), r4("obs_t").alias("obs_t"))


@query(f"""SELECT o_orderkey, p AS obs_id, {SQL_R.format('o_custkey + o_totalprice * p')} AS obs_t FROM (SELECT o_orderkey, o_custkey, o_totalprice::DOUBLE AS o_totalprice FROM orders),
(VALUES (0.2::DOUBLE), (0.8::DOUBLE)) z(p)""")
def explode_props(spark, d):
    rows = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("double").alias("t1"), (F.col("o_custkey") + F.col("o_totalprice").cast("double")).alias("t2"))
    return tiers.explode_intervals(rows, [0.2, 0.8]).select("o_orderkey", "obs_id", r4("obs_t").alias("obs_t"))


@query(f"""WITH b AS (SELECT v.user_id, view_id, view_t, c.t AS t0, c.value AS v0 FROM {VIEWS} v ASOF LEFT JOIN {CLICKS} c ON v.user_id = c.user_id AND v.view_t >= c.t),
f AS (SELECT b.*, c.t AS t1, c.value AS v1 FROM b ASOF LEFT JOIN {CLICKS} c ON b.user_id = c.user_id AND b.view_t <= c.t),
s AS (SELECT user_id, (max(t) - min(t)) / nullif(count(*) - 1, 0) / 2 AS tol FROM {CLICKS} GROUP BY user_id)
SELECT f.user_id, view_id, view_t, coalesce(least(view_t - t0, t1 - view_t) <= tol, tol IS NULL AND least(view_t - t0, t1 - view_t) IS NOT NULL) AS within,
CASE WHEN within THEN {SQL_R.format('CASE WHEN t1 = t0 THEN v0 ELSE coalesce(v0 + (v1 - v0) * (view_t - t0) / (t1 - t0), v0, v1) END')} END AS value FROM f LEFT JOIN s USING (user_id)""")
def interpolate_linear(spark, d):
    targets = views(spark, d).drop("value")
    found = asof.interpolate(clicks(spark, d).select("user_id", "t", "value"), targets, ["user_id"], "t", "view_t", width=24.0 * HOUR)
    return found.withColumn("value", r4("value"))


@query(f"""WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id)::DOUBLE AS k, CASE WHEN event_type = 'view' THEN value END AS v FROM {EVENTS}),
p AS (SELECT user_id, k AS x, v AS y FROM e WHERE v IS NOT NULL),
b AS (SELECT e.*, p.x AS x0, p.y AS y0 FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.k >= p.x),
f AS (SELECT b.*, p.x AS x1, p.y AS y1 FROM b ASOF LEFT JOIN p ON b.user_id = p.user_id AND b.k <= p.x)
SELECT user_id, event_id, {SQL_R.format('CASE WHEN x0 = x1 THEN y0 ELSE coalesce(y0 + (y1 - y0) * (k - x0) / (x1 - x0), y0, y1) END')} AS v FROM f""")
def position_interpolate(spark, d):
    rows = events(spark, d).select("user_id", "event_id", "t", F.when(F.col("event_type") == "view", F.col("value")).alias("v"))
    return asof.interpolate_positions(rows, ["user_id"], ["t", "event_id"], ["v"]).select("user_id", "event_id", r4("v").alias("v"))


TALK = "(SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN text ELSE role || ': ' || text END AS text FROM conversations)"


def talk(spark, d):
    said = F.when(F.col("turn") % 3 == 2, F.col("text")).otherwise(F.concat("role", F.lit(": "), "text"))
    return read(spark, d, "conversations").select("conv_id", "turn", said.alias("text"))


@query(f"""WITH s AS (SELECT *, string_split(text, ': ') AS p FROM {TALK})
SELECT conv_id, turn, CASE WHEN len(p) = 2 THEN p[2] ELSE p[1] END AS text, coalesce(CASE WHEN len(p) = 2 THEN p[1] END, '*') AS speaker FROM s""")
def speaker_split(spark, d):
    return tiers.split_speakers(talk(spark, d), ["conv_id"], ["turn"], sep=": ", ffill=False)


@query(f"""WITH s AS (SELECT *, string_split(text, ': ') AS p FROM {TALK})
SELECT conv_id, turn, CASE WHEN len(p) = 2 THEN p[2] ELSE p[1] END AS text,
coalesce(last_value(CASE WHEN len(p) = 2 THEN p[1] END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn), '*') AS speaker FROM s""")
def speaker_split_ffill(spark, d):
    return tiers.split_speakers(talk(spark, d), ["conv_id"], ["turn"], sep=": ")


@query(f"""WITH s AS (SELECT user_id, t, event_id, CASE WHEN value > lag(value) OVER w THEN 'r' ELSE 'f' END AS c, row_number() OVER w AS k
FROM {EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT user_id, coalesce(string_agg(c, '' ORDER BY k) FILTER (WHERE k > 1), '') AS contour FROM s GROUP BY user_id""")
def contour_type(spark, d):
    return tiers.contour(events(spark, d), ["user_id"], "t", "value")


LINE = "(SELECT l_returnflag AS spk, l_orderkey, l_linenumber, l_quantity::DOUBLE AS F1, CASE WHEN l_linenumber <> 3 THEN l_extendedprice::DOUBLE END AS F2, l_discount::DOUBLE AS F3, l_tax::DOUBLE AS F4 FROM lineitem)"
DELTA = "(sum(F1) / 1 * 2 + coalesce(sum(F2), 0) / 1.5::DOUBLE + sum(F3) / 2.5::DOUBLE + sum(F4) / 3.5::DOUBLE) / (count(F1) + count(F2) + count(F3) + count(F4))"


def formant_rows(spark, d):
    c = lambda x: F.col(x).cast("double")
    return read(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("spk"), "l_orderkey", "l_linenumber", c("l_quantity").alias("F1"),
        F.when(F.col("l_linenumber") != 3, c("l_extendedprice")).alias("F2"), c("l_discount").alias("F3"), c("l_tax").alias("F4"),
    )


@query(f"SELECT {SQL_R.format(DELTA)} AS \"deltaF\" FROM {LINE}")
def deltaf_global(spark, d):
    return norm.delta_f(formant_rows(spark, d)).select(r4("deltaF").alias("deltaF"))


@query(f"SELECT spk, {SQL_R.format(DELTA)} AS \"deltaF\" FROM {LINE} GROUP BY spk")
def deltaf_by_group(spark, d):
    return norm.delta_f(formant_rows(spark, d), ["spk"]).withColumn("deltaF", r4("deltaF"))


@query(f"SELECT spk, {SQL_R.format(f'35300 / (2 * {DELTA})')} AS vtl FROM {LINE} GROUP BY spk")
def vtl(spark, d):
    return norm.delta_f(formant_rows(spark, d), ["spk"], vtl=True).withColumn("vtl", r4("vtl"))


@query(f"""SELECT l_orderkey, l_linenumber, {SQL_R.format('F1 / d')} AS n1, {SQL_R.format('F2 / d')} AS n2 FROM {LINE} JOIN (SELECT spk, {DELTA} AS d FROM {LINE} GROUP BY spk) USING (spk)""")
def deltaf_norm(spark, d):
    out = norm.delta_f_norm(formant_rows(spark, d), ["spk"])
    return out.select("l_orderkey", "l_linenumber", r4("F1/∆F").alias("n1"), r4("F2/∆F").alias("n2"))


@query("SELECT event_type, count(value) AS value_count, " + ", ".join(f"{SQL_R.format(x)} AS value_{n}" for n, x in (("mean", "avg(value)"), ("std", "stddev_samp(value)"), ("min", "min(value)"), ("p25", "quantile_cont(value, 0.25)"), ("p50", "quantile_cont(value, 0.5)"), ("p75", "quantile_cont(value, 0.75)"), ("max", "max(value)"))) + " FROM events GROUP BY event_type")
def group_describe(spark, d):
    out = series.describe(read(spark, d, "events"), ["event_type"], "value")
    return out.select("event_type", "value_count", *[r4(c).alias(c) for c in out.columns[2:]])


@query(f"SELECT user_id, {SQL_R.format('avg(value)')} AS mean_value, {SQL_R.format('median(value)')} AS median_value FROM events GROUP BY user_id")
def group_mean_median(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(r4(F.avg("value")).alias("mean_value"), r4(F.median("value")).alias("median_value"))


@query(f"""SELECT vec_id, len(embedding) AS n, len(embedding) / 64::DOUBLE AS duration, {SQL_R.format('list_min(embedding)::DOUBLE')} AS y_min, {SQL_R.format('list_max(embedding)::DOUBLE')} AS y_max,
(list_position(embedding, list_max(embedding)) - 1) / 64::DOUBLE AS t_max, (list_position(embedding, list_min(embedding)) - 1) / 64::DOUBLE AS t_min,
{SQL_R.format('list_avg(embedding::DOUBLE[])')} AS y_mean, {SQL_R.format('sqrt(list_avg(list_transform(embedding::DOUBLE[], lambda x: x * x)))')} AS y_rms,
{SQL_R.format('list_stddev_pop(embedding::DOUBLE[])')} AS y_sd, embedding[33]::DOUBLE AS y_half FROM embeddings""")
def signal_stats(spark, d):
    y, fs = "embedding", 64.0
    return read(spark, d, "embeddings").select(
        "vec_id", F.size(y).cast("long").alias("n"), (F.size(y) / F.lit(fs)).alias("duration"), r4(F.array_min(y).cast("double")).alias("y_min"), r4(F.array_max(y).cast("double")).alias("y_max"),
        arrays.time_of_max(y, fs).alias("t_max"), arrays.time_of_min(y, fs).alias("t_min"), r4(arrays.mean(y)).alias("y_mean"), r4(arrays.rms(y)).alias("y_rms"),
        r4(arrays.deviation(y)).alias("y_sd"), arrays.value_at(y, F.lit(0.5), fs).alias("y_half"),
    )


@query(f"""SELECT vec_id, frame, sec, {SQL_R.format('sqrt(list_avg(list_transform(list_slice(embedding, frame * 8 + 1, frame * 8 + 16)::DOUBLE[], lambda x: x * x)))')} AS rms
FROM (SELECT vec_id, embedding, unnest(range(0, (len(embedding) - 16) // 8 + 1)) AS frame, (frame * 8 + 8) / 64::DOUBLE AS sec FROM embeddings)""")
def rms_frames(spark, d):
    out = series.frames(read(spark, d, "embeddings"), "embedding", 16, 8, ["vec_id"], 64.0)
    return out.select("vec_id", F.col("frame").cast("long").alias("frame"), "sec", r4(arrays.rms("y")).alias("rms"))


def _samplewise(expression: str, window: str) -> str:
    return f"SELECT vec_id, i, {SQL_R.format(expression)} AS v FROM {WAVE} WINDOW w AS ({window})"


def _wave_column(spark, d, y: Column) -> DataFrame:
    """One row for each sample of an array that is worked out in place, without a shuffle."""
    rows = read(spark, d, "embeddings").select("vec_id", F.posexplode(y).alias("i", "v"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), r4("v").alias("v"))


ORDERED, WHOLE = "PARTITION BY vec_id ORDER BY i", "PARTITION BY vec_id"


@query(_samplewise("y - 0.94::DOUBLE * coalesce(lag(y) OVER w, 0)", ORDERED))
def preemphasis(spark, d):
    return _wave_column(spark, d, arrays.preemphasised("embedding", 0.94))


@query(_samplewise("y - lag(y) OVER w", ORDERED))
def difference(spark, d):
    return _wave_column(spark, d, arrays.differences("embedding"))


@query(_samplewise("CASE WHEN lag(y) OVER w IS NULL THEN lead(y) OVER w - y WHEN lead(y) OVER w IS NULL THEN y - lag(y) OVER w ELSE (lead(y) OVER w - lag(y) OVER w) / 2 END", ORDERED))
def gradient(spark, d):
    return _wave_column(spark, d, arrays.gradient("embedding"))


@query(_samplewise("(y - avg(y) OVER w) / stddev_pop(y) OVER w", WHOLE))
def zscore_time(spark, d):
    return _wave_column(spark, d, arrays.standardised("embedding"))


@query(_samplewise("(y - min(y) OVER w) / (max(y) OVER w - min(y) OVER w)", WHOLE))
def minmax_norm(spark, d):
    return _wave_column(spark, d, arrays.between_extremes("embedding"))


@query(_samplewise("y - avg(y) OVER w", WHOLE))
def remove_dc(spark, d):
    return _wave_column(spark, d, arrays.without_mean("embedding"))


@query(_samplewise("CASE WHEN y >= min(y) OVER w + (max(y) OVER w - min(y) OVER w) * 0.5 THEN y END", WHOLE))
def threshold_mask(spark, d):
    return _wave_column(spark, d, arrays.above_threshold("embedding"))


@query(f"""SELECT vec_id, i, CASE WHEN count(y) OVER w >= 3 THEN {SQL_R.format('max(y) OVER w')} END AS high, CASE WHEN count(y) OVER w >= 3 THEN {SQL_R.format('min(y) OVER w')} END AS low
FROM {WAVE} WINDOW w AS (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)""")
def rolling_minmax(spark, d):
    both = F.arrays_zip(*[arrays.rolling("embedding", 8, 3, how).alias(name) for how, name in (("max", "high"), ("min", "low"))])
    rows = read(spark, d, "embeddings").select("vec_id", F.posexplode(both).alias("i", "e"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), r4("e.high").alias("high"), r4("e.low").alias("low"))


@query(f"SELECT vec_id, count_if(y >= 0 AND p < 0) AS up, count_if(y < 0 AND p >= 0) AS down FROM (SELECT *, lag(y) OVER (PARTITION BY vec_id ORDER BY i) AS p FROM {WAVE}) GROUP BY vec_id")
def zero_crossings(spark, d):
    up, down = arrays.crossings("embedding")
    return read(spark, d, "embeddings").select("vec_id", up.alias("up"), down.alias("down"))


@query(f"SELECT vec_id, i FROM {WAVE} WHERE y > 0.2::DOUBLE")
def nonzero_indexes(spark, d):
    return wave(spark, d).where(F.col("y") > 0.2).select("vec_id", F.col("i").cast("long").alias("i"))


@query(f"""SELECT vec_id, i, {SQL_R.format('y')} AS v, rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY y DESC, i) AS rank FROM {WAVE}) WHERE rank <= 3""")
def topk_peaks(spark, d):
    rows = read(spark, d, "embeddings").select("vec_id", F.posexplode(arrays.highest("embedding")).alias("rank", "p"))
    return rows.select("vec_id", F.col("p.i").cast("long").alias("i"), r4("p.v").alias("v"), (F.col("rank") + 1).cast("long").alias("rank"))


@query(f"""WITH l AS (SELECT a.vec_id, b.i - a.i AS lag, sum(a.y * b.y) AS ac FROM {WAVE} a JOIN {WAVE} b ON a.vec_id = b.vec_id AND b.i - a.i BETWEEN 4 AND 15 GROUP BY ALL),
z AS (SELECT vec_id, sum(y * y) AS e FROM {WAVE} GROUP BY vec_id),
m AS (SELECT vec_id, arg_max(lag, ac) AS lag, max(ac) AS ac FROM l GROUP BY vec_id)
SELECT vec_id, 64::DOUBLE / lag AS f0, {SQL_R.format('CASE WHEN ac > 0 THEN sqrt(ac / e) ELSE 0 END')} AS c FROM m JOIN z USING (vec_id)""")
def autocorr_f0(spark, d):
    y = F.transform("embedding", lambda x: x.cast("double"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)
    rows = read(spark, d, "embeddings").select("vec_id", y.alias("y"), F.size("embedding").alias("n"))
    lags = F.transform(F.sequence(F.lit(4), F.lit(15)), lambda k: F.struct(dot(F.slice("y", F.lit(1), F.col("n") - k), F.slice("y", k + 1, F.col("n") - k)).alias("ac"), (-k).alias("k")))
    best = rows.select("vec_id", dot(F.col("y"), F.col("y")).alias("e"), F.array_max(lags).alias("b"))
    return best.select("vec_id", (F.lit(64.0) / -F.col("b.k")).alias("f0"), r4(F.when(F.col("b.ac") > 0, F.sqrt(F.col("b.ac") / F.col("e"))).otherwise(0.0)).alias("c"))


SPECTRUM = f"""(SELECT vec_id, k, (sum(y * cos(2 * pi() * k * i / 64)) ** 2 + sum(y * sin(2 * pi() * k * i / 64)) ** 2) AS p FROM {WAVE}, range(33) z(k) GROUP BY ALL)"""


def spectrum(spark, d) -> DataFrame:
    from tierloom.signal.udfs import power_spectrum as power

    rows = read(spark, d, "embeddings").select("vec_id", power("embedding").alias("s"))
    return rows.select("vec_id", F.posexplode("s").alias("k", "p"))


@query(f"SELECT vec_id, k, {SQL_R.format('p')} AS p FROM {SPECTRUM}")
def power_spectrum(spark, d):
    return spectrum(spark, d).select("vec_id", F.col("k").cast("long").alias("k"), r4("p").alias("p"))


@query(f"""WITH s AS (SELECT vec_id, k::DOUBLE AS f, p / sum(p) OVER (PARTITION BY vec_id) AS w FROM {SPECTRUM}), c AS (SELECT vec_id, sum(f * w) AS g FROM s GROUP BY vec_id),
m AS (SELECT vec_id, any_value(g) AS g, sum(w * (f - g) ** 2) AS v, sum(w * (f - g) ** 3) AS m3, sum(w * (f - g) ** 4) AS m4 FROM s JOIN c USING (vec_id) GROUP BY vec_id)
SELECT vec_id, {SQL_R.format('g')} AS cog, {SQL_R.format('sqrt(v)')} AS sd, {SQL_R.format('m3 / v ** 1.5')} AS skew, {SQL_R.format('m4 / (v * v) - 3')} AS kurtosis FROM m""")
def spectral_moments(spark, d):
    from tierloom.signal.udfs import power_spectrum as power

    rows = read(spark, d, "embeddings").select("vec_id", power("embedding").alias("s")).select("vec_id", arrays.moments("s").alias("m"))
    return rows.select("vec_id", *[r4(f"m.{c}").alias(c) for c in ("cog", "sd", "skew", "kurtosis")])


@query(f"""WITH m AS (SELECT *, max(y) OVER w AS hi, min(y) OVER w AS lo FROM {WAVE} WINDOW w AS (PARTITION BY vec_id)), f AS (SELECT vec_id, i, CASE WHEN hi + lo < 0 THEN -y ELSE y END AS y FROM m)
SELECT vec_id, i, {SQL_R.format('y / max(y) OVER (PARTITION BY vec_id) * 0.99::DOUBLE')} AS v FROM f""")
def polarity_scale(spark, d):
    rows = read(spark, d, "embeddings").select("vec_id", F.posexplode(arrays.scaled(arrays.polarity("embedding"))).alias("i", "v"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), r4("v").alias("v"))


PRICE = "(SELECT l_orderkey, l_linenumber, l_extendedprice::DOUBLE AS hz FROM lineitem)"


def prices(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("double").alias("hz"))


@query(f"SELECT l_orderkey, l_linenumber, {SQL_R.format('7 * asinh(hz / 650)')} AS bark, {SQL_R.format('650 * sinh(asinh(hz / 650))')} AS hz FROM {PRICE}")
def hz2bark_scale(spark, d):
    bark = scales.hz2bark(F.col("hz"))
    return prices(spark, d).select("l_orderkey", "l_linenumber", r4(bark).alias("bark"), r4(scales.bark2hz(bark)).alias("hz"))


@query(f"""SELECT l_orderkey, l_linenumber, {SQL_R.format('10 * log10(hz)')} AS db, {SQL_R.format('20 * log10(hz / max(hz) OVER ())')} AS amp FROM {PRICE}""")
def db_scale(spark, d):
    rows = prices(spark, d)
    top = rows.agg(F.max("hz").alias("top")).scalar()
    return rows.select("l_orderkey", "l_linenumber", r4(scales.db(F.col("hz"))).alias("db"), r4(scales.amplitude_db(F.col("hz"), top)).alias("amp"))


@query(f"SELECT l_orderkey, l_linenumber, {SQL_R.format('550 * ln(1 + hz / 550)')} AS mel, {SQL_R.format('12 * ln(hz / 100) / ln(2)')} AS st, {SQL_R.format('11.17::DOUBLE * ln((hz + 312) / (hz + 14680)) + 43')} AS erb FROM {PRICE}")
def pitch_units(spark, d):
    unit = lambda u: r4(scales.pitch_unit(F.col("hz"), u))
    return prices(spark, d).select("l_orderkey", "l_linenumber", unit("MEL").alias("mel"), unit("SEMITONES_100").alias("st"), unit("ERB").alias("erb"))


@query(f"SELECT event_id, {SQL_R.format('o / (1 + o)')} AS probv, o / (1 + o) > 0.5 AS voiced FROM (SELECT event_id, exp(-4.2::DOUBLE + 0.17::DOUBLE * -value + 13.2::DOUBLE * (value / 100)) AS o FROM events)")
def voicing_prob(spark, d):
    p = scales.voicing_probability(-F.col("value"), F.col("value") / 100)
    return read(spark, d, "events").select("event_id", r4(p).alias("probv"), (p > 0.5).alias("voiced"))


@query(f"SELECT event_id, {SQL_R.format('1 / (1 + exp(-x))')} AS probv, x > 0 AS voiced FROM (SELECT event_id, -7.2::DOUBLE + 9.45::DOUBLE * (value / 100) + 10 * (value / 100 - 0.5::DOUBLE) AS x FROM events)")
def voicing_prob_older(spark, d):
    p = scales.voicing_probability(F.col("value") / 100, F.col("value") / 100 - 0.5, (-7.2, 9.45, 10.0))
    return read(spark, d, "events").select("event_id", r4(p).alias("probv"), (p > 0.5).alias("voiced"))


@query(f"SELECT k AS band, {SQL_R.format('100 * 2 ** k / 2 ** (1 / 6::DOUBLE)')} AS low, {SQL_R.format('100 * 2 ** k * 2 ** (1 / 6::DOUBLE)')} AS high FROM range(6) z(k)")
def octave_bands(spark, d):
    return scales.third_octave_bands(spark).select("band", r4("low").alias("low"), r4("high").alias("high"))


@query(f"SELECT k AS band, {SQL_R.format('exp(ln(70) + k * ((ln(4999) - ln(70)) / 24))')} AS low, {SQL_R.format('exp(ln(70) + (k + 1) * ((ln(4999) - ln(70)) / 24))')} AS high FROM range(24) z(k)")
def shannon_bands(spark, d):
    return scales.shannon_bands(spark).select("band", r4("low").alias("low"), r4("high").alias("high"))


@query(f"""SELECT i, {SQL_R.format('0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * i / 63)')} AS hamming,
{SQL_R.format('0.35875::DOUBLE - 0.48829::DOUBLE * cos(2 * pi() * i / 63) + 0.14128::DOUBLE * cos(4 * pi() * i / 63) - 0.01168::DOUBLE * cos(6 * pi() * i / 63)')} AS harris,
{SQL_R.format('CASE WHEN least(i, 63 - i) < 3.15::DOUBLE THEN 0.5::DOUBLE * (1 + cos(pi() * (least(i, 63 - i) / 3.15::DOUBLE - 1))) ELSE 1 END')} AS tukey FROM range(64) z(i)""")
def window_functions(spark, d):
    kinds = {"hamming": "hamming", "blackmanharris": "harris", "tukey": "tukey"}
    return spark.range(64).select(F.col("id").alias("i"), *[r4(scales.window_function(k, F.col("id"), 64)).alias(n) for k, n in kinds.items()])


@query("SELECT l_orderkey, l_linenumber, list_sort([l_quantity::DOUBLE, l_extendedprice::DOUBLE, l_discount::DOUBLE, l_tax::DOUBLE])[1] AS low, list_sort([l_quantity::DOUBLE, l_extendedprice::DOUBLE, l_discount::DOUBLE, l_tax::DOUBLE])[4] AS high FROM lineitem")
def order_values(spark, d):
    raw = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.col(c).cast("double").alias(n) for c, n in (("l_quantity", "a"), ("l_extendedprice", "b"), ("l_discount", "c"), ("l_tax", "e"))])
    return raw.select("l_orderkey", "l_linenumber", F.get(scales.ordered("a", "b", "c", "e"), F.lit(0)).alias("low"), F.get(scales.ordered("a", "b", "c", "e"), F.lit(3)).alias("high"))


@query("SELECT o_orderkey, o_orderpriority, CASE split_part(o_orderpriority, '-', 1) WHEN '1' THEN 'high' WHEN '2' THEN 'high' ELSE 'low' END AS label FROM orders")
def label_lookup(spark, d):
    from tierloom.operators.workflow import translate

    symbols = spark.createDataFrame([("1", "high"), ("2", "high"), ("3", "low"), ("4", "low"), ("5", "low")], "symbol string, label string")
    rows = read(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("symbol"))
    return translate(rows, symbols, "symbol", "label").drop("symbol")


@query("SELECT c_custkey AS key, c_name AS name, NULL::VARCHAR AS phone FROM customer UNION ALL SELECT s_suppkey, s_name, '' FROM supplier")
def union_files(spark, d):
    a = read(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    b = read(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.lit("").alias("phone"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('click', 'view')")
def filter_labels(spark, d):
    return read(spark, d, "events").where(F.col("event_type").isin("click", "view")).select("event_id", "user_id", "event_type")


@query("SELECT event_id, value FROM events WHERE value >= 20 AND value <= 40")
def filter_range(spark, d):
    return read(spark, d, "events").where(F.col("value").between(20, 40)).select("event_id", "value")


@query("SELECT conv_id, turn FROM conversations WHERE text <> ''")
def filter_nonempty(spark, d):
    return read(spark, d, "conversations").where("text <> ''").select("conv_id", "turn")


@query(f"SELECT user_id, t1 + {HOUR} AS mid, t1 + 5 AS t1, t2 + 5 AS t2 FROM {SPANS}")
def midpoint_offset(spark, d):
    return spans(spark, d).select("user_id", F.expr("(t1 + t2) div 2").alias("mid"), (F.col("t1") + 5).alias("t1"), (F.col("t2") + 5).alias("t2"))


@query("SELECT page_id, try_cast(regexp_extract(url, '/([0-9]+)', 1) AS DOUBLE) AS number, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages")
def capture_cast(spark, d):
    return read(spark, d, "pages").select("page_id", F.expr(r"try_cast(regexp_extract(url, '/([0-9]+)', 1) AS DOUBLE)").alias("number"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))


@query("SELECT doc_id, concat_ws('/', source, lang, doc_id::VARCHAR) AS path, replace(lang, '\"', '\"\"') AS quoted FROM documents")
def path_quote(spark, d):
    return read(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.replace("lang", F.lit('"'), F.lit('""')).alias("quoted"))


@query("SELECT o_orderkey AS token, CASE WHEN o_orderstatus = 'F' THEN 'female' ELSE 'male' END AS speaker_sex, o_totalprice::DOUBLE AS price FROM orders")
def rename_convert(spark, d):
    """Chosen columns of a table under other names, one of them converted as it is read."""
    sex = F.when(F.col("o_orderstatus") == "F", "female").otherwise("male")
    rows = read(spark, d, "orders").select("o_orderkey", sex.alias("speaker_sex"), F.col("o_totalprice").cast("double").alias("price"))
    return rows.withColumnRenamed("o_orderkey", "token")


@query(f"SELECT user_id, t1, t2, event_type FROM {SPANS} ORDER BY user_id, t1, t2")
def sort_rows(spark, d):
    """Rows in order of recording and time: one range-partitioned sort, for a sink that keeps the order."""
    return spans(spark, d).orderBy("user_id", "t1", "t2")


@query(f"SELECT event_id, t, event_type FROM {EVENTS} ORDER BY t, event_id LIMIT 5")
def first_rows(spark, d):
    """The first rows of a table in order, by a top-n in each task: no full sort."""
    return events(spark, d).select("event_id", "t", "event_type").orderBy("t", "event_id").limit(5)


@query("SELECT DISTINCT source, lang FROM documents")
def distinct_paths(spark, d):
    return read(spark, d, "documents").select("source", "lang").distinct()


@query("SELECT DISTINCT role AS speaker FROM conversations EXCEPT SELECT 'user'")
def speaker_difference(spark, d):
    return read(spark, d, "conversations").select(F.col("role").alias("speaker")).distinct().exceptAll(spark.createDataFrame([("user",)], "speaker string"))


@query("SELECT count(*) AS n_rows, count(*) - count(quality) AS missing FROM documents LEFT JOIN labels USING (doc_id)")
def completeness(spark, d):
    joined = read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return joined.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("quality").isNull()).alias("missing"))


@query("SELECT o_orderkey, printf('%.4f', o_totalprice::DOUBLE) AS price FROM orders")
def number_format(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.format_string("%.4f", F.col("o_totalprice").cast("double")).alias("price"))


@query(f"""SELECT user_id, string_agg(printf('%.4f', t1 / 1e6) || chr(10) || printf('%.4f', t2 / 1e6) || chr(10) || '"' || replace(event_type, '"', '""') || '"', chr(10) ORDER BY t1, t2) AS block FROM {SPANS} GROUP BY user_id""")
def textgrid_block(spark, d):
    from tierloom.sources.textgrid import tier_blocks

    rows = spans(spark, d).select("user_id", (F.col("t1") / 1e6).alias("t1"), (F.col("t2") / 1e6).alias("t2"), F.col("event_type").alias("label"))
    return tier_blocks(rows, ["user_id"], fmt="%.4f")


@query("SELECT conv_id, turn, turn * 2.0::DOUBLE AS t1, turn * 2.0::DOUBLE + 1.5 AS t2, role AS text FROM conversations")
def subtitle_parse(spark, d):
    from tierloom.sources.srt import parse_blocks

    stamp = lambda ms: F.format_string("%02d:%02d:%02d,%03d", (ms / 3600000).cast("int"), (ms / 60000).cast("int") % 60, (ms / 1000).cast("int") % 60, (ms % 1000).cast("int"))
    rows = read(spark, d, "conversations").select("conv_id", "turn", "role", (F.col("turn") * 2000).alias("ms"))
    block = F.concat_ws("\n", (F.col("turn") + 1).cast("string"), F.concat(stamp(F.col("ms")), F.lit(" --> "), stamp(F.col("ms") + 1500)), "role")
    return parse_blocks(rows.select("conv_id", "turn", block.alias("block")), "block").select("conv_id", "turn", "t1", "t2", "text")


@query(f"SELECT vec_id, count(*) AS n, {SQL_R.format('(list(y ORDER BY i))[4]')} AS fourth, {SQL_R.format('(list(y ORDER BY i))[1]')} AS first FROM {WAVE} GROUP BY vec_id")
def reshape_wide(spark, d):
    rows = wave(spark, d).groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("i", "y"))).alias("a"))
    y = F.transform("a", lambda x: x["y"])
    return rows.select("vec_id", F.size("a").cast("long").alias("n"), r4(F.get(y, F.lit(3))).alias("fourth"), r4(F.get(y, F.lit(0))).alias("first"))


FRAMES = f"(SELECT user_id, t AS sec, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS frame FROM {EVENTS} WHERE event_type = 'click')"


@query(f"""WITH p AS (SELECT user_id, event_id, s, t + s * {HOUR} AS x FROM {EVENTS}, range(2) z(s) WHERE event_type = 'view'),
b AS (SELECT p.*, f.sec AS t0, f.frame AS f0 FROM p ASOF LEFT JOIN {FRAMES} f ON p.user_id = f.user_id AND p.x >= f.sec),
c AS (SELECT b.*, f.sec AS t1, f.frame AS f1 FROM b ASOF LEFT JOIN {FRAMES} f ON b.user_id = f.user_id AND b.x <= f.sec),
n AS (SELECT event_id, s, CASE WHEN t0 IS NULL OR t1 - x <= x - t0 THEN f1 ELSE f0 END AS frame FROM c)
SELECT event_id, max(CASE WHEN s = 0 THEN frame END) AS first, max(CASE WHEN s = 1 THEN frame END) AS later FROM n GROUP BY event_id""")
def match_frames(spark, d):
    """The numbers of the frames nearest to two times of each view, one and two arrays deep."""
    at = views(spark, d).withColumn("at", F.array(F.array("view_t"), F.array(F.col("view_t") + HOUR)))
    track = clicks(spark, d).select("user_id", F.col("t").alias("sec"))
    out = asof.match_frames(at, track, ["user_id"], "at", "sec", width=24.0 * HOUR)
    return out.select(F.col("view_id").alias("event_id"), F.col("frame")[0][0].cast("long").alias("first"), F.col("frame")[1][0].cast("long").alias("later"))


@query()
def sample_per_class(spark, d):
    return series.sample_per_class(read(spark, d, "events").select("event_id", "event_type", "value"), "event_type", 20, seed=1, id_cols=["event_id"])


@query()
def sample_with_replacement(spark, d):
    return series.sample_per_class(read(spark, d, "events").select("event_id", "event_type", "value"), "event_type", 20, True, 1, ["event_id"])


def _register() -> None:
    from tierloom.plans import kernel_catalogue, signal_catalogue, source_catalogue  # noqa: F401  their queries are registered as they are imported


def queries() -> dict[str, Query]:
    _register()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _register()
    return dict(_SQL)
