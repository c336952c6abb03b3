"""Queries whose kernels SQL can spell out: Fourier sums, filter banks, oscillators and linear smoothers over `embeddings` as signals.

Arrays are given as a few of their values and sums over all of them, so that both engines can be compared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierloom.dsp.hearing import LOUDNESS, LOUDNESS_DOMAIN
from tierloom.dsp.spectra import slepian
from tierloom.functions import arrays, scales
from tierloom.plans.catalogue import SQL_R, query, r4, read
from tierloom.plans.signal_catalogue import KEYS, samplewise, signals, times
from tierloom.signal import measures, samplers


def y(n: int) -> str:
    """Signals of n samples: those of `embeddings`, repeated."""
    return f"(SELECT vec_id, list_transform(range({n}), lambda i: embedding[i % 64 + 1]::DOUBLE) AS y FROM embeddings)"


def turns(n: int, size: int, bins: str, window: str) -> str:
    """Cosines and sines of the bins of a transform of `size` points for frames of n samples, times the window (of i)."""
    values = lambda f: f"list_transform(range({n}), lambda i: ({window}) * {f}(2 * pi() * b * i / {size}))"
    return f"(SELECT b, {values('cos')} AS c, {values('sin')} AS s FROM {bins})"


HAMMING = "0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * i / {})"
HARRIS = "0.35875::DOUBLE - 0.48829::DOUBLE * cos(2 * pi() * i / 63) + 0.14128::DOUBLE * cos(4 * pi() * i / 63) - 0.01168::DOUBLE * cos(6 * pi() * i / 63)"
SIZE = "sqrt(list_inner_product(f, c) ** 2 + list_inner_product(f, s) ** 2)"


def picked(df: DataFrame, col: str, places: tuple[int, ...], *others: str) -> DataFrame:
    """The array's values at some places, its mean and its largest value, rounded."""
    values = [r4(F.get(col, F.lit(p))).alias(f"m{p}") for p in places]
    return df.select(*others, *values, r4(arrays.mean(col)).alias("mean"), r4(F.array_max(col)).alias("top"))


# frames of 800 samples at 48 kHz, lags of 120 to 799
PITCH = f"""WITH f AS (SELECT vec_id, k, list_slice(y, k * 240 + 1, k * 240 + 800) AS f FROM {y(1280)}, range(3) z(k)),
l AS (SELECT vec_id, k, lag, list_inner_product(list_slice(f, 1, 800 - lag), list_slice(f, lag + 1, 800)) AS ac FROM f, range(120, 800) q(lag)),
m AS (SELECT vec_id, k, arg_max(lag, ac) AS lag, max(ac) AS ac FROM l GROUP BY ALL),
e AS (SELECT vec_id, k, list_inner_product(f, f) AS e FROM f),
r AS (SELECT vec_id, k, lag, sqrt(greatest(ac / e, 0)) AS c, 20 * log10(greatest(sqrt(e / 800), 1e-12) / max(sqrt(e / 800)) OVER (PARTITION BY vec_id)) AS db FROM m JOIN e USING (vec_id, k)),
p AS (SELECT *, 1 / (1 + exp(-(-4.2::DOUBLE + 0.17::DOUBLE * db + 13.2::DOUBLE * c))) AS p FROM r)"""


@query(f"""{PITCH}
SELECT vec_id, (k * 240 + 400) / 48000::DOUBLE AS sec, {SQL_R.format('48000::DOUBLE / lag')} AS f0, {SQL_R.format('db')} AS rms, {SQL_R.format('c')} AS c, {SQL_R.format('p')} AS probv, p > 0.5 AS voiced FROM p""")
def get_f0_cor(spark, d):
    out = measures.get_f0_cor(signals(spark, d, 48000.0, 20), KEYS)
    return out.select("vec_id", "sec", *[r4(c).alias(c) for c in ("f0", "rms", "c", "probv")], "voiced")


@query(f"""{PITCH}
SELECT vec_id, t, {SQL_R.format('12 * ln(48000::DOUBLE / lag / 100) / ln(2)')} AS f0 FROM p JOIN (VALUES (0.01::DOUBLE, 0), (0.015::DOUBLE, 1)) z(t, k) USING (k) WHERE p > 0.5""")
def pitch_at_times(spark, d):
    out = samplers.pitch_to_df(signals(spark, d, 48000.0, 20), KEYS, times(spark, d, 0.01, 0.015), "t", "SEMITONES_100", "NEAREST", measures.get_f0_cor)
    return out.select("vec_id", "t", r4("f0").alias("f0"))


SGRAM_BINS = (0, 8, 32, 64, 128)
LEVELS = """f AS (SELECT vec_id, k, list_slice(x, k * 8 + 1, k * 8 + 64) AS r FROM x, range({frames}) z(k)),
l AS (SELECT vec_id, k, r, list_avg(r) AS mean, list_inner_product(r, list_transform(range(64), lambda i: i - 31.5::DOUBLE)) / 21840 AS slope FROM f),
g AS (SELECT vec_id, k, list_transform(r, lambda v, i: v - mean - slope * (i - 32.5::DOUBLE)) AS f FROM l),
w AS (SELECT sum({window}) AS total FROM range(64) z(i)),
a AS (SELECT vec_id, k, b, 20 * log10({size} / total + 1) AS m FROM g, w, {turns})"""


def levels(frames: int, size: int, bins: str) -> str:
    return LEVELS.format(frames=frames, window=HARRIS, size=SIZE, turns=turns(64, size, bins, HARRIS))


@query(f"""WITH x AS (SELECT vec_id, list_transform(y, lambda v: round_even(v / list_max(y) * 32000, 0)) AS x FROM {y(256)}),
{levels(25, 256, 'range(129) q(b)')}
SELECT vec_id, k AS frame, (k * 8 + 32) / 8000::DOUBLE AS sec, {', '.join(SQL_R.format(f'max(CASE WHEN b = {b} THEN m END)') + f' AS m{b}' for b in SGRAM_BINS)},
{SQL_R.format('avg(m)')} AS mean, {SQL_R.format('max(m)')} AS top FROM a GROUP BY vec_id, k""")
def compute_sgram(spark, d):
    out = measures.compute_sgram(signals(spark, d, 8000.0, 4), KEYS, nfft=256)
    return picked(out.withColumn("frame", F.col("frame").cast("long")), "mag", SGRAM_BINS, "vec_id", "frame", "sec")


SLICE_BINS = (0, 1024, 2048, 4096)


@query(f"""WITH s AS (SELECT vec_id, CASE WHEN list_max(y) + list_min(y) < 0 THEN list_transform(y, lambda v: -v) ELSE y END AS y FROM {y(256)}),
e AS (SELECT vec_id, list_transform(y, lambda v, i: CASE WHEN i = 1 THEN v ELSE v - 0.94::DOUBLE * y[i - 1] END) AS z FROM s),
p AS (SELECT vec_id, list_transform(z, lambda v: v / list_max(z) * 0.99::DOUBLE) AS z FROM e),
x AS (SELECT vec_id, list_slice(list_transform(z, lambda v: round_even(v / list_max(z) * 32000, 0)), 97, 160) AS x FROM p),
{levels(1, 8192, '(VALUES ' + ', '.join(f'({b})' for b in SLICE_BINS) + ') q(b)')}
SELECT vec_id, 12 AS frame, 0.016::DOUBLE AS sec, {', '.join(SQL_R.format(f'max(CASE WHEN b = {b} THEN m END)') + f' AS m{b}' for b in SLICE_BINS)} FROM a GROUP BY vec_id""")
def sgram_slice(spark, d):
    out = measures.sgram(signals(spark, d, 8000.0, 4), KEYS, tf=4000, slice_time=0.016)
    return picked(out, "mag", SLICE_BINS, "vec_id", "frame", "sec").drop("mean", "top")


def tapers(n: int) -> str:
    """The multitaper windows of n samples and their shares, as rows; tests check them against the eigenvectors that define them."""
    windows, shares = slepian(n)
    return "(VALUES " + ", ".join(f"({float(w)!r}::DOUBLE, [{', '.join(f'{float(v)!r}::DOUBLE' for v in t)}])" for t, w in zip(windows, shares)) + ") q(share, taper)"


# 64 samples at 3200 Hz around 0.02 s: bins of 50 Hz, moments over those from 300 Hz on
@query(f"""WITH f AS (SELECT vec_id, list_transform(list_slice(y, 33, 96), lambda v: v - m) AS f FROM (SELECT vec_id, y, list_avg(list_slice(y, 33, 96)) AS m FROM {y(128)})),
t AS (SELECT vec_id, share, list_transform(f, lambda v, i: v * taper[i]) AS f FROM f, {tapers(64)}),
p AS (SELECT vec_id, b, 10 * log10(greatest(sum(share * ({SIZE}) ** 2) / sum(share) * (CASE WHEN b BETWEEN 1 AND 31 THEN 2 ELSE 1 END), 1e-20)) AS p FROM t, {turns(64, 64, 'range(6, 33) q(b)', '1')} GROUP BY vec_id, b),
w AS (SELECT vec_id, b * 50::DOUBLE AS hz, p, p - min(p) OVER o AS w FROM p WINDOW o AS (PARTITION BY vec_id)),
g AS (SELECT *, w / sum(w) OVER o AS share, sum(w * hz) OVER o / sum(w) OVER o AS g FROM w WINDOW o AS (PARTITION BY vec_id)),
m AS (SELECT vec_id, any_value(g) AS g, sum(share * (hz - g) ** 2) AS m2, sum(share * (hz - g) ** 3) AS m3, sum(share * (hz - g) ** 4) AS m4 FROM g GROUP BY vec_id)
SELECT vec_id, 0.02::DOUBLE AS t, {SQL_R.format('g')} AS cog, {SQL_R.format('sqrt(m2)')} AS sd, {SQL_R.format('m3 / m2 ** 1.5')} AS skew, {SQL_R.format('m4 / (m2 * m2) - 3')} AS kurtosis FROM m""")
def fricative_moments(spark, d):
    out = measures.fricative(signals(spark, d, 3200.0, 2).withColumn("t", F.lit(0.02)), KEYS, "t")
    return out.select("vec_id", "t", *[r4(c).alias(c.lower()) for c in ("COG", "SD", "Skew", "Kurtosis")])


PHASE = "(m / 96::DOUBLE - n / 64::DOUBLE)"
KERNEL = f"(1 + 2 * list_sum(list_transform(range(1, 32), lambda k: cos(2 * pi() * k * {PHASE}))) + cos(64 * pi() * {PHASE})) / 64"


@query(f"""WITH k AS (SELECT m, list(w ORDER BY n) AS w FROM (SELECT m, n, {KERNEL} AS w FROM range(96) a(m), range(64) b(n)) GROUP BY m),
r AS (SELECT vec_id, m AS i, list_inner_product(y, w) AS v FROM {y(64)}, k),
s AS (SELECT vec_id, i, CASE WHEN max(v) OVER p + min(v) OVER p < 0 THEN -v ELSE v END AS v FROM r WINDOW p AS (PARTITION BY vec_id))
SELECT vec_id, i, {SQL_R.format('v / max(v) OVER (PARTITION BY vec_id) * 0.99::DOUBLE')} AS v FROM s""")
def prep_audio_resampled(spark, d):
    return samplewise(measures.prep_audio(signals(spark, d), KEYS, 960))


COSINES = "list_sum(list_transform(range(64), lambda k: (CASE WHEN k = 0 THEN 1 ELSE 2 END) / 64::DOUBLE / (1 + 10 * (2 - 2 * cos(pi() * k / 64)) ** 2) * cos(pi() * k * (m + 0.5::DOUBLE) / 64) * cos(pi() * k * (n + 0.5::DOUBLE) / 64)))"


@query(f"""WITH k AS (SELECT m, list(w ORDER BY n) AS w FROM (SELECT m, n, {COSINES} AS w FROM range(64) a(m), range(64) b(n)) GROUP BY m)
SELECT vec_id, m AS i, {SQL_R.format('list_inner_product(y, w)')} AS v FROM {y(64)}, k""")
def smoothn(spark, d):
    return samplewise(measures.smoothn(signals(spark, d), KEYS, 10.0))


@query(f"""WITH t AS (SELECT vec_id, i, i // 40 AS k, (i % 40) / 40::DOUBLE AS q, embedding AS e, list_min(embedding)::DOUBLE AS low, list_max(embedding)::DOUBLE AS high FROM embeddings, range(2520) z(i)),
v AS (SELECT vec_id, i, x, (x - low) / (high - low) AS a FROM (SELECT *, e[k + 1]::DOUBLE + (e[k + 2]::DOUBLE - e[k + 1]::DOUBLE) * q AS x FROM t)),
p AS (SELECT vec_id, i, a, f, 2 * pi() * sum(500 * f + 10 * x) OVER (PARTITION BY vec_id, f ORDER BY i) / 4000 AS phase FROM v, range(1, 5) z(f)),
s AS (SELECT vec_id, i, sum(a * sin(phase)) * least(i / 79::DOUBLE, (2519 - i) / 79::DOUBLE, 1) AS v FROM p GROUP BY vec_id, i, a),
n AS (SELECT vec_id, i, v / max(abs(v)) OVER (PARTITION BY vec_id) AS v FROM s)
SELECT vec_id, count(*) AS n, {SQL_R.format('sum(v * v)')} AS energy, {SQL_R.format('sum(v * i) / 2520')} AS moment, {SQL_R.format('max(v)')} AS top, {SQL_R.format('min(v)')} AS bottom FROM n GROUP BY vec_id""")
def sine_synth(spark, d):
    tracks = read(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "x"))
    cols = {"sec": F.col("k") / 100.0, "rms": F.col("x").cast("double"), **{f"F{k}": 500.0 * k + F.col("x").cast("double") * 10 for k in range(1, 5)}}
    out = measures.sine_synth(tracks.withColumns(cols), KEYS, 4000)
    return out.select("vec_id", F.size("y").cast("long").alias("n"), *[r4(c).alias(n) for n, c in sums(F.col("y")).items()])


def sums(z: Column) -> dict[str, Column]:
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return {"energy": total(F.transform(z, lambda x: x * x)), "moment": total(F.transform(z, lambda x, i: x * i)) / F.size(z), "top": F.array_max(z), "bottom": F.array_min(z)}


MEL = "CASE WHEN {0} < 1000 THEN {0} * 3 / 200 ELSE 15 + ln({0} / 1000) / (ln(6.4::DOUBLE) / 27) END"
HERTZ = "CASE WHEN {0} < 15 THEN {0} * 200 / 3 ELSE 1000 * exp((ln(6.4::DOUBLE) / 27) * ({0} - 15)) END"
NEAR_FRAMES = "(VALUES (0.03::DOUBLE, 2), (0.06::DOUBLE, 5)) z(t, k)"


@query(f"""WITH p AS (SELECT vec_id, t, b, list_inner_product(f, c) ** 2 + list_inner_product(f, s) ** 2 AS p FROM (SELECT vec_id, t, list_slice(y, k * 32 + 1, k * 32 + 80) AS f FROM {y(256)}, {NEAR_FRAMES}), {turns(80, 128, 'range(65) q(b)', HAMMING.format(79))}),
m AS (SELECT j, {HERTZ.format('(j * top / 27)')} AS hz FROM (SELECT j, {MEL.format('1600::DOUBLE')} AS top FROM range(28) q(j))),
e AS (SELECT a.j, a.hz AS low, b.hz AS mid, c.hz AS high FROM m a JOIN m b ON b.j = a.j + 1 JOIN m c ON c.j = a.j + 2),
w AS (SELECT j, b, greatest(0, least((b * 25 - low) / (mid - low), (high - b * 25) / (high - mid))) * 2 / (high - low) AS w FROM e, range(65) q(b)),
l AS (SELECT vec_id, t, j, ln(sum(p * w) + 1e-10) AS v FROM p JOIN w USING (b) GROUP BY ALL),
c AS (SELECT vec_id, t, k, sum(v * cos(k * (j + 0.5::DOUBLE) * pi() / 26)) * sqrt((CASE WHEN k = 0 THEN 1 ELSE 2 END) / 26::DOUBLE) AS c FROM l, range(13) q(k) GROUP BY vec_id, t, k)
SELECT vec_id, t, {', '.join(SQL_R.format(f'max(CASE WHEN k = {k} THEN c END)') + f' AS c{k}' for k in range(13))} FROM c GROUP BY vec_id, t""")
def mfcc_at_times(spark, d):
    out = samplers.mfcc_to_df(signals(spark, d, 3200.0, 4), KEYS, 12, times(spark, d, 0.03, 0.06), "t")
    return out.select("vec_id", "t", *[r4(f"c{k}").alias(f"c{k}") for k in range(13)])


def loudness_sql(hz: str) -> str:
    x = f"(2 * ({hz} - {LOUDNESS_DOMAIN[0]}) / ({LOUDNESS_DOMAIN[1] - LOUDNESS_DOMAIN[0]})::DOUBLE - 1)"
    return "(" + " + ".join(f"{c}::DOUBLE * {x} ** {k}" for k, c in enumerate(LOUDNESS)) + ")"


@query(f"SELECT b AS bin, {SQL_R.format(loudness_sql('b * 31.25::DOUBLE'))} AS db FROM range(1, 258) z(b)")
def loudness_curve(spark, d):
    return spark.range(1, 258).select(F.col("id").alias("bin"), r4(scales.loudness_db(F.col("id") * 31.25)).alias("db"))


# critical bands of 512 points at 16 kHz: bins of 31.25 Hz, the first of 257 bins at 31.25 Hz; 78 bands
ZGRAM = f"""ld AS (SELECT b, 10 ** (-{loudness_sql('(b + 1) * 31.25::DOUBLE')} / 10) AS loud FROM range(257) z(b)),
x AS (SELECT vec_id, list_concat(list_resize([]::DOUBLE[], 256, 0), list_transform(y, lambda v: v * sign * 32768), list_resize([]::DOUBLE[], 256, 0)) AS x FROM (SELECT *, CASE WHEN list_max(y) + list_min(y) < 0 THEN -1 ELSE 1 END AS sign FROM {y(2048)})),
p AS (SELECT vec_id, k, b, 2 / 512::DOUBLE * {SIZE} + loud AS p FROM (SELECT vec_id, k, list_slice(x, k * 480 + 1, k * 480 + 512) AS f FROM x, range(5) z(k)), {turns(512, 512, 'range(257) q(b)', HAMMING.format(511))} JOIN ld USING (b)),
h AS (SELECT j, 650 * sinh((j + 1) * top / 79 / 7) AS hz FROM (SELECT j, 7 * asinh(8000 / 650::DOUBLE) AS top FROM range(78) z(j))),
g AS (SELECT j, hz, r, sqrt(exp(-pi() * (r * 31.25::DOUBLE / 10 ** ((8.3::DOUBLE * log10(hz) - 2.3::DOUBLE) / 10)) ** 2)) AS g FROM h, range(100) z(r) WHERE r * 31.25::DOUBLE < hz / 5),
n AS (SELECT j, r, floor(hz / 31.25::DOUBLE)::INT AS centre, g / sum(CASE WHEN r = 0 THEN g ELSE 2 * g END) OVER (PARTITION BY j) AS g FROM g),
w AS (SELECT j, centre + r AS b, g FROM n WHERE centre + r < 256 UNION ALL SELECT j, centre - r, g FROM n WHERE centre - r >= 1 AND r > 0),
zg AS (SELECT vec_id, k, j, 20 * log10(sum(p * g) + 1) AS z FROM p JOIN w USING (b) GROUP BY ALL)"""
BANDS = (0, 10, 40, 77)


def bands_sql(gram: str) -> str:
    values = ", ".join(SQL_R.format(f"max(CASE WHEN j = {b} THEN z END)") + f" AS m{b}" for b in BANDS)
    return f"SELECT vec_id, k AS frame, k * 480 / 16000::DOUBLE AS sec, {values}, {SQL_R.format('avg(z)')} AS mean, {SQL_R.format('max(z)')} AS top FROM {gram} GROUP BY vec_id, k"


def auditory(spark, d, kind: str) -> DataFrame:
    out = measures.auditory(signals(spark, d, 16000.0, 32), KEYS, kind)
    return picked(out.withColumn("frame", F.col("frame").cast("long")), "mag", BANDS, "vec_id", "frame", "sec")


@query(f"WITH {ZGRAM} {bands_sql('zg')}")
def audspec_zgram(spark, d):
    return auditory(spark, d, "zgram")


@query(f"""WITH {ZGRAM}, c AS (SELECT vec_id, k, j, CASE WHEN k = 0 THEN lead(z) OVER o - z WHEN k = 4 THEN z - lag(z) OVER o ELSE (lead(z) OVER o - lag(z) OVER o) / 2 END AS g FROM zg WINDOW o AS (PARTITION BY vec_id, j ORDER BY k)),
t AS (SELECT vec_id, k, j, (g - avg(g) OVER o) / greatest(stddev_pop(g) OVER o, 1e-12) AS z FROM c WINDOW o AS (PARTITION BY vec_id, j)) {bands_sql('t')}""")
def audspec_tgram(spark, d):
    return auditory(spark, d, "tgram")


SPACING = "(7 * asinh(8000 / 650::DOUBLE) / 79)"
EVERY_BAND = "SELECT a.vec_id, a.k, a.j, greatest(sum(b.z * v), 0) AS z FROM zg a JOIN (SELECT j AS j0, greatest(least(j + q, 77), 0) AS j1, v FROM range(78) y(j), k) c ON a.j = c.j0 JOIN zg b ON a.vec_id = b.vec_id AND a.k = b.k AND b.j = c.j1 GROUP BY ALL"


def blurred(weights: str) -> str:
    """Each frame convolved with the weights (q, v) about 0, with repeated edges, negative values as 0, scaled to 0..1 over the recording."""
    return f"k AS ({weights}), v AS ({EVERY_BAND}), s AS (SELECT vec_id, k, j, (z - min(z) OVER o) / greatest(max(z) OVER o - min(z) OVER o, 1e-12) AS z FROM v WINDOW o AS (PARTITION BY vec_id))"


@query(f"""WITH {ZGRAM}, {blurred(f"SELECT q, exp(-q * q / 4.5::DOUBLE) / sum(exp(-q * q / 4.5::DOUBLE)) OVER () AS v FROM (SELECT unnest(range(-n, n + 1)) AS q FROM (SELECT (floor(3 / {SPACING})::INT | 1) // 2 AS n))")} {bands_sql('s')}""")
def audspec_blurgram(spark, d):
    return auditory(spark, d, "blurgram")


@query(f"""WITH {ZGRAM}, {blurred(f"SELECT q, (CASE WHEN q = 0 THEN n ELSE -1 END)::DOUBLE / (n - (n - 1)) AS v FROM (SELECT n, unnest(range(-(n // 2), n // 2 + 1)) AS q FROM (SELECT floor(6 / {SPACING})::INT | 1 AS n))")} {bands_sql('s')}""")
def audspec_sharpgram(spark, d):
    return auditory(spark, d, "sharpgram")


MIXED = {"square": "CASE WHEN phase < 0.5 THEN 1 ELSE -1 END", "triangle": "1 - 4 * abs(phase - 0.5)", "sawtooth": "2 * phase - 1", "trapezium": "CASE WHEN phase < 0.1 THEN phase * 20 - 1 WHEN phase < 0.5 THEN 1 WHEN phase < 0.6 THEN 1 - (phase - 0.5) * 20 ELSE -1 END"}


@query(f"""WITH w AS ({" UNION ALL ".join(f"SELECT '{k}' AS kind, i, ({x})::DOUBLE AS w FROM (SELECT i, (i * 40 % 640) / 640::DOUBLE AS phase FROM range(64) z(i))" for k, x in MIXED.items())}),
n AS (SELECT kind, i, w / max(abs(w)) OVER (PARTITION BY kind) * 10 ** (-0.3::DOUBLE) AS w FROM w),
m AS (SELECT vec_id, kind, i, y / max(abs(y)) OVER (PARTITION BY vec_id, kind) + w AS v FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS y FROM embeddings) JOIN n USING (i))
SELECT vec_id, kind, i, {SQL_R.format("v / max(abs(v)) OVER (PARTITION BY vec_id, kind) * 10 ** (-0.05::DOUBLE)")} AS v FROM m""")
def noise_waves(spark, d):
    """Signals mixed with periodic waves at -6 dB, at a peak of -1 dB."""
    rows = [samplewise(measures.add_noise_and_norm(signals(spark, d), KEYS, kind, -6, -1, hz=40)).withColumn("kind", F.lit(kind)) for kind in MIXED]
    return reduce(DataFrame.unionByName, rows)
