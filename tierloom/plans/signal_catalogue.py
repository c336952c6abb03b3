"""Named queries of the signal operators. `embeddings` stand in for recordings: 64 samples each, repeated where a kernel needs more."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierloom.functions import arrays
from tierloom.plans.catalogue import SQL_R, WAVE, query, r4, read
from tierloom.signal import measures, samplers

KEYS = ["vec_id"]
#: Nominal rate, at which 64 samples are a tenth of a second.
FS = 640.0


def signals(spark, d, fs: float = FS, times: int = 1) -> DataFrame:
    y = F.transform("embedding", lambda x: x.cast("double"))
    return read(spark, d, "embeddings").select("vec_id", F.lit(fs).alias("fs"), (F.flatten(F.array_repeat(y, times)) if times > 1 else y).alias("y"))


def times(spark, d, *at: float) -> DataFrame:
    return read(spark, d, "embeddings").select("vec_id", F.explode(F.array(*map(F.lit, at))).alias("t"))


def samplewise(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.posexplode("y").alias("i", "v")).select("vec_id", F.col("i").cast("long").alias("i"), r4(F.col("v").cast("double")).alias("v"))


@query()
def track_formants_lpc(spark, d):
    return measures.track_formants(signals(spark, d), KEYS)


@query()
def track_formants_ifc(spark, d):
    return measures.track_formants(signals(spark, d), KEYS, "ifc", 0.94)


@query()
def track_formants_ifc_fast(spark, d):
    return measures.track_formants(signals(spark, d), KEYS, "ifc_fast", 0.94)


@query()
def get_f0(spark, d):
    return measures.get_f0(signals(spark, d), KEYS)


@query()
def get_f0_srh(spark, d):
    return measures.get_f0_srh(signals(spark, d, times=2), KEYS)


@query()
def get_f0_acd(spark, d):
    return measures.get_f0_acd(signals(spark, d), KEYS)


@query()
def fricative(spark, d):
    return measures.fricative(signals(spark, d, 3200.0, 2).withColumn("t", F.lit(0.02)), KEYS, "t")


@query()
def burst(spark, d):
    rows = signals(spark, d, 3200.0, 4).withColumns({"start": F.lit(0.0), "end": F.lit(0.08)})
    return measures.burst(rows, KEYS, "start", "end")


@query()
def amplitude_envelope(spark, d):
    return samplewise(measures.amplitude_envelope(signals(spark, d), KEYS, target_fs=FS))


@query()
def get_rhythm_spectrum(spark, d):
    return measures.get_rhythm_spectrum(signals(spark, d, times=40), KEYS)


@query()
def rhythmogram(spark, d):
    return measures.rhythmogram(signals(spark, d, times=50), KEYS)


@query()
def egg_to_oq(spark, d):
    return measures.egg_to_oq(signals(spark, d, 3200.0, 8), KEYS)


LEVEL = "20 * log10(greatest(sqrt(list_avg(list_transform(list_slice(embedding, k * 6 + 1, k * 6 + 12)::DOUBLE[], lambda x: x * x))), 1e-12::DOUBLE) / 2e-5::DOUBLE)"


@query(f"SELECT vec_id, (k * 6 + 6) / 640::DOUBLE AS t1, {SQL_R.format(LEVEL)} AS intensity FROM embeddings, range(9) z(k)")
def intensity_frames(spark, d):
    return samplers.intensity_to_df(signals(spark, d), KEYS).withColumn("intensity", r4("intensity"))


@query(f"""WITH f AS (SELECT vec_id, k, {LEVEL} AS v FROM embeddings, range(9) z(k))
SELECT a.vec_id, t, {SQL_R.format("a.v + (b.v - a.v) * (t * 640 / 6 - 1 - a.k)")} AS intensity FROM (VALUES (0.02::DOUBLE), (0.05::DOUBLE)) z(t), f a, f b
WHERE a.vec_id = b.vec_id AND a.k = floor(t * 640 / 6 - 1) AND b.k = a.k + 1""")
def intensity_at_times(spark, d):
    return samplers.intensity_to_df(signals(spark, d), KEYS, times(spark, d, 0.02, 0.05), "t", "LINEAR").withColumn("intensity", r4("intensity"))


@query()
def formant_at_times(spark, d):
    return samplers.formant_to_df(signals(spark, d), KEYS, 3, times(spark, d, 0.03, 0.07), "t", "BARK", include_bw=True)


POLAR = f"(SELECT vec_id, i, CASE WHEN hi + lo < 0 THEN -y ELSE y END AS y FROM (SELECT *, max(y) OVER w AS hi, min(y) OVER w AS lo FROM {WAVE} WINDOW w AS (PARTITION BY vec_id)))"


@query(f"SELECT vec_id, i, {SQL_R.format('round_even(32767 * (y / max(y) OVER (PARTITION BY vec_id) * 0.99::DOUBLE), 0)')} AS v FROM {POLAR}")
def prep_audio_int16(spark, d):
    return samplewise(measures.prep_audio(signals(spark, d), KEYS, None, outtype="int16"))


@query(f"SELECT vec_id, {SQL_R.format('sqrt(sum(y * y) / 2048)')} AS peak_rms FROM {WAVE} GROUP BY vec_id")
def peak_rms(spark, d):
    return measures.peak_rms(signals(spark, d), KEYS).withColumn("peak_rms", r4("peak_rms"))


@query(f"SELECT vec_id, i, {SQL_R.format('CASE WHEN i BETWEEN 16 AND 31 THEN -y ELSE y END')} AS v FROM {WAVE}")
def sigcor_noise_all(spark, d):
    return samplewise(measures.sigcor_noise(signals(spark, d), KEYS, 1.0, 0.025, 0.05))


@query()
def sigcor_noise(spark, d):
    return samplewise(measures.sigcor_noise(signals(spark, d), KEYS))


@query()
def add_noise(spark, d):
    return measures.add_noise(signals(spark, d), KEYS, "pink", 10)


@query()
def vocode(spark, d):
    return measures.vocode(signals(spark, d), KEYS, [(40, 80), (80, 160)])


@query()
def apply_filterbank(spark, d):
    return measures.apply_filterbank(signals(spark, d), KEYS, [(40, 80), (80, 160)], FS)


@query(f"SELECT vec_id, k - 16 AS i, {SQL_R.format('embedding[k + 1]::DOUBLE')} AS v FROM embeddings, range(16, 32) z(k)")
def clip_extract(spark, d):
    return samplewise(signals(spark, d).select("vec_id", arrays.part("y", F.lit(0.025), F.lit(0.05), FS).alias("y")))
