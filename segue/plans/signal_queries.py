"""Registered signal queries and their SQL twins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segue.functions.ordered import row_index, scan
from segue.operators import signals as ops
from segue.plans.tables import TRACK_CATALOG_SQL, table, track_catalog


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison (adding zero drops a negative zero)."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def pcm(spark, sf, per_track: int = 25) -> DataFrame:
    """Samples of consecutive vectors joined to tracks of ``per_track`` vectors."""
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "value")).selectExpr(
        f"vec_id div {per_track} AS track", f"(vec_id % {per_track}) * 64 + pos AS idx", "CAST(value AS DOUBLE) AS value")


def pcm_sql(per_track: int = 25) -> str:
    return (f"SELECT vec_id // {per_track} AS track, (vec_id % {per_track}) * 64 + pos AS idx, CAST(embedding[pos + 1] AS DOUBLE) AS value "
            "FROM embeddings, range(64) t(pos)")


def series(spark, sf) -> DataFrame:
    """Event values per user with their position; id ranges cut long series."""
    events = table(spark, sf, "events").selectExpr("user_id AS track", "event_id", "value", "event_id div 4096 AS part")
    return scan(events, ["track"], ["part"], ["event_id"], idx=row_index())


SERIES_SQL = "SELECT user_id AS track, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx FROM events"
RATE = 200
LOW = "value * (idx % 3) / 2"


def downmix_frames(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "x")).selectExpr(
        "label AS track", "vec_id * 32 + pos div 2 AS frame", "pos % 2 AS channel", "CAST(x AS DOUBLE) AS value")
    return rounded(ops.downmix_frames(df))


def decimate_mean(spark, sf):
    return rounded(ops.decimate_mean(pcm(spark, sf), RATE, 48))


def loudness_levels(spark, sf):
    return rounded(ops.loudness_levels(table(spark, sf, "events").selectExpr("user_id AS track", "value / 500 AS value")))


def block_energy(spark, sf):
    return rounded(ops.block_energy(pcm(spark, sf), 30), 8)


def quantize_levels(spark, sf):
    return rounded(ops.quantize_levels(ops.rms_envelope(pcm(spark, sf), RATE)))


def audible_bounds(spark, sf):
    return rounded(ops.audible_bounds(pcm(spark, sf)))


def _onsets(spark, sf):
    samples = pcm(spark, sf)
    low = samples.selectExpr("track", "idx", f"{LOW} AS value")
    return ops.onset_flux(ops.block_energy(samples, 1), ops.block_energy(low, 1), chunk_rows=512)


def onset_flux(spark, sf):
    return rounded(_onsets(spark, sf))


def estimate_tempo(spark, sf):
    return rounded(ops.estimate_tempo(_onsets(spark, sf)), 4)


def _tempo(spark, sf):
    onsets = _onsets(spark, sf)
    sums = pcm(spark, sf).groupBy("track").agg(F.expr(f"sum(({LOW}) * ({LOW})) / sum(value * value)").alias("low_energy_ratio"))
    return onsets, ops.select_tempo(ops.estimate_tempo(onsets), ops.estimate_tempo(onsets, value="kick_onset"), sums)


def select_tempo(spark, sf):
    return rounded(_tempo(spark, sf)[1], 4)


def downbeat_phase(spark, sf):
    onsets = _onsets(spark, sf)
    beats = onsets.select("track").distinct().selectExpr("track", "track % 7 AS first_beat", "10 + track % 5 AS beat_lag")
    return rounded(ops.downbeat_phase(onsets.drop("kick_onset"), beats))


ENVELOPE = ("CASE WHEN idx < 6 + track % 9 OR idx > 40 + track % 7 THEN value / 5000 ELSE 0.5 + value / 1000 END")


def energy_structure(spark, sf):
    env = series(spark, sf).selectExpr("track", "idx", f"{ENVELOPE} AS rms")
    bounds = env.groupBy("track").agg((F.count("idx") / 4).alias("audible_end_s")).selectExpr(
        "track", "(track % 3) / 8 AS audible_start_s", "audible_end_s")
    return rounded(ops.energy_structure(env, bounds))


def median_smooth(spark, sf):
    return rounded(ops.median_smooth(series(spark, sf).select("track", "idx", "value"), 4))


def median3_smooth(spark, sf):
    return rounded(ops.median3_smooth(series(spark, sf).select("track", "idx", "value"), chunk_rows=16))


def nearest_rank_percentile(spark, sf):
    df = table(spark, sf, "events").selectExpr("user_id % 10 AS track", "value")
    return ops.nearest_rank_percentile(df, "track", "value", 0.9, F.floor(F.col("value") / 8))


def run_statistics(spark, sf):
    events = table(spark, sf, "events").selectExpr("user_id % 10 AS track", "event_id AS idx", "value", "event_id div 4096 AS part")
    return rounded(ops.run_statistics(events, F.col("value") > 120, ["part"]))


def band_filter(spark, sf):
    return rounded(ops.band_filter(pcm(spark, sf), 2000, chunk_rows=640))


VOCAL = "value * (0.5 + (idx % 3) * 0.2)"
VOICE_RATE = 800


def vocal_bin_features(spark, sf):
    return rounded(ops.vocal_bin_features(pcm(spark, sf).selectExpr("*", f"{VOCAL} AS vocal"), VOICE_RATE))


FEATURES = {
    "full_rms": "value / 500", "vocal_ratio": "(event_id % 101) / 100", "voicing": "(event_id % 73) / 100",
    "modulation": "(event_id % 89) / 100", "duty": "(event_id % 53) / 50", "zcr": "(event_id % 61) / 100", "crest": "event_id % 20 + 0.5",
}


def _features():
    return [f"CAST({e} AS DOUBLE) AS {n}" for n, e in FEATURES.items()]


def vocal_risk(spark, sf):
    df = series(spark, sf).selectExpr("track", "idx AS bin", *_features())
    return ops.vocal_risk(df, reliable=True)


def effective_vocal_risk(spark, sf):
    df = track_catalog(spark, sf).select("track", "vocal", "vocal_conf", "vocal_rate", F.explode(F.sequence(F.lit(0), F.lit(80))).alias("s"))
    at = F.col("s").cast("long") * 1000000 + F.col("track")
    return rounded(df.select("track", "s", ops.effective_risk(F.col("vocal"), F.col("vocal_conf"), F.col("vocal_rate"), at).alias("risk")))


TONAL_VECTORS = 250


def estimate_key(spark, sf):
    return rounded(ops.estimate_key(pcm(spark, sf, TONAL_VECTORS), ops.TONAL_RATE), 4)


def mix_quality_metrics(spark, sf):
    return rounded(ops.mix_quality_metrics(pcm(spark, sf), RATE), 5)


QUERIES = {f.__name__: f for f in (
    downmix_frames, decimate_mean, loudness_levels, block_energy, quantize_levels, audible_bounds, onset_flux,
    estimate_tempo, select_tempo, downbeat_phase, energy_structure, median_smooth, median3_smooth,
    nearest_rank_percentile, run_statistics, band_filter, vocal_bin_features, vocal_risk, effective_vocal_risk,
    estimate_key, mix_quality_metrics)}

EPS = repr(ops.EPS)
_PCM = pcm_sql()
_LOWPCM = f"SELECT track, idx, {LOW} AS value FROM ({_PCM})"
_ONSETS = f"""
o1 AS (SELECT track, idx, value * value AS e, lead(value * value) OVER (PARTITION BY track ORDER BY idx) AS e2 FROM ({_PCM})),
l1 AS (SELECT track, idx, avg(value * value) OVER w AS m, count(*) OVER w AS c FROM ({_LOWPCM}) WINDOW w AS (PARTITION BY track ORDER BY idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
l2 AS (SELECT track, idx, CASE WHEN idx >= 3 THEN greatest(sqrt(lead(m) OVER (PARTITION BY track ORDER BY idx)) - sqrt(m), 0) ELSE 0 END AS kick FROM l1),
onsets AS (SELECT o1.track, o1.idx, greatest(sqrt(e2) - sqrt(e), 0) AS onset, CAST(kick AS DOUBLE) AS kick_onset FROM o1 JOIN l2 ON o1.track = l2.track AND o1.idx = l2.idx WHERE e2 IS NOT NULL)"""


def _tempo_sql(name: str, value: str) -> str:
    return f"""
{name}_s AS (SELECT a.track, lag, sum(a.{value} * b.{value}) AS s FROM onsets a, range(66, 173) g(lag), onsets b WHERE a.track = b.track AND b.idx = a.idx + lag GROUP BY 1, 2),
{name}_e AS (SELECT track, count(*) AS n, sum({value} * {value}) AS e FROM onsets GROUP BY 1),
{name}_r AS (SELECT *, lag(s) OVER w AS l, lead(s) OVER w AS r, row_number() OVER (PARTITION BY track ORDER BY s DESC, lag DESC) AS rn FROM {name}_s WINDOW w AS (PARTITION BY track ORDER BY lag)),
{name}_f AS (SELECT t.track, n, e, s, lag + CASE WHEN l IS NULL OR r IS NULL OR abs(l - 2 * s + r) <= {EPS} THEN 0 ELSE least(greatest(0.5 * (l - r) / (l - 2 * s + r), -0.5), 0.5) END AS lg FROM {name}_r t JOIN {name}_e USING (track) WHERE rn = 1),
{name} AS (SELECT track, CASE WHEN e > {EPS} AND n >= 200 THEN 12000 / lg END AS bpm, CASE WHEN e > {EPS} AND n >= 200 THEN least(s / e, 1) END AS confidence, CASE WHEN e > {EPS} AND n >= 200 THEN lg END AS beat_lag FROM {name}_f)"""


def _ramp(x: str, low: float, high: float) -> str:
    return f"least(greatest(({x} - {low}) / ({high} - {low}), 0), 1)"


def _poles(rate: float):
    return [math.exp(-2 * math.pi * f / rate) for f in (40.0, 180.0, 180.0, min(4000.0, rate * 0.45))]


_A = _poles(2000)


def _stage(p: str, hi: float, lo: float) -> tuple[str, list[str]]:
    """Expressions of one filter chain step over the previous row's memory."""
    h1 = f"({hi!r} * ({p}h1 + x.value - px))"
    h2 = f"({hi!r} * ({p}h2 + {h1} - {p}h1))"
    l1 = f"({1 - lo!r} * {h2} + {lo!r} * {p}l1)"
    l2 = f"({1 - lo!r} * {l1} + {lo!r} * {p}l2)"
    return l2, [f"{h1} AS {p}h1", f"{h2} AS {p}h2", f"{l1} AS {p}l1", f"{l2} AS {p}l2"]


_STEP = ", ".join(_stage("a", _A[0], _A[1])[1] + _stage("b", _A[2], _A[3])[1])
_ZERO = ", ".join(f"CAST(0 AS DOUBLE) AS {p}{c}" for p in "ab" for c in ("h1", "h2", "l1", "l2"))
_DB = "CASE WHEN {x} > " + EPS + " THEN 20 * log10({x}) ELSE -120.0 END"
_KEYS = ", ".join(f"({t}, '{m}', [{', '.join(str(p[(k + 12 - t) % 12]) for k in range(12))}])"
                  for t in range(12) for m, p in (("major", ops.MAJOR), ("minor", ops.MINOR)))

ORACLES = {
    "downmix_frames": """
WITH c AS (SELECT label AS track, vec_id * 32 + pos // 2 AS frame, pos % 2 AS channel, CAST(embedding[pos + 1] AS DOUBLE) AS v FROM embeddings, range(64) t(pos)),
r AS (SELECT *, row_number() OVER (PARTITION BY track, frame ORDER BY abs(v) DESC, channel DESC) AS rn FROM c)
SELECT track, frame, round(avg(v), 6) + 0.0 AS mean, round(any_value(v) FILTER (WHERE rn = 1), 6) + 0.0 AS loudest FROM r GROUP BY track, frame""",
    "decimate_mean": f"""
WITH b AS (SELECT track, idx, value, idx * 48 // 200 AS bin, count(*) OVER (PARTITION BY track) AS n FROM ({_PCM}))
SELECT track, bin, round(avg(value), 6) + 0.0 AS value FROM b WHERE bin < n * 48 // 200 GROUP BY track, bin""",
    "loudness_levels": "SELECT user_id AS track, round(10 * log10(avg((value / 500) ** 2)), 6) + 0.0 AS rms_dbfs, round(20 * log10(max(abs(value / 500))), 6) + 0.0 AS peak_dbfs FROM events GROUP BY user_id",
    "block_energy": f"SELECT track, idx // 30 AS block, round(avg(value * value), 8) + 0.0 AS energy FROM ({_PCM}) GROUP BY 1, 2",
    "quantize_levels": f"""
WITH r AS (SELECT track, idx // 50 AS block, sqrt(avg(value * value)) AS rms FROM ({_PCM}) GROUP BY 1, 2),
q AS (SELECT *, CAST(round((least(greatest(CASE WHEN rms > {EPS} THEN 20 * log10(rms) ELSE -80 END, -80), 0) + 80) / 80 * 255) AS INTEGER) AS level FROM r)
SELECT track, block, round(rms, 6) + 0.0 AS rms, level, round(pow(10, (level / 255 * 80 - 80) / 20), 6) + 0.0 AS linear FROM q""",
    "audible_bounds": f"""
WITH p AS (SELECT *, max(abs(value)) OVER (PARTITION BY track) AS peak FROM ({_PCM}))
SELECT track, round(any_value(peak), 6) + 0.0 AS peak, count(*) AS samples, any_value(peak) > {EPS} AS analyzed, min(CASE WHEN abs(value) >= greatest(peak * 0.02, 0.0005) THEN idx END) AS "first",
 max(CASE WHEN abs(value) >= greatest(peak * 0.02, 0.0005) THEN idx END) AS "last" FROM p GROUP BY track""",
    "onset_flux": f"WITH {_ONSETS} SELECT track, idx, round(onset, 6) + 0.0 AS onset, round(kick_onset, 6) + 0.0 AS kick_onset FROM onsets",
    "estimate_tempo": f"WITH {_ONSETS}, {_tempo_sql('f', 'onset')} SELECT track, round(bpm, 4) + 0.0 AS bpm, round(confidence, 4) + 0.0 AS confidence, round(beat_lag, 4) + 0.0 AS beat_lag FROM f",
    "select_tempo": f"""
WITH {_ONSETS}, {_tempo_sql('f', 'onset')}, {_tempo_sql('k', 'kick_onset')},
q AS (SELECT track, sum(({LOW}) * ({LOW})) / sum(value * value) AS ratio FROM ({_PCM}) GROUP BY track),
j AS (SELECT f.track, f.bpm AS fb, f.confidence AS fc, f.beat_lag AS fl, k.bpm AS kb, k.confidence AS kc, k.beat_lag AS kl, coalesce(k.confidence >= 0.35 AND ratio >= 0.015, false) AS kick_reliable FROM f JOIN k USING (track) JOIN q USING (track)),
u AS (SELECT *, kick_reliable AND NOT coalesce(abs(kb / fb - 1) <= 0.03, false) AS low FROM j)
SELECT track, kick_reliable, round(CASE WHEN low THEN kb ELSE fb END, 4) + 0.0 AS bpm, round(CASE WHEN low THEN kc ELSE fc END, 4) + 0.0 AS confidence, round(CASE WHEN low THEN kl ELSE fl END, 4) + 0.0 AS beat_lag FROM u""",
    "downbeat_phase": f"""
WITH {_ONSETS}, n AS (SELECT track, count(*) AS n, track % 7 AS f, 10 + track % 5 AS lag FROM onsets GROUP BY track),
p AS (SELECT track, k, f + k * lag AS p FROM n, range(2000) g(k) WHERE f + k * lag < n),
v AS (SELECT p.track, p.k, max(onset) AS v FROM p JOIN onsets o ON o.track = p.track AND o.idx BETWEEN p - 1 AND p + 1 GROUP BY 1, 2),
m AS (SELECT track, k % 4 AS phase, avg(v) AS m, count(*) AS c FROM v GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY m DESC, phase) AS rn, sum(c) OVER (PARTITION BY track) AS beats FROM m),
b AS (SELECT track, any_value(phase) FILTER (WHERE rn = 1) AS phase, CASE WHEN max(m) > {EPS} AND any_value(beats) >= 8 THEN (max(m) - any_value(m) FILTER (WHERE rn = 2)) / max(m) ELSE 0 END AS c FROM r GROUP BY track)
SELECT track, CASE WHEN c < 0.05 THEN 0 ELSE phase END AS phase, round(c, 6) + 0.0 AS confidence FROM b""",
    "energy_structure": f"""
WITH s AS (SELECT track, idx, {ENVELOPE} AS rms, count(*) OVER (PARTITION BY track) AS total FROM ({SERIES_SQL})),
b AS (SELECT *, CAST(floor((track % 3) / 8 * 4) AS BIGINT) AS off FROM s), c AS (SELECT track, idx - off AS i, off, rms FROM b WHERE idx >= off),
v AS (SELECT track, list(rms ORDER BY i) AS a, any_value(off) AS off, count(*) AS n FROM c GROUP BY track),
m AS (SELECT track, off, n, list_transform(range(n), lambda i: list_sort(a[greatest(i - 1, 1):least(i + 3, n)])[CAST(floor((least(i + 3, n) - greatest(i - 1, 1)) * 0.5 + 0.5) AS BIGINT) + 1]) AS z FROM v WHERE n >= 24),
r AS (SELECT *, list_sort(z)[CAST(floor((n - 1) * 0.9 + 0.5) AS BIGINT) + 1] AS ref, least(greatest(n * 35 // 100, 20), 120, n) AS search FROM m),
g AS (SELECT track, off, n, z, ref, search, k AS p, z[1:k] AS bf, z[k + 1:n] AS rest FROM r, range(0, 2000) t(k) WHERE k < n),
h AS (SELECT *, list_avg(list_transform(bf, lambda x: CASE WHEN x <= ref * 0.35 THEN 1 ELSE 0 END)) AS wb, list_avg(list_transform(z[p - 3:p], lambda x: CASE WHEN x <= ref * 0.35 THEN 1 ELSE 0 END)) AS eb,
 list_avg(list_transform(z[p + 1:p + 16], lambda x: CASE WHEN x >= ref * 0.55 THEN 1 ELSE 0 END)) AS ca, list_avg(z[p + 1:p + 16]) AS ma, list_avg(bf) AS mb,
 list_avg(list_transform(z[p - 15:p], lambda x: CASE WHEN x >= ref * 0.55 THEN 1 ELSE 0 END)) AS cb, list_avg(z[p - 15:p]) AS mcb, list_avg(list_transform(rest, lambda x: CASE WHEN x <= ref * 0.35 THEN 1 ELSE 0 END)) AS wa,
 list_avg(list_transform(z[p + 1:p + 4], lambda x: CASE WHEN x <= ref * 0.35 THEN 1 ELSE 0 END)) AS ea, list_avg(rest) AS mr,
 len(list_filter(range(1, len(rest) - 6), lambda j: list_min(rest[j:j + 7]) >= ref * 0.55)) > 0 AS recovers FROM g WHERE p >= 4),
i AS (SELECT track, off, p, 0.45 * least(greatest((ma - mb) / ref, 0), 1) + 0.3 * wb + 0.25 * ca AS c FROM h WHERE p < search - 16 AND wb >= 0.75 AND eb >= 0.75 AND ca >= 0.75),
o AS (SELECT track, off, p, 0.45 * least(greatest((mcb - mr) / ref, 0), 1) + 0.3 * wa + 0.25 * cb AS c FROM h WHERE p >= greatest(n - search, 16) AND p < n - 4 AND cb >= 0.75 AND wa >= 0.75 AND ea >= 0.75 AND NOT recovers),
ii AS (SELECT track, min(p + off) AS p, arg_min(c, p) AS c FROM i WHERE c >= 0.65 GROUP BY track), oo AS (SELECT track, min(p + off) AS p, arg_min(c, p) AS c FROM o WHERE c >= 0.65 GROUP BY track),
f AS (SELECT t.track, ii.p AS ip, ii.c AS ic, oo.p AS op, oo.c AS oc, coalesce(ii.p >= oo.p, false) AS clash FROM (SELECT DISTINCT track FROM s) t LEFT JOIN ii USING (track) LEFT JOIN oo USING (track))
SELECT track, round(CASE WHEN NOT (clash AND ic <= oc) OR NOT clash THEN ip / 4 END, 6) AS intro_end_s, round(coalesce(CASE WHEN NOT clash OR NOT ic <= oc THEN ic END, 0), 6) + 0.0 AS intro_confidence,
 round(CASE WHEN NOT clash OR ic <= oc THEN op / 4 END, 6) AS outro_start_s, round(coalesce(CASE WHEN NOT clash OR ic <= oc THEN oc END, 0), 6) + 0.0 AS outro_confidence FROM f""",
    "median_smooth": f"""
WITH s AS (SELECT track, idx, value, list(value) OVER (PARTITION BY track ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS a FROM ({SERIES_SQL}))
SELECT track, idx, value, list_sort(a)[CAST(floor((len(a) - 1) * 0.5 + 0.5) AS BIGINT) + 1] AS smooth FROM s""",
    "median3_smooth": f"""
WITH s AS (SELECT track, idx, value, lag(value) OVER w AS l, lead(value) OVER w AS r FROM ({SERIES_SQL}) WINDOW w AS (PARTITION BY track ORDER BY idx))
SELECT track, idx, value, CASE WHEN l IS NULL AND r IS NULL THEN value WHEN l IS NULL THEN greatest(value, r) WHEN r IS NULL THEN greatest(value, l)
 ELSE greatest(least(value, l), least(greatest(value, l), r)) END AS smooth FROM s""",
    "nearest_rank_percentile": """
WITH r AS (SELECT user_id % 10 AS track, value, row_number() OVER (PARTITION BY user_id % 10 ORDER BY value) - 1 AS rn, count(*) OVER (PARTITION BY user_id % 10) AS n FROM events)
SELECT track, value AS percentile FROM r WHERE rn = CAST(floor((n - 1) * 0.9 + 0.5) AS BIGINT)""",
    "run_statistics": """
WITH e AS (SELECT user_id % 10 AS track, event_id, value > 120 AS m FROM events), i AS (SELECT *, count(CASE WHEN NOT m THEN 1 END) OVER (PARTITION BY track ORDER BY event_id) AS island FROM e),
l AS (SELECT track, island, count(CASE WHEN m THEN 1 END) AS n FROM i GROUP BY 1, 2)
SELECT track, (SELECT round(avg(CASE WHEN m THEN 1.0 ELSE 0.0 END), 6) FROM e WHERE e.track = l.track) AS ratio, max(n) AS longest_run FROM l GROUP BY track""",
    "band_filter": f"""
WITH RECURSIVE p AS (SELECT * FROM ({_PCM})),
r AS (SELECT DISTINCT track, CAST(-1 AS BIGINT) AS idx, CAST(0 AS DOUBLE) AS px, {_ZERO} FROM p
 UNION ALL SELECT x.track, x.idx, x.value, {_STEP} FROM r JOIN p x ON x.track = r.track AND x.idx = r.idx + 1)
SELECT track, idx, round(px, 6) + 0.0 AS value, round(al2, 6) + 0.0 AS low_band, round(bl2, 6) + 0.0 AS vocal_band FROM r WHERE idx >= 0""",
    "vocal_bin_features": f"""
WITH b AS (SELECT track, idx, value, {VOCAL} AS v, idx // 200 AS bin, count(*) OVER (PARTITION BY track, idx // 200) AS n FROM ({_PCM})),
c AS (SELECT * FROM b WHERE n >= 100), g AS (SELECT track, bin, sqrt(avg(value * value)) AS full_rms, sqrt(avg(v * v)) AS vr, max(abs(v)) AS pk, avg(v * v) AS ms, sum(v * v) AS e FROM c GROUP BY 1, 2),
l AS (SELECT a.track, a.bin, lag, sum(a.v * z.v) / greatest(sqrt(sum(a.v * a.v) * sum(z.v * z.v)), 1e-9) AS s FROM c a, range(5, 26) t(lag), c z WHERE z.track = a.track AND z.bin = a.bin AND z.idx = a.idx + lag GROUP BY 1, 2, 3),
x AS (SELECT track, bin, greatest(max(s), 0) AS voicing FROM l GROUP BY 1, 2), w AS (SELECT track, bin, (idx % 200) // 40 AS k, sqrt(avg(v * v)) AS lv FROM c GROUP BY 1, 2, 3),
m AS (SELECT track, bin, (max(lv) - min(lv)) / greatest(max(lv), 1e-7) AS modulation, max(lv) AS top FROM w GROUP BY 1, 2),
d AS (SELECT w.track, w.bin, avg(CASE WHEN lv >= top * 0.25 THEN 1.0 ELSE 0.0 END) AS duty FROM w JOIN m USING (track, bin) GROUP BY 1, 2),
z AS (SELECT track, bin, avg(CASE WHEN nx IS NULL THEN NULL WHEN (v < 0) <> (nx < 0) THEN 1.0 ELSE 0.0 END) AS zcr FROM (SELECT *, lead(v) OVER (PARTITION BY track, bin ORDER BY idx) AS nx FROM c) GROUP BY 1, 2)
SELECT g.track, g.bin, round(full_rms, 6) + 0.0 AS full_rms, round(vr / greatest(full_rms, 1e-7), 6) + 0.0 AS vocal_ratio, round(CASE WHEN e > {EPS} THEN voicing ELSE 0 END, 6) + 0.0 AS voicing, round(modulation, 6) + 0.0 AS modulation,
 round(duty, 6) + 0.0 AS duty, round(zcr, 6) + 0.0 AS zcr, round(pk * pk / greatest(ms, 1e-9), 6) + 0.0 AS crest FROM g JOIN x USING (track, bin) JOIN m USING (track, bin) JOIN d USING (track, bin) JOIN z USING (track, bin)""",
    "vocal_risk": f"""
WITH s AS (SELECT track, idx AS bin, {', '.join(_features())} FROM ({SERIES_SQL})),
r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY full_rms) - 1 AS rn, count(*) OVER (PARTITION BY track) AS n FROM s),
f AS (SELECT track, full_rms AS ref FROM r WHERE rn = CAST(floor((n - 1) * 0.9 + 0.5) AS BIGINT)),
a AS (SELECT s.*, full_rms >= ref * 0.03 AS active, {_ramp('vocal_ratio', 0.12, 0.72)} AS ra, {_ramp('voicing', 0.12, 0.65)} AS vo, {_ramp('modulation', 0.08, 0.65)} AS mo,
 CASE WHEN zcr <= 0.03 OR zcr >= 0.48 THEN 0 WHEN zcr <= 0.22 THEN (zcr - 0.03) / 0.19 ELSE (0.48 - zcr) / 0.26 END AS zc FROM s JOIN f USING (track)),
t AS (SELECT *, {_ramp('crest', 6.0, 16.0)} * (1 - vo) AS tr FROM a),
k AS (SELECT *, CASE WHEN active THEN 0.34 * ra + 0.31 * vo + 0.25 * mo + 0.1 * zc - 0.35 * tr ELSE 0 END AS raw FROM t),
c AS (SELECT *, least(greatest(CASE WHEN duty < 0.25 THEN least(raw, 0.35) WHEN modulation < 0.08 THEN least(raw, 0.5) ELSE raw END, 0), 1) AS risk FROM k)
SELECT track, bin, CAST(round(risk * 255) AS INTEGER) AS risk, CAST(round(255 * CASE WHEN active AND ra >= 0.35 AND vo >= 0.3 AND mo >= 0.2 THEN 0.9
 WHEN NOT active OR ra < 0.12 OR duty < 0.25 OR (vo < 0.12 AND tr > 0.25) OR (mo < 0.08 AND risk < 0.55) THEN 0.8 ELSE 0.45 END) AS INTEGER) AS risk_confidence FROM c""",
    "effective_vocal_risk": f"""
WITH c AS (SELECT track, vocal, vocal_conf, vocal_rate, CAST(s AS INTEGER) AS s, CAST(floor((s * 1000000 + track) * vocal_rate / 1000000) AS BIGINT) + 1 AS b FROM ({TRACK_CATALOG_SQL}), range(81) t(s))
SELECT track, s, round(coalesce(CASE WHEN vocal_rate > 0 THEN vocal_conf[b] / 255 * vocal[b] / 255 + (1 - vocal_conf[b] / 255) * 0.65 END, 0.65), 6) AS risk FROM c""",
    # plain discrete Fourier sums of every windowed frame
    "estimate_key": f"""
WITH p AS (SELECT * FROM ({pcm_sql(TONAL_VECTORS)})), n AS (SELECT track, count(*) AS n FROM p GROUP BY 1),
w AS (SELECT track, k FROM n, range(100) t(k) WHERE k * 2048 + 4096 <= n),
x AS (SELECT w.track, w.k, idx - k * 2048 AS j, value * (0.5 - 0.5 * cos(2 * pi() * (idx - k * 2048) / 4095)) AS v FROM w JOIN p ON p.track = w.track AND idx >= k * 2048 AND idx < k * 2048 + 4096),
f AS (SELECT track, k, b, sum(v * cos(2 * pi() * ((j * b) % 4096) / 4096)) AS re, sum(v * sin(2 * pi() * ((j * b) % 4096) / 4096)) AS im FROM x, range(21, 744) t(b) GROUP BY 1, 2, 3),
e AS (SELECT track, k, CAST(floor(69 + 12 * log2(b * 11025 / 4096 / 440) + 0.5) AS BIGINT) % 12 AS pc, sum((re * re + im * im) / (b * 11025 / 4096)) AS e FROM f WHERE b * 11025 / 4096 BETWEEN 55 AND 2000 GROUP BY 1, 2, 3),
c AS (SELECT track, pc, e / sum(e) OVER (PARTITION BY track, k) AS e FROM e), g AS (SELECT track, pc, sum(e) AS e FROM c GROUP BY 1, 2),
q AS (SELECT * FROM (VALUES {_KEYS}) v(tonic, mode, prof)),
s AS (SELECT track, tonic, mode, sum(e * prof[pc + 1]) / (sqrt(sum(e * e)) * sqrt(sum(CAST(prof[pc + 1] AS DOUBLE) * prof[pc + 1]))) AS s FROM g, q GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY s DESC, tonic, mode) AS rn FROM s),
b AS (SELECT track, any_value(tonic) FILTER (WHERE rn = 1) AS tonic, any_value(mode) FILTER (WHERE rn = 1) AS mode, least((max(s) - any_value(s) FILTER (WHERE rn = 2)) / max(s) * 8, 1) AS c FROM r GROUP BY track)
SELECT track, CAST(CASE WHEN c >= 0.15 THEN tonic END AS BIGINT) AS tonic, CASE WHEN c >= 0.15 THEN mode END AS mode, CASE WHEN c >= 0.15 THEN round(c, 4) END AS confidence FROM b""",
    "mix_quality_metrics": f"""
WITH p AS (SELECT *, count(*) OVER (PARTITION BY track) AS n FROM ({_PCM})), t AS (SELECT track, any_value(n) AS n, max(abs(value)) AS pk FROM p GROUP BY track),
s AS (SELECT t.track, k, sqrt(avg(value * value)) AS r FROM t, range(2000) g(k), p WHERE p.track = t.track AND k * 25 < t.n AND (k = 0 OR k * 25 - 25 + 100 < t.n) AND idx >= k * 25 AND idx < k * 25 + 100 GROUP BY 1, 2),
q AS (SELECT track, min(r) AS qt FROM s GROUP BY track),
e AS (SELECT track, sqrt(avg(value * value) FILTER (WHERE idx < 100)) AS st, sqrt(avg(value * value) FILTER (WHERE idx >= (n - 100) // 2 AND idx < (n - 100) // 2 + 100)) AS md, sqrt(avg(value * value) FILTER (WHERE idx >= n - 100)) AS en FROM p GROUP BY track),
m AS (SELECT track, {_DB.format(x='st')} AS a, {_DB.format(x='md')} AS b, {_DB.format(x='en')} AS c, {_DB.format(x='qt')} AS d, qt / greatest(least(st, en), {EPS}) AS x, md / greatest(least(st, en), {EPS}) AS y, {_DB.format(x='pk')} AS z FROM e JOIN q USING (track) JOIN t USING (track))
SELECT track, round(a, 5) AS start_rms_dbfs, round(b, 5) AS mid_rms_dbfs, round(c, 5) AS end_rms_dbfs, round(d, 5) AS quietest_rms_dbfs, round(x, 5) AS quietest_to_edge, round(y, 5) AS mid_to_edge, round(z, 5) AS peak_dbfs,
 x < 0.35 AS quiet_gap, y < 0.6 AS midpoint_drop, z > -0.01 AS clipping_risk FROM m""",
}
