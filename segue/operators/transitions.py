"""Track facts and pairwise measures for transitions (all times in seconds).

Every measure is a column expression over a prepared outgoing track ``o`` and a
prepared incoming track ``i``; curves are evaluated in the row, without a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segue.functions.ordered import Shifted, scan
from segue.operators.signals import EPS, dequantize_level
from segue.session import cut_lineage, spread

# Limits and thresholds of transition planning.
TEMPO_DEADBAND = 0.001
TRUSTED = 0.35
MIN_OVERLAP = 1.0
BEAT_LIMIT, DOWNBEAT_LIMIT, PHRASE_LIMIT = 0.035, 0.070, 0.150
LOW_DIP, LOW_BUILD = 0.85, 1.15
DUAL_VOCAL_LIMIT = 0.58
SELECTION_EPSILON = 0.02
BACKED_CONFIDENCE, BACKED_COVERAGE, BACKED_MARKERS = 0.45, 0.55, 8
PICKUP, LOW_SKIP, STRUCTURED_SKIP, SKIP_RISK = 0.1, 8.0, 16.0, 0.2
SHORTER_SEARCH, NATURAL_OVERLAP = 8.0, 4.0
HEADROOM_DBFS = -1.0
CROSSFADE_S, MAX_TEMPO_ADJUSTMENT, MIN_BEAT_CONFIDENCE = 8.0, 0.06, 0.70
SAMPLES = 32


def unit(x: Column, low: float = 0.0) -> Column:
    """Clamp to low..1 a value that is never null (``greatest`` and ``least`` skip nulls)."""
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(low))


def clamp(x: Column) -> Column:
    """Clamp to 0..1, keeping null."""
    return F.when(x.isNotNull(), unit(x))


def less(a: Column, b) -> Column:
    """Saturating difference."""
    return F.greatest(a - b, F.lit(0.0))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def smoothstep(x: Column) -> Column:
    v = unit(x)
    return v * v * (3 - 2 * v)


# ---- facts of one track ----------------------------------------------------


def tempo_confident(floor: float) -> Column:
    """Beat confidence at or above the floor, or enough trusted markers behind it."""
    n = F.size("marker_conf")
    good = F.size(F.filter("marker_conf", lambda c: c >= TRUSTED))
    backed = ((F.col("beat_confidence") >= BACKED_CONFIDENCE) & (F.size("markers") >= BACKED_MARKERS) & (n > 0)
              & (good >= BACKED_MARKERS) & (good / n >= BACKED_COVERAGE))
    return (F.col("beat_confidence") >= floor) | F.coalesce(backed, F.lit(False))


def kick_coverage() -> Column:
    n = F.size("marker_conf")
    return F.when(n > 0, F.size(F.filter("marker_conf", lambda c: c >= TRUSTED)) / n).otherwise(0.0)


def _sec(name: str) -> Column:
    return F.col(name) / 1000000


def prepare_tracks(catalog: DataFrame, min_beat_confidence: float = MIN_BEAT_CONFIDENCE) -> DataFrame:
    """``track_facts`` as a written table: pair plans start from it instead of repeating its expressions."""
    return cut_lineage(track_facts(catalog, min_beat_confidence))


# fields of a prepared track; those in ``ONCE`` are small and dear to make
FIELDS = ("dur", "a0", "a1", "intro", "intro_c", "outro", "outro_c", "bpm", "raw_bpm", "bc", "fb", "fd", "dc", "tonic", "minor", "kc", "rms",
          "peak", "vr", "er", "nr", "en", "mk", "sure", "bi", "vk", "grid", "barred", "tol", "tm", "vf", "vl", "anchor", "starts")
ONCE = ("sure", "vk", "vf", "vl", "anchor", "starts")


def track_facts(catalog: DataFrame, min_beat_confidence: float = MIN_BEAT_CONFIDENCE) -> DataFrame:
    """Analysis records to (track, t) with everything the pair measures look up; only fields in use are computed."""
    return facts_in_row(spread(catalog, "track"), min_beat_confidence)


def facts_in_row(catalog: DataFrame, min_beat_confidence: float = MIN_BEAT_CONFIDENCE, keep: tuple[str, ...] = (),
                 once: str | None = None) -> DataFrame:
    """``track_facts`` where the rows are; columns named by ``keep`` stay. ``once`` names a struct with the fields ``ONCE``,
    which are then taken from it."""
    bpm = F.when((F.col("bpm") > 0) & ~F.isnan("bpm"), F.col("bpm"))
    trust = F.transform("markers", lambda m, k: F.struct(
        (m / 1000000).alias("t"), F.coalesce(F.get("marker_conf", k), F.col("beat_confidence")).alias("c")))
    rate = F.col("vocal_rate")
    paired = (rate > 0) & (F.size("vocal") == F.size("vocal_conf"))
    risks = F.when(paired, F.zip_with("vocal", "vocal_conf", lambda r, c: c / 255 * r / 255 + (1 - c / 255) * 0.65))
    known = F.when(paired & (F.size("vocal") > 0),
                   F.aggregate("vocal_conf", F.lit(0.0), lambda s, c: s + c / 255) / F.size("vocal_conf") >= 0.6)
    df = catalog.select(
        "track", *keep, _sec("duration_us").alias("dur"), _sec("audible_start_us").alias("a0"), _sec("audible_end_us").alias("a1"),
        _sec("intro_end_us").alias("intro"), F.col("intro_confidence").alias("intro_c"),
        _sec("outro_start_us").alias("outro"), F.col("outro_confidence").alias("outro_c"),
        bpm.alias("bpm"), F.col("bpm").cast("double").alias("raw_bpm"), F.col("beat_confidence").alias("bc"), _sec("first_beat_us").alias("fb"),
        _sec("first_downbeat_us").alias("fd"), F.col("downbeat_confidence").alias("dc"),
        F.col("key_tonic").alias("tonic"), F.col("key_minor").alias("minor"), F.col("key_confidence").alias("kc"),
        F.col("rms_dbfs").alias("rms"), F.col("peak_dbfs").alias("peak"),
        rate.cast("double").alias("vr"), F.coalesce(risks, F.array().cast("array<double>")).alias("er"),
        F.col("energy_rate").cast("double").alias("nr"), F.transform("energy", lambda b: dequantize_level(b)).alias("en"),
        trust.alias("mk"), *([F.col(f"{once}.{c}") for c in ONCE] if once else [known.alias("_k"), tempo_confident(min_beat_confidence).alias("sure")]))
    beat = 60 / F.col("bpm")
    grid = F.coalesce(F.col("fd").isNotNull() & F.col("bpm").isNotNull() & (F.col("bc") > 0), F.lit(False))
    df = df.withColumns({"bi": beat, "grid": grid, "tol": F.coalesce(15 / F.col("bpm"), F.lit(0.1)), "barred": grid & (F.col("dc") >= 0.25),
                         "tm": F.transform(F.filter("mk", lambda m: m["c"] >= TRUSTED), lambda m: m["t"])})
    if not once:
        df = _add_once(df)
    return df.select("track", *keep, F.struct(*FIELDS).alias("t"))


def _add_once(df: DataFrame) -> DataFrame:
    df = df.withColumn("vk", F.coalesce("_k", F.lit(False))).drop("_k")
    active = F.filter(F.transform("er", lambda r, k: F.when(
        (k / F.col("vr") < F.col("a1")) & ((k + 1) / F.col("vr") > F.col("a0")) & (r >= DUAL_VOCAL_LIMIT), k)), lambda k: k.isNotNull())
    df = df.withColumn("_act", active)
    df = df.withColumn("vf", F.when(F.col("vk"), F.greatest(F.array_min("_act") / F.col("vr"), F.when(F.size("_act") > 0, F.col("a0")))))
    df = df.withColumn("vl", F.when(F.col("vk"), F.least((F.array_max("_act") + 1) / F.col("vr"), F.when(F.size("_act") > 0, F.col("a1")))))
    df = df.withColumn("anchor", F.coalesce(
        F.array_min(F.filter("tm", lambda m: m >= F.col("a0"))), F.array_min("tm"), F.col("fb"), F.col("fd"))).drop("_act")
    return _add_safe_starts(df)


def _risk_between(start: Column, end: Column) -> Column:
    """Highest effective risk of the bins a span touches; null if unknown."""
    first = F.floor(start * F.col("vr"))
    last = F.least(F.ceil(end * F.col("vr")), F.size("er"))
    part = F.when(last > first, F.slice("er", (first + 1).cast("int"), F.greatest(last - first, F.lit(0)).cast("int")))
    return F.when(F.col("vk") & (end > start), F.array_max(part))


def _mean_energy(start: Column, end: Column, samples: int) -> Column:
    values = F.filter(F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: F.get(
        "en", F.floor((start + (end - start) * (k + 0.5) / samples) * F.col("nr")).cast("int"))), lambda e: e.isNotNull())
    mean = F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values)
    return F.when((end > start) & (F.size(values) > 0) & (F.col("nr") > 0), mean)


def _add_safe_starts(df: DataFrame) -> DataFrame:
    """Adds ``starts``: up to three sorted incoming starts."""
    a0, a1 = F.col("a0"), F.col("a1")

    def downbeat(pickup: float) -> Column:
        fd = F.col("fd")
        near = (F.size("mk") == 0) | F.exists("tm", lambda m: F.abs(m - fd) <= BEAT_LIMIT)
        return F.when((F.col("dc") >= 0.25) & (fd >= a0) & (fd - a0 <= pickup) & near, fd)

    def marker(pickup: float) -> Column:
        return F.array_min(F.filter("tm", lambda m: (m >= a0) & (m - a0 <= pickup)))

    intro = F.col("intro")
    usable = (F.col("intro_c") >= 0.65) & (intro > a0) & (intro < a1) & (intro - a0 <= STRUCTURED_SKIP)
    reach = F.greatest(F.col("tol"), F.lit(0.12))
    close = F.array_min(F.transform(F.filter("tm", lambda m: (m >= a0) & (m < a1) & (F.abs(m - intro) <= reach)),
                                    lambda m: F.struct(F.abs(m - intro).alias("d"), m.alias("m"))))["m"]
    raw = {"_c0": F.coalesce(downbeat(PICKUP), marker(PICKUP), F.col("fb")), "_c1": F.when(usable, close),
           "_c2": F.coalesce(downbeat(LOW_SKIP), marker(LOW_SKIP), F.col("fb"))}
    df = df.select("*", *[x.alias(n) for n, x in raw.items()])
    near = F.col("_c0")
    facts = {"_r0": _risk_between(a0, near)}
    for n in ("1", "2"):
        c = F.col(f"_c{n}")
        facts |= {f"_r{n}": _risk_between(a0, c), f"_b{n}": _mean_energy(a0, c, 12),
                  f"_e{n}": _mean_energy(c, F.least(a1, c + 2), 8)}
    df = df.select("*", *[x.alias(n) for n, x in facts.items()])

    def skippable(n: str, longest: float, ratio: float) -> Column:
        c, after = F.col(f"_c{n}"), F.col(f"_e{n}")
        return F.when((c > a0) & (c - a0 <= longest) & (c < a1) & (F.col(f"_r{n}") <= SKIP_RISK) & (after > 1e-6)
                      & (F.col(f"_b{n}") <= after * ratio), c)

    direct = F.when((near >= a0) & (near - a0 <= PICKUP) & ~F.coalesce(F.col("_r0") >= DUAL_VOCAL_LIMIT, F.lit(False)), near)
    found = F.array(direct, skippable("1", STRUCTURED_SKIP, 0.55), skippable("2", LOW_SKIP, 0.45))
    df = df.withColumn("starts", F.array_distinct(F.array_sort(F.filter(found, lambda c: c.isNotNull()))))
    return df.drop(*raw, *facts)


def beat_grid(catalog: DataFrame) -> DataFrame:
    ok = F.col("first_downbeat_us").isNotNull() & (F.col("bpm") > 0) & (F.col("beat_confidence") > 0)
    return catalog.select("track", F.when(ok, F.col("first_downbeat_us")).alias("first_downbeat_us"),
                          F.when(ok, F.round(60000000 / F.col("bpm")).cast("long")).alias("beat_interval_us"),
                          F.when(ok, F.lit(4)).alias("beats_per_bar"), kick_coverage().alias("kick_coverage"))


def phrase_cues(catalog: DataFrame) -> DataFrame:
    """(track, position_us, bars) for every 4/8/16-bar boundary inside the audible range."""
    ok = (F.col("bpm") > 0) & (F.col("beat_confidence") > 0) & (F.col("downbeat_confidence") >= 0.25)
    df = catalog.where(ok & F.col("first_downbeat_us").isNotNull()).select(
        "*", F.explode(F.array(F.lit(4), F.lit(8), F.lit(16))).alias("bars"))
    step = 240000000.0 / F.col("bpm") * F.col("bars")
    first = F.col("first_downbeat_us")
    k0 = F.greatest(F.ceil((F.col("audible_start_us") - first) / step), F.lit(0))
    k1 = F.floor((F.col("audible_end_us") - first) / step)
    df = df.withColumn("_k0", k0).withColumn("_k1", k1).where("_k1 >= _k0")
    return df.select("track", "bars", F.explode(F.sequence("_k0", "_k1")).alias("_k"), step.alias("_step"), first.alias("_first")).select(
        "track", F.round(F.col("_first") + F.col("_k") * F.col("_step")).cast("long").alias("position_us"), "bars")


def adjacent_pairs(queue: DataFrame, owner: str, chunk: list[str], order: list[str], item: str) -> DataFrame:
    """Consecutive items of every ordered list."""
    paired = scan(queue, [owner], chunk, order, incoming=Shifted(F.col(item), 1))
    return paired.where(F.col("incoming").isNotNull()).select(owner, *order, F.col(item).alias("outgoing"), "incoming")


def with_tracks(pairs: DataFrame, tracks: DataFrame) -> DataFrame:
    """Attach prepared records ``o`` and ``i`` to pairs(outgoing, incoming).

    Every pair stays; ``error`` names the side whose analysis is missing, null if both are there.
    """
    # merge joins: records are wide, and the estimate of a written table would have both sides broadcast; what tells
    # that a record is there is a column of its own, so that only the fields in use are shuffled
    o = tracks.select(F.col("track").alias("outgoing"), F.col("t").alias("o"), F.lit(True).alias("_o")).hint("merge")
    i = tracks.select(F.col("track").alias("incoming"), F.col("t").alias("i"), F.lit(True).alias("_i")).hint("merge")
    error = F.when(F.col("_o").isNull(), "outgoing analysis unavailable").when(F.col("_i").isNull(), "incoming analysis unavailable")
    return pairs.join(o, "outgoing", "left").join(i, "incoming", "left").withColumn("error", error).drop("_o", "_i")


# ---- measures of a pair ----------------------------------------------------


def tempo_ratio(outgoing_bpm: Column, incoming_bpm: Column) -> Column:
    """The ratio closest to 1 among r, 2r, r/2 (the first of equals)."""
    raw = outgoing_bpm / incoming_bpm
    options = F.array(*[F.struct(F.abs(raw * k - 1).alias("d"), F.lit(n).alias("n"), (raw * k).alias("r"))
                        for n, k in enumerate((1.0, 2.0, 0.5))])
    return F.when((outgoing_bpm > 0) & (incoming_bpm > 0), F.array_min(options)["r"])


def tempo_candidates(pairs: DataFrame, tracks: DataFrame, max_adjustment: float = MAX_TEMPO_ADJUSTMENT,
                     min_confidence: float = MIN_BEAT_CONFIDENCE) -> DataFrame:
    """Given pairs(outgoing, incoming) whose tempo ratio is within range and whose beats are
    both trusted. Only asked-for pairs are tested: all tracks of one tempo would be a square."""
    facts = tracks.where(tempo_confident(min_confidence) & (F.col("bpm") > 0)).select("track", "bpm")
    df = (pairs.join(facts.withColumnsRenamed({"track": "outgoing", "bpm": "_ob"}), "outgoing")
          .join(facts.withColumnsRenamed({"track": "incoming", "bpm": "_ib"}), "incoming"))
    df = df.withColumn("ratio", tempo_ratio(F.col("_ob"), F.col("_ib"))).drop("_ob", "_ib")
    return df.where(F.abs(F.col("ratio") - 1) <= max_adjustment)


def harmonic(o: str = "o", i: str = "i") -> Column:
    """Key compatibility; null if a key is missing, doubtful or invalid."""
    ot, it = F.col(f"{o}.tonic"), F.col(f"{i}.tonic")
    om, im = F.col(f"{o}.minor"), F.col(f"{i}.minor")
    usable = (F.col(f"{o}.kc") >= 0.5) & (F.col(f"{i}.kc") >= 0.5) & (ot < 12) & (it < 12)
    relative = (~om & im & (it == (ot + 9) % 12)) | (om & ~im & (ot == (it + 9) % 12))
    fifth = (om == im) & ((it == (ot + 7) % 12) | (ot == (it + 7) % 12))
    # Same key, relative, fifth, parallel, other.
    return F.when(usable, F.when((ot == it) & (om == im), 1.0).when(relative, 0.95).when(fifth, 0.85)
                  .when(ot == it, 0.65).otherwise(0.2))


def linear(dbfs: Column) -> Column:
    return F.pow(F.lit(10.0), dbfs / 20)


def equal_power(progress: Column) -> tuple[Column, Column]:
    angle = unit(progress) * (math.pi / 2)
    return F.cos(angle), F.sin(angle)


def beat_handoff(progress: Column) -> tuple[Column, Column]:
    p = unit(progress)
    incoming = F.sin(smoothstep(p / 0.75) * (math.pi / 2))
    outgoing = F.cos(smoothstep((p - 0.15) / 0.85) * (math.pi / 2))
    power = F.sqrt(outgoing * outgoing + incoming * incoming)
    scale = F.when(power > 1.08, 1.08 / power).otherwise(1.0)
    return unit(outgoing * scale), unit(incoming * scale)


def _gain_table(curve) -> list[tuple[float, float]]:
    """Gain pairs at the 33 sample points (constants of the curve)."""
    out = []
    for k in range(SAMPLES + 1):
        p = k / SAMPLES
        if curve == "beat":
            def s(v):
                v = min(max(v, 0.0), 1.0)
                return v * v * (3 - 2 * v)
            i, o = math.sin(s(p / 0.75) * math.pi / 2), math.cos(s((p - 0.15) / 0.85) * math.pi / 2)
            scale = 1.08 / math.hypot(o, i) if math.hypot(o, i) > 1.08 else 1.0
            out.append((min(max(o * scale, 0.0), 1.0), min(max(i * scale, 0.0), 1.0)))
        else:
            out.append((math.cos(p * math.pi / 2), math.sin(p * math.pi / 2)))
    return out


def eq_gains(role: str, progress: Column, compatibility: Column) -> tuple[Column, Column, Column]:
    """Low, mid and high gains of one deck at a progress of the overlap."""
    bass, presence = smoothstep(unit(progress * 2)), smoothstep(progress)
    duck = F.coalesce(clamp((0.5 - compatibility) / 0.5) * 0.2, F.lit(0.0))
    if role == "outgoing":
        bands = (1 - bass, 1 - (0.25 + duck) * presence, 1 - (0.18 + duck * 0.7) * presence)
    else:
        bands = (bass, (0.7 - duck) + (0.3 + duck) * presence, (0.82 - duck * 0.7) + (0.18 + duck * 0.7) * presence)
    return tuple(unit(b) for b in bands)


def recommended_gain(beat_matched: bool) -> Column:
    """Level match, peak headroom and combined-peak limit, within 0.25..1."""
    level = F.coalesce(linear(F.col("o.rms") - F.col("i.rms")), F.lit(1.0))
    peak = F.coalesce(linear(HEADROOM_DBFS - F.col("i.peak")), F.lit(1.0))
    op, ip = linear(F.col("o.peak")), linear(F.col("i.peak"))
    ceiling = 10 ** (HEADROOM_DBFS / 20)
    steps = [(o, i) for o, i in _gain_table("beat" if beat_matched else "fade")[1:] if i > EPS]
    limits = [F.when(ceiling - op * o <= 0, 0.0).otherwise((ceiling - op * o) / (ip * i)) for o, i in steps]
    combined = F.coalesce(unit(F.least(F.lit(1.0), *limits), 0.25), F.lit(1.0))
    both = F.when(op.isNotNull() & ip.isNotNull(), combined).otherwise(1.0)
    return unit(F.least(level, peak, both), 0.25)


def structure_span(incoming_start: Column) -> Column:
    """Shorter of the trusted outro and intro spans; null under a second or if untrusted."""
    outro = F.when(F.col("o.outro_c") >= 0.65, F.col("o.outro"))
    intro = F.when(F.col("i.intro_c") >= 0.65, F.col("i.intro"))
    span = F.when(outro.isNotNull() & intro.isNotNull(),
                  F.least(less(F.col("o.a1"), outro), less(intro, incoming_start)))
    return F.when(span >= 1.0, span)


def energy_at(side: str, position: Column) -> Column:
    rate = F.col(f"{side}.nr")
    return F.when(rate > 0, F.get(F.col(f"{side}.en"), F.floor(position * rate).cast("int")))


def risk_at(side: str, position: Column) -> Column:
    rate = F.col(f"{side}.vr")
    return F.coalesce(F.when(rate > 0, F.get(F.col(f"{side}.er"), F.floor(position * rate).cast("int"))), F.lit(0.65))


# ---- tempo map -------------------------------------------------------------


def nearest_marks(targets: Column, marks: Column) -> Column:
    """For ascending ``targets`` the index of the nearest of the ascending ``marks`` (the earlier of equals).

    Both are merged in one sort; a target's place in the merged order less its own index is the number of marks up to it.
    """
    own = F.transform(marks, lambda m, k: F.struct(m.alias("t"), F.lit(0).alias("kind"), k.alias("k")))
    sought = F.transform(targets, lambda t, k: F.struct(t.alias("t"), F.lit(1).alias("kind"), k.alias("k")))
    merged = F.array_sort(F.concat(own, sought))
    below = F.filter(F.transform(merged, lambda x, at: F.struct(x["t"].alias("t"), x["kind"].alias("kind"), (at - x["k"]).alias("n"))),
                     lambda x: x["kind"] == 1)
    gap = lambda x, k: F.abs(F.get(marks, k) - x["t"])
    return F.transform(below, lambda x: F.when((x["n"] == 0) | ((x["n"] < F.size(marks)) & (gap(x, x["n"]) < gap(x, x["n"] - 1))), x["n"])
                       .otherwise(x["n"] - 1))


def nearest_distances(targets: Column, marks: Column) -> Column:
    """Distance of each of the ascending ``targets`` to the nearest of the ascending ``marks``."""
    return F.zip_with(targets, nearest_marks(targets, marks), lambda t, k: F.abs(F.get(marks, k) - t))


def source_elapsed(env: Column, t: Column) -> Column:
    """Source time after output time ``t``; ``env`` null keeps native time.

    env: struct(initial, mix_end, hold, ramp, segments array<struct(end, speed)>).
    """
    hold, ramp, first, last = env["hold"], env["ramp"], env["initial"], env["mix_end"]

    def through(target: Column) -> Column:
        def step(acc, s):
            return F.struct((acc["src"] + F.greatest(F.least(s["end"], target) - acc["prev"], F.lit(0.0)) * s["speed"]).alias("src"),
                            s["end"].alias("prev"))
        start = F.struct(F.lit(0.0).alias("src"), F.lit(0.0).alias("prev"))
        return F.aggregate(env["segments"], start, step,
                           lambda a: a["src"] + F.greatest(target - a["prev"], F.lit(0.0)) * last)

    segmented = F.size(env["segments"]) > 0
    plain = F.when(hold > 0, first * t + 0.5 * (last - first) * t * t / hold).otherwise(t * last)
    held = F.when(segmented, through(hold)).otherwise(hold * (first + last) * 0.5)
    e = t - hold
    inside = F.when(segmented, through(t)).otherwise(plain)
    after = F.when((ramp > 0) & (e < ramp), held + last * e + 0.5 * (1 - last) * e * e / ramp).otherwise(
        held + ramp * (last + 1) * 0.5 + (e - ramp))
    return F.when(env.isNull(), t).when(t <= hold, inside).otherwise(after)


def output_elapsed(env: Column, s: Column) -> Column:
    """Inverse of ``source_elapsed``, solved piece by piece."""
    hold, ramp, first, last = env["hold"], env["ramp"], env["initial"], env["mix_end"]

    def step(acc, g):
        reach = acc["src"] + (g["end"] - acc["prev"]) * g["speed"]
        found = acc["out"].isNull() & (reach >= s)
        return F.struct(reach.alias("src"), g["end"].alias("prev"),
                        F.when(found, acc["prev"] + (s - acc["src"]) / g["speed"]).otherwise(acc["out"]).alias("out"))

    begin = F.struct(F.lit(0.0).alias("src"), F.lit(0.0).alias("prev"), F.lit(None).cast("double").alias("out"))
    by_segment = F.aggregate(env["segments"], begin, step,
                             lambda a: F.coalesce(a["out"], a["prev"] + (s - a["src"]) / last))
    curve = F.when(hold > 0, 2 * (last - first) / hold).otherwise(0.0)
    plain = 2 * s / (first + F.sqrt(F.greatest(first * first + curve * s, F.lit(0.0))))
    held = source_elapsed(env, hold)
    over = s - held
    bend = F.when(ramp > 0, 2 * (1 - last) / ramp).otherwise(0.0)
    in_ramp = 2 * over / (last + F.sqrt(F.greatest(last * last + bend * over, F.lit(0.0))))
    past = ramp + over - ramp * (last + 1) * 0.5
    inside = F.when(F.size(env["segments"]) > 0, by_segment).otherwise(plain)
    return F.when(env.isNull(), s).when(s <= held, inside).otherwise(
        hold + F.when((ramp > 0) & (in_ramp < ramp), in_ramp).otherwise(past))


def steady_envelope(ratio: Column, hold: Column) -> Column:
    """Constant-speed map without a way back, used for a first vocal limit."""
    return F.when(ratio.isNotNull(), F.struct(
        ratio.alias("initial"), ratio.alias("mix_end"), hold.alias("hold"), F.lit(0.0).alias("ramp"),
        F.array().cast("array<struct<end:double,speed:double>>").alias("segments")))


def add_tempo_map(df: DataFrame, start: str, incoming_start: str, duration: str, ratio: str, out: str,
                  max_adjustment: float = MAX_TEMPO_ADJUSTMENT, most_segments: int | None = None) -> DataFrame:
    """Adds ``out`` (envelope or null) and ``out_speed`` (initial speed) for a planned overlap.

    Outgoing and incoming markers are paired greedily in order; every fourth pair
    corrects the speed when the markers around it are trusted. Markers without distance
    between them leave the overlap without segments; ``most_segments`` limits their number.
    """
    os, is_, dur, r = (F.col(c) for c in (start, incoming_start, duration, ratio))
    df = df.withColumn("_ob", F.when(r.isNotNull(), F.filter("o.mk", lambda m: (m["t"] >= os) & (m["t"] <= os + dur))))
    reach = F.greatest(F.col("i.tol"), F.lit(BEAT_LIMIT))
    df = df.withColumn("_ib", F.when(r.isNotNull(), F.filter(
        "i.mk", lambda m: (m["t"] >= is_) & (m["t"] <= is_ + dur * r + reach))))

    pair_type = "array<struct<o:double,oc:double,s:double,sc:double>>"
    targets = F.transform("_ob", lambda m: is_ + (m["t"] - os) * r)
    df = df.withColumn("_tg", F.when(F.size("_ob") >= 5, targets)).withColumn("_im", F.transform("_ib", lambda m: m["t"]))
    df = df.withColumn("_to", F.zip_with("_tg", nearest_marks(F.col("_tg"), F.col("_im")), lambda t, k: F.struct(t.alias("t"), k.alias("k"))))
    df = df.withColumn("_to", F.zip_with("_ob", "_to", lambda m, x: F.struct(m.alias("m"), x["t"].alias("t"), x["k"].alias("k"))))

    def attach(acc, beat):
        # of markers in order, the nearest that is still free is the nearest one or the first free one
        at = F.greatest(beat["k"], acc["next"])
        found = F.get("_ib", at)
        near = F.coalesce(F.abs(found["t"] - beat["t"]) <= reach, F.lit(False))
        return F.when(near, F.struct((at + 1).alias("next"), F.concat(acc["pairs"], F.array(F.struct(
            beat["m"]["t"].alias("o"), beat["m"]["c"].alias("oc"), found["t"].alias("s"), found["c"].alias("sc")))).alias("pairs"))).otherwise(acc)

    begin = F.struct(F.lit(0).alias("next"), F.array().cast(pair_type).alias("pairs"))
    df = df.withColumn("_pairs", F.when(F.size("_ob") >= 5, F.aggregate("_to", begin, attach, lambda a: a["pairs"])))
    n = F.size("_pairs")
    usable = ((n >= 5) & (F.abs(F.get("_ob", F.lit(0))["t"] - os) <= 0.03) & (F.abs(F.get("_pairs", F.lit(0))["s"] - is_) <= 0.03))
    segment_type = "array<struct<end:double,speed:double>>"

    def correct(acc, k):
        a, b = k * 4, F.least(k * 4 + 4, n - 1)
        part = F.slice(F.col("_pairs"), a + 1, b - a + 1)
        p, q = F.get("_pairs", a), F.get("_pairs", b)
        good = lambda f: F.size(F.filter(part, lambda x: x[f] >= TRUSTED)) >= 3
        trusted = (good("oc") & good("sc") & (p["oc"] >= TRUSTED) & (q["oc"] >= TRUSTED)
                   & (p["sc"] >= TRUSTED) & (q["sc"] >= TRUSTED))
        wanted = (q["s"] - is_ - acc["src"]) / F.nullif(q["o"] - p["o"], F.lit(0.0))
        speed = F.when(trusted & (F.abs(wanted - 1) <= max_adjustment), wanted).otherwise(r)
        return let(speed, lambda v: F.struct(
            (acc["src"] + (q["o"] - p["o"]) * v).alias("src"),
            F.concat(acc["segments"], F.array(F.struct((q["o"] - os).alias("end"), v.alias("speed")))).alias("segments")))

    zero = F.struct(F.lit(0.0).alias("src"), F.array().cast(segment_type).alias("segments"))
    count = F.ceil((n - 1) / 4).cast("int")
    count = count if most_segments is None else F.least(count, F.lit(most_segments))
    flat = F.exists(F.sequence(F.lit(0), count - 1), lambda k: F.get("_pairs", k * 4)["o"] >= F.get("_pairs", F.least(k * 4 + 4, n - 1))["o"])
    usable = usable & ~flat
    folded = F.aggregate(F.sequence(F.lit(0), count - 1), zero, correct, lambda a: a["segments"])
    df = df.withColumn("_seg", F.coalesce(F.when(F.coalesce(usable, F.lit(False)), folded), F.array().cast(segment_type)))
    first = F.coalesce(F.get("_seg", F.lit(0))["speed"], r)
    last = F.coalesce(F.try_element_at("_seg", F.lit(-1))["speed"], r)
    needed = F.exists("_seg", lambda s: F.abs(s["speed"] - 1) > TEMPO_DEADBAND) | (F.abs(first - 1) > TEMPO_DEADBAND) | (
        F.abs(last - 1) > TEMPO_DEADBAND)
    env = F.when(r.isNotNull() & needed, F.struct(
        first.alias("initial"), last.alias("mix_end"), dur.alias("hold"),
        (240 / F.coalesce(F.col("o.bpm"), F.lit(120.0))).alias("ramp"), F.col("_seg").alias("segments")))
    return (df.withColumn(out, env).withColumn(f"{out}_speed", F.coalesce(first, F.lit(1.0)))
            .drop("_ob", "_ib", "_tg", "_im", "_to", "_pairs", "_seg"))


def vocal_limit(incoming_start: Column, longest: Column, env: Column | None = None) -> Column:
    """Longest overlap that keeps the two vocals apart: two seconds when unknown."""
    tail = F.least(less(F.col("o.a1"), F.col("o.vl")), longest)
    head = less(F.col("i.vf"), incoming_start)
    mapped = head if env is None else output_elapsed(env, head)
    return (F.when(~F.col("o.vk") | ~F.col("i.vk"), F.least(longest, F.lit(2.0)))
            .when(F.col("o.vl").isNull() | F.col("i.vf").isNull(), longest)
            .otherwise(F.least(longest, tail + mapped)))


# ---- quality of a planned overlap ------------------------------------------


def add_curves(df: DataFrame) -> DataFrame:
    """Adds ``_pts``: 33 points of a plan (p_os, p_is, p_dur, p_env, p_kind, p_gain, h).

    What depends on the point number alone is a table of constants; band gains need no
    clamp because the duck is at most 0.2.
    """
    os, is_, dur = F.col("p_os"), F.col("p_is"), F.col("p_dur")

    def table(kind: str) -> Column:
        def smooth(v: float) -> float:
            v = min(max(v, 0.0), 1.0)
            return v * v * (3 - 2 * v)
        return F.array(*[F.struct(F.lit(o).alias("o"), F.lit(i).alias("i"), F.lit(smooth(k / SAMPLES * 2)).alias("bass"),
                                  F.lit(smooth(k / SAMPLES)).alias("pres")) for k, (o, i) in enumerate(_gain_table(kind))])

    duck = F.coalesce(clamp((0.5 - F.col("h")) / 0.5) * 0.2, F.lit(0.0))
    gains = F.when(F.col("p_kind") == "beat_matched", table("beat")).otherwise(table("fade"))
    df = df.withColumns({"p_mix": source_elapsed(F.col("p_env"), dur), "_gains": gains, "_duck": duck})
    live = (F.col("p_kind") != "gapless") & (dur > 0)
    where = F.transform(F.sequence(F.lit(0), F.lit(SAMPLES)), lambda k: F.struct(
        k.alias("k"), (dur * k / SAMPLES).alias("e"), source_elapsed(F.col("p_env"), dur * k / SAMPLES).alias("s")))
    seen = F.transform(where, lambda p: F.struct(
        p["k"].alias("k"), p["e"].alias("e"), p["s"].alias("s"), F.when(F.col("p_mix") > 0, p["s"] / F.col("p_mix")).otherwise(1.0).alias("q")))
    shaped = F.transform(seen, lambda p: F.struct(
        p["k"].alias("k"), p["e"].alias("e"), p["s"].alias("s"), smoothstep(p["q"] * 2).alias("bass"), smoothstep(p["q"]).alias("pres"),
        F.get("_gains", p["k"]).alias("g")))
    df = df.withColumn("_at", F.when(live, shaped))
    d = F.col("_duck")
    banded = F.transform("_at", lambda p: F.struct(
        p["k"].alias("k"), p["e"].alias("e"), p["s"].alias("s"), p["g"].alias("g"), p["bass"].alias("i_low"),
        (0.7 - d + (0.3 + d) * p["pres"]).alias("i_mid"), (0.82 - d * 0.7 + (0.18 + d * 0.7) * p["pres"]).alias("i_high"),
        (1 - (0.25 + d) * p["g"]["pres"]).alias("o_mid"), (1 - (0.18 + d * 0.7) * p["g"]["pres"]).alias("o_high")))
    points = F.transform(banded, lambda p: F.struct(
        p["k"].alias("k"), (os + p["e"]).alias("o"), (is_ + p["s"]).alias("i"), (1 - p["g"]["bass"] + p["i_low"]).alias("low"),
        (p["g"]["o"] * (0.7 * p["o_mid"] + 0.3 * p["o_high"])).alias("o_voice"),
        (p["g"]["i"] * F.col("p_gain") * (0.7 * p["i_mid"] + 0.3 * p["i_high"])).alias("i_voice"),
        (p["g"]["o"] * (0.35 * (1 - p["g"]["bass"]) + 0.45 * p["o_mid"] + 0.2 * p["o_high"])).alias("o_full"),
        (p["g"]["i"] * F.col("p_gain") * (0.35 * p["i_low"] + 0.45 * p["i_mid"] + 0.2 * p["i_high"])).alias("i_full")))
    return df.withColumn("_pts", points).drop("_at", "_gains", "_duck")


def add_low_band(df: DataFrame) -> DataFrame:
    low = F.transform("_pts", lambda p: p["low"])
    return df.withColumns({"low_min": F.array_min(low), "low_max": F.array_max(low)})


def add_dual_vocals(df: DataFrame) -> DataFrame:
    """Sampled minimum of both deck's audible vocal risk; null if either is unknown."""
    heard = F.filter("_pts", lambda p: (p["o"] >= F.col("o.a0")) & (p["o"] <= F.col("o.a1"))
                     & (p["i"] >= F.col("i.a0")) & (p["i"] <= F.col("i.a1")))
    risk = F.transform(heard, lambda p: F.least(risk_at("o", p["o"]) * p["o_voice"], risk_at("i", p["i"]) * p["i_voice"]))
    return df.withColumn("dual_vocal", F.when(F.col("o.vk") & F.col("i.vk"), F.array_max(risk)))


def add_energy(df: DataFrame) -> DataFrame:
    """Level of the mix against the louder edge: extremes, largest step, hand-off figures."""
    ref = F.greatest(energy_at("o", F.col("p_os")), energy_at("i", F.col("p_is") + F.col("p_mix")) * F.col("p_gain"), F.lit(1e-6))
    both = energy_at("o", F.col("p_os")).isNotNull() & energy_at("i", F.col("p_is") + F.col("p_mix")).isNotNull()
    df = df.withColumn("_ref", F.when(both, ref))
    levels = F.filter(F.transform("_pts", lambda p: F.struct(
        p["k"].alias("k"), (energy_at("o", p["o"]) * p["o_full"]).alias("a"), (energy_at("i", p["i"]) * p["i_full"]).alias("b"))),
        lambda x: x["a"].isNotNull() & x["b"].isNotNull())
    df = df.withColumn("_lv", F.when(F.col("_ref").isNotNull(), levels))
    df = df.withColumn("_ra", F.transform("_lv", lambda x: F.sqrt(x["a"] * x["a"] + x["b"] * x["b"]) / F.col("_ref")))
    shares = F.transform(F.filter("_lv", lambda x: (x["k"] >= 24) & (x["a"] * x["a"] + x["b"] * x["b"] > 1e-12)),
                         lambda x: unit(x["b"] * x["b"] / (x["a"] * x["a"] + x["b"] * x["b"])))
    n = F.size("_ra")
    steps = F.transform(F.slice("_ra", 2, SAMPLES), lambda r, k: F.abs(r - F.get("_ra", k)))
    return df.withColumns({
        "energy_samples": F.coalesce(F.when(n > 0, n), F.lit(0)), "energy_min": F.array_min("_ra"), "energy_max": F.array_max("_ra"),
        "energy_step": F.when(n > 1, F.array_max(steps)), "handoff_ratio": F.try_element_at("_ra", F.lit(-1)),
        "handoff_share": F.array_min(shares)}).drop("_ref", "_lv", "_ra")


def _phase(x: Column, cycle: Column) -> Column:
    """Share of the cycle that has passed at ``x``."""
    return x / cycle - F.floor(x / cycle)


def interval_family(outgoing: Column, incoming: Column) -> Column:
    """The incoming interval, its double or its half: whichever is nearest to the outgoing one."""
    return F.array_min(F.array(*[F.struct(F.abs(incoming * k - outgoing).alias("d"), F.lit(n).alias("n"), (incoming * k).alias("v"))
                                 for n, k in enumerate((1.0, 2.0, 0.5))]))["v"]


def cycle_error(o_at: Column, o_first: Column, o_len: Column, i_at: Column, i_first: Column, i_len: Column) -> Column:
    near = interval_family(o_len, i_len)
    delta = F.abs(_phase(o_at - o_first, o_len) - _phase(i_at - i_first, near))
    return o_len * F.least(delta, 1 - delta)


def cycle_positions(first: Column, step: Column, start: Column, end: Column) -> Column:
    k0, k1 = F.ceil((start - first) / step), F.floor((end - first) / step)
    return F.when((end > start) & (k1 >= k0), F.transform(F.sequence(k0, k1), lambda k: first + k * step)).otherwise(
        F.array().cast("array<double>"))


def beats_between(side: str, start: Column, end: Column) -> Column:
    """Trusted markers of a span, else grid beats when the track's beat is trusted."""
    marks = F.filter(f"{side}.tm", lambda m: (m >= start) & (m <= end))
    first, step = F.col(f"{side}.fb"), F.col(f"{side}.bi")
    open_at = F.when(first.isNull() | (start <= first), F.greatest(F.coalesce(first, start), start)).otherwise(
        first + F.ceil((start - first) / step) * step)
    count = F.floor((end - open_at) / step)
    grid = F.when((F.col(f"{side}.bc") >= TRUSTED) & step.isNotNull() & (count >= 0),
                  F.transform(F.sequence(F.lit(0).cast("long"), count), lambda k: open_at + k * step))
    return F.when(end <= start, F.array().cast("array<double>")).when(F.size(marks) > 0, marks).otherwise(
        F.coalesce(grid, F.array().cast("array<double>")))


def add_phase_errors(df: DataFrame) -> DataFrame:
    """Beat, downbeat and 4-bar phrase errors over the overlap and at its end."""
    os, is_, dur, mix, env = (F.col(c) for c in ("p_os", "p_is", "p_dur", "p_mix", "p_env"))
    oe, ie = os + dur, is_ + mix
    barred = F.col("o.barred") & F.col("i.barred")
    none = F.array().cast("array<double>")
    spans = {"o": (os, oe), "i": (is_, ie)}

    def marks(side: str) -> Column:
        low, high = spans[side]
        return F.filter(f"{side}.tm", lambda m: (m >= low) & (m <= high))

    ticks = {f"_b_{s}": beats_between(s, *spans[s]) for s in "oi"}
    for name, beats in (("d", 4), ("p", 16)):
        ticks |= {f"_{name}_{s}": F.when(F.col(f"{s}.barred"), cycle_positions(
            F.col(f"{s}.fd"), F.col(f"{s}.bi") * beats, *spans[s])).otherwise(none) for s in "oi"}
    close = F.array_min(F.transform(marks("o"), lambda m: F.struct(F.abs(m - oe).alias("d"), m.alias("m"))))
    df = df.withColumns(ticks | {"_close": close, "_im": marks("i")})
    labels = {"b": "beat", "d": "downbeat", "p": "phrase"}

    def expected(name: str) -> Column:
        shifted = F.transform(f"_{name}_o", lambda t: is_ + source_elapsed(env, t - os))
        return F.when(F.size(f"_{name}_i") > 0, shifted).otherwise(none)

    df = df.withColumns({f"_x_{n}": expected(n) for n in labels} | {"_cx": is_ + source_elapsed(env, F.col("_close.m") - os)})

    def worst(name: str) -> Column:
        return F.array_max(nearest_distances(F.col(f"_x_{name}"), F.col(f"_{name}_i")))

    # hand-off by markers near the end, else by the cycle of the whole track
    usable = (F.size("_im") > 0) & (F.col("_close.d") <= F.coalesce(F.col("o.bi") / 2, F.lit(BEAT_LIMIT)))
    by_marker = F.when(usable, F.array_min(F.transform("_im", lambda m: F.abs(m - F.col("_cx")))))
    sure = (F.col("o.bc") >= TRUSTED) & (F.col("i.bc") >= TRUSTED)
    by_cycle = F.when(sure, cycle_error(oe, F.col("o.anchor"), F.col("o.bi"), ie, F.col("i.anchor"), F.col("i.bi")))
    handoffs = {"beat_handoff": F.coalesce(by_marker, by_cycle)}
    for label, beats in (("downbeat", 4), ("phrase", 16)):
        handoffs[f"{label}_handoff"] = F.when(barred, cycle_error(
            oe, F.col("o.fd"), F.col("o.bi") * beats, ie, F.col("i.fd"), F.col("i.bi") * beats))
    df = df.withColumns({f"{v}_pairs": F.size(f"_x_{n}") for n, v in labels.items()}
                        | {f"{v}_error": worst(n) for n, v in labels.items()} | handoffs)
    return df.drop("_close", "_im", "_cx", *ticks, *[f"_x_{n}" for n in labels])


def actionable(bars: int) -> Column:
    """The overlap covers at least half of the shorter phrase."""
    phrase = F.least(F.col("o.bi"), F.col("i.bi")) * (4 * bars)
    return F.col("o.grid") & F.col("i.grid") & (F.col("p_dur") >= phrase / 2)


def phrase_boundary() -> Column:
    chain = None
    for bars in (16, 8, 4):
        error = F.when(F.col("o.barred") & F.col("i.barred"), cycle_error(
            F.col("p_os"), F.col("o.fd"), F.col("o.bi") * (4 * bars), F.col("p_is"), F.col("i.fd"), F.col("i.bi") * (4 * bars)))
        hit = F.coalesce(actionable(bars) & (error <= PHRASE_LIMIT), F.lit(False))
        chain = F.when(hit, bars) if chain is None else chain.when(hit, bars)
    return chain


def speed_step() -> Column:
    env = F.col("p_env")
    path = F.concat(F.array(env["initial"]), F.transform(env["segments"], lambda s: s["speed"]), F.array(env["mix_end"]))
    return F.when(env.isNotNull(), let(path, lambda p: F.array_max(F.transform(
        F.slice(p, F.lit(2), F.size(p)), lambda v, k: F.abs(v - F.get(p, k))))))


MEASURES = ("p_dur", "beat_pairs", "beat_error", "beat_handoff", "downbeat_pairs", "downbeat_error", "downbeat_handoff",
            "phrase_pairs", "phrase_error", "phrase_handoff", "phrase_bars", "structure_ratio", "low_min", "low_max",
            "dual_vocal", "energy_samples", "energy_min", "energy_max", "energy_step", "handoff_ratio", "handoff_share",
            "tempo_step")


def add_quality(df: DataFrame) -> DataFrame:
    """Adds all measures of a plan, ``issues`` (in reporting order) and ``blocked``."""
    df = add_phase_errors(add_energy(add_dual_vocals(add_low_band(add_curves(df)))))
    beat = F.col("p_kind") == "beat_matched"
    mixed = F.col("p_kind") != "gapless"
    gated = {"phrase_bars": F.when(beat, phrase_boundary()), "tempo_step": speed_step(),
             "structure_ratio": F.when(mixed, clamp(F.col("p_dur") / structure_span(F.col("p_is"))))}
    for c in ("beat", "downbeat", "phrase"):
        gated[f"{c}_pairs"] = F.when(beat, F.col(f"{c}_pairs")).otherwise(0)
        gated |= {f"{c}_{part}": F.when(beat, F.col(f"{c}_{part}")) for part in ("error", "handoff")}
    df = df.withColumns(gated)
    c = F.col
    # Issues in reporting order; only the two low-band ones do not block.
    checks = (
        ("mix_overlap_too_short", mixed & (c("p_dur") < MIN_OVERLAP)),
        ("outgoing_overlap_misses_audible_end", mixed & (F.abs(c("p_os") + c("p_dur") - c("o.a1")) > 0.02)),
        ("incoming_overlap_exceeds_audible_end", mixed & (c("p_is") + c("p_mix") > c("i.a1") + 0.02)),
        ("low_handoff_dip", mixed & (c("low_min") < LOW_DIP)),
        ("low_handoff_build_up", mixed & (c("low_max") > LOW_BUILD)),
        ("dual_vocal_overlap_too_high", mixed & (c("dual_vocal") > DUAL_VOCAL_LIMIT)),
        ("beat_phase_unverified", beat & c("beat_error").isNull()),
        ("beat_phase_drift_too_large", c("beat_error") > BEAT_LIMIT),
        ("beat_handoff_phase_drift_too_large", c("beat_handoff") > BEAT_LIMIT),
        ("downbeat_phase_drift_too_large", c("downbeat_error") > DOWNBEAT_LIMIT),
        ("downbeat_handoff_phase_drift_too_large", c("downbeat_handoff") > DOWNBEAT_LIMIT),
        ("phrase_phase_drift_too_large", (c("phrase_error") > PHRASE_LIMIT) & actionable(4)),
        ("phrase_handoff_phase_drift_too_large", (c("phrase_handoff") > PHRASE_LIMIT) & actionable(4)),
    )
    df = df.withColumn("issues", F.filter(F.array(*[F.when(hit, F.lit(name)) for name, hit in checks]), lambda x: x.isNotNull()))
    blocked = F.exists("issues", lambda x: ~x.isin("low_handoff_dip", "low_handoff_build_up"))
    return df.withColumn("blocked", blocked).drop("_pts")


PENALTIES = ("energy_balance", "vocal", "short_mix", "energy_step", "handoff_energy", "handoff_ownership",
             "tempo_smoothness", "phrase_strength", "structure_usage", "harmonic_overlap")


def score_penalties() -> dict[str, Column]:
    """The ten penalties of a measured plan; energy_balance is null without energy samples."""
    c = F.col
    clash = F.coalesce(clamp((0.5 - c("h")) / 0.5), F.lit(0.0))
    low, high = F.greatest(c("energy_min"), F.lit(1e-6)), F.greatest(c("energy_max"), F.lit(1e-6))

    def above(x: Column, limit: float) -> Column:
        return F.greatest(x - limit, F.lit(0.0))

    def below(x: Column, limit) -> Column:
        return F.greatest(limit - x, F.lit(0.0))

    natural = F.when(clash > 0, F.greatest(NATURAL_OVERLAP * (1 - clash * 0.5), F.lit(2.0))).otherwise(NATURAL_OVERLAP)
    balance = below(low, 0.9) * 4 + above(high, 1.15) * 2 + F.abs(F.ln(low)) * 0.15 + F.abs(F.ln(high)) * 0.05
    risk = unit(c("dual_vocal") / DUAL_VOCAL_LIMIT)
    # Weights and targets of the score.
    parts = {
        "energy_balance": F.when(c("energy_samples") > 0, balance),
        "vocal": risk * risk * (1.1 + clash * 0.7),
        "short_mix": F.greatest(natural - c("p_dur"), F.lit(0.0)) * 0.12,
        "energy_step": above(c("energy_step"), 0.12) * 2,
        "handoff_energy": below(c("handoff_ratio"), 0.85) * 3 + above(c("handoff_ratio"), 1.15) * 2,
        "handoff_ownership": below(c("handoff_share"), 0.7 + clash * 0.1) * (1.5 + clash),
        "tempo_smoothness": above(c("tempo_step"), 0.015) * 8,
        "phrase_strength": F.when(c("phrase_bars") == 16, 0.0).when(c("phrase_bars") == 8, 0.04)
        .when(c("phrase_bars") == 4, 0.10).otherwise(0.16),
        "structure_usage": below(c("structure_ratio"), 0.7) * 0.12,
        "harmonic_overlap": above(c("p_dur"), 4.0) * 0.04 * clash,
    }
    # a measure that is absent costs nothing
    needs = {"vocal": "dual_vocal", "energy_step": "energy_step", "handoff_energy": "handoff_ratio",
             "handoff_ownership": "handoff_share", "tempo_smoothness": "tempo_step", "structure_usage": "structure_ratio"}
    return {n: F.when(c(needs[n]).isNull(), 0.0).otherwise(x) if n in needs else x for n, x in parts.items()}


def add_score(df: DataFrame, detail: bool = False) -> DataFrame:
    parts = score_penalties()
    if detail:
        for n, x in parts.items():
            df = df.withColumn(f"{n}_penalty", x)
    total = parts["energy_balance"]
    for n in PENALTIES[1:]:
        total = total + parts[n]
    return df.withColumn("score", total)
