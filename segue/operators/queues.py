"""Queue and event-log jobs: commits, replay, previews, occupancy, end reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segue import rules
from segue.functions.fold import fold_from, ordered_fold
from segue.functions.ordered import Floored, Running, Shifted, SinceReset, row_index, scan
from segue.operators.urls import truncate_text
from segue.session import cut_lineage

# A disconnect empties any queue: a step below every possible queue length.
_EMPTY_ALL = -(1 << 32)


def commit_ready_prefix(log: DataFrame, guild: str, chunk: list[str], order: list[str],
                        resolved_at: str = "resolved_at", ok: str = "ok") -> DataFrame:
    """Requests of the contiguous resolved prefix with dense ``seq``, ``commit_at`` and
    ``outcome``; a failure still advances the prefix. Null ``resolved_at`` is unresolved."""
    done = F.col(resolved_at).isNotNull()
    numbered = scan(log, [guild], chunk, order, seq=row_index(), commit_at=Running(F.col(resolved_at), "max"),
                    _open=Running((~done).cast("long"), "sum"))
    return numbered.where(F.col("_open") == 0).select(
        *[c for c in log.columns if c not in chunk], "seq", "commit_at",
        F.when(F.col(ok), "committed").otherwise("failed").alias("outcome"))


def admission_step(max_queue: int, max_pending: int):
    """Sequential admission of one guild; pending holds at most ``max_pending`` ids."""

    def step(state: dict, rows) -> list:
        out, pending = [], dict.fromkeys(state["pending"])
        for kind, ident, ok in zip(rows["kind"], rows["id"], rows["ok"]):
            verdict = None
            if kind == "request":
                full = len(pending) >= max_pending or state["queued"] + len(pending) >= max_queue
                verdict = "rejected" if full else "admitted"
                if not full:
                    pending[int(ident)] = None
            elif kind == "resolve":
                verdict = "unknown"
                if int(ident) in pending:
                    del pending[int(ident)]
                    verdict = "queued" if ok and state["playing"] else "started" if ok else "failed"
                    if ok and state["playing"]:
                        state["queued"] += 1
                    elif ok:
                        state["playing"] = True
            elif kind == "advance":
                verdict = "advanced" if state["queued"] else "idle"
                state["playing"] = state["queued"] > 0
                state["queued"] = max(state["queued"] - 1, 0)
            out.append(verdict)
        state["pending"] = list(pending)
        return out

    return step


ADMISSION_START = {"queued": 0, "playing": False, "pending": []}


def admit_requests(log: DataFrame, guild: str, chunk: str, order: list[str], max_queue: int = rules.MAX_QUEUE,
                   max_pending: int = rules.MAX_PENDING) -> DataFrame:
    """log(guild, id, kind in request/resolve/advance, ok) with a ``verdict`` per row.

    Were every request admitted, pending requests would be a running sum and the tracks present one floored at zero, both
    scanned in chunks. These bound the true state from above, so a request that fits them is admitted; leaving out all others
    bounds it from below. Where both bounds are equal the state is known. Verdicts there are read off; only the stretches
    between, which start where a cap binds and end where the bounds meet again, are folded row by row, each by itself from
    its known start. A stretch in which a cap goes on binding is one stream. Guilds that request an id twice are folded whole.
    """
    place, kind = F.struct(chunk, *order), F.col("kind")
    columns = log.columns
    asks = log.where(kind == "request").groupBy(guild, "id").agg(F.count(F.lit(1)).alias("_asks"), F.min(place).alias("_asked"))
    answers = log.where(kind == "resolve").select(guild, "id", place.alias("_at")).join(asks, [guild, "id"]).where(
        F.col("_at") > F.col("_asked")).groupBy(guild, "id").agg(F.min("_at").alias("_answered"))
    asks = cut_lineage(asks.join(answers, [guild, "id"], "left"))
    odd = asks.where("_asks > 1").select(F.col(guild).alias("_odd")).distinct()
    known_ids = asks.select(F.col(guild).alias("_g"), F.col("id").alias("_i"), "_answered")
    df = log.join(odd, F.col(guild).eqNullSafe(F.col("_odd")), "left_anti")
    df = df.join(known_ids, (F.col(guild) == F.col("_g")) & (F.col("id") == F.col("_i")), "left").drop("_g", "_i")

    def number(hit: Column) -> Column:
        return F.coalesce(hit, F.lit(False)).cast("long")

    df = df.withColumn("_valid", F.coalesce((kind == "resolve") & (F.col("_answered") == place), F.lit(False))).drop("_answered")
    df = df.withColumn("_joins", number(F.col("_valid") & F.col("ok")) - number(kind == "advance"))
    df = scan(cut_lineage(df), [guild], [chunk], order, _pending=Running(number(kind == "request") - number(F.col("_valid")), before=True),
              _present=Floored(F.col("_joins")), _had=Floored(F.col("_joins"), before=True))
    queued = F.greatest(F.col("_had") - 1, F.lit(0))
    full = (kind == "request") & ((F.col("_pending") >= max_pending) | (queued + F.col("_pending") >= max_queue))
    df = cut_lineage(df.withColumn("_full", full))

    # the lower bound: without the requests that did not fit
    doubted = df.where("_full").select(F.col(guild).alias("_g"), F.col("id").alias("_i"), F.lit(True).alias("_doubt"))
    df = df.join(doubted, (F.col(guild) == F.col("_g")) & (F.col("id") == F.col("_i")), "left").drop("_g", "_i")
    doubt = F.coalesce(F.col("_doubt"), F.lit(False))
    df = df.withColumn("_sure", F.when(doubt & F.col("_valid"), 0).otherwise(F.col("_joins")).cast("long"))
    unsettled = number(F.col("_full")) - number(doubt & F.col("_valid"))
    df = scan(df, [guild], [chunk], order, _open=Running(unsettled), _least=Floored(F.col("_sure")),
              _opened=Running(unsettled, before=True), _leased=Floored(F.col("_sure"), before=True))
    df = df.withColumn("_known", (F.col("_open") == 0) & (F.col("_present") == F.col("_least")))
    df = df.withColumn("_was", (F.coalesce("_opened", F.lit(0)) == 0) & (F.col("_had") == F.col("_leased")))
    df = df.withColumn("_starts", F.col("_was") & ~F.col("_known")).drop("_doubt", "_sure", "_least", "_leased", "_open", "_opened")
    df = cut_lineage(scan(cut_lineage(df), [guild], [chunk], order, _stretch=Running(F.col("_starts").cast("long"))))
    within = ~F.col("_was") | ~F.col("_known")

    playing = F.col("_had") > 0
    verdict = (F.when(kind == "request", "admitted")
               .when(kind == "resolve", F.when(~F.col("_valid"), "unknown").when(~F.col("ok"), "failed")
                     .when(playing, "queued").otherwise("started"))
               .when(kind == "advance", F.when(F.col("_had") > 1, "advanced").otherwise("idle")))
    clear = df.where(~within).select(*columns, verdict.alias("verdict"))

    # what is pending where a stretch starts: admitted before it, answered in it or later
    last = df.groupBy(guild).agg(F.max("_stretch").alias("_last"))
    asked = df.where((kind == "request") & ~F.col("_full")).select(guild, "id", F.col("_stretch").alias("_from"))
    answered = df.where("_valid").select(F.col(guild).alias("_g"), F.col("id").alias("_i"), F.col("_stretch").alias("_to"))
    spans = asked.join(answered, (F.col(guild) == F.col("_g")) & (F.col("id") == F.col("_i")), "left").drop("_g", "_i").join(last, guild)
    spans = spans.withColumn("_to", F.coalesce("_to", "_last")).where("_to > _from")
    held = spans.select(guild, "id", F.explode(F.sequence(F.col("_from") + 1, F.col("_to"))).alias("_stretch"))
    held = held.groupBy(guild, "_stretch").agg(F.sort_array(F.collect_list("id")).alias("_ids"))  # at most max_pending
    states = df.where("_starts").select(guild, "_stretch", "_had").join(held, [guild, "_stretch"], "left").select(
        guild, "_stretch", F.to_json(F.struct(
            F.greatest(F.col("_had") - 1, F.lit(0)).alias("queued"), (F.col("_had") > 0).alias("playing"),
            F.coalesce("_ids", F.array().cast("array<bigint>")).alias("pending"))).alias("_in"))
    folded = fold_from(df.where(within).select(*columns, "_stretch"), [guild, "_stretch"], [chunk, *order], states,
                       admission_step(max_queue, max_pending), "verdict", "string").drop("_stretch")
    out = clear.unionByName(folded)
    if odd.isEmpty():
        return out
    rest = log.join(odd, F.col(guild).eqNullSafe(F.col("_odd")), "left_semi")
    return out.unionByName(ordered_fold(rest, [guild], chunk, order, admission_step(max_queue, max_pending), ADMISSION_START, "verdict", "string"))


def replay_queue(log: DataFrame, guild: str, chunk: list[str], order: list[str], action: str = "action",
                 automix_default: bool = False) -> DataFrame:
    """State after every event: ``present`` tracks (current included), ``looping``,
    ``automix``, ordinals of current and next track, and the ``outcome`` of the action.

    Actions: enqueue, skip, loop, shuffle, automix, end, error, start_failed, disconnect.
    A queue length is a running sum floored at zero, the flags are parities since their
    last set event, and the present tracks are always the most recently enqueued ones.
    The log does not record permutations, so ordinals follow enqueue order.
    """
    keys, a = [guild], F.col(action)
    default = F.lit(int(automix_default))

    def count(hit: Column) -> Column:
        return hit.cast("long")

    # a session opens with the first enqueue and closes at a disconnect
    df = scan(log, keys, chunk, order, _session=Running(
        F.when(a == "enqueue", True).when(a == "disconnect", False), "last", before=True))
    live = F.coalesce(F.col("_session"), F.lit(False))
    df = cut_lineage(df.withColumn("_session", live).withColumn(
        "_do", F.when(a.isin("loop", "skip", "shuffle", "automix") & ~live, "none").otherwise(a)))
    do = F.col("_do")

    # automix: toggled by its own action, off after a loop action, reset by a disconnect
    clears = do.isin("loop", "disconnect")
    base = F.when(do == "loop", 0).when(do == "disconnect", default)
    df = scan(df, keys, chunk, order,
              _t0=SinceReset(count(do == "automix"), clears, before=True), _t1=SinceReset(count(do == "automix"), clears),
              _b0=Running(base, "last", before=True), _b1=Running(base, "last"))
    was = ((F.coalesce(F.col("_b0"), default) + F.col("_t0")) % 2 == 1)
    now = ((F.coalesce(F.col("_b1"), default) + F.col("_t1")) % 2 == 1)
    df = df.withColumn("_was_auto", was).withColumn("automix", now).drop("_t0", "_t1", "_b0", "_b1")

    # loop: set off by skip, failed start, disconnect or automix turning on; set on when a
    # loop action replaces automix; otherwise toggled by the loop action
    value = (F.when(do.isin("skip", "start_failed", "disconnect") | ((do == "automix") & ~F.col("_was_auto")), 0)
             .when((do == "loop") & F.col("_was_auto"), 1))
    df = cut_lineage(df.withColumn("_set", value))
    flips = count((do == "loop") & F.col("_set").isNull())
    is_set = F.col("_set").isNotNull()
    df = scan(df, keys, chunk, order,
              _t0=SinceReset(flips, is_set, before=True), _t1=SinceReset(flips, is_set),
              _b0=Running(F.col("_set"), "last", before=True), _b1=Running(F.col("_set"), "last"))
    df = (df.withColumn("_was_loop", (F.coalesce(F.col("_b0"), F.lit(0)) + F.col("_t0")) % 2 == 1)
          .withColumn("looping", (F.coalesce(F.col("_b1"), F.lit(0)) + F.col("_t1")) % 2 == 1)
          .drop("_t0", "_t1", "_b0", "_b1", "_set"))

    ends = do.isin("end", "error")
    delta = (F.when(do == "enqueue", 1).when((ends & ~F.col("_was_loop")) | (do == "start_failed"), -1)
             .when(do == "disconnect", _EMPTY_ALL).otherwise(0)).cast("long")
    df = cut_lineage(df.withColumn("_delta", delta))
    df = scan(df, keys, chunk, order, present=Floored(F.col("_delta")), _before=Floored(F.col("_delta"), before=True),
              _enqueued=Running(count(do == "enqueue"), "sum"))
    n, had = F.col("present"), F.col("_before") > 0
    outcome = (
        F.when(do == "none", "no_track_playing")
        .when(do == "enqueue", F.when(had, "queued").otherwise("now_playing"))
        .when(do == "skip", F.when(F.col("_was_loop"), "skipped_loop").otherwise("skipped"))
        .when(do == "loop", F.when(F.col("looping"), "loop_on").otherwise("loop_off"))
        .when(do == "automix", F.when(F.col("automix"), "automix_on").otherwise("automix_off"))
        .when(do == "shuffle", F.when(n >= 2, "shuffled").otherwise("nothing_to_shuffle"))
        .when(do == "disconnect", "disconnected")
        .when(~had, "ignored")
        .when(ends & F.col("_was_loop"), "repeated")
        .otherwise(F.when(n > 0, "advanced").otherwise("finished")))
    first = F.col("_enqueued") - n + 1
    return df.select(*[c for c in log.columns if c not in chunk], "present", "looping", "automix",
                     F.when(n > 0, first).alias("current_ordinal"),
                     F.when(F.col("looping") & (n > 0), first).when(n > 1, first + 1).alias("next_ordinal"),
                     outcome.alias("outcome"))


def queue_preview(queue: DataFrame, guild: str, order: list[str], payload: list[str],
                  limit: int = rules.PREVIEW_LIMIT) -> DataFrame:
    """Current row (rank 0) and the first ``limit`` upcoming ones with ``total_queued``."""
    ranked = queue.withColumn("rank", F.row_number().over(Window.partitionBy(guild).orderBy(*order)) - 1)
    head = ranked.where(F.col("rank") <= limit).select(guild, "rank", *payload)
    totals = queue.groupBy(guild).agg((F.count(F.lit(1)) - 1).alias("total_queued"))
    return head.join(totals, guild)


def peek_next(queue: DataFrame, loops: DataFrame, guild: str, order: list[str], item: str) -> DataFrame:
    """Next item per guild: the current one when looping, else the second of the queue."""
    ranked = queue.withColumn("_r", F.row_number().over(Window.partitionBy(guild).orderBy(*order)))
    heads = (ranked.where(F.col("_r") <= 2).groupBy(guild)
             .agg(F.max(F.when(F.col("_r") == 1, F.col(item))).alias("current"),
                  F.max(F.when(F.col("_r") == 2, F.col(item))).alias("_second")))
    looping = F.coalesce(F.col("looping"), F.lit(False))
    return heads.join(loops, guild, "left").select(
        guild, "current", F.when(looping, F.col("current")).otherwise(F.col("_second")).alias("next"))


def shuffle_queue(queue: DataFrame, guild: str, ident: str, seed: int) -> DataFrame:
    """Seeded permutation: ``new_pos`` per guild by a hash of seed and id.

    Equal-width slices of the hash space cut a long queue into chunks.
    """
    key = F.md5(F.concat(F.lit(f"{seed}-"), F.col(guild), F.lit("-"), F.col(ident)))
    keyed = queue.withColumn("_h", key).withColumn("_slice", F.substring("_h", 1, 3))
    return scan(keyed, [guild], ["_slice"], ["_h", ident], new_pos=row_index()).drop("_h", "_slice")


def drop_stale_events(events: DataFrame, current: DataFrame, keys: list[str], kind: str, order: list[str]) -> DataFrame:
    """Events of the current session and playback; of repeated ones only the first."""
    live = events.join(current.select(*keys), keys, "left_semi")
    rest = [c for c in events.columns if c not in (*keys, kind, *order)]
    return (live.groupBy(*keys, kind).agg(F.min(F.struct(*order, *rest)).alias("_e"))
            .select(*keys, kind, "_e.*"))


def voice_occupancy(events: DataFrame, guild: str, chunk: list[str], order: list[str]) -> DataFrame:
    """events(kind in bootstrap/load/bot_move/bot_leave/peer, user, old_channel, channel):
    one row per peer event with the people in the bot channel and the decision."""
    kind = F.col("kind")
    resets = kind.isin("bootstrap", "bot_leave")
    moved = F.when(resets | (kind == "bot_move"), F.struct(
        F.when(kind != "bot_leave", F.col("channel")).alias("bot")))
    df = scan(events, [guild], chunk, order, _epoch=Running(resets.cast("long"), "sum"),
              _bot=Running(moved, "last"), _boot=Running(F.when(resets, kind == "bootstrap"), "last"))
    df = cut_lineage(df.withColumn("_boot", F.coalesce("_boot", F.lit(False))).withColumn("_bot", F.col("_bot.bot")))

    # per user: an event with old = new moves nobody while the user is untracked
    people = df.where(kind.isin("load", "peer") & F.col("_boot"))
    real = (kind == "load") | ~F.col("old_channel").eqNullSafe(F.col("channel")) | F.col("channel").isNull()
    people = scan(people, [guild, "_epoch", "user"], chunk, order,
                  _last=Shifted(F.struct(F.col("channel").alias("c")), -1),
                  _anchor=Running(F.when(real, F.struct(F.col("channel").alias("c"))), "last", before=True))
    tracked = F.col("_anchor.c").isNotNull()
    people = people.withColumn("_from", F.when(tracked, F.col("_last.c")))
    no_op = F.coalesce("_from", F.when(kind == "peer", F.col("old_channel"))).eqNullSafe(F.col("channel")) & (kind == "peer")
    people = cut_lineage(people.withColumn("_no_op", no_op).drop("_last", "_anchor"))

    # one row per head-count change, plus one probe of the bot channel per peer event
    moves = F.filter(F.array(
        F.when(~F.col("_no_op") & F.col("_from").isNotNull(), F.struct(F.col("_from").alias("c"), F.lit(-1).alias("d"), F.lit(0).alias("k"))),
        F.when(~F.col("_no_op") & F.col("channel").isNotNull(), F.struct(F.col("channel").alias("c"), F.lit(1).alias("d"), F.lit(0).alias("k"))),
        F.when((kind == "peer") & F.col("_bot").isNotNull(), F.struct(F.col("_bot").alias("c"), F.lit(0).alias("d"), F.lit(1).alias("k")))),
        lambda m: m.isNotNull())
    steps = people.select(guild, "_epoch", *chunk, *order, F.explode(moves).alias("_m")).select(
        guild, "_epoch", *chunk, *order, F.col("_m.c").alias("_c"), F.col("_m.d").cast("long").alias("_d"), F.col("_m.k").alias("_k"))
    counted = scan(steps, [guild, "_epoch", "_c"], chunk, [*order, "_k", "_d"], people=Running(F.col("_d"), "sum"))
    probes = counted.where(F.col("_k") == 1).select(guild, *order, F.col("_c").alias("bot_channel"), "people")
    decision = F.when(F.col("people").isNull(), "ignore").when(F.col("people") == 0, "disconnect_alone").otherwise("stay")
    return (df.where(kind == "peer").select(guild, *order, "user", "channel")
            .join(probes, [guild, *order], "left").withColumn("decision", decision))


def action_access(actors: DataFrame, state: DataFrame, guild: str) -> DataFrame:
    """actors(guild, actor_channel) against state(guild, bot_channel)."""
    actor, bot = F.col("actor_channel"), F.col("bot_channel")
    access = (F.when(actor.isNull(), "user_not_in_voice").when(bot.isNull(), "no_active_channel")
              .when(actor == bot, "same_channel").otherwise("different_channel"))
    return actors.join(state, guild, "left").withColumn("access", access)


def track_end_reason(signals: DataFrame, playback: str, order: str, kind: str = "kind") -> DataFrame:
    """One row per playback with an ``end`` signal: completed, stopped, or null after an error."""
    def first(name: str) -> Column:
        return F.min(F.when(F.col(kind) == name, F.col(order)))

    facts = signals.groupBy(playback).agg(first("stop").alias("_stop"), first("error").alias("_error"),
                                          first("end").alias("ended_at"))
    end = F.col("ended_at")
    stop = F.when(F.col("_stop") < end, F.col("_stop"))
    error = F.when(F.col("_error") < end, F.col("_error"))
    reason = (F.when(stop.isNull() & error.isNull(), "completed")
              .when(error.isNull() | (stop < error), "stopped"))
    return facts.where(end.isNotNull()).select(playback, "ended_at", reason.alias("reason"))


def render_queue_lines(queue: DataFrame, guild: str, order: list[str], title: str,
                       limit: int = rules.PREVIEW_LIMIT, budget: int = rules.FIELD_BYTES,
                       title_chars: int = rules.TITLE_CHARS) -> DataFrame:
    """Numbered upcoming titles within a byte budget, then the count of unlisted songs."""
    head = queue_preview(queue, guild, order, [title], limit).where(F.col("rank") >= 1)
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), truncate_text(F.col(title), title_chars), F.lit("\n"))
    # at most ``limit`` lines per guild are gathered
    lists = head.groupBy(guild).agg(
        F.array_sort(F.collect_list(F.struct(F.col("rank"), line.alias("line")))).alias("_lines"),
        F.max("total_queued").alias("total"))
    hidden = F.col("total") - F.size("_lines")
    suffix = F.when(hidden > 0, F.concat(F.lit("\n...and "), hidden.cast("string"), F.lit(" more songs"))).otherwise("")
    room = F.lit(budget) - F.octet_length(suffix)

    def add(acc: Column, entry: Column) -> Column:
        fits = acc["open"] & (F.octet_length(acc["text"]) + F.octet_length(entry["line"]) <= room)
        return F.struct(F.when(fits, F.concat(acc["text"], entry["line"])).otherwise(acc["text"]).alias("text"),
                        fits.alias("open"))

    start = F.struct(F.lit("").alias("text"), F.lit(True).alias("open"))
    text = F.aggregate("_lines", start, add, lambda acc: F.concat(acc["text"], suffix))
    return lists.select(guild, text.alias("text"))
