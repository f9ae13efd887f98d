"""Registered queue and event-log queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from segue.functions.ordered import row_index, scan
from segue.operators import queues as ops
from segue.operators.manifests import dedupe_segments as dedupe
from segue.plans.tables import LISTENER_QUEUE_SQL, listener_queue, table

CHUNK = 4096  # ids are dense, so a chunk of a guild holds at most this many rows

ENQUEUE_LOG = {
    "guild": "o_custkey % 16", "id": "o_orderkey",
    "resolved_at": "CASE WHEN o_totalprice <= 499000 THEN 1000 * o_orderkey + (o_orderkey * 7919) % 86400 END",
    "ok": "o_orderstatus <> 'F'",
}
# user 0 to 149: a third of the users share one guild
GUILD = "CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id % 16 END"
ACTION = ("CASE event_type WHEN 'view' THEN 'enqueue' WHEN 'purchase' THEN CASE WHEN value > 300 THEN 'enqueue' WHEN value > 200 THEN 'loop' ELSE 'automix' END "
          "WHEN 'click' THEN CASE WHEN value > 300 THEN 'shuffle' WHEN value > 200 THEN 'skip' ELSE 'end' END "
          "WHEN 'signup' THEN CASE WHEN value > 480 THEN 'disconnect' ELSE 'end' END "
          "ELSE CASE WHEN value > 400 THEN 'start_failed' ELSE 'error' END END")


def _cols(exprs):
    return [f"{e} AS {n}" for n, e in exprs.items()]


def _events(spark, sf, *cols):
    return table(spark, sf, "events").selectExpr(*cols, f"event_id div {CHUNK} AS part")


def commit_ready_prefix(spark, sf):
    log = table(spark, sf, "orders").selectExpr(*_cols(ENQUEUE_LOG), f"o_orderkey div {CHUNK} AS part")
    return ops.commit_ready_prefix(log, "guild", ["part"], ["id"])


MAX_QUEUE, MAX_PENDING = 40, 12
ADMISSION = (
    f"SELECT {GUILD} AS guild, event_id AS id, event_id * 10 AS moment, CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'request' ELSE 'advance' END AS kind, false AS ok FROM events "
    f"UNION ALL SELECT {GUILD}, event_id, event_id * 10 + 5 + CAST(floor(value * 12) AS BIGINT), 'resolve', event_type <> 'signup' FROM events WHERE event_type IN ('view', 'click', 'signup')")


def admit_requests(spark, sf):
    events = table(spark, sf, "events").withColumn("guild", F.expr(GUILD))
    asked = F.col("event_type").isin("view", "click", "signup")
    first = events.select("guild", F.col("event_id").alias("id"), (F.col("event_id") * 10).alias("moment"),
                          F.when(asked, "request").otherwise("advance").alias("kind"), F.lit(False).alias("ok"))
    later = events.where(asked).select(
        "guild", F.col("event_id").alias("id"), (F.col("event_id") * 10 + 5 + F.floor(F.col("value") * 12)).alias("moment"),
        F.lit("resolve").alias("kind"), (F.col("event_type") != "signup").alias("ok"))
    log = first.unionByName(later).withColumn("part", F.expr(f"moment div {10 * CHUNK}"))
    log = _fold_chunks(log, "guild", ["moment", "id"])
    return ops.admit_requests(log, "guild", "part", ["moment", "id"], MAX_QUEUE, MAX_PENDING).drop("part")


SEGMENT = "concat('https://cdn.example.net/s', CAST(floor(value) AS BIGINT) % 12, '.ts')"
MEMORY = 4


def _fold_chunks(log, group, order):
    """Chunks of a fold by position in the group: a short group is one chunk, and a chunk of
    a long one holds many more rows than the state remembers."""
    placed = scan(log, [group], ["part"], order, _n=row_index())
    return placed.withColumn("part", F.expr(f"_n div {CHUNK}")).drop("_n")


def dedupe_segments(spark, sf):
    lines = _events(spark, sf, "user_id AS stream", "event_id AS line_no", f"{SEGMENT} AS url")
    lines = _fold_chunks(lines, "stream", ["line_no"])
    return dedupe(lines, "stream", "part", ["line_no"], capacity=MEMORY).drop("part")


def replay_queue(spark, sf):
    log = _events(spark, sf, f"{GUILD} AS guild", "event_id", f"{ACTION} AS action")
    return ops.replay_queue(log, "guild", ["part"], ["event_id"])


def queue_preview(spark, sf):
    return ops.queue_preview(listener_queue(spark, sf), "listener", ["pos"], ["track"])


def peek_next(spark, sf):
    loops = table(spark, sf, "customer").selectExpr("c_custkey AS listener", "c_nationkey % 2 = 0 AS looping")
    return ops.peek_next(listener_queue(spark, sf), loops, "listener", ["pos"], "track")


def shuffle_queue(spark, sf):
    return ops.shuffle_queue(listener_queue(spark, sf).drop("part"), "listener", "pos", seed=42)


PLAYBACK = "event_id div 500"


def drop_stale_events(spark, sf):
    events = table(spark, sf, "events").selectExpr(
        f"{GUILD} AS guild", "dayofmonth(ts) AS session", f"{PLAYBACK} AS playback", "event_type AS kind", "event_id", "value")
    current = (events.where("kind = 'view'").groupBy("guild")
               .agg(F.max(F.struct("event_id", "session", "playback")).alias("m")).select("guild", "m.session", "m.playback"))
    return ops.drop_stale_events(events, current, ["guild", "session", "playback"], "kind", ["event_id"])


VOICE = {
    "guild": "CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id % 8 END", "event_id": "event_id", "user": "user_id",
    "kind": "CASE WHEN event_type = 'signup' THEN CASE WHEN value > 440 THEN 'bootstrap' ELSE 'bot_move' END WHEN event_type = 'error' AND value > 485 THEN 'bot_leave' WHEN event_type = 'purchase' AND value > 400 THEN 'load' ELSE 'peer' END",
    "channel": "CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value) AS BIGINT) % 40 END",
    "old_channel": "CASE WHEN user_id % 5 = 0 AND event_type <> 'error' THEN CAST(floor(value) AS BIGINT) % 40 END",
}


def voice_occupancy(spark, sf):
    events = _events(spark, sf, *_cols(VOICE))
    return ops.voice_occupancy(events, "guild", ["part"], ["event_id"])


def action_access(spark, sf):
    events = table(spark, sf, "events").selectExpr(*_cols(VOICE))
    bots = events.where("kind IN ('bootstrap', 'bot_move', 'bot_leave')")
    state = bots.groupBy("guild").agg(F.max(F.struct("event_id", "channel")).alias("m")).select(
        "guild", F.when(F.col("guild") != 3, F.col("m.channel")).alias("bot_channel"))
    actors = events.selectExpr("event_id", "guild", "channel AS actor_channel")
    return ops.action_access(actors, state, "guild")


SIGNAL = "CASE WHEN event_type = 'click' THEN 'stop' WHEN event_type = 'error' THEN 'error' WHEN event_type = 'view' THEN 'end' ELSE 'start' END"


def track_end_reason(spark, sf):
    signals = table(spark, sf, "events").selectExpr("event_id div 4 AS playback", "event_id", f"{SIGNAL} AS kind")
    return ops.track_end_reason(signals, "playback", "event_id")


TITLE = "CASE WHEN track % 4 = 0 THEN repeat(concat(p_name, ' '), 30) ELSE concat(p_name, ' é ', repeat('x', CAST(track % 150 AS INTEGER))) END"


def render_queue_lines(spark, sf):
    titles = table(spark, sf, "part").withColumnRenamed("p_partkey", "track").selectExpr("track", f"{TITLE} AS title")
    queue = listener_queue(spark, sf).join(titles, "track")
    return ops.render_queue_lines(queue, "listener", ["pos"], "title")


QUERIES = {f.__name__: f for f in (
    commit_ready_prefix, admit_requests, dedupe_segments, replay_queue, queue_preview, peek_next, shuffle_queue,
    drop_stale_events, voice_occupancy, action_access, track_end_reason, render_queue_lines)}

_WINDOW = "PARTITION BY {k} ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_LOOP_ON = "CASE WHEN am THEN true ELSE NOT lp END"

ORACLES = {
    "commit_ready_prefix": f"""
WITH l AS (SELECT {', '.join(_cols(ENQUEUE_LOG))} FROM orders),
n AS (SELECT *, row_number() OVER w - 1 AS seq, max(resolved_at) OVER w AS commit_at FROM l WINDOW w AS (PARTITION BY guild ORDER BY id)),
f AS (SELECT *, min(CASE WHEN resolved_at IS NULL THEN id END) OVER (PARTITION BY guild) AS stop FROM n)
SELECT guild, id, resolved_at, ok, seq, commit_at, CASE WHEN ok THEN 'committed' ELSE 'failed' END AS outcome FROM f WHERE stop IS NULL OR id < stop""",
    # one recursion step per log position, all guilds at once
    "admit_requests": f"""
WITH RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY guild ORDER BY moment, id) AS n FROM ({ADMISSION})),
r AS (SELECT guild, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS queued, false AS playing, CAST([] AS BIGINT[]) AS pending, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS moment, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS BOOLEAN) AS ok, CAST(NULL AS VARCHAR) AS verdict FROM (SELECT DISTINCT guild FROM l)
 UNION ALL SELECT l.guild, l.n,
  CASE WHEN l.kind = 'resolve' AND l.ok AND playing AND list_contains(pending, l.id) THEN queued + 1 WHEN l.kind = 'advance' THEN greatest(queued - 1, 0) ELSE queued END,
  CASE WHEN l.kind = 'advance' THEN queued > 0 WHEN l.kind = 'resolve' AND l.ok AND list_contains(pending, l.id) THEN true ELSE playing END,
  CASE WHEN l.kind = 'request' AND len(pending) < {MAX_PENDING} AND queued + len(pending) < {MAX_QUEUE} THEN list_append(pending, l.id) WHEN l.kind = 'resolve' THEN list_filter(pending, lambda x: x <> l.id) ELSE pending END,
  l.id, l.moment, l.kind, l.ok,
  CASE l.kind WHEN 'request' THEN CASE WHEN len(pending) < {MAX_PENDING} AND queued + len(pending) < {MAX_QUEUE} THEN 'admitted' ELSE 'rejected' END
   WHEN 'advance' THEN CASE WHEN queued > 0 THEN 'advanced' ELSE 'idle' END
   ELSE CASE WHEN NOT list_contains(pending, l.id) THEN 'unknown' WHEN NOT l.ok THEN 'failed' WHEN playing THEN 'queued' ELSE 'started' END END
  FROM r JOIN l ON l.guild = r.guild AND l.n = r.n + 1)
SELECT guild, id, moment, kind, ok, verdict FROM r WHERE n > 0""",
    "dedupe_segments": f"""
WITH RECURSIVE l AS (SELECT user_id AS stream, event_id AS line_no, {SEGMENT} AS url, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
r AS (SELECT stream, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS mem, CAST(NULL AS BIGINT) AS line_no, CAST(NULL AS VARCHAR) AS url, false AS fresh FROM (SELECT DISTINCT stream FROM l)
 UNION ALL SELECT l.stream, l.n, CASE WHEN list_contains(mem, l.url) THEN mem ELSE list_slice(list_append(mem, l.url), -{MEMORY}, -1) END, l.line_no, l.url, NOT list_contains(mem, l.url)
 FROM r JOIN l ON l.stream = r.stream AND l.n = r.n + 1)
SELECT stream, line_no, url FROM r WHERE n > 0 AND fresh""",
    "replay_queue": f"""
WITH RECURSIVE l AS (SELECT {GUILD} AS guild, event_id, {ACTION} AS action, row_number() OVER (PARTITION BY {GUILD} ORDER BY event_id) AS n FROM events),
r AS (SELECT guild, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS action, false AS ses, CAST([] AS BIGINT[]) AS items, CAST(0 AS BIGINT) AS made, false AS lp, false AS am, CAST(NULL AS VARCHAR) AS outcome FROM (SELECT DISTINCT guild FROM l)
 UNION ALL SELECT l.guild, l.n, l.event_id, l.action,
  CASE l.action WHEN 'enqueue' THEN true WHEN 'disconnect' THEN false ELSE ses END,
  CASE WHEN l.action = 'enqueue' THEN list_append(items, made + 1) WHEN l.action = 'disconnect' THEN [] WHEN (l.action IN ('end', 'error') AND NOT lp) OR l.action = 'start_failed' THEN items[2:] ELSE items END,
  made + CASE WHEN l.action = 'enqueue' THEN 1 ELSE 0 END,
  CASE WHEN l.action IN ('disconnect', 'start_failed') THEN false WHEN NOT ses THEN lp WHEN l.action = 'skip' THEN false WHEN l.action = 'loop' THEN {_LOOP_ON} WHEN l.action = 'automix' AND NOT am THEN false ELSE lp END,
  CASE WHEN l.action = 'disconnect' THEN false WHEN NOT ses THEN am WHEN l.action = 'loop' THEN false WHEN l.action = 'automix' THEN NOT am ELSE am END,
  CASE WHEN l.action IN ('skip', 'loop', 'shuffle', 'automix') AND NOT ses THEN 'no_track_playing'
   WHEN l.action = 'enqueue' THEN CASE WHEN len(items) > 0 THEN 'queued' ELSE 'now_playing' END
   WHEN l.action = 'skip' THEN CASE WHEN lp THEN 'skipped_loop' ELSE 'skipped' END
   WHEN l.action = 'loop' THEN CASE WHEN {_LOOP_ON} THEN 'loop_on' ELSE 'loop_off' END
   WHEN l.action = 'automix' THEN CASE WHEN am THEN 'automix_off' ELSE 'automix_on' END
   WHEN l.action = 'shuffle' THEN CASE WHEN len(items) >= 2 THEN 'shuffled' ELSE 'nothing_to_shuffle' END
   WHEN l.action = 'disconnect' THEN 'disconnected' WHEN len(items) = 0 THEN 'ignored' WHEN l.action IN ('end', 'error') AND lp THEN 'repeated'
   WHEN len(items) > 1 THEN 'advanced' ELSE 'finished' END
  FROM r JOIN l ON l.guild = r.guild AND l.n = r.n + 1)
SELECT guild, event_id, action, CAST(len(items) AS BIGINT) AS present, lp AS looping, am AS automix, items[1] AS current_ordinal,
 CASE WHEN lp THEN items[1] ELSE items[2] END AS next_ordinal, outcome FROM r WHERE n > 0""",
    "queue_preview": f"""
WITH q AS ({LISTENER_QUEUE_SQL}), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY listener ORDER BY pos) - 1 AS INTEGER) AS rank, count(*) OVER (PARTITION BY listener) - 1 AS total_queued FROM q)
SELECT listener, rank, track, total_queued FROM r WHERE rank <= 10""",
    "peek_next": f"""
WITH q AS ({LISTENER_QUEUE_SQL}), r AS (SELECT *, row_number() OVER w AS rn, lead(track) OVER w AS nxt FROM q WINDOW w AS (PARTITION BY listener ORDER BY pos))
SELECT listener, track AS current, CASE WHEN c_nationkey % 2 = 0 THEN track ELSE nxt END AS "next" FROM r LEFT JOIN customer ON c_custkey = listener WHERE rn = 1""",
    "shuffle_queue": f"""
WITH q AS ({LISTENER_QUEUE_SQL}) SELECT listener, pos, track, row_number() OVER (PARTITION BY listener ORDER BY md5('42-' || listener || '-' || pos), pos) - 1 AS new_pos FROM q""",
    "drop_stale_events": f"""
WITH e AS (SELECT {GUILD} AS guild, CAST(day(ts) AS INTEGER) AS session, event_id // 500 AS playback, event_type AS kind, event_id, value FROM events),
c AS (SELECT guild, arg_max(session, event_id) AS session, arg_max(playback, event_id) AS playback FROM e WHERE kind = 'view' GROUP BY guild),
k AS (SELECT e.*, row_number() OVER (PARTITION BY e.guild, e.session, e.playback, kind ORDER BY event_id) AS rn FROM e JOIN c ON e.guild = c.guild AND e.session = c.session AND e.playback = c.playback)
SELECT guild, session, playback, kind, event_id, value FROM k WHERE rn = 1""",
    "voice_occupancy": f"""
WITH RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY guild ORDER BY event_id) AS n FROM (SELECT {', '.join(_cols(VOICE)).replace(' AS user', ' AS usr')} FROM events)),
r AS (SELECT guild, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS usr, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS BIGINT) AS channel, false AS boot, CAST(NULL AS BIGINT) AS bot, CAST([] AS STRUCT(u BIGINT, c BIGINT)[]) AS ppl FROM (SELECT DISTINCT guild FROM l)
 UNION ALL SELECT l.guild, l.n, l.event_id, l.usr, l.kind, l.channel,
  CASE l.kind WHEN 'bootstrap' THEN true WHEN 'bot_leave' THEN false ELSE boot END,
  CASE WHEN l.kind IN ('bootstrap', 'bot_move') THEN l.channel WHEN l.kind = 'bot_leave' THEN NULL ELSE bot END,
  CASE WHEN l.kind IN ('bootstrap', 'bot_leave') THEN [] WHEN NOT boot OR l.kind = 'bot_move' THEN ppl
   WHEN l.kind = 'peer' AND coalesce(list_filter(ppl, lambda x: x.u = l.usr)[1].c, l.old_channel) IS NOT DISTINCT FROM l.channel THEN ppl
   ELSE list_concat(list_filter(ppl, lambda x: x.u <> l.usr), CASE WHEN l.channel IS NULL THEN [] ELSE [{{'u': l.usr, 'c': l.channel}}] END) END
  FROM r JOIN l ON l.guild = r.guild AND l.n = r.n + 1),
d AS (SELECT *, CASE WHEN boot AND bot IS NOT NULL THEN CAST(len(list_filter(ppl, lambda x: x.c = bot)) AS BIGINT) END AS people FROM r WHERE kind = 'peer')
SELECT guild, event_id, usr AS "user", channel, CASE WHEN people IS NOT NULL THEN bot END AS bot_channel, people,
 CASE WHEN people IS NULL THEN 'ignore' WHEN people = 0 THEN 'disconnect_alone' ELSE 'stay' END AS decision FROM d""",
    "action_access": f"""
WITH e AS (SELECT {', '.join(_cols(VOICE)).replace(' AS user', ' AS usr')} FROM events),
s AS (SELECT guild, max_by(struct_pack(c := channel), event_id).c AS bot FROM e WHERE kind IN ('bootstrap', 'bot_move', 'bot_leave') GROUP BY guild),
j AS (SELECT e.event_id, e.guild, e.channel AS actor_channel, CASE WHEN e.guild <> 3 THEN bot END AS bot_channel FROM e LEFT JOIN s ON s.guild = e.guild)
SELECT event_id, guild, actor_channel, bot_channel, CASE WHEN actor_channel IS NULL THEN 'user_not_in_voice' WHEN bot_channel IS NULL THEN 'no_active_channel'
 WHEN actor_channel = bot_channel THEN 'same_channel' ELSE 'different_channel' END AS access FROM j""",
    "track_end_reason": f"""
WITH s AS (SELECT event_id // 4 AS playback, event_id, {SIGNAL} AS kind FROM events), e AS (SELECT playback, min(event_id) AS ended_at FROM s WHERE kind = 'end' GROUP BY 1),
f AS (SELECT e.playback, e.ended_at, arg_min(s.kind, s.event_id) AS first_kind FROM e LEFT JOIN s ON s.playback = e.playback AND s.kind IN ('stop', 'error') AND s.event_id < e.ended_at GROUP BY 1, 2)
SELECT playback, ended_at, CASE WHEN first_kind IS NULL THEN 'completed' WHEN first_kind = 'stop' THEN 'stopped' END AS reason FROM f""",
    "render_queue_lines": f"""
WITH t AS (SELECT track, {TITLE} AS title FROM (SELECT p_partkey AS track, p_name FROM part)), q AS (SELECT * FROM ({LISTENER_QUEUE_SQL}) JOIN t USING (track)),
r AS (SELECT *, row_number() OVER (PARTITION BY listener ORDER BY pos) - 1 AS rank, count(*) OVER (PARTITION BY listener) - 1 AS total FROM q),
h AS (SELECT *, rank || '. ' || CASE WHEN length(title) <= 180 THEN title ELSE substring(title, 1, 177) || '...' END || chr(10) AS line,
  CASE WHEN total > 10 THEN chr(10) || '...and ' || (total - 10) || ' more songs' ELSE '' END AS suffix FROM r WHERE rank BETWEEN 1 AND 10),
b AS (SELECT *, sum(octet_length(encode(line))) OVER (PARTITION BY listener ORDER BY rank) AS used FROM h)
SELECT listener, coalesce(string_agg(line, '' ORDER BY rank) FILTER (WHERE used <= 1024 - octet_length(encode(suffix))), '') || any_value(suffix) AS text FROM b GROUP BY listener""",
}
