"""Structured Streaming forms of the queue and playlist jobs.

Each job keeps one small JSON state per key (guild or stream) and sees the rows of a
micro-batch in order; the same step functions drive the batch folds.
"""

from __future__ import annotations

import json
from typing import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from segue import rules
from segue.operators.freshness import coalesce_requests
from segue.operators.manifests import recent_links_step
from segue.operators.queues import ADMISSION_START, admission_step

STATE = T.StructType([T.StructField("json", T.StringType())])


def keyed_fold_stream(df: DataFrame, key: str, order: list[str], step: Callable, initial: dict,
                      added: list[tuple[str, T.DataType]]) -> DataFrame:
    """Append columns computed by ``step(state, rows) -> list of tuples`` per key, across batches."""
    start = json.dumps(initial)
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in added]])
    names = [n for n, _ in added]

    def run(_key, batches, state):
        memory = json.loads(state.get[0] if state.exists else start)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        out = step(memory, rows)
        state.update((json.dumps(memory),))
        result = rows.reset_index(drop=True)
        for n, name in enumerate(names):
            result[name] = pd.Series([value[n] for value in out], dtype=object)
        yield result

    return df.groupBy(key).applyInPandasWithState(run, schema, STATE, "append", GroupStateTimeout.NoTimeout)


def _single(step: Callable) -> Callable:
    return lambda state, rows: [(v,) for v in step(state, rows)]


def admit_requests_stream(log: DataFrame, guild: str = "guild", order: tuple = ("moment", "id"),
                          max_queue: int = rules.MAX_QUEUE, max_pending: int = rules.MAX_PENDING) -> DataFrame:
    return keyed_fold_stream(log, guild, list(order), _single(admission_step(max_queue, max_pending)), ADMISSION_START,
                             [("verdict", T.StringType())])


def dedupe_segments_stream(lines: DataFrame, stream: str = "stream", order: tuple = ("line_no",),
                           capacity: int = rules.SEGMENT_MEMORY) -> DataFrame:
    flagged = keyed_fold_stream(lines, stream, list(order), _single(recent_links_step(capacity)), {"urls": []},
                                [("_fresh", T.BooleanType())])
    return flagged.where("_fresh").drop("_fresh")


def commit_ready_prefix_stream(resolutions: DataFrame, guild: str = "guild") -> DataFrame:
    """resolutions(guild, seq, resolved_at, ok) in any order to committed rows in sequence.

    Early resolutions wait in the state; admission bounds how many can wait.
    """
    fields = ("seq", "resolved_at", "ok")
    schema = T.StructType([resolutions.schema[guild], *[resolutions.schema[f] for f in fields],
                           T.StructField("commit_at", T.LongType()), T.StructField("outcome", T.StringType())])
    start = json.dumps({"next": 0, "latest": 0, "waiting": {}})

    def run(key, batches, state):
        memory = json.loads(state.get[0] if state.exists else start)
        for pdf in batches:
            for seq, at, ok in zip(pdf["seq"], pdf["resolved_at"], pdf["ok"]):
                memory["waiting"][str(int(seq))] = (int(at), bool(ok))
        out = []
        while str(memory["next"]) in memory["waiting"]:
            at, ok = memory["waiting"].pop(str(memory["next"]))
            memory["latest"] = max(memory["latest"], at)
            out.append((key[0], memory["next"], at, ok, memory["latest"], "committed" if ok else "failed"))
            memory["next"] += 1
        state.update((json.dumps(memory),))
        yield pd.DataFrame(out, columns=[f.name for f in schema.fields])

    return resolutions.groupBy(guild).applyInPandasWithState(run, schema, STATE, "append", GroupStateTimeout.NoTimeout)


REPLAY_START = {"session": False, "present": 0, "made": 0, "loop": False, "auto": False}


def replay_step(state: dict, rows: pd.DataFrame) -> list:
    """Queue state machine of one guild: (present, looping, automix, outcome) per event."""
    out = []
    for action in rows["action"]:
        s, verdict = state, None
        if action in ("skip", "loop", "shuffle", "automix") and not s["session"]:
            verdict = "no_track_playing"
        elif action == "enqueue":
            verdict = "queued" if s["present"] else "now_playing"
            s.update(session=True, present=s["present"] + 1, made=s["made"] + 1)
        elif action == "skip":
            verdict = "skipped_loop" if s["loop"] else "skipped"
            s["loop"] = False
        elif action == "loop":
            s["loop"], s["auto"] = (True if s["auto"] else not s["loop"]), False
            verdict = "loop_on" if s["loop"] else "loop_off"
        elif action == "automix":
            s["auto"] = not s["auto"]
            s["loop"] = s["loop"] and not s["auto"]
            verdict = "automix_on" if s["auto"] else "automix_off"
        elif action == "shuffle":
            verdict = "shuffled" if s["present"] >= 2 else "nothing_to_shuffle"
        elif action == "disconnect":
            s.update(session=False, present=0, loop=False, auto=False)
            verdict = "disconnected"
        else:  # end, error, start_failed
            repeats = s["loop"] and action != "start_failed"
            if action == "start_failed":
                s["loop"] = False
            if not s["present"]:
                verdict = "ignored"
            elif repeats:
                verdict = "repeated"
            else:
                s["present"] -= 1
                verdict = "advanced" if s["present"] else "finished"
        out.append((s["present"], s["loop"], s["auto"], verdict))
    return out


def replay_queue_stream(log: DataFrame, guild: str = "guild", order: tuple = ("event_id",)) -> DataFrame:
    return keyed_fold_stream(log, guild, list(order), replay_step, REPLAY_START, [
        ("present", T.LongType()), ("looping", T.BooleanType()), ("automix", T.BooleanType()), ("outcome", T.StringType())])


def occupancy_step(state: dict, rows: pd.DataFrame) -> list:
    """Voice state of one guild: (people in the bot channel, decision); null for other rows."""
    def key(value):
        return None if pd.isna(value) else int(value)

    out = []
    for kind, user, old, new in zip(rows["kind"], rows["user"], rows["old_channel"], rows["channel"]):
        user, old, new = str(int(user)), key(old), key(new)
        people = state["people"]
        if kind in ("bootstrap", "bot_leave"):
            state.update(boot=kind == "bootstrap", bot=new if kind == "bootstrap" else None, people={})
        elif kind == "bot_move":
            state["bot"] = new
        elif state["boot"]:
            tracked = people.get(user)
            no_op = kind == "peer" and (tracked if tracked is not None else old) == new
            if not no_op:
                people.pop(user, None)
                if new is not None:
                    people[user] = new
        if kind != "peer":
            out.append((None, None))
        elif not state["boot"] or state["bot"] is None:
            out.append((None, "ignore"))
        else:
            n = sum(1 for c in state["people"].values() if c == state["bot"])
            out.append((n, "stay" if n else "disconnect_alone"))
    return out


def voice_occupancy_stream(events: DataFrame, guild: str = "guild", order: tuple = ("event_id",)) -> DataFrame:
    counted = keyed_fold_stream(events, guild, list(order), occupancy_step, {"boot": False, "bot": None, "people": {}},
                                [("people", T.LongType()), ("decision", T.StringType())])
    return counted.where("kind = 'peer'")


def drop_stale_events_stream(events: DataFrame, current: DataFrame, keys: list[str], kind: str, at: str,
                             delay: str = "1 hour") -> DataFrame:
    """Semi join with the current playbacks, then one event per playback and kind."""
    live = events.withWatermark(at, delay).join(current.select(*keys), keys, "left_semi")
    return live.dropDuplicatesWithinWatermark([*keys, kind])


def coalesce_requests_stream(requests: DataFrame, gate: str, at: str, order: list[str], window: str = "10 minutes",
                             delay: str = "10 minutes") -> DataFrame:
    """The batch rule over windows that the watermark has passed: the first request of a gate key and window leads."""
    return coalesce_requests(requests.withWatermark(at, delay), gate, at, order, window)
