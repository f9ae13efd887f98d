"""Admission by bounds against the plain loop: caps that bind in bursts, always, never; hot guilds; repeated ids."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from segue.operators import queues


def log_of(seed, guilds=3, n=700, busy=0.5, repeat=False):
    """Bursts and quiet spells; answers come late, doubly, or never; a third of all rows in guild 0."""
    rng = random.Random(seed)
    rows, at = [], 0
    for g in range(guilds):
        ids, open_ = 0, []
        for k in range(n if g else 2 * n):
            at += 1
            calm = (k // 60) % 3 == 2
            move = rng.random()
            if move < (0.1 if calm else busy):
                ids += 1
                ident = g * 100_000 + (rng.randrange(1, ids + 1) if repeat and rng.random() < 0.2 else ids)
                rows.append((g, at, ident, "request", False))
                open_.append(ident)
            elif move < 0.8 and open_:
                ident = open_.pop(rng.randrange(len(open_))) if rng.random() < 0.9 else rng.choice(open_)
                rows.append((g, at, ident, "resolve", rng.random() < 0.7))
            else:
                rows.append((g, at, -at, "advance", False))
    return pd.DataFrame(rows, columns=["guild", "moment", "id", "kind", "ok"])


def plain(log, queue, pending):
    out = {}
    for g, rows in log.sort_values("moment").groupby("guild"):
        step = queues.admission_step(queue, pending)
        out |= dict(zip(rows["moment"], step({"queued": 0, "playing": False, "pending": []}, rows)))
    return out


@pytest.mark.parametrize("queue,pending,busy,repeat", [(6, 4, 0.4, False), (9000, 9000, 0.5, False), (3, 2, 0.6, False), (6, 4, 0.4, True)])
def test_admission_equals_the_loop(spark, queue, pending, busy, repeat):
    log = log_of(queue, busy=busy, repeat=repeat)
    df = spark.createDataFrame(log).withColumn("part", F.expr("moment div 50"))
    got = queues.admit_requests(df, "guild", "part", ["moment"], queue, pending).select("moment", "verdict").collect()
    want = plain(log, queue, pending)
    assert {r.moment: r.verdict for r in got} == want and len(got) == len(want)
    assert ("rejected" in want.values()) == (queue < 9000)


def test_a_hot_guild_is_folded_in_stretches(spark, monkeypatch):
    log = log_of(9, guilds=1, n=1500, busy=0.4)
    df = spark.createDataFrame(log).withColumn("part", F.expr("moment div 50"))
    seen = {}

    def spy(rows, keys, order, states, step, out, kind):
        counts = rows.groupBy(*keys).count().collect()
        seen.update(stretches=len(counts), longest=max(r["count"] for r in counts), rows=sum(r["count"] for r in counts))
        return original(rows, keys, order, states, step, out, kind)

    original = queues.fold_from
    monkeypatch.setattr(queues, "fold_from", spy)
    queues.admit_requests(df, "guild", "part", ["moment"], 6, 4).count()
    assert seen["stretches"] > 5 and seen["longest"] < len(log) / 3 and seen["rows"] < len(log)
