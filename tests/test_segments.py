"""Segment memory against the plain loop: sliding windows, old repeats, cycles, a hot stream; pieces between restarts."""

import random

import pandas as pd
from pyspark.sql import functions as F

from segue.operators import manifests


def lines_of(seed, n=1200):
    rng = random.Random(seed)
    rows, at = [], 0
    for stream, kind in enumerate(("sliding", "old", "cycle", "narrow", "mixed")):
        new = 0
        for k in range(2 * n if stream == 0 else n):
            at += 1
            fresh = rng.random() < 0.4
            if kind == "cycle":
                url = k % 13
            elif kind == "narrow":
                url = rng.randrange(6)
            elif fresh or not new:
                url, new = new, new + 1
            elif kind == "sliding":
                url = max(new - 1 - rng.randrange(4), 0)
            elif kind == "old" and (k // 150) % 3 == 1:
                url = rng.randrange(new)
            elif kind == "mixed" and rng.random() < 0.01:
                url = rng.randrange(new)
            else:
                url = max(new - 1 - rng.randrange(3), 0)
            rows.append((stream, at, None if kind == "mixed" and url == 5 else f"u{url}"))
    return pd.DataFrame(rows, columns=["stream", "line_no", "url"])


def plain(lines, capacity):
    out = set()
    for _, rows in lines.groupby("stream"):
        fresh = manifests.recent_links_step(capacity)({"urls": []}, rows)
        out |= {n for n, f in zip(rows["line_no"], fresh) if f}
    return out


def test_segments_equal_the_loop_in_pieces(spark, monkeypatch):
    lines, seen = lines_of(3), {}

    def spy(rows, keys, order, states, step, out, kind):
        for r in rows.groupBy(*keys).count().collect():
            seen.setdefault(r[keys[0]], []).append(r["count"])
        return original(rows, keys, order, states, step, out, kind)

    original = manifests.fold_from
    monkeypatch.setattr(manifests, "fold_from", spy)
    df = spark.createDataFrame(lines).withColumn("part", F.expr("line_no div 100"))
    got = manifests.dedupe_segments(df, "stream", "part", ["line_no"], 8).collect()
    assert {r.line_no for r in got} == plain(lines, 8) and len({r.line_no for r in got}) == len(got)
    assert len(seen[0]) > 15 and max(seen[0]) < 300, seen  # the hot sliding stream is many pieces
    assert len(seen[1]) > 3 and len(seen[4]) > 5
    assert max(seen[2]) > 1150 and 3 not in seen  # a cycle shows its memory once, a narrow stream needs no fold
