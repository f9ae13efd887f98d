"""Chunked scans and folds against a plain loop, with one group holding most rows."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from segue.functions.fold import ordered_fold
from segue.functions.ordered import Floored, Running, Shifted, SinceReset, row_index, scan
from segue.operators.manifests import recent_links_step


def data(seed=3, n=400):
    rng = random.Random(seed)
    return [(0 if rng.random() < 0.6 else rng.randrange(1, 6), i, rng.choice([None, 1, -2, 3]), rng.random() < 0.1) for i in range(n)]


def test_scan_equals_loop(spark):
    rows = data()
    df = spark.createDataFrame(rows, "g int, i int, v int, r boolean").withColumn("c", F.expr("i div 17"))
    got = {(x.g, x.i): x for x in scan(
        df, ["g"], ["c"], ["i"], n=row_index(), last=Running(F.col("v"), "last"), low=Running(F.col("v"), "min"),
        prev=Shifted(F.col("v"), -1), nxt=Shifted(F.col("v"), 1), since=SinceReset(F.lit(1), F.col("r")),
        before=SinceReset(F.lit(1), F.col("r"), before=True), floor=Floored(F.coalesce(F.col("v"), F.lit(0))),
        was=Floored(F.coalesce(F.col("v"), F.lit(0)), before=True)).collect()}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        last = low = None
        since = floor = 0
        for n, (_, i, v, reset) in enumerate(own):
            x = got[(g, i)]
            assert x.n == n and x.before == since and x.was == floor
            last, low = (v if v is not None else last), (min(low, v) if None not in (low, v) else low if v is None else v)
            since = 0 if reset else since + 1
            floor = max(floor + (v or 0), 0)
            assert (x.last, x.low, x.since, x.floor) == (last, low, since, floor)
            assert x.prev == (own[n - 1][2] if n else None) and x.nxt == (own[n + 1][2] if n + 1 < len(own) else None)


def test_fold_equals_loop_for_any_chunk_size(spark):
    rng = random.Random(5)
    rows = [(0 if i % 3 else 1, i, f"u{rng.randrange(9)}") for i in range(200)]
    for size in (5, 60):
        df = spark.createDataFrame(rows, "g int, i int, url string").withColumn("c", F.expr(f"i div {size}"))
        step = recent_links_step(4)
        got = {(r.g, r.i): r.fresh for r in ordered_fold(df, ["g"], "c", ["i"], step, {"urls": []}, "fresh", "boolean").collect()}
        for g in (0, 1):
            memory = []
            for _, i, url in [r for r in rows if r[0] == g]:
                assert got[(g, i)] == (url not in memory)
                if url not in memory:
                    memory = (memory + [url])[-4:]
