"""Hot ids, very long words, hostile digits: bounds and results of the corpus operators."""

import datetime
import re
import time

import numpy as np
from pyspark.sql import functions as F

from segue.llm import decontaminate, id_planes, pii_feistel, quality_mil
from segue.llm.common import text_words


def pii(spark, texts, key="k"):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return {r.row.doc_id: r for r in pii_feistel.pseudonymize(docs, key).collect()}


def test_hostile_digits_take_linear_time(spark):
    hostile = [" ".join(["+" + "1" * 60 + "x"] * 30), "+" + "1" * 1_000_000, "1" * 1_000_000, "+1(" * 300_000, "a" * 1_000_000,
               "+1 " * 10_000, "1-" * 10_000, "2 " * 10_000, "1." * 50_000, "GB12 " * 4_000]
    pii(spark, ["x"])
    for text in hostile:
        start = time.time()
        assert pii(spark, [text])[0].text is not None
        assert time.time() - start < 20, text[:40]


def test_dates_of_mixed_layouts_keep_apart(spark):
    day, texts = datetime.date(1900, 1, 1), []
    while day.year <= 2050:
        texts += [day.strftime("%d/%m/%Y")] + ([day.strftime("%m/%d/%Y")] if day.day > 12 else [])
        day += datetime.timedelta(1)
    docs = spark.createDataFrame([(t,) for t in dict.fromkeys(texts)], "text string")
    rows = pii_feistel.pseudonymize(docs, "k")
    got = rows.agg(F.count("*").alias("n"), F.count_distinct("text").alias("d"), F.sum("n_found").alias("f")).first()
    assert got.n == got.d == got.f == len(set(texts)) > 88_000
    again = rows.select("text").toArrow()["text"].to_pylist()
    assert all(re.fullmatch(r"\d\d/\d\d/\d{4}", t) for t in again)
    late = [t for t in again if int(t[:2]) <= 12 < int(t[3:5])]
    assert all(datetime.datetime.strptime(t, "%m/%d/%Y") for t in late) and len(late) == sum(int(t[3:5]) > 12 for t in set(texts))


def test_bare_numbers_and_longest_phones(spark):
    got = pii(spark, ["id 9995551234", "id 4115551234", "id 3705551234", "call 4155551234", "+44 20 7946 0958 123456789012", "+49 (30) 901820 x"])
    assert [got[k].n_found for k in range(6)] == [0, 0, 0, 1, 1, 1]
    assert got[4].text.endswith(" 123456789012") and "7946" not in got[4].text[:16]


def test_words_of_any_length_and_spans_cut_out(spark):
    huge = "w" * 3_000_000
    item = " ".join([huge] + [f"t{k}" for k in range(20)])
    benchmark = spark.createDataFrame([(1, item), (2, "short item"), (3, None), (4, "?!")], "item_id bigint, text string")
    filler = " ".join(f"f{k}" for k in range(600))
    rows = [(1, f"{filler}, {item}. {filler}"), (2, "before Short  ITEM! after"), (3, None), (4, ""), (5, filler + " short item"),
            (6, item.replace("w" * 100, "v" * 100)), (7, item)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, found int")
    for shard_words in (decontaminate.SHARD_WORDS, 4):
        found = {r.row.doc_id: r.found for r in decontaminate.decontaminate(docs, benchmark, shard_words=shard_words).collect()}
        assert [found[k].n_hit for k in range(1, 8)] == [21, 2, 0, 0, 2, 20, 21]
        got = {r.row.doc_id: r for r in decontaminate.remove_spans(docs, benchmark, 15, 0.05, ["doc_id"], shard_words).collect()}
        assert got[1].text == f"{filler}, . {filler}" and got[1].n_removed == 21
        assert got[2].text == "before ! after" and got[3].text is None and got[4].text == "" and got[5].text == rows[4][1]
        assert got[7].text == "" and [tuple(s) for s in got[7].removed] == [(0, 20)]
    kept = decontaminate.remove_spans(docs, benchmark)
    assert kept.first().row.asDict().keys() == {"doc_id", "text", "found"}
    assert decontaminate.remove_spans(docs.limit(0), benchmark).count() == 0 == decontaminate.remove_spans(docs, benchmark.limit(0)).where("n_removed > 0").count()
    words = [b"a", b"b" * 65, b"c" * 64]
    assert decontaminate.short_words(b" ".join(words))[::2] == words[::2] and text_words(b" ".join(words)) == words


def test_repeated_ids_are_one_training_text(spark):
    texts = [(k if k % 3 else 0, f"text {k} " + "good words here. " * (k % 7 + 1)) for k in range(900)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(0, 400)], "doc_id bigint, quality int, toxic int")
    seen = []
    plain = quality_mil.Net.fit
    try:
        quality_mil.Net.fit = lambda self, bags, *a, **k: seen.append(len(bags)) or plain(self, bags, *a, **k)
        quality_mil.train(docs, labels)
    finally:
        quality_mil.Net.fit = plain
    chosen = {k for k in range(400) if (k % 3 or k == 0)}
    assert seen and seen[0] <= len(chosen)


def test_repeated_rows_spread_over_files(spark):
    docs = spark.createDataFrame([(7, "the same text")] * 4000 + [(k, f"text {k}") for k in range(8, 100)] + [(None, None)], "doc_id bigint, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store = id_planes.write_ids(docs.repartition(6))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert store.select("part").distinct().count() > 2
    rows = sorted((r.start, r.n_tokens) for r in id_planes.read_ids(store).collect())
    starts = np.cumsum([0] + [n for _, n in rows])
    assert len(rows) == 4093 and [s for s, _ in rows] == starts[:-1].tolist()


def test_portions_of_a_task_are_bounded(spark):
    from collections import defaultdict

    from segue.llm import packing

    lengths = np.random.default_rng(3).integers(1, 1025, 700).tolist()
    rows = [(k, 0, 0, n, 0) for k, n in enumerate(lengths)]
    parts = spark.createDataFrame(rows, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    held = {}
    for portion in (50, packing.PORTION):
        sequences = defaultdict(list)
        for r in packing.pack(parts, portion=portion).collect():
            sequences[r.sequence_id].append((r.offset, r.length, r.doc_id))
        assert sorted(d for s in sequences.values() for _, _, d in s) == list(range(700))
        for s in sequences.values():
            assert sum(n for _, n, _ in s) <= 1024
            assert [o for o, _, _ in sorted(s)] == np.cumsum([0] + [n for _, n, _ in sorted(s)][:-1]).tolist()
        held[portion] = len(sequences)
    assert sum(lengths) / 1024 <= held[packing.PORTION] <= held[50] < 1.2 * sum(lengths) / 1024
