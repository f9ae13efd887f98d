"""The near-copy stage of the pipeline: links of fingerprints and of shingle sets in common components."""

from __future__ import annotations

import random

import corpus_pipeline
from segue.llm import ngram_join, simhash


def _alike(a: str, b: str) -> float:
    x, y = (set(ngram_join.shingle_set(t.encode(), 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def _apart(a: str, b: str) -> int:
    return bin((simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())) & (1 << 64) - 1).count("1")


def test_both_kinds_of_links_count(spark, sf):
    draw, pair = random.Random(7), None
    while pair is None:  # close by fingerprint, not by shingles
        words = [f"w{draw.randrange(10**6)}" for _ in range(47)]
        one, other = " ".join(words), " ".join(words[:23] + ["changed"] + words[24:])
        if _apart(one, other) <= 2 and _alike(one, other) < 0.8:
            pair = one, other
    longer = pair[1] + " and six more words at end"  # close to the second by shingles only
    assert _alike(pair[1], longer) >= 0.8 and _apart(pair[0], longer) > 2 and _apart(pair[1], longer) > 2
    other = " ".join(f"x{k}" for k in range(40))
    rows = [(5, longer), (3, pair[1]), (1, pair[0]), (2, other), (7, None), (8, " \n"), (4, pair[0].upper())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, sf).collect()) == [1, 2, 7]


def test_no_links_and_no_rows(spark, sf):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e f"), (None, "g")], "doc_id bigint, text string")
    assert corpus_pipeline.near(spark, docs, sf).count() == 3
    assert corpus_pipeline.near(spark, docs.limit(0), sf).count() == 0
