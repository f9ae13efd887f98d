"""The divergence cube against a plain count, with blocks so small that every axis is cut."""

import random
import re
from collections import Counter, defaultdict

import pytest

from segue.llm import source_divergence


def plain(rows, least, top):
    counts, docs, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in {g[0] for g in counts}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        own = {s: {t: c[t] for t in kept} for (k, s), c in counts.items() if k == lang}
        for s in own:
            langs[lang].update(own[s])

        def shares(c):
            size = sum(c.get(t, 0) for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c.get(t, 0) + 5) // size for t in kept}

        q = shares(langs[lang])
        p = {s: shares(c) for s, c in own.items()}
        for s in own:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if own[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


@pytest.mark.parametrize("groups,terms", [(2, 4), (3, 1000), (16, 7)])
def test_cube_equals_plain_counts(spark, groups, terms):
    rng = random.Random(3)
    vocabulary = ["the", "The", "é", "zz", "a1b", "über", "x-y"] + [f"{a}{b}" for a in "abcdefgh" for b in "klm"]
    rows = [(" ".join(rng.choices(vocabulary, k=rng.randrange(30))), rng.choice(["en", "de"]), f"s{rng.randrange(7)}") for _ in range(300)]
    rows += [(None, "fr", "s1"), ("", "fr", "s2"), ("seldom", "fr", None), (None, None, None), ("alone", "it", "s1")] + [("twice the same", "en", "s0")] * 40
    docs = spark.createDataFrame([(*r, "t", 0) for r in rows], "text string, lang string, source string, term string, n int").repartition(5)
    found = source_divergence.divergences(docs, 5, 6, groups, terms).collect()
    assert sorted(map(tuple, found)) == plain(rows, 5, 6)
    assert source_divergence.divergences(docs.limit(0)).count() == 0


def test_shares_do_not_overflow(spark):
    from pyspark.sql import functions as F

    cases = [(0, 7), (10**12, 9 * 10**13), (3, 8), (9 * 10**13 - 5, 9 * 10**13), (12345678901, 23456789012345)]
    rows = spark.createDataFrame(cases, "n bigint, size bigint").select("n", "size", source_divergence.share(F.col("n"), F.col("size")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.n + 5) // r.size for r in rows)
