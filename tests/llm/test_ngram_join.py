"""The grouped prefix join against all pairs: both settings, crowded shingles and groups, repeats, nulls, long texts."""

import random
import re
import string
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from segue.llm import ngram_join

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def plain_links(texts, size, p, q):
    sets, parent = [plain_set(t, size) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and q * len(a & sets[j]) >= p * len(a | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def copies(seed=4, each=40):
    """Originals, chains of copies with more and more words changed, and short texts."""
    rng = random.Random(seed)
    texts = []
    for size in (6, 12, 30, 60, 150, 400):
        first = [f"w{rng.randrange(300)}" for _ in range(size)]
        texts.append(" ".join(first))
        for _ in range(each):
            words = list(rng.choice([first, texts[-1].split()]))
            for _ in range(rng.randrange(1, 2 + size // 30)):
                words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}" if rng.random() < 0.7 else rng.choice(first)
            texts.append(" ".join(words + ["end"] * rng.randrange(2)))
    return [*texts, None, "", " \t", "a b", "A  b\n", "c", "é É", "é É"]


def passages(seed=5, n=120):
    """Texts put together from few passages: shingles that are frequent nearly throughout."""
    rng = random.Random(seed)
    pool = [" ".join(f"p{k}w{i}" for i in range(30)) for k in range(6)]
    return [" ".join(rng.choice(pool) for _ in range(3)) + (f" own{k}" if k % 3 else "") for k in range(n)]


def linked(spark, texts, size, p, q, crowd=64):
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id bigint, text string, key int").repartition(3)
    rows = ngram_join.link_documents(docs, size, p, q, crowd).collect()
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


@pytest.mark.parametrize("size,p,q,crowd", [(3, 90, 100, 64), (5, 4, 5, 2), (3, 4, 5, 64)])
def test_join_equals_all_pairs(spark, size, p, q, crowd):
    texts = copies() + passages()
    want = dict(enumerate(plain_links(texts, size, p, q)))
    assert 20 < len({root for _, root in want.values()}) < len(texts) - 20
    assert linked(spark, texts, size, p, q, crowd) == want


def test_groups_beyond_one_expansion(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "EXPAND", 1)
    monkeypatch.setattr(ngram_join, "CHUNK", 4)
    monkeypatch.setattr(ngram_join, "UNIT", 8)
    texts = passages(6, 60) + copies(7, 12)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    classes = ngram_join.class_components(docs, 3, 4, 5, crowd=3, expand=1)
    want = plain_links([t for t in dict.fromkeys(" ".join((t or "").translate(LOWER).split()) for t in texts) if t], 3, 4, 5)
    assert classes.select("root").distinct().count() == len({root for _, root in want})


def test_frequent_block_in_dissimilar_texts_makes_no_pairs(spark):
    rng = random.Random(2)
    block = " ".join(f"b{k}" for k in range(14))
    texts = [" ".join(f"o{rng.randrange(10**9)}" for _ in range(36)) + " " + block for _ in range(400)]
    blocks = ngram_join.blocks_of(spark.createDataFrame([(t,) for t in texts], "text string"))
    sets = ngram_join.prefixes(blocks, ngram_join.repeated_cells(blocks, 5), 5, 4, 5)
    few, big, _ = ngram_join.meetings(sets, 4, 5, 64, 1024)
    assert few.count() == 0 and big.count() == 0


def test_representatives(spark):
    words = [f"w{k}" for k in range(100)]
    near = " ".join([*words[:50], "other", *words[51:]])  # 91 of 101 shingles are shared
    far = " ".join(w if k % 20 else "other" for k, w in enumerate(words))
    rows = [(3, " ".join(words), 1, None), (2, near, 2, "x"), (1, far, 3, "y"), (None, " ".join(words), 4, "z"), (7, far, 5, "q"),
            (2, near, 2, "x"), (2, near.upper(), 9, "x"), (5, None, 6, ""), (5, None, 6, ""), (6, "", 7, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, number int, `row.key` string")
    kept = ngram_join.representatives(docs, 5, 4, 5)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 5, 6]
    assert ngram_join.representatives(docs.limit(0)).count() == 0 == ngram_join.link_documents(docs.limit(0)).count()


def test_whole_long_texts(spark):
    words = [f"w{k % 9000}x{k // 9000}" for k in range(300_000)]
    late = words[:-3000] + [f"n{k}" for k in range(3000)]
    other = words[:250_000] + [f"m{k}" for k in range(50_000)]
    got = linked(spark, [" ".join(words), " ".join(late), " ".join(other)], 3, 90, 100)
    assert [got[k][1] for k in range(3)] == [0, 0, 2] and got[0][0] == 299_998


def test_coding():
    import numpy as np

    numbers = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64))
    assert (ngram_join.unpack(ngram_join.pack(numbers)) == numbers).all()
    line = b"a b a b a b c"
    assert len(ngram_join.shingle_set(line, 3)) == 3 and len(ngram_join.shingle_set(b"a b", 3)) == 1 and not len(ngram_join.shingle_set(b"", 3))


def test_cells_are_added_up_in_little_memory(monkeypatch):
    rng, kind = np.random.default_rng(3), pa.schema([("block", pa.int64()), ("cells", pa.binary()), ("counts", pa.binary())])
    own = [np.unique(rng.integers(0, 1 << 22, 4000, dtype=np.uint64)) for _ in range(100)]
    times = [(1 + (rng.random(len(c)) < 0.02)).astype(np.uint16) for c in own]
    table = pa.table({"block": range(100), "cells": [ngram_join.pack(c) for c in own], "counts": [t.tobytes() for t in times]}, kind)
    want, peaks = Counter(), []
    for cells, counts in zip(own, times):
        want.update(dict(zip(cells.tolist(), counts.tolist())))
    for size in (1 << 15, 1 << 30):
        monkeypatch.setattr(ngram_join, "SLICE", size)
        tracemalloc.start()
        found = ngram_join.add_up(table)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        got = {b: dict(zip(ngram_join.unpack(c).tolist(), np.frombuffer(t, np.int64).tolist()))
               for b, c, t in zip(*(found[n].to_pylist() for n in ("block", "cells", "totals")))}
        assert got == {b: x for b, c in enumerate(own) if (x := {v: want[v] for v in c.tolist() if want[v] > 1})}
        peaks.append(peak)
    assert peaks[0] * 2 < peaks[1]  # the whole bucket in one slice, as before
