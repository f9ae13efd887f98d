"""Divergence between the sources of a language, by three-dimensional cube partitioning.

Every (lang, source) group and every lang gives each kept term a smoothed share in billionths,
``1 + floor(10**9 (count + 5) / (N + 5 V))``. The work on pairs of groups is a cube: group blocks x group blocks x term
blocks. A slice (group block, term block) is replicated to the cells of its row and column, a cell (group block, group
block, term block) holds two small dense matrices and sums the absolute differences of its own terms for all its pairs,
and the partial sums are added along the term axis. A cell is ``GROUP_BLOCK`` groups by ``TERM_BLOCK`` terms, about,
whatever the corpus; terms that a group does not have are filled in from its smallest share, so slices carry only counts
that occur.

Terms are counted in every task before the shuffle (``HELD_TERMS`` entries, ``HELD_BYTES`` of text at most between two
emissions), so a source with a third of all rows is as many rows as tasks make of it. All arithmetic is in whole numbers;
it is exact while N + 5 V of a language is below 9 * 10**13.

Null text, lang and source are the empty string. Repeated rows count as documents of their own. Texts without terms add
their group, with no counts; a language without kept terms has pairs of value 0; a language of one source has no pairs.
Ties are ranked by item in UTF-8 order. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, small_batches, stored, texts_of

LEAST_DOCS = 30
TOP_TERMS = 50
ADD = 5
GROUP_BLOCK, TERM_BLOCK = 16, 4096
HELD_TERMS, HELD_BYTES = 400_000, 64 << 20

LETTER_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
"""Lower-cases A-Z and blanks every ASCII byte that is no letter."""


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs; a row with a null term for every group."""
    small_batches(docs.sparkSession)
    kind = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def emit(held):
        for (lang, source), (counts, docs) in held.items():
            terms = list(counts)
            for at in range(0, max(1, len(terms)), 50_000):
                some = terms[at : at + 50_000] if terms else []
                extra = at == 0
                names = pa.array([None] * extra + [t.decode() for t in some], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(names)), pa.array([source] * len(names)), names,
                     pa.array([0] * extra + [counts[t] for t in some], pa.int64()),
                     pa.array([0] * extra + [docs[t] for t in some], pa.int64())], schema=kind)

    def run(batches):
        held, size, entries = {}, 0, 0
        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts_of(batch.column("text"))):
                counts, docs = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(counts)
                terms = text.translate(LETTER_BYTES).split()
                counts.update(terms)
                docs.update(set(terms))
                entries += len(counts) - before
                size += len(text)
                if entries > HELD_TERMS or size > HELD_BYTES:
                    yield from emit(held)
                    held, size, entries = {}, 0, 0
        yield from emit(held)

    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = texts.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column) -> Column:
    """1 + floor(10**9 (count + ADD) / total) in long division, so that nothing overflows."""
    top = count + ADD
    div = lambda a, b: F.call_function("div", a, b)
    rest = (top % total) * 100_000
    return 1 + div(top, total) * 1_000_000_000 + div(rest, total) * 10_000 + div((rest % total) * 10_000, total)


def _cells(cube: DataFrame, group_block: int) -> DataFrame:
    """Sums of absolute differences of all pairs of a cell's two group blocks, over the terms of its block."""
    kind = pa.schema([("lang", pa.string()), ("g", pa.int64()), ("h", pa.int64()), ("value", pa.int64())])

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lang, low, high, _ = (k.as_py() for k in key)
        group, place, value = (table[c].to_numpy() for c in ("g", "at", "p"))
        heads = place < 0
        order = np.argsort(group[heads])
        groups, base = group[heads][order], value[heads][order]
        shares = np.repeat(base[:, None], int(table["terms"].to_numpy().max()), axis=1)
        shares[np.searchsorted(groups, group[~heads]), place[~heads]] = value[~heads]
        first, second = (np.flatnonzero(groups // group_block == k) for k in (low, high))
        out = {"lang": [], "g": [], "h": [], "value": []}
        for a in first:
            others = second if low < high else second[second > a]
            out["lang"] += [lang] * len(others)
            out["g"] += [groups[a]] * len(others)
            out["h"] += groups[others].tolist()
            out["value"] += np.abs(shares[others] - shares[a]).sum(axis=1).tolist()
        return pa.table(out, kind)

    return cube.groupBy("lang", "low", "high", "block").applyInArrow(add, "lang string, g bigint, h bigint, value bigint")


def divergences(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, group_block: int = GROUP_BLOCK,
                term_block: int = TERM_BLOCK) -> DataFrame:
    """Rows lang, source, part, item, value, rank.

    Part ``pair``: every other source of the lang and the sum over kept terms of the absolute differences of shares.
    Part ``term``: kept terms that the group has with a share above the lang's, the ``top`` first ones.
    """
    counts = stored(term_counts(docs), "divergence-counts")
    kept = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    kept = kept.where(F.col("docs") >= least_docs).drop("docs")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    kept = kept.join(langs, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / term_block)))
    place = F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1
    kept = kept.repartition("lang", "block")  # else the join's partitions by lang would do, one task for all terms of one
    kept = stored(kept.withColumn("at", place), "divergence-kept")
    own = counts.where("term IS NOT NULL").drop("docs").join(kept, ["lang", "term"])
    sums = own.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = counts.where("term IS NULL").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["group_n", "v", "lang_n"]).select(
        "lang", "source", "v", (F.col("group_n") + ADD * F.col("v")).alias("size"),
        (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("bigint").alias("g"))
    blocks = (F.floor((F.count("*").over(Window.partitionBy("lang")) - 1) / group_block) + 1).alias("group_blocks")
    groups = stored(groups.select("*", blocks), "divergence-groups")

    shares = own.join(groups.select("lang", "source", "g", "size", "group_blocks"), ["lang", "source"])
    shares = stored(shares.select("lang", "source", "g", "group_blocks", "term", "block", "at", share(F.col("n"), F.col("size")).alias("p"),
                                  share(F.col("total"), F.col("lang_n") + ADD * F.col("v")).alias("q")), "divergence-shares")
    spans = kept.groupBy("lang", "block").agg(F.count("*").alias("terms"))
    every = groups.select("lang", "v").distinct().select(
        "lang", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.ceil(F.col("v") / term_block) - 1))).alias("block"))
    spans = every.join(spans, ["lang", "block"], "left").na.fill(0, ["terms"])
    base = F.when(F.col("size") > 0, share(F.lit(0), F.col("size"))).otherwise(0)
    heads = groups.join(spans, "lang").select("lang", "g", "group_blocks", "block", "terms", F.lit(-1).alias("at"), base.alias("p"))
    slices = heads.unionByName(shares.select("lang", "g", "group_blocks", "block", F.lit(0).cast("bigint").alias("terms"), "at", "p"))
    mine = F.floor(F.col("g") / group_block)
    cube = slices.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("group_blocks") - 1)).alias("other")).select(
        "lang", F.least(mine, F.col("other")).alias("low"), F.greatest(mine, F.col("other")).alias("high"), "block", "g", "at", "p", "terms")
    total = _cells(cube, group_block).groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    both = total.unionByName(total.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), "value"))
    name = groups.select("lang", "g", "source")
    pairs = both.join(name, ["lang", "g"]).join(name.select("lang", F.col("g").alias("h"), F.col("source").alias("item")), ["lang", "h"])

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    forget(counts)
    return pairs.unionByName(terms)
