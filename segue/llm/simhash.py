"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is cut into ``SEGMENTS`` segments and mapped to the vector of their bit counts. Flipping one bit moves the
vector by one step along one axis, so the Manhattan distance of two vectors is at most the Hamming distance of the
fingerprints. Two vectors at distance 2 or less share a grid cell at distance 1 or less from both; each distinct
fingerprint therefore visits its own cell and the cells one step away (at most 2 * SEGMENTS), fingerprints that meet in
a cell are candidates, and their Hamming distance is then checked exactly.

Only distinct fingerprints take part, so copies never meet each other. A cell with more than ``CROWD`` visitors would give
too many pairs; its visitors go another exact way: each visits the 65 values within one bit of it. All visitors of one
value differ by 2 bits or less among themselves, they are at most 65, and any two fingerprints within 2 bits share a
value, so linking every visitor to the smallest one loses no link and makes no pairs. Components are found with
alternating large-star and small-star steps over stored edge tables.

Null and empty texts have fingerprint zero and are linked like any other. An empty table gives no rows. Repeated rows share a component. A null
doc_id takes part, but is the component's id only if no other id is in it. Input columns of any name stay in ``row``.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, quoted, spaced_words, stored

SHINGLE = 3
SEED = 42
SEGMENTS = 16
DISTANCE = 2
CROWD = 64
"""Visitors of a cell up to which all pairs in it are compared."""


def fingerprint(text: bytes | None) -> int:
    """64-bit SimHash of the word shingles, as a signed number."""
    words = spaced_words(text)
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        return int(np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64).view(np.int64)[0])
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - SHINGLE] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Columns ``row`` and ``found.fp``."""
    return annotate(docs, "fp bigint", lambda texts: {"fp": [fingerprint(t) for t in texts]}, keep)


def visited(distinct: DataFrame) -> DataFrame:
    """Grid cells that each fingerprint visits: its own and those one step away; a cell is one number in base (width + 1)."""
    width = 64 // SEGMENTS
    counts = [F.bit_count(F.shiftright("fp", width * s).bitwiseAND(F.lit((1 << width) - 1))) for s in range(SEGMENTS)]
    place = [F.lit((width + 1) ** s).cast("bigint") for s in range(SEGMENTS)]
    own = sum((c * p for c, p in zip(counts, place)), F.lit(0).cast("bigint"))
    steps = [F.lit(0).cast("bigint")]
    steps += [F.when(c < width, p) for c, p in zip(counts, place)] + [F.when(c > 0, -p) for c, p in zip(counts, place)]
    return distinct.select("fp", F.explode(F.array_compact(F.array(*steps))).alias("step")).select(
        "fp", (own + F.col("step")).alias("cell"))


def links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges ``a``, ``b`` over distinct fingerprints ``fp`` whose components are those of all links of 2 bits or less."""
    visits = visited(distinct)
    met = stored(visits.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"), "simhash-cells")
    few = visits.join(met.where(F.col("n") <= crowd).select("cell"), "cell")
    left, right = few.select("cell", F.col("fp").alias("a")), few.select("cell", F.col("fp").alias("b"))
    near = left.join(right, "cell").where(
        (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)).select("a", "b")
    crowded = visits.join(met.where(F.col("n") > crowd).select("cell"), "cell", "left_semi").select("fp").distinct()
    masks = F.array(F.lit(0).cast("bigint"), *[F.lit(v - (1 << 64) if v >> 63 else v).cast("bigint")
                                               for v in (1 << k for k in range(64))])
    around = crowded.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("value"))
    hubs = around.groupBy("value").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = hubs.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return near.unionByName(stars).distinct()


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """Smallest node reachable over edges ``a``, ``b`` of numbers: one row ``node``, ``root`` for every node with an edge.

    Alternates large-star and small-star steps until nothing changes; the edges never outgrow the input. Groups are
    combined before the shuffle (``min``), the joins back are plain and left to adaptive skew handling.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star-edges")
    mark = None
    for _ in range(limit):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, "star-large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b"), "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "star-small")
        seen = now.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = seen
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, keep: list[str] | None = None, crowd: int = CROWD) -> DataFrame:
    """Columns ``row``, ``fp``, ``root`` and ``component_id`` for every document.

    ``root`` names the component by its smallest fingerprint, ``component_id`` is the smallest doc_id in it.
    """
    marked = fingerprints(docs, keep)
    marked = stored(marked.select("row", F.col("found.fp").alias("fp")), "simhash-docs")
    classes = stored(marked.groupBy("fp").agg(F.min("row.doc_id").alias("least"), F.count("*").alias("n")), "simhash-classes")
    roots = components(links(classes.select("fp"), crowd)).withColumnRenamed("node", "fp")
    linked = classes.join(roots, "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = linked.join(least, "root").select("fp", "root", "component_id")
    alone = F.col("root").isNull()
    named = stored(classes.join(linked, "fp", "left").select(
        "fp", "n", F.coalesce("root", "fp").alias("root"),
        F.when(alone, F.col("least")).otherwise(F.col("component_id")).alias("component_id")), "simhash-named")
    return spread_join(marked, named, "fp", "n").select("row", "fp", "root", "component_id")


def spread_join(rows: DataFrame, named: DataFrame, key: str, size: str) -> DataFrame:
    """Join rows to the one entry of their key. Keys that hold over one row in a thousand are fewer than a thousand and
    are broadcast, so no task gets all rows of one; the others are joined by a shuffle."""
    total = named.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    hot = F.broadcast(named.where(F.col(size) * 1000 > total))
    rest = rows.join(hot.select(key), key, "left_anti").join(named.where(F.col(size) * 1000 <= total), key)
    return rows.join(hot, key).unionByName(rest)


def representatives(docs: DataFrame) -> DataFrame:
    """One document of each component, with all its columns: the smallest doc_id, then the first row stored."""
    number = "row_number_of_simhash"
    while number in docs.columns:
        number += "_"
    numbered = stored(docs.withColumn(number, F.monotonically_increasing_id()), "simhash-input")
    marked = stored(near_duplicates(numbered, ["doc_id", number]).select(
        "root", F.col("row.doc_id").alias("doc_id"), F.col(f"row.{number}").alias(number)), "simhash-marked")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", number)
    least = marked.groupBy("root").agg(F.min(first).alias("first"), F.count("*").alias("n"))
    dropped = spread_join(marked, stored(least, "simhash-least"), "root", "n").where(F.col("first")[number] != F.col(number)).select(number)
    return numbered.join(dropped, number, "left_anti").select(*[F.col(quoted(c)) for c in docs.columns])
