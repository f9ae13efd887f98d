"""Near copies by two methods: SimHash fingerprints (``simhash``) and shared shingles (``ngram_join``), in common components.

Two texts link if their fingerprints differ in ``simhash.DISTANCE`` bits or less, or if the Jaccard similarity of their
shingle sets is p / q or more. Both methods depend on the word sequence alone, so components are joined over its classes.
Texts without words have fingerprint zero and are linked like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngram_join
from .common import annotate, forget, spaced_words, stored
from .simhash import components, fingerprint, links, spread_join

WORDLESS = b""
"""Key of the texts without words; those of word sequences have 16 bytes."""


def printed_classes(docs: DataFrame) -> DataFrame:
    """For every distinct word sequence, the empty one too: ``key`` and SimHash ``fp``."""

    def both(texts):
        lines = [b" ".join(spaced_words(t)) for t in texts]
        return {"key": [ngram_join.sequence_key(line) if line else WORDLESS for line in lines], "fp": [fingerprint(line) for line in lines]}

    return annotate(docs, "key binary, fp bigint", both, ["doc_id"]).select("found.*").groupBy("key").agg(F.min("fp").alias("fp"))


def class_components(docs: DataFrame, shingle: int, p: int, q: int) -> DataFrame:
    """For every distinct word sequence: key, size of its shingle set, and ``root`` of its component by links of both kinds."""
    prints = stored(printed_classes(docs), "near-prints")
    shared = ngram_join.class_components(docs, shingle, p, q)
    empty = prints.where(F.col("key") == F.lit(WORDLESS)).select("key", F.lit(0).cast("bigint").alias("size"), F.lit(-1).cast("bigint").alias("root"))
    classes = stored(shared.select("key", F.col("size").cast("bigint").alias("size"), "root").unionByName(empty), "near-classes")
    alike = components(links(prints.select("fp").distinct())).select(F.col("node").alias("fp"), F.col("root").alias("print"))
    marked = classes.join(prints, "key").join(alike, "fp", "left").select("root", F.coalesce("print", "fp").alias("print"))
    marked = stored(marked, "near-marked")
    least = stored(marked.groupBy("print").agg(F.min("root").alias("least"), F.count("*").alias("n")), "near-least")
    edges = spread_join(marked, least, "print", "n").where("root <> least").select(F.col("root").alias("a"), F.col("least").alias("b"))
    over = components(edges).select(F.col("node").alias("root"), F.col("root").alias("over"))
    heads = classes.groupBy("root").agg(F.count("*").alias("n")).join(over, "root", "left")
    heads = stored(heads.select("root", "n", F.coalesce("over", "root").alias("over")), "near-heads")
    out = stored(spread_join(classes, heads, "root", "n").select("key", "size", F.col("over").alias("root")), "near-joined")
    forget(prints, shared, classes, marked, least, heads)
    return out


def representatives(docs: DataFrame, shingle: int, p: int, q: int) -> DataFrame:
    """One document of each component, with all its columns: the smallest doc_id (null last), of repeated rows any one."""
    return ngram_join.representatives(docs, shingle, p, q, classes=class_components(docs, shingle, p, q), wordless=WORDLESS)
