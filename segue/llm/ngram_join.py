"""Similarity join on word n-grams: a grouped prefix join.

Two texts link when their sets of word shingles have a Jaccard similarity of p / q or more. No link is missed:

1. Texts of one word sequence are one class; classes are packed into blocks of some megabytes.
2. Shingles are counted over all classes. Every block sends its distinct shingles (the upper ``CELL_BITS`` of their hashes)
   to ranges of hash values, where they are added up, and gets back those met more than once.
3. Every set is ordered by these counts, rare shingles first, then by hash. A partner of a set of n shingles shares at least
   t = ceil(p n / q) of them, so it shares one of the first n - t + 1, the prefix. Shingles met once link nothing and are
   not listed; sets that list none have no partner.
4. Sets with an identical prefix and size are one group. Groups that meet at a listed shingle are filtered by the bounds on
   size and place and, groups of one, by a parity bitmap: the bits in which two bitmaps differ are at most the shingles in
   which the sets differ. The pairs that are left are expanded to members, and so are groups with themselves; members pass
   the bitmap bound and are verified on whole sets.

A shingle, group or pair of groups with more than ``CROWD`` members is compared with its most central member first. Of the
others, only pairs in different components so far are compared, those outside the largest component against all, in chunks;
components are all that is asked for. As rare shingles come first by exact counts, a shingle is crowded only among texts
that consist of frequent shingles nearly throughout.

Sets hold 64-bit hashes of shingles. Texts with fewer words than a shingle are one shingle. Null texts and texts without
words have an empty set and link with nothing. Repeated rows link with each other if they have words. A null doc_id takes
part, but names a component only if no other id is in it. Very long texts are blocks of their own. An empty table gives an
empty result. Columns other than doc_id and text are not read; ``representatives`` keeps them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import annotate, forget, quoted, small_batches, spaced_words, stored, texts_of
from .simhash import components, spread_join

SHINGLE, P, Q = 3, 90, 100
SEED = 42
CELL_BITS = 40
BLOCK_BYTES, BLOCK_DOCS = 2 << 20, 1 << 13
BUCKET = 2_000_000
"""Shingles of a counting bucket, about."""
SLICE = 1 << 17
"""Shingles of a bucket that are sorted at once, about."""
WORDS = 8
"""64-bit words of a parity bitmap."""
CROWD = 64
CENTRES = 16
"""Members from which the central one is told."""
EXPAND = 1024
"""Member pairs up to which a pair of groups is expanded at once."""
CHUNK = 1024
UNIT = 256
"""Pairs verified together."""
CACHE = 4 << 20
"""Shingles of sets that a verifying task keeps."""


def sequence_key(line: bytes) -> bytes:
    return hashlib.blake2b(line, digest_size=16).digest()


def shingle_set(line: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles of space-joined words."""
    words = line.split(b" ") if line else []
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(line, SEED + 1)] if words else [], np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - size + 1
    mixed = own[:n].copy()
    for k in range(1, size):
        mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + own[k : k + n]
    mixed = (mixed ^ mixed >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ mixed >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return np.unique(mixed ^ mixed >> np.uint64(31))


def pack(numbers: np.ndarray) -> bytes:
    """Ascending numbers as byte planes of their differences; the upper planes are zeros and vanish in a compressed shuffle."""
    steps = np.diff(numbers.astype(np.uint64), prepend=np.uint64(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1), dtype=np.uint64)


def parity_bitmap(hashes: np.ndarray) -> list[int]:
    odd = np.bincount((hashes & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def keyed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``row`` (the columns ``keep``) and ``found.key``, the digest of the word sequence; null without words."""

    def keys(texts):
        lines = [b" ".join(spaced_words(t)) for t in texts]
        return {"key": [sequence_key(line) if line else None for line in lines]}

    return annotate(docs, "key binary", keys, keep)


def blocks_of(docs: DataFrame) -> DataFrame:
    """The distinct word sequences in blocks: block, keys, contents (compressed space-joined words), n_words."""
    small_batches(docs.sparkSession)

    def local(batches):
        squeeze, seen = zstandard.ZstdCompressor(level=1).compress, set()
        for batch in batches:
            keys, contents = [], []
            for text in texts_of(batch.column("text")):
                line = b" ".join(spaced_words(text))
                key = sequence_key(line)
                if line and key not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(key)
                    keys.append(key)
                    contents.append(squeeze(line))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(contents, pa.binary())], ["key", "content"])

    kind = pa.schema([("block", pa.int64()), ("keys", pa.list_(pa.binary())), ("contents", pa.list_(pa.binary())), ("n_words", pa.int64())])

    def gather(batches):
        from pyspark import TaskContext

        block, last, size, words = TaskContext.get().partitionId() << 20, None, 0, 0
        keys, contents, expand = [], [], zstandard.ZstdDecompressor().decompress

        def row():
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((block, keys, contents, words), kind)], schema=kind)

        for batch in batches:
            for key, content in zip(batch.column("key").to_pylist(), batch.column("content").to_pylist()):
                if key != last:
                    line = expand(content)
                    if keys and (size + len(line) > BLOCK_BYTES or len(keys) == BLOCK_DOCS):
                        yield row()
                        block, keys, contents, size, words = block + 1, [], [], 0, 0
                    last = key
                    keys.append(key)
                    contents.append(content)
                    size += len(line)
                    words += line.count(b" ") + 1
        if keys:
            yield row()

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(local, "key binary, content binary")
    return found.repartition("key").sortWithinPartitions("key").mapInArrow(
        gather, "block bigint, keys array<binary>, contents array<binary>, n_words bigint")


def _lines(contents) -> list[bytes]:
    expand = zstandard.ZstdDecompressor().decompress
    return [expand(c) for c in contents]


def add_up(table: pa.Table) -> pa.Table:
    """Cells of one bucket (block, cells, counts) that all blocks together hold more than once: block, cells, totals.

    They are added up slice by slice, so that what sorting needs is small against the bucket.
    """
    cells = [unpack(c.as_py()) for c in table["cells"]]
    counts = [np.frombuffer(c.as_buffer(), np.uint16) for c in table["counts"]]
    low, high = min(int(c[0]) for c in cells), max(int(c[-1]) for c in cells) + 1
    width = -(-(high - low) // max(1, sum(map(len, cells)) // SLICE))
    cuts = np.arange(low, high + width, width, np.uint64)
    at = [np.searchsorted(c, cuts) for c in cells]
    more = [[] for _ in cells]
    for k in range(len(cuts) - 1):
        parts = [c[a[k] : a[k + 1]] for c, a in zip(cells, at)]
        every, place = np.unique(np.concatenate(parts), return_inverse=True)
        weights = np.concatenate([n[a[k] : a[k + 1]] for n, a in zip(counts, at)])
        totals = np.bincount(place, weights=weights, minlength=len(every)).astype(np.int64)[place]
        for part, found, here in zip(parts, more, np.split(totals, np.cumsum([len(x) for x in parts])[:-1])):
            if (here > 1).any():
                found.append((part[here > 1], here[here > 1]))
    out = {"block": [], "cells": [], "totals": []}
    for block, found in zip(table["block"].to_pylist(), more):
        if found:
            out["block"].append(block)
            out["cells"].append(pack(np.concatenate([c for c, _ in found])))
            out["totals"].append(np.concatenate([t for _, t in found]).tobytes())
    return pa.table(out, pa.schema([("block", pa.int64()), ("cells", pa.binary()), ("totals", pa.binary())]))


def repeated_cells(blocks: DataFrame, shingle: int) -> DataFrame:
    """For each block, the cells of its shingles that the corpus holds more than once: block, cells, totals."""
    total = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first()["n"]
    buckets = max(16, -(-total // BUCKET))
    shift = np.uint64(64 - CELL_BITS)

    def count(batches):
        for batch in batches:
            for block, contents in zip(batch.column("block").to_pylist(), batch.column("contents").to_pylist()):
                cells = np.concatenate([shingle_set(line, shingle) >> shift for line in _lines(contents)])
                cells, counts = np.unique(cells, return_counts=True)
                cuts = np.array([(k << CELL_BITS) // buckets for k in range(buckets + 1)], np.uint64)
                at = np.searchsorted(cells, cuts)
                used = np.flatnonzero(np.diff(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used, pa.int32()), pa.array([block] * len(used), pa.int64()),
                     pa.array([pack(cells[at[k] : at[k + 1]]) for k in used], pa.binary()),
                     pa.array([counts[at[k] : at[k + 1]].astype(np.uint16).clip(0, BLOCK_DOCS).tobytes() for k in used], pa.binary())],
                    ["bucket", "block", "cells", "counts"])

    sent = blocks.select("block", "contents").mapInArrow(count, "bucket int, block bigint, cells binary, counts binary")
    return sent.groupBy("bucket").applyInArrow(add_up, "block bigint, cells binary, totals binary")


SETS = "number bigint, key binary, size int, prefix binary, shingles array<bigint>, places array<int>, bits array<bigint>"


def prefixes(blocks: DataFrame, cells: DataFrame, shingle: int, p: int, q: int) -> DataFrame:
    """For every class: number, key, size of its set, digest of prefix and size, listed shingles with places, bitmap."""
    shift = np.uint64(64 - CELL_BITS)
    kind = pa.schema([("number", pa.int64()), ("key", pa.binary()), ("size", pa.int32()), ("prefix", pa.binary()),
                      ("shingles", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("bits", pa.list_(pa.int64()))])

    def order(block: pa.Table, known: pa.Table) -> pa.Table:
        parts = sorted(((unpack(c), t) for c, t in zip(known["cells"].to_pylist(), known["totals"].to_pylist())), key=lambda x: x[0][0])
        cell = np.concatenate([c for c, _ in parts] + [np.array([1 << 63], np.uint64)])
        total = np.concatenate([np.frombuffer(t, np.int64) for _, t in parts] + [np.array([1])])
        rows = []
        for key, line in zip(block["keys"][0].as_py(), _lines(block["contents"][0].as_py())):
            own = shingle_set(line, shingle)
            at = np.searchsorted(cell, own >> shift)
            met = np.where(cell[at] == own >> shift, total[at], 1)
            first = len(own) - (-(-p * len(own) // q)) + 1
            take = np.argsort(met, kind="stable")[:first]
            listed = np.flatnonzero(met[take] > 1)
            head = own[take]
            rows.append({"key": key, "size": len(own), "prefix": sequence_key(head.tobytes() + len(own).to_bytes(8, "little")),
                         "shingles": head[listed].view(np.int64), "places": listed, "bits": parity_bitmap(own) if len(listed) else []})
        start = block["block"][0].as_py() * BLOCK_DOCS
        out = {c: [r[c] for r in rows] for c in ("key", "size", "prefix", "shingles", "places", "bits")}
        return pa.table({"number": range(start, start + len(rows))} | out, kind)

    return blocks.select("block", "keys", "contents").groupBy("block").cogroup(cells.groupBy("block")).applyInArrow(order, SETS)


def _apart(a: Column, b: Column) -> Column:
    """Bits in which two bitmaps differ."""
    return sum((F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(WORDS)), F.lit(0))


def _near(a: str, b: str, p: int, q: int) -> Column:
    """Bounds that every similar pair meets at its first common shingle: sizes, what follows it and, where both are there,
    bitmaps."""
    size, other = F.col(f"{a}.size").cast("bigint"), F.col(f"{b}.size").cast("bigint")
    need = F.expr(f"({p} * cast({a}.size + {b}.size as bigint) + {p + q - 1}) div {p + q}")
    return (q * F.least(size, other) >= p * F.greatest(size, other)) & \
        (F.least(size - F.col(f"{a}.place"), other - F.col(f"{b}.place")) >= need) & \
        (F.coalesce(_apart(F.col(f"{a}.bits"), F.col(f"{b}.bits")), F.lit(0)) <= size + other - 2 * need)


def stars(big: DataFrame, p: int, q: int) -> DataFrame:
    """Of every crowded key, its most central member with all others.

    Central is who differs least, by bitmaps, from a few members taken by hash. The choice changes the work, not the result.
    """
    order = Window.partitionBy("name").orderBy(F.xxhash64("number"))
    some = big.select("name", "bits", F.row_number().over(order).alias("turn")).where(F.col("turn") <= CENTRES)
    some = some.groupBy("name").agg(F.collect_list("bits").alias("others"))
    far = F.aggregate("others", F.lit(0), lambda total, other: total + _apart(other, F.col("bits")))
    entry = F.struct("number", "size", "place", "bits")
    hubs = big.join(some, "name").groupBy("name").agg(F.min_by(entry, F.struct(far, "number")).alias("hub")).select("name", "hub.*")
    met = big.alias("a").join(hubs.alias("b"), (F.col("a.name") == F.col("b.name")) & (F.col("a.number") != F.col("b.number"))
                              & _near("a", "b", p, q))
    return met.select(F.least("a.number", "b.number").alias("a"), F.greatest("a.number", "b.number").alias("b"))


def rest(big: DataFrame, roots: DataFrame, p: int, q: int) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs of a crowded key in different components: those outside its largest one against all, chunk by chunk. A pair is
    given by its first common shingle only."""
    rooted = big.join(roots.withColumnRenamed("node", "number"), "number", "left")
    rooted = stored(rooted.withColumn("root", F.coalesce("root", "number")), "ngram-rooted")
    sizes = rooted.groupBy("name", "root").agg(F.count("*").alias("n"))
    most = sizes.groupBy("name").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"))
    most = stored(most.where("most < n").withColumn("chunks", F.ceil((F.col("n") - F.col("most")) / CHUNK)).select("name", "main", "chunks"),
                  "ngram-open")
    left = rooted.join(most, "name").where("root <> main").withColumn("chunk", F.pmod(F.xxhash64("number"), "chunks"))
    right = rooted.join(most, "name").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    once = (F.col("b.root") == F.col("b.main")) | (F.col("a.number") < F.col("b.number"))
    met = left.alias("a").join(right.alias("b"), (F.col("a.name") == F.col("b.name")) & (F.col("a.chunk") == F.col("b.chunk"))
                               & (F.col("a.root") != F.col("b.root")) & once & _near("a", "b", p, q)
                               & ~F.arrays_overlap("a.before", "b.before"))
    return met.select(F.least("a.number", "b.number").alias("a"), F.greatest("a.number", "b.number").alias("b")), [rooted, most]


def meetings(sets: DataFrame, p: int, q: int, crowd: int, expand: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Candidate pairs ``a`` < ``b`` of few, and the members of crowded keys: name, number, size, place,
    bits, and the shingles listed before the key's."""
    some = sets.where(F.size("shingles") > 0).drop("key")
    groups = some.groupBy("prefix").agg(F.min("number").alias("gid"), F.count("*").alias("n"))
    members = stored(some.join(groups, "prefix").drop("prefix"), "ngram-members")
    listed = members.where("number = gid").select(
        "gid", "n", "size", F.when(F.col("n") == 1, F.col("bits")).alias("bits"),
        F.explode(F.arrays_zip("shingles", "places")).alias("at")).select("gid", "n", "size", "bits", "at.*")
    listed = listed.withColumnsRenamed({"shingles": "shingle", "places": "place"})
    met = listed.groupBy("shingle").agg(F.count("*").alias("c")).where("c > 1")
    listed = stored(listed.join(met, "shingle"), "ngram-lists")
    few = listed.where(F.col("c") <= crowd)
    pairs = few.alias("a").join(few.alias("b"), (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.gid") < F.col("b.gid"))
                                & _near("a", "b", p, q))
    pairs = stored(pairs.select(*[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("gid", "n")]).distinct(), "ngram-groups")
    own = members.select("gid", "n", "number", "size", F.lit(0).alias("place"), "bits")
    several = own.where("n > 1")
    wide = F.col("n_a") * F.col("n_b") > expand
    single = pairs.where("n_a = 1 AND n_b = 1").select(F.col("gid_a").alias("a"), F.col("gid_b").alias("b"))
    mixed = pairs.where(~wide & F.expr("n_a > 1 OR n_b > 1"))
    both = mixed.join(own.alias("a"), F.col("gid_a") == F.col("a.gid")).join(
        own.alias("b"), (F.col("gid_b") == F.col("b.gid")) & _near("a", "b", p, q))
    inside = several.where(F.col("n") <= crowd)
    inside = inside.alias("a").join(inside.alias("b"), (F.col("a.gid") == F.col("b.gid")) & (F.col("a.number") < F.col("b.number"))
                                    & _near("a", "b", p, q))
    ends = [F.least("a.number", "b.number").alias("a"), F.greatest("a.number", "b.number").alias("b")]
    found = single.unionByName(both.select(*ends)).unionByName(inside.select(*ends))
    entry = ["number", "size", "place", "bits", "before"]
    own = own.withColumn("before", F.array().cast("array<bigint>"))
    several = own.where("n > 1")
    earlier = F.filter(F.arrays_zip("shingles", "places"), lambda x: x.places < F.col("place"))
    crowded = listed.where(F.col("c") > crowd).select(F.concat(F.lit("s"), F.col("shingle").cast("string")).alias("name"), "gid", "place") \
        .join(members, "gid").withColumn("before", F.transform(earlier, lambda x: x.shingles))
    large = several.where(F.col("n") > crowd).withColumn("name", F.concat(F.lit("g"), F.col("gid").cast("string")))
    name = F.concat_ws("-", "gid_a", "gid_b").alias("name")
    pair = pairs.where(wide).select(name, F.explode(F.array("gid_a", "gid_b")).alias("gid")).join(own, "gid")
    big = crowded.select("name", *entry).unionByName(large.select("name", *entry)).unionByName(pair.select("name", *entry))
    return found, big, [members, listed, pairs]


def verified(pairs: DataFrame, blocks: DataFrame, shingle: int, p: int, q: int) -> DataFrame:
    """The pairs ``a``, ``b`` whose whole sets are similar enough; sets are fetched for units of about ``UNIT`` pairs."""
    pairs = stored(pairs.distinct(), "ngram-pairs")
    units = max(1, pairs.count() // UNIT)
    load = pairs.groupBy("a").agg(F.count("*").alias("n"))
    turn = F.pmod(F.xxhash64("b"), F.greatest(F.lit(1), F.ceil(F.col("n") / UNIT)))
    jobs = stored(pairs.join(load, "a").select(F.pmod(F.xxhash64("a", turn), F.lit(units)).alias("unit"), "a", "b"), "ngram-units")
    wanted = jobs.select(F.col("unit").alias("work"), F.explode(F.array("a", "b")).alias("number")).distinct()
    texts = blocks.select("block", F.posexplode("contents").alias("at", "content")).select(
        (F.col("block") * BLOCK_DOCS + F.col("at")).alias("number"), "content")
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def check(ends: pa.Table, texts: pa.Table) -> pa.Table:
        content = dict(zip(texts["number"].to_pylist(), texts["content"].to_pylist()))
        sets, held, out = {}, 0, []

        def of(number):
            nonlocal held
            if number not in sets:
                if held > CACHE:
                    sets.clear()
                    held = 0
                sets[number] = shingle_set(_lines([content[number]])[0], shingle)
                held += len(sets[number])
            return sets[number]

        for a, b in sorted(zip(ends["a"].to_pylist(), ends["b"].to_pylist())):
            x, y = of(a), of(b)
            shared = len(x) + len(y) - len(np.union1d(x, y))
            if shared and q * shared >= p * (len(x) + len(y) - shared):
                out.append((a, b))
        return pa.table({"a": [a for a, _ in out], "b": [b for _, b in out]}, kind)

    found = jobs.groupBy("unit").cogroup(wanted.join(texts, "number").groupBy("work")).applyInArrow(check, "a bigint, b bigint")
    links = stored(found, "ngram-links")
    forget(pairs, jobs)
    return links


def class_components(docs: DataFrame, shingle: int = SHINGLE, p: int = P, q: int = Q, crowd: int = CROWD,
                     expand: int = EXPAND) -> DataFrame:
    """For every distinct word sequence: key, size of its set, and the number ``root`` of its component."""
    blocks = stored(blocks_of(docs), "ngram-blocks")
    sets = stored(prefixes(blocks, repeated_cells(blocks, shingle), shingle, p, q), "ngram-sets")
    few, big, tables = meetings(sets, p, q, crowd, expand)
    big = stored(big, "ngram-crowded")
    edges = verified(few.unionByName(stars(big, p, q)), blocks, shingle, p, q)
    roots = components(edges)
    if not big.isEmpty():
        pairs, more = rest(big, roots, p, q)
        late = verified(pairs, blocks, shingle, p, q)
        if not late.isEmpty():
            roots = components(edges.unionByName(late))
        tables += [late, *more]
    found = sets.select("number", "key", "size").join(roots.withColumnRenamed("node", "number"), "number", "left")
    out = stored(found.select("key", "size", F.coalesce("root", "number").alias("root")), "ngram-classes")
    forget(blocks, sets, big, edges, *tables)
    return out


def _named(ids: DataFrame, classes: DataFrame, first: Column) -> DataFrame:
    """key, size, n (rows of the key) and ``first``, the least value of ``first`` over the component."""
    least = ids.where("key IS NOT NULL").groupBy("key").agg(F.min(first).alias("least"), F.count("*").alias("n"))
    named = classes.join(least, "key")
    heads = named.groupBy("root").agg(F.min("least").alias("first"))
    return stored(named.join(heads, "root").select("key", "size", "n", "first"), "ngram-named")


def link_documents(docs: DataFrame, shingle: int = SHINGLE, p: int = P, q: int = Q, crowd: int = CROWD) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included)."""
    ids = stored(keyed(docs, ["doc_id"]).select(F.col("row.doc_id").cast("bigint").alias("doc_id"), "found.key"), "ngram-ids")
    named = _named(ids, class_components(docs, shingle, p, q, crowd), F.col("doc_id"))
    linked = spread_join(ids.where("key IS NOT NULL"), named, "key", "n")
    return linked.select("doc_id", F.col("size").cast("bigint").alias("n_shingles"), F.col("first").alias("component_id")).unionByName(
        ids.where("key IS NULL").select("doc_id", F.lit(0).cast("bigint").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def representatives(docs: DataFrame, shingle: int = SHINGLE, p: int = P, q: int = Q, crowd: int = CROWD,
                    classes: DataFrame | None = None, wordless: bytes | None = None) -> DataFrame:
    """One document of each component, with all its columns: the smallest doc_id (null last), of repeated rows any one.

    Documents without words stay, each by itself, unless ``wordless`` is their key. ``classes`` are other components than
    those of ``class_components``. No copy of the texts is written: those that go are few or many rows of (doc_id, key),
    removed by an anti join.
    """
    columns = [quoted(c) for c in docs.columns]
    name = [F.col("row.doc_id").isNull().alias("absent"), F.coalesce(F.col("row.doc_id").cast("bigint"), F.lit(0)).alias("doc"),
            F.coalesce("found.key", F.lit(wordless)).alias("key")]
    ids = stored(keyed(docs, ["doc_id"]).select(*name), "ngram-ids")
    classes = class_components(docs, shingle, p, q, crowd) if classes is None else classes
    named = _named(ids, classes, F.struct("absent", "doc", "key"))
    rows = ids.where("key IS NOT NULL").groupBy("absent", "doc", "key").agg(F.count("*").alias("rows")).join(named, "key")
    keeps = F.col("first") == F.struct("absent", "doc", "key")
    rows = stored(rows.select("absent", "doc", "key", "rows", keeps.alias("keeps")), "ngram-rows")
    whole = keyed(docs, docs.columns).select("row", *name)
    stay = whole.join(rows.where("NOT keeps OR rows > 1").select("absent", "doc", "key"), ["absent", "doc", "key"], "left_anti")
    out = stay.select("row")
    twice = rows.where("keeps AND rows > 1").select("absent", "doc", "key")
    if not twice.isEmpty():
        again = whole.join(twice, ["absent", "doc", "key"]).groupBy("absent", "doc", "key").agg(
            F.min_by("row", F.xxhash64(*[F.col("row").getField(c) for c in docs.columns])).alias("row"))
        out = out.unionByName(again.select("row"))
    forget(ids, named)
    return out.select(*[F.col(f"row.{c}").alias(n) for c, n in zip(columns, docs.columns)])
