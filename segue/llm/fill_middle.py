"""Fill-in-middle transformation by secondary-sort assembly.

A text is cut into units (lines); two keyed hashes of the doc_id choose where prefix and middle end. Tasks emit the segments
as pieces of whole units (``PIECE_BYTES``, longer units are cut), keyed by document and place in the output.
Pieces are repartitioned by document and sorted within partitions; a stream over them builds every output piece by piece,
feeding an incremental digest. The same stream parses the output for its sentinels and gives each piece its place in the
restored text; a second sort within the same partitions, without another shuffle, streams those into a second digest. No
text is put together in memory: a task holds a batch of pieces. A document is a row: rows of one doc_id are documents of
their own, so a repeated doc_id spreads over tasks.

Forms: ``psm`` is <P>prefix<S>suffix<M>middle, ``spm`` is <S>suffix<P>prefix<M>middle, ``plain`` the text itself, for empty
texts, texts that contain a sentinel, and the share of documents above ``rate``. Null texts are empty. A null doc_id hashes
as the word "null". Equal rows give equal results. An empty table gives no rows. Columns other than doc_id and text are
not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts_of

SEED, RATE, SPM = 7, 100, 50
"""Key of the hashes; percent of documents transformed; percent of those in the form spm."""
PIECE_BYTES = 256 << 10
OUT_BYTES = 4 << 20
P, S, M = b"<P>", b"<S>", b"<M>"
ORDERS = {"psm": (P, S, M), "spm": (S, P, M), "plain": ()}
RANK = {b"": 0, P: 0, M: 1, S: 2}
"""Place of the segments in the restored text."""

PIECES = ("number bigint, place int, doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, payload binary")
PARTS = ("number bigint, place bigint, doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, "
         "output_sha256 string, payload binary")
ROWS = ("doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string")


def plan(text: bytes, doc_id: int | None, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> tuple[np.ndarray, str, int, int]:
    """Ends of the units (from 0), form, and the units in which prefix and middle end."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x0A) + 1
    if len(text) and not (len(ends) and ends[-1] == len(text)):
        ends = np.append(ends, len(text))
    bounds, n = np.concatenate([[0], ends]), len(ends)
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[k : k + 4]) for k in (0, 4, 8, 12))
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    form = "plain" if not text or any(m in text for m in (P, S, M)) or h3 % 100 >= rate else "spm" if h4 % 100 < spm else "psm"
    return bounds, form, first, second


def chunks(bounds: np.ndarray, start: int, end: int, most: int):
    """Cut bytes ``start`` to ``end`` at unit ends into chunks of about ``most`` bytes; at least one, maybe empty."""
    while end - start > most:
        at = int(bounds[np.searchsorted(bounds, start + most, side="right") - 1])
        at = at if at > start else start + most
        yield start, at
        start = at
    yield start, end


def chars(data: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


class Splitter:
    """Finds the sentinels of a form in an output that comes in pieces; yields (sentinel of the segment, bytes)."""

    def __init__(self, form: str):
        self.marks, self.now, self.held = list(ORDERS[form]), b"", b""

    def feed(self, data: bytes, last: bool = False):
        data = self.held + data
        self.held = b""
        while self.marks and (at := data.find(self.marks[0])) >= 0:
            if at:
                yield self.now, data[:at]
            self.now, data = self.marks.pop(0), data[at + 3 :]
        if self.marks and not last:
            data, self.held = data[:-2], data[-2:]
        if data:
            yield self.now, data


def _stream(batches):
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _batches(rows, kind: pa.Schema):
    """Arrow batches of a thousand rows or ``OUT_BYTES`` of payload."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1] or b"")
        if len(held) == 1000 or size > OUT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kind)], schema=kind)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kind)], schema=kind)


def _kind(schema: str) -> pa.Schema:
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, types[kind]) for name, kind in (field.split() for field in schema.split(", "))])


def pieces(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The outputs in pieces (``PIECES``), sorted by document and place within partitions. ``payload`` is compressed; the
    payloads of a document in order of place are its output. Counts are set in every piece of a document."""
    small_batches(docs.sparkSession)

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress

        def cut():
            for batch in batches:
                for number, doc_id, text in zip(batch.column("number").to_pylist(), batch.column("doc_id").to_pylist(), texts_of(batch.column("text"))):
                    text = text or b""
                    bounds, form, first, second = plan(text, doc_id, seed, rate, spm)
                    a, b = int(bounds[first]), int(bounds[second])
                    spans = {P: (0, a), M: (a, b), S: (b, len(text))}
                    counts = (None, None) if form == "plain" else (chars(text[:a]), chars(text[a:b]))
                    place = 0
                    for mark in ORDERS[form] or (b"",):
                        for start, end in chunks(bounds, *spans.get(mark, (0, len(text))), piece_bytes):
                            yield number, place, doc_id, len(bounds) - 1, form, *counts, squeeze(mark + text[start:end])
                            mark, place = b"", place + 1

        yield from _batches(cut(), _kind(PIECES))

    rows = docs.select(F.monotonically_increasing_id().alias("number"), F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES).repartition("number").sortWithinPartitions("number", "place")


def _parts(sent: DataFrame) -> DataFrame:
    """Pieces of the restored texts, with the output's digest in the last one of each document."""

    def run(batches):
        expand, squeeze = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress

        def parse():
            now, digest, split, about, count = None, None, None, None, 0

            def placed(found):
                nonlocal count
                for mark, data in found:
                    count += 1
                    yield now, (RANK[mark] << 40) + count, *[None] * 6, squeeze(data)

            def close():
                yield from placed(split.feed(b"", last=True))
                yield now, 3 << 40, *about, digest.hexdigest(), None

            for number, _, *own, payload in _stream(batches):
                if number != now:
                    if now is not None:
                        yield from close()
                    now, digest, split, about, count = number, hashlib.sha256(), Splitter(own[2]), own, 0
                data = expand(payload)
                digest.update(data)
                yield from placed(split.feed(data))
            if now is not None:
                yield from close()

        yield from _batches(parse(), _kind(PARTS))

    return sent.mapInArrow(run, PARTS).sortWithinPartitions("number", "place")


def digests(sent: DataFrame) -> DataFrame:
    """One row per document of ``pieces``: counts, form, digests of the output and of the text restored from it."""

    def run(batches):
        expand = zstandard.ZstdDecompressor().decompress

        def rows():
            digest = hashlib.sha256()
            for _, place, doc_id, n, form, prefix, middle, output, payload in _stream(batches):
                if payload is not None:
                    digest.update(expand(payload))
                else:
                    yield doc_id, n, form, prefix, middle, output, digest.hexdigest()
                    digest = hashlib.sha256()

        kind = _kind(ROWS)
        held = []
        for row in rows():
            held.append(row)
            if len(held) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kind)], schema=kind)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kind)], schema=kind)

    return _parts(sent).mapInArrow(run, ROWS)


def texts(sent: DataFrame, restored: bool = False) -> DataFrame:
    """One row per document of ``pieces``: doc_id, form, and its output or restored text as one string."""
    source = _parts(sent) if restored else sent

    def run(batches):
        expand = zstandard.ZstdDecompressor().decompress
        kind = _kind("doc_id bigint, form string, text string")

        def row(doc_id, form, data):
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((doc_id, form, b"".join(data).decode()), kind)], schema=kind)

        now, about, held = None, None, []
        for number, _, doc_id, n, form, *_, payload in _stream(batches):
            if number != now and now is not None and not restored:
                yield row(*about, held)
                held = []
            now, about = number, (doc_id, form)
            if payload is not None:
                held.append(expand(payload))
            elif restored:
                yield row(*about, held)
                now, held = None, []
        if now is not None:
            yield row(*about, held)

    return source.mapInArrow(run, "doc_id bigint, form string, text string")


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """Digest rows of every document."""
    return digests(pieces(docs, seed, rate, spm))
