"""Token-id output as bit-plane shuffled binary files.

Documents are range-partitioned and sorted by doc_id, tokenised, and their ids written as a run of files. Layout of a
file (little-endian):

* header: magic ``SGBP``, version uint16, planes uint16 (byte planes of an id: 4, or bit planes: 32), block ids uint32;
* blocks: up to ``BLOCK_IDS`` ids each, transposed so that plane ``p`` holds bit or byte ``p`` of every id, each plane
  compressed with zstandard on its own (the upper planes are nearly constant and vanish);
* document table, compressed: for every document its doc_id (int64), a null flag (uint8) and its number of ids (uint64);
* chunk index: for every block its id count (uint32) and the offset (uint64) and size (uint32) of every plane, so any
  block or plane can be read alone;
* footer: documents uint32, blocks uint32, offset of the document table uint64, offset of the index uint64, magic.

A file is closed after ``FILE_IDS`` ids, at the end of a document. Files are kept as rows (part, file, n_docs, n_ids,
content) of a table in the shared folder, written by Spark's committer, so that a lost executor or a repeated task leaves
no stray file; ``export_files`` copies them out as plain files. Global starts come from the totals of parts and files.

Null and empty texts are one end id. Equal doc_ids are ordered by a hash of their text,
repeated rows by their number, so that they may end in several partitions; null doc_ids come first. An empty table is no
file and no row.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .tokens import default_path, encoder, portions

MAGIC, VERSION = b"SGBP", 1
BLOCK_IDS = 1 << 16
FILE_IDS = 1 << 20
LEVEL = 3
HEAD, FOOT = "<4sHHI", "<IIQQ4s"


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Byte planes (4), or bit planes (32), of uint32 ids, lowest first."""
    rows = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if not bits:
        return [row.tobytes() for row in rows]
    return [np.packbits(row >> k & 1, bitorder="little").tobytes() for row in rows for k in range(8)]


def from_planes(planes: list[bytes], count: int) -> np.ndarray:
    if len(planes) == 4:
        rows = np.stack([np.frombuffer(p, np.uint8) for p in planes]) if count else np.empty((4, 0), np.uint8)
    else:
        flat = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=count, bitorder="little") for p in planes])
        rows = np.bitwise_or.reduce(flat.reshape(4, 8, count) << np.arange(8, dtype=np.uint8)[None, :, None], axis=1)
    return np.ascontiguousarray(rows.T).view("<u4").reshape(-1)


def write_file(documents: list[tuple[int | None, bytes]], bits: bool = False) -> bytes:
    """One file from (doc_id, little-endian uint32 ids) pairs."""
    squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
    planes = 32 if bits else 4
    flat = np.frombuffer(b"".join(ids for _, ids in documents), "<u4")
    out, at, index = [struct.pack(HEAD, MAGIC, VERSION, planes, BLOCK_IDS)], struct.calcsize(HEAD), []
    for begin in range(0, len(flat), BLOCK_IDS):
        ids = flat[begin : begin + BLOCK_IDS]
        packed = [squeeze(p) for p in to_planes(ids, bits)]
        index.append(struct.pack("<I", len(ids)))
        for p in packed:
            index.append(struct.pack("<QI", at, len(p)))
            at += len(p)
        out += packed
    names = np.array([d or 0 for d, _ in documents], "<i8").tobytes()
    absent = np.array([d is None for d, _ in documents], np.uint8).tobytes()
    table = squeeze(names + absent + np.array([len(ids) // 4 for _, ids in documents], "<u8").tobytes())
    foot = struct.pack(FOOT, len(documents), -(-len(flat) // BLOCK_IDS), at, at + len(table), MAGIC)
    return b"".join([*out, table, *index, foot])


def _foot(content: bytes):
    magic, version, planes, _ = struct.unpack_from(HEAD, content, 0)
    documents, blocks, table_at, index_at, tail = struct.unpack_from(FOOT, content, len(content) - struct.calcsize(FOOT))
    if magic != MAGIC or tail != MAGIC or version != VERSION or planes not in (4, 32):
        raise ValueError("not a plane file")
    return planes, documents, blocks, table_at, index_at


def read_block(content: bytes, number: int) -> np.ndarray:
    """Ids of one block, found by the chunk index."""
    planes, _, blocks, _, index_at = _foot(content)
    if not 0 <= number < blocks:
        raise IndexError(number)
    at = index_at + number * (4 + 12 * planes)
    (count,) = struct.unpack_from("<I", content, at)
    places = [struct.unpack_from("<QI", content, at + 4 + 12 * p) for p in range(planes)]
    expand = zstandard.ZstdDecompressor().decompress
    return from_planes([expand(content[a : a + n]) for a, n in places], count)


def read_file(content: bytes) -> list[tuple[int | None, bytes]]:
    """The (doc_id, ids) pairs of a file."""
    _, documents, blocks, table_at, index_at = _foot(content)
    table = zstandard.ZstdDecompressor().decompress(content[table_at:index_at])
    names = np.frombuffer(table, "<i8", documents)
    absent = np.frombuffer(table, np.uint8, documents, 8 * documents)
    sizes = np.frombuffer(table, "<u8", documents, 9 * documents)
    data = b"".join(read_block(content, k).tobytes() for k in range(blocks))
    ends = np.cumsum(sizes.astype(np.int64)) * 4
    return [(None if gone else name, data[end - 4 * size : end])
            for name, gone, size, end in zip(names.tolist(), absent.tolist(), sizes.astype(np.int64).tolist(), ends.tolist())]


STORE = "part int, file int, n_docs bigint, n_ids bigint, content binary"


def write_ids(docs: DataFrame, path: str | None = None, bits: bool = False) -> DataFrame:
    """Tokenise and write all documents in ascending doc_id order; one row per file (see ``STORE``)."""
    path = path or default_path()
    kind = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()),
                      ("content", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        part, file, held, size = TaskContext.get().partitionId(), 0, [], 0

        def row():
            return pa.RecordBatch.from_pylist([{"part": part, "file": file, "n_docs": len(held), "n_ids": size // 4,
                                                "content": write_file(held, bits)}], kind)

        for batch in batches:
            ids, texts, at = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), 0
            for some in portions(texts):
                for doc_id, packed in zip(ids[at : at + len(some)], encoder(path).ids(some)):
                    held.append((doc_id, packed))
                    size += len(packed)
                    if size >= 4 * FILE_IDS:
                        yield row()
                        file, held, size = file + 1, [], 0
                at += len(some)
        if held:
            yield row()

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"),
                       F.monotonically_increasing_id().alias("number"))
    rows = rows.repartitionByRange("doc_id", "tie", "number").sortWithinPartitions("doc_id", "tie", "number")
    return stored(rows.select("doc_id", "text").mapInArrow(run, STORE), "id-planes")


READ = "part int, file int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint"


def read_ids(store: DataFrame) -> DataFrame:
    """Read the files back: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            for part, file, content in zip(*(batch.column(c).to_pylist() for c in ("part", "file", "content"))):
                rows, at = [], 0
                for doc_id, ids in read_file(content):
                    rows.append({"part": part, "file": file, "doc_id": doc_id, "at": at, "n_tokens": len(ids) // 4,
                                 "ids_crc32": zlib.crc32(ids)})
                    at += len(ids) // 4
                yield pa.RecordBatch.from_pylist(rows, pa.schema([
                    ("part", pa.int32()), ("file", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()),
                    ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]))

    found = store.select("part", "file", "content").mapInArrow(run, READ)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = store.groupBy("part").agg(F.sum("n_ids").alias("n")).select(  # one row per written partition
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = store.select("part", "file", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("file_start"))
    return found.join(files.join(parts, "part"), ["part", "file"]).select(
        "doc_id", (F.col("part_start") + F.col("file_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def export_files(store: DataFrame, folder: str) -> list[str]:
    """Copy the files into a folder that this process can reach, one at a time."""
    os.makedirs(folder, exist_ok=True)
    names = []
    for row in store.select("part", "file", "content").orderBy("part", "file").toLocalIterator():
        names.append(os.path.join(folder, f"ids-{row.part:05d}-{row.file:05d}.sgbp"))
        with open(names[-1], "wb") as out:
            out.write(row.content)
    return names
