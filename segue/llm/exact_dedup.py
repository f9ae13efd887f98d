"""Exact deduplication by skew-safe combining.

Texts are equal when identical without white space. Three stages, each comparing full content:

1. Locally, every task gathers equal texts of a bounded buffer into one local group (best row, size, member ids).
2. Local groups merge by (digest, salt, content); the salt is a hash of the number of the group's best row (task and place
   in it), so a digest with copies in every task spreads over ``SALTS`` groups.
3. The salt winners (at most ``SALTS`` rows for a content) merge by (digest, content).

Content travels compressed; the compressor is a fixed function with an inverse, so comparing its bytes compares content.
Results return to documents over (digest, salt, variant): ``variant`` numbers the contents of one digest, so a digest
collision separates. Members ride in their local group's row, so a group with a third of all documents is as many rows
as tasks and buffers made for it, never one list.

Null counts as the empty text, texts of white space alone equal it. An empty table gives no rows. Of equal texts the longest original stays, then the
smallest doc_id (a null doc_id last). Repeated rows with one doc_id form a group like others: all but one are dropped,
``kept`` is true for one row. Only doc_id and text are read; other columns are left out of the result.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, quoted, stored

SALTS = 32
BUFFER_BYTES = 32 << 20
"""Compressed content held by a task before it emits its local groups."""
BLANKS = b" \t\n\x0b\x0c\r"

LOCAL = ("digest binary, sha binary, content binary, salt int, best struct<shorter:bigint,unnamed:boolean,doc_id:bigint,row:bigint>, "
         "members array<struct<doc_id:bigint,row:bigint>>")


def _local_groups(docs: DataFrame, row: str | None, digest_bytes: int, buffer_bytes: int) -> DataFrame:
    member = pa.struct([("doc_id", pa.int64()), ("row", pa.int64())])
    best_kind = pa.struct([("shorter", pa.int64()), ("unnamed", pa.bool_()), ("doc_id", pa.int64()), ("row", pa.int64())])
    kind = pa.schema([("digest", pa.binary()), ("sha", pa.binary()), ("content", pa.binary()), ("salt", pa.int32()), ("best", best_kind),
                      ("members", pa.list_(member))])

    def emit(groups):
        rows = [{"digest": sha[:digest_bytes], "sha": sha, "content": content, "salt": zlib.crc32(b"%d" % best[3]) % SALTS,
                 "best": dict(zip(("shorter", "unnamed", "doc_id", "row"), best)), "members": members}
                for (sha, content), (best, members) in groups.items()]
        for at in range(0, len(rows), 2000):
            yield pa.RecordBatch.from_pylist(rows[at : at + 2000], kind)

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1, write_content_size=True).compress
        groups, held = {}, 0
        for batch in batches:
            ids, rows, chars = (batch.column(c).to_pylist() for c in ("doc_id", "row", "chars"))
            for doc_id, text, size, number in zip(ids, batch.column("text").cast(pa.binary()).to_pylist(), chars, rows):
                plain = (text or b"").translate(None, BLANKS)
                content = squeeze(plain)
                key = hashlib.sha256(plain).digest(), content
                best = (-size, doc_id is None, doc_id, number)
                old = groups.get(key)
                if old is None:
                    groups[key] = [best, [{"doc_id": doc_id, "row": number}]]
                    held += len(content)
                else:
                    old[0] = min(old[0], best, key=lambda b: (b[0], b[1], b[2] or 0, b[3]))
                    old[1].append({"doc_id": doc_id, "row": number})
                held += 300
                if held > buffer_bytes:
                    yield from emit(groups)
                    groups, held = {}, 0
        yield from emit(groups)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    number = F.col(row) if row else F.monotonically_increasing_id()
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"),
                       F.char_length(text).alias("chars"), number.alias("row")).mapInArrow(run, LOCAL)


def exact_groups(docs: DataFrame, row: str | None = None, digest_bytes: int = 32, buffer_bytes: int = BUFFER_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, row.

    ``row`` names a column that numbers the rows; by default numbers are dealt and stored with the local groups.
    ``digest_bytes`` shortens the grouping digest; results are the same, as content decides.
    """
    return _grouped(docs, row, digest_bytes, buffer_bytes)[0]


def _grouped(docs: DataFrame, row: str | None, digest_bytes: int = 32, buffer_bytes: int = BUFFER_BYTES) -> tuple[DataFrame, list[DataFrame]]:
    """The rows of ``exact_groups`` and the stored tables that they are read from."""
    local = stored(_local_groups(docs, row, digest_bytes, buffer_bytes), "dedup-local")
    salted = local.groupBy("digest", "content", "salt").agg(F.min("best").alias("best"), F.sum(F.size("members")).alias("n"))
    one = salted.repartition("digest").groupBy("digest", "content").agg(
        F.min("best").alias("best"), F.sum("n").alias("n"), F.collect_set("salt").alias("salts"))
    contents = F.count("*").over(Window.partitionBy("digest"))
    winners = stored(one.withColumn("contents", contents).select(
        "digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "n", "salts",
        F.when(F.col("contents") > 1, F.col("content")).alias("content")), "dedup-winners")
    keyed = winners.select("*", F.explode("salts").alias("salt")).drop("salts")
    out = local.select("digest", "salt", "sha", "members").join(
        keyed.where("content IS NULL").drop("content"), ["digest", "salt"])
    if not winners.where("content IS NOT NULL").isEmpty():  # several contents share a digest: content decides
        out = out.unionByName(local.drop("best").join(keyed, ["digest", "salt", "content"]).drop("content"))
    return out.select("sha", "keep_id", "keep_row", "n", F.explode("members").alias("m")).select(
        "m.doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("m.row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "m.row"), [local, winners]


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    number = "row_number_of_dedup"
    while number in docs.columns:
        number += "_"
    numbered = stored(docs.withColumn(number, F.monotonically_increasing_id()), "dedup-input")
    groups, tables = _grouped(numbered, number)
    dropped = stored(groups.where("NOT kept").select(F.col("row").alias(number)), "dedup-dropped")
    forget(*tables)
    return numbered.join(dropped, number, "left_anti").select(*[F.col(quoted(c)) for c in docs.columns])
