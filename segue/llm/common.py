"""Helpers shared by the corpus operators."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from segue.session import shared_dir

WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
"""Lower-cases A-Z and blanks every ASCII byte that is neither letter nor digit."""


def text_words(data: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text, A-Z lower-cased; null has none."""
    return data.translate(WORD_BYTES).split() if data else []


def spaced_words(data: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text, A-Z lower-cased; null has none."""
    return data.lower().split() if data else []


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def small_batches(spark) -> None:
    """Whole texts are large rows: keep Arrow batches, which stand in memory several times over, at a few megabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def annotate(docs: DataFrame, found: str, per_batch: Callable[[list[bytes | None]], dict[str, list]],
             keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Run ``per_batch`` over the texts (UTF-8 bytes) of every Arrow batch.

    Returns two columns: ``row``, a struct of the input columns (or of ``keep``), and ``found``, a struct typed by
    ``found``. Nesting keeps input columns whatever they are called. No shuffle; one batch is in memory at a time.
    """
    small_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    packed = docs.select(F.struct(*[F.col(quoted(c)) for c in keep]).alias("row"),
                         F.col(quoted(text)).cast("string").alias("text"))
    inside = T._parse_datatype_string(found)
    schema = T.StructType([packed.schema["row"], T.StructField("found", inside)])
    kind = to_arrow_schema(T.StructType([T.StructField("found", inside)])).field("found").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = per_batch(texts_of(batch.column("text")))
                columns = [pa.array(out[f.name], f.type) for f in kind]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), pa.StructArray.from_arrays(columns, fields=list(kind))], ["row", "found"])

    return packed.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def per_process(slot: str, token, make: Callable):
    """A value that a worker process keeps between tasks: one per slot, made anew when ``token`` changes.

    Code travels with the job, so module globals are new in every task; a registered module outlives them.
    """
    kept = sys.modules.setdefault("segue_kept", types.ModuleType("segue_kept")).__dict__
    if kept.get(slot, (None,))[0] != token:
        kept[slot] = token, make()
    return kept[slot][1]


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back; later steps survive lost executors."""
    small_batches(df.sparkSession)
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_path = path
    return table


def forget(*tables: DataFrame) -> None:
    """Delete ``stored`` tables that no later plan reads."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def id_remainder(column: str, modulus: int):
    """crc32 of an id as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))
