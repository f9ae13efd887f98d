"""Best-fit packing of documents into sequences, as vector bin packing.

Every document becomes pieces of at most ``tokens`` ids (only longer documents are cut; the first piece takes the odd
rest, the others are full). A sequence has three capacities: tokens, documents, and attention cost (sum of squared piece
lengths). Pieces are dealt, without their text, into portions of bounded bytes; each portion is packed on its own by
vector best-fit, so no step sees all pieces. Within a portion the pieces of one length are placed together, longest
first: every open sequence that can take one under all three constraints is scored, by the norm of what would remain or
by the weighted dot product of demand and remainder, and the best sequences get one each, round by round; new ones are
opened when none fits.

Null and empty texts are a single end id. Repeated rows are packed as separate documents; a null doc_id is kept. An
empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate
from .tokens import default_path, encoder, portions

TOKENS = 1024
WEIGHTS = (1.0, 0.05, 0.05)

PIECES = "pieces array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"
OUT = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def cut(ids: bytes, tokens: int = TOKENS) -> list[dict]:
    """Pieces of one document's little-endian uint32 ids."""
    total = len(ids) // 4
    first = total % tokens or min(tokens, total)
    edges = [0, *range(first, total + 1, tokens)]
    return [{"piece": k, "start": a, "length": b - a, "ids_crc32": zlib.crc32(ids[4 * a : 4 * b])}
            for k, (a, b) in enumerate(zip(edges, edges[1:]))]


def pieces(docs: DataFrame, path: str | None = None, tokens: int = TOKENS, keep: list[str] | None = None) -> DataFrame:
    """Columns ``row`` and ``found.pieces`` for every document."""
    path = path or default_path()

    def per_batch(texts):
        out = []
        for part in portions(texts):
            out += [cut(ids, tokens) for ids in encoder(path).ids([t.decode() if t else t for t in part])]
        return {"pieces": out}

    return annotate(docs, PIECES, per_batch, keep)


PORTION = 1 << 20
"""Pieces packed together at most; a sequence holds one at least, so their numbers are within it too."""


def fit(lengths: np.ndarray, tokens: int = TOKENS, documents: int = TOKENS, attention: int = TOKENS * TOKENS,
        weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> np.ndarray:
    """Sequence number of every piece, by vector best-fit. ``rule``: ``norm`` (least remainder) or ``dot`` (greatest)."""
    full = np.array([tokens, documents, attention], np.float64)
    weights = np.asarray(weights)
    place = np.empty(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    values, begins = np.unique(-lengths[order], return_index=True)
    bounds = [*begins.tolist(), len(lengths)]
    shortest = -int(values[-1]) if len(values) else 0
    numbers, left, opened = np.empty(0, np.int64), np.empty((0, 3)), 0
    for value, a, b in zip((-values).tolist(), bounds, bounds[1:]):
        todo = order[a:b]
        need = np.array([value, 1, value * value], np.float64)
        if (need > full).any():
            raise ValueError("a piece is larger than a sequence")
        while len(todo):
            fits = np.flatnonzero((left >= need).all(axis=1))
            if not len(fits):
                each = int((full // np.maximum(need, 1)).min())
                more = -(-len(todo) // each)
                numbers = np.concatenate([numbers, np.arange(opened, opened + more)])
                left = np.concatenate([left, np.tile(full, (more, 1))])
                opened += more
                continue
            rest = (left[fits] - need) / full
            score = -(weights * rest * rest).sum(axis=1) if rule == "norm" else -(weights * (need / full) * (left[fits] / full)).sum(axis=1)
            take = min(len(todo), len(fits))
            if take < len(fits):
                best = fits[np.argsort(-score, kind="stable")[:take]]
            else:
                best = fits
            place[todo[:take]] = numbers[best]
            left[best] -= need
            todo = todo[take:]
        open_still = (left >= [shortest, 1, shortest * shortest]).all(axis=1)
        numbers, left = numbers[open_still], left[open_still]
    return place


def pack(parts: DataFrame, tokens: int = TOKENS, documents: int = TOKENS, attention: int = TOKENS * TOKENS,
         weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm", portion: int = PORTION) -> DataFrame:
    """Place pieces (doc_id, piece, start, length, ids_crc32) into sequences: adds ``sequence_id`` and ``offset``.

    The rebalance gives partitions of the session's advisory size, a few hundred thousand pieces each; a task packs portions
    of ``portion`` pieces at most, whatever it is given.
    """

    def packed(batches, base):
        table = pa.Table.from_batches(batches).combine_chunks()
        lengths = table.column("length").to_numpy()
        place = fit(lengths, tokens, documents, attention, weights, rule)
        order = np.argsort(place, kind="stable")
        table, sizes, place = table.take(pa.array(order)), lengths[order], place[order]
        ends = np.cumsum(sizes)
        heads = np.flatnonzero(np.diff(place, prepend=-1))
        begin = np.repeat(ends[heads] - sizes[heads], np.diff(np.append(heads, len(place))))
        table = table.append_column("sequence_id", pa.array(place + base)).append_column("offset", pa.array(ends - sizes - begin))
        yield from table.to_batches(max_chunksize=65536)

    def run(batches):
        from pyspark import TaskContext

        base, held, size = TaskContext.get().partitionId() << 40, [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, portion):
                some = batch.slice(at, portion)
                if held and size + some.num_rows > portion:
                    yield from packed(held, base)
                    base, held, size = base + portion, [], 0
                held.append(some)
                size += some.num_rows
        if held:
            yield from packed(held, base)

    return parts.select("doc_id", "piece", "start", "length", "ids_crc32").hint("rebalance").mapInArrow(run, OUT)


def pack_documents(docs: DataFrame, path: str | None = None, tokens: int = TOKENS, **limits) -> DataFrame:
    """Tokenise, cut and pack whole documents; one row per piece."""
    found = pieces(docs, path, tokens, ["doc_id"])
    flat = found.select(F.col("row.doc_id").cast("bigint").alias("doc_id"), F.explode("found.pieces").alias("p"))
    return pack(flat.select("doc_id", "p.*"), tokens, **limits)
