"""Language identification with hyperdimensional profiles.

Every letter class has a random vector of +1/-1. A letter n-gram is the product (binding) of its letters' vectors, each
rotated (permuted) by its place; a text is the sum (bundle) of its n-gram vectors, a language the sum over its training
texts. A text gets the language whose prototype has the greatest cosine with it.

Letters are lower-cased and mapped to ``SYMBOLS`` classes by a fixed rule, runs of other characters to one boundary
class. Training is one pass: each task adds up the vectors of its own texts by language, and these sums (one vector per
task and language) are added in two salted steps. The prototypes are ``DIM`` numbers per language.

``und`` with score 0 for null texts and texts without a letter, and for all texts if nothing could be learned. Repeated
rows count as often as they stand in the table. A row with a null doc_id is not learned from and not held out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, id_remainder, per_process, quoted

DIM = 1024
SYMBOLS = 64
ORDER = 3
SEED = 20240229
CHUNK_CHARS = 1 << 19
UNKNOWN = "und"
SALTS = 64

FOUND = "lang_pred string, score double"


class Profiles:
    """Letter classes and n-gram vectors; the same in every process, from the seed alone."""

    def __init__(self, dim: int = DIM, seed: int = SEED):
        letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (SYMBOLS, dim))
        self.dim = dim
        self.places = [np.roll(letters, ORDER - 1 - k, axis=1) for k in range(ORDER)]
        self.head = self.places[0][:, None, :] * self.places[1][None, :, :]  # bound pairs
        self.table = np.zeros(0x110000, np.uint8)
        for code in range(0x33000):  # letters end before
            char = chr(code)
            if char.isalpha():
                low = ord(char.lower()[0])
                self.table[code] = 1 + (low - 97 if 97 <= low <= 122 else 26 + low % (SYMBOLS - 27))

    def ngrams(self, text: str | None) -> np.ndarray | None:
        """n-gram numbers of a text with a boundary at both ends; None if it has no letter."""
        if not text:
            return None
        symbols = self.table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        if not symbols.any():
            return None
        symbols = np.concatenate([[0], symbols, [0]])
        symbols = symbols[(symbols > 0) | (np.diff(symbols, prepend=1) != 0)].astype(np.int64)
        return (symbols[:-2] * SYMBOLS + symbols[1:-1]) * SYMBOLS + symbols[2:]

    def vectors(self, numbers: np.ndarray) -> np.ndarray:
        """One row per n-gram number."""
        pair, last = np.divmod(numbers, SYMBOLS)
        return (self.head.reshape(-1, self.dim)[pair] * self.places[2][last]).astype(np.float32)

    def bundle(self, texts: list[np.ndarray]) -> np.ndarray:
        """Sum of n-gram vectors for each text, by one matrix product over the n-grams that occur."""
        flat = np.concatenate(texts)
        seen = np.flatnonzero(np.bincount(flat, minlength=SYMBOLS**ORDER))
        at = np.searchsorted(seen, flat)
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        counts = np.bincount(owner * len(seen) + at, minlength=len(texts) * len(seen)).reshape(len(texts), len(seen))
        out = np.zeros((len(texts), self.dim), np.float32)
        for begin in range(0, len(seen), 4096):
            out += counts[:, begin : begin + 4096].astype(np.float32) @ self.vectors(seen[begin : begin + 4096])
        return out


def profiles(dim: int = DIM, seed: int = SEED) -> Profiles:
    return per_process("profiles", (dim, seed), lambda: Profiles(dim, seed))


def _chunks(texts: list[str | None], most: int = 512):
    """Slices of bounded characters and rows, at least one text."""
    at, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= CHUNK_CHARS or k + 1 - at >= most:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def train(docs: DataFrame, dim: int = DIM, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes from columns ``text`` and ``lang``, over all rows with both."""

    def local(batches):
        from pyspark import TaskContext

        space, sums = profiles(dim, seed), {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for a, b in _chunks(texts):
                by_lang: dict[str, list[np.ndarray]] = {}
                for text, lang in zip(texts[a:b], langs[a:b]):
                    grams = space.ngrams(text)
                    if grams is not None:
                        by_lang.setdefault(lang, []).append(grams)
                for lang, grams in by_lang.items():
                    total = space.bundle([np.concatenate(grams)])[0].astype(np.float64)
                    sums[lang] = sums.get(lang, 0) + total
        salt = TaskContext.get().partitionId() % SALTS
        yield pa.RecordBatch.from_pylist([{"lang": k, "salt": salt, "vector": v.tobytes()} for k, v in sums.items()],
                                         pa.schema([("lang", pa.string()), ("salt", pa.int32()), ("vector", pa.binary())]))

    def add(key, frames):
        import pandas as pd

        total = 0
        for frame in frames if not hasattr(frames, "columns") else [frames]:
            for vector in frame["vector"]:
                total = total + np.frombuffer(vector, np.float64)
        return pd.DataFrame({"lang": [key[0]], "vector": [total.tobytes()]})

    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select(F.col("text").cast("string").alias("text"),
                                                                      F.col("lang").cast("string").alias("lang"))
    sums = rows.mapInArrow(local, "lang string, salt int, vector binary")
    sums = sums.groupBy("lang", "salt").applyInPandas(add, "lang string, vector binary")
    sums = sums.groupBy("lang").applyInPandas(add, "lang string, vector binary")
    found = sorted((r.lang, np.frombuffer(r.vector, np.float64)) for r in sums.collect())
    langs = [lang for lang, _ in found]
    matrix = np.array([v / max(np.linalg.norm(v), 1e-12) for _, v in found]) if found else np.zeros((0, dim))
    return langs, matrix


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray, keep: list[str] | None = None, dim: int = DIM,
            seed: int = SEED) -> DataFrame:
    """Columns ``row`` and ``found`` (see ``FOUND``) for every document."""
    matrix = prototypes.astype(np.float32).T.copy()

    def per_batch(texts):
        space = profiles(dim, seed)
        preds, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if langs:
            for a, b in _chunks(texts):
                grams = [space.ngrams(t.decode() if t else None) for t in texts[a:b]]
                known = [k for k, g in enumerate(grams) if g is not None]
                if known:
                    vectors = space.bundle([grams[k] for k in known])
                    cosine = (vectors @ matrix) / np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)[:, None]
                    best = cosine.argmax(axis=1)
                    for k, which, value in zip(known, best.tolist(), cosine.max(axis=1).tolist()):
                        preds[a + k], scores[a + k] = langs[which], min(1.0, max(0.0, value))
        return {"lang_pred": preds, "score": scores}

    return annotate(docs, FOUND, per_batch, keep)


def identify(docs: DataFrame, folds: int = 3, held_fold: int = 1, keep: list[str] | None = None) -> DataFrame:
    """Learn from the documents outside the held-out fold (crc32 of doc_id as text) and predict all."""
    langs, prototypes = train(docs.where(id_remainder("doc_id", folds) != held_fold))
    out = predict(docs, langs, prototypes, keep)
    held = F.coalesce(id_remainder(f"row.{quoted('doc_id')}", folds) == held_fold, F.lit(False))
    return out.withColumn("held_out", held)
