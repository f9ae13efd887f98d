"""Language-model scores: a log-bilinear model trained with noise-contrastive estimation.

The model predicts a token from the two before it: with word vectors ``r``, diagonal context weights ``c1``, ``c2`` and
output vectors ``q``, the score of ``w`` after ``w2 w1`` is ``(c1*r[w1] + c2*r[w2]) . q[w] + b[w]``. Its outputs are the
``FREQUENT`` most counted training words and ``BUCKETS`` buckets of the other words (by a hash of their last bytes);
inside a bucket a word has its smoothed share of the bucket's training count, one share is left for unseen words. Since
the score is a sum of two tables, batched matrix products give the logarithm of the normaliser for every pair of context
words, so token probabilities are exactly normalised.

Steps, all over the whole corpus: word counts (combined in each task before the shuffle); one pass that writes each
document's output numbers and its rarer words; ``ROUNDS`` rounds in which each task trains a copy of the model on its
documents (every ``ROUNDS``-th position of each, another phase in each round, so every position is a target once) and the
copies are averaged by tokens, in two salted steps; one scoring pass. Counts of words beyond the ``COUNTED`` most frequent (which ride in a
broadcast of that many entries at most) are joined. The base score is the add-0.1 unigram of the contract.

A token is a word or the end of a text; null and empty texts are one end token. Repeated rows count as often as they
stand in the table. Documents with a null doc_id are scored, not learned from and not held out. An empty
table gives no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import id_remainder, per_process, spaced_words, stored, texts_of
from .tokens import portions

FREQUENT, BUCKETS = 768, 256
OUTPUTS = FREQUENT + BUCKETS
COUNTED = 100_000
DIM = 24
NOISE = 64
BATCH = 512
RATE = 0.15
ROUNDS = 2
SALTS, BLOCKS = 64, 16
"""Models are summed in blocks of their weights, first per salt."""
HELD_WORDS = 500_000
END = b""
"""The end of a text; no word is empty."""


def bucket(word: bytes) -> int:
    """Output number of a word that is not frequent, by its last three bytes."""
    return FREQUENT + zlib.crc32(word[-3:]) % BUCKETS


def word_counts(docs: DataFrame) -> DataFrame:
    """Columns word (binary), c: counts over all texts, the end token included."""
    kind = pa.schema([("word", pa.binary()), ("c", pa.int64())])

    def out(held):
        words, counts = list(held), list(held.values())
        for at in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[at : at + 50_000], pa.binary()),
                                              pa.array(counts[at : at + 50_000], pa.int64())], schema=kind)

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                held.update(spaced_words(text))
                held[END] += 1
                if len(held) > HELD_WORDS:
                    yield from out(held)
                    held = Counter()
        yield from out(held)

    part = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word binary, c bigint")
    return part.groupBy("word").agg(F.sum("c").alias("c"))


class Model:
    """Vectors of the log-bilinear model."""

    NAMES = ("r", "c1", "c2", "q", "b")

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights
        self.power: dict[str, np.ndarray] = {}

    @classmethod
    def fresh(cls, outputs: np.ndarray, seed: int = 3) -> Model:
        """``outputs``: training counts of the output words; biases start at their log share."""
        rng = np.random.default_rng(seed)
        n = len(outputs)
        share = (outputs + 0.1) / (outputs + 0.1).sum()
        return cls({"r": rng.normal(0, 0.3, (n, DIM)), "c1": np.ones(DIM), "c2": np.full(DIM, 0.5),
                    "q": rng.normal(0, 0.1, (n, DIM)), "b": np.log(share)})

    def flat(self) -> np.ndarray:
        return np.concatenate([np.ravel(self.w[k]) for k in self.NAMES]).astype(np.float64)

    def like(self, flat: np.ndarray) -> Model:
        out, at = {}, 0
        for k in self.NAMES:
            size = self.w[k].size
            out[k] = flat[at : at + size].reshape(self.w[k].shape)
            at += size
        return Model(out)

    def step(self, one: np.ndarray, two: np.ndarray, target: np.ndarray, noise: np.ndarray, log_noise: np.ndarray) -> None:
        """A noise-contrastive step: targets against ``noise`` outputs shared by the batch."""
        w, lift = self.w, np.float32(np.log(len(noise)))
        r1, r2 = w["r"].take(one, axis=0), w["r"].take(two, axis=0)
        h = r1 * w["c1"] + r2 * w["c2"]
        qt, qn = w["q"].take(target, axis=0), w["q"].take(noise, axis=0)
        st = np.einsum("ij,ij->i", h, qt) + w["b"][target] - log_noise[target] - lift
        sn = h @ qn.T + (w["b"][noise] - log_noise[noise] - lift)
        gt = _logistic(st) - 1
        gn = _logistic(sn)
        dh = gt[:, None] * qt + gn @ qn
        out, back = np.concatenate([target, noise]), np.concatenate([one, two])
        self._descend("q", _summed(out, np.concatenate([gt[:, None] * h, gn.T @ h])))
        self._descend("b", _summed(out, np.concatenate([gt, gn.sum(axis=0)])))
        self._descend("c1", np.einsum("ij,ij->j", dh, r1))
        self._descend("c2", np.einsum("ij,ij->j", dh, r2))
        self._descend("r", _summed(back, np.concatenate([dh * w["c1"], dh * w["c2"]])))

    def _descend(self, name: str, grad: np.ndarray) -> None:
        """Adagrad step; rows without a gradient stay as they are."""
        power = self.power.setdefault(name, np.ones(len(self.w[name]), np.float32))
        power += grad**2 if grad.ndim == 1 else np.einsum("ij,ij->i", grad, grad) / DIM
        scale = np.float32(RATE) / np.sqrt(power)
        self.w[name] -= grad * (scale if grad.ndim == 1 else scale[:, None])


def _logistic(x: np.ndarray) -> np.ndarray:
    x = np.minimum(-x, np.float32(30))
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


PLACES = np.arange(OUTPUTS * DIM).reshape(OUTPUTS, DIM)


def _summed(at: np.ndarray, grad: np.ndarray) -> np.ndarray:
    """The gradients of each output number added up."""
    if grad.ndim == 1:
        return np.bincount(at, grad, OUTPUTS).astype(np.float32)
    return np.bincount(PLACES.take(at, axis=0).ravel(), grad.ravel(), OUTPUTS * DIM).astype(np.float32).reshape(OUTPUTS, DIM)


def train_local(model: Model, streams, turn: int, rounds: int, seed: int, log_noise: np.ndarray) -> tuple[Model, int]:
    """Pass over ``streams`` (arrays of output numbers, each a text with its end) at the positions of round ``turn``.

    The positions of a text in all ``rounds`` are disjoint and together are all of them.
    """
    model = Model({k: v.astype(np.float32) for k, v in model.w.items()})
    rng = np.random.default_rng(seed)
    draw, log_noise = np.cumsum(np.exp(log_noise)), log_noise.astype(np.float32)
    used, held = 0, []

    def learn(block):
        one, two, target = block
        order = rng.permutation(len(target))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            noise = np.minimum(np.searchsorted(draw, rng.random(NOISE) * draw[-1]), len(log_noise) - 1)
            model.step(one[pick], two[pick], target[pick], noise, log_noise)

    size = 0
    for ids in streams:
        one, two, target = contexts(ids)
        pick = slice((zlib.crc32(ids.tobytes()[-64:]) + turn) % rounds, None, rounds)
        held.append((one[pick], two[pick], target[pick]))
        size += len(target[pick])
        if size >= 256 * BATCH:
            learn([np.concatenate(x) for x in zip(*held)])
            used, size, held = used + size, 0, []
    if size:
        learn([np.concatenate(x) for x in zip(*held)])
    return model, used + size


def contexts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word before, the one before that, and the word, for every token; ends stand before a text."""
    padded = np.concatenate([[0, 0], ids]).astype(np.int64)  # output 0 is the end
    return padded[1:-1], padded[:-2], padded[2:]


class Vocabulary:
    """The ``COUNTED`` most frequent words with their counts, and totals; all that is broadcast of the counts."""

    def __init__(self, words: list[bytes], counts: list[int], tokens: int, distinct: int, in_bucket: np.ndarray):
        self.index = {w: k for k, w in enumerate(words)}
        self.tokens, self.distinct = tokens, distinct
        self.log_count = np.log10(np.array(counts, np.float64) + 0.1)
        chosen = [END, *[w for w in words if w != END][: FREQUENT - 1]]
        self.outputs = {w: k for k, w in enumerate(chosen)}
        self.number = np.array([self.outputs.get(w, -1) for w in words], np.int64)
        missing = np.flatnonzero(self.number < 0)
        self.number[missing] = [bucket(words[k]) for k in missing]
        share = np.zeros((BUCKETS, 2))
        share += in_bucket
        for word in chosen:  # the bucket totals hold all words; frequent ones are outputs of their own
            if word in self.index:
                share[bucket(word) - FREQUENT] -= (counts[self.index[word]], 1)
        self.log_bucket = np.log10(share[:, 0] + 0.1 * (share[:, 1] + 1))
        self.output_counts = np.zeros(OUTPUTS)
        for word, k in self.outputs.items():
            self.output_counts[k] = counts[self.index[word]] if word in self.index else 0
        self.output_counts[FREQUENT:] = share[:, 0]

    @classmethod
    def of(cls, counts: DataFrame) -> Vocabulary:
        size = F.length("word")
        tail = F.when(size > 3, F.substring("word", size - 2, F.lit(3))).otherwise(F.col("word"))
        totals = counts.groupBy(F.pmod(F.crc32(tail), F.lit(BUCKETS)).alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
        in_bucket = np.zeros((BUCKETS, 2))
        for row in totals:
            in_bucket[row.k] = row.n, row.v
        top = counts.orderBy(F.desc("c"), "word").limit(COUNTED).toArrow().to_pydict()
        return cls([bytes(w) for w in top["word"]], top["c"], int(in_bucket[:, 0].sum()), int(in_bucket[:, 1].sum()), in_bucket)

    def encode(self, texts: list[bytes | None]) -> dict[str, list]:
        """Columns of ``ENCODED``; the words of all texts are looked up together."""
        each = [[*spaced_words(t), END] for t in texts]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        ends = np.cumsum(sizes)
        starts = ends - sizes
        words = list(chain.from_iterable(each))
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        known = at >= 0
        numbers = np.where(known, self.number[at] if len(self.number) else 0, 0)
        rare: list[list[dict]] = [[] for _ in texts]
        lost = np.flatnonzero(~known)
        for doc, k in zip((np.searchsorted(ends, lost, side="right")).tolist(), lost.tolist()):
            word = words[k]
            numbers[k] = self.outputs[word] if word in self.outputs else bucket(word)
            rare[doc].append(word)
        logs = np.where(known, self.log_count[at] if len(self.number) else 0.0, 0.0)
        inside = numbers >= FREQUENT
        within = np.where(inside, logs, 0.0)
        within[inside] -= self.log_bucket[numbers[inside] - FREQUENT]
        ids = numbers.astype("<u2").tobytes()
        base, within, counted = (np.add.reduceat(x, starts).tolist() for x in (logs, within, known.astype(np.int64)))
        return {"n_tokens": sizes.tolist(), "n_counted": counted, "base": base, "within": within,
                "ids": [ids[2 * a : 2 * b] for a, b in zip(starts.tolist(), ends.tolist())],
                "rare": [[{"word": w, "n": n} for w, n in Counter(found).items()] if found else [] for found in rare]}


ENCODED = ("n_tokens bigint, n_counted bigint, base double, within double, ids binary, "
           "rare array<struct<word:binary,n:bigint>>")


def train_model(rows: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> Model:
    """Rounds of local training over ``rows.ids`` and averaging by tokens."""
    model = Model.fresh(vocabulary.output_counts)
    log_noise = np.log((vocabulary.output_counts + 1) / (vocabulary.output_counts + 1).sum())
    kind = pa.schema([("block", pa.int32()), ("salt", pa.int32()), ("n", pa.int64()), ("vector", pa.binary())])
    columns = "block int, salt int, n bigint, vector binary"

    def local(start, turn):
        def run(batches):
            from pyspark import TaskContext

            part = TaskContext.get().partitionId()
            streams = (np.frombuffer(i, "<u2") for batch in batches for i in batch.column("ids").to_pylist())
            trained, n = train_local(start, streams, turn, rounds, part, log_noise)
            if n:
                blocks = np.array_split(trained.flat() * n, BLOCKS)
                yield pa.RecordBatch.from_pylist(
                    [{"block": k, "salt": part % SALTS, "n": n, "vector": b.tobytes()} for k, b in enumerate(blocks)], kind)
        return run

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v, np.float64) for v in frame["vector"])
        return pd.DataFrame({"block": frame["block"].iloc[:1], "salt": [0], "n": [frame["n"].sum()], "vector": [total.tobytes()]})

    for turn in range(rounds):
        parts = rows.select("ids").mapInArrow(local(model, turn), columns)
        summed = parts.groupBy("block", "salt").applyInPandas(add, columns).groupBy("block").applyInPandas(add, columns)
        found = {r.block: np.frombuffer(r.vector, np.float64) / r.n for r in summed.collect()}
        if found:
            model = model.like(np.concatenate([found[k] for k in range(BLOCKS)]))
    return model


class Scorer:
    """Normalised token log-probabilities; normalisers are kept by context pair."""

    def __init__(self, model: Model):
        w = {k: v.astype(np.float32) for k, v in model.w.items()}
        self.near = (w["r"] * w["c1"]) @ w["q"].T
        self.far = (w["r"] * w["c2"]) @ w["q"].T + w["b"]
        self.log_z = np.full(self.near.shape, np.nan, np.float32)

    def log_probabilities(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logarithms."""
        todo = np.isnan(self.log_z[one, two])
        if todo.any():
            pairs = np.unique(one[todo] * len(self.log_z) + two[todo])
            for at in range(0, len(pairs), 256):
                a, b = np.divmod(pairs[at : at + 256], len(self.log_z))
                scores = self.near[a] + self.far[b]
                top = scores.max(axis=1)
                self.log_z[a, b] = top + np.log(np.exp(scores - top[:, None]).sum(axis=1))
        return self.near[one, target] + self.far[two, target] - self.log_z[one, two]


def score_texts(docs: DataFrame, folds: int = 10, held_fold: int = 0) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    rest = id_remainder("doc_id", folds)
    learnt = F.coalesce(rest != held_fold, F.lit(False))
    counts = stored(word_counts(docs.where(learnt)), "lm-counts")
    vocabulary = Vocabulary.of(counts)
    encoded = T._parse_datatype_string(ENCODED)
    inputs = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("bigint").alias("doc_id"),
                         learnt.alias("learnt"), F.coalesce(rest == held_fold, F.lit(False)).alias("held_out"),
                         F.col("text").cast("string").alias("text"))
    marks = ["uid", "doc_id", "learnt", "held_out"]
    schema = T.StructType([inputs.schema[c] for c in marks] + encoded.fields)
    kind = to_arrow_schema(schema)

    def encode(batches):
        for batch in batches:
            texts, at = texts_of(batch.column("text")), 0
            for part in portions(texts):
                found = vocabulary.encode(part)
                columns = [batch.column(c).slice(at, len(part)) for c in marks]
                columns += [pa.array(found[f.name], kind.field(f.name).type) for f in encoded.fields]
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])
                at += len(part)

    rows = stored(inputs.mapInArrow(encode, schema), "lm-rows")
    model = train_model(rows.where("learnt"), vocabulary)
    slim = ["uid", "doc_id", "held_out", "n_tokens", "n_counted", "base", "within"]
    out = T.StructType([rows.schema[c] for c in slim] + [T.StructField("model", T.DoubleType())])

    token = uuid.uuid4().hex

    def judge(batches):
        scorer = per_process("lm-scorer", token, lambda: Scorer(model))  # its normalisers serve all tasks of a worker
        for batch in batches:
            ids = [np.frombuffer(i, "<u2") for i in batch.column("ids").to_pylist()]
            sums = [float(scorer.log_probabilities(*contexts(i)).sum(dtype=np.float64) / np.log(10)) for i in ids]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in slim], pa.array(sums, pa.float64())],
                                             [f.name for f in out.fields])

    judged = rows.select(*slim, "ids").mapInArrow(judge, out)
    rare = rows.select("uid", F.explode("rare").alias("x")).select("uid", F.col("x.word").alias("word"), F.col("x.n").alias("n"))
    looked = rare.join(counts, "word", "left").select(
        "uid", F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("known"),
        (F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))).alias("logs"))
    looked = looked.groupBy("uid").agg(F.sum("known").alias("known"), F.sum("logs").alias("logs"))
    extra = F.coalesce("logs", F.lit(0.0))
    total = float(np.log10(vocabulary.tokens + 0.1 * (vocabulary.distinct + 1)))
    return judged.join(looked, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_counted") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + extra - F.col("n_tokens") * F.lit(total)).alias("base_score"),
        (F.col("model") + F.col("within") + extra).alias("score"))
