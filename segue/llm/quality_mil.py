"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages (``PASSAGE`` bytes of its text, the whole text, cut anywhere). Each passage has a fixed
feature vector: counts of byte classes and of pairs of byte classes, scaled to frequencies, and a few shape measures. A
learned layer encodes every passage, gated attention (tanh and sigmoid branches) weighs the passages of a document
against each other, and a logistic unit scores the weighted sum. Only document labels are used.

The net is fitted in numpy on at most ``SAMPLE`` labelled documents (as many of either label, those first by a hash of
the id) and at most ``BAG`` passages of each, evenly spaced over the text; scoring takes every passage of every text.
The weights are some 50 kB. Scoring makes no shuffle.

Null and empty texts are a bag of one blank passage and get a score as others do. Without labels of both kinds the net
has nothing to tell apart: all documents get the share of label 1 among the labels (1 without labels). Repeated labels
of one id count by their mean. Labels, lang, source and doc_id are never features.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, id_remainder, quoted

PASSAGE = 512
SAMPLE = 4000
BAG = 48
HIDDEN, GATE = 24, 12
EPOCHS = 12
THRESHOLD = 0.3

GROUPS = 16
FINE = 64


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    """Fine class (each ASCII punctuation mark apart, letters by case) and coarse class of every byte."""
    fine, coarse = np.zeros(256, np.int64), np.zeros(256, np.int64)
    marks = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
    for b in range(256):
        char = chr(b)
        if b >= 0x80:
            fine[b], coarse[b] = 1, 1
        elif char.islower():
            fine[b], coarse[b] = (2, 2) if char in "aeiouy" else (3, 3)
        elif char.isupper():
            fine[b], coarse[b] = 4, 4
        elif char.isdigit():
            fine[b], coarse[b] = 5, 5
        elif char == " ":
            fine[b], coarse[b] = 6, 6
        elif char == "\n":
            fine[b], coarse[b] = 7, 7
        elif b in marks:
            fine[b], coarse[b] = 8 + marks.index(b), 8 + (".,;:".find(char) + 1 if char in ".,;:" else 5 + marks.index(b) % 3)
    return fine, coarse


_FINE, _COARSE = _byte_classes()
WIDTH = FINE + GROUPS * GROUPS + 3


def passages(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of some texts, and where each text's passages begin."""
    sizes = np.array([len(t) if t else 0 for t in texts], np.int64)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    begins = np.concatenate([[0], np.cumsum(counts)])
    data = np.frombuffer(b"".join(t or b"" for t in texts), np.uint8)
    total = int(begins[-1])
    offsets = np.cumsum(sizes) - sizes
    owner = np.repeat(begins[:-1] - 0, sizes) + (np.arange(len(data)) - np.repeat(offsets, sizes)) // PASSAGE
    fine, coarse = _FINE[data], _COARSE[data]
    single = np.bincount(owner * FINE + fine, minlength=total * FINE).reshape(total, FINE)
    same = owner[1:] == owner[:-1]
    pair = np.bincount((owner[1:] * GROUPS * GROUPS + coarse[:-1] * GROUPS + coarse[1:])[same],
                       minlength=total * GROUPS * GROUPS).reshape(total, GROUPS * GROUPS)
    length = np.maximum(1, single.sum(axis=1, keepdims=True)).astype(np.float32)
    words = single[:, 6:8].sum(axis=1, keepdims=True)
    shape = np.concatenate([length / PASSAGE, length / (8.0 * (1 + words)), np.ones_like(length)], axis=1)
    return np.sqrt(np.concatenate([single / length, pair / length, shape], axis=1, dtype=np.float32)), begins


class Net:
    """Passage encoder, gated attention and logistic unit, with Adam."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        shapes = {"W": (WIDTH, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": ()}
        self.p = {k: rng.normal(0, (s[0] ** -0.5 if s else 0.0), s) if k not in "bd" else np.zeros(s) for k, s in shapes.items()}
        self.mean, self.scale = np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32)

    def forward(self, x: np.ndarray, begins: np.ndarray) -> dict:
        p, starts = self.p, begins[:-1]
        x = (x - self.mean) * self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        counts = np.diff(begins)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
        a = e / np.repeat(np.add.reduceat(e, starts), counts)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "y": y, "counts": counts}

    def gradients(self, f: dict, labels: np.ndarray, weight: np.ndarray) -> dict:
        p, counts = self.p, f["counts"]
        dy = (f["y"] - labels) * weight / weight.sum()
        dz = np.repeat(dy[:, None] * p["c"], counts, axis=0)
        da = (dz * f["h"]).sum(axis=1)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, starts), counts))
        dt, ds = de[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2), de[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"])
        dh = f["a"][:, None] * dz + dt @ p["V"].T + ds @ p["U"].T
        dx = dh * (1 - f["h"] ** 2)
        return {"W": f["x"].T @ dx + 1e-4 * p["W"], "b": dx.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ ds,
                "w": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ dy, "d": dy.sum()}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 5e-3):
        """Both labels weigh the same in all."""
        rows = np.concatenate(bags)
        self.mean, self.scale = rows.mean(axis=0), 1 / (rows.std(axis=0) + 0.02)
        weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
        rng, step = np.random.default_rng(5), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                begins = np.concatenate([[0], np.cumsum([len(bags[k]) for k in some])])
                g = self.gradients(self.forward(np.concatenate([bags[k] for k in some]), begins), labels[some], weight[some])
                step += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.p = {k: np.asarray(x, np.float32) for k, x in self.p.items()}
        return self


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0, sample: int = SAMPLE):
    """Net fitted on labelled documents outside the held-out fold, or the constant score."""
    marks = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("q"))
    marks = marks.where(id_remainder("doc_id", folds) != held_fold).select("doc_id", (F.col("q") >= 0.5).cast("int").alias("label"))
    chosen = [marks.where(f"label = {k}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for k in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])  # at most SAMPLE ids
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))  # one text an id

    def per_batch(texts):
        out = []
        for text in texts:
            x, _ = passages([text])
            pick = np.unique(np.linspace(0, len(x) - 1, min(len(x), BAG)).astype(int))
            out.append(x[pick].astype(np.float16).tobytes())
        return {"bag": out}

    found = annotate(rows, "bag binary", per_batch, ["label"]).select("row.label", "found.bag").toArrow().to_pydict()
    label = np.array(found["label"], np.float64)
    if not len(label) or label.min() == label.max():
        share = marks.agg(F.avg("label").alias("s")).first()["s"]
        return 1.0 if share is None else float(share)
    order = sorted(range(len(label)), key=lambda k: (found["bag"][k], label[k]))
    bags = [np.frombuffer(found["bag"][k], np.float16).reshape(-1, WIDTH).astype(np.float32) for k in order]
    return Net().fit(bags, label[order])


FOUND = "score double"


def score(docs: DataFrame, net, keep: list[str] | None = None) -> DataFrame:
    """Columns ``row`` and ``found.score`` for every document, whole text."""

    def per_batch(texts):
        if isinstance(net, float):
            return {"score": [net] * len(texts)}
        scores, at, size = [], 0, 0
        for k, text in enumerate(texts):
            size += len(text or b"")
            if size > 1 << 18 or k + 1 == len(texts):
                x, begins = passages(texts[at : k + 1])
                scores += net.forward(x, begins)["y"].astype(np.float64).tolist()
                at, size = k + 1, 0
        return {"score": scores}

    return annotate(docs, FOUND, per_batch, keep)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0, threshold: float = THRESHOLD,
             keep: list[str] | None = None) -> DataFrame:
    """Learn and score: columns ``row``, ``held_out``, ``score``, ``predicted``."""
    out = score(docs, train(docs, labels, folds, held_fold), keep)
    held = F.coalesce(id_remainder(f"row.{quoted('doc_id')}", folds) == held_fold, F.lit(False))
    return out.select("row", held.alias("held_out"), F.col("found.score").alias("score"),
                      (F.col("found.score") >= threshold).cast("int").alias("predicted"))
