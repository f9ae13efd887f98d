"""Benchmark decontamination with a generalised suffix automaton over test-item words.

Every test item is cut into pieces that overlap by ``window - 1`` words, so each window of ``window`` consecutive words
lies whole in one piece. The pieces of a shard form one automaton of bounded size (``SHARD_WORDS``), which is broadcast;
training texts stream through it, keeping the longest suffix that is also a substring of some item. A match of
``window`` words or more ends an occurrence; shorter items are one window each. Documents are never shuffled. A benchmark
of more than one shard is matched shard by shard over stored tables.

Nulls and empty texts have no words and no hits. An empty table gives no rows, an empty benchmark no hits. Null item texts and items without words never match; a null item id
counts as the id "null". Repeated rows are judged alike, one by one. Input columns of any name are kept in ``row``.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_BYTES, annotate, per_process, stored, text_words

WINDOW = 13
WORD_MOST = 64
"""Longer words are matched by a digest of that size or less."""
PIECE_WORDS = 4096
SHARD_WORDS = 250_000
"""Words in one automaton: at most twice as many states, about 300 MB in a Python worker."""

FOUND = ("n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, longest bigint, "
         "item_ids array<string>, spans array<struct<first:bigint,last:bigint>>")


def short_words(text: bytes | None) -> list[bytes]:
    """The words of a text, those over ``WORD_MOST`` bytes as digests (which start with a blank, as no word does)."""
    words = text_words(text)
    if words and len(max(words, key=len)) > WORD_MOST:
        words = [w if len(w) <= WORD_MOST else b" " + hashlib.blake2b(w, digest_size=24).hexdigest().encode() for w in words]
    return words


class Automaton:
    """Generalised suffix automaton; ``ends[state]`` lists (window length, item) pairs that end in a state."""

    def __init__(self, pieces: Iterator[tuple[str, list[bytes], int]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.ends: dict[int, dict[int, set[str]]] = {}
        pieces = list(pieces)
        for _, words, _ in pieces:
            last = 0
            for word in words:
                last = self._extend(last, word)
        for item, words, window in pieces:
            self._mark(item, words, window)
        self.need = self._thresholds()
        self._memo: dict[tuple[int, int], tuple[int, frozenset[str]]] = {}

    def _state(self, size: int, edges: dict[bytes, int], link: int) -> int:
        self.next.append(edges)
        self.size.append(size)
        self.link.append(link)
        return len(self.size) - 1

    def _split(self, parent: int, word: bytes, child: int) -> int:
        """Give the strings of ``child`` that end a path through ``parent`` a state of their own."""
        twin = self._state(self.size[parent] + 1, dict(self.next[child]), self.link[child])
        self.link[child] = twin
        while parent >= 0 and self.next[parent].get(word) == child:
            self.next[parent][word] = twin
            parent = self.link[parent]
        return twin

    def _target(self, parent: int, word: bytes) -> int:
        child = self.next[parent][word]
        return child if self.size[child] == self.size[parent] + 1 else self._split(parent, word, child)

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.next[last]:
            return self._target(last, word)
        state = self._state(self.size[last] + 1, {}, 0)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = state
            last = self.link[last]
        if last >= 0:
            self.link[state] = self._target(last, word)
        return state

    def _mark(self, item: str, words: list[bytes], window: int) -> None:
        state = 0
        for seen, word in enumerate(words, 1):
            state = self.next[state][word]
            if seen >= window:
                at = state
                while self.size[self.link[at]] >= window:
                    at = self.link[at]
                self.ends.setdefault(at, {}).setdefault(window, set()).add(item)

    def _thresholds(self) -> list[int]:
        """Matched length from which a state or one of its suffixes ends a window."""
        need = [1 << 60] * len(self.size)
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            need[state] = min(need[self.link[state]], min(self.ends.get(state, ()), default=1 << 60))
        return need

    def _windows(self, state: int, matched: int) -> tuple[int, frozenset[str]]:
        """Longest window and all items with a window ending here."""
        key = (state, min(matched, WINDOW))
        if key not in self._memo:
            longest, items = 0, set()
            while state > 0:
                for window, owners in self.ends.get(state, {}).items():
                    if window <= matched:
                        longest = max(longest, window)
                        items |= owners
                state = self.link[state]
            self._memo[key] = longest, frozenset(items)
        return self._memo[key]

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str], int]:
        """Merged spans of hit words (first, last), items found, longest match."""
        step, link, size, need, root = self.next, self.link, self.size, self.need, self.next[0]
        state = matched = best = 0
        spans: list[list[int]] = []
        items: set[str] = set()
        for at, word in enumerate(words):
            to = step[state].get(word)
            while to is None and state:
                state = link[state]
                matched = size[state]
                to = step[state].get(word) if state else root.get(word)
            if to is None:
                matched = 0
                continue
            state = to
            matched += 1
            if matched >= need[state]:
                longest, owners = self._windows(state, matched)
                first = at - longest + 1
                items |= owners
                while spans and spans[-1][1] >= first - 1:
                    first = min(first, spans.pop()[0])
                spans.append([first, at])
            if matched > best:
                best = matched
        return spans, items, best


def pieces_of(item: str, text: bytes | None, window: int = WINDOW) -> Iterator[tuple[str, list[bytes], int]]:
    words = short_words(text)
    if words:
        own = min(window, len(words))
        for start in range(0, max(1, len(words) - own + 1), PIECE_WORDS - own + 1):
            yield item, words[start : start + PIECE_WORDS], own


def _shards(benchmark: DataFrame, shard_words: int) -> list[DataFrame]:
    """Piece tables of at most ``shard_words`` words, or one piece; as words are of bounded size, so are the shards."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"),
                             F.col("text").cast("string").cast("binary").alias("text"))

    def cut(batches):
        for batch in batches:
            rows = [{"item": i, "words": b"\x00".join(w), "own": n, "n": len(w)}
                    for item, text in zip(*(c.to_pylist() for c in batch.columns)) for i, w, n in pieces_of(item, text)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema(
                [("item", pa.string()), ("words", pa.binary()), ("own", pa.int32()), ("n", pa.int64())]))

    pieces = stored(items.mapInArrow(cut, "item string, words binary, own int, n bigint"), "benchmark-pieces")
    total = pieces.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    count = max(1, -(-int(total) // max(1, shard_words // 2)))
    if count == 1:
        return [pieces]
    pieces = pieces.distinct()

    def shard(count):
        return F.pmod(F.xxhash64("item", "words"), F.lit(count))

    for _ in range(8):
        if pieces.groupBy(shard(count).alias("k")).agg(F.sum("n").alias("n")).agg(F.max("n").alias("n")).first()["n"] <= max(shard_words, PIECE_WORDS):
            break
        count *= 2
    return [pieces.where(shard(count) == k) for k in range(count)]


def _merge(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and out[-1][1] >= first - 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, one_in: int = 20, keep: list[str] | None = None,
                  shard_words: int = SHARD_WORDS) -> DataFrame:
    """Hits of benchmark windows in every text: columns ``row`` and ``found`` (see ``FOUND``).

    A document is contaminated if at least one in ``one_in`` of its words is hit. ``spans`` are word positions.
    """
    shards = _shards(benchmark, shard_words)
    if len(shards) == 1:
        return annotate(docs, FOUND, _matcher(docs.sparkSession, shards[0], one_in), keep)
    out = annotate(docs, FOUND, _matcher(docs.sparkSession, shards[0], one_in))
    for number, shard in enumerate(shards[1:], 1):
        before = stored(out, f"decontaminate-{number}").select("row", "found", F.col("row.text").alias("text"))
        both = annotate(before, FOUND, _matcher(docs.sparkSession, shard, one_in), ["row", "found"])
        out = _joined(both, one_in)
    kept = docs.columns if keep is None else keep
    return out.select(F.struct(*[F.col("row").getField(c).alias(c) for c in kept]).alias("row"), "found")


def _joined(both: DataFrame, one_in: int) -> DataFrame:
    """Merge the findings of two shards, row by row."""
    schema = T.StructType([both.schema["row"].dataType["row"], both.schema["found"]])

    def run(batches):
        for batch in batches:
            row, found = batch.column("row"), batch.column("found")
            merged = []
            for a, b in zip(row.field("found").to_pylist(), found.to_pylist()):
                spans = _merge([[s["first"], s["last"]] for s in a["spans"] + b["spans"]])
                merged.append(_verdict(a["n_words"], spans, {*a["item_ids"], *b["item_ids"]},
                                       max(a["longest"], b["longest"]), one_in))
            yield pa.RecordBatch.from_arrays([row.field("row"), pa.array(merged, found.type)], ["row", "found"])

    return both.mapInArrow(run, schema)


def _verdict(n_words: int, spans: list[list[int]], items: set[str], longest: int, one_in: int) -> dict:
    n_hit = sum(last - first + 1 for first, last in spans)
    ids = sorted(items)
    return {"n_words": n_words, "n_hit": n_hit, "n_items": len(ids),
            "items_sha256": hashlib.sha256(",".join(ids).encode()).hexdigest(),
            "contaminated": n_hit > 0 and one_in * n_hit >= n_words, "longest": longest, "item_ids": ids,
            "spans": [{"first": a, "last": b} for a, b in spans]}


def _matcher(spark: SparkSession, shard: DataFrame, one_in: int):
    rows = shard.select("item", "words", "own").toArrow().to_pylist()
    pieces = [(r["item"], r["words"].split(b"\x00"), r["own"]) for r in rows]
    shared, token = spark.sparkContext.broadcast(pieces), uuid.uuid4().hex

    def per_batch(texts):
        automaton = per_process("automaton", token, lambda: Automaton(shared.value))
        found = []
        for text in texts:
            words = short_words(text)
            found.append(_verdict(len(words), *automaton.scan(words), one_in))
        return {name: [x[name] for x in found] for name in found[0]}

    return per_batch


def remove_spans(docs: DataFrame, benchmark: DataFrame, length: int = 50, coverage: float = 0.05, keep: list[str] | None = None,
                 shard_words: int = SHARD_WORDS) -> DataFrame:
    """Mended texts: columns ``row``, ``text``, ``removed`` (word spans cut out) and ``n_removed`` (words).

    A span of hit words is cut out if it has ``length`` words or more; where all spans cover at least ``coverage`` of a text's
    words, all are. Other texts stay as they are, null stays null, a text that is one span becomes empty. What stands around
    a span (punctuation, blanks) is kept. Texts go no further than the task that matched them, unless the benchmark has
    several shards.
    """
    keep = docs.columns if keep is None else keep
    inner = keep + [c for c in ("text",) if c not in keep]
    found = decontaminate(docs, benchmark, keep=inner, shard_words=shard_words)
    row = F.struct(*[F.col("row").getField(c).alias(c) for c in keep]).alias("row")
    rows = found.select(row, F.col("row.text").cast("string").alias("text"), F.col("found.n_words").alias("n_words"), F.col("found.spans").alias("spans"))
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType()), T.StructField("removed", rows.schema["spans"].dataType),
                           T.StructField("n_removed", T.LongType())])

    def run(batches):
        for batch in batches:
            texts, cut = [], []
            for text, words, spans in zip(*(batch.column(c).to_pylist() for c in ("text", "n_words", "spans"))):
                sizes = [s["last"] - s["first"] + 1 for s in spans]
                every = bool(spans) and sum(sizes) >= coverage * words
                cut.append([s for s, n in zip(spans, sizes) if every or n >= length])
                texts.append(without_spans(text, cut[-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(texts, pa.string()), pa.array(cut, batch.column("spans").type),
                 pa.array([sum(s["last"] - s["first"] + 1 for s in c) for c in cut], pa.int64())], ["row", "text", "removed", "n_removed"])

    return rows.mapInArrow(run, schema)


def without_spans(text: str | None, spans) -> str | None:
    """The text with the given word spans cut out, for callers that mend documents in place of dropping them."""
    if not text or not spans:
        return text
    data = text.encode()
    masked = data.translate(WORD_BYTES)
    edges, inside = [], False
    for at, byte in enumerate(masked):
        if (byte != 0x20) != inside:
            inside = not inside
            edges.append(at)
    if inside:
        edges.append(len(data))
    out, done = [], 0
    for span in spans:
        out.append(data[done : edges[2 * span["first"]]])
        done = edges[2 * span["last"] + 1]
    return b"".join([*out, data[done:]]).decode()
