"""Operators that judge texts one by one, against plain versions on small tables."""

import hashlib
import random
import re

import pytest

from segue.llm import decontaminate, language_id, license_scan, quality_mil
from segue.llm.common import text_words

SCHEMA = "doc_id bigint, text string, row string, found int, score double"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def edge_docs(spark, texts):
    rows = [(k, t, "r", k, 0.5) for k, t in enumerate(texts)]
    rows += [(None, None, None, None, None), (7, "", "r", 1, 0.0), (7, "", "r", 1, 0.0), (8, " \n\t ", "r", 1, 0.0)]
    return spark.createDataFrame(rows, SCHEMA)


def test_words_are_the_contract_words():
    for text in ("Ünder-Score_9 ÀB c", "a\x00b\x7fc", "日本語 Text", "A" * 5000 + " b"):
        assert [w.decode() for w in text_words(text.encode())] == words_of(text)


def plain_hits(items, text):
    words, hit, found = words_of(text), set(), set()
    for item, body in items:
        own = words_of(body)
        n = min(13, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add("null" if item is None else str(item))
    return len(words), len(hit), sorted(found)


@pytest.fixture(scope="module")
def benchmark_items():
    rng = random.Random(4)
    vocabulary = ["of", "Tall", "xa", "yé", "zz9"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([3, 12, 13, 14, 40])))) for k in range(25)]
    return [*items, (3, "of tall, ZZ9"), (None, "lone-null item words"), (99, None), (98, "..."), (97, items[0][1])]


@pytest.mark.parametrize("shard_words", [250_000, 200])
def test_decontamination_matches_plain_windows(spark, benchmark_items, shard_words):
    rng = random.Random(9)
    vocabulary = ["of", "Tall", "xa", "yé", "zz9", "other"]
    texts = []
    for _ in range(40):
        text = " ".join(rng.choices(vocabulary, k=rng.randrange(0, 120)))
        if rng.random() < 0.5:
            text += "; " + (rng.choice(benchmark_items)[1] or "")
        texts.append(text)
    texts += [" ".join(["filler"] * 30_000) + " of tall zz9", "lone null ITEM words", benchmark_items[5][1] * 2]
    docs = edge_docs(spark, texts)
    bench = spark.createDataFrame(benchmark_items, "item_id bigint, text string")
    rows = decontaminate.decontaminate(docs, bench, shard_words=shard_words).collect()
    assert len(rows) == docs.count()
    for r in rows:
        n_words, n_hit, ids = plain_hits(benchmark_items, r.row.text)
        got = r.found
        assert (got.n_words, got.n_hit, got.n_items, list(got.item_ids)) == (n_words, n_hit, len(ids), ids)
        assert got.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()
        assert got.contaminated == (n_hit > 0 and 20 * n_hit >= n_words)
        assert sum(s["last"] - s["first"] + 1 for s in got.spans) == n_hit
        left = words_of(decontaminate.without_spans(r.row.text, got.spans))
        assert len(left) == n_words - n_hit
    assert set(rows[0].row.asDict()) == {"doc_id", "text", "row", "found", "score"}


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "some words")], "doc_id bigint, text string")
    assert [r.found.n_hit for r in decontaminate.decontaminate(docs, none).collect()] == [0]
    assert decontaminate.decontaminate(docs.limit(0), none).count() == 0


def test_license_templates():
    scan = license_scan.Scanner(license_scan.BASE, license_scan.TEMPLATES).scan
    mit = license_scan.TEMPLATES[0][2].replace("[[ associated ]]", "associated").replace("[[", "").replace("]]", "")
    assert scan(mit.encode())["labels"] == "mit" and scan(mit.encode())["score"] == 1.0
    assert scan(mit.replace("associated", "").encode())["score"] == 1.0  # optional word
    assert scan(mit.replace("merge", "mangle").encode())["score"] == 0.0  # mandatory word changed
    r = scan(b"Code: licensed under the GNU General  Public License, version 3. MIT License MIT license, cc-by")
    assert (r["n_base"], r["first_word"], r["last_word"]) == (4, 4, 14)
    assert r["base_labels"] == "cc-by,gpl,mit" and r["labels"] == "cc-by,gpl,gpl-3.0,mit" and r["score"] == 0.9
    assert scan(b"released under the terms of the MIT License")["labels"] == "mit"
    assert scan(b"released under the many odd other MIT License")["score"] == license_scan.BASE_WEIGHT
    assert scan(None)["labels"] == "" and scan(b"")["first_word"] is None


def test_license_base_matches_plain_search(spark):
    rng = random.Random(3)
    bits = ["MIT", "license", "Apache", "cc", "BY", "gnu", "general", "public", "x"]
    docs = edge_docs(spark, [" ".join(rng.choices(bits, k=60)) for _ in range(30)] + ["x " * 50_000 + "mit license"])
    for r in license_scan.scan_licenses(docs).collect():
        words, places, labels = words_of(r.row.text), [], set()
        for phrase, label in license_scan.BASE.items():
            want = phrase.split()
            at = [i for i in range(len(words)) if words[i : i + len(want)] == want]
            places += at
            labels |= {label} if at else set()
        assert r.found.n_words == len(words) and r.found.n_base == len(places)
        assert r.found.first_word == min(places, default=None) and r.found.last_word == max(places, default=None)
        assert r.found.base_labels == ",".join(sorted(labels))


def test_quality_learns_and_defines_edges(spark, sf):
    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/../sf0.01/labels.parquet")
    out = quality_mil.classify(docs, labels, keep=["doc_id"]).select("row.doc_id", "held_out", "predicted", "score")
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.93
    edges = edge_docs(spark, ["x", "word " * 60_000])
    assert all(0 <= r.score <= 1 for r in quality_mil.classify(edges, labels).collect())
    assert {r.score for r in quality_mil.classify(edges, labels.limit(0)).collect()} == {1.0}
    assert quality_mil.classify(edges.limit(0), labels).count() == 0


def test_attention_gradients():
    import numpy as np

    rng = np.random.default_rng(0)
    net, x, begins = quality_mil.Net(), rng.normal(size=(7, quality_mil.WIDTH)), np.array([0, 2, 3, 7])
    labels, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0])

    def loss():
        y = net.forward(x, begins)["y"]
        return -(weight * (labels * np.log(y) + (1 - labels) * np.log(1 - y))).sum() / weight.sum() + 5e-5 * (net.p["W"] ** 2).sum()

    grads = net.gradients(net.forward(x, begins), labels, weight)
    for name, at in (("W", (5, 3)), ("b", 2), ("V", (1, 1)), ("U", (4, 2)), ("w", 3), ("c", 6)):
        keep = net.p[name][at]
        net.p[name][at] = keep + 1e-5
        up = loss()
        net.p[name][at] = keep - 1e-5
        assert grads[name][at] == pytest.approx((up - loss()) / 2e-5, abs=1e-6)
        net.p[name][at] = keep


def test_language_profiles(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    rows = language_id.identify(docs).select("row.*", "held_out", "found.*").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    langs, prototypes = language_id.train(docs)
    edges = edge_docs(spark, ["123 !?", "the of and", "der die das " * 40_000])
    found = {(r.row.doc_id, r.row.text): r.found for r in language_id.predict(edges, langs, prototypes).collect()}
    assert found[None, None].lang_pred == found[7, ""].lang_pred == found[0, "123 !?"].lang_pred == "und"
    assert found[1, "the of and"].lang_pred == "en" and found[1, "the of and"].score > 0
    assert {r.found.lang_pred for r in language_id.predict(edges, *language_id.train(docs.limit(0))).collect()} == {"und"}


def test_bundle_is_the_sum_of_bound_permuted_letters():
    import numpy as np

    space = language_id.Profiles(dim=32)
    grams = space.ngrams("Ab, c")
    letters = [0, space.table[ord("a")], space.table[ord("b")], 0, space.table[ord("c")], 0]
    want = sum(space.places[0][a].astype(int) * space.places[1][b] * space.places[2][c] for a, b, c in zip(letters, letters[1:], letters[2:]))
    assert np.array_equal(space.bundle([grams])[0], want)
