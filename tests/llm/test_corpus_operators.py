"""Operators over the whole corpus: dedup, near-dedup, packing, id files, LM, pseudonyms and the pipeline."""

import datetime
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from segue.llm import exact_dedup, id_planes, lm_score, packing, pii_feistel, queries, simhash
from segue.llm.tokens import END_ID, default_path, encoder
from test_ngram_join import plain_links

BLANK = re.compile(r"[\x20\x09-\x0D]")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def mixed_docs(spark, seed=1, n=120):
    """Copies that differ in white space, near copies, nulls, empty and long texts, repeated rows and odd columns."""
    rng = random.Random(seed)
    base = [" ".join(rng.choices(["alpha", "Beta", "gamma", "dé", "x1", "omega"], k=rng.randrange(1, 60))) for _ in range(12)]
    rows = []
    for k in range(n):
        text = rng.choice(base)
        kind = rng.random()
        if kind < 0.3:
            text = text.replace(" ", rng.choice(["\n", "  ", "\t "]))
        elif kind < 0.5:
            text += " tail" * rng.randrange(3)
        rows.append((k * 3 + 1, text))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (None, "x1"), (None, None), (1003, "long " * 40_000), (5, "same"), (5, "same"), (5, "sa me")]
    return spark.createDataFrame([(d, t, "k", 1, 2, "c") for d, t in rows], "doc_id bigint, text string, row string, n int, fp int, digest string")


@pytest.mark.parametrize("digest_bytes,buffer", [(32, 32 << 20), (1, 32 << 20), (0, 400), (32, 1)])
def test_exact_groups(spark, digest_bytes, buffer):
    docs = mixed_docs(spark).repartition(5)
    groups = defaultdict(list)
    for r in docs.collect():
        groups[BLANK.sub("", r.text or "")].append((-len(r.text or ""), r.doc_id is None, r.doc_id or 0, r.doc_id))
    want = Counter()
    for plain, members in groups.items():
        best = min(members)[3]
        for m in members:
            want[m[3], best, len(members), hashlib.sha256(plain.encode()).hexdigest()] += 1
    rows = exact_dedup.exact_groups(docs, digest_bytes=digest_bytes, buffer_bytes=buffer).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == want
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)
    assert Counter(r.text_sha256 for r in rows if r.kept) == Counter(hashlib.sha256(p.encode()).hexdigest() for p in groups)


def test_distinct_documents_keep_columns(spark):
    docs = mixed_docs(spark)
    out = exact_dedup.distinct_documents(docs)
    assert out.columns == docs.columns
    assert sorted(BLANK.sub("", r.text or "") for r in out.collect()) == sorted({BLANK.sub("", r.text or "") for r in docs.collect()})
    assert exact_dedup.distinct_documents(docs.limit(0)).count() == 0


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def plain_components(fps, distance=2):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = list(parent)
    for i, a in enumerate(order):
        for b in order[:i]:
            if (a ^ b).bit_count() <= distance:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def test_fingerprint_and_spark_hash_agree(spark):
    for text in (None, "", "one", "one Two", "a b c", "É É É x y \x0b z", "w " * 70_000 + "tail"):
        assert simhash.fingerprint(text and text.encode()) % (1 << 64) == plain_fingerprint(text)
    row = spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first()
    assert row.h % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("crowd", [64, 2, 1])
def test_near_duplicates(spark, crowd):
    docs = mixed_docs(spark, 5).repartition(3)
    rows = simhash.near_duplicates(docs, ["doc_id", "text"], crowd).collect()
    fps = [plain_fingerprint(r.row.text) for r in rows]
    assert [r.fp % (1 << 64) for r in rows] == fps
    roots, least = plain_components(fps), {}
    for r, f in zip(rows, fps):
        if r.row.doc_id is not None:
            least[roots[f]] = min(least.get(roots[f], r.row.doc_id), r.row.doc_id)
    assert [r.component_id for r in rows] == [least.get(roots[f]) for f in fps]
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(roots.values()))


@pytest.mark.parametrize("crowd", [64, 3])
def test_links_of_dense_fingerprints(spark, crowd):
    """Chains and clusters of fingerprints a few bits apart, far more than a cell takes."""
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(100)}
    for seed in list(fps)[:4]:
        at = seed
        for _ in range(150):
            at ^= 1 << rng.randrange(64)
            fps.add(at)
            fps.add(seed ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    want = plain_components(fps)
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint")
    found = {r.node % (1 << 64): r.root for r in simhash.components(simhash.links(frame, crowd)).collect()}
    groups = defaultdict(set)
    for f in fps:
        groups[want[f]].add(f)
    for members in groups.values():
        assert len({found.get(f, f) for f in members}) == 1 and (len(members) == 1 or members <= set(found))
    assert len({found.get(f, f) for f in fps}) == len(groups)


def test_packing(spark):
    docs = mixed_docs(spark, 3).repartition(2)
    rows = packing.pack_documents(docs).collect()
    ids = Counter()
    tokenizer = encoder(default_path()).tokenizer
    for r in docs.collect():
        own = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, END_ID]
        first = len(own) % 1024 or min(1024, len(own))
        edges = [0, *range(first, len(own) + 1, 1024)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            ids[r.doc_id, k, a, b - a, zlib.crc32(np.array(own[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == ids
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1 + 1.05 * sum(r.length for r in rows) / 1024
    assert packing.pack_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    lengths = np.random.default_rng(1).integers(1, 400, 3000)
    place = packing.fit(lengths, 1024, 5, 300_000, rule=rule)
    used = [(lengths[place == k].sum(), (place == k).sum(), (lengths[place == k] ** 2).sum()) for k in np.unique(place)]
    assert all(t <= 1024 and n <= 5 and c <= 300_000 for t, n, c in used)


def test_segment_cache_equals_whole_encoding():
    own = encoder(default_path())
    texts = ["a  b\n c\t\td ", "  lead", "tail  \n", "don't stop!! 123 é x", "ctrl\x1c\x1d a", "<|endoftext|> b", "\n\n x", "", None,
             "y" * 100 + " " + "z" * 3000, "   em \x85 nel", "日本語 テキスト"]
    for text, got in zip(texts, own.ids(texts)):
        want = own.tokenizer.encode(text or "", add_special_tokens=False).ids + [END_ID]
        assert np.frombuffer(got, "<u4").tolist() == want, text


@pytest.mark.parametrize("bits", [False, True])
def test_id_files_round_trip(spark, folder, bits, monkeypatch):
    docs = mixed_docs(spark, 8).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).repartition(3)
    store = id_planes.write_ids(docs, bits=bits)
    at, want = 0, []
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        own = encoder(default_path()).ids([r.text])[0]
        want.append((r.doc_id, at, len(own) // 4, zlib.crc32(own)))
        at += len(own) // 4
    assert sorted(map(tuple, id_planes.read_ids(store).collect())) == want
    names = id_planes.export_files(store, folder)
    flat = [d for name in names for d in id_planes.read_file(open(name, "rb").read())]
    assert [d for d, _ in flat] == [w[0] for w in want]
    nulls = id_planes.read_ids(id_planes.write_ids(mixed_docs(spark, 8))).collect()
    assert sum(r.doc_id is None for r in nulls) == 2 and sum(r.n_tokens for r in nulls) == max(r.start + r.n_tokens for r in nulls)
    assert id_planes.read_ids(id_planes.write_ids(docs.limit(0))).count() == 0


def test_planes_of_odd_blocks():
    for n in (0, 1, 7, 8, 9, 1000):
        ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
        for bits in (False, True):
            assert np.array_equal(id_planes.from_planes(id_planes.to_planes(ids, bits), n), ids)
    with pytest.raises(ValueError):
        id_planes.read_file(b"XXXX" + id_planes.write_file([(1, b"\1\0\0\0")])[4:])


def test_lm_scores(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(None, "the of"), (9000, None), (9001, "")], "doc_id bigint, text string"))
    rows = docs.collect()
    tokens = {(r.doc_id, r.text): [*re.findall(r"[^\x20\x09-\x0D]+", lower(r.text)), ""] for r in rows}
    crc = lambda d: zlib.crc32(str(d).encode()) % 10
    counts = Counter(t for (d, _), ts in tokens.items() if d is not None and crc(d) != 0 for t in ts)
    total = sum(counts.values())
    lm = lm_score.score_texts(docs).collect()
    by_id = {d: ts for (d, _), ts in tokens.items()}
    assert len(lm) == len(rows)
    for r in lm:
        ts = by_id[r.doc_id]
        base = sum(np.log10((counts[t] + 0.1) / (total + 0.1 * (len(counts) + 1))) for t in ts)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ts), sum(counts[t] > 0 for t in ts), total)
        assert r.base_score == pytest.approx(base) and r.held_out == (r.doc_id is not None and crc(r.doc_id) == 0)
        assert np.isfinite(r.score) and r.score <= 0
    held = [r for r in lm if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) - 0.02 * abs(sum(r.base_score for r in held))
    assert lm_score.score_texts(docs.limit(0)).count() == 0


def test_lm_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    scorer = lm_score.Scorer(lm_score.Model.fresh(rng.integers(1, 9, lm_score.OUTPUTS).astype(float)))
    every = np.arange(lm_score.OUTPUTS)
    for one, two in ((0, 0), (5, 900)):
        logs = scorer.log_probabilities(np.full_like(every, one), np.full_like(every, two), every)
        assert np.exp(logs.astype(float)).sum() == pytest.approx(1, abs=1e-4)


def plain_feistel(x, y, a, b, key, tag):
    for i in range(pii_feistel.ROUNDS):
        half = y if i % 2 == 0 else x
        f = int(hashlib.sha256(f"{key}|{tag}|{i}|{half}".encode()).hexdigest()[:15], 16)
        if i % 2 == 0:
            x = (x + f) % a
        else:
            y = (y + f) % b
    return x, y


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d)
        total += d if k % 2 == 0 else d * 2 - (9 if d > 4 else 0)
    return total % 10


def plain_digits(digits, key, tag):
    n = len(digits) // 2
    x, y = plain_feistel(int(digits[:n]), int(digits[n:]), 10**n, 10 ** (len(digits) - n), key, f"{tag}{len(digits)}")
    return f"{x:0{n}d}{y:0{len(digits) - n}d}"


def test_pseudonyms(spark):
    key = "k"
    body = plain_digits("497673627372849", key, "card")
    card = body + str(next(c for c in range(10) if luhn(body + str(c)) == 0))
    day = (datetime.date(2020, 2, 29) - datetime.date(1700, 1, 1)).days
    x, y = plain_feistel(day // 773, day % 773, 189, 773, key, "date")
    new_day = datetime.date(1700, 1, 1) + datetime.timedelta(x * 773 + y)
    a, b = plain_feistel(127 * 256 + 3, 4 * 256 + 250, 65536, 65536, key, "ip")
    phone = plain_digits("2125557713", key, "phone")
    valid = "497673627372849" + str(next(c for c in range(10) if luhn("497673627372849" + str(c)) == 0))
    cases = {
        f"pay {valid}!": f"pay {card}!",
        f"{valid[:4]} {valid[4:8]}-{valid[8:12]} {valid[12:]}": f"{card[:4]} {card[4:8]}-{card[8:12]} {card[12:]}",
        "on 2020-02-29, 29.02.2020": f"on {new_day:%Y-%m-%d}, {new_day:%d.%m.%Y}",
        "ip 127.3.4.250.": f"ip {a // 256}.{a % 256}.{b // 256}.{b % 256}.",
        "+1 (212) 555-7713": f"+1 ({phone[:3]}) {phone[3:6]}-{phone[6:]}",
        "no 2021-02-30 nor 300.1.1.1 nor 4976736273728491234567 nor 666-12-1234": None,
        f"bad {valid[:-1]}{(int(valid[-1]) + 1) % 10}": None, "": None, "plain": None,
    }
    rows = [(k, t, "r", 0, "") for k, t in enumerate(cases)]
    rows += [(None, None, None, None, None), (50, "9" * 100_000, "r", 0, ""), (51, "a" * 100_000 + "@b.example", "r", 0, ""),
             (52, "ssn 123-45-6789 mail A.b@c.example and a.B@C.example x", "r", 0, ""), (53, "DE89 3704 0044 0532 0130 00", "r", 0, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row string, found int, hits string")
    got = {r.row.doc_id: r for r in pii_feistel.pseudonymize(docs, key).collect()}
    for k, (text, want) in enumerate(cases.items()):
        assert got[k].text == (text if want is None else want)
        assert (got[k].n_found > 0) == (want is not None)
    assert got[None].text is None and got[None].n_found == 0 and got[50].text == "9" * 100_000
    assert got[2].n_found == 2 and got[2].kinds == "date"
    a, b = re.findall(r"\S+@example\.invalid", got[52].text)
    assert a == b and got[52].kinds == "email,ssn" and "123-45-6789" not in got[52].text
    iban = got[53].text.replace(" ", "")
    moved = "".join(str(int(c, 36)) for c in iban[4:] + iban[:4])
    assert got[53].kinds == "iban" and iban != "DE89370400440532013000" and int(moved) % 97 == 1
    assert pii_feistel.pseudonymize(docs.limit(0), key).count() == 0


def test_feistel_is_a_permutation(spark):
    frame = spark.range(189 * 773).select(pii_feistel.feistel(F.floor(F.col("id") / 773), F.col("id") % 773, 189, 773, "k", "t").alias("p"))
    assert frame.distinct().count() == 189 * 773
    short = spark.range(1000).select(pii_feistel.permute_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("p"))
    assert {r.p for r in short.collect()} == {f"{k:03d}" for k in range(1000)}
    plan = pii_feistel.pseudonymize(spark.createDataFrame([(1, "a")], "doc_id int, text string"), "k")._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_pipeline_matches_a_plain_version(spark, sf):
    import corpus_pipeline
    from segue.llm import quality_mil

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.row.doc_id for r in quality_mil.classify(docs, labels).where("predicted = 1").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    groups = defaultdict(list)
    for d, t in texts.items():
        groups[BLANK.sub("", t)].append((-len(t), d))
    texts = {d: texts[d] for d in (min(g)[1] for g in groups.values())}
    named = sorted(texts)
    near = {named[root] for _, root in plain_links([texts[d] for d in named], 5, 4, 5)}
    assert len(near) < len(texts)
    texts = {d: t for d, t in texts.items() if d in near}
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r.text))
        n = min(13, len(own))
        windows |= {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
    sizes = {len(w) for w in windows}
    want = Counter()
    for d, t in texts.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        hit = {k for n in sizes for i in range(len(words) - n + 1) if tuple(words[i : i + n]) in windows for k in range(i, i + n)}
        if not hit or 20 * len(hit) < len(words):
            own = encoder(default_path()).ids([t])[0]
            for p in packing.cut(own):
                want[d, p["piece"], p["start"], p["length"], p["ids_crc32"]] += 1
    rows = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries()) and set(queries.ORACLES) <= set(entry.oracle_sql())
