"""Fill-in-middle: output and restored texts against a plain version, in pieces of a few bytes too."""

import hashlib
import re

import pytest

from segue.llm import fill_middle


def plain(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    x, y = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
    if not text or re.search("<[PSM]>", text):
        return n, "plain", None, None, text, text
    form = "spm" if h4 % 100 < 50 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return n, form, len(p), len(m), out, text


def documents(spark):
    texts = [None, "", "\n", "\n\n\n", "one line", "a\nb\nc\nd\n", "é\nüber\n日本\nlast", "has <P> in it\nx", "x<\nP>\ny<M", "\r\n\x0b\n",
             "".join(f"line {k} ü\n" for k in range(4000)), "w" * 100_000 + "\nend", "<S", "a\n<\nS\n>"]
    rows = [(k, t) for k, t in enumerate(texts * 3)] + [(None, "a\nb"), (5, "again\nand\nagain\n"), (5, "again\nand\nagain\n")]
    return rows, spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, number int, form string").repartition(4)


@pytest.mark.parametrize("piece", [7, 1000, fill_middle.PIECE_BYTES])
def test_outputs_and_restored_texts(spark, piece):
    rows, docs = documents(spark)
    want = [plain(*r) for r in rows]
    sent = fill_middle.pieces(docs, piece_bytes=piece)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    key = lambda row: tuple((v is None, v) for v in row)
    assert sorted(map(tuple, fill_middle.digests(sent).collect()), key=key) == sorted(
        ((r[0], *w[:4], sha(w[4]), sha(w[5])) for r, w in zip(rows, want)), key=key)
    for restored in (False, True):
        assert sorted(map(tuple, fill_middle.texts(sent, restored).collect()), key=key) == sorted(
            ((r[0], w[1], w[5] if restored else w[4]) for r, w in zip(rows, want)), key=key)
    assert {w[1] for w in want} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


def test_restoring_reads_the_output(spark):
    """A changed output gives another restored text: nothing is taken from the source."""
    from pyspark.sql import functions as F

    import zstandard

    docs = spark.createDataFrame([(2, "a\nb\nc\nd\ne\nf\n")], "doc_id bigint, text string")
    sent = fill_middle.pieces(docs)
    other = sent.select(*sent.columns[:-1], F.lit(bytearray(zstandard.compress(b"zz"))).alias("payload")).sortWithinPartitions("number", "place")
    row = fill_middle.digests(other).first()
    assert row.restored_sha256 != hashlib.sha256(b"a\nb\nc\nd\ne\nf\n").hexdigest()


def test_sentinels_across_pieces():
    split = fill_middle.Splitter("spm")
    got = {}
    for k in (b"<", b"S>suf\n<", b"P", b">pre<", b"M>", b"mid<P>"):
        for mark, data in split.feed(k):
            got[mark] = got.get(mark, b"") + data
    for mark, data in split.feed(b"", last=True):
        got[mark] = got.get(mark, b"") + data
    assert got == {b"<S>": b"suf\n", b"<P>": b"pre", b"<M>": b"mid<P>"}
