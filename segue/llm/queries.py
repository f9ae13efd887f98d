"""Registered queries of the corpus operators, with SQL twins where SQL can express them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontaminate, exact_dedup, fill_middle, id_planes, language_id, license_scan, lm_score, ngram_join, packing,
               pii_feistel, quality_mil, simhash, source_divergence)

PII_KEY = "segue-demonstration-key"
"""Key of the registered query; callers pass their own."""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(_docs(spark, sf_dir), _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("row.doc_id", "found.n_words", "found.n_hit", "found.n_items", "found.items_sha256",
                        "found.contaminated")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(_docs(spark, sf_dir), ["doc_id"])
    return found.select("row.doc_id", "found.n_words", "found.n_base", "found.first_word", "found.last_word",
                        "found.base_labels", "found.labels", "found.score")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_mil.classify(_docs(spark, sf_dir), _table(spark, sf_dir, "labels"), keep=["doc_id"])
    return found.select("row.doc_id", "held_out", "score", "predicted")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.identify(docs, keep=["doc_id"])
    return found.select("row.doc_id", "held_out", "found.lang_pred", "found.score")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_docs(spark, sf_dir))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_texts(_docs(spark, sf_dir))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_feistel.pseudonymize(_docs(spark, sf_dir), PII_KEY, ["doc_id"])
    return found.select("row.doc_id", "text", "n_found", "kinds")


def op8_id_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_planes.read_ids(id_planes.write_ids(_docs(spark, sf_dir)))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_docs(spark, sf_dir)).drop("row")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_docs(spark, sf_dir), ["doc_id"])
    return found.select("row.doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergences(_table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fill_in_middle(_docs(spark, sf_dir))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(_docs(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_license_scan, op3_quality, op4_language_id, op5_packing,
                                   op6_lm_score, op7_pii, op8_id_planes, op9_exact_dedup, op10_simhash, op11_source_divergence,
                                   op12_fill_middle, op13_ngram_join)}


def _words_sql(column: str, pattern: str = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+") -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{upper}', '{lower}'), '{pattern}')"


OP1_SQL = f"""
WITH dw AS (SELECT doc_id, {_words_sql('text')} AS w FROM documents),
iw AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_words_sql('text')} AS w FROM benchmark),
items AS (SELECT item, w, least(13, len(w)) AS n FROM iw WHERE len(w) > 0),
wins AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g
         FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
places AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
           FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
                 FROM dw, (SELECT DISTINCT n FROM items) WHERE len(w) >= n)),
met AS (SELECT DISTINCT doc_id, item, p.n, i FROM places p JOIN wins USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM met) GROUP BY 1),
own AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS digest
        FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(digest, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)
"""


def _license_regex(template: str) -> str:
    """Pattern of a template over words with one blank before each, from its text (not by the operator's parser)."""
    text = re.sub(r"\{\{([0-9]+)[^}]*\}\}", " any\u00b7\\1 ", template.lower()).replace("[[", " open\u00b7 ").replace("]]", " shut\u00b7 ")
    out, depth, begun = [], 0, False
    for word in re.sub("[^0-9a-z\u00b7]+", " ", text).split():
        kind = word.partition("\u00b7")[0] if "\u00b7" in word else None
        depth += (kind == "open") - (kind == "shut")
        begun = begun or (kind is None and not depth)
        if begun:
            out.append({"open": "(?:", "shut": ")?"}.get(kind) or (f"(?: [^ ]+){{0,{word.partition(chr(0xb7))[2]}}}" if kind else " " + word))
    return "".join(out)


def _license_sql() -> str:
    def starts(phrase: str) -> str:
        words = phrase.split()
        test = " AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(words))
        return f"list_filter(range(1, CAST(len(w) AS BIGINT) + 1), lambda i: {test})"

    bases = list(license_scan.BASE.items())
    columns = ", ".join(f"{starts(phrase)} AS b{k}" for k, (phrase, _) in enumerate(bases))
    base = ", ".join(f"CASE WHEN len(b{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(bases))
    every = " || ".join(f"b{k}" for k in range(len(bases)))
    labels, weights, whole = [], [], {}
    for label, weight, text in license_scan.TEMPLATES:
        test = f"regexp_matches(line, '{_license_regex(text)} ')"
        if weight == 1.0:
            whole[label] = test
        for other in license_scan.UNLESS.get(label, ()):
            test += f" AND NOT {whole[other]}"
        labels.append(f"CASE WHEN {test} THEN '{label}' END")
        weights.append(f"CASE WHEN {test} THEN {weight} ELSE 0.0 END")
    joined = "coalesce(array_to_string(list_sort(list_distinct(list_filter([{}], lambda x: x IS NOT NULL))), ','), '')"
    return f"""
WITH dw AS (SELECT doc_id, {_words_sql('text')} AS w FROM documents),
b AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS line, {columns} FROM dw),
c AS (SELECT *, {every} AS places FROM b)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base,
       list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word,
       {joined.format(base)} AS base_labels, {joined.format(base + ', ' + ', '.join(labels))} AS labels,
       CAST(greatest(CASE WHEN len(places) > 0 THEN {license_scan.BASE_WEIGHT} ELSE 0.0 END, {', '.join(weights)}) AS DOUBLE) AS score
FROM c
"""


OP9_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain FROM documents),
k AS (SELECT doc_id, plain, first_value(doc_id) OVER (PARTITION BY plain ORDER BY chars DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY plain) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(plain) AS text_sha256 FROM k
"""

LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

OP11_SQL = f"""
WITH t AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_words_sql('text', LETTERS)} AS w
           FROM documents),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM t) GROUP BY ALL),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM t) GROUP BY ALL HAVING count(*) >= 30),
g AS (SELECT DISTINCT lang, source FROM t),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grid AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n
         FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n,
             1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (CAST(sum(n) OVER (PARTITION BY lang, source) AS HUGEINT) + 5 * v) AS p
      FROM grid JOIN v USING (lang)),
l AS (SELECT lang, term, sum(n) AS n FROM grid GROUP BY ALL),
q AS (SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (CAST(sum(n) OVER (PARTITION BY lang) AS HUGEINT) + 5 * v) AS q
      FROM l JOIN v USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS k
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, CAST(k AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR k <= 50
"""

OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^
]*
|[^
]+') AS u,
                  sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
e AS (SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2,
             CAST('0x' || h[17:24] AS UBIGINT) AS h3, CAST('0x' || h[25:32] AS UBIGINT) AS h4 FROM d),
f AS (SELECT doc_id, t, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS x, greatest(h1 % (n + 1), h2 % (n + 1)) AS y,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM e),
s AS (SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:x], ''), '') AS p, coalesce(array_to_string(u[x + 1:y], ''), '') AS m,
             coalesce(array_to_string(u[y + 1:n], ''), '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM s
"""

ORACLES = {"op1_decontamination": OP1_SQL, "op2_license_scan": _license_sql(), "op9_exact_dedup": OP9_SQL,
           "op11_source_divergence": OP11_SQL, "op12_fill_middle": OP12_SQL}
