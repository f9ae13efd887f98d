"""Attribute, tag and entity functions over HTML text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def attribute(text: Column, name: str) -> Column:
    """First quoted value of ``name``; null if its opening quote never closes."""
    pattern = rf"(?U)(?<![A-Za-z0-9_:-]){re.escape(name)}\s*=\s*(\"[^\"]*\"?|'[^']*'?)"
    quoted = F.regexp_extract(text, pattern, 1)
    closed = (F.length(quoted) >= 2) & (F.left(quoted, F.lit(1)) == F.right(quoted, F.lit(1)))
    return F.when(closed, F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def meta_content(text: Column, key: str, value: str) -> Column:
    """``content`` of the first meta tag whose ``key`` attribute equals ``value``."""
    tags = F.regexp_extract_all(text, F.lit("<meta[^>]*>"), F.lit(0))
    hit = F.filter(tags, lambda t: F.coalesce(attribute(t, key) == value, F.lit(False)))
    return attribute(F.get(hit, F.lit(0)), "content")


def _until_close(tail: Column) -> Column:
    at = F.instr(tail, "</script>")
    return F.when(at > 0, F.regexp_replace(F.substring(tail, F.lit(1), at - 1), r"(?U)^\s+|\s+$", ""))


def script_body(text: Column, open_tag: str) -> Column:
    """Trimmed body after the exact open tag; for ld+json any script of that type."""
    at = F.instr(text, open_tag)
    exact = _until_close(F.substring(text, at + len(open_tag), F.length(text)))
    if "application/ld+json" not in open_tag:
        return F.when(at > 0, exact)
    pieces = F.split(text, "(?=<script)")
    typed = F.transform(pieces, lambda p, i: F.when(
        F.lower(attribute(F.regexp_extract(p, r"^<script[^>]*>", 0), "type")) == "application/ld+json", i))
    first = F.array_min(typed)
    # the body may itself hold "<script", so take everything after the tag
    rest = F.array_join(F.slice(pieces, first + 1, F.size(pieces)), "")
    loose = _until_close(F.regexp_replace(rest, r"^<script[^>]*>", ""))
    return F.when(at > 0, exact).when(first.isNotNull(), loose)


def decode_entities(text: Column) -> Column:
    """Ordered replacement: the ampersand comes third, so ``&amp;lt;`` ends as ``<``."""
    # Entities in decoding order.
    for entity, char in (("&quot;", '"'), ("&#34;", '"'), ("&amp;", "&"), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def between(text: Column, start: str, end: str) -> Column:
    """Trimmed text between two markers; null if either is missing."""
    at = F.instr(text, start)
    tail = F.substring(text, at + len(start), F.length(text))
    stop = F.instr(tail, end)
    return F.when((at > 0) & (stop > 0),
                  F.regexp_replace(F.substring(tail, F.lit(1), stop - 1), r"(?U)^\s+|\s+$", ""))


def _kind(node: Column) -> Column:
    return F.schema_of_variant(node)


def text_at(doc: Column, path: str) -> Column:
    """String member of a variant; null for any other JSON type."""
    node = F.try_variant_get(doc, path, "variant")
    return F.when(_kind(node) == "STRING", F.try_variant_get(doc, path, "string"))


def whole_at(doc: Column, path: str) -> Column:
    """Non-negative whole number member of a variant."""
    node = F.try_variant_get(doc, path, "variant")
    value = F.try_variant_get(doc, path, "long")
    return F.when((_kind(node) == "BIGINT") & (value >= 0), value)


def number_at(doc: Column, path: str) -> Column:
    node = F.try_variant_get(doc, path, "variant")
    return F.when(_kind(node).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(doc, path, "double"))


def has(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "variant").isNotNull()
