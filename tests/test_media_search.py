"""The search for media objects below the fixed paths: what it skips, and where the parsing runs."""

from __future__ import annotations

from segue.operators import pages
from segue.plans import page_queries


def test_texts_without_the_name_are_not_searched_and_escapes_are(spark):
    media = '{"video_info":{"variants":[]}}'
    rows = [(1, '{"a":{"b":' + media + '}}'), (2, '{"a":{"b":{"c":1}}}'), (3, '{"a":{"video\\u005finfo":{"variants":[]}}}'),
            (4, "not json"), (5, None), (6, '[{"x":"video_info"},[' + media + ']]')]
    found = pages.find_media_node(spark.createDataFrame(rows, "id int, payload string"))
    assert {r.id: r.media for r in found.collect()} == {1: media, 2: None, 3: media, 4: None, 5: None, 6: media}


def test_posts_are_parsed_in_many_tasks(spark, sf, monkeypatch):
    monkeypatch.setattr(page_queries.ops, "normalize_posts", lambda df: df)
    assert page_queries.normalize_posts(spark, sf).rdd.getNumPartitions() > 1
