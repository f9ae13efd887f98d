"""Joins of wide track records, and the tasks that make them."""

from __future__ import annotations

from segue.operators import transition_plan as P
from segue.plans import tables, transition_queries
from segue.plans.tables import track_catalog


def test_track_records_are_not_broadcast(spark, sf):
    pairs = transition_queries.playlist_pairs(spark, sf)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan


def test_only_fields_in_use_are_shuffled(spark, sf):
    plan = transition_queries.harmonic_compatibility(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    joins = plan.index("Join ")
    assert "tonic" in plan[joins:] and "isnotnull(o#" not in plan


def test_catalog_is_made_in_many_tasks(spark, sf):
    assert track_catalog(spark, sf).rdd.getNumPartitions() > 1


def test_tasks_of_the_catalog_grow_with_its_records(spark, sf, monkeypatch):
    monkeypatch.setattr(tables, "RECORDS", 10)
    sizes = track_catalog(spark, sf).select("track").rdd.glom().map(len).collect()
    assert len(sizes) == -(-sum(sizes) // 10) and max(sizes) < 40 and sum(sizes) == tables.table(spark, sf, "part").count()


def test_summaries_compute_only_what_they_show(spark, sf):
    plan = transition_queries.vocal_summary(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "marker_conf" not in plan


def test_chosen_starts_are_not_broadcast(spark, sf):
    variants = transition_queries._variants(spark, sf)
    starts = variants.selectExpr("outgoing", "incoming", "variant", "0 AS position", "default_start AS p_os", "CAST(0 AS DOUBLE) AS score")
    finished = P.finish_variants(variants, P.select_start(starts, transition_queries.VARIANT), transition_queries.VARIANT)
    plan = finished._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert "strategy=merge" in finished._jdf.queryExecution().optimizedPlan().toString()  # whatever the estimate
