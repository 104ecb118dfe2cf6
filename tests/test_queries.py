"""Every query with SQL gives what DuckDB gives on the same tables."""

from __future__ import annotations

import pytest

from arcline.plans import queries as q


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(q.queries()[name], q.oracle_sql()[name])


def test_every_query_has_sql():
    assert set(q.queries()) == set(q.oracle_sql())


def test_bounces_need_two_shuffles_at_most_by_clip(spark, sf_dir):
    from arcline.operators import tracks
    from arcline.plans import mapping

    track = mapping.track(spark, sf_dir).withColumn("clip_id", mapping.F.col("clip_id"))
    plan = tracks.turning_candidates(track)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2  # numbering frames, then clips by block
    assert "Python" not in plan
