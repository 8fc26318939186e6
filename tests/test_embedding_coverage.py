from __future__ import annotations

from gleanframe.queries.store import coverage_counts, embedding_actions, embedding_coverage_counts


def test_other_profiles_and_bad_vectors_are_not_reused(spark):
    folder = "/root/testdata/sf0.01"
    before, now = (dict(map(tuple, q(spark, folder).collect())) for q in (coverage_counts, embedding_coverage_counts))
    assert now["ready"] < before["ready"] and now["invalid_vector"] > 0 and now["invalid_input"] > 0
    assert sum(now.values()) == sum(before.values())
    assert dict(map(tuple, embedding_actions(spark, folder).collect())) == {
        "reuse": now["ready"], "skip": now["invalid_input"], "compute": now["invalid_vector"] + now["stale"] + now["missing"],
    }
