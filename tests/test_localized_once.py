"""Localization parses a text once and sends its sentences once."""

import __spark_entry__
from scriptorium.operators import scoring


def test_one_pass_and_one_exchange(spark):
    m = scoring.LinearModel(("a", "b"), (0.0, 0.0), (1.0, 1.0), (1.0, -2.0), 0.0, 0.5)
    rows = [(1, 0, 2.0, 1.0), (1, 1, None, 1.0), (1, 2, 3.0, 0.0), (2, 0, None, None), (None, 0, 1.0, 1.0)]
    got = {r.doc_id: r for r in scoring.localized(spark.createDataFrame(rows, "doc_id long, i int, a double, b double"), m, 1).collect()}
    assert [(c["rank"], c.i, [e.field for e in c.evidence]) for c in got[1].candidates] == [(1, 2, ["a", "b"])] and got[1].total_scorable == 2
    assert [s.i for s in got[1].skipped] == [1] and got[1].reason is None
    assert got[2].candidates is None and got[2].skipped[0].missing_fields == ["a", "b"] and got[2].reason
    assert got[None].total_scorable == 0 and got[None].candidates is None and got[None].skipped is None
    plan = __spark_entry__.queries()["localization"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan
