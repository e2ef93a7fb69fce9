from scriptorium.operators import features as V


def test_heads_travel_as_longs_and_none_stays_none(spark, capfd):
    rows = [(1, 0, 0, "NOUN", 0), (1, 0, 1, "VERB", 0), (1, 0, 2, "X", 1), (1, 1, 0, "ADJ", 0), (1, 1, 1, "ADJ", None), (2, 0, 0, "ADV", 0)]
    t = spark.createDataFrame(rows, "doc_id long, i int, at int, pos string, head int")
    out = V.grammar_features(t)
    got = {(r.doc_id, r.i): (round(r.noun_ratio, 3), r.adj_ratio, r.dependency_depth) for r in out.collect()}
    assert got[1, 0] == (0.333, 0.0, 2) and got[2, 0] == (0.0, 0.0, 0) and got[1, 1][1] == 1.0
    capfd.readouterr()
    out.explain()
    plan = [x for x in capfd.readouterr().out.splitlines() if "collect_list(" in x]
    assert plan and not any("struct" in x for x in plan)
