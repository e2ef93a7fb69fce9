"""Texts lie still while views are scored: only scores move."""

from scriptorium.llm import cotraining


def test_no_text_moves_to_leave_out_labelled_documents(spark, monkeypatch):
    rows = [(k, f"word{k % 7} other{k % 5} " * (k % 9 + 1), "en", "web", k) for k in range(60)]
    d = spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in zip(cotraining.INPUT, ("long", "string", "string", "string", "long"))))
    y = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    plans, own = {}, cotraining.table
    monkeypatch.setattr(cotraining, "table", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()) and own(df, name))
    cotraining.train(d, y)
    assert 0 <= plans["scored"].find("LeftAnti") < plans["scored"].find("MapInArrow")
