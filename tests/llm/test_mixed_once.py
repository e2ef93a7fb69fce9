"""The mix's documents are those of its plan, and their texts aren't shuffled for it."""

from collections import Counter

from pyspark.sql import functions as F

from scriptorium.llm import mixing


def test_texts_stay_where_they_lie(spark):
    rows = [(k, " ".join(["w"] * (1 + k % 5)), "abc"[k % 3] if k % 7 else None) for k in range(300)]
    rows += [(k, t, s) for k, t, s in rows if k % 4 == 0] * 2  # repeated rows are documents of their own
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mixed_documents(d)
    got = Counter()
    for r in mixed.collect():
        got[r.doc_id, r.source] += r.repeats * len(r.text.split())
    want = Counter()
    sources = {k: s for k, _, s in rows}
    for r in mixing.plan_mix(d).collect():
        want[r.doc_id, sources[r.doc_id]] += r.taken
    assert got == +want
    unique = mixing.mixed_documents(d.where(F.col("doc_id") % 4 != 0))
    assert "Exchange hashpartitioning" not in unique._jdf.queryExecution().executedPlan().toString()
