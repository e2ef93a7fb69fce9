"""Operators that no SQL stands beside: files, spans with token scores, splices."""

from pyspark.sql import functions as F

from scriptorium.operators import spans
from scriptorium.sources import files


def test_append_takes_up_again_and_replace_swaps(spark, tmp_path):
    path = f"file://{tmp_path}/rows"
    files.append_missing(spark.createDataFrame([(1, "a")], "id long, v string"), path, "id")
    files.append_missing(spark.createDataFrame([(1, "z"), (2, "b")], "id long, v string"), path, "id")
    rows = files.read_jsonl(spark, path, "id long, v string")
    assert sorted(map(tuple, rows.collect())) == [(1, "a"), (2, "b")]
    files.replace_jsonl(rows.withColumn("v", F.upper("v")), path)
    assert sorted(map(tuple, files.read_jsonl(spark, path, "id long, v string").collect())) == [(1, "A"), (2, "B")]


def test_spans(spark):
    d = spark.createDataFrame([(1, "ab\ncdé\n"), (2, None)], "doc_id long, text string")
    parts = spans.pieces(d, "\n")
    assert sorted(map(tuple, parts.collect())) == [(1, 0, 0, 2), (1, 1, 3, 6), (1, 2, 7, 7), (2, 0, 0, 0)]
    hits = spans.overlap_labels(parts, spark.createDataFrame([(1, 2, 4)], "doc_id long, b int, e int"))
    assert {(r.doc_id, r.i) for r in hits.where("hit").collect()} == {(1, 1)}
    tokens = spark.createDataFrame([(1, 0, 1, -1.0), (1, 1, 2, -3.0), (1, 2, 4, -9.0)], "doc_id long, t0 int, t1 int, log_prob double")
    got = {(r.doc_id, r.i): (r.mean_lp, r.var_lp, r.n) for r in spans.attributed(tokens, parts).collect()}
    assert got[1, 0] == (-2.0, 1.0, 2) and got[1, 1] == (None, None, None)
    assert d.select(spans.splice("text", F.lit(1), F.lit(4), F.lit("X"))).first()[0] == "aXdé\n"
