"""Operators that no SQL stands beside, and odd rows of those that have it."""

import math

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import curation as C
from scriptorium.operators import evaluation as E
from scriptorium.operators import features as V
from scriptorium.operators import scoring, search, spans
from scriptorium.sources import files
from scriptorium.streaming import ingest


def column(spark, texts, c):
    d = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k long, text string")
    return [r[0] for r in d.orderBy("k").select(c).collect()]


def test_text_functions(spark):
    assert column(spark, ["éa\r\nb\rc\x00\td\x7f", "plain", None], T.normalized()) == ["éa\nb\nc\td", "plain", None]
    assert column(spark, ["  a b\x0b\n", "\n\n", ""], T.strip()) == ["a b", "", ""]
    assert column(spark, ["It isn't l'élève's, they're Ann's"], T.words()) == [["it", "is", "they", "ann"]]
    assert column(spark, ["a\n\nb", "a\r\n\r\nb", "a\nb"], T.has_paragraph_marker()) == [True, True, False]
    assert column(spark, ["ab\n\ncd"] * 8, T.containing_paragraph("text", F.col("k").cast("int"))) == [0, 0, 0, 0, 1, 1, 0, 0]
    assert column(spark, ["a\n\nb\n\nc"], T.paragraph_spliced("text", F.lit(1), F.lit("X\n\nY"))) == ["a\n\nX\n\nY\n\nc"]
    d = spark.createDataFrame([("One two. Three four five. Six.", [8, 25, 30]), ("x y z w", [7]), ("none", [])], "text string, ends array<int>")
    assert [r[0] for r in d.select(T.truncated_to_budget("text", "ends", F.lit(2))).collect()] == ["One two.", "x y z w", "none"]
    assert column(spark, ["", "A. B", None], T.sentence_proxy()) == [0, 2, None]


def test_features_of_short_null_and_repeated_rows(spark):
    rows = [(1, None), (2, ""), (3, "one"), (3, "one"), (4, "a a a. a a a."), (5, "Go on now. Go on then! Stay.")]
    rows = [(k, x, 1, 2, 3) for k, x in rows]  # names that the operator uses itself
    d = V.essay_features(spark.createDataFrame(rows, "doc_id long, text string, n long, words long, grams long"))
    assert d.first().n == 1 and d.first().words == 2
    got = {r.doc_id: r for r in d.collect()}
    assert d.count() == 6 and got[1].repeated_bigram_ratio == got[3].repeated_trigram_ratio == 0 and got[2].moving_average_ttr == 0 and got[3].moving_average_ttr == 1
    assert got[4].repeated_bigram_ratio == 1 and got[4].type_token_ratio == 1 / 6 and got[4].repeated_sentence_opening_ratio == 1
    assert got[5].repeated_sentence_opening_ratio == 2 / 3 and got[5].sentence_count == 3 and abs(got[5].sentence_length_std - math.sqrt(8 / 9)) < 1e-12
    words = [f"w{k % 37}" for k in range(140)]
    one = V.moving_average_ttr(spark.createDataFrame([(words,)], "words array<string>"), "words").first().moving_average_ttr
    assert abs(one - sum(len(set(words[k : k + 50])) / 50 for k in range(91)) / 91) < 1e-12


def test_vectors(spark):
    d = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id long, kind string, v double")
    assert V.reused(d.select("id"), d, "id").count() == 2
    with pytest.raises(ValueError):
        V.reused(spark.range(4), d, "id")
    more = spark.createDataFrame([(1, "a", 1.0), (3, "c", 3.0)], "id long, kind string, v double")
    assert {r.id for r in V.merged(d, more, F.col("kind") == "a").collect()} == {1, 2, 3}
    with pytest.raises(ValueError):
        V.merged(d, more.withColumn("v", F.lit(9.0)), F.col("kind") == "a")
    g = spark.createDataFrame([(1, 0, k, p, h) for k, (p, h) in enumerate([("NOUN", 0), ("VERB", 0), ("NOUN", 1), ("X", 2), ("X", 3), ("X", 4)])], "doc_id long, i int, at int, pos string, head int")
    r = V.grammar_features(g).first()
    assert r.dependency_depth == 5 and abs(r.noun_ratio - 1 / 3) < 1e-12


def test_quality_checks_have_the_exact_phrases(spark):
    texts = ["Surely this works", "Sure, here", "  OF COURSE it is", "a language model is a thing", "As an  AI language\nmodel", "", None, "\n\t"]
    rows = C.quality_checks(spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k long, text string"), "text", "a b c d e f", 1, 9).orderBy("k").collect()
    assert [r.instruction_artifact_preamble for r in rows] == [False, True, True] + [False] * 5
    assert [r.ai_self_reference for r in rows] == [False] * 4 + [True] + [False] * 3
    assert [r.notes for r in rows[5:]] == [["empty_output"]] * 3
    assert column(spark, ["x A  b C d e F y", "a b c d e"], C.leaks("text", "a b c d e f")) == [True, False]


def test_similarities_are_those_of_matching_blocks(spark):
    d = spark.createDataFrame([(["tide", "same", ""], ["diet", "same", ""]), (["a"], ["b", "c"])], "a array<string>, b array<string>")
    rows = C.aligned(d, "a", "b").withColumn("changed", C.modified("pairs", 0.5)).collect()
    assert [p.similarity for p in rows[0].pairs] == [0.25, 1.0, 1.0] and rows[0].changed == [0] and rows[1].structure_drift and rows[1].pairs == []


def test_paragraph_pairs(spark):
    rows = [("a\n\nb\n\nc", 1, "a\n\nB1\n\nB2\n\nc"), ("a\n\nb", 1, "a\n\nB"), ("a\n\nb", 0, "X\n\nb"), ("a\n\nb", 1, "z\n\nB"), ("a", 3, "a")]
    d = spark.createDataFrame(rows, "h string, i int, n string")
    got = [r[0] for r in d.select(C.paragraph_pair("h", F.col("i"), "n")).collect()]
    assert [tuple(x) if x else None for x in got] == [("b", "B1\n\nB2"), ("b", "B"), ("a", "X"), None, None]


def test_splits_and_samples(spark):
    d = spark.range(150).select(F.col("id").cast("string").alias("family"))
    n = {r.split: r["count"] for r in C.family_split(d, "family", 1).groupBy("split").count().collect()}
    assert n == {"train": 105, "validation": 22, "test": 23}
    assert C.seed_sample(d, "family", 5, 42).count() == 5
    with pytest.raises(ValueError):
        C.seed_sample(d, "family", 151, 42)
    with pytest.raises(ValueError):
        C.reviewed(d, d.select("family", F.lit("bad").alias("v")), "family", "v", ["good"])
    with pytest.raises(ValueError):
        C.reviewed(d, spark.createDataFrame([("x", "good")], "family string, v string"), "family", "v", ["good"])
    pairs = C.with_original(spark.createDataFrame([(1, "original"), (1, "derived"), (2, "derived")], "family long, kind string"), "family", "kind").collect()
    assert [(r.family, r.original.kind) for r in pairs] == [(1, "original")]


def test_evaluation(spark):
    rows = [(1, 0.9), (1, 0.29), (0, 0.29), (0, 0.1), (None, 0.5), (1, None), (1, 1.0), (0, 0.0)]
    d = spark.createDataFrame(rows, "y int, score double")
    swept = {r.percent: r for r in E.sweep(d).collect()}
    for p in range(1, 100):
        hit = [(y, s >= p / 100.0) for y, s in rows if y is not None and s is not None]
        assert (swept[p].tp, swept[p].fp) == (sum(y == 1 and h for y, h in hit), sum(y == 0 and h for y, h in hit)), p
    best = E.chosen_threshold(d).first()
    assert (best.threshold, best.f1) == (0.11, 0.8571)
    none = E.metrics_at(d.where("y = 0"), 2.0).first()
    assert none.precision_machine == none.recall_machine == none.f1_machine == 0 and none.accuracy == 1
    assert E.majority_binary(spark.createDataFrame([(0,), (1,)], "y int")).first().label == 0
    assert spark.range(1).select(E.wilson(F.lit(0), F.lit(0), 1)).first()[0] is None
    assert spark.createDataFrame([([0.2, 0.4, 0.4],)], "p array<double>").select(E.argmax("p")).first()[0] == 1
    with pytest.raises(ValueError):
        E.require_complete(d, ["score"])
    with pytest.raises(ValueError):
        E.reproduced(1.0, 0.47, 1.0, 0.46)
    assert E.coefficients({"a": 0.1, "b": -2.00004}) == [("b", -2.0), ("a", 0.1)]


def test_models_are_fitted(spark):
    rows = [(k, float(k % 7) + 5.0 * (k % 2), float(k % 3), k % 2) for k in range(120)]
    d = spark.createDataFrame(rows, "k long, a double, b double, y int")
    mean, scale = E.scaler(d.withColumn("z", F.lit(4.0)), ["a", "z"])
    assert scale[1] == 1.0 and mean[1] == 4.0 and abs(mean[0] - sum(r[1] for r in rows) / 120) < 1e-9
    dealt = E.folds(d, "k", "y")
    assert {(r.y, r["count"]) for r in dealt.groupBy("y", "fold").count().collect()} == {(0, 12), (1, 12)}
    model, c = E.logistic_cv(dealt, ["a", "b"], cs=3)
    assert 1e-4 <= c <= 1e4 and model.coefficients[0] > 0
    assert E.random_forest(d, ["a", "b"], trees=5).numFeatures == 2


def test_localization_and_labels(spark):
    m = scoring.LinearModel(("a",), (0.0,), (1.0,), (1.0,), 0.0, 0.5)
    d = spark.createDataFrame([(1, 0, 2.0), (1, 1, None), (1, 2, 3.0), (2, 0, None)], "doc_id long, i int, a double")
    got = {r.doc_id: r for r in scoring.localized(d, m, 1).collect()}
    assert got[1].total_scorable == 2 and [c.i for c in got[1].candidates] == [2] and got[1].candidates[0].evidence[0].direction == "higher"
    assert got[2].reason and got[2].total_scorable == 0 and got[2].skipped[0].missing_fields == ["a"]
    assert [r[0] for r in d.where("a is not null").select(m.label()).collect()] == ["machine", "machine"]


def test_highlights_show_the_whole_text(spark):
    d = spark.createDataFrame([("abcdefghij", [(6, 8), (1, 3), (2, 4)]), ("abc", []), ("", [])], "t string, s array<struct<b:int,e:int>>")
    rows = spans.highlights(d.withColumn("k", F.monotonically_increasing_id()), "t", "s").collect()
    first = sorted((r.start_char, r.segment, r.hit) for r in rows if r.segment in ("a", "bc", "cd", "ef", "gh", "ij"))
    assert first == [(0, "a", False), (1, "bc", True), (2, "cd", True), (4, "ef", False), (6, "gh", True), (8, "ij", False)]
    assert [(r.segment, r.hit) for r in rows if r.segment == "abc"] == [("abc", False)] and len(rows) == 7


def test_nearest(spark):
    rows = [(k, [float(k % 5), float(k % 3), 1.0]) for k in range(60)] + [(60, [0.0, 0.0, 0.0]), (61, None), (None, [1.0, 1.0, 1.0])]
    d = spark.createDataFrame(rows, "id long, v array<double>")
    got = search.nearest(d, "id", "v", F.col("id") % 20 == 0, 3).collect()
    want = {}
    cos = lambda a, b: 0.0 if not any(a) or not any(b) else round(sum(x * y for x, y in zip(a, b, strict=True)) / math.dist(a, [0] * 3) / math.dist(b, [0] * 3), 4)
    own = [(k, v) for k, v in rows if v is not None and k is not None]
    for q, v in own:
        if q % 20 == 0:
            want |= {(q, k): s for s, k in sorted(((cos(v, w), k) for k, w in own), key=lambda x: (-x[0], x[1]))[:3]}
    assert {(r.query_id, r.id): r.similarity for r in got} == want


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,score,t\n007,1.5,"x\ny"\n008,n/a,z\n')
    assert [tuple(r) for r in files.read_csv(spark, f"file://{tmp_path}/a.csv", "id string, score string, t string").collect()] == [("007", "1.5", "x\ny"), ("008", "n/a", "z")]
    assert [tuple(r) for r in files.read_scores_csv(spark, f"file://{tmp_path}/a.csv", "id", ["score"]).collect()] == [("007", 1.5, "x\ny"), ("008", None, "z")]
    (tmp_path / "d.json").write_text('{"rows": [{"id": 1},\n {"id": 2}]}')
    assert [r.id for r in files.read_json_array(spark, f"file://{tmp_path}/d.json", "id long", "rows").collect()] == [1, 2]
    assert files.read_json_document(spark, f"file://{tmp_path}/d.json", "rows array<struct<id:long>>").count() == 1
    d = spark.createDataFrame([("a/b", 1), ("a b", 2), ("a/b", 3)], "k string, v long")
    files.write_by_key(d, f"file://{tmp_path}/by", "k")
    folders = [p for p in (tmp_path / "by").iterdir() if p.is_dir()]
    assert len(folders) == 2 and all(len(list(p.glob("*.json"))) == 1 for p in folders)
    files.write_json_document(d, f"file://{tmp_path}/doc")
    assert files.read_jsonl(spark, f"file://{tmp_path}/doc", "k string, v long").count() == 3
    sums = {r.path.rsplit("/", 1)[-1]: r.md5 for r in files.checksums(spark, f"file://{tmp_path}/a.csv").collect()}
    files.verified(spark, f"file://{tmp_path}/a.csv", sums)
    with pytest.raises(ValueError):
        files.verified(spark, f"file://{tmp_path}/a.csv", {"b.csv": "0"})


def test_streams(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id long, v string")
    d.write.json(f"file://{tmp_path}/in")
    schema, out, check = "id long, v string", f"file://{tmp_path}/out", f"file://{tmp_path}/check"
    for rows in (2, 3):
        ingest.append_stream(ingest.stream_jsonl(spark, f"file://{tmp_path}/in", schema), out, "id", check).awaitTermination()
        assert files.read_jsonl(spark, out, schema).count() == rows
        spark.createDataFrame([(2, "x"), (3, "y")], schema).write.mode("append").json(f"file://{tmp_path}/in")
    e = spark.createDataFrame([("2024-01-01 00:00:10", "a"), ("2024-01-01 00:00:50", "a"), ("2024-01-01 00:01:10", "b")], "t string, by string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r.n for r in ingest.counts_by_time(e, "t", "by", "1 minute", "10 minutes").collect()) == [1, 2]
