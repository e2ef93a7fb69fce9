"""Queries over sentence features, linear scores with their evidence, spans and multi-class evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ablation as A
from ..operators import evaluation as E
from ..operators import features as V
from ..operators import scoring, spans
from .queries import _SENTENCES, _WORDS, _rounded, query

#: A model to exercise scoring with; its values are arbitrary.
MODEL = scoring.LinearModel(("word_count", "char_count", "punctuation_count", "avg_word_length"), (12.0, 60.0, 2.0, 5.0), (6.0, 30.0, 1.5, 1.2), (0.5, -0.3, 0.4, 0.25), -0.1, 0.47)

_FEATURES = f"""(SELECT doc_id, i, len(w) AS word_count, length(array_to_string(w, '')) AS char_count,
  len(regexp_extract_all(text, '\\p{{P}}')) AS punctuation_count,
  CASE WHEN len(w) = 0 THEN 0.0 ELSE length(array_to_string(w, '')) / len(w) END AS avg_word_length
  FROM (SELECT *, {_WORDS} AS w FROM (SELECT doc_id, unnest({_SENTENCES}) AS text, generate_subscripts({_SENTENCES}, 1) - 1 AS i FROM documents)))"""
_PARTS = [f"(CAST({w} AS DOUBLE) * ((CAST({f} AS DOUBLE) - CAST({m} AS DOUBLE)) / CAST({s} AS DOUBLE)))" for f, m, s, w in zip(MODEL.fields, MODEL.mean, MODEL.scale, MODEL.weight, strict=True)]
_SCORE = f"1 / (1 + exp(-(CAST({MODEL.intercept} AS DOUBLE) + {' + '.join(_PARTS)})))"


def _features(t):
    return V.sentence_features(t("documents")).drop("sentence")


@query(f"SELECT doc_id, i, word_count, char_count, punctuation_count, round(avg_word_length, 6) AS avg_word_length FROM {_FEATURES}")
def sentence_features(t):
    return _features(t).withColumn("avg_word_length", F.round("avg_word_length", 6))


@query(f"""SELECT doc_id, i, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS rank
  FROM (SELECT doc_id, i, round({_SCORE}, 4) AS score FROM {_FEATURES})""")
def sentence_ranking(t):
    return scoring.ranked(_features(t), MODEL).select("doc_id", "i", "score", "rank")


_ITEMS = " UNION ALL ".join(f"SELECT doc_id, i, {k} AS place, '{f}' AS field, CAST({f} AS DOUBLE) AS value, CAST({m} AS DOUBLE) AS reference, {p} AS c FROM f" for k, (f, m, p) in enumerate(zip(MODEL.fields, MODEL.mean, _PARTS, strict=True)))


@query(f"""WITH f AS {_FEATURES}, e AS ({_ITEMS}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, i ORDER BY abs(c) DESC, place) AS rank FROM e)
SELECT doc_id, i, rank, field, round(value, 4) AS value, CASE WHEN value > reference THEN 'higher' ELSE 'lower' END AS direction, round(c, 6) AS contribution FROM r WHERE rank <= 3""")
def sentence_evidence(t):
    return scoring.evidence(_features(t), MODEL, ["doc_id", "i"])


_MEANS = ", ".join(f"avg({f}) AS {f}" for f in MODEL.fields)


@query(f"""SELECT doc_id, score IS NULL AS incomplete, CASE WHEN score IS NULL THEN 'inconclusive' WHEN score >= {MODEL.threshold} THEN 'machine_signal_detected' ELSE 'no_strong_signal_detected' END AS state, round(score, 4) AS score
FROM (SELECT doc_id, {_SCORE} AS score FROM (SELECT d.doc_id, {_MEANS} FROM documents d LEFT JOIN {_FEATURES} f ON d.doc_id = f.doc_id GROUP BY d.doc_id))""")
def essay_state(t):
    means = _features(t).groupBy("doc_id").agg(*(F.avg(f).alias(f) for f in MODEL.fields))
    d = t("documents").select("doc_id").distinct().join(means, "doc_id", "left")
    return d.select("doc_id", MODEL.score().isNull().alias("incomplete"), MODEL.state().alias("state"), F.round(MODEL.score(), 4).alias("score"))


@query("""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
o AS (SELECT doc_id, i, length(line) AS n, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p)
SELECT doc_id, i, CAST(b AS BIGINT) AS start_char, CAST(b + n AS BIGINT) AS end_char, coalesce(b < 300 AND 100 < b + n AND quality = 0, false) AS hit FROM o LEFT JOIN labels USING (doc_id)""")
def span_labels(t):
    marked = t("labels").where("quality = 0").select("doc_id", F.lit(100).alias("b"), F.lit(300).alias("e"))
    return spans.overlap_labels(spans.pieces(t("documents"), "\n"), marked)


@query("SELECT source, count(*) AS n, count_if(lang = 'en') AS en, count_if(lang <> 'en') AS others, count_if(text IS NULL) AS missing FROM documents GROUP BY source")
def class_balance(t):
    other = F.col("lang") != "en"
    return t("documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("en"), F.count_if(other).alias("others"), F.count_if(F.col("text").isNull()).alias("missing"))


_CLASS = "CASE WHEN n_chars < 500 THEN 0 WHEN n_chars < 3000 THEN 1 ELSE 2 END"


@query(f"""WITH x AS (SELECT quality + toxic AS y, {_CLASS} AS p FROM documents JOIN labels USING (doc_id)),
g AS (SELECT a.k AS y, b.k AS p FROM range(3) a(k), range(3) b(k))
SELECT CAST(g.y AS INTEGER) AS y, CAST(g.p AS INTEGER) AS p, count(x.y) AS n FROM g LEFT JOIN x ON g.y = x.y AND g.p = x.p GROUP BY g.y, g.p""")
def confusion_grid(t):
    """All nine cells, empty ones too."""
    return E.confusion_grid(_classed(t), 3)


def _classed(t):
    x = t("documents").select("doc_id", "n_chars").join(t("labels"), "doc_id")
    return x.select((F.col("quality") + F.col("toxic")).alias("y"), F.expr(_CLASS).alias("p"))


@query(f"""WITH x AS (SELECT quality + toxic AS y, {_CLASS} AS p FROM documents JOIN labels USING (doc_id)),
c AS (SELECT k AS class, (SELECT count(*) FROM x WHERE y = k) AS support, (SELECT count(*) FROM x WHERE p = k) AS said, (SELECT count(*) FROM x WHERE y = k AND p = k) AS t FROM range(3) r(k)),
m AS (SELECT *, CASE WHEN said = 0 THEN 0.0 ELSE t / said END AS precision, CASE WHEN support = 0 THEN 0.0 ELSE t / support END AS recall, CASE WHEN said + support = 0 THEN 0.0 ELSE 2 * t / (said + support) END AS f1 FROM c)
SELECT CAST(class AS INTEGER) AS class, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(sum(support) OVER () AS BIGINT) AS n, round(sum(t) OVER () / sum(support) OVER (), 6) AS accuracy,
  round(avg(CASE WHEN said + support > 0 THEN f1 END) OVER (), 6) AS macro_f1, round(sum(f1 * support) OVER () / sum(support) OVER (), 6) AS weighted_f1 FROM m""")
def multiclass_metrics(t):
    return _rounded(E.multiclass_metrics(_classed(t), 3))


@query(f"""WITH r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY {_SCORE} DESC, i) AS rank, punctuation_count > 3 AS positive FROM {_FEATURES})
SELECT count(*) AS n, count_if(hit) AS hits FROM (SELECT doc_id, bool_or(positive AND rank = 1) AS hit FROM r GROUP BY doc_id HAVING bool_or(positive))""")
def top_one_localization(t):
    """Of documents with a positive sentence, in how many the first of the best scored ones is positive."""
    s = _features(t).select("doc_id", F.struct((-MODEL.score()).alias("order"), "i", (F.col("punctuation_count") > 3).alias("positive")).alias("s"))
    best = s.groupBy("doc_id").agg(F.min("s").alias("best"), F.bool_or("s.positive").alias("some")).where("some")
    return best.agg(F.count("*").alias("n"), F.count_if("best.positive").alias("hits"))


# Ablation: which of a text's simple measures tell its quality label


_LENGTH, _WORDING = ["n_words", "n_lines"], ["distinct", "word_length", "marks"]
GROUPS = {"all": _LENGTH + _WORDING, "length": _LENGTH, "wording": _WORDING, "without_marks": [*_LENGTH, "distinct", "word_length"], "without_distinct": [*_LENGTH, "word_length", "marks"]}


def _labelled(t):
    """Labelled documents with five measures, a split and folds by the id's sum."""
    d = T.once(t("documents").join(t("labels").select("doc_id", "quality"), "doc_id").where("quality is not null and text is not null"), w=T.tokens())
    n, crc = F.size("w"), F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = F.when(crc % 10 < 7, "train").when(crc % 10 < 9, "validation").otherwise("test")
    return d.select("doc_id", F.col("source").alias("essay"), split.alias("split"), (F.floor(crc / 10) % 5).cast("int").alias("fold"), F.col("quality").alias("y"),
        F.log1p(n).alias("n_words"), F.log1p(F.regexp_count("text", F.lit("\n"))).alias("n_lines"), T.ratio(F.size(F.array_distinct("w")), n).alias("distinct"),
        T.ratio(F.char_length("text"), n + 1).alias("word_length"), T.ratio(F.regexp_count("text", F.lit("[^\\p{L}\\s]")), F.char_length("text")).alias("marks"))


@query()
def quality_ablation(t):
    rows = _labelled(t)
    fitted = A.fit_groups(rows.where("split = 'train'"), GROUPS)
    report = A.ablation_report(rows.where("split <> 'test'"), fitted)
    return report.select("group", "split", "n_features", "chosen_c", "n", "tp", "fp", "tn", "fn", *(F.round(c, 6).alias(c) for c in ("accuracy", "f1_machine", "f1_human")))


@query()
def quality_group_diagnostic(t):
    rows = _labelled(t)
    out = A.group_diagnostic(rows, A.fit_groups(rows.where("split = 'train'"), GROUPS), "essay", "doc_id")
    return out.select("group", "n_features", "chosen_c", "threshold", "n", "tp", "fp", "tn", "fn", F.round("f1_machine", 6).alias("f1_machine"), "validation_essays", "validation_top1", "test_essays", "test_top1")
