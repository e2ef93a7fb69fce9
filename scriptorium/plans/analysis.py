"""The whole analysis of each document as one query, and its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis as A
from ..operators import segmentation as S
from ..operators.scoring import LinearModel
from .language import _BOUNDED, _LEARNT
from .queries import _STRIP, _WORDS, query

#: Models to exercise the analysis with; their values are arbitrary.
ESSAY = LinearModel(("stylo_sentence_count", "stylo_sentence_length_mean", "stylo_type_token_ratio", "stylo_mean_word_count", "stylo_mean_punctuation_count"), (12.0, 9.0, 0.6, 9.0, 1.5), (8.0, 4.0, 0.2, 4.0, 0.8), (0.5, -0.3, 0.9, 0.25, 0.4), -0.1, 0.47)
SENTENCE = LinearModel(("stylo_type_token_ratio", "stylo_mean_word_count", "stylo_mean_char_count", "stylo_mean_punctuation_count", "stylo_mean_avg_word_length"), (0.6, 9.0, 45.0, 1.5, 5.0), (0.2, 4.0, 20.0, 0.8, 1.2), (0.2, 0.5, -0.4, 0.3, 0.6), 0.05, 0.06)
REFERENCE = {f: (m, s) for model in (ESSAY, SENTENCE) for f, m, s in zip(model.fields, model.mean, model.scale, strict=True)}


def _sql_parts(model: LinearModel) -> list[str]:
    return [f"(CAST({w} AS DOUBLE) * ((CAST({f} AS DOUBLE) - CAST({m} AS DOUBLE)) / CAST({s} AS DOUBLE)))" for f, m, s, w in zip(model.fields, model.mean, model.scale, model.weight, strict=True)]


def _sql_score(model: LinearModel) -> str:
    return f"1 / (1 + exp(-(CAST({model.intercept} AS DOUBLE) + {' + '.join(_sql_parts(model))})))"


def _sql_best(model: LinearModel) -> str:
    """Fields by contribution, as a list of structs."""
    items = ", ".join(f"{{'o': -abs({p}), 'k': {k}, 'f': '{f}', 'd': CASE WHEN {f} > {m} THEN 'higher' ELSE 'lower' END, 'c': {p}}}" for k, (f, m, p) in enumerate(zip(model.fields, model.mean, _sql_parts(model), strict=True)))
    return f"list_sort([{items}])"


_NORMAL = "regexp_replace(replace(replace(nfc_normalize(text), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\\x00-\\x08\\x0B-\\x1F\\x7F]', '', 'g')"
_FOUND = _BOUNDED.replace(_LEARNT, "base AS (SELECT doc_id, status, CASE WHEN status = 200 THEN " + _NORMAL + " END AS text FROM (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN length(coalesce(text, '')) > 20000 THEN 413 WHEN " + _STRIP.replace("text", "coalesce(text, '')") + " = '' THEN 422 ELSE 200 END AS status FROM documents)),\nshort AS (SELECT '' AS type WHERE false), starters AS (SELECT '' AS type WHERE false)").replace("FROM documents)", "FROM base)", 2).replace("FROM base)),\nshort", "FROM documents)),\nshort")


@query(f"""WITH {_FOUND},
sw AS (SELECT doc_id, i, own, {_WORDS.replace('text', 'own')} AS w FROM sentences),
sf AS (SELECT doc_id, i, len(w) AS word_count, length(array_to_string(w, '')) AS char_count, len(regexp_extract_all(own, '\\p{{P}}')) AS punctuation_count, CASE WHEN len(w) = 0 THEN 0.0 ELSE length(array_to_string(w, '')) / len(w) END AS avg_word_length FROM sw),
means AS (SELECT doc_id, count(*) AS stylo_sentence_count, sum(word_count) / count(*) AS stylo_sentence_length_mean, avg(word_count) AS stylo_mean_word_count, avg(punctuation_count) AS stylo_mean_punctuation_count FROM sf GROUP BY doc_id),
ttr AS (SELECT doc_id, status, CASE WHEN len({_WORDS}) = 0 THEN 0.0 ELSE len(list_distinct({_WORDS})) / len({_WORDS}) END AS stylo_type_token_ratio FROM base),
essays AS (SELECT doc_id, status, stylo_sentence_count IS NOT NULL AS found, *, {_sql_score(ESSAY)} AS score, {_sql_best(ESSAY)} AS best FROM ttr LEFT JOIN means USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS r FROM (SELECT doc_id, i, round({_sql_score(SENTENCE)}, 4) AS score, {_sql_best(SENTENCE)} AS best
  FROM (SELECT sf.doc_id, i, stylo_type_token_ratio, word_count AS stylo_mean_word_count, char_count AS stylo_mean_char_count, punctuation_count AS stylo_mean_punctuation_count, avg_word_length AS stylo_mean_avg_word_length FROM sf JOIN ttr ON sf.doc_id = ttr.doc_id))),
tops AS (SELECT doc_id, list(i ORDER BY r) FILTER (WHERE r <= 3) AS places, round(max(score), 4) AS top_score, max(best[1].f) FILTER (WHERE r = 1) AS top_feature, count(*) AS n FROM ranked GROUP BY doc_id)
SELECT e.doc_id, status, CASE WHEN status <> 200 THEN NULL WHEN NOT found THEN 'inconclusive' WHEN score >= 0.47 THEN 'machine_signal_detected' ELSE 'no_strong_signal_detected' END AS state, round(score, 4) AS score,
  CASE WHEN score IS NOT NULL THEN best[1].f || ' ' || best[1].d || ', ' || best[2].f || ' ' || best[2].d || ', ' || best[3].f || ' ' || best[3].d END AS evidence, CASE WHEN score IS NOT NULL THEN round(best[1].c, 6) END AS contribution,
  array_to_string(list_transform(places, lambda x: CAST(x AS VARCHAR)), ' ') AS candidates, top_score, top_feature, CASE WHEN status = 200 THEN coalesce(n, 0) END AS total FROM essays e LEFT JOIN tops ON e.doc_id = tops.doc_id""")
def analysis(t):
    """The parts of each document's analysis that SQL can hold beside it; sentences part by the known abbreviations alone."""
    d = A.analyzed(t("documents").select("doc_id", "text"), ESSAY, SENTENCE, S.Boundaries(S.KNOWN, ()), REFERENCE)
    e, c = F.col("essay.evidence"), F.col("sentences.candidates")
    told = F.array_join(F.transform(e, lambda x: F.concat(x["feature"], F.lit(" "), x["direction"])), ", ")
    some = F.size(c) > 0
    return d.select(
        "doc_id", "status", F.col("essay.state").alias("state"), F.col("essay.score").alias("score"), F.when(F.size(e) > 0, told).alias("evidence"), F.get(e, F.lit(0))["contribution"].alias("contribution"),
        F.when(some, F.array_join(F.transform(c, lambda x: x["sentence_index"].cast("string")), " ")).alias("candidates"), F.get(c, F.lit(0))["score"].alias("top_score"), F.get(F.get(c, F.lit(0))["evidence"], F.lit(0))["feature"].alias("top_feature"), F.col("sentences.total_scorable_sentences").cast("long").alias("total"),
    )
