"""The composite analysis: states, evidence, candidates, and that no text moves."""

import math

import pytest

from scriptorium.operators import analysis as A
from scriptorium.operators import features as V
from scriptorium.operators import segmentation as S
from scriptorium.operators.scoring import LinearModel
from scriptorium.plans.analysis import ESSAY, REFERENCE, SENTENCE

KNOWN = S.Boundaries(S.KNOWN, ())


def test_every_field_has_a_label():
    assert tuple(A.FIELD_LABELS) == V.VECTOR_FIELDS


def test_states_evidence_and_candidates(spark):
    texts = ["Short one. Here Dr. Lee walked to the old mill and looked at it. It was so.\r\nNo stop", "   ", None, "x" * 20_001, "...", "Café society."]
    d = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, own string")
    out = A.analyzed(d, ESSAY, SENTENCE, KNOWN, REFERENCE, versions=("e1", "s1"))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    rows = {r.doc_id: r for r in out.collect()}
    assert [rows[k].status for k in range(6)] == [200, 422, 422, 413, 200, 200]
    assert rows[1].essay is None and rows[3].sentences is None and rows[1].analysis_id is None
    r = rows[0]
    assert r.normalized_text == texts[0].replace("\r\n", "\n") and r.metadata.essay_model_version == "e1" and len(r.analysis_id) == 36
    c = r.sentences.candidates
    assert r.sentences.total_scorable_sentences == 4 and len(c) == 3 and [x.rank for x in c] == [1, 2, 3] and [x.score for x in c] == sorted((x.score for x in c), reverse=True)
    assert all(r.normalized_text[x.char_start : x.char_end] == x.text and x.label == "potentially_ai_assisted" for x in c)
    assert [e.feature for e in r.essay.evidence] == sorted((e.feature for e in r.essay.evidence), key=lambda f: -abs(next(e.contribution for e in r.essay.evidence if e.feature == f)))
    for e in r.essay.evidence:
        mean, std = REFERENCE[e.feature]
        assert (e.reference_mean, e.reference_std, e.human_label) == (mean, std, A.FIELD_LABELS[e.feature])
        assert e.direction == ("higher" if e.observed_value > mean else "lower") and f"{e.direction} level of {e.human_label}" in e.statement and f"average of {mean:.3f})" in e.statement
    assert rows[4].sentences.total_scorable_sentences == 1 and rows[5].normalized_text == "Café society."


def test_missing_fields(spark):
    model = LinearModel(("stylo_type_token_ratio", "lm_mean_perplexity"), (0.5, 10.0), (0.1, 5.0), (1.0, 1.0), 0.0, 0.5)
    ref = {"stylo_type_token_ratio": (0.5, 0.1), "lm_mean_perplexity": (10.0, 5.0)}
    d = spark.createDataFrame([(1, "Ab bc. Cd de.", None), (2, "Ab bc. Cd de.", 20.0)], "id long, text string, lm_mean_perplexity double")
    rows = {r.id: r for r in A.analyzed(d, model, model, KNOWN, ref, key="id").collect()}
    assert rows[1].essay.state == "inconclusive" and rows[1].essay.score is None and rows[1].essay.evidence == []
    s = rows[1].sentences
    assert not s.has_evidence and s.no_evidence_reason == A.NOTHING_SCORED and [(x.sentence_index, x.missing) for x in s.skipped] == [(0, ["lm_mean_perplexity"]), (1, ["lm_mean_perplexity"])]
    assert rows[2].essay.score == pytest.approx(round(1 / (1 + math.exp(-(5.0 + 2.0))), 4)) and rows[2].essay.state == "machine_signal_detected"
    assert [x.sentence_index for x in rows[2].sentences.candidates] == [0, 1] and rows[2].sentences.skipped == []
