"""One analysis a text: from the text to its state, its evidence, and the sentences that stand out, within its row.

The sentences are found once; the essay's and the sentences' features, scores and evidence are expressions over that array. So
texts are neither shuffled nor joined, and all that a row needs besides its text is told as constants.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import features as V
from . import segmentation as S
from .scoring import LinearModel

#: What the fields are called to readers.
FIELD_LABELS = {
    "stylo_sentence_count": "number of sentences",
    "stylo_sentence_length_mean": "average sentence length",
    "stylo_sentence_length_std": "variation in sentence length",
    "stylo_sentence_length_cv": "relative variation in sentence length",
    "stylo_short_sentence_ratio": "proportion of short sentences",
    "stylo_medium_sentence_ratio": "proportion of medium-length sentences",
    "stylo_long_sentence_ratio": "proportion of long sentences",
    "stylo_type_token_ratio": "vocabulary diversity",
    "stylo_moving_average_ttr": "vocabulary diversity (windowed measure)",
    "stylo_rare_word_ratio": "use of uncommon words",
    "stylo_repeated_bigram_ratio": "repeated two-word phrases",
    "stylo_repeated_trigram_ratio": "repeated three-word phrases",
    "stylo_repeated_sentence_opening_ratio": "repeated sentence openings",
    "stylo_mean_word_count": "average words per sentence",
    "stylo_mean_char_count": "average characters per sentence",
    "stylo_mean_punctuation_count": "punctuation density",
    "stylo_mean_avg_word_length": "average word length",
    "stylo_mean_noun_ratio": "proportion of nouns",
    "stylo_mean_verb_ratio": "proportion of verbs",
    "stylo_mean_adj_ratio": "proportion of adjectives",
    "stylo_mean_adv_ratio": "proportion of adverbs",
    "stylo_mean_pronoun_ratio": "proportion of pronouns",
    "stylo_mean_dependency_depth": "sentence structural complexity",
    "lm_mean_mean_log_prob": "average predictability under the language-model instrument",
    "lm_mean_median_log_prob": "median predictability under the language-model instrument",
    "lm_mean_log_prob_variance": "variability of predictability under the language-model instrument",
    "lm_mean_perplexity": "perplexity under the language-model instrument",
    "lm_mean_token_count": "average token count (a length measure, not a predictability measure)",
    "lm_mean_predictability_delta": "change in predictability between neighboring sentences",
}
#: The label of a sentence that stands out, and why there may be none.
CANDIDATE = "potentially_ai_assisted"
NOTHING_SCORED = "no scorable sentences (no sentences with sufficient language-model-scorable content)"
#: Characters that a text may have, and what is answered for one that is right, too long, or blank.
LONGEST, RIGHT, TOO_LONG, BLANK = 20_000, 200, 413, 422
_OWN = ("word_count", "char_count", "punctuation_count", "avg_word_length")

Getter = Callable[[str], Column]


def _parts(model: LinearModel, value: Getter) -> list[Column]:
    return [F.lit(w) * ((value(f).cast("double") - F.lit(m)) / F.lit(s)) for f, m, s, w in zip(model.fields, model.mean, model.scale, model.weight, strict=True)]


def _score(model: LinearModel, value: Getter) -> Column:
    logit = F.lit(model.intercept)
    for p in _parts(model, value):
        logit = logit + p
    return 1 / (1 + F.exp(-logit))


def _evidence(model: LinearModel, value: Getter, reference: dict[str, tuple[float, float]], n: int) -> Column:
    """The ``n`` fields of largest absolute contribution, the model's order among equals, each told in a sentence."""
    items = []
    for k, (f, part) in enumerate(zip(model.fields, _parts(model, value), strict=True)):
        mean, std = reference[f]
        v = value(f).cast("double")
        direction = F.when(v > mean, "higher").otherwise("lower")
        statement = F.format_string(f"This shows a %s level of {FIELD_LABELS[f].replace('%', '%%')} than the reference range used by the detector (observed %.3f vs. a human-reference average of {mean:.3f}).", direction, v)
        items.append(F.struct((-F.abs(part)).alias("order"), F.lit(k).alias("at"), F.lit(f).alias("feature"), F.lit(FIELD_LABELS[f]).alias("human_label"), F.round(v, 4).alias("observed_value"), F.lit(round(mean, 4)).alias("reference_mean"), F.lit(round(std, 4)).alias("reference_std"), direction.alias("direction"), F.round(part, 6).alias("contribution"), statement.alias("statement")))
    best = F.slice(F.array_sort(F.filter(F.array(*items), lambda x: x["contribution"].isNotNull())), 1, n)
    return F.transform(best, lambda x: x.dropFields("order", "at"))


def analyzed(docs: DataFrame, essay: LinearModel, sentence: LinearModel, boundaries: S.Boundaries, reference: dict[str, tuple[float, float]], key: str = "doc_id", top_k: int = 3, top_n: int = 3, versions: tuple[str, str] = ("", "")) -> DataFrame:
    """``(key, status, analysis_id, normalized_text, essay, sentences, metadata)``, a row a row of ``docs``.

    ``essay`` has the state, the rounded score and the evidence; an essay that lacks a field of the model is inconclusive and has
    neither. ``sentences`` has the ``top_k`` candidates by score, then index, with their evidence; the sentences that lack a
    field, with what they miss; how many could be scored; and why there is no candidate. Fields of the vector that aren't
    made of the text alone (grammar, rare words, log-probabilities) are taken from columns of ``docs`` of that name, and null
    where there is none. ``reference`` has a mean and a deviation of each field. A blank or null text, or one of more than
    ``LONGEST`` characters, has its status and null elsewhere.
    """
    given = [f for f in V.VECTOR_FIELDS if f in docs.columns]
    raw = F.coalesce(F.col("text"), F.lit(""))
    status = F.when(F.char_length(raw) > LONGEST, TOO_LONG).when(T.strip(raw) == "", BLANK).otherwise(RIGHT)
    own = docs.select(F.struct(F.col(key).alias("key"), status.alias("status"), *given).alias("row"), F.when(status == RIGHT, T.normalized(raw)).alias("text"))
    d = S.sentence_spans(own, boundaries, "row")
    d = T.once(d, own=F.transform("sentences", lambda s: s["text"]), words=T.words(F.coalesce(F.col("text"), F.lit(""))))
    with_words = F.transform("own", lambda s: F.struct(s.alias("s"), T.words(s).alias("w")))
    chars = lambda x: F.char_length(F.array_join(x["w"], ""))
    each = F.transform(with_words, lambda x: F.struct(F.size(x["w"]).alias("word_count"), chars(x).alias("char_count"), F.regexp_count(x["s"], F.lit("\\p{P}")).alias("punctuation_count"), T.ratio(chars(x), F.size(x["w"])).alias("avg_word_length")))
    d = V.sentence_lengths(T.once(d, each=each), "own").withColumn("type_token_ratio", V.type_token_ratio("words"))
    d = V.moving_average_ttr(d, "words")
    for n, name in ((2, "repeated_bigram_ratio"), (3, "repeated_trigram_ratio")):
        d = V.repeated_grams(d, "words", n, name)
    d = V.repeated_openings(d, "own")
    some = F.size("own") > 0
    mean = lambda f: F.aggregate("each", F.lit(0.0), lambda s, x: s + x[f], lambda s: s / F.size("each"))
    vector = {f"stylo_{f}": F.when(some, F.col(f)) for f in V.ESSAY_FIELDS if f in d.columns} | {f"stylo_mean_{f}": F.when(some, mean(f)) for f in _OWN}
    vector |= {f: F.col("row").getField(f) for f in given}
    d = T.once(d, v=F.struct(*(vector.get(f, F.lit(None)).cast("double").alias(f) for f in V.VECTOR_FIELDS)))
    of_essay = lambda f: F.col("v").getField(f)
    d = T.once(d, score=_score(essay, of_essay))
    right, score = F.col("row.status") == RIGHT, F.col("score")
    state = F.when(score.isNull(), "inconclusive").when(score >= essay.threshold, "machine_signal_detected").otherwise("no_strong_signal_detected")
    evidence = _evidence(essay, of_essay, reference, top_n)
    result = F.struct(state.alias("state"), F.round("score", 4).alias("score"), F.when(score.isNotNull(), evidence).otherwise(F.slice(evidence, 1, 0)).alias("evidence"))

    def of_sentence(x: Column) -> Getter:
        return lambda f: x["x"][f.removeprefix("stylo_mean_")] if f.removeprefix("stylo_mean_") in _OWN and f not in given else of_essay(f)

    marked = F.transform("each", lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    missing = lambda x: F.array_compact(F.array(*(F.when(of_sentence(x)(f).isNull(), F.lit(f)) for f in sentence.fields)))
    scored = F.transform(marked, lambda x: F.struct((-F.round(_score(sentence, of_sentence(x)), 4)).alias("order"), x["i"].alias("i"), x["x"].alias("x"), missing(x).alias("missing")))
    d = T.once(d, scored=scored)
    d = T.once(d, complete=F.array_sort(F.filter("scored", lambda x: x["order"].isNotNull())))
    place = lambda i: F.get("sentences", i)
    candidates = F.transform(F.slice("complete", 1, top_k), lambda x, k: F.struct(x["i"].alias("sentence_index"), (k + 1).alias("rank"), place(x["i"])["text"].alias("text"), place(x["i"])["start_char"].alias("char_start"), place(x["i"])["end_char"].alias("char_end"), (-x["order"]).alias("score"), F.lit(CANDIDATE).alias("label"), _evidence(sentence, of_sentence(x), reference, top_n).alias("evidence")))
    skipped = F.transform(F.filter("scored", lambda x: x["order"].isNull()), lambda x: F.struct(x["i"].alias("sentence_index"), place(x["i"])["text"].alias("text"), place(x["i"])["start_char"].alias("char_start"), place(x["i"])["end_char"].alias("char_end"), F.array_sort(x["missing"]).alias("missing")))
    total = F.size("complete")
    found = F.struct(candidates.alias("candidates"), skipped.alias("skipped"), F.lit(top_k).alias("top_k"), total.alias("total_scorable_sentences"), (total > 0).alias("has_evidence"), F.when(total == 0, NOTHING_SCORED).alias("no_evidence_reason"))
    metadata = F.struct(F.lit(versions[0]).alias("essay_model_version"), F.lit(versions[1]).alias("sentence_model_version"))
    only = lambda c: F.when(right, c)
    return d.select(F.col("row.key").alias(key), F.col("row.status").alias("status"), only(F.expr("uuid()")).alias("analysis_id"), only(F.col("text")).alias("normalized_text"), only(result).alias("essay"), only(found).alias("sentences"), only(metadata).alias("metadata"))
