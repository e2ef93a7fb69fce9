"""Sentence, essay and language-model features, and the vectors made of them.

All of a text's features are computed in its row: nothing is shuffled, and rows that repeat an id stay rows of their own.
Functions that add single features to a table use columns of their own beside its; ``essay_features`` keeps any names apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

SHORT, LONG = 10, 20
WINDOW = 50
RARE_BELOW = 3.0
ESSAY_FIELDS = ("sentence_count", "sentence_length_mean", "sentence_length_std", "sentence_length_cv", "short_sentence_ratio", "medium_sentence_ratio", "long_sentence_ratio", "type_token_ratio", "moving_average_ttr", "rare_word_ratio", "repeated_bigram_ratio", "repeated_trigram_ratio", "repeated_sentence_opening_ratio")
SENTENCE_FIELDS = ("word_count", "char_count", "punctuation_count", "avg_word_length", "noun_ratio", "verb_ratio", "adj_ratio", "adv_ratio", "pronoun_ratio", "dependency_depth")
LM_FIELDS = ("mean_log_prob", "median_log_prob", "log_prob_variance", "perplexity", "token_count")
#: The 29 fields of an essay's vector, in order.
VECTOR_FIELDS = (*(f"stylo_{f}" for f in ESSAY_FIELDS), *(f"stylo_mean_{f}" for f in SENTENCE_FIELDS), *(f"lm_mean_{f}" for f in LM_FIELDS), "lm_mean_predictability_delta")


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda s, x: s + x)


def sentence_lengths(df: DataFrame, sentences: str = "sentences") -> DataFrame:
    """``df`` with the length features of an array of sentences; all are 0 where there is none."""
    d = T.once(df, lengths=F.transform(sentences, lambda s: F.size(T.words(s))))
    d = T.once(d, n=F.size("lengths"), total=_sum(F.col("lengths")), squares=_sum(F.transform("lengths", lambda x: x * x)))
    n, safe = F.col("n"), F.greatest(F.col("n"), F.lit(1))
    share = lambda keep: (F.size(F.filter("lengths", keep)) / safe)
    d = d.withColumn("sentence_count", n.cast("long")).withColumn("sentence_length_mean", F.col("total") / safe)
    d = d.withColumn("sentence_length_std", F.sqrt((n * F.col("squares") - F.col("total") * F.col("total")).cast("double")) / safe)
    d = d.withColumn("sentence_length_cv", F.when(F.col("total") == 0, 0.0).otherwise(F.col("sentence_length_std") / F.col("sentence_length_mean")))
    d = d.withColumn("short_sentence_ratio", share(lambda x: x <= SHORT)).withColumn("medium_sentence_ratio", share(lambda x: (x > SHORT) & (x <= LONG))).withColumn("long_sentence_ratio", share(lambda x: x > LONG))
    return d.drop("lengths", "n", "total", "squares")


def type_token_ratio(words: str) -> Column:
    return T.ratio(F.size(F.array_distinct(words)), F.size(words))


def repeated_grams(df: DataFrame, array: str, n: int, name: str) -> DataFrame:
    """``df`` with ``name``_total, ``name``_repeated and ``name``: all occurrences of n-grams that occur twice or more,
    over all n-grams; 0 for a text without one. N-grams are compared by 64-bit hashes."""
    d = T.once(df, grams=F.array_sort(T.gram_hashes(array, n)))
    d = T.once(d, **{f"{name}_total": F.size("grams").cast("long"), f"{name}_repeated": T.n_repeated("grams").cast("long")}).drop("grams")
    return d.withColumn(name, T.ratio(F.col(f"{name}_repeated"), F.col(f"{name}_total")))


def moving_average_ttr(df: DataFrame, words: str, name: str = "moving_average_ttr") -> DataFrame:
    """``df`` with the mean share of different words over all windows of ``WINDOW`` words, or over the text if it's no longer.

    A word opens the windows that begin after its last occurrence: equal words meet by sorting, not by window. Whole
    numbers are summed and divided once.
    """
    d = T.once(df, spots=F.array_sort(F.transform(words, lambda w, i: F.struct(F.xxhash64(w).alias("w"), i.alias("i")))), n=F.size(words))
    before = F.concat(F.array(F.lit(None).cast("struct<w:bigint,i:int>")), F.slice("spots", 1, F.greatest(F.col("n") - 1, F.lit(0))))
    last = F.col("n") - WINDOW

    def opened(spot: Column, prev: Column) -> Column:
        low = F.greatest(F.when(prev["w"] == spot["w"], prev["i"]).otherwise(F.lit(-1)), spot["i"] - WINDOW, F.lit(-1))
        return F.greatest(F.least(spot["i"], last) - low, F.lit(0))

    d = T.once(d, opened=F.when(F.col("n") > WINDOW, _sum(F.zip_with("spots", before, opened))), distinct=F.size(F.array_distinct(words)))
    moving = F.col("opened").cast("double") / (F.lit(WINDOW).cast("long") * (F.col("n") - (WINDOW - 1)))
    out = d.withColumn(name, F.when(F.col("n") > WINDOW, moving).when(F.col("n") > 0, F.col("distinct") / F.col("n")).otherwise(0.0))
    return out.drop("spots", "n", "opened", "distinct")


def repeated_openings(df: DataFrame, sentences: str, name: str = "repeated_sentence_opening_ratio") -> DataFrame:
    """``df`` with the share of sentences whose first two pieces, in lower case, open another one too; 0 below two sentences."""
    d = T.once(df, openings=F.array_sort(F.transform(sentences, lambda s: F.array_join(F.slice(T.tokens(F.lower(s)), 1, 2), " "))))
    return d.withColumn(name, F.when(F.size("openings") < 2, 0.0).otherwise(T.n_repeated("openings") / F.size("openings"))).drop("openings")


def rare_word_ratio(docs: DataFrame, lexicon: DataFrame, key: str, words: str = "words") -> DataFrame:
    """``(key, rare_word_ratio)``: the share of words whose frequency in ``lexicon(word, zipf)`` is below ``RARE_BELOW``; a
    word that isn't listed has 0. A text's words are counted before they meet the lexicon; a text without words has 0."""
    counts = docs.select(key, F.explode_outer(words).alias("word")).groupBy(key, "word").agg(F.count("word").alias("n"))
    zipf = lexicon.groupBy("word").agg(F.max("zipf").alias("zipf"))
    rare = F.sum(F.when(F.coalesce("zipf", F.lit(0.0)) < RARE_BELOW, F.col("n")).otherwise(0))
    return counts.join(zipf, "word", "left").groupBy(key).agg(T.ratio(rare, F.sum("n")).alias("rare_word_ratio"))


def essay_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``ESSAY_FIELDS`` but the rare words, which need a lexicon. Null and empty texts have 0 everywhere."""
    body = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(F.struct(*docs.columns).alias("row"), body.alias("body"))
    d = T.once(d, sentences=T.sentences("body"), words=T.words("body"))
    d = sentence_lengths(d).withColumn("type_token_ratio", type_token_ratio("words"))
    d = moving_average_ttr(d, "words")
    for n, name in ((2, "repeated_bigram_ratio"), (3, "repeated_trigram_ratio")):
        d = repeated_grams(d, "words", n, name)
    d = repeated_openings(d, "sentences")
    return T.expanded(d, "row", *(f for f in ESSAY_FIELDS if f != "rare_word_ratio"))


def sentence_features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per sentence, ``(key, i, sentence, word_count, char_count, punctuation_count, avg_word_length)``."""
    s = docs.select(key, F.posexplode(T.sentences(text)).alias("i", "sentence"))
    s = T.once(s, words=T.words("sentence"))
    n, chars = F.size("words"), F.char_length(F.array_join("words", ""))
    return s.select(key, "i", "sentence", n.alias("word_count"), chars.alias("char_count"), F.regexp_count("sentence", F.lit("\\p{P}")).alias("punctuation_count"), F.when(n == 0, 0.0).otherwise(chars / n).alias("avg_word_length"))


def grammar_features(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per sentence of ``tokens(key, i, at, pos, head)`` the part-of-speech ratios and the depth of the dependency tree.

    Ratios are over all tokens. ``head`` is the place of a token's head, a root's its own; a depth is the longest chain of
    heads. Chains are followed by doubling, so that their length costs its logarithm in joins within a sentence's array.
    """
    share = lambda pos: (F.count_if(F.col("pos") == pos) / F.count("*"))
    names = {"noun_ratio": "NOUN", "verb_ratio": "VERB", "adj_ratio": "ADJ", "adv_ratio": "ADV", "pronoun_ratio": "PRON"}
    # place and head travel as one long, a third of what they take as a struct in a list; none is -1
    packed = F.shiftleft(F.coalesce("at", F.lit(-1)).cast("long"), 32).bitwiseOR(F.coalesce("head", F.lit(-1)).cast("long").bitwiseAND(F.lit((1 << 32) - 1)))
    heads = F.transform(F.array_sort(F.collect_list(packed)), lambda x: F.shiftright(F.shiftleft(x, 32), 32).cast("int"))
    g = tokens.groupBy(key, "i").agg(*(share(p).alias(f) for f, p in names.items()), heads.alias("heads"))
    # depths by relaxation: after k rounds all depths up to k are right; as many rounds as the deepest needs
    g = T.once(g, h=F.col("heads"), n=F.size("heads"))
    depth = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1))),
        F.struct(F.transform("h", lambda h, k: F.when(h == k, 0).otherwise(1)).alias("d"), F.col("h").alias("to"), F.lit(True).alias("go")),
        lambda s, _: F.when(~s["go"], s).otherwise(F.struct(
            F.transform(s["d"], lambda d, k: d + F.get(s["d"], F.get(s["to"], k))).alias("d"),
            F.transform(s["to"], lambda t: F.get(s["to"], t)).alias("to"),
            F.exists(F.zip_with(s["to"], F.col("h"), lambda t, h: t != F.get(F.col("h"), t)), lambda x: x).alias("go"),
        )),
        lambda s: F.array_max(s["d"]),
    )
    return g.select(key, "i", *names, F.coalesce(depth, F.lit(0)).alias("dependency_depth"))


def deltas(rows: DataFrame, key: str = "doc_id", value: str = "mean_log_prob") -> DataFrame:
    """``rows(key, i, ...)`` with ``predictability_delta``: the value less the previous sentence's; null for the first or
    where either is null. Sentences without a value must be in ``rows``."""
    return rows.withColumn("predictability_delta", F.col(value) - F.lag(value).over(W.partitionBy(key).orderBy("i")))


def essay_vector(essays: DataFrame, sentences: DataFrame, key: str = "doc_id") -> DataFrame:
    """The essay vectors: ``stylo_`` fields as they are, ``stylo_mean_`` and ``lm_mean_`` ones as means over sentences that
    have them, and how many sentences there are and have language-model values. Fields that the inputs lack are left out;
    an essay without sentences has null in all."""
    own = [f for f in ESSAY_FIELDS if f in essays.columns]
    means = [(f, f"stylo_mean_{f}") for f in SENTENCE_FIELDS if f in sentences.columns] + [(f, f"lm_mean_{f}") for f in (*LM_FIELDS, "predictability_delta") if f in sentences.columns]
    scored = F.count("mean_log_prob") if "mean_log_prob" in sentences.columns else F.lit(0).cast("long")
    m = sentences.groupBy(key).agg(*(F.avg(f).alias(to) for f, to in means), F.count("*").alias("n_sentences_total"), scored.alias("n_sentences_scored_by_lm"))
    some = F.col("n_sentences_total").isNotNull()
    both = essays.select(key, *own).join(m, key, "left")
    return both.select(key, *(F.when(some, F.col(f)).alias(f"stylo_{f}") for f in own), *(to for _, to in means), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_sentences_total", "n_sentences_scored_by_lm")))


def sentence_vectors(essays: DataFrame, sentences: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each sentence's own values beside its essay's, which every sentence repeats."""
    own = [f for f in ESSAY_FIELDS if f in essays.columns]
    fields = [f for f in (*SENTENCE_FIELDS, *LM_FIELDS, "predictability_delta") if f in sentences.columns]
    prefix = {**{f: f"stylo_mean_{f}" for f in SENTENCE_FIELDS}, **{f: f"lm_mean_{f}" for f in (*LM_FIELDS, "predictability_delta")}}
    e = essays.select(key, *(F.col(f).alias(f"stylo_{f}") for f in own))
    return sentences.join(e, key).select(key, "i", *(f"stylo_{f}" for f in own), *(F.col(f).alias(prefix[f]) for f in fields))


def training_rows(vectors: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sentence vectors with their label ``(key, i, label)``; rows that lack a language-model value are left out."""
    lm = [c for c in vectors.columns if c.startswith("lm_mean_")]
    return vectors.join(labels.select(key, "i", "label"), [key, "i"]).dropna(subset=lm)


def reused(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``rows`` with the vectors of ``known`` of the same key; raises if any has none."""
    lost = rows.join(known, key, "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"no vector is known for {key} = {lost[0][key]}")
    return rows.select(key).join(known, key)


def merged(a: DataFrame, b: DataFrame, shared: Column) -> DataFrame:
    """Both tables' rows, those that ``shared`` names once; raises unless these are the same in both."""
    b = b.select(*a.columns)
    x, y = a.where(shared), b.where(shared)
    if not x.exceptAll(y).isEmpty() or not y.exceptAll(x).isEmpty():
        raise ValueError("the shared rows differ")
    return a.unionByName(b.where(~shared | shared.isNull()))
