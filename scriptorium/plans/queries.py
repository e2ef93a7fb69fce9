"""Named queries over the test tables and, beside each, its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import curation as C
from ..operators import evaluation as E
from ..operators import features as V
from ..operators.search import nearest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: White space at a text's ends, as an SQL string.
_WHITE = "chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160)"
_STRIP = f"trim(text, {_WHITE})"
_PARTED = "regexp_replace(regexp_replace(lower(text), 'n[''\u2019]t\\b', ' ', 'g'), '[''\u2019](s|m|re|ve|ll|d)\\b', ' ', 'g')"
_WORDS = f"list_filter(regexp_extract_all({_PARTED}, '\\p{{L}}+(?:[''\u2019]\\p{{L}}+)*'), lambda q: NOT regexp_matches(q, '[''\u2019]'))"
_TOKENS = "list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')"
_SENTENCES = f"list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[^.!?\\n]+[.!?]*'), lambda s: trim(s, {_WHITE})), lambda s: s <> '')"
_LOOSE = "regexp_replace(lower(text), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')"
_FOLD = f"regexp_replace(lower({_STRIP}), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')"


def _docs(t, *columns):
    return t("documents").select("doc_id", *columns, "text")


_LENGTHS = f"(SELECT doc_id, list_transform({_SENTENCES}, lambda s: len({_WORDS.replace('text', 's')})) AS c FROM documents)"
_SHARE = "CASE WHEN len(c) = 0 THEN 0.0 ELSE round(len(list_filter(c, lambda n: {})) / len(c), 6) END"


@query(f"""
SELECT doc_id, len(c) AS sentence_count, coalesce(round(list_avg(c), 6), 0) AS length_mean, coalesce(round(list_aggregate(c, 'stddev_pop'), 6), 0) AS length_std,
  CASE WHEN coalesce(list_sum(c), 0) = 0 THEN 0.0 ELSE round(list_aggregate(c, 'stddev_pop') / list_avg(c), 6) END AS length_cv,
  {_SHARE.format('n <= 10')} AS short_ratio, {_SHARE.format('n > 10 AND n <= 20')} AS medium_ratio, {_SHARE.format('n > 20')} AS long_ratio FROM {_LENGTHS}""")
def sentence_length_features(t):
    d = V.sentence_lengths(T.once(_docs(t), sentences=T.sentences()))
    names = {"sentence_length_mean": "length_mean", "sentence_length_std": "length_std", "sentence_length_cv": "length_cv", "short_sentence_ratio": "short_ratio", "medium_sentence_ratio": "medium_ratio", "long_sentence_ratio": "long_ratio"}
    return d.select("doc_id", "sentence_count", *(F.round(f, 6).alias(to) for f, to in names.items()))


@query(f"""
SELECT doc_id, coalesce(len({_WORDS}), 0) AS n_words, coalesce(len(list_distinct({_WORDS})), 0) AS n_distinct,
  CASE WHEN coalesce(len({_WORDS}), 0) = 0 THEN 0.0 ELSE round(len(list_distinct({_WORDS})) / len({_WORDS}), 6) END AS type_token_ratio FROM documents""")
def type_token_ratio(t):
    d = T.once(_docs(t), w=T.words(F.coalesce("text", F.lit("")))).select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))
    return d.withColumn("type_token_ratio", T.ratio(F.col("n_distinct"), F.col("n_words")))


def _repeats(n: int) -> str:
    gram = " || ' ' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(n))
    return f"""
WITH a AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, {gram} AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM a WHERE len(w) >= {n})),
c AS (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY ALL),
s AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS total, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS repeated FROM c GROUP BY doc_id)
SELECT doc_id, coalesce(total, 0) AS total, coalesce(repeated, 0) AS repeated, coalesce(round(repeated / total, 6), 0) AS ratio FROM documents LEFT JOIN s USING (doc_id)"""


def _repeated(t, n):
    d = V.repeated_grams(T.once(_docs(t), words=T.words(F.coalesce("text", F.lit("")))), "words", n, "r")
    return d.select("doc_id", F.col("r_total").alias("total"), F.col("r_repeated").alias("repeated"), F.round("r", 6).alias("ratio"))


@query(_repeats(2))
def repeated_bigram_ratio(t):
    return _repeated(t, 2)


@query(_repeats(3))
def repeated_trigram_ratio(t):
    return _repeated(t, 3)


@query(f"""
WITH w AS (SELECT doc_id, unnest({_WORDS}) AS word, generate_subscripts({_WORDS}, 1) - 1 AS i FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY 1),
p AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id, word ORDER BY i) AS prev FROM w)
SELECT doc_id, coalesce(mattr, 0) AS mattr FROM documents LEFT JOIN (
  SELECT doc_id, round(CASE WHEN n <= 50 THEN CAST(count_if(prev IS NULL) AS DOUBLE) / n
    ELSE CAST(sum(greatest(least(i, n - 50) - greatest(coalesce(prev, -1), i - 50, -1), 0)) AS DOUBLE) / (50 * (n - 49)) END, 6) AS mattr
  FROM p JOIN n USING (doc_id) GROUP BY doc_id, n) USING (doc_id)""")
def moving_average_ttr(t):
    d = V.moving_average_ttr(T.once(_docs(t), words=T.words(F.coalesce("text", F.lit("")))), "words", "mattr")
    return d.select("doc_id", F.round("mattr", 6).alias("mattr"))


@query(f"""
WITH s AS (SELECT doc_id, unnest({_SENTENCES}) AS text FROM documents),
o AS (SELECT doc_id, array_to_string(list_slice({_TOKENS.replace('text', 'lower(text)')}, 1, 2), ' ') AS opening FROM s),
c AS (SELECT doc_id, opening, count(*) AS n FROM o GROUP BY ALL),
r AS (SELECT doc_id, CASE WHEN sum(n) < 2 THEN 0.0 ELSE round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n), 6) END AS ratio FROM c GROUP BY doc_id)
SELECT doc_id, coalesce(ratio, 0) AS ratio FROM documents LEFT JOIN r USING (doc_id)""")
def repeated_opening_ratio(t):
    d = V.repeated_openings(T.once(_docs(t), sentences=T.sentences()), "sentences", "ratio")
    return d.select("doc_id", F.round("ratio", 6).alias("ratio"))


_LEXICON = f"(SELECT word, round(log10(count(*) * 1e9 / sum(count(*)) OVER ()), 4) AS zipf FROM (SELECT unnest({_WORDS}) AS word FROM benchmark) GROUP BY word)"


def _lexicon(t):
    w = t("benchmark").select(F.explode(T.words()).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return w.crossJoin(F.broadcast(w.agg(F.sum("n").alias("m")))).select("word", F.round(F.log10(F.col("n") * 1e9 / F.col("m")), 4).alias("zipf"))


@query(f"""
WITH w AS (SELECT doc_id, unnest({_WORDS}) AS word FROM documents), z AS (SELECT w.doc_id, coalesce(l.zipf, 0) AS zipf FROM w LEFT JOIN {_LEXICON} l USING (word)),
s AS (SELECT doc_id, count_if(zipf < 3) / count(*) AS r FROM z GROUP BY doc_id)
SELECT doc_id, coalesce(round(r, 6), 0) AS ratio FROM documents LEFT JOIN s USING (doc_id)""")
def rare_word_ratio(t):
    d = T.once(_docs(t), words=T.words(F.coalesce("text", F.lit(""))))
    return V.rare_word_ratio(d, _lexicon(t), "doc_id").select("doc_id", F.round("rare_word_ratio", 6).alias("ratio"))


@query(f"""SELECT doc_id, CASE WHEN length(text) > 20000 THEN 413 WHEN length({_STRIP}) < 1 OR text IS NULL THEN 422 ELSE 200 END AS status FROM documents""")
def validation_status(t):
    n = F.char_length("text")
    return t("documents").select("doc_id", F.when(n > 20000, 413).when(C.is_empty(), 422).otherwise(200).alias("status"))


@query("""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '\\r\\n', chr(10), 'g'), '\\r', chr(10), 'g'), '[\\x00-\\x08\\x0B-\\x1F\\x7F]', '', 'g')) AS text_md5 FROM documents""")
def normalized_text(t):
    return t("documents").select("doc_id", F.md5(T.normalized()).alias("text_md5"))


@query(f"""SELECT doc_id, len({_TOKENS}) AS n_tokens, len(string_split(text, chr(10) || chr(10))) AS n_paragraphs, regexp_matches(text, '\\r\\n\\r\\n|\\n\\n') AS marked,
  CASE WHEN {_STRIP} = '' THEN 0 ELSE len(regexp_extract_all({_STRIP}, '[.!?][ \\t\\n\\r\\f\\x0B]+')) + 1 END AS n_sentences_proxy FROM documents""")
def candidate_profile(t):
    return t("documents").select("doc_id", F.size(T.tokens()).alias("n_tokens"), F.size(T.paragraphs()).alias("n_paragraphs"), T.has_paragraph_marker().alias("marked"), T.sentence_proxy().alias("n_sentences_proxy"))


@query(f"""SELECT doc_id, len({_WORDS}) AS n, md5(array_to_string({_WORDS}, ' ')) AS digest FROM (SELECT doc_id, 'It isn''t l''été; they''re Ann''s. ' || text AS text FROM documents)""")
def alphabetic_words(t):
    d = t("documents").select("doc_id", T.words(F.concat(F.lit("It isn't l'été; they're Ann's. "), F.col("text"))).alias("w"))
    return d.select("doc_id", F.size("w").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


@query(f"""SELECT doc_id FROM documents WHERE len({_TOKENS}) BETWEEN 50 AND 500 AND CASE WHEN {_STRIP} = '' THEN 0 ELSE len(regexp_extract_all({_STRIP}, '[.!?][ \\t\\n\\r\\f\\x0B]+')) + 1 END >= 3 AND len(string_split(text, chr(10) || chr(10))) >= 1""")
def candidate_filter(t):
    return t("documents").where(F.size(T.tokens()).between(50, 500) & (T.sentence_proxy() >= 3) & (F.size(T.paragraphs()) >= 1)).select("doc_id")


@query("""SELECT doc_id FROM (SELECT doc_id FROM documents WHERE n_chars BETWEEN 500 AND 3000 ORDER BY md5('42:' || doc_id), doc_id LIMIT 100)""")
def seed_sample(t):
    d = t("documents").where(F.col("n_chars").between(500, 3000))
    return d.orderBy(F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string"))), "doc_id").limit(100).select("doc_id")


@query("""
WITH f AS (SELECT source, row_number() OVER (ORDER BY md5('7:' || source), source) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))
SELECT source, CASE WHEN r <= round_even(0.7 * n, 0) THEN 'train' WHEN r <= round_even(0.7 * n, 0) + round_even(0.15 * n, 0) THEN 'validation' ELSE 'test' END AS split FROM f""")
def family_split(t):
    return C.family_split(t("documents"), "source", 7)


@query("""SELECT conv_id, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles FROM conversations GROUP BY conv_id HAVING count(DISTINCT role) > 1""")
def split_violations(t):
    return C.split_violations(t("conversations"), "conv_id", "role").select("conv_id", F.array_join("splits", ",").alias("roles"))


def _either(items, pattern):
    return " OR ".join(pattern.format(p.replace("'", "''")) for p in items)


#: An instruction to seek in the texts.
INSTRUCTION = "rewrite the following text so that it reads like a new one and keep its length"
_GRAMS = [" ".join(INSTRUCTION.split()[k : k + 6]) for k in range(len(INSTRUCTION.split()) - 5)]
_CHECKS = f"""(WITH a AS (SELECT doc_id, {_TOKENS.replace('text', 'lower(text)')} AS w FROM documents),
g AS (SELECT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM a WHERE len(w) >= 3)),
c AS (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY ALL), r AS (SELECT doc_id, sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n) > 0.3 AS again FROM c GROUP BY doc_id)
SELECT doc_id, coalesce({_STRIP}, '') = '' AS empty_output, coalesce(NOT len({_TOKENS}) BETWEEN 30 AND 2000, true) AS length_out_of_bounds,
  coalesce({_either(_GRAMS, "contains(" + _LOOSE + ", '{}')")}, false) AS instruction_leakage, coalesce({_either(C.SELF_REFERENCES, "contains(" + _LOOSE + ", '{}')")}, false) AS ai_self_reference,
  coalesce(again, false) AS excessive_repetition, coalesce({_either(C.PREAMBLES, "starts_with(lower(" + _STRIP + "), '{}')")}, false) AS instruction_artifact_preamble FROM documents LEFT JOIN r USING (doc_id))"""
_FLAGS = ", ".join(f"{n} AND NOT empty_output AS {n}" if k else n for k, n in enumerate(C.NOTES))
_NOTED = " || ".join(f"CASE WHEN {n} THEN '{n},' ELSE '' END" for n in C.NOTES)


@query(f"SELECT *, {_NOTED} AS notes FROM (SELECT doc_id, {_FLAGS} FROM {_CHECKS})")
def qc_flags(t):
    d = C.quality_checks(_docs(t), "text", INSTRUCTION)
    return d.select("doc_id", *C.NOTES, F.array_join(F.transform("notes", lambda n: F.concat(n, F.lit(","))), "").alias("notes"))


_SIGN = f"left({_FOLD}, 80) AS head, right({_FOLD}, 80) AS tail, length({_FOLD}) AS n"


@query(f"""WITH s AS (SELECT {_SIGN}, count(*) AS c FROM documents GROUP BY ALL HAVING count(*) > 1)
SELECT count(*) AS n_groups, CAST(coalesce(sum(c), 0) AS BIGINT) AS n_rows FROM s""")
def near_duplicate_groups(t):
    f = t("documents").select(C.signature().alias("s"))
    return f.groupBy("s").agg(F.count("*").alias("c")).where("c > 1").agg(F.count("*").alias("n_groups"), F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"))


@query("""SELECT source, count(*) AS n, min(n_chars) AS least, round(median(n_chars), 6) AS middle, round(quantile_cont(n_chars, 0.1), 6) AS p10,
  round(quantile_cont(n_chars, 0.9), 6) AS p90, max(n_chars) AS most FROM documents GROUP BY source""")
def prompt_summary(t):
    p = lambda q: F.round(F.percentile("n_chars", q), 6)
    return t("documents").groupBy("source").agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), p(0.5).alias("middle"), p(0.1).alias("p10"), p(0.9).alias("p90"), F.max("n_chars").alias("most"))


@query("""SELECT lang, count_if(quality = 1) AS good, count_if(quality = 0) AS bad FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def qc_pivot(t):
    return t("documents").join(t("labels"), "doc_id").groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))


_SCORED = "(SELECT doc_id, lang, quality AS y, round(1 / (1 + exp(-(n_chars - 1500) / 1000.0)), 6) AS score FROM documents JOIN labels USING (doc_id))"


def _scored(t):
    d = t("documents").select("doc_id", "lang", "n_chars").join(t("labels"), "doc_id")
    return d.select("doc_id", "lang", F.col("quality").alias("y"), F.round(1 / (1 + F.exp(-(F.col("n_chars") - 1500) / 1000.0)), 6).alias("score"))


_CELLS = "count_if(y = 1 AND score >= {t}) AS tp, count_if(y = 0 AND score >= {t}) AS fp, count_if(y = 0 AND score < {t}) AS tn, count_if(y = 1 AND score < {t}) AS fn"


def _measures(places=6):
    div = lambda a, b: f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE round(({a}) / ({b}), {places}) END"
    out = [f"tp + fp + tn + fn AS n, {div('tp + tn', 'tp + fp + tn + fn')} AS accuracy"]
    for name, a, p, n in (("machine", "tp", "fp", "fn"), ("human", "tn", "fn", "fp")):
        out.append(f"{div(a, f'{a} + {p}')} AS precision_{name}, {div(a, f'{a} + {n}')} AS recall_{name}, {div(f'2 * {a}', f'2 * {a} + {p} + {n}')} AS f1_{name}")
    return ", ".join(out)


def _rounded(df, places=6):
    return df.select(*(F.round(c, places).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


@query(f"SELECT *, {_measures()}, 0.47 AS threshold FROM (SELECT {_CELLS.format(t='0.47')} FROM {_SCORED})")
def metrics_at_threshold(t):
    return _rounded(E.metrics_at(_scored(t), 0.47))


@query(f"SELECT *, {_measures()} FROM (SELECT CAST(i AS INTEGER) AS percent, {_CELLS.format(t='i / 100.0')} FROM {_SCORED}, range(1, 100) r(i) GROUP BY i)")
def threshold_sweep(t):
    return _rounded(E.sweep(_scored(t)))


@query(f"""SELECT percent / 100.0 AS threshold, round(f, 4) AS f1 FROM (SELECT percent, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f
  FROM (SELECT i AS percent, {_CELLS.format(t='i / 100.0')} FROM {_SCORED}, range(1, 100) r(i) GROUP BY i)) ORDER BY f DESC, percent LIMIT 1""")
def chosen_threshold(t):
    return E.chosen_threshold(_scored(t))


@query(f"SELECT lang, count(*) AS n, round(avg(score), 5) AS mean, round(median(score), 5) AS middle, round(stddev_pop(score), 5) AS std, min(score) AS least, max(score) AS most FROM {_SCORED} GROUP BY lang")
def score_summary(t):
    return _scored(t).groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("score"), 5).alias("mean"), F.round(F.median("score"), 5).alias("middle"), F.round(F.stddev_pop("score"), 5).alias("std"), F.min("score").alias("least"), F.max("score").alias("most"))


@query(f"""
WITH g AS (SELECT lang, count(*) AS n, count_if(score >= 0.47) AS k FROM {_SCORED} WHERE y = 0 GROUP BY lang), p AS (SELECT *, k / n AS p FROM g)
SELECT lang, n, k, CASE WHEN n >= 10 THEN round((p + 1.9208 / n - 1.96 * sqrt(p * (1 - p) / n + 0.9604 / n / n)) / (1 + 3.8416 / n), 6) END AS low,
  CASE WHEN n >= 10 THEN round((p + 1.9208 / n + 1.96 * sqrt(p * (1 - p) / n + 0.9604 / n / n)) / (1 + 3.8416 / n), 6) END AS high FROM p""")
def subgroup_wilson(t):
    g = _scored(t).where("y = 0").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 0.47).alias("k"))
    end = lambda s: F.when(F.col("n") >= E.LEAST_GROUP, F.round(E.wilson(F.col("k"), F.col("n"), s), 6))
    return g.select("lang", "n", "k", end(-1).alias("low"), end(1).alias("high"))


@query("""
WITH s AS (SELECT doc_id, lang, source, n_chars FROM documents)
SELECT doc_id, source, rank FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM s) WHERE rank <= 3""")
def rank_top_k(t):
    w = W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return t("documents").select("doc_id", "source", F.row_number().over(w).alias("rank"), ).where("rank <= 3")


@query("""SELECT conv_id, turn, length(text) - lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS delta FROM conversations""")
def predictability_delta(t):
    n = F.char_length("text")
    return t("conversations").select("conv_id", "turn", (n - F.lag(n).over(W.partitionBy("conv_id").orderBy("turn"))).alias("delta"))


@query("""
SELECT a.doc_id FROM labels a LEFT JOIN (SELECT doc_id FROM documents WHERE lang = 'en') d ON a.doc_id = d.doc_id WHERE d.doc_id IS NULL""")
def manifest_integrity(t):
    return t("labels").select("doc_id").join(t("documents").where("lang = 'en'").select("doc_id"), "doc_id", "left_anti")


@query("""SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) AS similarity
FROM embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0) q
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) DESC, e.vec_id) <= 10""")
def embedding_similarity(t):
    """The ten nearest of all vectors for every vector whose id is divisible by 20."""
    return nearest(t("embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 10)


@query("""
WITH x AS (SELECT 'n_chars' AS feature, CAST(n_chars AS DOUBLE) AS v FROM documents JOIN labels USING (doc_id) WHERE quality = 1)
SELECT feature, count(v) AS n, round(avg(v), 5) AS mean, round(stddev_samp(v), 5) AS std FROM x GROUP BY feature""")
def reference_stats(t):
    v = t("documents").join(t("labels").where("quality = 1"), "doc_id").select(F.lit("n_chars").alias("feature"), F.col("n_chars").cast("double").alias("v"))
    return v.groupBy("feature").agg(F.count("v").alias("n"), F.round(F.avg("v"), 5).alias("mean"), F.round(F.stddev_samp("v"), 5).alias("std"))
