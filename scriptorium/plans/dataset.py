"""Queries over feature vectors, paragraphs, near duplicates, manifests, reviews, screens and subgroup reports.

The test tables lack what some operators take (tokens with their log-probabilities and grammar, manifests, reviews); these
queries derive such inputs from ``documents`` by a rule that the SQL beside each states too.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.similarity import similarities
from ..operators import curation as C
from ..operators import evaluation as E
from ..operators import features as V
from ..operators import near_copies as N
from ..operators import scoring
from .queries import _FOLD, _LENGTHS, _SCORED, _SENTENCES, _TOKENS, _WORDS, _rounded, _scored, query
from .scoring import _FEATURES, _ITEMS, _SCORE, MODEL, _features

# Vectors. A sentence's tokens are its words, and a word of n letters has the log-probability -n / 2; sentences of fewer
# than two words have no language-model values.

_LM = f"""(SELECT doc_id, i, CASE WHEN len(w) >= 2 THEN list_avg(l) END AS mean_log_prob, CASE WHEN len(w) >= 2 THEN list_median(l) END AS median_log_prob,
  CASE WHEN len(w) >= 2 THEN list_aggregate(l, 'var_pop') END AS log_prob_variance, CASE WHEN len(w) >= 2 THEN exp(-list_avg(l)) END AS perplexity, CASE WHEN len(w) >= 2 THEN len(w) END AS token_count
  FROM (SELECT doc_id, i, w, list_transform(w, lambda x: -length(x) / 2.0) AS l FROM (SELECT doc_id, i, {_WORDS} AS w
  FROM (SELECT doc_id, unnest({_SENTENCES}) AS text, generate_subscripts({_SENTENCES}, 1) - 1 AS i FROM documents))))"""
_SENT = f"(SELECT f.*, l.* EXCLUDE (doc_id, i), l.mean_log_prob - lag(l.mean_log_prob) OVER (PARTITION BY f.doc_id ORDER BY f.i) AS predictability_delta FROM {_FEATURES} f JOIN {_LM} l ON f.doc_id = l.doc_id AND f.i = l.i)"
_OWN = ("word_count", "char_count", "punctuation_count", "avg_word_length")
_LMS = (*V.LM_FIELDS, "predictability_delta")


def _sentences(t):
    s = T.once(V.sentence_features(t("documents")), l=F.transform(T.words("sentence"), lambda w: -F.char_length(w) / F.lit(2.0)))
    n = F.size("l")
    mean = F.aggregate("l", F.lit(0.0), lambda a, x: a + x) / n
    s = T.once(s, o=F.array_sort("l"), mean_log_prob=F.when(n >= 2, mean))
    median = (F.get("o", F.floor((n - 1) / 2).cast("int")) + F.get("o", F.floor(n / 2).cast("int"))) / 2
    variance = F.aggregate(F.transform("l", lambda x: (x - F.col("mean_log_prob")) * (x - F.col("mean_log_prob"))), F.lit(0.0), lambda a, x: a + x) / n
    some = F.col("mean_log_prob").isNotNull()
    s = s.withColumn("median_log_prob", F.when(some, median)).withColumn("log_prob_variance", F.when(some, variance)).withColumn("perplexity", F.exp(-F.col("mean_log_prob"))).withColumn("token_count", F.when(some, n))
    return V.deltas(s.drop("l", "o", "sentence"))


def _essays(t):
    return V.sentence_lengths(T.once(t("documents").select("doc_id", "text"), sentences=T.sentences())).select("doc_id", "sentence_count", "sentence_length_mean", "short_sentence_ratio")


_ESSAY = f"""(SELECT doc_id, len(c) AS sentence_count, coalesce(list_avg(c), 0) AS sentence_length_mean, CASE WHEN len(c) = 0 THEN 0.0 ELSE len(list_filter(c, lambda n: n <= 10)) / len(c) END AS short_sentence_ratio FROM {_LENGTHS})"""
_THREE = ("sentence_count", "sentence_length_mean", "short_sentence_ratio")


@query(f"""SELECT e.doc_id, {', '.join(f'round(CAST(CASE WHEN m.n IS NOT NULL THEN {f} END AS DOUBLE), 6) AS stylo_{f}' for f in _THREE)}, {', '.join(f'round(a_{f}, 6) AS stylo_mean_{f}' for f in _OWN)}, {', '.join(f'round(a_{f}, 6) AS lm_mean_{f}' for f in _LMS)},
  coalesce(n, 0) AS n_sentences_total, coalesce(k, 0) AS n_sentences_scored_by_lm FROM {_ESSAY} e
  LEFT JOIN (SELECT doc_id, {', '.join(f'avg({f}) AS a_{f}' for f in (*_OWN, *_LMS))}, count(*) AS n, count(mean_log_prob) AS k FROM {_SENT} GROUP BY doc_id) m ON e.doc_id = m.doc_id""")
def essay_vector(t):
    out = V.essay_vector(_essays(t), _sentences(t))
    return _rounded(out.withColumn("stylo_sentence_count", F.col("stylo_sentence_count").cast("double")))


@query(f"""SELECT s.doc_id, s.i, {', '.join(f'round(CAST({f} AS DOUBLE), 6) AS stylo_{f}' for f in _THREE)}, {', '.join(f'round(CAST({f} AS DOUBLE), 6) AS stylo_mean_{f}' for f in _OWN)}, {', '.join(f'round(CAST({f} AS DOUBLE), 6) AS lm_mean_{f}' for f in _LMS)}
FROM {_SENT} s JOIN {_ESSAY} e ON s.doc_id = e.doc_id""")
def sentence_vectors(t):
    v = V.sentence_vectors(_essays(t), _sentences(t))
    return v.select("doc_id", "i", *(F.round(F.col(c).cast("double"), 6).alias(c) for c in v.columns if c not in ("doc_id", "i")))


@query(f"""SELECT s.doc_id, s.i, CASE WHEN s.i % 3 = 0 THEN 'ai_assisted' ELSE 'human' END AS label, round(mean_log_prob, 6) AS lm, round(predictability_delta, 6) AS delta
FROM {_SENT} s WHERE mean_log_prob IS NOT NULL AND predictability_delta IS NOT NULL""")
def sentence_training_rows(t):
    """Every third sentence is labelled as assisted."""
    s = _sentences(t)
    labels = s.select("doc_id", "i", F.when(F.col("i") % 3 == 0, "ai_assisted").otherwise("human").alias("label"))
    rows = V.training_rows(V.sentence_vectors(_essays(t), s), labels)
    return rows.select("doc_id", "i", "label", F.round("lm_mean_mean_log_prob", 6).alias("lm"), F.round("lm_mean_predictability_delta", 6).alias("delta"))


@query(f"""WITH w AS (SELECT doc_id, i, unnest({_WORDS}) AS word, generate_subscripts({_WORDS}, 1) - 1 AS place FROM (SELECT doc_id, unnest({_SENTENCES}) AS text, generate_subscripts({_SENTENCES}, 1) - 1 AS i FROM documents))
SELECT doc_id, i, {', '.join(f'round(count_if(length(word) % 6 = {k}) / count(*), 6) AS {n}' for k, n in enumerate(('noun_ratio', 'verb_ratio', 'adj_ratio', 'adv_ratio', 'pronoun_ratio')))},
  CASE WHEN max(place) = 0 THEN 0 ELSE CAST(floor(log2(max(place))) + 1 AS INTEGER) END AS dependency_depth FROM w GROUP BY doc_id, i""")
def grammar_features(t):
    """A word's part of speech goes by its length, and its head is the word at half its place."""
    kinds = F.array(*map(F.lit, ("NOUN", "VERB", "ADJ", "ADV", "PRON", "X")))
    s = t("documents").select("doc_id", F.posexplode(T.sentences()).alias("i", "s")).select("doc_id", "i", F.posexplode(T.words("s")).alias("at", "w"))
    tokens = s.select("doc_id", "i", "at", F.get(kinds, F.char_length("w") % 6).alias("pos"), F.floor(F.col("at") / 2).cast("int").alias("head"))
    return _rounded(V.grammar_features(tokens))


# Ranking with evidence


@query(f"""WITH f AS {_FEATURES}, s AS (SELECT doc_id, i, round({_SCORE}, 4) AS score FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS rank, count(*) OVER (PARTITION BY doc_id) AS total FROM s),
e AS ({_ITEMS}), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, i ORDER BY abs(c) DESC, place) AS k FROM e)
SELECT r.doc_id, total AS total_scorable, r.rank, r.i, r.score, string_agg(o.field, ',' ORDER BY o.k) AS fields FROM r JOIN o ON r.doc_id = o.doc_id AND r.i = o.i AND o.k <= 3 WHERE r.rank <= 3 GROUP BY ALL""")
def localization(t):
    out = scoring.localized(_features(t), MODEL)
    return out.select("doc_id", "total_scorable", F.explode("candidates").alias("c")).select("doc_id", "total_scorable", "c.rank", "c.i", "c.score", F.array_join(F.transform("c.evidence", lambda e: e["field"]), ",").alias("fields"))


@query(f"SELECT feature, lang, n, round(mean, 5) AS mean, round(std, 5) AS std FROM (SELECT 'n_chars' AS feature, lang, count(n_chars) AS n, avg(n_chars) AS mean, stddev_pop(n_chars) AS std FROM documents GROUP BY lang UNION ALL SELECT 'words', lang, count(len({_TOKENS})), avg(len({_TOKENS})), stddev_pop(len({_TOKENS})) FROM documents GROUP BY lang)")
def feature_distribution(t):
    d = t("documents").select("lang", "n_chars", F.size(T.tokens()).alias("words"))
    return E.feature_distribution(d, ["n_chars", "words"], "lang")


# Paragraphs and spans


@query("""WITH p AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents), d AS (SELECT doc_id, array_to_string(l, chr(10) || chr(10)) AS text FROM p),
b AS (SELECT doc_id, text, unnest([0, 50, 200, 1000]) AS at FROM d),
s AS (SELECT doc_id, x - 1 AS k, sum(length(q[x]) + 2) OVER (PARTITION BY doc_id ORDER BY x) - length(q[x]) - 2 AS a, length(q[x]) AS n FROM (SELECT doc_id, q, unnest(range(1, len(q) + 1)) AS x FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS q FROM d)))
SELECT b.doc_id, b.at, CAST(coalesce(min(s.k), 0) AS INTEGER) AS paragraph FROM b LEFT JOIN s ON b.doc_id = s.doc_id AND b.at >= s.a AND b.at < s.a + s.n GROUP BY ALL""")
def containing_paragraph(t):
    d = t("documents").select("doc_id", F.regexp_replace("text", "\\n", "\n\n").alias("text"), F.explode(F.array(*map(F.lit, (0, 50, 200, 1000)))).alias("at"))
    return d.select("doc_id", "at", T.containing_paragraph("text", F.col("at")).alias("paragraph"))


@query("""SELECT doc_id, md5(array_to_string(list_transform(string_split(text, chr(10) || chr(10)), lambda p, i: CASE WHEN i = 1 THEN 'new' ELSE p END), chr(10) || chr(10))) AS digest FROM documents""")
def paragraph_splice(t):
    return t("documents").select("doc_id", F.md5(T.paragraph_spliced("text", F.lit(0), F.lit("new"))).alias("digest"))


@query("""WITH d AS (SELECT doc_id, text, [x for x in [100, 200, 300, 400, 500] if x <= length(text)] AS ends FROM documents WHERE length(text) >= 100),
e AS (SELECT doc_id, text, ends, list_filter(ends, lambda x: len(list_filter(string_split_regex(substring(text, 1, x), '[ \\t\\n\\r\\f\\x0B]+'), lambda y: y <> '')) <= 40 * 1.15) AS fit FROM d)
SELECT doc_id, md5(substring(text, 1, coalesce(list_max(fit), ends[1]))) AS digest, CAST(floor(40 * 1.6) AS INTEGER) + 20 AS max_new FROM e""")
def word_budget(t):
    """Sentences are taken to end at every hundredth character."""
    d = t("documents").where(F.char_length("text") >= 100).withColumn("ends", F.filter(F.array(*map(F.lit, (100, 200, 300, 400, 500))), lambda x: x <= F.char_length("text")))
    return d.select("doc_id", F.md5(T.truncated_to_budget("text", "ends", F.lit(40))).alias("digest"), T.max_new_tokens(F.lit(40)).alias("max_new"))


@query("""WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents), p AS (SELECT doc_id, text, array_to_string(l, chr(10) || chr(10)) AS human, l FROM d)
SELECT doc_id, md5(l[1]) AS original, md5('new ' || l[1] || ' and' || chr(10) || chr(10) || 'more') AS rewritten FROM p""")
def paragraph_pair(t):
    """The first paragraph is rewritten to two."""
    d = t("documents").select("doc_id", F.regexp_replace("text", "\\n", "\n\n").alias("human"))
    d = d.withColumn("new", T.paragraph_spliced("human", F.lit(0), F.concat(F.lit("new "), F.get(T.paragraphs("human"), F.lit(0)), F.lit(" and\n\nmore"))))
    pair = C.paragraph_pair("human", F.lit(0), "new")
    return d.select("doc_id", pair.alias("p")).select("doc_id", F.md5("p.original").alias("original"), F.md5("p.rewritten").alias("rewritten"))


@query("""WITH h AS (SELECT doc_id, text, 10 AS b1, 30 AS e1, 25 AS b2, 60 AS e2 FROM documents WHERE length(text) >= 100)
SELECT doc_id, unnest([0, 10, 25, 60]) AS start_char, unnest([10, 30, 60, length(text)]) AS end_char, unnest([false, true, true, false]) AS hit, md5(unnest([substring(text, 1, 10), substring(text, 11, 20), substring(text, 26, 35), substring(text, 61)])) AS digest FROM h""")
def highlight_segments(t):
    """Two overlapping spans: a highlight shows its whole span, gaps only what no span has shown."""
    from ..operators import spans

    d = t("documents").where(F.char_length("text") >= 100)
    marks = F.array(F.struct(F.lit(25).alias("b"), F.lit(60).alias("e")), F.struct(F.lit(10).alias("b"), F.lit(30).alias("e")))
    out = spans.highlights(d.select("doc_id", "text", marks.alias("spans")), "text", "spans")
    return out.select("doc_id", "start_char", "end_char", "hit", F.md5("segment").alias("digest"))


# Near duplicates

_SHINGLES = f"(SELECT doc_id, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS s FROM (SELECT doc_id, {_TOKENS.replace('text', 'lower(text)')} AS w FROM documents WHERE length(text) < 600) WHERE len(w) >= 5)"


@query(f"""WITH s AS {_SHINGLES}, c AS (SELECT min(doc_id) AS id, list_sort(s) AS s FROM s GROUP BY list_sort(s)), g AS (SELECT id, unnest(s) AS g FROM c), n AS (SELECT id, len(s) AS n FROM c),
p AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM g x JOIN g y ON x.g = y.g AND x.id < y.id GROUP BY ALL)
SELECT a, b, round(k / (x.n + y.n - k), 6) AS jaccard FROM p JOIN n x ON a = x.id JOIN n y ON b = y.id WHERE k / (x.n + y.n - k) >= 0.2""")
def shingled_pairs(t):
    d = t("documents").where(F.char_length("text") < 600)
    return _rounded(C.shingled_pairs(d, "doc_id"))


@query(f"""WITH s AS (SELECT doc_id, left({_FOLD}, 80) AS head, right({_FOLD}, 80) AS tail, length({_FOLD}) AS n FROM documents)
SELECT doc_id, g AS "group" FROM (SELECT doc_id, min(doc_id) OVER w AS g, count(*) OVER w AS k FROM s WINDOW w AS (PARTITION BY head, tail, n)) WHERE k > 1""")
def near_duplicate_pairs(t):
    return C.equal_signatures(t("documents"), "doc_id")


@query()
def near_copies(t):
    """Per document its class and group of near copies by the ratio of matching blocks, its class's links, and whether a
    document of another source is among them."""
    d = t("documents")
    members, links = N.near_copies(d, "doc_id", "source")
    n = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("n_links"))
    flags = N.flagged(d.select("doc_id"), members, links, "doc_id").withColumnRenamed("doc_id", "key")
    return members.join(n, "class", "left").join(flags, "key").select(F.col("key").alias("doc_id"), "class", "group", F.coalesce("n_links", F.lit(0)).alias("n_links"), "duplicate")


@query()
def turn_similarity(t):
    """The ratio of matching blocks of each turn and the one before it."""
    before = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    d = t("conversations").select("conv_id", "turn", "text", before.alias("before"))
    return d.select("conv_id", "turn", F.when(F.col("before").isNotNull(), similarities(F.array("before"), F.array("text"))[0]).alias("similarity"))


# Corpus reports


@query(f"""WITH d AS (SELECT abs(n_chars / 6 - len({_TOKENS})) AS off FROM documents)
SELECT round(median(off), 6) AS median, round(max(off), 6) AS most, round(avg(CAST(off <= 2 AS INTEGER)) * 100, 2) AS percent_2, round(avg(CAST(off > 2 AND off <= 20 AS INTEGER)) * 100, 2) AS percent_20, round(avg(CAST(off > 20 AS INTEGER)) * 100, 2) AS percent_more FROM d""")
def word_count_discrepancy(t):
    return _rounded(C.word_count_discrepancy(t("documents"), F.col("n_chars") / 6, F.size(T.tokens())))


@query("SELECT round(coalesce(avg(CAST(regexp_matches(text, '\\r\\n\\r\\n|\\n\\n') AS INTEGER)), 0), 6) AS coverage FROM documents")
def marker_coverage(t):
    return C.marker_coverage(t("documents"))


@query("SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def duplicate_ids(t):
    return C.duplicate_ids(t("conversations"), "conv_id")


@query("""WITH c AS (SELECT source, lang, count(*) AS m FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY ALL), m AS (SELECT source, arg_min(lang, (-m, lang)) AS common, count(*) = 1 AS one_text FROM c GROUP BY source)
SELECT source, arg_min(lang, doc_id) AS first, count(*) AS n, min(n_chars) AS least, round(median(n_chars), 6) AS middle, round(quantile_cont(n_chars, 0.1), 6) AS p10, round(quantile_cont(n_chars, 0.9), 6) AS p90, max(n_chars) AS most, any_value(common) AS common, any_value(one_text) AS one_text
FROM documents JOIN m USING (source) GROUP BY source""")
def prompt_texts(t):
    """The source as prompt, its languages as the prompt's texts."""
    return C.prompt_summary(t("documents"), "source", "lang", "doc_id", "n_chars")


@query("SELECT lang, count(*) AS n, min(n_chars) AS least, round(median(n_chars), 6) AS middle, max(n_chars) AS most FROM documents WHERE n_chars <> 0 GROUP BY lang")
def length_stats(t):
    return C.length_stats(t("documents"), "lang", "n_chars")


@query("SELECT lang, count_if(quality = 0) AS \"0\", count_if(quality = 1) AS \"1\" FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def status_pivot(t):
    return C.pivot(t("documents").join(t("labels"), "doc_id"), "lang", "quality", ["0", "1"])


# Manifests, reviews and splits

_KIND = "CASE doc_id % 4 WHEN 0 THEN 'human' WHEN 1 THEN 'full_ai' WHEN 2 THEN 'light' ELSE 'other' END"


def _manifest(t):
    d = t("documents").select("doc_id", F.expr(_KIND).alias("kind")).join(t("labels"), "doc_id", "left")
    return C.manifest(d.withColumn("status", F.when(F.col("quality") == 1, "passed").otherwise("rejected")).withColumn("review", F.when(F.col("toxic") == 0, "preserved")), "kind", "status", "review")


_MANIFEST = f"""(SELECT d.doc_id, k AS kind, CASE k WHEN 'human' THEN true WHEN 'full_ai' THEN coalesce(quality = 1, false) ELSE coalesce(toxic = 0, false) END AS included FROM (SELECT doc_id, {_KIND} AS k FROM documents) d LEFT JOIN labels USING (doc_id) WHERE k <> 'other')"""


@query(f"SELECT * FROM {_MANIFEST}")
def inclusion_manifest(t):
    return _manifest(t).select("doc_id", "kind", "included")


@query(f"SELECT d.doc_id, n_chars FROM documents d WHERE doc_id IN (SELECT doc_id FROM {_MANIFEST} WHERE included)")
def included_rows(t):
    return C.included(t("documents").select("doc_id", "n_chars"), _manifest(t), "doc_id")


@query("""WITH a AS (SELECT doc_id FROM labels WHERE quality = 1 UNION ALL SELECT doc_id FROM labels WHERE doc_id % 10 = 0), b AS (SELECT doc_id FROM labels WHERE toxic = 1 UNION ALL SELECT -1), l AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT 'no_row' AS problem, doc_id FROM (SELECT DISTINCT doc_id FROM l WHERE doc_id NOT IN (SELECT doc_id FROM documents))
UNION ALL SELECT 'not_listed', doc_id FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM l))
UNION ALL SELECT 'on_both', doc_id FROM (SELECT doc_id FROM a INTERSECT SELECT doc_id FROM b)
UNION ALL SELECT 'repeated', doc_id FROM (SELECT doc_id, count(*) OVER (PARTITION BY doc_id) AS m FROM l) WHERE m > 1""")
def manifest_problems(t):
    y = t("labels")
    yes = y.where("quality = 1").select("doc_id").unionByName(y.where("doc_id % 10 = 0").select("doc_id"))
    no = y.where("toxic = 1").select("doc_id").unionByName(y.sparkSession.range(1).select(F.lit(-1).cast("long").alias("doc_id")))
    return C.integrity(t("documents"), yes, no, "doc_id")


@query("SELECT doc_id, CASE WHEN quality IS NOT NULL THEN CASE WHEN quality = 1 THEN 'preserved' ELSE 'changed' END ELSE 'open' END AS state FROM documents LEFT JOIN labels USING (doc_id)")
def applied_reviews(t):
    d = t("documents").select("doc_id", F.lit("open").alias("state"))
    known = t("labels").join(t("documents").select("doc_id"), "doc_id", "left_semi")
    reviews = known.select("doc_id", F.when(F.col("quality") == 1, "preserved").otherwise("changed").alias("state"))
    return C.reviewed(d, reviews, "doc_id", "state", ["preserved", "changed"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def seed_exclusion(t):
    return C.excluded(t("documents").select("doc_id"), t("labels"), "doc_id")


@query(f"""WITH s AS (SELECT doc_id, unnest({_SENTENCES}) AS text, generate_subscripts({_SENTENCES}, 1) - 1 AS i FROM documents), k AS (SELECT * FROM s WHERE len({_TOKENS}) BETWEEN 8 AND 40)
SELECT d.doc_id, CAST(p.i AS INTEGER) AS i FROM documents d LEFT JOIN (SELECT doc_id, arg_min(i, md5('42:' || doc_id || ':' || i)) AS i FROM k GROUP BY doc_id) p ON d.doc_id = p.doc_id""")
def rewrite_choice(t):
    d = T.once(t("documents").select("doc_id", "text"), sentences=T.sentences())
    return d.select("doc_id", C.rewrite_sentence("sentences", F.concat(F.lit("42:"), F.col("doc_id").cast("string"))).alias("i"))


# Screens: a conversation's next turn as the rewrite of the one before

_NUMBERS = "list_sort(list_distinct(list_concat(regexp_extract_all({c}, '\\d+(?:[.,]\\d+)*'), list_filter(regexp_extract_all(lower({c}), '\\p{{L}}+'), lambda w: list_contains({words}, w)))))"
_NAMES = "list_sort(list_distinct(list_transform(regexp_extract_all({c}, '[\\p{{L}}\\p{{N}},;:)\"''] (\\p{{Lu}}\\p{{L}}+(?: \\p{{Lu}}\\p{{L}}+)*)', 1), lambda x: lower(x))))"
_WORDLIST = "[" + ", ".join(f"'{w}'" for w in C.NUMBER_WORDS) + "]"


def _facts_sql(c):
    return _NUMBERS.format(c=c, words=_WORDLIST), _NAMES.format(c=c)


@query(f"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS a, lead(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations),
f AS (SELECT conv_id, turn, {_facts_sql('a')[0]} AS na, {_facts_sql('a')[1]} AS ma, {_facts_sql('b')[0]} AS nb, {_facts_sql('b')[1]} AS mb, turn % 10 / 10.0 AS s FROM t WHERE b IS NOT NULL),
g AS (SELECT *, len(list_filter(na, lambda x: NOT list_contains(nb, x))) + len(list_filter(ma, lambda x: NOT list_contains(mb, x))) + len(list_filter(nb, lambda x: NOT list_contains(na, x))) > 0 AS flagged FROM f)
SELECT conv_id, turn, flagged, len(na) AS n_numbers, len(ma) AS n_names, CASE WHEN flagged THEN 'needs_review' WHEN s >= 0.75 THEN 'likely_preserved' WHEN s >= 0.4 THEN 'needs_review' ELSE 'likely_changed' END AS label,
  CASE WHEN s < 0.45 OR flagged THEN 'possible_omission_flagged' ELSE 'no_omission_signal' END AS claim FROM g""")
def semantic_screen(t):
    """Similarities are taken to be the turn's number modulo ten, in tenths."""
    from pyspark.sql import Window as W

    c = t("conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("a"))
    c = c.withColumn("b", F.lead("a").over(W.partitionBy("conv_id").orderBy("turn"))).where("b is not null")
    d = T.once(c, fa=C.facts("a"), fb=C.facts("b"))
    s, f = F.col("turn") % 10 / 10.0, F.col("check.flagged")
    d = T.once(d, check=C.fact_check("fa", "fb"))
    return d.select("conv_id", "turn", f.alias("flagged"), F.size("fa.numbers").alias("n_numbers"), F.size("fa.names").alias("n_names"), C.screen_label(s, f, 0.75, 0.35).alias("label"), C.claim_label(s < C.COVERED, f).alias("claim"))


@query("""WITH v AS (SELECT vec_id // 10 AS g, vec_id % 10 AS i, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.g, a.i, b.i AS j, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.g = b.g WHERE a.i < 5 AND b.i >= 5)
SELECT g, i, j, round(s, 4) AS similarity, s < 0.45 AS dropped FROM (SELECT *, row_number() OVER (PARTITION BY g, i ORDER BY s DESC, j) AS r FROM p) WHERE r = 1""")
def sentence_coverage(t):
    """Of ten vectors in a row the first five are an original's sentences, the others its rewrite's."""
    v = t("embeddings").select(F.floor(F.col("vec_id") / 10).alias("g"), (F.col("vec_id") % 10).alias("i"), "embedding")
    return C.coverage(v.where("i < 5"), v.where("i >= 5"), "g")


@query("""WITH v AS (SELECT vec_id // 10 AS g, vec_id % 10 AS i, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.g, a.i, max(round(list_cosine_similarity(a.e, b.e), 4)) AS s, max(list_cosine_similarity(a.e, b.e)) AS x FROM v a JOIN v b ON a.g = b.g WHERE a.i < 5 AND b.i >= 5 AND b.g % 3 <> 0 AND a.g % 4 <> 0 GROUP BY a.g, a.i),
q AS (SELECT g, count(*) AS n, count(*) FILTER (WHERE x < 0.45) AS d, min(s) AS s FROM p GROUP BY g)
SELECT v.g, coalesce(n, 0) AS n_sentences, coalesce(d, 0) AS n_dropped, s AS min_similarity FROM (SELECT DISTINCT g FROM v) v LEFT JOIN q ON v.g = q.g""")
def coverage_report(t):
    """As ``sentence_coverage``, by text; every fourth original and every third rewrite has no sentence."""
    v = t("embeddings").select(F.floor(F.col("vec_id") / 10).alias("g"), (F.col("vec_id") % 10).alias("i"), "embedding")
    return C.coverage_report(v, C.coverage(v.where("i < 5 and g % 4 <> 0"), v.where("i >= 5 and g % 3 <> 0"), "g"), "g")


# Evaluation


@query(f"""WITH s AS (SELECT x.*, d.source FROM {_SCORED} x JOIN documents d USING (doc_id) WHERE y = 0), a AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'Yes' ELSE 'No' END AS v FROM documents WHERE doc_id % 3 > 0),
m AS (SELECT coalesce(a.v, 'unlabeled') AS g, score >= 0.47 AS wrong FROM s LEFT JOIN a USING (doc_id)), c AS (SELECT g, count(*) AS n, count_if(wrong) AS k FROM m GROUP BY g),
f AS (SELECT unnest(['Yes', 'No', 'unlabeled']) AS g), j AS (SELECT f.g, coalesce(n, 0) AS n, coalesce(k, 0) AS k, k / n AS p FROM f LEFT JOIN c USING (g))
SELECT g AS "group", n, k, round(p, 4) AS rate, CASE WHEN n >= 10 THEN round((p + 1.9208 / n - 1.96 * sqrt(p * (1 - p) / n + 0.9604 / n / n)) / (1 + 3.8416 / n), 4) END AS low,
  CASE WHEN n >= 10 THEN round((p + 1.9208 / n + 1.96 * sqrt(p * (1 - p) / n + 0.9604 / n / n)) / (1 + 3.8416 / n), 4) END AS high, CASE WHEN n < 10 THEN 'too few rows' END AS note FROM j""")
def subgroup_report(t):
    known = t("documents").where("doc_id % 3 > 0").select("doc_id", F.when(F.col("lang") == "en", "Yes").otherwise("No").alias("v"))
    return E.subgroup_report(_scored(t).where("y = 0"), known, "doc_id", "v", F.col("score") >= 0.47, ["Yes", "No"])


@query(f"""SELECT 'score' AS field, count_if(score IS NULL) AS n_missing FROM {_SCORED} HAVING count_if(score IS NULL) > 0 UNION ALL
SELECT 'quality', count_if(quality IS NULL) FROM documents LEFT JOIN labels USING (doc_id) HAVING count_if(quality IS NULL) > 0""")
def missingness(t):
    d = t("documents").join(t("labels"), "doc_id", "left").withColumn("score", F.lit(1.0))
    return E.missingness(d, ["score", "quality"])


@query("SELECT label, n FROM (SELECT lang AS label, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang) ORDER BY n DESC, label LIMIT 1")
def majority_baseline(t):
    return E.majority(t("documents"), "lang")


@query(f"SELECT doc_id, predicted, predicted = y AS correct, predicted = 1 AND y = 0 AS false_positive, predicted = 0 AND y = 1 AS false_negative FROM (SELECT *, CAST(score >= 0.47 AS INTEGER) AS predicted FROM {_SCORED})")
def prediction_audit(t):
    return E.audited(_scored(t), 0.47).select("doc_id", "predicted", "correct", "false_positive", "false_negative")


@query("SELECT doc_id, quality AS label, CAST((row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id), doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels")
def stratified_folds(t):
    return E.folds(t("labels").select("doc_id", F.col("quality").alias("label")), "doc_id", "label")
