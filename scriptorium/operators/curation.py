"""Building and checking a data set: samples, splits, quality checks, near duplicates, manifests, reviews, screens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.similarity import similarities
from .near_copies import paired

#: Phrases by which a text gives itself away, and openings it must not have.
SELF_REFERENCES = ("as an ai", "as an artificial intelligence", "as a language model", "as an ai language model", "i am an ai", "i'm an ai", "i do not have personal experiences", "i don't have personal experiences", "i don't have personal feelings", "as a large language model")
PREAMBLES = ("sure,", "sure!", "here is", "here's", "certainly", "of course")
#: Notes of the quality checks, in order.
NOTES = ("empty_output", "length_out_of_bounds", "instruction_leakage", "ai_self_reference", "excessive_repetition", "instruction_artifact_preamble")
#: Similarity from which a rewrite is likely preserved, the band below it that needs review, and from which a
#: sentence is covered.
PRESERVED, REVIEW_BAND, COVERED = 0.75, 0.35, 0.45
#: Number words that count as numbers.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion trillion".split()


# Samples and splits


def _order(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def seed_sample(rows: DataFrame, key: str, n: int, seed: int, keep: Column | None = None, strict: bool = True) -> DataFrame:
    """The ``n`` rows of ``keep`` that come first in a seeded order, by key; raises if ``strict`` and there are fewer."""
    own = rows if keep is None else rows.where(keep)
    if strict:
        there = own.limit(n).count()
        if there < n:
            raise ValueError(f"{n} rows are asked for, {there} are there")
    return own.orderBy(_order(key, seed), key).limit(n)


def excluded(rows: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """``rows`` whose key isn't among the used ones."""
    return rows.join(used.select(key), key, "left_anti")


def family_split(rows: DataFrame, family: str, seed: int, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """``(family, split)``: families in a seeded order, the first 70 % to train, the next 15 % to validation, halves to even.

    The order is cut by 256 parts of the hash: parts are counted, and ranks are sought within a part, so that no task
    sorts all families. A null family is a family.
    """
    f = rows.select(family).distinct().withColumn("h", F.coalesce(_order(family, seed), F.lit("")))
    f = f.withColumn("part", F.substring("h", 1, 2))
    sizes = f.groupBy("part").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("part", before.alias("before"), F.sum("m").over(W.partitionBy()).alias("n"))  # 257 rows at most
    rank = F.col("before") + F.row_number().over(W.partitionBy("part").orderBy("h", family))
    first, second = F.bround(F.col("n") * train), F.bround(F.col("n") * validation)
    split = F.when(F.col("rank") <= first, "train").when(F.col("rank") <= first + second, "validation").otherwise("test")
    return f.join(sizes, "part").withColumn("rank", rank).select(family, split.alias("split"))


def split_violations(rows: DataFrame, family: str, split: str) -> DataFrame:
    """Families that lie in more than one split, with the splits in order."""
    return rows.groupBy(family).agg(F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def picked(items: str, seed: Column, keep) -> Column:
    """Index of the element, of those that ``keep`` takes, whose seeded hash is least; null if there is none."""
    all_ = F.transform(items, lambda x, i: F.struct(F.md5(F.concat_ws(":", seed, i.cast("string"))).alias("h"), i.alias("i"), x.alias("x")))
    return F.array_min(F.transform(F.filter(all_, lambda y: keep(y["x"])), lambda y: F.struct(y["h"], y["i"])))["i"]


def rewrite_sentence(sentences: str, seed: Column) -> Column:
    return picked(sentences, seed, lambda s: F.size(T.tokens(s)).between(8, 40))


def rewrite_paragraph(paragraphs: str, seed: Column) -> Column:
    return picked(paragraphs, seed, lambda s: F.size(T.tokens(s)) >= 15)


# Quality checks of a text


def is_empty(c: str = "text") -> Column:
    return F.coalesce(T.strip(c), F.lit("")) == ""


def leaks(c: str, instruction: str, n: int = 6, loose: str | None = None) -> Column:
    """Whether ``n`` consecutive words of the instruction stand in the text; case and runs of white space aside. ``loose``
    names a column that holds the text so folded already: an expression within an ``or`` is computed for each of its parts."""
    w, body = instruction.lower().split(), F.col(loose) if loose else T.loosely_folded(c)
    out = F.lit(False)
    for k in range(len(w) - n + 1):
        out = out | F.contains(body, F.lit(" ".join(w[k : k + n])))
    return F.coalesce(out, F.lit(False))


def refers_to_itself(c: str = "text", loose: str | None = None) -> Column:
    found, body = F.lit(False), F.col(loose) if loose else T.loosely_folded(c)
    for p in SELF_REFERENCES:
        found = found | F.contains(body, F.lit(p))
    return F.coalesce(found, F.lit(False))


def has_preamble(c: str = "text") -> Column:
    found, start = F.lit(False), F.lower(F.left(T.strip(c), F.lit(max(map(len, PREAMBLES)))))
    for p in PREAMBLES:
        found = found | F.startswith(start, F.lit(p))
    return F.coalesce(found, F.lit(False))


def quality_checks(rows: DataFrame, c: str, instruction: str, least: int = 30, most: int = 2000) -> DataFrame:
    """``rows`` with six flags and ``notes``, the names of those that are set, in order. An empty text has only the first."""
    d = rows.select(F.struct(*rows.columns).alias("row"), F.col(c).alias("body"))
    c = "body"
    d = T.once(d, loose=T.loosely_folded(c))
    d = T.once(d, tokens=F.filter(F.split(F.coalesce(F.col("loose"), F.lit("")), " "), lambda x: x != ""))
    d = T.once(d, grams=F.array_sort(T.gram_hashes("tokens", 3)))
    n = F.size("tokens")
    flags = [
        is_empty(c),
        ~n.between(least, most),
        leaks(c, instruction, loose="loose"),
        refers_to_itself(c, "loose"),
        (n >= 3) & (T.n_repeated("grams") > 0.3 * F.size("grams")),
        has_preamble(c),
    ]
    d = T.once(d, flags=F.array(*(f if k == 0 else f & ~is_empty(c) for k, f in enumerate(flags))))
    named = F.filter(F.zip_with(F.array(*map(F.lit, NOTES)), "flags", lambda name, f: F.when(f, name)), lambda x: x.isNotNull())
    return T.expanded(d, "row", *(F.col("flags")[k].alias(name) for k, name in enumerate(NOTES)), named.alias("notes"))


# Sentences of two versions


def aligned(rows: DataFrame, a: str, b: str) -> DataFrame:
    """``rows`` with ``structure_drift`` (the arrays differ in size) and ``pairs`` of the sentences place by place, with
    their similarity; none where they drift."""
    drift = F.size(a) != F.size(b)
    d = rows.withColumn("structure_drift", drift).withColumn("ratios", similarities(F.when(~drift, F.col(a)), F.when(~drift, F.col(b))))
    zipped = F.zip_with(F.arrays_zip(F.col(a).alias("original"), F.col(b).alias("candidate")), "ratios", lambda p, r: F.struct(p["original"].alias("original"), p["candidate"].alias("candidate"), r.alias("similarity")))
    return d.withColumn("pairs", F.when(drift, F.array().cast("array<struct<original:string,candidate:string,similarity:double>>")).otherwise(zipped)).drop("ratios")


def modified(pairs: str, threshold: float) -> Column:
    """Indices of the pairs of a similarity below ``threshold``."""
    return F.filter(F.transform(pairs, lambda p, i: F.when(p["similarity"] < threshold, i)), lambda i: i.isNotNull())


def paragraph_pair(human: str, index: Column, new: str) -> Column:
    """A paragraph and what stands in its place in ``new``: what lies between the unchanged text before and behind it; null
    where that text isn't unchanged or there is no such paragraph."""
    parts = T.paragraphs(human)
    h, n = F.col(human), F.col(new)
    before = F.array_join(F.slice(parts, 1, index), "\n\n")
    start = F.char_length(before) + F.when(index > 0, 2).otherwise(0)
    own = F.get(parts, index)
    prefix, suffix = F.substring(h, F.lit(1), start), F.substring(h, start + F.char_length(own) + 1, F.char_length(h))
    there = (index >= 0) & (index < F.size(parts)) & F.startswith(n, prefix) & F.endswith(n, suffix)
    middle = F.substring(n, start + 1, F.greatest(F.char_length(n) - F.char_length(suffix) - start, F.lit(0)))
    return F.when(there, F.struct(own.alias("original"), middle.alias("rewritten")))


# Near duplicates


def signature(c: str = "text") -> Column:
    f = T.folded(c)
    return F.struct(F.left(f, F.lit(80)).alias("head"), F.right(f, F.lit(80)).alias("tail"), F.length(f).alias("n"))


def equal_signatures(rows: DataFrame, key: str, c: str = "text") -> DataFrame:
    """Rows whose signature others share, with the least key that has it: ``(key, group)``. A group of m rows stands for its
    m (m - 1) / 2 pairs, which needn't be written out."""
    s = rows.select(key, signature(c).alias("s"))
    groups = s.groupBy("s").agg(F.min(key).alias("group"), F.count("*").alias("n")).where("n > 1").select("s", "group")
    return s.join(groups, "s").select(key, "group")


def shingled_pairs(rows: DataFrame, key: str, c: str = "text", size: int = 5, least: float = 0.2) -> DataFrame:
    """Pairs ``(a, b, jaccard)``, a < b, whose sets of ``size``-word shingles have a Jaccard similarity of ``least`` or more.

    Rows of equal sets are one class, of which the least key stands.
    """
    d = T.once(rows.select(key, c), w=T.tokens(F.lower(F.coalesce(F.col(c), F.lit("")))))
    d = T.once(d, s=F.array_sort(F.array_distinct(T.gram_hashes("w", size)))).where(F.size("s") > 0)
    d = d.groupBy("s").agg(F.min(key).alias("id"))
    return paired(d, least)


# Corpus reports


def word_count_discrepancy(rows: DataFrame, told: Column, counted: Column) -> DataFrame:
    """How far told counts of words are from counted ones: median and greatest difference, and shares of rows by it."""
    off = F.abs(told - counted)
    share = lambda c: F.round(F.avg(c.cast("int")) * 100, 2)
    return rows.agg(F.median(off).alias("median"), F.max(off).alias("most"), share(off <= 2).alias("percent_2"), share((off > 2) & (off <= 20)).alias("percent_20"), share(off > 20).alias("percent_more"))


def marker_coverage(rows: DataFrame, c: str = "text") -> DataFrame:
    """The share of texts with a blank line; 0 without texts."""
    return rows.agg(F.round(F.coalesce(F.avg(T.has_paragraph_marker(c).cast("int")), F.lit(0.0)), 6).alias("coverage"))


def duplicate_ids(rows: DataFrame, key: str) -> DataFrame:
    """Ids that more than one row has, and how many."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def prompt_summary(rows: DataFrame, prompt: str, text: str, order: str, value: str) -> DataFrame:
    """Per prompt, nulls aside: its first text by ``order``, whether all its texts are one, the commonest text (the least of
    equals), and count and quantiles of ``value``."""
    p = lambda q: F.round(F.percentile(value, q), 6)
    own = rows.where(F.col(prompt).isNotNull())
    # texts are counted first: the commonest is then one of few
    common = own.where(F.col(text).isNotNull()).groupBy(prompt, text).agg(F.count("*").alias("m"))
    common = common.groupBy(prompt).agg(F.min(F.struct((-F.col("m")).alias("m"), F.col(text).alias("t")))["t"].alias("common"), (F.count("*") == 1).alias("one_text"))
    g = own.groupBy(prompt).agg(F.min_by(text, order).alias("first"), F.count("*").alias("n"), F.min(value).alias("least"), p(0.5).alias("middle"), p(0.1).alias("p10"), p(0.9).alias("p90"), F.max(value).alias("most"))
    return g.join(common, prompt, "left")


def length_stats(rows: DataFrame, category: str, length: str) -> DataFrame:
    """Per category count, least, median and greatest of the lengths that aren't null or 0."""
    return rows.where(F.col(length) != 0).groupBy(category).agg(F.count("*").alias("n"), F.min(length).alias("least"), F.round(F.median(length), 6).alias("middle"), F.max(length).alias("most"))


def drift_distribution(rows: DataFrame, category: str) -> DataFrame:
    """Per category how many rows drift, how many are aligned, and the aligned pairs' similarities in order."""
    ratios = F.flatten(F.collect_list(F.transform("pairs", lambda p: F.round(p["similarity"], 4))))
    return rows.groupBy(category).agg(F.count_if("structure_drift").alias("drift"), F.count_if(~F.col("structure_drift")).alias("aligned"), F.array_sort(ratios).alias("similarities"))


def pivot(rows: DataFrame, category: str, status: str, values: list[str]) -> DataFrame:
    """Counts by category and status, a column per status, 0 where none is."""
    return rows.groupBy(category).pivot(status, values).count().fillna(0, values)


# Manifests and reviews


def manifest(rows: DataFrame, kind: str, status: str, review: str) -> DataFrame:
    """``rows`` of the kinds that a manifest lists, with ``included``: human texts always, full rewrites if they passed,
    light edits if a review calls them preserved. Rows of other kinds are left out."""
    k = F.col(kind)
    yes = F.when(k == "human", True).when(k == "full_ai", F.col(status).eqNullSafe(F.lit("passed"))).when(k == "light", F.col(review).eqNullSafe(F.lit("preserved")))
    return rows.withColumn("included", yes).where(F.col("included").isNotNull())


def included(rows: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    return rows.join(listed.where("included").select(key), key, "left_semi")


def integrity(rows: DataFrame, yes: DataFrame, no: DataFrame, key: str) -> DataFrame:
    """What is wrong between rows and a manifest's two lists: ``(problem, key)`` of listed ids without a row, rows that no
    list has, ids on both lists, and repeated ids, an entry per occurrence."""
    a, b, r = yes.select(key), no.select(key), rows.select(key)
    listed = a.unionByName(b)
    found = [("no_row", listed.distinct().join(r, key, "left_anti")), ("not_listed", r.distinct().join(listed, key, "left_anti")), ("on_both", a.intersect(b))]
    times = listed.groupBy(key).agg(F.count("*").alias("m")).where("m > 1")
    found.append(("repeated", times.select(F.explode(F.array_repeat(F.col(key), F.col("m").cast("int"))).alias(key))))
    out = None
    for name, part in found:
        part = part.select(F.lit(name).alias("problem"), key)
        out = part if out is None else out.unionByName(part)
    return out


def reviewed(rows: DataFrame, reviews: DataFrame, key: str, value: str, allowed: list[str]) -> DataFrame:
    """``rows`` with ``value`` from the reviews where there is one; raises on a value that isn't allowed and on an unknown key."""
    wrong = reviews.where(~F.col(value).isin(*allowed) | F.col(value).isNull()).limit(1).collect()
    unknown = reviews.join(rows, key, "left_anti").limit(1).collect()
    if wrong or unknown:
        raise ValueError(f"a review has the value {wrong[0][value]}" if wrong else f"a review is of {unknown[0][key]}, which isn't there")
    new = reviews.groupBy(key).agg(F.max(value).alias("reviewed value"))
    old = F.col(value) if value in rows.columns else F.lit(None).cast("string")
    return rows.join(new, key, "left").withColumn(value, F.coalesce("reviewed value", old)).drop("reviewed value")


# Screens of a rewrite's meaning


def facts(c: str) -> Column:
    """Numbers and names of a text, in lower case: runs of digits and number words; capitalised words not at a sentence's
    start, neighbours together."""
    numbers = F.array_union(F.regexp_extract_all(c, F.lit("\\d+(?:[.,]\\d+)*"), F.lit(0)), F.filter(T.words(c), lambda w: w.isin(*NUMBER_WORDS)))
    names = F.regexp_extract_all(c, F.lit("[\\p{L}\\p{N},;:)\"'] (\\p{Lu}\\p{L}+(?: \\p{Lu}\\p{L}+)*)"), F.lit(1))
    return F.struct(F.array_sort(F.array_distinct(numbers)).alias("numbers"), F.array_sort(F.array_distinct(F.transform(names, lambda x: F.lower(x)))).alias("names"))


def fact_check(a: str, b: str) -> Column:
    """Of two structs of facts: missing numbers and names, added numbers, and ``flagged`` if there is any. Added names are
    no matter."""
    lost, names, new = F.array_except(f"{a}.numbers", f"{b}.numbers"), F.array_except(f"{a}.names", f"{b}.names"), F.array_except(f"{b}.numbers", f"{a}.numbers")
    return F.struct((F.size(lost) + F.size(names) + F.size(new) > 0).alias("flagged"), F.array_sort(lost).alias("missing_numbers"), F.array_sort(names).alias("missing_names"), F.array_sort(new).alias("added_numbers"))


def cosine(a: str | Column, b: str | Column) -> Column:
    """0 where either vector has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def screen_label(similarity: Column, flagged_: Column, preserved: float = PRESERVED, band: float = REVIEW_BAND) -> Column:
    return F.when(flagged_, "needs_review").when(similarity >= preserved, "likely_preserved").when(similarity >= preserved - band, "needs_review").otherwise("likely_changed")


def coverage(original: DataFrame, rewritten: DataFrame, key: str, threshold: float = COVERED) -> DataFrame:
    """Per sentence ``(key, i)`` of the original the best match ``(j, similarity)`` among the rewrite's, the first of equals,
    and whether it's dropped. Both have ``(key, i, embedding)``; a side without sentences has no rows."""
    b = rewritten.select(key, F.col("i").alias("j"), F.col("embedding").alias("e"))
    met = original.join(b, key).select(key, "i", "j", cosine("embedding", "e").alias("s"))
    best = met.groupBy(key, "i").agg(F.max(F.struct("s", (-F.col("j")).alias("j"))).alias("b"))
    return best.select(key, "i", (-F.col("b.j")).alias("j"), F.round("b.s", 4).alias("similarity"), (F.col("b.s") < threshold).alias("dropped"))


def coverage_report(texts: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    """A row a key of ``texts``: how many sentences ``coverage`` has matched, how many are dropped, and the least
    similarity; a text that lacks sentences on either side has 0, 0 and null."""
    g = covered.groupBy(key).agg(F.count("*").alias("n_sentences"), F.count_if("dropped").alias("n_dropped"), F.min("similarity").alias("min_similarity"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return texts.select(key).distinct().join(g, key, "left").select(key, zero("n_sentences"), zero("n_dropped"), "min_similarity")


def claim_label(dropped: Column, flagged_: Column) -> Column:
    return F.when(dropped | flagged_, "possible_omission_flagged").otherwise("no_omission_signal")


def with_original(rows: DataFrame, family: str, kind: str, original: str = "original") -> DataFrame:
    """Each derived row beside its family's original: columns of the latter as ``original``."""
    base = rows.where(F.col(kind) == original).select(F.col(family).alias("family of original"), F.struct(*rows.columns).alias("original"))
    return rows.where(F.col(kind) != original).join(base, F.col(family) == F.col("family of original")).drop("family of original")


def calibration(rows: DataFrame, label: str, similarity: str) -> DataFrame:
    """Per reviewed label its similarities in order."""
    return rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.array_sort(F.collect_list(F.round(similarity, 4))).alias("similarities"))
