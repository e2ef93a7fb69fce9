"""Text functions as Column expressions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What counts as white space at a text's ends.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0"


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns that are computed once a row, however often later expressions use them.

    The optimizer puts a projection's expressions into the ones that use it, into lambda functions too, where they would
    run once an element. It never does so beyond a generator, and that's what a list of one row is.
    """
    x = F.explode(F.array(F.struct(*(c.alias(k) for k, c in columns.items()))))
    return df.withColumn("once a row", x).select(*df.columns, *(F.col("`once a row`").getField(k).alias(k) for k in columns))


def strip(c: str | Column = "text") -> Column:
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(WHITE))


def words(c: str | Column = "text") -> Column:
    """Words of letters alone, in lower case: English clitics are split off, and what still has an apostrophe inside is dropped."""
    low = F.lower(c)
    parted = F.regexp_replace(F.regexp_replace(low, "n['\u2019]t\\b", " "), "['\u2019](s|m|re|ve|ll|d)\\b", " ")
    whole = F.filter(F.regexp_extract_all(parted, F.lit("\\p{L}+(?:['\u2019]\\p{L}+)*"), F.lit(0)), lambda w: ~w.rlike("['\u2019]"))
    return F.when(low.rlike("['\u2019]"), whole).otherwise(F.regexp_extract_all(low, F.lit("\\p{L}+"), F.lit(0)))


def tokens(c: str | Column = "text") -> Column:
    """Pieces between ASCII white space."""
    return F.filter(F.split(c, "[ \\t\\n\\r\\f\\x0B]+"), lambda x: x != "")


def sentences(c: str | Column = "text") -> Column:
    """Runs up to and with their stops; a line end parts sentences too. Null has none."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit("[^.!?\\n]+[.!?]*"), F.lit(0)), lambda s: strip(s)), lambda s: s != "")


def sentence_proxy(c: str | Column = "text") -> Column:
    """How many pieces a stop and white space part a text into; 0 for a blank one."""
    return F.when(strip(c) == "", 0).otherwise(F.regexp_count(strip(c), F.lit("[.!?][ \\t\\n\\r\\f\\x0B]+")) + 1)


def without_controls(c: str | Column = "text") -> Column:
    """Line ends as line feeds, control characters but tab and line feed gone."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "\\r\\n", "\n"), "\\r", "\n"), "[\\x00-\\x08\\x0B-\\x1F\\x7F]", "")


#: A character that form C may change or join with the one before it; those below, all Latin letters, begin anew and stay.
UNSTABLE = "[^\\x00-\\x{2FF}]"


def composed(c: str | Column = "text") -> Column:
    """Unicode's form C. Spark has no function for it: texts with an ``UNSTABLE`` character go to Python, one at a time from
    Arrow batches, others stay."""
    @F.arrow_udf("string")
    def nfc(s: pa.Array) -> pa.Array:
        return pa.array((x.as_py() and unicodedata.normalize("NFC", x.as_py()) for x in s), pa.string())

    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(nfc(F.when(c.rlike(UNSTABLE), c)), c)


def normalized(c: str | Column = "text") -> Column:
    return without_controls(composed(c))


def folded(c: str | Column = "text") -> Column:
    """Lower case, stripped, runs of white space as one space."""
    return F.regexp_replace(F.lower(strip(c)), "[ \\t\\n\\r\\f\\x0B]+", " ")


def loosely_folded(c: str | Column = "text") -> Column:
    """As ``folded``, not stripped."""
    return F.regexp_replace(F.lower(c), "[ \\t\\n\\r\\f\\x0B]+", " ")


def gram_hashes(array: str, n: int) -> Column:
    """Hashes of all runs of ``n`` elements of an array column; the column must be computed already (``once``)."""
    size = F.size(array) - (n - 1)
    out = F.transform(F.slice(array, 1, F.greatest(size, F.lit(0))), lambda w: F.xxhash64(w))
    for k in range(1, n):
        out = F.zip_with(out, F.slice(array, k + 1, F.greatest(size, F.lit(0))), lambda h, w: F.xxhash64(h, w))
    return out


def n_repeated(array: str) -> Column:
    """Elements that have an equal one in the array: in order, those equal to a neighbour. Needs a sorted, computed array."""
    n = F.size(array)
    same = F.zip_with(F.slice(array, 1, F.greatest(n - 1, F.lit(0))), F.slice(array, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: a == b)
    edge = F.array(F.lit(False))
    return F.size(F.filter(F.zip_with(F.concat(edge, same), F.concat(same, edge), lambda a, b: a | b), lambda x: x))


def ngrams(array: str, n: int) -> Column:
    size = F.size(array)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.concat_ws(" ", F.slice(array, i, n)))).otherwise(F.array().cast("array<string>"))


def ratio(a: Column, b: Column) -> Column:
    """a / b; 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def expanded(df: DataFrame, row: str, *more: Column | str) -> DataFrame:
    """The columns of a struct column, and more."""
    return df.select(*(F.col(row).getField(f).alias(f) for f in df.schema[row].dataType.fieldNames()), *more)


def paragraphs(c: str | Column = "text") -> Column:
    """Pieces between blank lines."""
    return F.split(c, "\\n\\n", -1)


def has_paragraph_marker(c: str | Column = "text") -> Column:
    return (F.col(c) if isinstance(c, str) else c).rlike("\\r\\n\\r\\n|\\n\\n")


def containing_paragraph(c: str, at: Column) -> Column:
    """Index of the first paragraph with start <= at < end; 0 where none has. The separator's places belong to none."""
    before = F.substring(F.col(c), F.lit(1), at)
    index = F.size(paragraphs(before)) - 1
    # a place within a separator, or beyond the text, is in no paragraph
    inside = (at >= 0) & (at < F.char_length(c)) & ~F.substring(F.col(c), at + 1, F.lit(2)).eqNullSafe(F.lit("\n\n")) & ~((at > 0) & F.substring(F.col(c), at, F.lit(2)).eqNullSafe(F.lit("\n\n")))
    return F.when(inside, index).otherwise(F.lit(0))


def paragraph_spliced(c: str, index: Column, new: Column) -> Column:
    return F.array_join(F.transform(paragraphs(c), lambda p, k: F.when(k == index, new).otherwise(p)), "\n\n")


def truncated_to_budget(c: str, ends: str, target: Column, over: float = 1.15) -> Column:
    """The longest prefix up to one of ``ends`` (rising places behind sentences) with at most ``target * over`` words.

    At least one sentence stays; without sentences the text does.
    """
    n = lambda e: F.size(tokens(F.substring(F.col(c), F.lit(1), e)))
    fits = F.filter(F.col(ends), lambda e: n(e) <= target * over)
    return F.when(F.size(ends) == 0, F.col(c)).otherwise(F.substring(F.col(c), F.lit(1), F.coalesce(F.array_max(fits), F.col(ends)[0])))


def max_new_tokens(n_words: Column) -> Column:
    return F.floor(n_words * 1.6).cast("int") + 20
