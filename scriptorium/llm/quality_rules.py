"""Quality rules by distribution divergence.

Every text is compared with references of its language: the share of each character class, and the share of each
common word. The distance is Jensen-Shannon's (base 2). References are built from all texts of a language, so they
follow the corpus; a text of fewer than ``min_words`` words is too short for a histogram and only the base rules
judge it. A language without common words listed below has only the character-class comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table
from .words import SPACE, Chunk, Words, chunks, one_hash, windows, words

#: Frequent function words of the languages.
COMMON = {
    "en": "the of and to in a is that for it was on are as with be by at from or this an",
    "de": "der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als",
    "fr": "de la le et les des en un une du dans qui que est pour au sur par pas avec il elle",
    "es": "de la que el en y a los se del las un por con una su para es al lo como no",
}
#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
CLASSES = 8  # lower, upper, digit, space, stop, symbol, other ASCII, beyond ASCII
_CLASS = np.full(256, 6, np.int64)
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[SPACE] = 3
_CLASS[np.frombuffer(b".,;:!?'\"-()", np.uint8)] = 4
_CLASS[np.frombuffer(SYMBOLS, np.uint8)] = 5
_CLASS[128:] = 7
_CONT = np.zeros(256, np.int64)
_CONT[128:192] = 1
_LIST = {lang: np.array(sorted({one_hash(w.encode()) for w in text.split()}), np.uint64) for lang, text in COMMON.items()}
WIDTH = 1 + max(map(len, _LIST.values()))

MIN_WORDS = 40
MAX_CLASS_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.36
#: Both exceeded: rejected, though neither is beyond its own limit.
JOINT_DISTANCES = (0.16, 0.32)

REF_SCHEMA = "lang string, n_docs long, classes array<double>, common array<double>"
OUT_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, class_distance double, word_distance double, base_failed boolean, kept boolean"


def _segment_sums(values: np.ndarray, limits: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[limits[1:]] - total[limits[:-1]]


def _histograms(c: Chunk, w: Words, langs: list) -> tuple[np.ndarray, np.ndarray]:
    """Per row: counts by character class (code points), and counts of its language's common words (last: all others)."""
    kinds = np.zeros((c.rows, CLASSES))
    whole = _CONT[c.data] == 0
    for k in range(CLASSES):
        kinds[:, k] = _segment_sums(((_CLASS[c.data] == k) & whole).astype(np.int64), c.offsets)
    common = np.zeros((c.rows, WIDTH))
    for k, lang in enumerate(langs):
        if lang in _LIST:
            own = w.hashes[w.bounds[k] : w.bounds[k + 1]]
            at = np.minimum(np.searchsorted(_LIST[lang], own), len(_LIST[lang]) - 1)
            hit = _LIST[lang][at] == own
            common[k, : len(_LIST[lang])] = np.bincount(at[hit], minlength=len(_LIST[lang]))
            common[k, -1] = len(own) - hit.sum()
    return kinds, common


def _reference_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for c in chunks(batch.column("text")):
            w, own = words(c), langs[c.first : c.first + c.rows]
            kinds, common = _histograms(c, w, own)
            enough = np.diff(w.bounds) >= MIN_WORDS
            for lang in set(own):
                rows = np.array([x == lang for x in own]) & enough
                s = sums.setdefault(lang, [0, np.zeros(CLASSES), np.zeros(WIDTH)])
                s[0] += int(rows.sum())
                # each text weighs alike, so that one long text can't make the reference
                s[1] += (kinds[rows] / np.maximum(1, kinds[rows].sum(1, keepdims=True))).sum(0)
                s[2] += (common[rows] / np.maximum(1, common[rows].sum(1, keepdims=True))).sum(0)
    if sums:
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "n_docs": pa.array([s[0] for s in sums.values()], pa.int64()), "classes": pa.array([s[1].tolist() for s in sums.values()], pa.list_(pa.float64())), "common": pa.array([s[2].tolist() for s in sums.values()], pa.list_(pa.float64()))})


def references(docs: DataFrame) -> DataFrame:
    """Mean histograms per language over all texts of at least ``MIN_WORDS`` words: ``(lang, n_docs, classes, common)``."""
    parts = docs.select("lang", "text").mapInArrow(_reference_part, REF_SCHEMA)
    cells = lambda name, n: F.array(*[F.sum(F.col(name)[k]) for k in range(n)])
    return parts.groupBy("lang").agg(F.sum("n_docs").alias("n_docs"), cells("classes", CLASSES).alias("classes"), cells("common", WIDTH).alias("common"))


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Square root of the Jensen-Shannon divergence in bits, row by row; 0 where either histogram is empty."""
    ps, qs = p.sum(-1, keepdims=True), q.sum(-1, keepdims=True)
    p, q = p / np.where(ps > 0, ps, 1), q / np.where(qs > 0, qs, 1)
    m = (p + q) / 2
    part = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(-1)
    found = np.sqrt(np.maximum(0, (part(p) + part(q)) / 2))
    return np.where((ps[..., 0] > 0) & (qs[..., 0] > 0), found, 0.0)


def repeated_words(hashes: np.ndarray, size: int = 8) -> int:
    """Words inside ``size``-word windows that occur at least twice in the text."""
    own = windows(hashes, size)
    if len(own) < 2:
        return 0
    _, inverse, counts = np.unique(own, return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[inverse] > 1)
    if not len(at):
        return 0
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + size, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def duplicate_lines(text: bytes) -> int:
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line.strip(b" \t\n\v\f\r"):
            n += line in seen
            seen.add(line)
    return n


def judged(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Per row of a batch with text, lang and its reference: the five counts, both distances, base_failed and kept."""
    langs, out = batch.column("lang").to_pylist(), [[] for _ in range(7)]
    reference = [np.array(batch.column(x).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, n) for x, n in ((REF_CLASSES, CLASSES), (REF_COMMON, WIDTH))]
    for c in chunks(batch.column("text")):
        w, own = words(c), langs[c.first : c.first + c.rows]
        kinds, common = _histograms(c, w, own)
        exact = words(c, lower=False).hashes
        points = np.concatenate([[0], np.cumsum(_CONT[c.data] == 0)])
        refs = [x[c.first : c.first + c.rows] for x in reference]
        for to, found in zip(out, (
            np.diff(w.bounds),
            _segment_sums(points[w.ends] - points[w.starts], w.bounds),
            _segment_sums((_CLASS[c.data] == 5).astype(np.int64), c.offsets),
            [duplicate_lines(c.text(k)) for k in range(c.rows)],
            [repeated_words(exact[w.bounds[k] : w.bounds[k + 1]]) for k in range(c.rows)],
            js_distance(kinds, refs[0]),
            js_distance(common, refs[1]),
        ), strict=True):
            to.append(np.asarray(found))
    n, chars, symbols, lines, repeats, by_class, by_word = (np.concatenate(x) if x else np.zeros(0) for x in out)
    failed = (n < 20) | (100 * repeats > 30 * n)
    odd = (by_class > MAX_CLASS_DISTANCE) | (by_word > MAX_WORD_DISTANCE) | ((by_class > JOINT_DISTANCES[0]) & (by_word > JOINT_DISTANCES[1]))
    return [n, chars, symbols, lines, repeats, by_class, by_word, failed, ~failed & ~((n >= MIN_WORDS) & odd)]


REF_CLASSES, REF_COMMON = "reference of classes", "reference of common words"


def with_references(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``rows`` with the reference of their language in ``docs``; Spark tells the tasks all references only where they are few."""
    refs = table(references(docs), "references").select(F.col("lang").alias("lang of reference"), F.col("classes").alias(REF_CLASSES), F.col("common").alias(REF_COMMON))
    return rows.join(refs, F.col("lang").eqNullSafe(F.col("lang of reference"))).drop("lang of reference")


def verdicts(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text, lang)``: counts, distances, ``base_failed`` and ``kept``.

    Null text counts as empty: no words, so it fails the base rule. A null language has its own reference. Repeated
    rows are judged one by one, alike. An empty table gives no rows. Columns beyond the three are not read.
    """
    names = [x.split()[0] for x in OUT_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *counts, by_class, by_word, failed, kept = judged(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in counts), pa.array(by_class, pa.float64()), pa.array(by_word, pa.float64()), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())], names=names)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    return with_references(own, own).mapInArrow(run, OUT_SCHEMA)


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that ``verdicts`` keeps. Columns of any other name may be there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(judged(batch)[-1], pa.bool_())).select(names)

    names = docs.columns
    return with_references(docs, docs).mapInArrow(run, docs.schema)


def op7_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
