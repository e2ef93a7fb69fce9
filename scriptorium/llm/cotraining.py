"""Quality by co-training: a text view and a metadata view label confident documents for each other.

Text view: hashed words, character classes, word length and variety. Metadata view: language, source and recorded length;
it never sees the text. Each is a logistic regression in numpy, fitted on the driver. In each round every unlabelled
document is scored by both views where it lies; among all of them each view is sure of a share per language and source,
and hands a seeded, bounded choice of these, with its label, to the other view to learn from. In the end each view is
calibrated by Platt's method on labels held out from it, and the calibrated log-odds are combined. Only what a fit takes is
bounded: ``MAX_LABELLED`` labelled rows and ``HANDED`` pseudo-labels of either kind a view and round.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop, table
from .words import SPACE, Chunk, chunks, plain_bytes, words

MAX_LABELLED = 4000
ROUNDS = 3
#: Documents of either label that a view hands over in a round, at most.
HANDED = 300
#: Share of a language's and source's unlabelled documents that may be handed over at either end.
SURE = 0.05
#: Log-odds beyond which a view is sure.
CONFIDENT = 1.0
HASHED = 1024
META_HASHED = 64
TEXT_WIDTH, META_WIDTH = HASHED + 6, 2 * META_HASHED + 3
#: Share of good calibration documents that may fall below the cut.
LOST = 0.01
SCHEMA = "doc_id long, text_score double, meta_score double, score double, kept boolean"
INPUT = ("doc_id", "text", "lang", "source", "n_chars")


def text_view(c: Chunk) -> np.ndarray:
    w = words(Chunk(c.first, plain_bytes(c.data), c.offsets), lower=False)
    out = np.zeros((c.rows, TEXT_WIDTH), np.float32)
    for k in range(c.rows):
        raw, own = c.data[c.offsets[k] : c.offsets[k + 1]], w.hashes[w.bounds[k] : w.bounds[k + 1]]
        if len(own):
            n = np.log1p(np.bincount((own % np.uint64(HASHED)).astype(np.int64), minlength=HASHED))
            out[k, :HASHED] = 3 * n / max(1e-9, np.sqrt((n * n).sum()))
            out[k, HASHED] = len(np.unique(own)) / len(own)
        size = max(1, len(raw))
        upper, alpha = ((raw >= 65) & (raw <= 90)).sum(), ((raw >= 97) & (raw <= 122)).sum()
        out[k, HASHED + 1 :] = upper / size, alpha / size, SPACE[raw].sum() / size, ((raw > 32) & (raw < 48)).sum() / size, np.log1p(len(own)) / 10
    return out


def meta_view(langs: list, sources: list, sizes: list) -> np.ndarray:
    out = np.zeros((len(langs), META_WIDTH), np.float32)
    for k, (lang, source, size) in enumerate(zip(langs, sources, sizes, strict=True)):
        out[k, crc32(f"l:{lang}".encode()) % META_HASHED] = 1
        out[k, META_HASHED + crc32(f"s:{source}".encode()) % META_HASHED] = 1
        n = np.log1p(max(0.0, float(size or 0))) / 10
        out[k, -3:] = n, n * n, size is None
    return out


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 200) -> tuple[np.ndarray, float]:
    """Logistic regression with balanced labels, by gradient steps with momentum."""
    w, b, vw, vb = np.zeros(x.shape[1]), 0.0, 0.0, 0.0
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for _ in range(steps):
        d = weight * (sigmoid(x @ w + b) - y)
        vw, vb = 0.9 * vw - 0.5 * (x.T @ d + l2 * w), 0.9 * vb - 0.5 * d.sum()
        w, b = w + vw, b + vb
    return w, b


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def platt(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift that turn log-odds into calibrated ones, by Newton's method with Platt's smoothed targets; the
    slope isn't negative. Without labels of both kinds nothing is changed."""
    good, bad = (y == 1).sum(), (y == 0).sum()
    if not good or not bad:
        return 1.0, 0.0
    aim = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    scale = max(1e-9, float(np.abs(z).max()))
    x, w = np.stack([z / scale, np.ones_like(z)], 1), np.zeros(2)
    loss = lambda w: float(np.sum(np.logaddexp(0, x @ w) - aim * (x @ w)) + 5e-4 * w @ w)
    for _ in range(steps):
        p = sigmoid(x @ w)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), x.T @ (p - aim) + 1e-3 * w)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
    return max(0.0, float(w[0]) / scale), float(w[1])


def _views(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    langs, sources, sizes = (batch.column(x).to_pylist() for x in ("lang", "source", "n_chars"))
    for c in chunks(batch.column("text"), 1 << 19):
        at = slice(c.first, c.first + c.rows)
        yield text_view(c), meta_view(langs[at], sources[at], sizes[at])


class CoModel:
    """Weights, calibrations and the combination of both views; ``cut`` divides kept from not."""

    def __init__(self, text, meta):
        self.text, self.meta = text, meta
        self.calibration = [(1.0, 0.0), (1.0, 0.0)]
        self.joint, self.cut = (np.array([1.0, 1.0]), 0.0), 0.0

    def raw(self, t: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return t @ self.text[0] + self.text[1], m @ self.meta[0] + self.meta[1]

    def calibrated(self, t: np.ndarray, m: np.ndarray) -> np.ndarray:
        return np.stack([np.clip(a * z + b, -9, 9) for z, (a, b) in zip(self.raw(t, m), self.calibration, strict=True)], 1)

    def scores(self, t: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = self.calibrated(t, m)
        return sigmoid(z[:, 0]), sigmoid(z[:, 1]), sigmoid(z @ self.joint[0] + self.joint[1])


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))


def _collected(d: DataFrame, chosen: DataFrame) -> list:
    """The chosen documents' views, at most as many as the bounds on ``chosen`` allow, in an order of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views = list(_views(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r.astype(np.float16).tobytes() for v in views for r in v[k]], pa.binary()) for k in (0, 1))], names=["doc_id", "t", "m"])

    rows = d.join(F.broadcast(chosen.select("doc_id")), "doc_id").select(*INPUT).mapInArrow(run, "doc_id long, t binary, m binary").collect()
    own = {r.doc_id: r for r in sorted(rows, key=lambda r: (bytes(r.t), bytes(r.m)))}  # of repeated ids one row, the same each time
    return sorted(own.values(), key=lambda r: (crc32(str(r.doc_id).encode()), r.doc_id))


def _matrix(rows: list) -> tuple[np.ndarray, np.ndarray]:
    t, m = (np.array([np.frombuffer(r[k], np.float16) for r in rows], np.float32).reshape(len(rows), n) for k, n in (("t", TEXT_WIDTH), ("m", META_WIDTH)))
    return t, m


def sure(docs: DataFrame, labelled: DataFrame, model: CoModel, turn: int) -> DataFrame:
    """What each view is sure of among all of ``docs`` but those ``labelled(doc_id)``: ``(doc_id, view, y)``, at most
    ``HANDED`` a view and label. All are scored where they lie; labelled ones go by their scores' rows, so that no text moves.

    A view is sure of the documents beyond ``CONFIDENT`` that are among the ``SURE`` highest or lowest of their language
    and source; of these the first by a seeded hash are taken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.raw(*v) for v in _views(batch)]
            z = [pa.array(np.concatenate([p[k] for p in parts]).astype(np.float64) if parts else np.zeros(0)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), batch.column("source"), *z], names=["doc_id", "lang", "source", "t", "m"])

    scored = docs.select(*INPUT).mapInArrow(run, "doc_id long, lang string, source string, t double, m double")
    scored = table(scored.join(labelled.select("doc_id"), "doc_id", "left_anti"), "scored")
    ends = scored.groupBy("lang", "source").agg(*(F.percentile_approx(x, [SURE, 1 - SURE], 1000).alias(f"end_{x}") for x in "tm"))
    ends = ends.select(F.col("lang").alias("l"), F.col("source").alias("s"), "end_t", "end_m")
    both = table(scored.join(ends, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))), "ends")
    parts = []
    for x in "tm":
        for y, beyond in ((0, (F.col(x) < -CONFIDENT) & (F.col(x) <= F.col(f"end_{x}")[0])), (1, (F.col(x) > CONFIDENT) & (F.col(x) >= F.col(f"end_{x}")[1]))):
            own = both.where(beyond).select("doc_id").distinct()
            parts.append(own.orderBy(F.xxhash64("doc_id", F.lit(turn)), "doc_id").limit(HANDED).select("doc_id", F.lit(x).alias("view"), F.lit(y).alias("y")))
    chosen = table(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]), "handed")
    drop(scored, both)
    return chosen


def train(docs: DataFrame, labels: DataFrame) -> CoModel:
    d = _input(docs).where("doc_id is not null")
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("y in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    few = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    label = {r.doc_id: r.y for r in few.collect()}
    rows = _collected(d, few)
    t, m = _matrix(rows)
    y = np.array([label[r.doc_id] for r in rows], np.int64)
    held = np.arange(len(rows)) % 4 == 3
    learnt = [(t[~held], y[~held]), (m[~held], y[~held])]  # of the text view, of the metadata view
    model = CoModel(fit(*learnt[0]), fit(*learnt[1]))
    taken: set[int] = set()
    for turn in range(ROUNDS if len(set(y[~held])) > 1 else 0):
        handed = sure(d, own, model, turn)
        given = [r for r in handed.orderBy("view", "y", "doc_id").collect() if r.doc_id not in taken]
        if not given:
            break
        fresh = _collected(d, handed.select("doc_id").distinct())
        views = {r.doc_id: k for k, r in enumerate(fresh)}
        both = _matrix(fresh)
        for k, view in ((0, "m"), (1, "t")):  # a view learns from what the other is sure of
            mine = [(views[r.doc_id], r.y) for r in given if r.view == view]
            if mine:
                at, labels_ = (np.array(x) for x in zip(*mine, strict=True))
                learnt[k] = np.concatenate([learnt[k][0], both[k][at]]), np.concatenate([learnt[k][1], labels_])
        taken |= {r.doc_id for r in given}
        model = CoModel(fit(*learnt[0]), fit(*learnt[1]))
    if held.any():
        model.calibration = [platt(z, y[held]) for z in model.raw(t[held], m[held])]
        if 0 < y[held].sum() < held.sum():
            model.joint = fit(model.calibrated(t[held], m[held]), y[held], 1e-4, 400)
        good = model.scores(t[held], m[held])[2][y[held] == 1]
        model.cut = min(0.5, float(np.quantile(good, LOST))) if len(good) else 0.0
    return model


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text, lang, source, n_chars)``: both views' calibrated scores, the combined one, kept.

    Nulls are values of their own in each column; null texts count as empty. Repeated rows score alike. Without labels
    of both kinds all scores come from what was learnt, at worst 0.5, and all documents are kept. An empty table gives
    no rows. Other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            parts = [model.scores(*v) for v in _views(batch)]
            a, b, s = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in range(3))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x.astype(np.float64)) for x in (a, b, s)), pa.array(s >= model.cut)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return _input(docs).mapInArrow(run, SCHEMA)


def op6_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents; ``labels.quality`` teaches."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
