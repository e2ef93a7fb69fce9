"""Toxicity by a convolutional text classifier: hashed word embeddings, several filter widths, max pooling.

Trained in numpy on the driver, on a bounded sample of labelled rows (``MAX_TRAIN``); every text is then scored whole
where it lies. The score depends on the text alone. Thresholds by language are calibrated beside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import crc_mod
from .words import Chunk, chunks, plain_bytes, words

#: Labelled rows that the model is fitted on, at most; the bound keeps the driver's memory and time fixed.
MAX_TRAIN = 8000
BUCKETS = 1 << 15
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 12
EPOCHS = 8
CUT = 0.3
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, lang string, lang_threshold double, lang_flag boolean"


def bucket_ids(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the texts' words (ASCII case and punctuation aside) and the texts' limits."""
    w = words(Chunk(c.first, plain_bytes(c.data), c.offsets), lower=False)
    return (w.hashes % np.uint64(BUCKETS)).astype(np.int32), w.bounds


def _padded(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text followed by as many empty words as the widest filter has, so that even an empty text has a window of its own."""
    pad = max(WIDTHS)
    n = np.diff(bounds)
    starts = bounds[:-1] + pad * np.arange(len(n))
    out = np.full(int(bounds[-1]) + pad * len(n), BUCKETS, np.int32)
    out[np.arange(len(ids)) + np.repeat(pad * np.arange(len(n)), n)] = ids
    return out, starts


class Model:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.e = rng.normal(0, 0.05, (BUCKETS + 1, DIM)).astype(np.float32)
        self.e[BUCKETS] = 0
        self.w = {k: rng.normal(0, 0.3, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS}
        self.b = {k: np.zeros(FILTERS, np.float32) for k in WIDTHS}
        self.v = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
        self.c = np.float32(-2.0)
        self.scale, self.shift = 1.0, 0.0

    def _pool(self, ids: np.ndarray, starts: np.ndarray, at: bool = False):
        x, n = self.e[ids], len(ids)
        pooled, where = [], []
        for k in WIDTHS:
            m = n - k + 1
            z = sum(x[j : j + m] @ self.w[k][j] for j in range(k))
            for j in range(1, k):  # windows that begin in the padding and reach the next text belong to none
                z[starts[1:] - j] = -np.inf
            most = np.maximum.reduceat(z, starts, axis=0)
            pooled.append(most + self.b[k])
            if at:
                hit = z == np.repeat(most, np.diff(np.append(starts, m)), axis=0)
                where.append(np.stack([np.maximum.reduceat(np.where(hit[:, f], np.arange(m), -1), starts) for f in range(FILTERS)], 1))
        return np.concatenate(pooled, 1), where

    def fit(self, texts: list[np.ndarray], y: np.ndarray, seed: int = 7) -> None:
        """Half of the rows give the first embedding column, by how far a word's share of label 1 is from chance; Adam
        fits everything on the other half."""
        half = np.arange(len(texts)) % 2 == 0
        seen, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for ids, label in zip((t for t, h in zip(texts, half, strict=True) if h), y[half], strict=True):
            u = np.unique(ids)
            seen[u] += 1
            toxic[u] += label
        p = float(np.clip(y[half].mean() if half.any() else 0.1, 0.01, 0.99))
        self.e[:BUCKETS, 0] = np.clip((toxic - seen * p) / np.sqrt(seen * p * (1 - p) + 1), -3, 8) / 2
        self.w[1][0, 0] += 0.5
        self.v[:FILTERS] += 0.1
        own = np.flatnonzero(~half)
        if not len(own):
            return
        rng = np.random.default_rng(seed)
        params = [self.e, *self.w.values(), *self.b.values(), self.v]
        first, second = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
        step = 0
        for _ in range(EPOCHS):
            rng.shuffle(own)
            for a in range(0, len(own), 32):
                rows = own[a : a + 32]
                ids, starts = _padded(np.concatenate([texts[r] for r in rows]), np.cumsum([0, *(len(texts[r]) for r in rows)]))
                pooled, where = self._pool(ids, starts, at=True)
                act = np.maximum(pooled, 0)
                out = 1 / (1 + np.exp(-(act @ self.v + self.c)))
                d = ((out - y[rows]) / len(rows)).astype(np.float32)
                dact = np.outer(d, self.v) * (pooled > 0)
                ge = np.zeros_like(self.e)
                gw, gb = {}, {}
                for i, k in enumerate(WIDTHS):
                    g, spot = dact[:, i * FILTERS : (i + 1) * FILTERS], where[i]
                    gb[k], gw[k] = g.sum(0), np.zeros_like(self.w[k])
                    for j in range(k):
                        word = ids[spot + j]
                        gw[k][j] = np.einsum("rfd,rf->df", self.e[word], g)
                        np.add.at(ge, word, g[:, :, None] * self.w[k][j].T[None])
                ge[BUCKETS] = 0
                grads = [ge, *gw.values(), *gb.values(), act.T @ d + 1e-4 * self.v]
                step += 1
                self.c -= np.float32(0.02 * d.sum())
                for x, g, m, s in zip(params, grads, first, second, strict=True):
                    m *= 0.9
                    m += 0.1 * g
                    s *= 0.99
                    s += 0.01 * g * g
                    x -= (0.005 / (1 - 0.9**step)) * m / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)

    def logits(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if len(bounds) < 2:
            return np.zeros(0)
        pooled, _ = self._pool(*_padded(ids, bounds))
        return np.maximum(pooled, 0) @ self.v + self.c

    def scores(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Rounded, so that sums taken in another order beside other texts leave no trace."""
        return np.round(1 / (1 + np.exp(-np.clip(self.scale * self.logits(ids, bounds) + self.shift, -30, 30).astype(np.float64))), 6)


def best_cut(scores: np.ndarray, y: np.ndarray) -> float | None:
    """The score that as a threshold gives the highest F1, midway to the next lower one; None without both labels."""
    if not 0 < y.sum() < len(y):
        return None
    at = np.argsort(-scores, kind="stable")
    hit = np.cumsum(y[at])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][scores[at][:-1] == scores[at][1:]] = 0
    k = int(np.argmax(f1))
    return float((scores[at][k] + (scores[at][k + 1] if k + 1 < len(y) else 0)) / 2)


def train(docs: DataFrame, labels: DataFrame) -> tuple[Model, dict[str, float]]:
    """The model and the languages' thresholds, from labelled rows whose crc32(doc_id) mod 4 is not 2.

    At most ``MAX_TRAIN`` of them are taken, by hash of the id. A fifth calibrates: the shift puts the best F1 at ``CUT``,
    and each language with 20 rows of either label gets its own threshold.
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where((crc_mod("doc_id", 4) != 2) & F.col("toxic").isin(0, 1))
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").join(F.broadcast(chosen), "doc_id")

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for c in chunks(batch.column("text")):
                b, limits = bucket_ids(c)
                ids += [b[limits[k] : limits[k + 1]].tobytes() for k in range(c.rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), batch.column("lang"), pa.array(ids, pa.binary())], names=["doc_id", "toxic", "lang", "ids"])

    rows = sorted(d.mapInArrow(ids_of, "doc_id long, toxic int, lang string, ids binary").collect(), key=lambda r: (r.doc_id * 2654435761 % 2**32, bytes(r.ids)))
    texts, y = [np.frombuffer(r.ids, np.int32) for r in rows], np.array([r.toxic for r in rows], np.float64)
    langs = np.array([r.lang or "" for r in rows], dtype=object)
    hold = np.arange(len(rows)) % 5 == 4
    model = Model()
    if not len(rows):
        return model, {}
    model.fit([t for t, h in zip(texts, hold, strict=True) if not h], y[~hold])
    own = [t for t, h in zip(texts, hold, strict=True) if h]
    if not own:
        return model, {}
    logit = lambda p: float(np.log(p / (1 - p)))
    ids, bounds = np.concatenate(own), np.cumsum([0, *map(len, own)])
    cut = best_cut(model.scores(ids, bounds), y[hold])
    if cut is not None:
        model.shift = logit(CUT) - logit(min(max(cut, 1e-6), 1 - 1e-6))
    scores, cuts = model.scores(ids, bounds), {}
    for lang in set(langs[hold]):
        mine = langs[hold] == lang
        if min(y[hold][mine].sum(), (1 - y[hold][mine]).sum()) >= 20:
            cuts[lang] = best_cut(scores[mine], y[hold][mine])
    return model, cuts


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text, lang)``: held_out, score, predicted, and the language's threshold and flag.

    Null and empty texts get the score of no words. Repeated rows score alike. Without usable labels, scores come from
    the untrained model. An empty table gives no rows. Other columns aren't read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cuts = shared.value
        for batch in batches:
            parts = [model.scores(*bucket_ids(c)) for c in chunks(batch.column("text"), 1 << 18)]
            s = np.concatenate(parts) if parts else np.zeros(0)
            lang = batch.column("lang")
            limit = np.array([cuts.get(x or "", CUT) for x in lang.to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= CUT).astype(np.int32)), lang, pa.array(limit), pa.array(s >= limit)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").withColumn("held_out", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)))
    return d.mapInArrow(run, SCHEMA)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("lang")
