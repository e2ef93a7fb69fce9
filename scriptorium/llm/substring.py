"""Substring deduplication: repeated passages found behind a count-min sketch.

1. A window is ``WINDOW`` consecutive words. Its anchor is the least hash of the ``GRAM``-word runs in it, so that equal
   windows have equal anchors, and neighbouring windows mostly share one: an anchor stands for about 13 windows.
2. Each partition counts its anchors in a sketch of ``ROWS`` rows of cells; the pieces of the partitions' sketches meet by
   segment of the cells and are added. A window's estimate is the least count of its anchor's cells: never less than the
   number of the window's occurrences. A segment keeps one bit a cell: whether it has counted two or more.
3. A second pass sends on only the windows whose estimate is two or more, as 128-bit hashes, and groups them exactly: the
   least document of each. A window that the sketch estimates too high costs a row and changes nothing.
4. Each document loses the words of its windows that begin in a document of smaller id as well.

The sketch has about eight cells an anchor, so it grows with the input, up to ``MOST_CELLS`` a row; beyond that estimates
are higher and more windows are grouped, with the same result. Tasks map the segments from the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop, drop_folder, folder, get_array, put_arrays, table
from .words import Chunk, chunks, mix, words

WINDOW = 50
GRAM = 25
ROWS = 2
#: Cells of a row to a byte of text: an anchor stands for about 80 bytes.
CELLS_A_BYTE = 1 / 8
LEAST_CELLS, MOST_CELLS = 1 << 16, 1 << 34
#: A row's segments, at most.
SEGMENTS = 256
#: Anchors that a task counts before it sends them on.
AT_ONCE = 1 << 20
_BASES = 0x9E3779B97F4A7C55, 0xC2B2AE3D27D4EB4F
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _powers or len(_powers[base][0]) < n:
        both = []
        for b in (base, pow(base, -1, 2**64)):
            full = np.full(max(n, 1 << 18), np.uint64(b))
            full[0] = 1
            both.append(np.multiply.accumulate(full))
        _powers[base] = tuple(both)
    return _powers[base]


def runs(hashes: np.ndarray, size: int, salt: int) -> np.ndarray:
    """Hashes of every run of ``size`` words, by sums of powers."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _power_tables(_BASES[salt], len(hashes))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down[:n], size + salt)


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` consecutive values, by doubling."""
    have = 1
    while have < size:
        step = min(have, size - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


class Windows:
    """A chunk's windows: first words ``start``, texts ``row``, and runs of windows of one anchor, ``anchor`` and ``length``."""

    def __init__(self, c: Chunk):
        w = words(c, lower=False)
        self.hashes, self.bounds = w.hashes, w.bounds
        counts = np.diff(w.bounds)
        row = np.repeat(np.arange(c.rows), counts)
        n = max(0, len(self.hashes) - WINDOW + 1)
        self.start = np.flatnonzero(np.arange(n) + WINDOW <= w.bounds[1:][row[:n]])
        self.row = row[self.start]
        of = _least(runs(self.hashes, GRAM, 0), WINDOW - GRAM + 1)[self.start] if n else np.zeros(0, np.uint64)
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (self.row[1:] != self.row[:-1])
        at = np.flatnonzero(new)
        self.anchor, self.length = of[at], np.diff(np.append(at, len(of)))


class Shape:
    """Which cells an anchor has: of each of ``ROWS`` rows one of ``cells`` cells, in ``segments`` segments a row."""

    def __init__(self, n_bytes: int):
        cells = min(MOST_CELLS, max(LEAST_CELLS, int(n_bytes * CELLS_A_BYTE)))
        self.bits = (cells - 1).bit_length()
        self.segments = min(SEGMENTS, max(1, (1 << self.bits) // LEAST_CELLS))
        self.inner = self.bits - (self.segments - 1).bit_length()

    def cells(self, anchors: np.ndarray, row: int) -> np.ndarray:
        return mix(anchors, 11 + row) >> np.uint64(64 - self.bits)


def _pieces(shape: Shape):
    """A task's sketch by segment: a cell counted once is named once, one counted more often twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            anchors, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            segments, pieces = [], []
            for r in range(ROWS):
                cells = np.sort(np.repeat(shape.cells(anchors, r), np.minimum(n, 2)))
                keep = np.ones(len(cells), bool)
                keep[2:] = cells[2:] != cells[:-2]
                cells = cells[keep]
                limits = np.searchsorted(cells >> np.uint64(shape.inner), np.arange(shape.segments + 1))
                for s in np.flatnonzero(limits[1:] > limits[:-1]).tolist():
                    segments.append(r * shape.segments + s)
                    pieces.append((cells[limits[s] : limits[s + 1]] & np.uint64((1 << shape.inner) - 1)).astype(np.uint32).tobytes())
            return pa.RecordBatch.from_arrays([pa.array(segments, pa.int32()), pa.array(pieces, pa.binary())], names=["segment", "cells"])

        for batch in batches:
            for c in chunks(batch.column("text")):
                held.append(Windows(c).anchor)
                if sum(map(len, held)) >= AT_ONCE:
                    yield flush()
        if sum(map(len, held)):
            yield flush()

    return run


def _merged(shape: Shape, place: str):
    """Adds the pieces of each segment, which come one segment after the other, and writes a bit a cell: counted twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts = None, None

        def put() -> pa.RecordBatch:
            put_arrays(f"{place}/{now}", twice=np.packbits(counts > 1))
            return pa.RecordBatch.from_pydict({"segment": pa.array([now], pa.int32())})

        for batch in batches:
            for s, cells in zip(batch.column("segment").to_pylist(), batch.column("cells"), strict=True):
                if s != now:
                    if now is not None:
                        yield put()
                    now, counts = s, np.zeros(1 << shape.inner, np.uint8)
                own = np.frombuffer(cells.as_buffer(), np.uint32)
                again = own[1:][own[1:] == own[:-1]]
                once = own[np.append(True, own[1:] != own[:-1])] if len(own) else own
                counts[once] = np.minimum(counts[once] + 1, 2)
                counts[again] = 2
        if now is not None:
            yield put()

    return run


class Sketch:
    """The merged sketch; segments are opened as they are asked for."""

    def __init__(self, place: str, shape: Shape):
        self.place, self.shape, self.open = place, shape, {}

    def repeated(self, anchors: np.ndarray) -> np.ndarray:
        """Whether each anchor's estimate is two or more."""
        out = np.ones(len(anchors), bool)
        for r in range(ROWS):
            left = np.flatnonzero(out)
            cells = self.shape.cells(anchors[left], r)
            segment = (cells >> np.uint64(self.shape.inner)).astype(np.int64)
            inner = (cells & np.uint64((1 << self.shape.inner) - 1)).astype(np.int64)
            order = np.argsort(segment, kind="stable")
            limits = np.searchsorted(segment[order], np.arange(self.shape.segments + 1))
            for s in np.flatnonzero(limits[1:] > limits[:-1]).tolist():
                at, key = order[limits[s] : limits[s + 1]], r * self.shape.segments + s
                if key not in self.open:
                    self.open[key] = get_array(f"{self.place}/{key}", "twice")
                out[left[at]] = (self.open[key][inner[at] >> 3] >> (7 - (inner[at] & 7))) & 1
        return out


def _estimated(shape: Shape, place: str):
    """The windows estimated repeated: ``(h1, h2, doc_id, text_hash, pos)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(place, shape)
        for batch in batches:
            for c in chunks(batch.column("text")):
                w = Windows(c)
                hot = np.repeat(sketch.repeated(w.anchor), w.length)
                start, row = w.start[hot], w.row[hot]
                if len(start):
                    own = [runs(w.hashes, WINDOW, salt)[start].view(np.int64) for salt in (0, 1)]
                    at = pa.array(row + c.first)
                    pos = (start - w.bounds[row]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*map(pa.array, own), batch.column("doc_id").take(at), batch.column("text_hash").take(at), pa.array(pos)], names=["h1", "h2", "doc_id", "text_hash", "pos"])

    return run


def repeated_windows(docs: DataFrame) -> DataFrame:
    """Per (id, text) with words to remove: ``(doc_id, text_hash, at)``, ``at`` the sorted first words of its windows that
    begin in a document of smaller id as well. A table in the shared folder."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    shape = Shape(d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    place = f"{folder(spark)}/sketch-{uuid.uuid4().hex}"
    pieces = d.select("text").mapInArrow(_pieces(shape), "segment int, cells binary")
    merged = pieces.repartition(ROWS * shape.segments, "segment").sortWithinPartitions("segment").mapInArrow(_merged(shape, place), "segment int")
    merged.agg(F.count("segment")).first()
    hashed = d.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    found = table(hashed.mapInArrow(_estimated(shape, place), "h1 long, h2 long, doc_id long, text_hash long, pos int"), "windows")
    drop_folder(spark, place)
    least = found.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("greatest"))
    least = table(least.where("least < greatest").drop("greatest"), "least")
    later = found.join(least, ["h1", "h2"]).where("doc_id > least")
    out = table(later.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("at")), "repeats")
    drop(found, least)
    return out


def covered(at: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that begins at one of ``at``."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + WINDOW, -1)
    return np.cumsum(steps[:n]) > 0


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            n_words, n_removed, kept = [], [], []
            for text, at in zip(part.column("text"), part.column("at"), strict=True):
                own = text.as_buffer().to_pybytes().split() if text.is_valid else []
                gone = covered(at.values.to_numpy(), len(own)) if at.is_valid else None
                n_words.append(len(own))
                n_removed.append(0 if gone is None else int(gone.sum()))
                kept.append(b" ".join(own if gone is None else compress(own, ~gone)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id``, ``n_words``, ``n_removed`` and ``kept``, its other words joined
    by single spaces.

    Of a window that several documents hold the one of least id keeps it; a window repeated within one document stays.
    Rows of one id never take from each other, whatever their texts. A row without id loses nothing and takes nothing. Null
    and empty texts have no words, texts of fewer than ``WINDOW`` words no window; texts are never cut. Other columns
    aren't read. An empty table gives no rows.
    """
    found = repeated_windows(docs)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    both = d.join(found, ["doc_id", "text_hash"], "left").select("doc_id", "text", "at")
    return both.mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept string")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``: ``doc_id``, ``n_words``, ``n_removed``, and ``kept_sha256`` of the words kept."""
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) AS p FROM d),
wins AS (SELECT doc_id, p, array_to_string(list_slice(w, p, p + 49), ' ') AS s FROM starts),
firsts AS (SELECT s, min(doc_id) AS least FROM wins GROUP BY s HAVING min(doc_id) < max(doc_id)),
marks AS (SELECT DISTINCT wins.doc_id, p FROM wins JOIN firsts ON wins.s = firsts.s WHERE wins.doc_id > least),
each AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
judged AS (SELECT each.doc_id, i, word, count(p) OVER (PARTITION BY each.doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) > 0 AS gone
           FROM each LEFT JOIN marks ON each.doc_id = marks.doc_id AND i = p),
sums AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM judged GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN sums ON d.doc_id = sums.doc_id
"""
