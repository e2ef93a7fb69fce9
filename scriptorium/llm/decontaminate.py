"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are compared in a plain form: ASCII letters in lower case, every run of other ASCII
characters as one space. An item is cut into windows of ``WINDOW`` bytes, one every ``Q`` bytes, and of ``WORDS`` words
(more, up to ``MIN_ITEM`` bytes), one from every word. So each exact passage of ``WORDS`` words and ``MIN_ITEM`` bytes,
and each of ``WINDOW + Q - 1`` bytes, holds a window; items of fewer words are windows themselves. Items of ``Q`` to
``MIN_ITEM - 1`` bytes must occur as they are, as whole words; shorter ones must be the whole text. If a text region lies within k
edits of a window of m bytes, they share at least ``m + 1 - (k + 1) * q`` q-grams whose diagonals (text position less
window position) span at most k. So shared q-grams are counted in overlapping bands of diagonals, bands below that
bound are dropped, and the rest are decided by a banded alignment. The filter loses no region within the budget.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import folder, get_array, put_arrays
from .words import BYTE_HASHES, Chunk, chunks, mix, plain_bytes, power_tables

Q = 12
WINDOW = 96
#: Words of the shortest passage that is sure to be found.
WORDS = 13
#: Edits allowed per byte of a window.
EDIT_SHARE = 0.05
#: Items shorter than this in plain form are only matched exactly.
MIN_ITEM = 32
#: Bytes of benchmark text whose index a task holds at a time; larger benchmarks take their blocks in turn.
BLOCK = 4_000_000
#: Bytes of documents that a task gathers before it turns to the next block of a benchmark of several.
GATHERED = 64_000_000
#: Windows looked up at once: a q-gram of many windows is dealt with in parts.
EXPANDED = 2_000_000
#: Bytes of text searched at once: each q-gram found in it goes to some twenty windows.
CHUNK = 1 << 18
SCHEMA = "doc_id long, item_ids array<long>, edits array<int>, starts array<long>, ends array<long>"


def plain(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The plain form of bytes, and the place in ``raw`` of each of its bytes. A zero byte stays: it parts texts."""
    shown = plain_bytes(raw)
    shown[raw == 0] = 0
    keep = shown != 32
    keep[1:] |= shown[:-1] != 32
    at = np.flatnonzero(keep)
    return shown[at], at


def _grams(body: np.ndarray, q: int) -> np.ndarray:
    n = len(body) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = power_tables(len(body) + 1)
    sums = np.zeros(len(body) + 1, np.uint64)
    np.cumsum(BYTE_HASHES[body] * up[: len(body)], out=sums[1:])
    return mix((sums[q:] - sums[:n]) * down[:n], 5)


def banded_edits(pattern: bytes, text: bytes, low: int, high: int, budget: int) -> tuple[int, int] | None:
    """Least edits that turn ``pattern`` into a stretch of ``text``, on diagonals low..high only, and where it ends.

    None if more than ``budget``. A diagonal is a text position less a pattern position; the stretch may begin anywhere.
    """
    far = budget + 1
    width = high - low + 1
    row = [0 if 0 <= low + b <= len(text) else far for b in range(width)]
    for i, c in enumerate(pattern, 1):
        new, left = [far] * width, far
        for b in range(width):
            j = low + b + i
            if 0 <= j <= len(text):
                best = left + 1
                if b + 1 < width and row[b + 1] + 1 < best:
                    best = row[b + 1] + 1
                if j > 0:
                    diagonal = row[b] + (text[j - 1] != c)
                    if diagonal < best:
                        best = diagonal
                new[b] = left = min(best, far)
            else:
                left = far
        row = new
        if min(row) > budget:
            return None
    best = min(row)
    return (best, low + row.index(best) + len(pattern)) if best <= budget else None


def _word_windows(body: bytes, words: int) -> list[tuple[int, int]]:
    """First and end byte of every run of ``words`` words, longer ones where they have fewer than MIN_ITEM bytes.

    Runs that are sure to hold a window of WINDOW bytes are left out.
    """
    gaps = [-1, *np.flatnonzero(np.frombuffer(body, np.uint8) == 32).tolist(), len(body)]
    out, j = [], 0
    for i in range(len(gaps) - words):
        start, j = gaps[i] + 1, max(j, i + words)
        while j < len(gaps) - 1 and gaps[j] - start < MIN_ITEM:
            j += 1
        if MIN_ITEM <= gaps[j] - start < WINDOW + Q - 1:
            out.append((start, gaps[j]))
    return out


#: What may stand beside a short item in the plain form: a space, a text's limit, nothing.
_EDGE = (b" ", b"\0", b"")


class Index:
    """The windows of benchmark items and the items' q-grams; a q-gram's windows are looked up when a text holds it."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, window: int = WINDOW, share: float = EDIT_SHARE):
        self.q, bodies, base = q, [], 0
        self.tiny: dict[bytes, list[int]] = {}  # items without a q-gram, by their plain form
        codes, place = [], []
        kinds: tuple[list, list] = ([], [])  # windows of bytes, of words: (item, first, end), both ascending
        for item, text in items:
            body = plain(np.frombuffer((text or "").encode(), np.uint8))[0].tobytes().strip(b" ")
            if len(body) < q:
                if body:
                    self.tiny.setdefault(body, []).append(item)
                continue
            starts = [*range(0, max(1, len(body) - window + 1), q)]
            if starts[-1] + window < len(body):
                starts.append(len(body) - window)
            kinds[0].extend((item, base + s, base + min(s + window, len(body))) for s in starts)
            kinds[1].extend((item, base + s, base + e) for s, e in _word_windows(body, WORDS))
            own = _grams(np.frombuffer(body, np.uint8), q)
            codes.append(own)
            place.append(base + np.arange(len(own)))
            bodies.append(body)
            base += len(body) + 1
        self.body = b" ".join(bodies)
        rows = np.array([r for kind in kinds for r in kind], np.int64).reshape(-1, 3)
        self.item, self.first, self.end = rows.T.copy()
        self.kinds = (0, len(kinds[0]), len(rows))
        length = self.end - self.first
        # the lemma must demand a q-gram at least
        self.budgets = np.where(length < MIN_ITEM, 0, np.minimum((length * share).astype(np.int64), length // q - 1))
        self.bounds = length + 1 - (self.budgets + 1) * q
        codes = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        order = np.argsort(codes, kind="stable")
        self.place = (np.concatenate(place) if place else np.zeros(0, np.int64))[order]
        self.codes, first = np.unique(codes[order], return_index=True)
        self.limits = np.append(first, len(codes))
        self.bits = max(16, int(np.ceil(np.log2(len(self.codes) * 32 + 1))))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[(self.codes >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def _windows(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of q-grams at these places, every window that holds one, and which q-gram it is."""
        pattern, which = [], []
        for a, b in zip(self.kinds, self.kinds[1:]):
            low = np.searchsorted(self.end[a:b] - self.q, place, "left")
            n = np.searchsorted(self.first[a:b], place, "right") - low
            pattern.append(a + np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()))
            which.append(np.repeat(np.arange(len(place)), n))
        return np.concatenate(pattern), np.concatenate(which)

    def _parts(self, slot: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of hits that lead to about EXPANDED places of q-grams at most."""
        total = np.concatenate([[0], np.cumsum(self.limits[slot + 1] - self.limits[slot])])
        a = 0
        while a < len(slot):
            b = max(a + 1, int(np.searchsorted(total, total[a] + EXPANDED // 20, "right")) - 1)
            yield a, b
            a = b

    def _bands(self, near: np.ndarray, slot: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Shared q-grams by window and band of diagonals: keys and counts, of the hits ``slot`` at ``near`` in a text of ``size`` bytes."""
        n = self.limits[slot + 1] - self.limits[slot]
        entry = np.repeat(self.limits[slot] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        place = self.place[entry]
        pattern, which = self._windows(place)
        diagonal = np.repeat(near, n)[which] - (place[which] - self.first[pattern])
        band = (diagonal + size) // (self.budgets[pattern] + 1)  # shifted, so that none is negative
        band_of = np.concatenate([band, band - 1])  # a band spans two steps, so k + 1 diagonals lie in one
        return np.unique(np.concatenate([pattern, pattern]) * np.int64(1 << 40) + band_of, return_counts=True)

    def search(self, c: Chunk) -> list[list[tuple[int, int, int, int]]]:
        """For each text of a chunk the items found: (item, edits, first byte, end byte), an item once."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in range(c.rows)]
        if not len(c.data):
            return out
        if self.tiny:
            for row in range(c.rows):
                if c.offsets[row + 1] - c.offsets[row] < 64 * self.q:
                    text = c.text(row)
                    for item in self.tiny.get(plain(np.maximum(np.frombuffer(text, np.uint8), 1))[0].tobytes().strip(b" "), ()):
                        out[row].append((item, 0, 0, len(text)))
        if not len(self.codes):
            return out
        cuts = c.offsets[1:-1]
        raw = np.insert(np.maximum(c.data, 1), cuts, 0)  # zero bytes of the texts themselves become other white space
        body, at = plain(raw)
        grams = _grams(body, self.q)
        near = np.flatnonzero(self.seen[(grams >> np.uint64(64 - self.bits)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.codes, grams[near]), len(self.codes) - 1)
        hit = self.codes[slot] == grams[near]
        near, slot = near[hit], slot[hit]
        if not len(near):
            return out
        parts = [self._bands(near[a:b], slot[a:b], len(body)) for a, b in self._parts(slot)]
        keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        key, inverse = np.unique(keys, return_inverse=True)
        count = np.bincount(inverse, counts, len(key)).astype(np.int64)
        pattern, band = key >> 40, key & ((1 << 40) - 1)
        full = count >= self.bounds[pattern]
        rows_at = np.flatnonzero(body == 0)
        whole = body.tobytes()
        found: set[tuple[int, int]] = set()
        for p, b in zip(pattern[full].tolist(), band[full].tolist(), strict=True):
            k, text, item = int(self.budgets[p]), self.body[self.first[p] : self.end[p]], int(self.item[p])
            low = b * (k + 1) - len(body)
            high = low + 2 * (k + 1) - 1
            middle = min(max(0, low + len(text) // 2), len(body) - 1)
            row = int(np.searchsorted(rows_at, middle, "right"))
            if (row, item) in found:
                continue
            start = max(0, low - k, int(rows_at[row - 1]) + 1 if row else 0)
            end = min(len(body), high + k + len(text), int(rows_at[row]) if row < len(rows_at) else len(body))
            region = whole[start:end]
            exact = region.find(text)
            while len(text) < MIN_ITEM and exact >= 0 and not (whole[start + exact - 1 : start + exact] in _EDGE and whole[start + exact + len(text) : start + exact + len(text) + 1] in _EDGE):
                exact = region.find(text, exact + 1)
            got = (0, exact + len(text)) if exact >= 0 else None if len(text) < MIN_ITEM else banded_edits(text, region, low - k - start, high + k - start, k)
            if got is None:
                continue
            edits, stop = got
            stop += start
            begin = max(start, stop - len(text))
            # places in the text: less the zero bytes put between texts and the bytes of earlier texts
            base = int(c.offsets[row]) + row
            found.add((row, item))
            out[row].append((item, edits, int(at[begin]) - base, int(at[stop - 1]) + 1 - base))
        return out


def _searched(docs: DataFrame, benchmark: DataFrame):
    """A function from batches with a text to (batch, per row the items found), all blocks of the benchmark taken in turn.

    A single block of about ``BLOCK`` bytes is broadcast, and its index built once a task. Several lie in the shared
    folder: documents of ``GATHERED`` bytes wait in a task for each block's index in turn.
    """
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and item_id is not null")
    blocks = 1 + int(b.agg(F.coalesce(F.sum(F.octet_length("text") + 8), F.lit(0))).first()[0]) // BLOCK
    spark, place = docs.sparkSession, ""
    for k in range(blocks):
        rows = b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        items = [(r.item_id, r.text) for r in rows]
        if blocks > 1:
            place = place or f"{folder(spark)}/benchmark-{uuid.uuid4().hex}"
            texts = [x.encode() for _, x in items]
            put_arrays(f"{place}/{k}", ids=np.array([i for i, _ in items], np.int64), ends=np.cumsum([0, *map(len, texts)]), body=np.frombuffer(b"".join(texts), np.uint8))
    one = spark.sparkContext.broadcast(items) if blocks == 1 else None

    def opened(k: int) -> Index:
        if one is not None:
            return Index(one.value)
        ids, ends, body = (get_array(f"{place}/{k}", x) for x in ("ids", "ends", "body"))
        return Index([(int(i), body[a:z].tobytes().decode()) for i, a, z in zip(ids, ends, ends[1:], strict=False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
        kept: list[Index] = []

        def searched(held: list[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
            found: list[list] = [[[] for _ in range(x.num_rows)] for x in held]
            for k in range(blocks):
                if blocks == 1 and not kept:
                    kept.append(opened(k))
                index = kept[0] if kept else opened(k)
                for batch, rows in zip(held, found, strict=True):
                    own = [x for c in chunks(batch.column("text"), CHUNK) for x in index.search(c)]
                    for row, more in zip(rows, own, strict=True):
                        row += more
            yield from zip(held, ([merged(x) for x in rows] for rows in found), strict=True)

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if blocks == 1 or size > GATHERED:
                yield from searched(held)
                held, size = [], 0
        yield from searched(held)

    return run


def merged(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Each item once, by least edits, in the order of items: an item whose rows lie in several blocks is still one."""
    best: dict[int, tuple[int, int, int, int]] = {}
    for x in found:
        best[x[0]] = min(best.get(x[0], x), x)
    return [best[k] for k in sorted(best)]


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: the ids of the items of ``benchmark(item_id, text)`` found in its text.

    ``edits``, ``starts`` and ``ends`` (bytes) go with ``item_ids``; all are empty where nothing is found, and for null
    and empty texts. Null items and items without a letter, digit or character beyond ASCII are found nowhere; repeated
    items are found by each of their ids, once each. Repeated and null document ids keep a row each. An empty benchmark
    finds nothing, an empty table gives no rows. Other columns aren't read. A benchmark of any size takes one pass over
    the documents; what a task holds of it has a fixed bound.
    """
    searched = _searched(docs, benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in searched(batches):
            column = lambda k, kind: pa.array([[m[k] for m in x] for x in found], pa.list_(kind))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column(0, pa.int64()), column(1, pa.int32()), column(2, pa.int64()), column(3, pa.int64())], names=["doc_id", "item_ids", "edits", "starts", "ends"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, in whose text no benchmark item is found; texts aren't shuffled. Null and empty
    texts stay, an empty table stays empty."""
    searched = _searched(docs, benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in searched(batches):
            yield batch.filter(pa.array([not x for x in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), F.size("item_ids").cast("long").alias("n_items"), F.array_sort("item_ids").alias("item_ids"), F.array_min("edits").alias("least_edits"))
