"""Ranked lexical search: an inverted index in shards of documents, searched by MaxScore.

The index has a row per shard, a few MB of texts: its documents' ids and lengths, its distinct terms as 64-bit hashes, and
each term's postings, (document, occurrences), side by side. Tasks make them from whole texts, so that nothing is shuffled.
Counts over all shards give each term's weight. A task then searches its shards one after the other. In a shard a list's
greatest score is its upper bound. The lists of an item, by bound, are split: the first ones, whose bounds together stay
below the score to beat, are non-essential. Essential lists are merged; a document goes on to the non-essential lists, from
the greatest bound down, only while its score with all bounds left can still reach the score to beat. That is the item's
k-th best score so far, of the task's earlier shards too. The best k of each task meet in one ranking.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import drop, drop_folder, folder, get_array, put_arrays, table, told
from .words import Chunk, chunks, plain_bytes, words

#: Bytes of text to a shard, about; a longer text is a shard of its own.
SHARD_BYTES = 1 << 22
#: Shards to a file of the index: what a writer or a reader holds at once, however many shards a task has.
FILE_SHARDS = 4
#: Items that a task holds the best documents of at once: 16 bytes for each of k. More items go by in turns.
ITEMS_AT_ONCE = 1 << 16
#: Bytes of item texts whose terms a task reads at a time, about.
ITEM_BYTES = 1 << 23
#: Ways in which the tasks' best documents of an item meet before they are ranked as one.
WAYS = 32
INDEX = "doc_ids array<long>, sizes array<long>, terms array<long>, df array<int>, docs array<int>, tf array<int>, n_docs long, n_terms long"


def _terms(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all terms of a chunk, and the rows' limits among them."""
    w = words(Chunk(c.first, plain_bytes(c.data), c.offsets), lower=False)
    return w.hashes, w.bounds


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow column of one row that holds ``values``."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        ids = pa.concat_arrays([x[0] for x in held])
        hashes, counts = (np.concatenate([x[k] for x in held]) for k in (1, 2))
        row = np.repeat(np.arange(len(counts)), counts)
        order = np.lexsort((row, hashes))
        h, r = hashes[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        at = np.flatnonzero(new)
        tf, h, r = np.diff(np.append(at, len(h))), h[at], r[at]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        df = np.diff(np.append(first, len(h)))
        columns = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), _lists(counts, pa.int64()), _lists(h[first].view(np.int64), pa.int64()), _lists(df.astype(np.int32), pa.int32()), _lists(r.astype(np.int32), pa.int32()), _lists(tf.astype(np.int32), pa.int32())]
        return pa.RecordBatch.from_arrays([*columns, pa.array([int((counts > 0).sum())], pa.int64()), pa.array([int(counts.sum())], pa.int64())], names=["doc_ids", "sizes", "terms", "df", "docs", "tf", "n_docs", "n_terms"])

    for batch in batches:
        for c in chunks(batch.column("text")):
            hashes, bounds = _terms(c)
            if held and size + len(c.data) > SHARD_BYTES:
                yield flush()
                held, size = [], 0
            held.append((batch.column("doc_id").slice(c.first, c.rows), hashes, np.diff(bounds)))
            size += len(c.data)
    if held:
        yield flush()


def build_index(docs: DataFrame) -> DataFrame:
    """The index of ``docs(doc_id, text)``, a row per shard, as a table in the shared folder."""
    return table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_shards, INDEX), "index", FILE_SHARDS)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item's distinct terms and how often it has them: ``(item, term, repeats)``."""
    for batch in batches:
        for c in chunks(batch.column("text")):
            hashes, bounds = _terms(c)
            for k in range(c.rows):
                own, n = np.unique(hashes[bounds[k] : bounds[k + 1]], return_counts=True)
                item = np.full(len(own), batch.column("item")[c.first + k].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(own.view(np.int64)), pa.array(n.astype(np.int64))], names=["item", "term", "repeats"])


def _put_items(place: str):
    """Writes a block's items, each with its terms and their weights times repeats, side by side."""

    def run(key: tuple[pa.Scalar, ...], of: pa.Table) -> pa.Table:
        of = of.sort_by([("item", "ascending"), ("term", "ascending")])
        item = of["item"].to_numpy()
        first = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
        put_arrays(f"{place}/{key[0].as_py()}", items=item[first], limits=np.append(first, len(item)), terms=of["term"].to_numpy().view(np.uint64), weights=of["weight"].to_numpy() * of["repeats"].to_numpy())
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32())})

    return run


class Shard:
    """A row of the index, with the score that each posting gives for a weight of one, and each list's greatest."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        arrays = {k: row[k].values.to_numpy(zero_copy_only=False) for k in ("sizes", "terms", "df", "docs", "tf")}
        self.ids = row["doc_ids"].values
        self.terms, self.docs = arrays["terms"].view(np.uint64), arrays["docs"]
        self.limits = np.concatenate([[0], np.cumsum(arrays["df"])])
        n = arrays["sizes"]
        if 25 * n_docs * int(n.max(initial=0)) < 2**63:
            m = 75 + 25 * n * n_docs // max(1, n_terms)
        else:
            m = np.array([75 + 25 * x * n_docs // n_terms for x in n.tolist()], np.int64)
        tf = arrays["tf"].astype(np.int64)
        self.units = 1_000_000_000 * tf // (1000 * tf + 12 * m[self.docs])
        self.greatest = np.maximum.reduceat(self.units, self.limits[:-1]) if len(self.terms) else self.units
        self.sums = np.zeros(len(n), np.int64)

    def best(self, lists: np.ndarray, weights: np.ndarray, k: int, beat: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents, as numbers in the shard, that may belong to the k best, and their scores; all that score at least
        ``beat``, above zero, and have k - 1 others at most above them in this shard are among them."""
        bounds = weights * self.greatest[lists]
        order = np.argsort(bounds, kind="stable")
        lists, weights, together = lists[order], weights[order], np.cumsum(bounds[order])
        essential = int(np.searchsorted(together, max(beat, 1), "left"))
        self.sums[:] = 0
        for j in range(essential, len(lists)):
            own = slice(self.limits[lists[j]], self.limits[lists[j] + 1])
            self.sums[self.docs[own]] += weights[j] * self.units[own]
        left = np.flatnonzero(self.sums)
        for j in range(essential - 1, -1, -1):
            left, beat = self._able(left, int(together[j]), k, beat)
            if not len(left):
                break
            own = slice(self.limits[lists[j]], self.limits[lists[j] + 1])
            docs = self.docs[own]
            at = np.minimum(np.searchsorted(docs, left), len(docs) - 1)
            hit = docs[at] == left
            self.sums[left[hit]] += weights[j] * self.units[own][at[hit]]
        left, _ = self._able(left, 0, k, beat)
        return left, self.sums[left]

    def _able(self, left: np.ndarray, more: int, k: int, beat: int) -> tuple[np.ndarray, int]:
        """Those that with ``more`` can still reach the score to beat, which the k-th greatest sum so far may raise."""
        sums = self.sums[left]
        if len(left) > k:
            beat = max(beat, int(np.partition(sums, len(sums) - k)[len(sums) - k]))
        return left[sums + more >= max(beat, 1)], beat


class Best:
    """The k best documents of each item so far: greater score first, then smaller id; a null id comes last."""

    def __init__(self, k: int):
        self.k, self.of = k, {}

    def beat(self, item: int) -> int:
        own = self.of.get(item)
        return int(own[0][self.k - 1]) if own is not None and len(own[0]) >= self.k else 0

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        if item in self.of:
            scores, ids, nulls = (np.concatenate(x) for x in zip(self.of[item], (scores, ids, nulls), strict=True))
        order = np.lexsort((ids, nulls, -scores))[: self.k]
        self.of[item] = scores[order], ids[order], nulls[order]

    def rows(self) -> Iterator[pa.RecordBatch]:
        for item, (scores, ids, nulls) in self.of.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item, np.int64)), pa.array(ids, pa.int64(), mask=nulls), pa.array(scores)], names=["item", "doc_id", "score"])


def _searched(place: str, blocks: list[int], k: int, n_docs: int, n_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in batches:
            for r in range(batch.num_rows):
                shard = Shard({x: batch.column(x)[r] for x in batch.schema.names}, n_docs, n_terms)
                ids, nulls = np.asarray(shard.ids.fill_null(0)), np.asarray(shard.ids.is_null())
                for b in blocks:
                    items, limits, terms, weights = (get_array(f"{place}/{b}", x) for x in ("items", "limits", "terms", "weights"))
                    at = np.minimum(np.searchsorted(shard.terms, terms), max(0, len(shard.terms) - 1))
                    here = shard.terms[at] == terms if len(shard.terms) else np.zeros(len(terms), bool)
                    for i, item in enumerate(items.tolist()):
                        own = slice(limits[i], limits[i + 1])
                        lists, w = at[own][here[own]], weights[own][here[own]]
                        if len(lists):
                            left, scores = shard.best(lists, w, k, best.beat(item))
                            if len(left):
                                best.add(item, scores, ids[left], nulls[left])
        yield from best.rows()

    return run


def search(index: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` best documents of ``index`` for each row of ``items(item_id, text)``: ``(item_id, rank, doc_id, score)``.

    A term's weight is ``w = floor(1000 * ln((2N + 2) / (2df + 1)))``, a document's ``m = 75 + 25 n N div L``; its score sums
    ``w * (1000000000 tf div (1000 tf + 12 m))`` over the item's terms, repeats included. Only scores above 0 rank; equal
    scores go by id, a null id last. Null texts and texts without a term have no terms; an item without terms has no rows.
    Repeated items and repeated documents each count. Texts are never cut. An empty index gives no rows.
    """
    spark = index.sparkSession
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    own = table(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "items")
    asked = table(own.select("item", "text").mapInArrow(_asked, "item long, term long, repeats long"), "asked")
    held = index.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.df").alias("df"))
    terms = table(asked.select("term").distinct(), "terms")
    df = held.join(told(terms, 16), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * n_docs) + 2) / (2.0 * F.col("df") + 1)))
    weighed = asked.join(told(table(df.select("term", weight.cast("long").alias("weight")), "weights"), 24), "term").where("weight > 0")
    n_items, size = own.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_blocks = max(1, -(-size // ITEM_BYTES), -(-n_items // ITEMS_AT_ONCE))
    place = f"{folder(spark)}/asked-{uuid.uuid4().hex}"
    placed = weighed.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(n_blocks)).cast("int")).groupBy("block").applyInArrow(_put_items(place), "block int")
    blocks = [x.block for x in placed.collect()]
    turn = max(1, math.ceil(n_blocks * ITEMS_AT_ONCE / max(1, n_items)))
    kind = "item long, doc_id long, score long"
    parts = [index.mapInArrow(_searched(place, blocks[b : b + turn], k, n_docs, n_terms), kind) for b in range(0, len(blocks), turn)]
    best = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], kind)
    order = F.col("score").desc(), F.col("doc_id").asc_nulls_last()
    best = table(best.withColumn("way", F.pmod(F.spark_partition_id(), F.lit(WAYS))), "best")
    drop_folder(spark, place)
    some = best.withColumn("rank", F.row_number().over(Window.partitionBy("item", "way").orderBy(*order))).where(F.col("rank") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    out = table(ranked.join(own.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score"), "ranked")
    drop(own, asked, terms, best)
    return out


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all ``documents`` for each item of ``benchmark``: ``item_id``, ``rank``, ``doc_id``, ``score``."""
    index = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    out = search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    drop(index)
    return out


SQL = r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
postings AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
scales AS (SELECT doc_id, 75 + ((25 * n * docs) // terms) AS m FROM sizes, totals),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, totals GROUP BY term, docs),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
repeats AS (SELECT item_id, term, count(*) AS q FROM asked GROUP BY item_id, term),
scores AS (SELECT item_id, postings.doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
           FROM repeats JOIN postings ON repeats.term = postings.term JOIN weights ON repeats.term = weights.term JOIN scales ON postings.doc_id = scales.doc_id
           GROUP BY item_id, postings.doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, CAST(r AS INTEGER) AS "rank", doc_id, score FROM ranked WHERE r <= 20
"""
