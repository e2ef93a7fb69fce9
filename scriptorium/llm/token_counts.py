"""Token counts of a subword model without materialising ids.

A text is cut into pre-tokens that no piece of the model spans, so that the sum of their counts is the text's count.

1. Tasks send the distinct pre-tokens of their blocks of texts, packed, to shards by ranges of their hashes.
2. A shard has the library count each of its distinct pre-tokens, once for the whole corpus, and writes the hashes in
   order with the counts, as arrays in the shared folder.
3. Tasks join these counts to the pre-token frequencies of each text and sum; a count is looked up in the mapped arrays,
   so that a task holds no more of them than its block asks for.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import folder, get_array, put_arrays, shards
from .words import BYTE_HASHES, Chunk, chunks, mix, power_tables

#: Bytes of pre-tokens that a shard has counted at a time.
AT_ONCE = 4_000_000
#: Bytes of text that a task cuts at a time.
BLOCK = 1 << 22
#: Bytes of text to a shard, about; small tables have as many shards as the session's shuffles have partitions.
SHARD_BYTES = 1 << 27
MARK = "▁"  # how the model writes a space
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class PieceCounter:
    """Counts tokens of a sentencepiece model whose pieces hold the space mark only in front and no tab or line feed.

    The library puts one space before a text. So a text is that space and itself, cut before each run of spaces and
    around each tab and line feed; ``count`` gives the tokens of each part as the library cuts them inside a text.
    Of another model (``safe`` is false) a pre-token is a whole text.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.safe = not any(MARK in p.lstrip(MARK) or re.search("[\t\n]", p) for p in pieces)

    def count(self, parts: list[str]) -> list[int]:
        if not self.safe:
            return [len(x) for x in self.model.encode(parts, num_threads=1)]
        # behind a line feed nothing is put before the part: its tokens are all but the leading mark and the line feed
        return [len(x) - 2 for x in self.model.encode(["\n" + p for p in parts], num_threads=1)]


class PreTokens:
    """The pre-tokens of a chunk of texts: the distinct ones' hashes, in order, and where each first stands in ``body``;
    ``which`` names the distinct one of each, ``row`` its text."""

    def __init__(self, c: Chunk, safe: bool):
        raw = c.data
        if safe and MARK.encode() in raw.tobytes():  # the mark itself is a space to the model
            texts = [c.text(k).decode().replace(MARK, " ").encode() for k in range(c.rows)]
            raw, c = np.frombuffer(b"".join(texts), np.uint8), Chunk(c.first, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        n = np.diff(c.offsets)
        if safe:  # every text but an empty one gets its leading space
            filled = n > 0
            body = np.full(len(raw) + int(filled.sum()), 32, np.uint8)
            before = np.cumsum(filled)
            body[np.arange(len(raw)) + np.repeat(before, n)] = raw
            offsets = c.offsets + np.concatenate([[0], before])
            single, space = (body == 9) | (body == 10), body == 32
            start = np.zeros(len(body), bool)
            start[1:] = (space[1:] & ~space[:-1]) | single[1:] | single[:-1]
            start[offsets[:-1][filled]] = True
            at = np.flatnonzero(start)
        else:
            body, offsets = raw, c.offsets
            at = offsets[:-1][n > 0]
        ends = np.append(at[1:], len(body))
        self.body = body.tobytes()
        self.row = np.searchsorted(offsets, at, "right") - 1
        self.hashes, first, self.which = np.unique(_span_hashes(body, at, ends), return_index=True, return_inverse=True)
        self.starts, self.ends = at[first], ends[first]


def _span_hashes(body: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans, white space included."""
    up, down = power_tables(len(body) + 1)
    sums = np.zeros(len(body) + 1, np.uint64)
    np.cumsum(BYTE_HASHES[body] * up[: len(body)], out=sums[1:])
    return mix((sums[ends] - sums[at]) * down[at], 3)


def _shard(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Shards are ranges of hashes, so that sorted hashes lie shard by shard."""
    return (((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _distinct(model_file: str, parts: int):
    """Sends each shard a block's distinct pre-tokens: hashes, lengths and bytes, side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        safe = PieceCounter(model_file).safe
        for batch in batches:
            for c in chunks(batch.column("text"), BLOCK):
                t = PreTokens(c, safe)
                limits = np.searchsorted(_shard(t.hashes, parts), np.arange(parts + 1))
                some = [p for p in range(parts) if limits[p] < limits[p + 1]]
                spans = [(t.starts[limits[p] : limits[p + 1]], t.ends[limits[p] : limits[p + 1]]) for p in some]
                yield pa.RecordBatch.from_arrays([
                    pa.array(some, pa.int32()),
                    pa.array([t.hashes[limits[p] : limits[p + 1]].tobytes() for p in some], pa.binary()),
                    pa.array([(b - a).astype(np.int32).tobytes() for a, b in spans], pa.binary()),
                    pa.array([b"".join(t.body[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)) for a, b in spans], pa.binary()),
                ], names=["part", "hashes", "lengths", "bytes"])

    return run


def _counted(model_file: str, place: str):
    """Writes each shard's distinct hashes, in order, and how many pieces each has: counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, known, own = PieceCounter(model_file), {}, {}
        held: dict[int, list] = {}

        def count(p: int) -> None:
            seen, hashes, parts = known.setdefault(p, np.zeros(0, np.uint64)), [], []
            for h, n, raw in held.pop(p):
                ends = np.cumsum(n)
                hashes.append(h)
                parts += [raw[e - m : e] for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
            distinct, first = np.unique(np.concatenate(hashes), return_index=True)
            new = ~np.isin(distinct, seen, assume_unique=True)
            pieces = counter.count([parts[k].decode() for k in first[new]])
            own.setdefault(p, []).append((distinct[new], np.array(pieces, np.uint32)))
            known[p] = np.union1d(seen, distinct[new])

        size: dict[int, int] = {}
        for batch in batches:
            for p, h, n, raw in zip(batch.column("part").to_pylist(), *(batch.column(x) for x in ("hashes", "lengths", "bytes")), strict=True):
                held.setdefault(p, []).append((np.frombuffer(h.as_buffer(), np.uint64), np.frombuffer(n.as_buffer(), np.int32), raw.as_py()))
                size[p] = size.get(p, 0) + len(held[p][-1][2])
                if size[p] > AT_ONCE:
                    count(p)
                    size[p] = 0
        for p in sorted(size):
            if p in held:
                count(p)
            hashes, pieces = (np.concatenate([x[k] for x in own[p]]) for k in (0, 1))
            at = np.argsort(hashes)
            put_arrays(f"{place}/{p}", hashes=hashes[at], pieces=pieces[at])
            yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "n": pa.array([len(at)], pa.int64())})

    return run


class Counts:
    """The shards' counts, opened as they are asked for."""

    def __init__(self, place: str, parts: int):
        self.place, self.parts, self.open = place, parts, {}

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """Pieces of each of these hashes, which are in order and all counted."""
        out = np.zeros(len(hashes), np.int64)
        limits = np.searchsorted(_shard(hashes, self.parts), np.arange(self.parts + 1))
        for p in np.flatnonzero(limits[1:] > limits[:-1]).tolist():
            if p not in self.open:
                self.open[p] = get_array(f"{self.place}/{p}", "hashes"), get_array(f"{self.place}/{p}", "pieces")
            own, pieces = self.open[p]
            part = slice(limits[p], limits[p + 1])
            out[part] = pieces[np.searchsorted(own, hashes[part])]
        return out


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: UTF-8 bytes, tokens, and whether there are more than ``limit``.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows each count. Texts are never cut. An empty table gives
    no rows. Other columns aren't read. ``model_file`` must be at that path on each executor, as installed packages are.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts, place = max(shards(spark), -(-size // SHARD_BYTES)), f"{folder(spark)}/pieces-{uuid.uuid4().hex}"
    packed = d.select("text").mapInArrow(_distinct(model_file, parts), "part int, hashes binary, lengths binary, bytes binary")
    packed.repartition(parts, "part").mapInArrow(_counted(model_file, place), "part int, n long").agg(F.sum("n")).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        safe, counts = PieceCounter(model_file).safe, Counts(place, parts)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for c in chunks(batch.column("text"), BLOCK):
                t = PreTokens(c, safe)
                n_bytes.append(np.diff(c.offsets))
                n_tokens.append(np.bincount(t.row, counts.of(t.hashes)[t.which], c.rows).astype(np.int64))
            sizes, tokens = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (n_bytes, n_tokens))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(tokens > limit, pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return d.mapInArrow(run, SCHEMA)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
