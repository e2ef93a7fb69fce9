"""A word trigram model in an Elias-Fano trie, and the log10 probability of every text under it.

Level 1 has the training words, sorted by hash, with their counts. Monotone pointers (Elias-Fano) lead from a node of a
level to its successors on the next; the successors of all nodes form one monotone sequence ``node * V + successor``,
Elias-Fano coded too, so that a successor is sought relative to its context within one bucket of high bits. A node of
level 2 is a pair of words, one of level 3 a triple. Probabilities are quantised to 8 bits by a codebook per shard.
Smoothing is Witten-Bell's: with T(h) different successors of a context h, ``P(w|h) = (c(hw) + T(h) P(w|h')) / (c(h) + T(h))``,
h' being h without its first word, over the add-one unigrams P(w). Level 2 holds P(w|v), level 3 the part
``c(hw) / (c(h) + T(h))``, to which the context's back-off times P(w|v) is added.

The trie is built in shards by ranges of word hashes: each a few mapped files in the shared folder. Counting covers all
training texts; tasks send blocks' distinct words, pairs and triples, the latter two Elias-Fano coded.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import crc_mod, folder, get_array, put_arrays, shards
from .words import chunks, one_hash, words

END = np.uint64(one_hash(b"\x00end of text\x00".replace(b" ", b"\xff")))  # \xff is never in UTF-8, so no word has this hash
BLOCK = 1_500_000
#: High bits to an entry of the directory.
SPAN = 512
#: Bytes of training text to a shard, about; small tables have as many shards as the session's shuffles have partitions.
SHARD_BYTES = 1 << 26


class EliasFano:
    """A strictly or weakly rising sequence of integers below ``universe``, in about 2 + log2(universe / n) bits each.

    A directory has the ones before every ``SPAN`` high bits: lookups read the places that they need, never the whole.
    """

    @staticmethod
    def build(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
        n = len(values)
        low = max(0, int(np.floor(np.log2(max(1, universe) / max(1, n)))))
        v = values.astype(np.uint64)
        high = np.zeros(-(-(n + (universe >> low) + 8) // SPAN) * SPAN, bool)
        high[(v >> np.uint64(low)).astype(np.int64) + np.arange(n)] = True
        packed = np.zeros(n * low // 64 + 2, np.uint64)
        if low and n:
            at = np.arange(n, dtype=np.uint64) * np.uint64(low)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            bits = v & np.uint64((1 << low) - 1)
            np.bitwise_or.at(packed, word, bits << shift)
            over = np.flatnonzero(shift + np.uint64(low) > np.uint64(64))
            np.bitwise_or.at(packed, word[over] + 1, bits[over] >> (np.uint64(64) - shift[over]))
        words_ = np.packbits(high, bitorder="little").view(np.uint64)
        return {"high": words_, "low": packed, "rank": EliasFano.ranks(words_), "head": np.array([n, low], np.int64)}

    def __init__(self, head: np.ndarray, high: np.ndarray, low: np.ndarray, rank: np.ndarray | None = None):
        """Without ``rank``, the directory is counted anew from the high bits."""
        self.n, self.bits, self.high, self.packed = int(head[0]), int(head[1]), high, low
        self.ones = self.ranks(high) if rank is None else np.asarray(rank)
        self.zeros = np.arange(len(self.ones)) * SPAN - self.ones

    @staticmethod
    def ranks(high: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(np.bitwise_count(high).reshape(-1, SPAN // 64).sum(1))]).astype(np.int64)

    def select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Where the k-th one (or zero) of the high bits stands, from 0: by the directory, then by words, then by bits."""
        directory, flip = (self.ones, np.uint64(0)) if ones else (self.zeros, np.uint64(2**64 - 1))
        span = np.searchsorted(directory, k, "right") - 1
        rest, at = k - directory[span], span * (SPAN // 64)
        for _ in range(SPAN // 64 - 1):
            c = np.bitwise_count(self.high[at] ^ flip)
            beyond = rest >= c
            rest -= np.where(beyond, c, 0)
            at += beyond
        word, at = self.high[at] ^ flip, at * 64
        for step in (32, 16, 8, 4, 2, 1):
            right = word & np.uint64((1 << step) - 1)
            c = np.bitwise_count(right)
            beyond = rest >= c
            rest -= np.where(beyond, c, 0)
            at += np.where(beyond, step, 0)
            word = np.where(beyond, word >> np.uint64(step), right)
        return at

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        right = self.packed[word + 1] << np.uint64(1) << (np.uint64(63) - shift)
        return ((self.packed[word] >> shift) | right) & np.uint64((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.select(i, True) - i) << self.bits) | self.lows(i).astype(np.int64)

    def values(self) -> np.ndarray:
        i = np.arange(self.n)
        ones = np.flatnonzero(np.unpackbits(np.ascontiguousarray(self.high).view(np.uint8), bitorder="little"))[: self.n]
        return ((ones - i) << self.bits) | self.lows(i).astype(np.int64)

    @staticmethod
    def packed(values: np.ndarray, universe: int) -> bytes:
        """A sequence as bytes, for the way between tasks."""
        a = EliasFano.build(values, universe)
        return np.concatenate([a["head"], [len(a["high"])], a["high"].view(np.int64), a["low"].view(np.int64)]).tobytes()

    @staticmethod
    def unpacked(raw) -> np.ndarray:
        a = np.frombuffer(raw, np.int64)
        end = 3 + int(a[2])
        return EliasFano(a[:2], a[3:end].view(np.uint64), a[end:].view(np.uint64)).values()

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Where each key below the universe stands, or -1: its bucket of high bits is searched for its low bits."""
        out = np.full(len(keys), -1, np.int64)
        if not self.n or not len(keys):
            return out
        h = (keys >> self.bits).astype(np.int64)
        # the k-th zero ends bucket k
        s, e = np.where(h > 0, self.select(np.maximum(h - 1, 0), False) - h + 1, 0), self.select(h, False) - h
        low = (keys & ((1 << self.bits) - 1)).astype(np.uint64)
        end, wide = e.copy(), np.flatnonzero(s < e)
        while len(wide):
            middle = (s[wide] + e[wide]) >> 1
            less = self.lows(middle) < low[wide]
            s[wide[less]], e[wide[~less]] = middle[less] + 1, middle[~less]
            wide = wide[s[wide] < e[wide]]
        some = np.flatnonzero(s < end)
        some = some[self.lows(s[some]) == low[some]]
        out[some] = s[some]
        return out


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Shards are ranges of hashes, so that shard by shard the words are in one sorted order."""
    return (((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


class Vocabulary:
    """Level 1 over all shards. A word's id is its place in the sorted order."""

    def __init__(self, place: str, sizes: list[int]):
        self.base = np.cumsum([0, *sizes])
        self.hashes = [get_array(f"{place}/{p}", "words") if n else None for p, n in enumerate(sizes)]
        self.counts = [get_array(f"{place}/{p}", "counts") if n else None for p, n in enumerate(sizes)]

    @property
    def size(self) -> int:
        return int(self.base[-1])

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted hashes, -1 for those not in training."""
        out = np.full(len(hashes), -1, np.int64)
        limits = np.searchsorted(part_of(hashes, len(self.hashes)), np.arange(len(self.hashes) + 1))
        for p, own in enumerate(self.hashes):
            a, b = limits[p], limits[p + 1]
            if a < b and own is not None:
                at = np.minimum(np.searchsorted(own, hashes[a:b]), len(own) - 1)
                out[a:b] = np.where(own[at] == hashes[a:b], at + self.base[p], -1)
        return out

    def count(self, ids: np.ndarray) -> np.ndarray:
        """Counts of sorted ids; 0 for -1."""
        out = np.zeros(len(ids), np.int64)
        limits = np.searchsorted(ids, self.base)
        for p, own in enumerate(self.counts):
            a, b = limits[p], limits[p + 1]
            if a < b:
                out[a:b] = own[ids[a:b] - self.base[p]]
        return out


def _tokens(batches: Iterator[pa.RecordBatch], extra: tuple[str, ...] = ()) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """Blocks of whole texts: token hashes with an end after each text, the texts' limits, and further columns' values."""
    held, sizes, values, total = [], [], [], 0
    for batch in batches:
        rows = list(zip(*(batch.column(x).to_pylist() for x in extra), strict=True)) if extra else []
        for c in chunks(batch.column("text")):
            w = words(c)
            n = np.diff(w.bounds)
            held.append(np.insert(w.hashes, w.bounds[1:], END))
            sizes += (n + 1).tolist()
            values += rows[c.first : c.first + c.rows]
            total += len(held[-1])
            if total >= BLOCK:
                yield np.concatenate(held), np.cumsum([0, *sizes]), values
                held, sizes, values, total = [], [], [], 0
    if held:
        yield np.concatenate(held), np.cumsum([0, *sizes]), values


def _rows(parts: list[int], **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *(pa.array(v, pa.binary()) for v in columns.values())], names=["part", *columns])


def _word_counts(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, _, _ in _tokens(batches):
            own, n = np.unique(tokens, return_counts=True)
            limits = np.searchsorted(part_of(own, parts), np.arange(parts + 1))
            some = [p for p in range(parts) if limits[p] < limits[p + 1]]
            yield _rows(some, keys=[own[limits[p] : limits[p + 1]].tobytes() for p in some], counts=[n[limits[p] : limits[p + 1]].astype(np.uint32).tobytes() for p in some])

    return run


def _packed_keys(keys: np.ndarray, part: np.ndarray, universes: np.ndarray) -> pa.RecordBatch:
    """Rows with the distinct keys of each shard, Elias-Fano coded, and their counts, in a byte each where they fit."""
    order = np.argsort(part, kind="stable")
    limits = np.searchsorted(part[order], np.arange(len(universes) + 1))
    some = [p for p in range(len(universes)) if limits[p] < limits[p + 1]]
    out = {"keys": [], "counts": []}
    for p in some:
        k, n = np.unique(keys[order[limits[p] : limits[p + 1]]], return_counts=True)
        out["keys"].append(EliasFano.packed(k, int(universes[p])))
        out["counts"].append(n.astype(np.uint8 if n.max() < 256 else np.uint32).tobytes())
    return _rows(some, **out)


def _merged(batches: Iterator[pa.RecordBatch], coded: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, sorted distinct keys, counts) of packed rows; keys are hashes or, if ``coded``, Elias-Fano sequences."""
    held: dict[int, list] = {}
    for batch in batches:
        for p, k, n in zip(batch.column("part").to_pylist(), batch.column("keys"), batch.column("counts"), strict=True):
            keys = EliasFano.unpacked(k.as_buffer()) if coded else np.frombuffer(k.as_buffer(), np.uint64)
            raw = n.as_buffer()
            held.setdefault(p, []).append((keys, np.frombuffer(raw, np.uint8 if raw.size == len(keys) else np.uint32)))
    for p, own in held.items():
        keys, counts = np.concatenate([x[0] for x in own]), np.concatenate([x[1] for x in own]).astype(np.int64)
        own.clear()
        at = np.argsort(keys)
        keys = keys[at]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        yield p, keys[first], np.add.reduceat(counts[at], first)


class Trie:
    """The model's place, words by shard, total, and the nodes by shard of levels 2 and 3; small enough for every task."""

    def __init__(self, place: str, sizes: list[int], tokens: int):
        self.place, self.sizes, self.tokens = place, sizes, tokens
        self.level2: dict[int, int] = {}
        self.level3: dict[int, int] = {}


def _coded(log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of 8 bits and their codebook: quantiles of the values."""
    book = np.unique(np.quantile(log, np.linspace(0, 1, 256)))
    return np.minimum(np.searchsorted((book[1:] + book[:-1]) / 2, log), len(book) - 1).astype(np.uint8), book


def _level(keys: np.ndarray, counts: np.ndarray, nodes: int, size: int) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Of a shard's keys ``node * size + successor``: each key's T and c of its context, and the level's arrays but the codes."""
    node = keys // size
    pointers = np.searchsorted(node, np.arange(nodes + 1))
    types = np.diff(pointers)
    followed = np.add.reduceat(np.append(counts, 0), np.minimum(pointers[:-1], len(counts))) * (types > 0)
    arrays = {f"s{k}": v for k, v in EliasFano.build(keys, nodes * size).items()} | {f"p{k}": v for k, v in EliasFano.build(pointers, len(keys) + 1).items()}
    return types[node], followed[node], arrays | {"followed": followed.astype(np.uint32) if followed.max() < 2**32 else followed}


def fit(texts: DataFrame) -> Trie:
    """Counts all of ``texts(text)`` and writes the trie."""
    spark = texts.sparkSession
    texts = texts.select("text")
    # a shard is merged in one task's memory, so their number follows the data
    parts = max(shards(spark), -(-texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // SHARD_BYTES))
    place = f"{folder(spark)}/trie-{uuid.uuid4().hex}"

    def level1(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, keys, counts in _merged(batches, False):
            put_arrays(f"{place}/{p}", words=keys, counts=counts.astype(np.uint32) if counts.max() < 2**32 else counts)
            yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "total": pa.array([int(counts.sum())], pa.int64())})

    packed = texts.mapInArrow(_word_counts(parts), "part int, keys binary, counts binary").repartition(parts, "part")
    sizes, tokens = [0] * parts, 0
    for r in packed.mapInArrow(level1, "part int, n long, total long").collect():  # a row per shard
        sizes[r.part] = r.n
        tokens += r.total
    trie = Trie(place, sizes, tokens)
    if not tokens:
        return trie

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(place, sizes)
        base, size = vocabulary.base, vocabulary.size
        for tokens_, bounds, _ in _tokens(batches):
            own, inverse = np.unique(tokens_, return_inverse=True)
            ids = vocabulary.ids(own)[inverse]
            at = np.flatnonzero(_follows(bounds))
            first = ids[at - 1]
            part = np.searchsorted(base, first, "right") - 1
            yield _packed_keys((first - base[part]) * size + ids[at], part, np.array(sizes, np.int64) * size)

    def level2(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(place, sizes)
        size = vocabulary.size
        for p, keys, counts in _merged(batches, True):
            types, followed, arrays = _level(keys, counts, sizes[p], size)
            distinct, inverse = np.unique(keys % size, return_inverse=True)
            unigram = (vocabulary.count(distinct)[inverse] + 1) / (tokens + size + 1)
            code, book = _coded(np.log10((counts + types * unigram) / (followed + types)))
            put_arrays(f"{place}/2-{p}", **arrays, codes=code, book=book)
            yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "n": pa.array([len(keys)], pa.int64())})

    packed = texts.mapInArrow(pairs, "part int, keys binary, counts binary").repartition(parts, "part")
    trie.level2 = {r.part: r.n for r in packed.mapInArrow(level2, "part int, n long").collect()}

    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(trie)
        nodes = np.array([trie.level2.get(p, 0) for p in range(parts)], np.int64)
        for tokens_, bounds, _ in _tokens(batches):
            b = reader.block(tokens_, bounds)
            at = b.thirds()
            yield _packed_keys(b.node[at - 1] * reader.size + b.ids[at], b.part[at - 1], nodes * reader.size)

    def level3(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = sum(sizes)
        for p, keys, counts in _merged(batches, True):
            types, followed, arrays = _level(keys, counts, trie.level2[p], size)
            code, book = _coded(np.log10(counts / (followed + types)))
            put_arrays(f"{place}/3-{p}", **arrays, codes=code, book=book)
            yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "n": pa.array([len(keys)], pa.int64())})

    packed = texts.mapInArrow(triples, "part int, keys binary, counts binary").repartition(parts, "part")
    trie.level3 = {r.part: r.n for r in packed.mapInArrow(level3, "part int, n long").collect()}
    return trie


def _follows(bounds: np.ndarray) -> np.ndarray:
    """Which tokens have one before them in their text."""
    out = np.ones(int(bounds[-1]), bool)
    out[bounds[:-1]] = False
    return out


class Shard:
    """A level of one shard, opened."""

    def __init__(self, place: str):
        get = lambda x: get_array(place, x)
        self.level, self.pointers = (EliasFano(*(get(f"{x}{y}") for y in ("head", "high", "low", "rank"))) for x in "sp")
        self.followed, self.codes, self.book = get("followed"), get("codes"), get("book")

    def back_off(self, nodes: np.ndarray) -> np.ndarray:
        """What each context leaves to successors that never followed it; 1 where none followed."""
        n = self.followed[nodes].astype(np.float64)
        types = self.pointers.get(nodes + 1) - self.pointers.get(nodes)
        return np.where(n > 0, types / np.maximum(1, n + types), 1.0)

    def log10(self, spot: np.ndarray) -> np.ndarray:
        return self.book[self.codes[spot]]


class Block:
    """A block of tokens: their word ids (-1: unknown), and for each with a known word before it that pair's node, if the
    trie has it, in shard ``part``; -1 if not."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray):
        self.ids, self.follows = ids, _follows(bounds)
        self.node, self.part = np.full(len(ids), -1, np.int64), np.full(len(ids), -1, np.int64)

    def thirds(self) -> np.ndarray:
        """Tokens behind a pair that the trie has."""
        at = np.flatnonzero(self.follows)
        return at[self.node[at - 1] >= 0]  # a text's first token has no node


class Reader:
    """Looks words, pairs and triples up in a trie."""

    def __init__(self, trie: Trie):
        self.trie, self.vocabulary, self.kept = trie, Vocabulary(trie.place, trie.sizes), {}
        self.size = self.vocabulary.size

    def shard(self, level: int, p: int) -> Shard:
        if (level, p) in self.kept:
            return self.kept[level, p]
        shard = Shard(f"{self.trie.place}/{level}-{p}")
        if self.trie.place.startswith("file:"):  # mapped: an open shard holds no memory
            self.kept[level, p] = shard
        return shard

    def _by_part(self, part: np.ndarray, level: dict) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(part, kind="stable")
        limits = np.searchsorted(part[order], np.arange(len(self.trie.sizes) + 1))
        for p in sorted(level):
            if limits[p] < limits[p + 1]:
                yield p, order[limits[p] : limits[p + 1]]

    def _found(self, shard: Shard, node: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Where each (context node, successor) stands on the shard's level, or -1."""
        out = np.full(len(ids), -1, np.int64)
        known = np.flatnonzero(ids >= 0)
        keys, again = np.unique(node[known] * self.size + ids[known], return_inverse=True)
        out[known] = shard.level.find(keys)[again]
        return out

    def block(self, tokens: np.ndarray, bounds: np.ndarray, p1: np.ndarray | None = None) -> Block:
        """The block's ids and nodes; with log10 P(w) of the distinct tokens, in order, also ``log``: log10 P(w|v)."""
        own, inverse = np.unique(tokens, return_inverse=True)
        b = Block(self.vocabulary.ids(own)[inverse], bounds)
        b.log = None if p1 is None else p1[inverse]
        at = np.flatnonzero(b.follows)
        at = at[b.ids[at - 1] >= 0]
        word = b.ids[at - 1]
        part = np.searchsorted(self.vocabulary.base, word, "right") - 1
        for p, mine in self._by_part(part, self.trie.level2):
            shard, t = self.shard(2, p), at[mine]
            local = word[mine] - self.vocabulary.base[p]
            spot = self._found(shard, local, b.ids[t])
            b.part[t], b.node[t] = p, spot
            if p1 is not None:
                some, again = np.unique(local, return_inverse=True)
                b.log[t] = np.where(spot >= 0, shard.log10(np.maximum(spot, 0)), b.log[t] + np.log10(shard.back_off(some))[again])
        return b

    def third(self, b: Block) -> None:
        """Turns the block's ``log`` into log10 P(w|u,v) where the trie has the context."""
        at = b.thirds()
        for p, mine in self._by_part(b.part[at - 1], self.trie.level3):
            shard, t = self.shard(3, p), at[mine]
            node = b.node[t - 1]
            spot = self._found(shard, node, b.ids[t])
            some, again = np.unique(node, return_inverse=True)
            rest = 10.0 ** b.log[t] * shard.back_off(some)[again]
            b.log[t] = np.log10(rest + np.where(spot >= 0, 10.0 ** shard.log10(np.maximum(spot, 0)), 0.0))


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, trie: Trie) -> DataFrame:
    """Scores every row of ``docs(doc_id, text, held_out)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(trie)
        vocabulary = reader.vocabulary
        for tokens, bounds, rows in _tokens(batches, ("doc_id", "held_out")):
            own, inverse = np.unique(tokens, return_inverse=True)
            ids_of = vocabulary.ids(own)
            known = ids_of >= 0  # the known ids rise, as their hashes do
            counts = np.zeros(len(own), np.int64)
            counts[known] = vocabulary.count(ids_of[known])
            base = np.log10((counts + 1) / (trie.tokens + vocabulary.size + 1))
            b = reader.block(tokens, bounds, base)
            reader.third(b)
            sums = lambda x: np.add.reduceat(x, bounds[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.bool_()), pa.array(np.diff(bounds)), pa.array(sums((counts > 0)[inverse].astype(np.int64))), pa.array(np.full(len(rows), trie.tokens, np.int64)), pa.array(sums(base[inverse])), pa.array(sums(b.log))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, SCHEMA)


def score_corpus(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``; the model learns from rows whose crc32(doc_id) mod 7 is not 2.

    A null or empty text has one token, its end. A null id is in training. Repeated rows each count. Without training
    tokens every token has probability 1. Very long texts are taken whole. Other columns aren't read.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False)))
    return score(d, fit(d.where("not held_out")))


def op2_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"))
