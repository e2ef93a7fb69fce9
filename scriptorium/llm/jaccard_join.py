"""N-gram Jaccard join of all documents: a size-aware heavy-light join.

Documents with equal shingle sets form a class at once. Then, among classes:

* light sets (at most ``boundary`` shingles) enumerate their subsets of every size that a link could demand; two light
  sets link exactly if they share a subset of the demanded size, so the join is on subset hashes;
* heavy sets scan inverted lists. A link needs a common shingle among each set's first ``n - ceil(0.8 n) + 1`` in any
  fixed order, so only those lists are kept; the order puts shingles that many documents share last, by counts over all
  documents. A light set that a heavy one could link with is in those lists too;
* the boundary has the least estimated cost, from the size histogram and the mean list length.

Lists aren't expanded into pairs: each set is proposed to heads of its lists, and only sets that then lie in different
components are paired, where sizes, places and a bitmap bound that never rejects a true link allow one. So all components
are known, and every link lies in one of them. The links themselves are counted in blocks of a component's sets: a task
compares two blocks by their incidence matrices and gives counts by set, not pairs.

What travels is packed: a task sends each partition one byte string of postings (5 bytes of key, 2 of local document).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, count
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import extended
from .shared import bucketed, drop, shards, table
from .words import Chunk, Words, chunks, mix, shingle_set, words

SIZE = 5
NUM, DEN = 80, 100
#: A shingle in more documents than this comes late in the order.
COMMON = 32
#: At most so many common shingles are told to the tasks; with more, ``COMMON`` is doubled until they fit. Any order is exact.
MAX_COMMON = 400_000
#: Counters of a partition in the shingle count; partitions grow with the data.
COUNTERS = 1 << 22
BITMAP = 1024
MAX_LIGHT = 16
BLOCK_DOCS = 1 << 15


def least_overlap(a: int, b: int) -> int:
    """Shared shingles that sets of sizes a and b need to link: I >= 0.8 (a + b - I)."""
    return -(-NUM * (a + b) // (DEN + NUM))


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def demanded(n: int) -> list[int]:
    """The overlaps that a set of n shingles may need with partners of any size it can link with."""
    return sorted({least_overlap(n, t) for t in range(-(-NUM * n // DEN), DEN * n // NUM + 1) if t and least_overlap(n, t) <= n})


def boundary_by_cost(histogram: dict[int, int], list_length: float) -> int:
    """The largest light size, 0 to MAX_LIGHT: least subsets enumerated plus postings scanned and pairs they propose."""
    subsets = lambda n: sum(comb(n, c) for c in demanded(n))
    scanned = lambda n: prefix_length(n) * (1 + list_length)

    def cost(x: int) -> float:
        light = sum(k * subsets(n) for n, k in histogram.items() if 0 < n <= x)
        also = sum(k * scanned(n) for n, k in histogram.items() if 0 < n <= x and DEN * n >= NUM * (x + 1))
        return light + also + sum(k * scanned(n) for n, k in histogram.items() if n > x)

    return min(range(MAX_LIGHT + 1), key=lambda x: (cost(x), x))


def _sets(c: Chunk, w: Words) -> Iterator[np.ndarray]:
    for k in range(c.rows):
        yield shingle_set(w.hashes[w.bounds[k] : w.bounds[k + 1]], SIZE)


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values()], names=list(columns))


def _bitmap(s: np.ndarray) -> bytes:
    return np.packbits((np.bincount((mix(s, 9) & np.uint64(BITMAP - 1)).astype(np.int64), minlength=BITMAP) & 1).astype(bool)).tobytes()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row: set size, two order-free hashes of the set, and its parity bitmap as longs."""
    for batch in batches:
        n, k1, k2, bits = [], [], [], []
        for c in chunks(batch.column("text")):
            for s in _sets(c, words(c)):
                n.append(len(s))
                k1.append(mix(s, 1).sum(dtype=np.uint64))
                k2.append(mix(s, 2).sum(dtype=np.uint64))
                bits.append(_bitmap(s))
        signed = lambda x: np.array(x, np.uint64).view(np.int64)
        yield _batch(doc_id=batch.column("doc_id"), n=pa.array(n, pa.int64()), k1=pa.array(signed(k1), pa.int64()), k2=pa.array(signed(k2), pa.int64()), bits=pa.array([np.frombuffer(b, np.int64) for b in bits], pa.list_(pa.int64())))


def _packed_counts(parts: int):
    """Sends each partition the counters that a block's shingles fall on: 3 bytes a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            every = np.concatenate(held)
            to = (every % np.uint64(parts)).astype(np.int32)
            slot = ((every // np.uint64(parts)) % np.uint64(COUNTERS)).astype(np.uint32)
            order = np.argsort(to, kind="stable")
            limits = np.searchsorted(to[order], np.arange(parts + 1))
            raw = slot[order].view(np.uint8).reshape(-1, 4)[:, :3]
            return _batch(part=pa.array(np.arange(parts), pa.int32()), body=pa.array([raw[limits[k] : limits[k + 1]].tobytes() for k in range(parts)], pa.binary()))

        for batch in batches:
            for c in chunks(batch.column("text")):
                own = [s for s in _sets(c, words(c)) if len(s)]
                if own:
                    held.append(mix(np.concatenate(own), 4))
                    size += len(held[-1])
                if size > 2_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _count(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, body in zip(batch.column("part").to_pylist(), batch.column("body"), strict=True):
                raw = np.frombuffer(body.as_buffer(), np.uint8).reshape(-1, 3)
                wide = np.zeros((len(raw), 4), np.uint8)
                wide[:, :3] = raw
                if part not in counts:
                    counts[part] = np.zeros(COUNTERS, np.uint32)
                slots, times = np.unique(wide.view(np.uint32).ravel(), return_counts=True)
                counts[part][slots] += times.astype(np.uint32)
        for part, c in counts.items():
            hot = np.flatnonzero(c > least)
            yield _batch(part=pa.array([part], pa.int32()), used=pa.array([int((c > 0).sum())], pa.int64()), total=pa.array([int(c.sum(dtype=np.int64))], pa.int64()), hot=pa.array([hot.tolist()], pa.list_(pa.int64())), times=pa.array([c[hot].tolist()], pa.list_(pa.int64())))

    return run


class Order:
    """A total order of shingles: those not common by hash, then the common ones by count."""

    def __init__(self, parts: int, keys: np.ndarray, times: np.ndarray):
        self.parts = parts
        at = np.argsort(keys)
        self.keys, self.times = keys[at], times[at]

    def prefix(self, s: np.ndarray, n: int) -> np.ndarray:
        if len(self.keys):
            h = mix(s, 4)
            key = ((h % np.uint64(self.parts)).astype(np.int64) * COUNTERS) + ((h // np.uint64(self.parts)) % np.uint64(COUNTERS)).astype(np.int64)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            count = np.where(self.keys[at] == key, self.times[at], 0)
            return s[np.lexsort((s, count))[:n]]
        return s[:n]


def _postings(parts: int, order, light: int):
    """Sends each partition a block's postings: keys (5 bytes), places in the set's order and local documents (2 bytes each), and the block's ids and sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = order.value
        ids, sizes, keys, owner, places, held, seen = [], [], [], [], [], 0, set()

        def flush():
            k, o, place = np.concatenate(keys), np.concatenate(owner), np.concatenate(places)
            to = (k % np.uint64(parts)).astype(np.int32)
            at = np.argsort(to, kind="stable")
            limits = np.searchsorted(to[at], np.arange(parts + 1))
            low = (k[at] // np.uint64(parts)).view(np.uint8).reshape(-1, 8)[:, :5]
            o, place = o[at].astype(np.uint16), place[at]
            all_ids, all_n = np.array(ids, np.int64), np.array(sizes, np.int64)
            rows = []
            for p in range(parts):
                a, b = limits[p], limits[p + 1]
                if a < b:
                    used, local = np.unique(o[a:b], return_inverse=True)
                    rows.append((p, low[a:b].tobytes(), local.astype(np.uint16).tobytes(), place[a:b].tobytes(), all_ids[used].tobytes(), all_n[used].tobytes()))
            return _batch(part=pa.array([r[0] for r in rows], pa.int32()), **{x: pa.array([r[k] for r in rows], pa.binary()) for k, x in enumerate(("keys", "local", "places", "ids", "sizes"), 1)})

        for batch in batches:
            row, doc = 0, batch.column("doc_id").to_pylist()
            for c in chunks(batch.column("text")):
                for s in _sets(c, words(c)):
                    own, at, n = [], [], len(s)
                    same = (n, int(mix(s, 1).sum(dtype=np.uint64)), int(mix(s, 2).sum(dtype=np.uint64)))
                    if n and doc[row] is not None and same not in seen:  # copies of one set stand once
                        seen.add(same)
                        if n <= light:
                            own += [mix(np.array([np.add.reduce(mix(s[list(x)], 6)) for x in combinations(range(n), d)], np.uint64), 100 + d) for d in demanded(n)]
                            at += [np.zeros(len(x), np.int64) for x in own]
                        if n > light or DEN * n >= NUM * (light + 1):
                            own.append(mix(rank.prefix(s, prefix_length(n)), 8))
                            at.append(np.arange(prefix_length(n)))
                    if own:
                        k = np.concatenate(own)
                        places.append(np.minimum(np.concatenate(at), 65535).astype(np.uint16))
                        keys.append(k)
                        owner.append(np.full(len(k), len(ids)))
                        ids.append(doc[row])
                        sizes.append(n)
                        held += len(k)
                    row += 1
                if held > 1_500_000 or len(ids) > BLOCK_DOCS:
                    yield flush()
                    ids, sizes, keys, owner, places, held = [], [], [], [], [], 0
                    seen.clear()
        if keys:
            yield flush()

    return run


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The inverted lists of a partition that hold two documents at least: one row per (list, document).

    A list is named by a hash of its documents; ``times`` tells how many of the partition's lists they are.
    """
    keys, ids, sizes, places = {}, {}, {}, {}
    for batch in batches:
        for r in range(batch.num_rows):
            part = batch.column("part")[r].as_py()
            raw = np.frombuffer(batch.column("keys")[r].as_buffer(), np.uint8).reshape(-1, 5)
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, :5] = raw
            local = np.frombuffer(batch.column("local")[r].as_buffer(), np.uint16)
            keys.setdefault(part, []).append(wide.view(np.uint64).ravel())
            ids.setdefault(part, []).append(np.frombuffer(batch.column("ids")[r].as_buffer(), np.int64)[local])
            places.setdefault(part, []).append(np.frombuffer(batch.column("places")[r].as_buffer(), np.uint16))
            sizes.setdefault(part, []).append(np.frombuffer(batch.column("sizes")[r].as_buffer(), np.int64)[local].astype(np.int32))
    for part in list(keys):
        k, i, n, place = (np.concatenate(x.pop(part)) for x in (keys, ids, sizes, places))
        at = np.argsort(k, kind="stable")
        k = k[at]
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        length = np.diff(np.append(first, len(k)))
        many = length > 1
        at = at[np.repeat(many, length)]
        i, n, place, length = i[at], n[at], place[at].astype(np.int32), length[many]
        if not len(length):
            continue
        # lists of the same documents are one: near copies share most of their lists
        first = np.concatenate([[0], np.cumsum(length)[:-1]])
        name = mix(np.add.reduceat(mix(i.view(np.uint64), 11), first), 12) ^ length.astype(np.uint64)
        _, kept, times = np.unique(name, return_index=True, return_counts=True)
        weight = np.zeros(len(length), np.int32)
        weight[kept] = times
        name, weight = np.repeat(name, length), np.repeat(weight, length)
        # of equal lists, one stays; a document's place is then its least in any of them, which prunes less but loses nothing
        order = np.lexsort((place, i, name))
        name_, i_ = name[order], i[order]
        rows = order[np.append(True, (name_[1:] != name_[:-1]) | (i_[1:] != i_[:-1]))]
        weights = dict(zip(name[weight > 0].tolist(), weight[weight > 0].tolist(), strict=True))
        i, n, name, place = i[rows], n[rows], name[rows], place[rows]
        weight = np.array([weights[x] for x in name.tolist()], np.int32)
        for a in range(0, len(i), 200_000):
            b = a + 200_000
            yield _batch(list=pa.array(name[a:b].view(np.int64), pa.int64()), doc_id=pa.array(i[a:b], pa.int64()), n=pa.array(n[a:b], pa.int32()), place=pa.array(place[a:b], pa.int32()), times=pa.array(weight[a:b], pa.int32()))


def _possible(x: str, y: str) -> Column:
    """Whether sizes and bitmaps of the sides x and y leave a link possible: |A xor B| is at least the bitmaps' distance."""
    apart = sum((F.bit_count(F.col(f"bits{x}")[k].bitwiseXOR(F.col(f"bits{y}")[k])) for k in range(BITMAP // 64)), F.lit(0))
    both = F.col(f"n{x}") + F.col(f"n{y}")
    most = F.least(F.col(f"n{x}"), F.col(f"n{y}"), F.shiftright(both - apart, 1))
    return (DEN + NUM) * most >= NUM * both


def linking(na: np.ndarray, nb: np.ndarray, shared: np.ndarray) -> np.ndarray:
    return DEN * shared >= NUM * (na + nb - shared)


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left set with every right one, by products of their incidence matrices."""
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    tokens, inverse, times = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    common = times > 1
    column = np.cumsum(common) - 1
    own = common[inverse]
    owner, inverse, width = owner[own], column[inverse[own]], int(common.sum())
    out = np.zeros((len(left), len(right)), np.int64)
    step = max(1, 4_000_000 // (len(left) + len(right)))
    order = np.argsort(inverse, kind="stable")
    owner, inverse = owner[order], inverse[order]
    for a in range(0, width, step):
        lo, hi = np.searchsorted(inverse, (a, a + step))
        m = np.zeros((len(left) + len(right), min(step, width - a)), np.float32)
        m[owner[lo:hi], inverse[lo:hi] - a] = 1
        out += np.rint(m[: len(left)] @ m[len(left) :].T).astype(np.int64)
    return out


def _linked_blocks(as_pairs: bool):
    """Of rows sorted by (component, lo, hi), the links between the sets of blocks lo and hi of a component: as pairs
    (a, b), or by set as ``others``: how many documents it links with."""

    def of(rows: list[tuple]) -> Iterator[tuple[np.ndarray, ...]]:
        lo, hi = rows[0][1], rows[0][2]
        left = [x for x in rows if x[3] == lo]
        right = left if lo == hi else [x for x in rows if x[3] == hi]
        if not left or not right:
            return
        n, ids, size = ([np.array([x[k] for x in side], np.int64) for side in (left, right)] for k in (5, 4, 6))
        hit = linking(n[0][:, None], n[1][None, :], _shared([x[7] for x in left], [x[7] for x in right]))
        if lo == hi:
            np.fill_diagonal(hit, False)
        if as_pairs:
            i, j = np.nonzero(np.triu(hit) if lo == hi else hit)
            yield np.minimum(ids[0][i], ids[1][j]), np.maximum(ids[0][i], ids[1][j])
        else:
            yield ids[0], hit @ size[1]
            if lo != hi:
                yield ids[1], size[0] @ hit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("a", "b") if as_pairs else ("id", "others")
        held, key = [], None
        out = lambda found: _batch(**{c: pa.array(x, pa.int64()) for c, x in zip(names, found, strict=True)})
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("component", "lo", "hi", "block", "id", "n", "size")]
            lists = batch.column("shingles")
            for k, row in enumerate(zip(*columns, strict=True)):
                if row[:3] != key:
                    for found in of(held) if held else ():
                        yield out(found)
                    held, key = [], row[:3]
                held.append((*row, lists[k].values.to_numpy(zero_copy_only=False)))
        for found in of(held) if held else ():
            yield out(found)

    return run


def _wanted_sets(filter_bits):
    """The sets of documents whose id falls on a wanted bucket; others can't be in a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = filter_bits.value
        for batch in batches:
            own = batch.filter(pa.array(wanted[batch.column("bucket").to_numpy(zero_copy_only=False)]))
            for c in chunks(own.column("text")):
                sets = list(_sets(c, words(c)))
                k1 = np.array([mix(s, 1).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                limits = np.cumsum([0, *map(len, sets)])
                lists = pa.ListArray.from_arrays(pa.array(limits, pa.int32()), pa.array(np.concatenate(sets).view(np.int64), pa.int64()))
                yield _batch(doc_id=own.column("doc_id").slice(c.first, c.rows), k1=pa.array(k1, pa.int64()), shingles=lists)

    return run


BUCKETS = 1 << 20
#: Rounds of head proposals go on while they find links for this share of the classes in open lists; then the pairs left
#: are enumerated.
CLOSED = 0.005
#: Classes of a list that one join key's left side holds, about.
SLICE = 1024
#: Sets and shingles of a block of a component, about.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 200_000
#: Pairs that ask for one copy of a set, about.
COPY = 256
#: A link of x and y in a list shares at most what either has from its place in the list on.
NEAR = f"{NUM} * nx <= {DEN} * ny and {NUM} * ny <= {DEN} * nx and {DEN + NUM} * least(nx - px, ny - py) >= {NUM} * (nx + ny)"


class Join:
    """The join's steps over one table of documents; each step is a table in the shared folder."""

    def __init__(self, docs: DataFrame):
        self.spark = docs.sparkSession
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.parts = shards(self.spark)
        self.digest = table(self.docs.mapInArrow(_digest, "doc_id long, n long, k1 long, k2 long, bits array<long>"), "digest")
        key = ["n", "k1", "k2"]
        classes = self.digest.where("n > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep"))
        # a document's class is its set's least id
        self.member = table(self.digest.select("doc_id", *key).join(classes, key, "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")), "member")
        heads = self.digest.where("n > 0 and doc_id is not null").join(classes.withColumnRenamed("rep", "doc_id"), [*key, "doc_id"])
        self.heads = table(heads.select("doc_id", "n", "k1", "bits").dropDuplicates(["doc_id"]), "heads")

    def order(self) -> tuple[Order, float]:
        packed = self.docs.select("text").mapInArrow(_packed_counts(self.parts), "part int, body binary")
        counts = table(packed.repartition(self.parts, "part").mapInArrow(_count(COMMON), "part int, used long, total long, hot array<long>, times array<long>"), "counts")
        used, total = counts.agg(F.coalesce(F.sum("used"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
        pairs = counts.select("part", F.explode(F.arrays_zip("hot", "times")).alias("x")).select("part", "x.hot", "x.times")
        least = COMMON
        while pairs.where(F.col("times") > least).count() > MAX_COMMON:
            least *= 2
        rows = pairs.where(F.col("times") > least).toPandas()
        keys = rows["part"].to_numpy(np.int64) * COUNTERS + rows["hot"].to_numpy(np.int64)
        return Order(self.parts, keys, rows["times"].to_numpy(np.int64)), total / max(1, used)

    def lists(self) -> DataFrame:
        order, mean = self.order()
        histogram = {r.n: r["count"] for r in self.heads.where(F.col("n") <= 2 * MAX_LIGHT).groupBy("n").count().collect()}
        self.boundary = boundary_by_cost(histogram, mean)
        packed = self.docs.mapInArrow(_postings(self.parts, self.spark.sparkContext.broadcast(order), self.boundary), "part int, keys binary, local binary, places binary, ids binary, sizes binary")
        found = packed.repartition(self.parts, "part").mapInArrow(_lists, "list long, doc_id long, n int, place int, times int")
        found = found.groupBy("list", "doc_id", "n").agg(F.min("place").alias("place"), F.sum("times").alias("times"))
        found = found.join(self.member.select("doc_id", "rep"), "doc_id")
        return table(found.groupBy("list", F.col("rep").alias("id"), "n").agg(F.min("place").alias("place"), F.max("times").alias("times")), "lists")

    def keep_sets(self, lists: DataFrame) -> None:
        """Writes the sets of the classes in ``lists``, made anew from the texts, bucketed by id: later joins move pairs, not sets.

        The tasks are told BUCKETS bits, of which those of the wanted ids are set; with many ids that filters less, and
        the join alone decides.
        """
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")
        ends = lists.select(F.col("id").alias("doc_id")).distinct()
        wanted = np.zeros(BUCKETS, bool)
        for r in ends.select(bucket.alias("k")).distinct().toLocalIterator():
            wanted[r.k] = True
        sets = self.docs.where("doc_id is not null").withColumn("bucket", bucket).mapInArrow(_wanted_sets(self.spark.sparkContext.broadcast(wanted)), "doc_id long, k1 long, shingles array<long>")
        # with repeated ids, a class's id may name rows of other texts too: the class's set is the one with its hash
        own = self.heads.join(ends, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.col("k1").alias("own"))
        sets = sets.join(own, F.expr("doc_id = id and (k1 ^ own) = 0")).select("id", "shingles")
        self.sets = bucketed(sets.repartition(self.parts, "id"), "id", "sets")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of proposed pairs (a, b) of class ids those that link, as a table. Many pairs may have one b: its set is dealt in copies."""
        left, right = (self.heads.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}")) for x in "ab")
        possible = table(pairs.join(left, "a").join(right, "b").where(_possible("a", "b")).select("a", "b"), "possible")
        copies = possible.groupBy("b").agg(F.ceil(F.count("*") / COPY).cast("int").alias("copies"))
        dealt = possible.join(copies, "b").withColumn("copy", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int"))
        sets = self.sets
        right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")).join(copies, "b")
        right = right.select("b", "sb", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
        left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
        both = dealt.join(left, "a").join(right, ["b", "copy"]).withColumn("both", F.size(F.array_intersect("sa", "sb")))
        linked = table(both.where(f"{DEN} * both >= {NUM} * (size(sa) + size(sb) - both)").select("a", "b").distinct(), "linked")
        drop(possible)
        return linked

    def components(self) -> DataFrame:
        """Every class that links with another: ``(node, component)``, by verified links alone."""
        lists = self.lists()
        near = F.expr(NEAR)
        side = lambda rows, s, *more: rows.select("list", *(F.col(k).alias(f"{to}{s}") for k, to in (("id", "id"), ("n", "n"), ("place", "p"), ("times", "t"), ("c", "c"))), *more)
        self.keep_sets(lists)
        known, now = None, lists.withColumn("c", F.col("id"))
        for turn in count():
            # each round proposes every set to the head, another each time, of the list it shares most with in another component
            salt = F.xxhash64("id", F.lit(turn)) if turn else F.col("n").cast("long")
            head = now.groupBy("list").agg(F.min(F.struct(salt.alias("salt"), "id", "n", "place", "times", "c")).alias("h")).select("list", "h.*")
            both = side(now, "x").join(side(head, "y"), "list").where(near & F.expr("cx <> cy"))
            best = both.groupBy("idx", "idy").agg(F.sum("tx").alias("times")).groupBy("idx").agg(F.max(F.struct("times", "idy")).alias("best"))
            links = self.verified(best.select(F.col("idx").alias("a"), F.col("best.idy").alias("b")))
            found = links.count()
            known = extended(known, links) if found or known is None else known
            drop(links, *([now] if turn else []))
            now = lists.join(known.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
            open_ = now.groupBy("list").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.ceil(F.count("*") / SLICE).cast("int").alias("slices")).where("c1 <> c2").select("list", "slices")
            now = table(now.join(open_, "list"), "open")
            if found <= CLOSED * now.select("id").distinct().count():
                break
        # sets of one list that still lie in different components are the pairs left, a list's left side dealt in slices
        rest = now.join(self.heads.select(F.col("doc_id").alias("id"), "bits"), "id")
        x = side(rest, "x", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("slice"), F.col("bits").alias("bitsx"))
        y = side(rest, "y", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.col("bits").alias("bitsy"))
        pairs = x.join(y, ["list", "slice"]).where(F.expr("cx < cy") & near & _possible("x", "y")).select(F.col("idx").alias("a"), F.col("idy").alias("b"))
        links = self.verified(pairs.distinct())
        known = extended(known, links)
        drop(links, now, lists)
        return known

    def _blocks(self, found: DataFrame) -> DataFrame:
        """The sets of each component, dealt in blocks: a row per pair of blocks (lo, hi), lo <= hi, that a set is in."""
        of = self.heads.join(found.withColumnRenamed("node", "doc_id"), "doc_id").select(F.col("doc_id").alias("id"), "n", "component")
        blocks = F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
        of = of.join(of.groupBy("component").agg(blocks), "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        rows = of.join(self.sizes(), "id").join(self.sets, "id").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select("component", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "id", "n", "size", "shingles")
        return rows.repartition(self.parts, "component", "lo", "hi").sortWithinPartitions("component", "lo", "hi")

    def sizes(self) -> DataFrame:
        return self.member.where("n > 0 and doc_id is not null").groupBy(F.col("rep").alias("id")).agg(F.count("*").alias("size"))

    def links(self) -> DataFrame:
        """Every pair (a, b), a < b, of classes that link; ``member`` names the documents of a class."""
        return self._blocks(self.components()).mapInArrow(_linked_blocks(True), "a long, b long")

    def result(self) -> DataFrame:
        found = self.components()
        others = self._blocks(found).mapInArrow(_linked_blocks(False), "id long, others long").groupBy(F.col("id").alias("rep")).agg(F.sum("others").alias("others"))
        size = self.sizes().withColumnRenamed("id", "rep")
        of = size.join(others, "rep", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("links", F.col("size") - 1 + F.coalesce("others", F.lit(0)))
        of = table(of, "classes")
        drop(self.sets)
        n_links = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("links")).otherwise(0)
        return self.member.join(of, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"), n_links.cast("long").alias("n_links"))

    def grouped(self) -> DataFrame:
        """``(doc_id, component_id)``, by the links that components need."""
        found = self.components().withColumnRenamed("node", "rep")
        drop(self.sets)
        return self.member.join(found, "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``n_shingles``, ``component_id``, the least id reachable by
    links, and ``n_links``, how many other rows with an id its text links with. ``Join.links`` has the links themselves.

    A null or empty text, or one of white space only, has an empty set and is linked with nothing. Very long texts are
    taken whole. Rows with equal sets share a class, repeated rows too. A row without id keeps a null component. An
    empty table gives no rows. Other columns aren't read.
    """
    return Join(docs).result()


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose id is their component's least; of repeated ids all rows stay."""
    found = Join(docs).grouped()
    drop = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
