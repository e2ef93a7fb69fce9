"""Brute force, SQL and odd rows for substring deduplication, ranked lexical search and embedding whitening."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import lexical, substring, whitening
from scriptorium.llm.queries import oracle_sql, queries

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("name", ["op11_substring_dedup", "op12_lexical_search"])
def test_queries_match_their_sql(spark, name):
    own = duckdb.connect()
    for t in ("documents", "benchmark"):
        own.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    want = own.execute(oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries()[name](spark, DIR).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


# Substring deduplication


def passages_left(rows):
    """By brute force: (id, words, removed, words kept) of each row."""
    least = {}
    for i, text in rows:
        w = WORD.findall(text or "")
        for p in range(len(w) - 49):
            if i is not None:
                least[tuple(w[p : p + 50])] = min(i, least.get(tuple(w[p : p + 50]), i))
    out = []
    for i, text in rows:
        w = WORD.findall(text or "")
        gone = {q for p in range(len(w) - 49) if i is not None and least[tuple(w[p : p + 50])] < i for q in range(p, p + 50)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def some_documents(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abé", k=rng.randint(1, 3)))
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 75, 120, 400)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += rng.choice(passages)[rng.randint(0, 3) :] if rng.random() < 0.6 else [word() for _ in range(rng.randint(0, 90))]
        if w and rng.random() < 0.3:
            w[rng.randrange(len(w))] = word()
        rows.append((i * 7 % 61, "".join(x + rng.choice([" ", "\n", "\t \x0b"]) for x in w)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_repeated_passages_as_by_brute_force(spark, seed):
    rows = some_documents(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, substring.without_repeats(docs).collect())) == sorted(passages_left(rows))


def test_repeated_passages_of_odd_rows(spark):
    passage = " ".join(f"w{k}" for k in range(60))
    periodic = "la " * 200
    rows = [(None, passage), (None, None), (1, None), (2, ""), (3, " \n\t"), (4, passage), (4, passage), (4, "x " + passage), (9, passage), (9, passage), (5, passage.replace("w3 ", "W3 ")), (6, periodic), (7, periodic + passage), (8, passage.replace(" ", " ")), (10, passage.replace(" ", " ")), (-3, "a b c")]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, h1 string, at int")
    got = sorted(map(tuple, substring.without_repeats(docs).collect()), key=str)
    assert got == sorted(passages_left(rows), key=str)
    assert substring.without_repeats(docs.limit(0)).count() == 0


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    """With far fewer cells than anchors all estimates are high; the exact grouping still decides."""
    rows = some_documents(5)
    monkeypatch.setattr(substring, "LEAST_CELLS", 16)
    monkeypatch.setattr(substring, "MOST_CELLS", 64)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, substring.without_repeats(docs).collect())) == sorted(passages_left(rows))


def test_estimates_are_never_too_low():
    rows = some_documents(8)
    shape = substring.Shape(1 << 18)
    batch = lambda part: pa.RecordBatch.from_pydict({"text": [t for _, t in part]})
    cells = Counter()
    for part in (rows[:30], rows[30:]):
        for piece in substring._pieces(shape)(iter([batch(part)])):
            for s, own in zip(piece["segment"].to_pylist(), piece["cells"].to_pylist(), strict=True):
                cells.update((s, int(c)) for c in np.frombuffer(own, np.uint32))
    seen = Counter(tuple(WORD.findall(t)[p : p + 50]) for _, t in rows for p in range(len(WORD.findall(t)) - 49))
    for c in substring.chunks(pa.array([t for _, t in rows])):
        w = substring.Windows(c)
        anchor = np.repeat(w.anchor, w.length)
        for k, (start, row) in enumerate(zip(w.start.tolist(), w.row.tolist(), strict=True)):
            own = WORD.findall(rows[row + c.first][1])[start - w.bounds[row] :][:50]
            for r in range(substring.ROWS):
                cell = int(shape.cells(anchor[k : k + 1], r)[0])
                count = cells[(r * shape.segments + (cell >> shape.inner), cell & ((1 << shape.inner) - 1))]
                assert count >= min(2, seen[tuple(own)]) or seen[tuple(own)] == 1


# Ranked lexical search


def ranked(docs, items, k):
    lower = lambda t: TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    own = [(i, Counter(lower(t))) for i, t in docs]
    total, n_docs = sum(sum(c.values()) for _, c in own), sum(bool(c) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in own:
            n = sum(c.values())
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * (75 + 25 * n * n_docs // total))) for t in lower(text) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k], 1)]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_search_as_by_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_BYTES", 700)  # so that a task's threshold meets later shards
    rng = random.Random(seed)
    vocabulary = ["the", "of"] * 20 + [f"t{k}" for k in range(60)] + ["É", "é", "naïve", "日本", "x2"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", "-", "\x7f", "_ "]) for _ in range(n))
    docs = [(rng.randrange(500), text(rng.choice([0, 1, 5, 40, 300]))) for _ in range(150)] + [(None, "t1 t2"), (None, "t1 t2"), (7, None), (8, "?!"), (9, "THE THE t3")]
    items = [(k, text(rng.choice([0, 1, 3, 30]))) for k in range(12)] + [(12, None), (None, "t1 t1 t2"), (13, "nowhere"), (13, "t5")]
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item long").repartition(3)
    index = lexical.build_index(d)
    for k in (1, 7, 1000):
        got = sorted(map(tuple, lexical.search(index, spark.createDataFrame(items, "item_id long, text string"), k).collect()), key=str)
        assert got == sorted(ranked(docs, items, k), key=str)


def test_search_in_turns_of_items_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ITEMS_AT_ONCE", 2)
    monkeypatch.setattr(lexical, "ITEM_BYTES", 10)
    docs = [(i, f"a{i % 5} b{i % 3} c") for i in range(40)]
    items = [(k, f"a{k} b{k} c") for k in range(9)]
    index = lexical.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, lexical.search(index, asked, 4).collect())) == sorted(ranked(docs, items, 4))
    assert lexical.search(index, asked.limit(0)).count() == 0
    empty = lexical.build_index(spark.createDataFrame([], "doc_id long, text string"))
    assert lexical.search(empty, asked).count() == 0


# Whitening


def test_digit_slices_are_exact():
    rng = random.Random(3)
    for bits in (3, 21, 50, 62, 90, 140):
        y = np.array([[rng.randint(-(2**bits), 2**bits) for _ in range(4)] for _ in range(30)], np.int64 if bits <= 62 else object)
        p = whitening.Products(4)
        p.add(y)
        p.add(y[:7])
        want = [[sum(int(a) * int(b) for a, b in zip(list(y[:, i]) + list(y[:7, i]), list(y[:, j]) + list(y[:7, j]), strict=True)) for j in range(4)] for i in range(4)]
        assert p.settle().tolist() == want
        for row in want:
            for v in row:
                assert sum(d << whitening.DIGIT_BITS * k for k, d in enumerate(whitening._digits(v, 16))) == v


def covariance(rows):
    """n, S and the covariance of the distinct integer vectors, as fractions."""
    fit = sorted({tuple(math.floor(256 * float(c)) for c in v) for v in rows})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = [[n * c - s for c, s in zip(v, sums, strict=True)] for v in fit]
    return n, sums, [[Fraction(sum(v[i] * v[j] for v in y), n**3) for j in range(len(sums))] for i in range(len(sums))]


@pytest.mark.parametrize("scale", [1.0, 1e9, 1e-2])
def test_whitening_as_by_fractions(spark, scale):
    rng = np.random.default_rng(5)
    rows = (rng.normal(size=(120, 6)) * np.array([9, 5, 3, 2, 1, 0.5]) * scale).astype(np.float32)
    rows = np.concatenate([rows, rows[:40], rows[:1].repeat(30, 0)])
    data = [(k, v.tolist()) for k, v in enumerate(rows)] + [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5), (904, [1.0, 2.0]), (905, []), (None, rows[3].tolist())]
    d = spark.createDataFrame([(i, v, "x") for i, v in data], "vec_id long, embedding array<float>, n string").repartition(3)
    got = whitening.whiten(d).collect()
    kept = [(i, v) for i, v in data if v is not None and len(v) == 6 and all(c is not None and math.isfinite(c) for c in v)]
    n, sums, cov = covariance([v for _, v in kept])
    assert len(got) == 4 * len(kept) and {r.n for r in got} == {n}
    trace = sum(cov[i][i] for i in range(6))
    values, vectors = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
    by_row = {}
    for r in got:
        by_row.setdefault(r.vec_id, {})[r.component] = r
    sign = None
    for i, v in kept:
        y = [n * math.floor(256 * float(c)) - s for c, s in zip(v, sums, strict=True)]
        for c in (1, 2, 3, 4):
            r = by_row[i][c]
            far = sum(a * a for a in y)
            assert r.deviation == (far if far < 2**63 else None)
            assert r.explained == pytest.approx(values[-c] / float(trace), rel=1e-9) and r.identity_error < 1e-9
        w = [by_row[i][c].whitened for c in (1, 2, 3, 4)]
        want = [sum(a * b for a, b in zip(y, vectors[:, -c], strict=True)) / n / math.sqrt(values[-c]) for c in (1, 2, 3, 4)]
        sign = sign or [math.copysign(1, a * b) for a, b in zip(w, want, strict=True)]
        assert w == pytest.approx([s * x for s, x in zip(sign, want, strict=True)], abs=1e-8)


def test_whitening_of_few_and_flat_vectors(spark):
    of = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id string, embedding array<double>")).collect()
    assert of([]) == [] and of([("a", None), ("b", [])]) == []
    one = of([("a", [1.0, 2.0]), ("b", [1.0, 2.0])])
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one if r.vec_id == "a"] == [(1, 1, 0, None, 0.0, None), (2, 1, 0, None, 0.0, None)]
    flat = sorted(of([("a", [0.0, 0.0, 5.0]), ("b", [1.0, 0.0, 5.0])]), key=lambda r: (r.vec_id, r.component))
    assert [abs(r.whitened) if r.whitened is not None else None for r in flat[:3]] == [pytest.approx(1), None, None]
    assert flat[0].explained == pytest.approx(1) and flat[0].deviation == 256**2 and flat[0].identity_error < 1e-12
    huge = of([("a", [1e300, 0.0]), ("b", [-1e300, 1.0]), ("c", [0.0, 0.0])])
    assert len(huge) == 6 and all(r.deviation is None or r.deviation >= 0 for r in huge)


def test_hash_of_nothing_is_that_of_the_empty_text(spark):
    row = substring.op11_substring_dedup(spark, DIR).where("n_words = n_removed").first()
    assert row is None or row.kept_sha256 == hashlib.sha256(b"").hexdigest()


def test_an_index_file_holds_few_shards(spark):
    """Rows of megabytes are held by the file on writing and reading, so that files of many shards need any heap."""
    text = F.repeat(F.concat(F.lit("word"), F.col("id").cast("string"), F.lit(" ")), 800_000)
    d = spark.range(6).coalesce(1).select(F.col("id").alias("doc_id"), text.alias("text"))
    index = lexical.build_index(d)
    sizes = [r["count"] for r in index.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 6 and max(sizes) <= lexical.FILE_SHARDS
