"""The operators on small tables: brute force where SQL can't say it, and odd rows everywhere."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import decontaminate, jaccard_join, line_dedup, mixing, ngram_trie, quality_rules, rotation, token_counts
from scriptorium.llm.words import chunks

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component long"
BASE = " ".join(f"word{k} and{k % 7}" for k in range(60))
ROWS = [
    (1, BASE, "en", "a", 1, 0),
    (2, BASE.upper(), "en", "a", 1, 0),
    (3, BASE + " more", "en", "b", 1, 0),
    (4, None, None, None, None, None),
    (5, "", "en", "b", 0, 0),
    (6, " \n\t ", "de", None, 3, 0),
    (7, "one two", "xx", "b", 7, 0),
    (7, "one two", "xx", "b", 7, 0),
    (8, "ünï çödé ▁ \x00 z" + "x" * 9000, "fr", "c", 1, 0),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_jaccard_join(docs, empty):
    got = {(r.doc_id, r.component_id, r.n_shingles) for r in jaccard_join.near_duplicates(docs).collect()}
    assert {(1, 1, 116), (2, 1, 116), (3, 1, 117), (5, 5, 0), (7, 7, 1)} <= got
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_small_sets_link_by_subsets(spark):
    words = [f"w{k}" for k in range(14)]
    texts = [" ".join(words[:13]), " ".join(words), " ".join(words[1:]), " ".join(words[:6]), " ".join(words[:5])]
    d = spark.createDataFrame([(k, t, "en", "a", 1, 0) for k, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(d).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}  # 9 of 10 and 9 of 10 shingles; 1 of 2


def test_every_link_is_found(spark, docs, empty):
    words = [f"w{k}" for k in range(130)]
    texts = [" ".join(words[3 * k : 3 * k + 100]) for k in range(8)] + [" ".join(words[:100]), " ".join(words[:13]), " ".join(words[:14]), "", None]
    shingles = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in ((x or "").split() for x in texts)]
    like = lambda a, b: len(a & b) >= 0.8 * len(a | b) > 0
    want = {i: sum(i != j and like(a, b) for j, b in enumerate(shingles)) for i, a in enumerate(shingles)}
    d = spark.createDataFrame([(k, x, "en", "a", 1, 0) for k, x in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in jaccard_join.near_duplicates(d).collect()}
    assert {k: r.n_links for k, r in got.items()} == want and want[3] == 7
    assert {r.component_id for k, r in got.items() if k < 9} == {0}
    assert {(r.a, r.b) for r in jaccard_join.Join(d).links().collect()} == {(i, j) for j in range(13) for i in range(j) if j != 8 and like(shingles[i], shingles[j])}
    assert {r.doc_id for r in jaccard_join.distinct_documents(d).collect()} == {0, 9, 11, 12}
    assert {(r.doc_id, r.n_links) for r in jaccard_join.near_duplicates(docs).collect()} >= {(1, 2), (4, 0), (5, 0), (7, 1)}
    assert jaccard_join.Join(empty).links().count() == 0


def removed(d):
    return {(r.doc_id, r.pos) for r in line_dedup.removed_lines(d).collect()}


def test_lines(docs, empty):
    assert removed(docs) == {(3, 0)}  # 3 repeats 1 closely; 2 differs in case; equal rows are one
    assert line_dedup.deduplicate_lines(docs).count() == docs.count() - 1
    assert line_dedup.deduplicate_lines(empty).count() == 0 and removed(empty) == set()


def test_lines_of_crowded_buckets(spark):
    """Pairs of near copies in buckets that many of them share: each pair must be found, whatever the heads are."""
    rng = np.random.default_rng(3)
    lines = []
    for _ in range(150):
        own = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 18))
        lines += [f"this passage opens every one of the lines in the table, as templates do, and then comes {own}", f"this passage opens every one of the lines in the table, as templates do, and then comes {own}."]
    sets = [{x[k : k + 5] for k in range(len(x) - 4)} for x in lines]
    like = {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert like == {(2 * k, 2 * k + 1) for k in range(150)}
    d = spark.createDataFrame([(k, x, "en", "a", 1, 0) for k, x in enumerate(lines)], SCHEMA)
    assert removed(d) == {(2 * k + 1, 0) for k in range(150)}


def test_removed_lines_against_brute_force(spark):
    """On a real table: removals are those of exact components, but for links that the banding misses."""
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    places = sorted((r["doc_id"], k, x) for r in rows for k, x in enumerate((r["text"] or "").split("\n")) if x.strip())
    lines = list(dict.fromkeys(x for _, _, x in places))
    sets = [{x[k : k + 5] for k in range(len(x) - 4)} for x in lines]
    owners: dict[str, list[int]] = {}
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j, s in enumerate(sets):
        shared = Counter(i for g in s for i in owners.get(g, ()))
        for i, n in shared.items():
            if n >= 0.8 * (len(s) + len(sets[i]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for g in s:
            owners.setdefault(g, []).append(j)
    first, want = {}, set()
    index = {x: k for k, x in enumerate(lines)}
    for doc, pos, x in places:
        if first.setdefault(find(index[x]), (doc, pos)) != (doc, pos):
            want.add((doc, pos))
    got = removed(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert len(want) > 50 and got <= want and len(got) >= 0.98 * len(want)


def test_lines_of_odd_rows(spark):
    """Repeated ids of other texts, null ids, ties, clashing names."""
    line = "a line of some length that stands in several of the rows"
    rows = [(1, line, 5, 7), (1, f"other\n{line}", 5, 7), (None, line, 1, 1), (2, None, 0, 0), (3, "", 0, 0), (3, "", 0, 0), (4, f"{line}\n{line}\nend", 0, 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, gone long, cut_id long")
    out = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in line_dedup.deduplicate_lines(d).select("doc_id", "text", "gone", "cut_id").collect()))
    assert out == [(False, 0, line), (True, 1, "other"), (True, 2, ""), (True, 3, ""), (True, 3, ""), (True, 4, "end")]
    clash = d.select("doc_id", "text", *(F.lit(k).alias(c) for k, c in enumerate(("cut_hash", "new_text", "row", "pos", "line", "h1", "text_hash", "component"))))
    got = line_dedup.deduplicate_lines(clash)
    assert got.columns == clash.columns and got.count() == 6 and got.select("new_text").distinct().collect()[0][0] == 1


def test_short_lines(spark):
    texts = ["Share this page\nok\n\n \n\u00fcber", "Share this page\nok\n\n \nabc", "Share this page!\nok.\n\t\nabd", "Share this\n\u00fcber"]
    d = spark.createDataFrame([(k, x, "en", "a", 1, 0) for k, x in enumerate(texts)], SCHEMA)
    assert removed(d) == {(1, 0), (1, 1), (2, 0), (3, 1)}  # 11 of 12 shingles are shared; blank lines stay


def test_quality(docs, empty):
    got = {r.doc_id: r for r in quality_rules.verdicts(docs).collect()}
    assert got[1].n_words == 120 and not got[1].base_failed and got[4].n_words == 0 and got[4].base_failed
    assert quality_rules.verdicts(empty).count() == 0 and quality_rules.filter_documents(empty).count() == 0
    assert quality_rules.repeated_words(np.arange(8, dtype=np.uint64).repeat(1)) == 0
    assert quality_rules.repeated_words(np.tile(np.arange(9, dtype=np.uint64), 2)) == 18


def test_decontamination(spark, docs, empty):
    item = " ".join(f"question{k} asks{k}" for k in range(8))
    b = spark.createDataFrame([(1, item), (2, None), (3, "short")], "item_id long, text string")
    d = docs.unionByName(spark.createDataFrame([(20, "before " + item.upper().replace("QUESTION3", "QUESTIOM3") + ", after", "en", "a", 1, 0)], SCHEMA))
    assert [r.doc_id for r in decontaminate.matches(d, b).where("size(item_ids) > 0").collect()] == [20]
    assert decontaminate.clean_documents(d, b).count() == len(ROWS)
    assert decontaminate.matches(empty, b).count() == 0


def test_passages_of_thirteen_words_are_found(spark):
    words = [f"{chr(97 + k % 26)}{k * 7919 % 997}{'xyz'[k % 3] * (k % 4)}" for k in range(60)]
    b = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    rows = [(k, f"before {' '.join(words[k : k + 13])} after", "en", "a", 1, 0) for k in range(48)]
    rows += [(100 + k, f"before {' '.join(words[k : k + 5])} after", "en", "a", 1, 0) for k in range(56)]
    found = decontaminate.matches(spark.createDataFrame(rows, SCHEMA), b).where("size(item_ids) > 0")
    assert sorted(r.doc_id for r in found.collect()) == list(range(48))


def test_token_counts_are_the_library_s(docs):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in token_counts.count_tokens(docs, path).collect():
        text = next(x[1] for x in ROWS if x[0] == r.doc_id) or ""
        assert r.n_tokens == len(model.encode(text)) and r.n_bytes == len(text.encode())


def test_mix(docs, empty):
    rows = mixing.plan_mix(docs).collect()
    assert len(rows) == len(ROWS) and all(r.taken <= 3 * r.size for r in rows)
    assert mixing.plan_mix(empty).count() == 0
    assert mixing.targets([10, 10, 100], [5, 2, 1]) == [30.0, 30.0, 60.0]
    n = np.array([3, 5, 11])
    assert int((n * mixing.fill(n, np.array([4, 4, 4]), 30)).sum()) == 30


def test_fill_takes_long_documents():
    words = lambda lengths, counts, budget: int((np.array(lengths) * mixing.fill(np.array(lengths), np.array(counts), budget)).sum())
    assert words([140_000], [10], 150_000) == 140_000
    assert words([140_000], [10], 990_000) == 980_000
    assert words([100_000, 140_000], [2, 1], 200_000) == 200_000
    assert words([7, 500_000], [3, 4], 1_100_000) == 1_000_021


def test_elias_fano():
    rng = np.random.default_rng(1)
    v = np.unique(rng.integers(0, 10**9, 5000))
    e = ngram_trie.EliasFano(*(ngram_trie.EliasFano.build(v, 10**9)[k] for k in ("head", "high", "low")))
    assert (e.values() == v).all() and (e.find(v) == np.arange(len(v))).all()
    assert (e.find(np.setdiff1d(v + 1, v)) == -1).all()


def test_ngram_scores(docs, empty):
    rows = ngram_trie.score_corpus(docs).collect()
    assert len(rows) == len(ROWS) and all(r.score <= 0 and r.n_tokens >= 1 for r in rows)
    assert ngram_trie.score_corpus(empty).count() == 0


def test_rotation(spark):
    t = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, None, "x")], "conv_id long, turn long, role string, text string")
    rows = rotation.rotate(t).collect()
    assert len(rows) == 12 and {r.speaker for r in rows} == {"ann", "bob", "unknown"}
    for s in ("ann", "bob", "unknown"):
        own = sorted((r for r in rows if r.speaker == s), key=lambda r: r.start_char)
        text = "".join(r.segment for r in own)
        assert [r.end_char for r in own][-1] == len(text)
        assert [text[r.mask_start : r.mask_end] for r in own if r.role == "assistant"] == [re.sub("^.*\n", "", next(r.segment for r in own if r.name == s), count=1)]


def test_words_match_the_pattern():
    import pyarrow as pa

    from scriptorium.llm.words import words

    texts = ["a b", "", None, "c\x0bd", "e", " f "]
    counts = [n for c in chunks(pa.array(texts), 4) for n in np.diff(words(c).bounds).tolist()]
    assert counts == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_line_signatures(spark):
    """Minima by brute force: bands are equal where their minima are, and bytes show which are."""
    texts = ["abcdefg", "abcdefgh", "żółć jest", "aaaaaa"]
    d = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "h1 long, line string")
    rows = {r.h1: r for r in line_dedup.signatures(d).collect()}
    halves = {g: r for g, r in ((g, spark.sql(f"SELECT xxhash64(encode('{g}', 'UTF-32')) AS h").first().h) for t in texts for g in (t[k : k + 5] for k in range(len(t) - 4)))}
    signed = lambda x: (x & 0xFFFFFFFF) - ((x & 0x80000000) << 1)
    minima = {}
    for n, t in enumerate(texts):
        hashes = [halves[t[k : k + 5]] for k in range(len(t) - 4)]
        minima[n] = [min(signed((h >> 32 if k % 2 == 0 else h) ^ (((k // 2) << 28) + 0x0783D9AB)) for h in hashes) for k in range(16)]
        assert [rows[n][f"g{k // 8}"] >> (8 * (k % 8)) & 255 for k in range(16)] == [m & 255 for m in minima[n]]
    for a in range(4):
        for b in range(a):
            for k, own in enumerate(line_dedup.BANDS):
                assert (rows[a][f"b{k}"] == rows[b][f"b{k}"]) == all(minima[a][m] == minima[b][m] for m in own)


def test_near_lines_are_found(spark):
    import random

    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(400)]
    lines = [" ".join(rng.choices(words, k=20)) for _ in range(60)]
    near = [line[:70] + "#" + line[71:] for line in lines]
    d = spark.createDataFrame([(k, t, "en", "a", 1, 0) for k, t in enumerate(lines + near)], SCHEMA)
    assert removed(d) == {(k, 0) for k in range(60, 120)}


def kept_by_brute_force(lines):
    """How many lines are the first of their component, by all pairs."""
    sets = [{x[k : k + 5] for k in range(len(x) - 4)} for x in lines]
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j in range(len(lines)):
        for i in range(j):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(k) for k in range(len(lines))}


def test_families_of_near_lines(spark):
    """Lines that differ from a common one in a few characters, and from each other in about twice as many."""
    import random

    rng = random.Random(9)
    lines = []
    for _ in range(40):
        base = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=120))
        for _ in range(25):
            own = list(base)
            for at in rng.sample(range(120), rng.randint(1, 4)):
                own[at] = rng.choice("ABCDEFGH")
            lines.append("".join(own))
    want = set(range(len(lines))) - kept_by_brute_force(lines)
    d = spark.createDataFrame([(k, t, "en", "a", 1, 0) for k, t in enumerate(lines)], SCHEMA)
    got = {k for k, _ in removed(d)}
    assert got <= want and len(want) > 300 and len(got) >= 0.98 * len(want)


def test_lines_beyond_the_basic_plane(spark):
    import random

    rng = random.Random(2)
    lines = []
    for _ in range(40):
        base = "".join(rng.choices("\U0001f600\U0001f601\U0001f602\U0001f603abcdefgh\u00e9", k=60))
        lines += [base, base[:30] + "#" + base[31:], base[:5] + "".join(rng.choices("xyz", k=14)) + base[19:]]
    want = set(range(len(lines))) - kept_by_brute_force(lines)
    d = spark.createDataFrame([(k, t, "en", "a", 1, 0) for k, t in enumerate(lines)], SCHEMA)
    got = {k for k, _ in removed(d)}
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) >= 40


def test_elias_fano_dense_runs_and_repeats():
    rng = np.random.default_rng(2)
    v = np.unique(np.concatenate([np.arange(0, 5000, 2), rng.integers(0, 10**10, 3000)]))  # a full bucket beside sparse ones
    e = ngram_trie.EliasFano(**ngram_trie.EliasFano.build(v, 10**10))
    assert (e.find(v) == np.arange(len(v))).all() and (e.find(np.setdiff1d(np.arange(5000), v)) == -1).all()
    w = np.sort(rng.integers(0, 500, 2000))
    assert (ngram_trie.EliasFano(**ngram_trie.EliasFano.build(w, 501)).values() == w).all()


def test_ngram_scores_match_brute_force(spark):
    texts = [(k, " ".join(f"w{(k * j) % (5 + k % 7)}" for j in range(1 + k % 23))) for k in range(60)]
    got = {r.doc_id: r for r in ngram_trie.score_corpus(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    train = [t.split() + ["</s>"] for k, t in texts if not got[k].held_out]
    one, two, ctx = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(t, t[1:])), Counter(w for t in train for w in t[:-1])
    three = Counter(p for t in train for p in zip(t, t[1:], t[2:]))
    types3, ctx3 = Counter(x[:2] for x in three), Counter()
    for x, n in three.items():
        ctx3[x[:2]] += n
    types, total = Counter(v for v, _ in two), sum(one.values())
    for k, t in texts:
        words = t.split() + ["</s>"]
        p1 = [(one[w] + 1) / (total + len(one) + 1) for w in words]
        p = p1[:1] + [(two[v, w] + types[v] * q) / (ctx[v] + types[v]) if ctx[v] else q for v, w, q in zip(words, words[1:], p1[1:])]
        for i, x in enumerate(zip(words, words[1:], words[2:]), 2):
            if ctx3[x[:2]]:
                p[i] = (three[x] + types3[x[:2]] * p[i]) / (ctx3[x[:2]] + types3[x[:2]])
        assert abs(got[k].base_score - sum(map(math.log10, p1))) < 1e-6
        assert abs(got[k].score - sum(map(math.log10, p))) < 0.05 * len(words)  # 8-bit probabilities
