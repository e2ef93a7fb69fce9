"""Brute force and odd rows for decontamination, quality rules, budget mixing, token counts, co-training and the pipeline."""

import importlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from scriptorium.llm import cotraining, decontaminate, jaccard_join, mixing, quality_rules, rotation, token_counts
from scriptorium.llm.queries import oracle_sql

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Decontamination


def plain(text):
    return re.sub(r"[^a-z0-9\x80-\U0010ffff]+", " ", text.lower()).strip()


def test_all_short_edits_are_found_by_the_lemma():
    """Every region within the budget is found, and none beyond it: against a full alignment on small texts."""
    rng = random.Random(4)
    index_of = lambda item: decontaminate.Index([(1, item)])

    def least(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
            row = new
        return min(row)

    for _ in range(40):
        item = " ".join("".join(rng.choices("abcde", k=rng.randint(2, 7))) for _ in range(12))[:90]
        item = plain(item)
        text = list(item)
        for _ in range(rng.randint(0, 7)):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice([[], ["x"], [text[at], "y"]])
        text = plain("before it " + "".join(text) + " and after")
        index = index_of(item)
        (c,) = decontaminate.chunks(__import__("pyarrow").array([text]))
        budget = int(index.budgets[0]) if len(index.budgets) == 1 else None
        found = index.search(c)[0]
        if budget is not None:
            assert bool(found) == (least(item, text) <= budget), (item, text)
            if found:
                assert found[0][1] <= budget


def test_short_items_must_occur_exactly(spark):
    b = spark.createDataFrame([(1, "What is 17 times 23?"), (2, "2 + 2?"), (3, "?!"), (4, None), (None, "no id but words enough")], "item_id long, text string")
    texts = ["What is 17 times 23?", "so: what is 17 times 23, they ask", "what is 17 times 234", "2+2", "2 + 2 = 4", "?!", "", None, "no id but words enough"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontaminate.matches(d, b).collect()}
    assert got == {0: [1], 1: [1], 2: [], 3: [2], 4: [], 5: [], 6: [], 7: [], 8: []}


def test_blocks_change_nothing(spark, monkeypatch):
    items = [(k, f"item {k} has {' '.join(f'word{k}x{j}' for j in range(20))}") for k in range(30)] + [(7, "a second text of the seventh item that is long enough to count")]
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, items[3][1]), (1, items[7][1] + " " + items[-1][1]), (1, "clean"), (None, items[9][1]), (None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    one = sorted(map(str, decontaminate.matches(d, b).collect()))
    clean = decontaminate.clean_documents(d, b).count()
    monkeypatch.setattr(decontaminate, "BLOCK", 700)
    assert sorted(map(str, decontaminate.matches(d, b).collect())) == one and len(one) == 5
    assert decontaminate.clean_documents(d, b).count() == clean == 2
    assert decontaminate.matches(d, b.limit(0)).where("size(item_ids) > 0").count() == 0


# Jaccard join


def test_links_against_brute_force_on_a_table(spark):
    d = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    rows = d.collect()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for r in rows:
        w = WORD.findall((r.text or "").translate(low))
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    links, root = Counter(), {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.near_duplicates(d).collect()}
    assert got == {k: (len(s), find(k), links[k]) for k, s in sets.items()}


def test_blocks_of_a_component(spark, monkeypatch):
    """Links are the same however a component's sets are dealt."""
    words = [f"w{k}" for k in range(90)]
    d = spark.createDataFrame([(k, " ".join(words[k : k + 60])) for k in range(25)], "doc_id long, text string")
    whole = sorted(map(str, jaccard_join.near_duplicates(d).collect()))
    pairs = {(r.a, r.b) for r in jaccard_join.Join(d).links().collect()}
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 4)
    monkeypatch.setattr(jaccard_join, "COPY", 3)
    assert sorted(map(str, jaccard_join.near_duplicates(d).collect())) == whole
    assert {(r.a, r.b) for r in jaccard_join.Join(d).links().collect()} == pairs and len(pairs) > 25


# Quality rules


def test_quality_counts_by_brute_force(spark):
    d = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = {r.doc_id: r.text or "" for r in d.collect()}
    for r in quality_rules.verdicts(d).collect():
        text = rows[r.doc_id]
        w = WORD.findall(text)
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        inside = {k + j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(8)}
        seen, again = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), again, len(inside))
        assert r.base_failed == (len(w) < 20 or 100 * len(inside) > 30 * len(w)) and (not r.base_failed or not r.kept)


def test_divergence_by_brute_force():
    p, q = np.array([[3.0, 1, 0]]), np.array([[1.0, 1, 2]])
    a, b = p[0] / 4, q[0] / 4
    m = (a + b) / 2
    kl = lambda x: sum(u * math.log2(u / v) for u, v in zip(x, m, strict=True) if u)
    assert abs(quality_rules.js_distance(p, q)[0] - math.sqrt((kl(a) + kl(b)) / 2)) < 1e-12
    assert quality_rules.js_distance(p, 0 * q)[0] == 0 and quality_rules.js_distance(p, p * 7)[0] < 1e-7


def test_quality_of_many_languages_and_clashing_names(spark):
    good = " ".join(f"word{k} of the" for k in range(30))
    rows = [(k, good, f"l{k}", "x") for k in range(50)] + [(100, "#" * 500 + " a b", None, "x"), (101, None, None, None), (102, "", "en", None), (102, "", "en", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, classes string")
    got = quality_rules.verdicts(d).collect()
    assert len(got) == len(rows) and all(r.kept for r in got if r.doc_id < 50) and not any(r.kept for r in got if r.doc_id >= 100)
    kept = quality_rules.filter_documents(d)
    assert kept.columns == d.columns and kept.count() == 50


# Budget mixing


def test_fill_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(600):
        lengths = np.unique(rng.integers(1, 60, rng.integers(1, 5)))
        counts, budget = rng.integers(1, 4, len(lengths)), int(rng.integers(0, 300))
        sums = {sum(x) for x in itertools.product(*[[k * n for k in range(c + 1)] for n, c in zip(lengths, counts, strict=True)])}
        got = mixing.fill(lengths, counts, budget, reserve=int(rng.integers(8, 40)))
        assert (got <= counts).all() and abs(int((lengths * got).sum()) - budget) == min(abs(x - budget) for x in sums)
    take = lambda lengths, budget: int((np.array(lengths) * mixing.fill(np.array(lengths), np.ones(len(lengths), int), budget)).sum())
    assert take([50_000, 100_000], 100_000) == 100_000
    assert take([70_000, 80_000, 90_000, 110_000, 180_000, 200_000], 525_000) == 530_000


def test_mix_meets_targets_and_its_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), " ".join(["w"] * int(rng.integers(0, 90))), f"s{k % 4}" if k % 5 else None, "x") for k in range(600)] + [(1, "w w w", "s1", "y"), (1, "w w w", "s1", "y"), (None, "w", "s0", "z")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    plan = mixing.plan_mix(d).collect()
    sizes = Counter()
    for _, text, source, _ in rows:
        sizes[source] += len(text.split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goals = dict(zip(order, mixing.targets([sizes[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))]), strict=True))
    assert len(plan) == len(rows) and abs(sum(goals.values()) - sum(sizes.values())) < 1e-6
    by = Counter()
    for r in plan:
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        by[r.target, r.source_size] += r.taken
    want = Counter((t, sizes[s]) for s, t in goals.items())
    assert set(by) == set(want) and all(abs(by[k] - n * k[0]) <= n for k, n in want.items())
    assert sorted(map(str, mixing.plan_mix(d).collect())) == sorted(map(str, plan))
    mixed = mixing.mixed_documents(d)
    assert mixed.columns == [*d.columns, "repeats"] and sum(len(r.text.split()) * r.repeats for r in mixed.collect()) == sum(by.values())
    with pytest.raises(ValueError):
        mixing.mixed_documents(d.withColumnRenamed("size", "repeats"))
    assert mixing.mixed_documents(d.limit(0)).count() == 0


# Token counts


def test_odd_texts_have_the_library_s_counts(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = ["", None, " ", "\n", "a\tb", "  two  spaces ", "▁mark ▁▁ x", "x" * 5000, "\x00z", "a\n\nb", "\r\n c", "日本語 テキスト", " nbsp", "end ", "<s> </s> <unk>", "same same same", "🙂 ﻿"]
    d = spark.createDataFrame([(k, x, x) for k, x in enumerate(texts)], "doc_id long, text string, n_tokens string")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: (r.n_tokens, r.n_bytes, r.over_limit) for r in token_counts.count_tokens(d, path, 4).collect()}
    assert got == {k: (n := len(model.encode(x or "")), len((x or "").encode()), n > 4) for k, x in enumerate(texts)}
    assert token_counts.count_tokens(d.limit(0), path).count() == 0


# Co-training


def test_cotraining_learns_and_keeps_odd_rows(spark):
    rng = np.random.default_rng(3)
    good, bad = [f"fine{k}" for k in range(80)], [f"junk{k}" for k in range(80)]
    rows = [(k, " ".join(rng.choice(good if k % 2 else bad, 25)), "en", "books" if k % 2 else f"web{k % 3}", 100 + 900 * (k % 2), "x") for k in range(500)]
    rows += [(1000, None, None, None, None, None), (1001, "", "en", "web", 0, None), (1001, "", "en", "web", 0, None), (None, "fine1", "en", "books", 5, None), (1002, "fine2 " * 20_000, "en", "books", 120_000, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, y string")
    y = spark.createDataFrame([(k, k % 2) for k in range(150)], "doc_id long, quality int")
    got = cotraining.score_documents(d, y).collect()
    assert len(got) == len(rows) and all(0 <= x <= 1 for r in got for x in (r.text_score, r.meta_score, r.score))
    rest = [r for r in got if r.doc_id is not None and 150 <= r.doc_id < 500]
    for f in ("text_score", "meta_score", "score"):
        assert np.mean([(getattr(r, f) > 0.5) == (r.doc_id % 2 == 1) for r in rest]) > 0.95, f
    assert len({r.score for r in got if r.doc_id == 1001}) == 1
    again = sorted(map(str, cotraining.score_documents(d, y).collect()))
    assert again == sorted(map(str, got))
    assert cotraining.score_documents(d.limit(0), y).count() == 0
    assert all(r.kept for r in cotraining.score_documents(d.limit(5), y.limit(0)).collect())


def test_metadata_never_sees_the_text():
    assert (cotraining.meta_view(["en", None], ["a", "a"], [5, None]) == cotraining.meta_view(["en", None], ["a", "a"], [5, None])).all()
    z, y = np.linspace(-3, 3, 200), (np.linspace(-3, 3, 200) + np.sin(np.arange(200)) > 0).astype(int)
    slope, shift = cotraining.platt(5 * z + 2, y)
    p = cotraining.sigmoid(slope * (5 * z + 2) + shift)
    assert abs(p.mean() - y.mean()) < 0.02 and 0 < slope < 1


# Rotation and the pipeline


def test_rotation_matches_its_sql(spark):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for t in ("conversations", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got, want = rotation.op3_perspective_rotation(spark, DIR).toPandas(), con.execute(oracle_sql()["op3_perspective_rotation"]).df()
    cols = sorted(got.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_rotation_of_odd_rows(spark):
    rows = [(1, 0, "a", "x"), (1, 0, "b", "y"), (1, None, "a", "z"), (None, 1, "a", "n"), (2, 0, None, None), (2, 0, None, None)]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    once, twice = (sorted(map(str, rotation.rotate(t).collect())) for _ in range(2))
    assert once == twice and len(once) > 0 and rotation.rotate(t.limit(0)).count() == 0


def test_pipeline_keeps_what_its_stages_keep(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    words = lambda seed, n: " ".join(random.Random(seed).choices([f"word{k}" for k in range(400)] + ["the", "of", "and"] * 60, k=n))
    item = words(999, 30)
    texts = {k: words(k, 120) for k in range(12)}
    texts[20], texts[21] = texts[0], texts[1] + " more"  # an exact copy and a near one
    texts[22] = words(50, 60) + " " + item + " " + words(51, 60)
    texts[23], texts[24], texts[25] = None, "", "too short"
    rows = [(k, x, "en", "s1" if k % 2 else None, len(x or "")) for k, x in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    got = pipeline.run(spark, str(tmp_path))
    rows = got.collect()
    assert got.columns == [*docs.columns, "repeats"] and {r.doc_id for r in rows} <= set(range(12)) and {1, 3, 5, 7, 9, 11} <= {r.doc_id for r in rows}
    assert sum(len(r.text.split()) * r.repeats for r in rows) in range(1380, 1500) and all(1 <= r.repeats <= 3 for r in rows)
