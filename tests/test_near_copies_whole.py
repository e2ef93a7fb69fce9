"""Near copies that share no five-word shingle are found by the query too, and cells bring all pairs together."""

import random

import pytest

from scriptorium.operators import near_copies as N
from scriptorium.plans.queries import QUERIES
from scriptorium.plans import dataset  # noqa: F401  adds its queries


def test_query_finds_copies_without_common_shingles(spark, tmp_path):
    words = ["".join(random.Random(k).choices("etaoinshrdlu", k=7)) for k in range(60)]
    rows = [(1, "s", " ".join(words)), (2, "t", " ".join(w + "x" if k % 4 == 2 else w for k, w in enumerate(words))), (3, "s", "apart")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_links, r.duplicate) for r in QUERIES["near_copies"](spark, str(tmp_path)).collect()}
    assert got == {1: (1, True), 2: (1, True), 3: (0, False)}


@pytest.mark.parametrize("threshold", [0.5, 0.9, 1.0])
def test_small_cells_lose_no_pair(spark, monkeypatch, threshold):
    from difflib import SequenceMatcher

    monkeypatch.setattr(N, "ROWS", 2)
    rng = random.Random(3)
    texts = []
    for _ in range(6):
        base = "".join(rng.choices("abcd é😀", k=rng.choice([5, 40, 130])))
        texts += [base] + ["".join(c for c in base if rng.random() > rate) for rate in (0.03, 0.1, 0.3)]
    texts = sorted(set(texts) - {""})
    d = spark.createDataFrame([(f"k{k:02}", t) for k, t in enumerate(texts)], "id string, t string").selectExpr("id", "t", "id last", "id `group`")
    want = {(f"k{i:02}", f"k{j:02}") for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and SequenceMatcher(None, a, b, autojunk=False).ratio() >= threshold}
    assert {(r.a, r.b) for r in N.scored(d, threshold).collect()} == want
