"""The toxicity classifier: scores by brute force, alone and side by side, learnt labels and odd rows."""

import numpy as np
import pyarrow as pa
import pytest

from scriptorium.llm import toxicity
from scriptorium.llm.words import chunks

SCHEMA = "doc_id long, text string, lang string, lang_threshold string"
TEXTS = ["you are vile", "", "one", "a b c d e f g", "vile", "x y", "the end of it all, vile one"]


@pytest.fixture(scope="module")
def model():
    m = toxicity.Model(3)
    ids = [toxicity.bucket_ids(c)[0] for t in TEXTS for c in chunks(pa.array([t]))]
    m.fit(ids * 20, np.array(["vile" in t for t in TEXTS] * 20, float))
    return m


def scores(m, texts):
    (c,) = chunks(pa.array(texts))
    return m.scores(*toxicity.bucket_ids(c))


def test_a_score_depends_on_the_text_alone(model):
    together = scores(model, TEXTS)
    assert together.tolist() == [scores(model, [t])[0] for t in TEXTS]
    assert together[::-1].tolist() == scores(model, TEXTS[::-1]).tolist()


def test_forward_pass_by_brute_force(model):
    for t, got in zip(TEXTS, scores(model, TEXTS), strict=True):
        (c,) = chunks(pa.array([t]))
        x = np.concatenate([model.e[toxicity.bucket_ids(c)[0]], np.zeros((3, toxicity.DIM), np.float32)])
        z = float(model.c)
        for i, k in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                best = max(float(sum(x[a + j] @ model.w[k][j][:, f] for j in range(k))) for a in range(len(x) - k + 1))
                z += max(0.0, best + float(model.b[k][f])) * float(model.v[i * toxicity.FILTERS + f])
        assert abs(1 / (1 + np.exp(-z)) - got) < 1e-4


def test_labels_are_learnt_and_odd_rows_scored(spark):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(rng.choice(words, 30)) + (" slur" if k % 3 == 0 else ""), "en", "x") for k in range(900)]
    rows += [(1000, None, None, None), (1001, "", "en", None), (1002, "slur " * 5000, "xx", None), (None, "w1", "en", None), (1001, "", "en", None)]
    d = spark.createDataFrame(rows, SCHEMA)
    y = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(900)], "doc_id long, toxic int")
    got = toxicity.score_documents(d, y).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert np.mean([r.predicted == (r.doc_id % 3 == 0) for r in held]) > 0.95
    assert next(r for r in got if r.doc_id == 1002).predicted == 1 and len({r.score for r in got if r.doc_id == 1001}) == 1


def test_without_labels_or_rows(spark):
    d = spark.createDataFrame([(1, "a", "en", "x")], SCHEMA)
    y = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_documents(d, y).count() == 1
    assert toxicity.score_documents(d.limit(0), y).count() == 0
    one_label = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.score_documents(d, one_label).count() == 1
