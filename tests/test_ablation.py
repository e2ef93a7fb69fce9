"""All models fitted together: against single fits, and the reports against brute force."""

import math

import numpy as np
import pytest

from scriptorium.operators import ablation as A
from scriptorium.operators import evaluation as E


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    data = []
    for k in range(360):
        x = rng.normal(size=4) * [1, 3, 0.5, 2] + [0, 5, 1, 0]
        y = int(x[0] + 0.4 * (x[1] - 5) + rng.normal() > 0.2)
        data.append((k, k // 6, k % 6, ["train", "train", "validation", "test"][k // 6 % 4], k % 5, y, *map(float, x)))
    return spark.createDataFrame(data, "id long, essay long, i int, split string, fold int, y int, a double, b double, c double, d double").repartition(3).persist()


GROUPS = {"all": ["a", "b", "c", "d"], "one": ["c"], "two": ["b", "a"], "again": ["a", "b"]}
CS = (1e-3, 0.1, 10.0, 1e4)


def single(x, y, c):
    """One fit by gradient steps of Newton's, on standardised columns."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, pen = np.zeros(x.shape[1]), np.append(np.ones(x.shape[1] - 1), 0) / c
    for _ in range(60):
        p = 1 / (1 + np.exp(-(x @ w)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pen), x.T @ (p - y) + pen * w)
    return w


def f1(said, y):
    tp, fp, fn = (said & (y == 1)).sum(), (said & (y == 0)).sum(), (~said & (y == 1)).sum()
    return 2 * tp / max(1, 2 * tp + fp + fn)


@pytest.fixture(scope="module")
def fitted(rows):
    return A.fit_groups(rows.where("split = 'train'"), GROUPS, strengths=CS)


def test_coefficients_and_strengths_are_those_of_single_fits(rows, fitted):
    t = rows.where("split = 'train'").toPandas()
    for name, fields in GROUPS.items():
        x, y, fold = t[fields].to_numpy(), t.y.to_numpy(), t.fold.to_numpy()
        z = (x - x.mean(0)) / x.std(0)
        score = {c: np.mean([f1(np.hstack([z, np.ones((len(z), 1))])[fold == k] @ single(z[fold != k], y[fold != k], c) > 0, y[fold == k]) for k in range(5)]) for c in CS}
        model, c = fitted[name]
        assert c == max(CS, key=score.__getitem__) and model.fields == tuple(fields)
        assert [*model.weight, model.intercept] == pytest.approx(single(z, y, c).tolist(), abs=1e-7)
    assert fitted["two"][0].weight == pytest.approx(fitted["again"][0].weight[::-1])


def test_separable_rows_end(spark):
    d = spark.createDataFrame([(float(k), 0.0, int(k > 9), k % 2) for k in range(20)], "a double, flat double, y int, fold int")
    model, _ = A.fit_groups(d, {"g": ["a", "flat"]}, strengths=(1.0, 1e4))["g"]
    assert model.weight[0] > 0 and model.weight[1] == pytest.approx(0) and all(map(math.isfinite, model.weight))
    for bad in (d.selectExpr("a", "0 as y", "fold"), d.selectExpr("nullif(a, 3) as a", "y", "fold")):
        with pytest.raises(ValueError):
            A.fit_groups(bad, {"g": ["a"]})


def test_ablation_report(rows, fitted):
    got = {(r.group, r.split): r for r in A.ablation_report(rows, fitted).collect()}
    assert len(got) == 12 and {r.n_features for r in got.values()} == {4, 1, 2}
    t = rows.toPandas()
    for (group, split), r in got.items():
        model, c = fitted[group]
        s = t[t.split == split]
        z = (s[list(model.fields)].to_numpy() - model.mean) / model.scale
        said = 1 / (1 + np.exp(-(z @ model.weight + model.intercept))) >= 0.5
        assert (r.tp, r.fp, r.n, r.chosen_c) == ((said & (s.y == 1)).sum(), (said & (s.y == 0)).sum(), len(s), c)
        assert r.f1_machine == pytest.approx(f1(said, s.y.to_numpy())) and r.accuracy == pytest.approx((said == (s.y == 1)).mean())


def test_group_diagnostic(rows, fitted):
    got = {r.group: r for r in A.group_diagnostic(rows, fitted, "essay", "i").collect()}
    assert set(got) == set(GROUPS)
    t = rows.toPandas()
    for group, r in got.items():
        model, _ = fitted[group]
        z = (t[list(model.fields)].to_numpy() - model.mean) / model.scale
        t["s"] = 1 / (1 + np.exp(-(z @ model.weight + model.intercept)))
        v, test = t[t.split == "validation"], t[t.split == "test"]
        best, at = 0.0, 0.5
        for k in range(1, 100):
            value = f1((v.s >= k / 100).to_numpy(), v.y.to_numpy())
            if value > best:
                best, at = value, k / 100
        assert (r.threshold, r.validation_f1) == (at, pytest.approx(best))
        assert r.f1_machine == pytest.approx(f1((test.s >= at).to_numpy(), test.y.to_numpy()))
        for name in ("validation", "test"):
            own = [g.sort_values("i") for _, g in t[t.split == name].groupby("essay") if g.y.max() == 1]
            assert (r[f"{name}_essays"], r[f"{name}_top1"]) == (len(own), sum(g.y.iloc[int(g.s.to_numpy().argmax())] for g in own))


def test_folds_of_the_library_are_taken(rows):
    d = E.folds(rows.drop("fold").where("split = 'train'"), "id", "y")
    assert set(A.fit_groups(d, {"g": ["a"]}, strengths=(1.0,))) == {"g"}
