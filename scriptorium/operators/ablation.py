"""Logistic models on several sets of fields at once: strengths by folds, ablation tables, diagnostics of groups.

A model is a group of fields, an L2 strength C and the fold that is held out, or none. All of them are fitted together by
Newton's steps: one pass over the rows an iteration gives every open model its loss, gradient and curvature, as sums of
blocks of rows. The sums of the tasks meet in two levels, and one row a model reaches the driver, whatever the rows. A model
whose loss has risen takes half its last step back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluation import confusion, measures, safe, scaler
from .scoring import LinearModel

#: Strengths from 1e-4 to 1e4, ten of them.
STRENGTHS = tuple(np.logspace(-4, 4, 10).tolist())
#: Rows of a block, the size of the last step, and iterations at most.
BLOCK, SMALL, ITERATIONS = 2048, 1e-9, 200
#: In how many ways the tasks' sums meet first.
WAYS = 64


@dataclass
class _Models:
    """All models' coefficients, the intercept last: zero for fields that aren't of a model's group."""

    own: np.ndarray
    strength: np.ndarray
    held: np.ndarray
    weights: np.ndarray

    def part(self, k: np.ndarray) -> _Models:
        return _Models(self.own[k], self.strength[k], self.held[k], self.weights[k])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK):
            b = batch.slice(k, BLOCK)
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            yield np.hstack([x, np.ones((len(x), 1))]), b.column("y").to_numpy(), b.column("fold").to_numpy()


def _sums(models: _Models):
    """Per model: loss, gradient and curvature over the rows that aren't held out, side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, d = models.weights.shape
        total = np.zeros((m, 1 + d + d * d))
        for x, y, fold in _blocks(batches):
            z = x @ models.weights.T
            there = fold[:, None] != models.held[None, :]
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            total[:, 0] += (there * (np.logaddexp(0, z) - y[:, None] * z)).sum(0)
            total[:, 1 : 1 + d] += (there * (p - y[:, None])).T @ x
            w = there * p * (1 - p)
            for k in range(m):
                total[k, 1 + d :] += ((x * w[:, k : k + 1]).T @ x).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(m), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["model", "sums"])

    return run


def _added(key: tuple[pa.Scalar, ...], of: pa.Table) -> pa.Table:
    sums = of["sums"].combine_chunks()
    total = sums.flatten().to_numpy().reshape(len(sums), -1).sum(0)
    return pa.table({"model": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total], pa.list_(pa.float64()))})


def _held_out(models: _Models):
    """Per model: hits, false alarms and misses over the rows of its held-out fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(models.held), 3), np.int64)
        for x, y, fold in _blocks(batches):
            said = x @ models.weights.T > 0
            there = fold[:, None] == models.held[None, :]
            yes = (y == 1)[:, None]
            for k, cell in enumerate((said & yes, said & ~yes, ~said & yes)):
                total[:, k] += (there & cell).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), *(pa.array(total[:, k]) for k in range(3))], names=["model", "tp", "fp", "fn"])

    return run


def _newton(data: DataFrame, models: _Models) -> None:
    m, d = models.weights.shape
    open_, last, loss = np.arange(m), models.weights.copy(), np.full(m, np.inf)
    for _ in range(ITERATIONS):
        now = models.part(open_)
        parts = data.mapInArrow(_sums(now), "model int, sums array<double>").withColumn("way", F.pmod(F.spark_partition_id(), F.lit(WAYS)))
        sums = parts.groupBy("model", "way").applyInArrow(_added, "model int, sums array<double>").groupBy("model").applyInArrow(_added, "model int, sums array<double>")
        closed = []
        for r in sums.collect():
            k = open_[r.model]
            at, own, c = models.weights[k], models.own[k], models.strength[k]
            total = np.array(r.sums)
            penalty = np.append(np.ones(d - 1), 0) / c
            value = total[0] + (penalty * at**2).sum() / 2
            if value > loss[k] + 1e-10 * abs(loss[k]):
                models.weights[k] = (at + last[k]) / 2
                continue
            last[k], loss[k] = at, value
            curvature = total[1 + d :].reshape(d, d) + np.diag(penalty + 1e-12)
            step = np.zeros(d)
            step[own] = np.linalg.solve(curvature[np.ix_(own, own)], (total[1 : 1 + d] + penalty * at)[own])
            models.weights[k] = at - step
            if np.abs(step).max() < SMALL * max(1.0, np.abs(at).max()):
                closed.append(k)
        open_ = np.setdiff1d(open_, closed)
        if not len(open_):
            return


def fit_groups(train: DataFrame, groups: dict[str, list[str]], label: str = "y", fold: str = "fold", strengths: tuple[float, ...] = STRENGTHS, threshold: float = 0.5) -> dict[str, tuple[LinearModel, float]]:
    """Per group of fields the model on all rows of ``train`` with the strength of the best mean F1 over the held-out folds
    (the first of equals), and that strength.

    Values are standardised by all rows' mean and population deviation. ``train`` has whole numbers as folds, dealt already; a
    fold on which a model says and finds nothing scores 0. Raises where a field or label is null, or all labels are equal.
    """
    fields = list(dict.fromkeys(f for g in groups.values() for f in g))
    state = train.agg(F.count_if(F.greatest(*(F.col(c).isNull().cast("int") for c in (*fields, label, fold)), F.lit(0)) == 1).alias("missing"), F.min(label).alias("lo"), F.max(label).alias("hi"), F.sort_array(F.collect_set(fold)).alias("folds")).first()
    if state.missing or state.lo == state.hi:
        raise ValueError(f"{state.missing} rows miss a field, label or fold" if state.missing else "rows of both labels are needed")
    mean, scale = scaler(train, fields)
    x = F.array(*((F.col(f).cast("double") - F.lit(m)) / F.lit(s) for f, m, s in zip(fields, mean, scale, strict=True)))
    data = train.select(x.alias("x"), F.col(label).cast("double").alias("y"), F.col(fold).cast("int").alias("fold")).persist()
    every = [(name, c, h) for name in groups for c in strengths for h in (*state.folds, -1)]
    d = len(fields) + 1
    own = np.array([[f in groups[name] for f in fields] + [True] for name, _, _ in every])
    models = _Models(own, np.array([c for _, c, _ in every]), np.array([h for _, _, h in every]), np.zeros((len(every), d)))
    try:
        _newton(data, models)
        cells = {r.model: 2 * r.tp / max(1, 2 * r.tp + r.fp + r.fn) for r in data.mapInArrow(_held_out(models), "model int, tp long, fp long, fn long").groupBy("model").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))).collect()}
    finally:
        data.unpersist()
    out = {}
    for name, group in groups.items():
        f1 = {c: np.mean([cells[k] for k, (g, s, h) in enumerate(every) if (g, s) == (name, c) and h >= 0]) for c in strengths}
        best = max(strengths, key=f1.__getitem__)
        w = models.weights[every.index((name, best, -1))]
        at = [fields.index(f) for f in group]
        pick = lambda values: tuple(float(values[k]) for k in at)  # noqa: B023, E731
        out[name] = LinearModel(tuple(group), pick(mean), pick(scale), pick(w), float(w[-1]), threshold), best
    return out


def scored_by_group(rows: DataFrame, fitted: dict[str, tuple[LinearModel, float]], *keep: str) -> DataFrame:
    """``(keep.., group, score)``: a row a row and group."""
    each = F.array(*(F.struct(F.lit(name).alias("group"), model.score().alias("score")) for name, (model, _) in fitted.items()))
    return rows.select(*keep, F.explode(each).alias("x")).select(*keep, "x.group", "x.score")


def _described(fitted: dict[str, tuple[LinearModel, float]], spark) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(n, len(m.fields), c) for n, (m, c) in fitted.items()], "group string, n_features int, chosen_c double"))  # a row a group


def ablation_report(rows: DataFrame, fitted: dict[str, tuple[LinearModel, float]], split: str = "split", y: str = "y", threshold: float = 0.5) -> DataFrame:
    """Per group of fields and split: the number of fields, the chosen strength, and all measures at ``threshold``. One pass."""
    cells = scored_by_group(rows, fitted, split, y).groupBy("group", split).agg(*confusion(y, "score", F.lit(threshold)))
    return measures(cells).join(_described(fitted, rows.sparkSession), "group")


def group_diagnostic(rows: DataFrame, fitted: dict[str, tuple[LinearModel, float]], essay: str, index: str, split: str = "split", y: str = "y") -> DataFrame:
    """Per group: the threshold of 0.01 to 0.99 with the best F1 on validation (the lowest of equals; 0.5 where none is above
    0), all measures on test at that threshold, and per split how many essays with a positive row there are and in how
    many the first row of the greatest score is positive.
    """
    s = scored_by_group(rows, fitted, essay, index, split, y)
    steps = F.transform(F.sequence(F.lit(1), F.lit(99)), lambda k: k / F.lit(100.0))
    passed = F.size(F.filter(steps, lambda t: t <= F.col("score")))
    counts = s.where(F.col(split) == "validation").groupBy("group", passed.alias("k")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    per = counts.select("group", "pos", "neg", F.col("k").alias("upto"), F.explode(F.sequence(F.lit(1), F.lit(99))).alias("k"))
    hit = F.col("k") <= F.col("upto")
    cells = per.groupBy("group", "k").agg(F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"), F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("fn"))
    f1 = safe(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    chosen = cells.groupBy("group").agg(F.max(F.struct(f1.alias("f1"), (-F.col("k")).alias("less"))).alias("best"))
    chosen = chosen.select("group", F.when(F.col("best.f1") > 0, -F.col("best.less") / 100.0).otherwise(0.5).alias("threshold"), F.col("best.f1").alias("validation_f1"))
    test = s.where(F.col(split) == "test").join(F.broadcast(chosen), "group")  # a row a group
    test = measures(test.groupBy("group").agg(*confusion(y, "score", F.col("threshold"))))
    tops = s.groupBy("group", essay, split).agg(F.max(F.struct("score", (-F.col(index)).alias("i"), F.col(y).alias("y"))).alias("top"), F.max(y).alias("any")).where("any = 1")
    tops = tops.groupBy("group").agg(*(F.count_if((F.col(split) == p) & extra).alias(f"{p}_{n}") for p in ("validation", "test") for n, extra in (("essays", F.lit(True)), ("top1", F.col("top.y") == 1))))
    every = _described(fitted, rows.sparkSession)
    return every.join(chosen, "group", "left").join(test, "group", "left").join(tops, "group", "left")
