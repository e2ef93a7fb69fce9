"""Fitting and evaluating classifiers: metrics, thresholds, intervals, scalers, logistic models, subgroup reports.

Scores meet thresholds by their hundredths, so that a sweep is one aggregation; all counts are of integers.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Z = 1.96
#: Groups of fewer rows get a note and no interval.
LEAST_GROUP = 10


def safe(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a.cast("double") / b)


def to_xy(rows: DataFrame, fields: list[str], label: str = "label", positive: str = "machine") -> DataFrame:
    return rows.select(*fields, (F.col(label) == positive).cast("int").alias("y"))


def missingness(rows: DataFrame, fields: list[str]) -> DataFrame:
    """``(field, n_missing)`` of the fields that are null anywhere."""
    counts = rows.agg(*(F.count_if(F.col(f).isNull()).alias(f) for f in fields))
    return counts.unpivot([], fields, "field", "n_missing").where("n_missing > 0")


def require_complete(rows: DataFrame, fields: list[str]) -> DataFrame:
    """``rows``; raises if a field is null anywhere."""
    found = missingness(rows, fields).orderBy("field").collect()
    if found:
        raise ValueError(f"fields are missing: {', '.join(r.field for r in found)}")
    return rows


def confusion(y: str = "y", score: str = "score", threshold: Column | float = 0.5) -> list[Column]:
    hit = F.col(score) >= threshold
    return [F.count_if(c).alias(n) for n, c in (("tp", (F.col(y) == 1) & hit), ("fp", (F.col(y) == 0) & hit), ("tn", (F.col(y) == 0) & ~hit), ("fn", (F.col(y) == 1) & ~hit))]


def measures(cells: DataFrame) -> DataFrame:
    """``cells`` (tp, fp, tn, fn) with accuracy and precision, recall and F1 of both classes; 0 where a divisor is 0."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = cells.withColumn("n", tp + fp + tn + fn).withColumn("accuracy", safe(tp + tn, F.col("n")))
    for name, t, p, n in (("machine", tp, fp, fn), ("human", tn, fn, fp)):
        out = out.withColumn(f"precision_{name}", safe(t, t + p)).withColumn(f"recall_{name}", safe(t, t + n)).withColumn(f"f1_{name}", safe(2 * t, 2 * t + p + n))
    return out


def metrics_at(rows: DataFrame, threshold: float, y: str = "y", score: str = "score") -> DataFrame:
    """One row of all measures where a score of at least ``threshold`` says 1; rows without label or score count nowhere."""
    return measures(rows.agg(*confusion(y, score, F.lit(threshold)))).withColumn("threshold", F.lit(threshold))


def sweep(rows: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """All measures at the thresholds 0.01 to 0.99, by ``percent``: rows are counted by the highest of them they reach, and
    the 99 rows are sums of these counts from above."""
    reached = F.greatest(F.lit(0), F.least(F.lit(99), F.floor(F.col(score) * 100).cast("int")))
    # the product may round across a whole number: the quotient, as thresholds are written, decides
    exact = F.when(F.col(score) >= (reached + 1) / 100.0, F.least(F.lit(99), reached + 1)).when(F.col(score) < reached / 100.0, reached - 1).otherwise(reached)
    counts = rows.where(F.col(y).isin(0, 1) & F.col(score).isNotNull()).groupBy(exact.alias("percent")).agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("n"))
    grid = rows.sparkSession.range(0, 100).select(F.col("id").cast("int").alias("percent"))
    full = grid.join(counts, "percent", "left").fillna(0, ["p", "n"])
    up, down = W.orderBy(F.desc("percent")).rowsBetween(W.unboundedPreceding, 0), W.orderBy(F.desc("percent")).rowsBetween(1, W.unboundedFollowing)
    none = lambda c: F.coalesce(c, F.lit(0))
    cells = full.select("percent", F.sum("p").over(up).alias("tp"), F.sum("n").over(up).alias("fp"), none(F.sum("n").over(down)).alias("tn"), none(F.sum("p").over(down)).alias("fn"))
    return measures(cells.where("percent >= 1"))


def chosen_threshold(rows: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """The threshold of the highest F1 of class 1, the lowest of equals, and that F1."""
    best = sweep(rows, y, score).orderBy(F.desc("f1_machine"), "percent").limit(1)
    return best.select((F.col("percent") / 100.0).alias("threshold"), F.round("f1_machine", 4).alias("f1"))


def confusion_grid(rows: DataFrame, classes: int, y: str = "y", p: str = "p") -> DataFrame:
    """``(y, p, n)`` for all pairs of classes, those without rows too."""
    counts = rows.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count("*").alias("n"))
    grid = rows.sparkSession.range(classes * classes).select((F.col("id") / classes).cast("int").alias("y"), (F.col("id") % classes).cast("int").alias("p"))
    return grid.join(counts, ["y", "p"], "left").select("y", "p", F.coalesce("n", F.lit(0)).alias("n"))


def multiclass_metrics(rows: DataFrame, classes: int, y: str = "y", p: str = "p") -> DataFrame:
    """Per class: support, precision, recall, F1; and of all, in every row, n, accuracy, macro and weighted F1."""
    g = confusion_grid(rows, classes, y, p)
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    true = g.groupBy(F.col("y").alias("class")).agg(F.sum("n").alias("support"), F.sum(hit).alias("t"))
    said = g.groupBy(F.col("p").alias("class")).agg(F.sum("n").alias("said"))
    c = true.join(said, "class")
    c = c.withColumn("precision", safe(F.col("t"), F.col("said"))).withColumn("recall", safe(F.col("t"), F.col("support"))).withColumn("f1", safe(2 * F.col("t"), F.col("said") + F.col("support")))
    every = W.partitionBy()  # one row a class
    total = F.sum("support").over(every)
    # a class that is neither there nor said isn't averaged over
    macro = F.avg(F.when((F.col("support") > 0) | (F.col("said") > 0), F.col("f1"))).over(every)
    weighted = safe(F.sum(F.col("f1") * F.col("support")).over(every), total)
    return c.select("class", "support", "precision", "recall", "f1", total.alias("n"), safe(F.sum("t").over(every), total).alias("accuracy"), macro.alias("macro_f1"), weighted.alias("weighted_f1"))


def argmax(probabilities: str) -> Column:
    """Index of the first greatest probability."""
    return F.array_position(F.col(probabilities), F.array_max(probabilities)).cast("int") - 1


def majority(rows: DataFrame, label: str = "label") -> DataFrame:
    """The commonest label, the first by order of equals, and its count."""
    return rows.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(1)


def majority_binary(rows: DataFrame, y: str = "y") -> DataFrame:
    """The rounded mean of 0 and 1, half to 0."""
    return rows.agg(F.bround(F.avg(y)).cast("int").alias("label"))


def wilson(k: Column, n: Column, sign: int) -> Column:
    """An end of the interval of a share; null where n is 0."""
    p = k.cast("double") / n
    z2 = Z * Z
    half = Z * F.sqrt(p * (1 - p) / n + F.lit(z2 / 4) / n / n)
    return F.when(n > 0, (p + F.lit(z2 / 2) / n + sign * half) / (1 + F.lit(z2) / n))


def subgroup_report(rows: DataFrame, attributes: DataFrame, key: str, attribute: str, wrong: Column, groups: list[str]) -> DataFrame:
    """Per group of ``groups`` and "unlabeled", even without rows: n, how many are wrong, their share and its interval.

    Rows without an attribute are unlabeled. Groups of fewer than ``LEAST_GROUP`` rows get a note and no interval.
    """
    of = rows.join(attributes.select(key, F.col(attribute).alias("group of row")), key, "left").withColumn("group", F.coalesce("group of row", F.lit("unlabeled")))
    counts = of.groupBy("group").agg(F.count("*").alias("n"), F.count_if(wrong).alias("k"))
    grid = rows.sparkSession.createDataFrame([(g,) for g in (*groups, "unlabeled")], "group string")
    both = grid.join(counts, "group", "left").fillna(0, ["n", "k"])
    n, k = F.col("n"), F.col("k")
    enough = n >= LEAST_GROUP
    return both.select("group", "n", "k", F.when(n > 0, F.round(k / n, 4)).alias("rate"), F.when(enough, F.round(wilson(k, n, -1), 4)).alias("low"), F.when(enough, F.round(wilson(k, n, 1), 4)).alias("high"), F.when(~enough, "too few rows").alias("note"))


def summary(rows: DataFrame, score: str = "score", by: list[str] | None = None) -> DataFrame:
    v = F.col(score)
    r = lambda c: F.round(c, 4)
    return rows.groupBy(*(by or [])).agg(F.count(v).alias("n"), r(F.avg(v)).alias("mean"), r(F.median(v)).alias("median"), r(F.stddev_pop(v)).alias("std"), r(F.min(v)).alias("min"), r(F.max(v)).alias("max"))


def feature_distribution(rows: DataFrame, fields: list[str], group: str) -> DataFrame:
    """Mean and population deviation of every field in every group, in long form."""
    long = rows.unpivot([group], [F.col(f).cast("double").alias(f) for f in fields], "feature", "v")
    return long.groupBy("feature", group).agg(F.count("v").alias("n"), F.round(F.avg("v"), 5).alias("mean"), F.round(F.stddev_pop("v"), 5).alias("std"))


def audited(rows: DataFrame, threshold: float, y: str = "y", score: str = "score") -> DataFrame:
    """``rows`` with what is said of each, whether it's right, and of which kind it is wrong."""
    said = (F.col(score) >= threshold).cast("int")
    return rows.withColumn("predicted", said).withColumn("correct", said == F.col(y)).withColumn("false_positive", (said == 1) & (F.col(y) == 0)).withColumn("false_negative", (said == 0) & (F.col(y) == 1))


def scaler(rows: DataFrame, fields: list[str]) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Means and population deviations; a deviation of 0 is taken as 1."""
    r = rows.agg(*(f(F.col(c).cast("double")).alias(f"{n}{k}") for k, c in enumerate(fields) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return tuple(r[f"m{k}"] for k in range(len(fields))), tuple(r[f"s{k}"] or 1.0 for k in range(len(fields)))


def folds(rows: DataFrame, key: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """``rows`` with a ``fold``: within each label, rows in a seeded order are dealt to k folds in turn.

    The order is cut by 256 parts of the hash: parts are counted, and ranks are sought within a part, so that no task sorts
    all rows of a label.
    """
    d = rows.select(F.struct(*rows.columns).alias("row"), F.col(label).alias("label"), F.col(key).alias("key"), F.coalesce(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.lit("")).alias("h"))
    d = d.withColumn("part", F.left("h", F.lit(2)))
    sizes = d.groupBy("label", "part").agg(F.count("*").alias("m"))  # 257 rows a label at most
    before = F.coalesce(F.sum("m").over(W.partitionBy("label").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("label").alias("l"), F.col("part").alias("p"), before.alias("before"))
    rank = F.col("before") + F.row_number().over(W.partitionBy("label", "part").orderBy("h", "key")) - 1
    both = d.join(sizes, F.expr("label <=> l and part = p"))
    return both.withColumn("fold", (rank % k).cast("int")).select(*(F.col("row").getField(c).alias(c) for c in rows.columns), "fold")


def logistic_cv(rows: DataFrame, fields: list[str], label: str = "y", cs: int = 10, scoring: str = "f1", multinomial: bool = False):
    """A logistic model with the L2 strength, of ``cs`` from 1e-4 to 1e4, that does best over the given ``fold``s.

    ``rows`` are standardised already and have a ``fold``. Returns the model fitted on all rows and the chosen C. Penalties
    are of the sum of losses, as C's are, so that a fold's regularisation follows its number of rows.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=fields, outputCol="vector", handleInvalid="error").transform(rows).select("vector", F.col(label).cast("double").alias("label"), "fold")
    count = {r.fold: r.n for r in data.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    kind = "fMeasureByLabel" if scoring == "f1" else "f1"
    measure = MulticlassClassificationEvaluator(metricName=kind, metricLabel=1.0)

    def fitted(train: DataFrame, n: int, c: float):
        return LogisticRegression(featuresCol="vector", regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=2000, family="multinomial" if multinomial else "binomial").fit(train)

    def mean_score(c: float) -> float:
        return float(np.mean([measure.evaluate(fitted(data.where(F.col("fold") != f), sum(count.values()) - count[f], c).transform(data.where(F.col("fold") == f))) for f in sorted(count)]))

    grid = np.logspace(-4, 4, cs)
    best = max(grid, key=mean_score)
    return fitted(data, sum(count.values()), float(best)), float(best)


def random_forest(rows: DataFrame, fields: list[str], label: str = "y", trees: int = 200, depth: int = 5, seed: int = 42):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=fields, outputCol="vector", handleInvalid="error").transform(rows)
    return RandomForestClassifier(featuresCol="vector", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed).fit(data)


def ablation(rows: DataFrame, groups: dict[str, list[str]], label: str = "y") -> dict[str, float]:
    """The chosen C of a model on each group of fields."""
    return {name: logistic_cv(rows, fields, label)[1] for name, fields in groups.items()}


def coefficients(weights: dict[str, float]) -> list[tuple[str, float]]:
    """Rounded weights, greatest absolute value first."""
    return sorted(((f, round(w, 4)) for f, w in weights.items()), key=lambda x: (-abs(x[1]), x[0]))


def union_scored(parts: list[DataFrame], model) -> DataFrame:
    """Several held-out tables as one, scored by a model that isn't fitted again."""
    return reduce(DataFrame.unionByName, parts).withColumn("score", model.score())


def reproduced(c: float, threshold: float, recorded_c: float, recorded_threshold: float, tolerance: float = 1e-6) -> None:
    """Raises unless a repeated fit gives the recorded strength and threshold."""
    if abs(c - recorded_c) > tolerance * max(1.0, abs(recorded_c)) or threshold != recorded_threshold:
        raise ValueError(f"the fit gives C = {c} and threshold {threshold}, on record are {recorded_c} and {recorded_threshold}")
