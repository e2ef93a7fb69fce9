"""Linear scoring with evidence: all parts are Column expressions, so that a score stays in one code-generated stage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LinearModel:
    """A fitted logistic model over named fields: score = sigmoid(intercept + sum of weight * (value - mean) / scale)."""

    fields: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weight: tuple[float, ...]
    intercept: float
    threshold: float

    def parts(self) -> list[Column]:
        """Each field's contribution to the logit; null where the field is."""
        return [F.lit(w) * ((F.col(f).cast("double") - F.lit(m)) / F.lit(s)) for f, m, s, w in zip(self.fields, self.mean, self.scale, self.weight, strict=True)]

    def logit(self) -> Column:
        out = F.lit(self.intercept)
        for part in self.parts():
            out = out + part
        return out

    def score(self) -> Column:
        return 1 / (1 + F.exp(-self.logit()))

    def label(self) -> Column:
        """Compares the score before rounding."""
        return F.when(self.score() >= self.threshold, "machine").otherwise("human")

    def state(self) -> Column:
        """Inconclusive where a field is missing. The states' names are fixed values."""
        score = self.score()
        return F.when(score.isNull(), "inconclusive").when(score >= self.threshold, "machine_signal_detected").otherwise("no_strong_signal_detected")


def ranked(sentences: DataFrame, model: LinearModel, doc: str = "doc_id", index: str = "i") -> DataFrame:
    """Complete sentences with their score, rounded to four places, and rank by it; ties go by index."""
    w = W.partitionBy(doc).orderBy(F.desc("score"), index)
    return sentences.withColumn("score", F.round(model.score(), 4)).where("score is not null").withColumn("rank", F.row_number().over(w))


def missing_fields(model: LinearModel) -> Column:
    """The sorted names of a row's missing fields."""
    return F.array_sort(F.array_compact(F.array(*(F.when(F.col(f).isNull(), F.lit(f)) for f in model.fields))))


def skipped(sentences: DataFrame, model: LinearModel) -> DataFrame:
    """Incomplete sentences with the sorted names of their missing fields."""
    return sentences.withColumn("missing_fields", missing_fields(model)).where(F.size("missing_fields") > 0)


def strongest(model: LinearModel, n: int = 3) -> Column:
    """A row's ``n`` fields of largest absolute contribution, first in the model's order among equals, as a list."""
    items = [F.struct((-F.abs(part)).alias("order"), F.lit(k).alias("at"), F.lit(f).alias("field"), F.col(f).cast("double").alias("value"), part.alias("contribution"), F.lit(m).alias("reference")) for k, (f, m, part) in enumerate(zip(model.fields, model.mean, model.parts(), strict=True))]
    best = F.slice(F.array_sort(F.filter(F.array(*items), lambda x: x["contribution"].isNotNull())), 1, n)
    direction = lambda e: F.when(e["value"] > e["reference"], "higher").otherwise("lower")
    return F.transform(best, lambda e, k: F.struct((k + 1).alias("rank"), e["field"].alias("field"), F.round(e["value"], 4).alias("value"), direction(e).alias("direction"), F.round(e["contribution"], 6).alias("contribution")))


def evidence(rows: DataFrame, model: LinearModel, keys: list[str], n: int = 3) -> DataFrame:
    """Each row's ``n`` fields of largest absolute contribution, first in the model's order among equals."""
    return rows.select(*keys, F.explode(strongest(model, n)).alias("e")).select(*keys, "e.*")


def localized(sentences: DataFrame, model: LinearModel, k: int = 3, doc: str = "doc_id", index: str = "i") -> DataFrame:
    """Per document: how many sentences can be scored, the ``k`` best with their evidence, in order, the incomplete ones
    with what they miss, and a reason where nothing can be scored."""
    # one pass and one exchange: ranks, totals and lists are all by document; a row without one is in none of them
    own = F.col(doc).isNotNull()
    w = W.partitionBy(doc).orderBy(F.desc_nulls_last("score"), index)
    s = sentences.withColumn("score", F.when(own, F.round(model.score(), 4))).withColumn("rank", F.row_number().over(w))
    s = s.withColumn("missing_fields", F.when(own, missing_fields(model)))
    top = F.when(F.col("score").isNotNull() & (F.col("rank") <= k), F.struct("rank", index, "score", strongest(model).alias("evidence")))
    lost = F.when(F.size("missing_fields") > 0, F.struct(index, "missing_fields"))
    docs = s.groupBy(doc).agg(F.count("score").alias("total_scorable"), F.array_sort(F.collect_list(top)).alias("candidates"), F.array_sort(F.collect_list(lost)).alias("skipped"))
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    return docs.select(doc, "total_scorable", some("candidates").alias("candidates"), some("skipped").alias("skipped"), F.when(F.col("total_scorable") == 0, "no sentence can be scored").alias("reason"))
