"""Model artifacts: published only if a repeated fit gives what is on record, swapped in whole, and loaded with a check."""

from __future__ import annotations

import json
import math
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scoring import LinearModel

#: Fixed value: how far a repeated score may lie from the one on record, which is rounded to four places.
TOLERANCE = 5e-5


def _place(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def checked(scored: DataFrame, recorded: DataFrame, key: str, tolerance: float = TOLERANCE) -> None:
    """Raises unless every row of ``scored(key, score)`` is in ``recorded(key, score)`` once, with a score as near as that."""
    r = recorded.select(key, F.col("score").alias("on record")).groupBy(key).agg(F.max("on record").alias("on record"), F.count("*").alias("times"))
    both = scored.select(key, "score").join(r, key, "left")
    off = F.abs(F.col("score") - F.col("on record"))
    bad = both.where(F.col("times").isNull() | (F.col("times") > 1) | F.coalesce(off > tolerance, F.lit(True)))
    n = bad.count()
    if n:
        first = bad.orderBy(key).first()
        raise ValueError(f"{n} scores aren't those on record; first {first[key]}: {first.score}, on record {first['on record']}")


def publish(spark: SparkSession, path: str, model: LinearModel, c: float, recorded_c: float, scored: DataFrame, recorded: DataFrame, key: str, **more: str | int | float) -> None:
    """Writes ``model`` to ``path`` if its strength and its scores are those on record.

    The file is written beside the old one, read back and compared, and then put in its place by one rename, so that a
    crash at any time leaves the old artifact or the new one, whole. ``more`` is kept with it: a version, a seed.
    """
    if not math.isclose(c, recorded_c, rel_tol=1e-5, abs_tol=1e-8):
        raise ValueError(f"the fit gives C = {c}, on record is {recorded_c}")
    checked(scored, recorded, key)
    body = {**more, "fields": model.fields, "mean": model.mean, "scale": model.scale, "weight": model.weight, "intercept": model.intercept, "threshold": model.threshold, "c": c}
    aside = f"{path}.new-{uuid.uuid4().hex}"
    p, fs = _place(spark, aside)
    try:
        out = fs.create(p)
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        if _read(spark, aside) != model:
            raise OSError(f"{aside} doesn't hold what was written")
        _swap(spark, aside, path)
    except BaseException:
        fs.delete(p, False)
        raise


def _swap(spark: SparkSession, aside: str, path: str) -> None:
    jvm = spark._jvm
    Rename = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = next(x for x in Rename.getEnumConstants() if x.name() == "OVERWRITE")
    Path = jvm.org.apache.hadoop.fs.Path
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(Path(path).toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(Path(aside), Path(path), how)


def _body(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def _read(spark: SparkSession, path: str) -> LinearModel:
    b = _body(spark, path)
    return LinearModel(*(tuple(b[k]) for k in ("fields", "mean", "scale", "weight")), b["intercept"], b["threshold"])


def load(spark: SparkSession, path: str, fields: list[str] | tuple[str, ...]) -> LinearModel:
    """The artifact at ``path``; raises if there is none, or its fields aren't ``fields`` in that order. Read once a process and
    published file."""
    p, fs = _place(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(f"no artifact at {path}: publish one first")
    status = fs.getFileStatus(p)
    model = _cached(spark, path, status.getModificationTime(), status.getLen())
    if model.fields != tuple(fields):
        raise ValueError(f"the artifact at {path} has its fields in another order or has others")
    return model


@lru_cache(maxsize=32)
def _cached(spark: SparkSession, path: str, modified: int, size: int) -> LinearModel:
    return _read(spark, path)
