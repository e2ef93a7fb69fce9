"""Sources and sinks beside Parquet: CSV, JSON lines and documents, resumable appends, swaps, files by key, checksums."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Keys keep the type that ``schema`` gives them; quoted fields may span lines."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def append_missing(rows: DataFrame, path: str, key: str) -> None:
    """Appends to JSON lines the rows whose key isn't there yet, so that a broken run can be taken up again.

    Of rows of one key in ``rows`` all are appended: drop repeats first if there may be any.
    """
    spark = rows.sparkSession
    if _exists(spark, path):
        done = spark.read.schema(rows.select(key).schema).json(path)
        rows = rows.join(done, key, "left_anti")
    rows.write.mode("append").json(path)


def replace_jsonl(rows: DataFrame, path: str) -> None:
    """Writes beside ``path`` and swaps, as ``rows`` may be read from it. The old rows are moved aside first and deleted
    last, so that a crash at any time leaves them or the new ones whole."""
    spark = rows.sparkSession
    aside, before = (f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    rows.write.json(aside)
    Path = spark._jvm.org.apache.hadoop.fs.Path
    target, new, old = Path(path), Path(aside), Path(before)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = fs.exists(target)
    if there and not fs.rename(target, old):
        raise OSError(f"rows are left in {aside}")
    if not fs.rename(new, target):
        raise OSError(f"rows are left in {aside}, the old ones in {before}")
    if there:
        fs.delete(old, True)


def write_by_key(rows: DataFrame, path: str, key: str) -> None:
    """A folder of JSON lines per value of ``key``, one file each, named by the value made safe and a hash of it, as two
    values may look alike then."""
    name = F.concat_ws("-", file_name(F.col(key)), F.hex(F.xxhash64(key)))
    rows.withColumn("file", name).repartition("file").write.partitionBy("file").json(path)


def read_json_array(spark: SparkSession, path: str, schema: str, field: str) -> DataFrame:
    """The rows of an array field of JSON documents."""
    d = spark.read.schema(f"`{field}` array<struct<{schema}>>").json(path, multiLine=True)
    return d.select(F.explode(field).alias("row")).select("row.*")


def read_scores_csv(spark: SparkSession, path: str, key: str, scores: list[str]) -> DataFrame:
    """A CSV whose key stays text and whose scores become numbers; what isn't a number becomes null."""
    d = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return d.select(F.col(key), *(F.expr(f"try_cast(`{c}` as double)").alias(c) for c in scores), *(c for c in d.columns if c != key and c not in scores))


def write_json_document(rows: DataFrame, path: str) -> None:
    """All rows as one JSON array in one text file: for reports, which are small; the write is one task's."""
    every = rows.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*rows.columns)))).alias("value"))
    every.coalesce(1).write.mode("overwrite").text(path)


def file_name(c: Column) -> Column:
    """What is neither letter nor digit becomes an underscore; none stay at the ends."""
    return F.trim(F.regexp_replace(c, "[^\\p{L}\\p{N}]", "_"), F.lit("_"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("md5"))


def verified(spark: SparkSession, path: str, expected: dict[str, str]) -> None:
    """Raises unless the files under ``path`` have the expected md5 sums, by file name, and no file is missing."""
    found = {r.path.rsplit("/", 1)[-1]: r.md5 for r in checksums(spark, path).collect()}
    wrong = sorted(name for name, md5 in expected.items() if found.get(name) != md5)
    if wrong:
        raise ValueError(f"not as expected: {', '.join(wrong)}")
