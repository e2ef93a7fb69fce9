"""Sinks by key: one file a key by a two-phase commit, and appends that read nothing but the keys of earlier ones."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .files import _exists, file_name


def _system(url: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(url if "://" in url or url.startswith("file:") else f"file://{url}")


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    names: list[str]


class _KeyedWriter(DataSourceWriter):
    """Tasks write files to folders of their own; only those of the tasks that the job counts are moved into place, and the rest
    goes. So a task that is repeated, or runs twice at once, leaves one file a key."""

    def __init__(self, path: str, job: str):
        self.path, self.staging = path.rstrip("/"), f"{path.rstrip('/')}/_staging-{job}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        own = f"{self.staging}/{uuid.uuid4().hex}"
        system, place = _system(own)
        names = []
        for name, rows in groupby(iterator, key=lambda r: r.file):
            if not names:
                system.create_dir(place, recursive=True)
            with system.open_output_stream(f"{place}/{name}.json") as out:
                for r in rows:
                    out.write(r.value.encode() + b"\n")
            names.append(name)
        return _Written(own, names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, target = _system(self.path)
        system.create_dir(target, recursive=True)
        for m in messages:
            if isinstance(m, _Written):
                place = _system(m.folder)[1]
                for name in m.names:
                    system.move(f"{place}/{name}.json", f"{target}/{name}.json")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        system, place = _system(self.staging)
        if system.get_file_info(place).type != fs.FileType.NotFound:
            system.delete_dir(place)


class KeyedFiles(DataSource):
    """Rows ``(file, value)``, those of one file next to each other in one task, as files of lines."""

    @classmethod
    def name(cls) -> str:
        return "keyed_files"

    def schema(self) -> str:
        return "file string, value string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _KeyedWriter(self.options["path"], self.options["job"])


def write_files(rows: DataFrame, path: str, key: str, order: str | None = None, hashed: bool = True) -> None:
    """One file of JSON lines per value of ``key`` in the folder ``path``, replacing files of that name.

    A file is named by the key made safe and, as two keys may look alike then, a hash of it; without ``hashed`` by the former
    alone, and keys that look alike share a file. Lines go by ``order``, or by themselves. Null keys are a key.
    """
    rows.sparkSession.dataSource.register(KeyedFiles)
    safe = F.coalesce(file_name(F.col(key).cast("string")), F.lit(""))
    name = F.concat_ws("-", safe, F.lower(F.hex(F.xxhash64(key)))) if hashed else safe
    lines = rows.select(name.alias("file"), F.to_json(F.struct(*rows.columns)).alias("value"), (F.col(order) if order else F.lit(0)).alias("order"))
    lines = lines.repartition("file").sortWithinPartitions("file", "order", "value").select("file", "value")
    lines.write.format("keyed_files").mode("append").option("path", path).option("job", uuid.uuid4().hex).save()


# Appends


def _batches(spark: SparkSession, path: str, part: str) -> str | None:
    return f"{path.rstrip('/')}/batches/*/{part}" if _exists(spark, f"{path.rstrip('/')}/batches") else None


def done_keys(spark: SparkSession, path: str, key: str, kind: str) -> DataFrame:
    """The keys that were appended to ``path``; of the sink nothing else is read."""
    place = _batches(spark, path, "keys")
    return spark.read.schema(f"`{key}` {kind}").parquet(place) if place else spark.createDataFrame([], f"`{key}` {kind}")


def append_new(rows: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key isn't there yet; returns how many. Of rows of one key in ``rows`` all are appended; a null key
    is never there yet.

    An append is a batch: its rows as JSON lines and its keys as a table of their own. Both are written aside, and the batch
    joins the others by one rename; a run that breaks off before leaves nothing that is read, and may be taken up again.
    """
    spark = rows.sparkSession
    done = done_keys(spark, path, key, rows.schema[key].dataType.simpleString())
    batch = uuid.uuid4().hex
    aside, target = f"{path.rstrip('/')}/_aside/{batch}", f"{path.rstrip('/')}/batches/{batch}"
    rows.join(done, key, "left_anti").write.json(f"{aside}/rows")
    new = spark.read.schema(rows.schema).json(f"{aside}/rows")
    new.select(key).distinct().write.parquet(f"{aside}/keys")
    n = new.count()
    p = spark._jvm.org.apache.hadoop.fs.Path
    fs = p(aside).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not n:
        fs.delete(p(aside), True)
        return 0
    fs.mkdirs(p(target).getParent())
    if not fs.rename(p(aside), p(target)):
        raise OSError(f"rows are left in {aside}")
    return n


def read_appended(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of the finished batches."""
    place = _batches(spark, path, "rows")
    return spark.read.schema(schema).json(place) if place else spark.createDataFrame([], schema)
