"""Tables and files in the folder that the cluster names in ``spark.checkpoint.dir``; every executor reaches it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The shared folder. Where the session names none, a temporary one is set if all runs in one process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


#: While it's true, Spark deletes a query's shuffle files when the query ends, and not only when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(df: DataFrame, name: str = "t", rows: int = 0) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it: cuts lineage and outlives any executor.

    ``rows`` bounds the rows of a file, where they are large: a writer holds a file's rows, and a reader thousands at once.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a table that may be told to every task.
TOLD = 32_000_000


def told(df: DataFrame, width: int) -> DataFrame:
    """A written table of rows of about ``width`` bytes, marked to be broadcast if by its count it's no larger than ``TOLD``."""
    return F.broadcast(df) if df.count() * width <= TOLD else df


def bucketed(df: DataFrame, by: str, name: str = "t") -> DataFrame:
    """As ``table``, with the rows of one ``by`` in one bucket, so that joins and groups by it don't move them again."""
    spark = df.sparkSession
    named = f"{name}_{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("path", f"{folder(spark)}/{named}").option("compression", "zstd").bucketBy(shards(spark), by).format("parquet").saveAsTable(named)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.table(named)
    out.named = named
    return out


def drop(*frames: DataFrame) -> None:
    """Deletes the files of what ``table`` or ``bucketed`` returned."""
    for df in frames:
        _drop(df)


def _drop(df: DataFrame) -> None:
    spark = df.sparkSession
    if "named" in df.__dict__:
        path = f"{folder(spark)}/{df.named}"
        spark.sql(f"DROP TABLE IF EXISTS {df.named}")
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        return
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop_folder(spark, path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shards(spark: SparkSession) -> int:
    """Partitions of packed exchanges: as many as the session's shuffles have."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def clean(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the columns an operator needs, so that others can't clash."""
    return docs.select(*columns)


def crc_mod(id_column: str, m: int) -> Column:
    return F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(m))


def put_arrays(place: str, **arrays) -> None:
    """Writes arrays side by side as files ``place-name.npy``; a rewrite by a repeated task puts the same bytes there."""
    import io
    import os

    import numpy as np

    for name, a in arrays.items():
        body = io.BytesIO()
        np.save(body, a)
        url = f"{place}-{name}.npy"
        if url.startswith("file:"):
            path = "/" + url.removeprefix("file:").lstrip("/")
            os.makedirs(os.path.dirname(path), exist_ok=True)
            own = f"{path}.{uuid.uuid4().hex}"
            with open(own, "wb") as f:
                f.write(body.getbuffer())
            os.replace(own, path)
        else:
            from pyarrow import fs

            system, path = fs.FileSystem.from_uri(url)
            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(path) as f:
                f.write(body.getbuffer())


def get_array(place: str, name: str):
    """An array of ``put_arrays``: mapped into memory where the folder is a file system's, read where it's a store's."""
    import io

    import numpy as np

    url = f"{place}-{name}.npy"
    if url.startswith("file:"):
        return np.load("/" + url.removeprefix("file:").lstrip("/"), mmap_mode="r")
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(url)
    with system.open_input_file(path) as f:
        return np.load(io.BytesIO(f.read()))
