"""Exact nearest neighbours by cosine similarity, in blocks of queries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Queries that are told to the tasks at a time.
BLOCK = 2048


def nearest(vectors: DataFrame, key: str, vector: str, asked: Column, k: int) -> DataFrame:
    """``(query_id, key, similarity)``: for the vectors that ``asked`` names, the ``k`` of all vectors of the highest cosine
    similarity, rounded to four places, the least keys of equals; 0 where either has no length.

    Each block of ``BLOCK`` queries is broadcast and meets all vectors as matrices; a batch keeps ``k`` of each query, and
    these few meet by query. Null keys and vectors are left out. Repeated keys count each.
    """
    spark = vectors.sparkSession
    own = vectors.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias("v"))
    queries = own.where(asked)
    blocks = max(1, -(-queries.count() // BLOCK))
    schema = f"query_id long, `{key}` long, similarity double"

    def searcher(told):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = told.value
            for batch in batches:
                if not batch.num_rows or not len(ids):
                    continue
                mine = batch.column(key).to_numpy(zero_copy_only=False)
                v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                norms = np.linalg.norm(v, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None, :]
                s = np.round(np.where(norms > 0, v @ q.T / np.where(norms > 0, norms, 1), 0.0), 4)
                best = [np.lexsort((mine, -s[:, j]))[:k] for j in range(len(ids))]
                n = [len(b) for b in best]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(mine[np.concatenate(best)]), pa.array(np.concatenate([s[b, j] for j, b in enumerate(best)]))], names=["query_id", key, "similarity"])

        return run

    parts = []
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).collect()
        told = spark.sparkContext.broadcast((np.array([r[key] for r in rows], np.int64), np.array([r.v for r in rows], np.float64)))
        parts.append(own.mapInArrow(searcher(told), schema))
    w = W.partitionBy("query_id").orderBy(F.desc("similarity"), key)
    every = reduce(DataFrame.unionByName, parts)
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")
