"""Mixing sources to target weights by subset sums over exact lengths.

Each source's target is filled in three steps: whole passes over the source, seeded documents of every length in
proportion, and for what is left a bounded-knapsack dynamic program over the length counts. Only the histogram
``(source, length) -> documents`` reaches the program; documents are then picked by seeded rank within their length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import table, told

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Words left open for the dynamic program; documents longer than this may leave it more, up to the longest's length.
RESERVE = 60_000
#: Where the target isn't met, the program is given more documents anew, up to so many words.
WIDEST = 4_000_000
WORD = "[^\\x20\\x09-\\x0D]+"


def targets(sizes: list[int], weights: list[int], cap: int = MAX_REPEATS) -> list[float]:
    """Shares the sum of all sizes by weight; none gets over ``cap`` times its size, the excess is shared anew."""
    total, open_, out = float(sum(sizes)), list(range(len(sizes))), [0.0] * len(sizes)
    left = total
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = float(cap * sizes[i])
        left -= sum(cap * sizes[i] for i in over)
        open_ = [i for i in open_ if i not in over]
    return out


def fill(lengths: np.ndarray, counts: np.ndarray, budget: int, reserve: int = RESERVE) -> np.ndarray:
    """How many documents of each length to take so that their words sum to ``budget`` or as near as can be, either side.

    First the same share of every length, less a reserve; then a bounded-knapsack program over the documents left decides
    the rest. All is counted in the lengths' greatest common divisor. If the nearest sum isn't met, the program is given a
    wider reserve, doubled up to ``WIDEST`` units; a reserve of the whole budget is exact. Of two sums as near the smaller
    one is taken. Lengths are positive and distinct.
    """
    if not len(lengths) or budget <= 0:
        return np.zeros(len(lengths), np.int64)
    unit = int(np.gcd.reduce(lengths))
    lengths = lengths // unit
    total = int((lengths * counts).sum())
    if budget >= total * unit:
        return counts.copy()
    off = lambda take: abs(int((lengths * take).sum()) * unit - budget)
    least = min(budget % unit, unit - budget % unit)
    best = _fill(lengths, counts, budget / unit, reserve)
    while off(best) > least and reserve < min(budget // unit, WIDEST):
        reserve = min(2 * reserve, WIDEST)
        best = min(best, _fill(lengths, counts, budget / unit, reserve), key=off)
    return best


def _fill(lengths: np.ndarray, counts: np.ndarray, budget: float, reserve: int) -> np.ndarray:
    take, total = np.zeros(len(lengths), np.int64), int((lengths * counts).sum())
    if budget > reserve:
        take = np.floor(counts * ((budget - reserve // 2) / total)).astype(np.int64)
        for k in np.argsort(-lengths, kind="stable"):  # long lengths first, while more than the reserve is open
            gap = int(budget) - reserve - int((lengths * take).sum())
            if gap <= 0:
                break
            take[k] += min(counts[k] - take[k], gap // lengths[k])
    rest = budget - int((lengths * take).sum())
    if rest > reserve:  # only where documents longer than the reserve are left
        for k in np.argsort(-lengths, kind="stable"):
            n = min(int(counts[k] - take[k]), max(0, int(rest - reserve // 2) // int(lengths[k])))
            take[k] += n
            rest -= n * int(lengths[k])
            if rest <= reserve:
                break
    # documents left are longer than rest - reserve // 2 here, so the table is no longer than twice the reserve and the longest
    left = lengths[counts > take]
    top = int(rest) + (min(int(left.max()), int(rest) + int(left.min())) if len(left) else 0)  # a sum beyond the rest is as near at most
    reach = np.zeros(top + 1, bool)
    reach[0] = True
    step, size = np.full(top + 1, -1, np.int32), np.zeros(top + 1, np.int32)
    aim = int(np.rint(rest))
    for k in np.argsort(-lengths, kind="stable"):
        if reach[aim]:
            break
        spare, part = int(counts[k] - take[k]), 1
        while spare > 0:  # binary parts of the bound
            n = min(part, spare)
            jump = n * int(lengths[k])
            if jump > top:
                break
            new = np.zeros_like(reach)
            new[jump:] = reach[:-jump]
            new &= ~reach
            step[new], size[new] = k, n
            reach |= new
            spare, part = spare - n, part * 2
    sums = np.flatnonzero(reach)
    at = int(sums[np.argmin(np.abs(sums - rest))])
    while at > 0:
        k, n = step[at], size[at]
        take[k] += n
        at -= int(n) * int(lengths[k])
    return take


def _plan(group: pd.DataFrame) -> pd.DataFrame:
    group = group[group["size"] > 0].sort_values("size")
    lengths, counts = group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
    if not len(group):
        return pd.DataFrame({"source": pd.Series(dtype=object), "size": pd.Series(dtype="int64"), "passes": pd.Series(dtype="int64"), "extra": pd.Series(dtype="int64")})
    total, want = int((lengths * counts).sum()), int(np.rint(group["target"].iloc[0]))
    passes = min(MAX_REPEATS, want // total)
    extra = fill(lengths, counts, want - passes * total) if passes < MAX_REPEATS else np.zeros(len(lengths), np.int64)
    return pd.DataFrame({"source": group["source"], "size": lengths, "passes": passes, "extra": extra})


def plan_mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """One row per row of ``docs(doc_id, text, source)``: size, source_size, target and taken (words).

    A null source is a source of its own, the last; a null text has size 0 and is taken 0 times. Repeated rows count
    as documents of their own; the seeded rank tells rows of one length apart by id and, for repeated ids, arbitrarily
    but with the same total. An empty table gives no rows. One row per source reaches the driver, documents don't.
    """
    rows, sources = _ranked(docs, seed)
    taken = F.col("o.size") * (F.col("o.passes") + F.col("o.more").cast("long"))
    both = rows.alias("o").join(sources.alias("s"), F.expr("o.source <=> s.source"))
    return both.select("o.doc_id", "o.size", "s.source_size", "s.target", taken.alias("taken"))


def _sized(docs: DataFrame, seed: int, *more: Column) -> DataFrame:
    """Id, source, size and seeded hash of each row, and ``more``."""
    d = docs.select(*more, F.col("doc_id").cast("long").alias("doc_id"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    return d.withColumn("h", F.xxhash64("doc_id", F.lit(seed)))


def _place() -> Column:
    """A row's place among those of its source and length, which are taken in this order."""
    return F.struct(F.shiftrightunsigned("h", 56).alias("part"), "h", "doc_id")


def _ranked(docs: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Per row of ``docs``, without its text: how many ``passes`` over its source take it, and whether it's taken once
    ``more``; and the sources with their size and target."""
    spark = docs.sparkSession
    d = table(_sized(docs, seed), "sizes")
    # 256 parts of each length group, by the seeded hash: a group of any size is ranked part by part
    parts = d.groupBy("source", "size", F.shiftrightunsigned("h", 56).alias("part")).agg(F.count("*").alias("n"))
    parts = table(parts, "parts")
    by_source = parts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")).collect()
    by_source.sort(key=lambda r: (r.source is None, r.source or ""))
    goals = targets([r.source_size for r in by_source], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(by_source))])
    sources = spark.createDataFrame([(r.source, r.source_size, t) for r, t in zip(by_source, goals, strict=True)], "source string, source_size long, target double")
    lengths = parts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    histogram = lengths.alias("l").join(sources.alias("s"), F.expr("l.source <=> s.source")).select("l.source", "size", "n", "target")
    plan = histogram.groupBy("source").applyInPandas(_plan, "source string, size long, passes long, extra long")
    before = F.coalesce(F.sum("n").over(W.partitionBy("source", "size").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("before", before)
    quota = parts.alias("p").join(plan.alias("q"), F.expr("p.source <=> q.source and p.size = q.size")).select("p.source", "p.size", "p.part", "q.passes", F.greatest(F.lit(0), F.least(F.col("p.n"), F.col("q.extra") - F.col("p.before"))).alias("quota"))
    rank = F.row_number().over(W.partitionBy("source", "size", "part").orderBy("h", "doc_id"))
    ranked = d.withColumn("part", F.shiftrightunsigned("h", 56)).withColumn("rank", rank)
    out = ranked.alias("d").join(quota.alias("q"), F.expr("d.source <=> q.source and d.size = q.size and d.part = q.part"), "left")
    more = F.coalesce(F.col("d.rank") <= F.col("q.quota"), F.lit(False))
    return out.select("d.doc_id", "d.source", "d.size", "d.h", F.coalesce("q.passes", F.lit(0)).alias("passes"), more.alias("more")), sources


def _cuts(rows: DataFrame) -> DataFrame:
    """Per source and length: the passes, the place ``cut`` of the last row that is taken once more, and how many rows of
    that place there are, ``n``, and are taken, ``k``: these differ only where an id is repeated."""
    at = rows.groupBy("source", "size", "passes", _place().alias("at")).agg(F.count("*").alias("n"), F.count_if("more").alias("k"))
    last = F.max(F.when(F.col("k") > 0, F.struct("at", "n", "k")))
    return at.groupBy("source", "size").agg(F.max("passes").alias("passes"), last.alias("last")).select("source", "size", "passes", F.col("last.at").alias("cut"), "last.n", "last.k").where("passes > 0 or cut is not null")


def mixed_documents(docs: DataFrame, seed: int = 17, repeats: str = "repeats") -> DataFrame:
    """The rows of ``docs`` that the mix takes, all columns, and how often each is taken, in a column named ``repeats``,
    which ``docs`` must not have. Rows of one id are taken each for itself. An empty table gives no rows."""
    if repeats in docs.columns:
        raise ValueError(f"the documents have a column {repeats}; name another one for the repeats")
    cuts = table(_cuts(_ranked(docs, seed)[0]), "cuts")
    # texts stay where they lie: which rows are taken follows from one place a source and length
    d = _sized(docs, seed, F.struct(*docs.columns).alias("row")).withColumn("at", _place())
    both = d.alias("d").join(told(cuts, 96).alias("c"), F.expr("d.source <=> c.source and d.size = c.size"))
    both = both.select("d.row", "d.source", "d.size", "d.at", "c.passes", "c.cut", "c.n", "c.k", F.coalesce(F.expr("d.at <= c.cut"), F.lit(False)).alias("more"))
    if not cuts.where("k < n").isEmpty():
        tied = F.coalesce(F.expr("at = cut and k < n"), F.lit(False))
        rank = F.row_number().over(W.partitionBy("source", "size").orderBy(F.xxhash64("row.text")))
        both = both.where(~tied).unionByName(both.where(tied).withColumn("more", rank <= F.col("k")))
    times = F.col("passes") + F.col("more").cast("long")
    return both.where(times > 0).select(*(F.col("row").getField(c).alias(c) for c in docs.columns), times.alias(repeats))


def op9_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
