"""Vector functions over arrays; doubles throughout. Column functions stay in the JVM, group means go through Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; -1 where it is no number."""
    c = dot(a, b) / (norm(a) * norm(b))
    return F.when(c.isNull() | F.isnan(c), F.lit(-1.0)).otherwise(c)


def normalize(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    return F.transform(F.array(F.struct(norm(a).alias("n"), a.alias("v"))), lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x.cast("double") / s["n"]).otherwise(x.cast("double"))))[0]


def weighted_mean(states: Column, weights: Column, epsilon: float) -> Column:
    """Sum of weighted state vectors over the sum of weights and epsilon; states: array<array<double>>."""
    width = F.size(F.get(states, F.lit(0)))
    total = F.aggregate(weights, F.lit(0.0), lambda s, w: s + w.cast("double")) + F.lit(epsilon)

    def column(j: Column) -> Column:
        return F.aggregate(F.zip_with(states, weights, lambda v, w: F.get(v, j).cast("double") * w.cast("double")), F.lit(0.0), lambda s, x: s + x) / total

    return F.transform(F.sequence(F.lit(0), width - 1), column)


def mean_pool(states: Column, mask: Column) -> Column:
    return weighted_mean(states, mask, 1e-20)


def weighted_pool(states: Column, mask: Column) -> Column:
    """Later positions weigh more: 1, 2, 3, ... over the positions of the mask."""
    rank = F.transform(mask, lambda m, i: m * F.aggregate(F.slice(mask, F.lit(1), i + 1), F.lit(0), lambda s, x: s + x.cast("int")))
    return weighted_mean(states, rank, 0.0)


def last_token_pool(states: Column, mask: Column) -> Column:
    """State at the last position of the mask; the first one where the mask is empty."""
    last = F.size(mask) - F.array_position(F.reverse(mask), 1).cast("int")
    return F.get(states, F.when(F.array_contains(mask, 1), last).otherwise(F.lit(0)))


def mean_pool_segments(states: Column, mask: Column, segment: int) -> Column:
    """Mean per segment of `segment` positions; a segment without a masked position takes the mean of all positions."""
    count = F.ceil(F.size(mask) / segment).cast("int")
    ones = F.transform(mask, lambda m: F.lit(1))

    def one(k: Column) -> Column:
        s, m = F.slice(states, k * segment + 1, F.lit(segment)), F.slice(mask, k * segment + 1, F.lit(segment))
        return F.when(F.array_contains(m, 1), weighted_mean(s, m, 1e-9)).otherwise(weighted_mean(states, ones, 0.0))

    return F.transform(F.sequence(F.lit(0), count - 1), one)


def instruction_mask(tokens: Column, mask: Column, end: int) -> Column:
    """Mask out everything up to the first `end` token after position 0; no such token masks nothing."""
    at = F.array_position(F.slice(tokens, F.lit(2), F.size(tokens)), end)
    return F.transform(mask, lambda m, i: F.when((at > 0) & (i <= at), F.lit(0)).otherwise(m.cast("int")))


def mean_vectors(rows: DataFrame, keys: list[str], vector: str, out: str = "centroid") -> DataFrame:
    """Mean vector of each group. Every Arrow batch is summed by group before its components are, so that few rows are shuffled and no group meets in one task."""
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[b["_v"].notna()]
            if not len(b):
                continue
            x = np.stack(b["_v"].to_numpy()).astype(float)
            groups = b.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(groups, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(groups[order]) != 0])
            part = b[keys].iloc[order[first]].reset_index(drop=True)
            part["_s"], part["_n"] = list(np.add.reduceat(x[order], first)), np.diff(np.r_[first, len(b)])
            yield part

    parts = rows.select(*keys, F.col(vector).cast("array<double>").alias("_v")).mapInPandas(partial, f"{kinds}, _s array<double>, _n long")
    sums = parts.select(*keys, "_n", F.posexplode("_s").alias("_j", "_x")).groupBy(*keys, "_j").agg(F.sum("_x").alias("_x"), F.sum("_n").alias("_n"))
    listed = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_j", (F.col("_x") / F.col("_n")).alias("_x")))).alias("_v"))
    return listed.select(*keys, F.transform("_v", lambda s: s["_x"]).alias(out))
