"""What the operators share: the work folder, joins with hot keys, bounded samples, a small regression."""

from __future__ import annotations

import ctypes
import gc
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..work import materialize, new_path, release, work_dir  # noqa: F401  the operators take them from here

def join_back(rows: DataFrame, sums: DataFrame, key: str) -> DataFrame:
    """Join rows with an aggregate over their own `key`, a long.

    The key is shifted: else the join takes the aggregate's exchange for its own, which Spark cannot split. So both
    sides have exchanges that were made for the join, and a partition with a hot key is split while the query runs.
    """
    shifted = F.col(key).bitwiseXOR(F.lit(1).cast("long"))
    return rows.withColumn("_shifted", shifted).join(sums.withColumn("_shifted", shifted).drop(key), "_shifted").drop("_shifted")


_caches: dict[str, Callable[[], None]] = {}


def only_cache(owner: str, drop: Callable[[], None] = lambda: None) -> None:
    """Worker processes outlive an operator: when one takes up its cache, the caches of the others go, and their memory back to the system."""
    if _caches.keys() != {owner}:
        for name, clear in list(_caches.items()):
            if name != owner:
                clear()
                del _caches[name]
        _caches[owner] = drop
        gc.collect()
        give_back()


def give_back() -> None:
    """Freed memory goes back to the system, which Arrow's pool and glibc keep otherwise: workers idle beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column | str, folds: int) -> Column:
    """crc32 of the key as text, modulo `folds`; 0 for a null key."""
    col = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(col.cast("string").cast("binary")), F.lit(0)) % folds


def bounded_sample(df: DataFrame, key: str, bound: int, count: int) -> DataFrame:
    """At most `bound` rows of `df` (which has `count` rows), chosen by a hash of `key`.

    The hash first thins the rows to about 1.3 x bound, so that the final sort sees a bounded number of them.
    """
    h = F.xxhash64(F.col(key), F.lit(17))
    if count > bound:
        share = min(1.0, 1.3 * bound / count + 50 / count)
        df = df.where(F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30)))
    return df.orderBy(h, key).limit(bound)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 100) -> np.ndarray:
    """Weighted logistic regression by Newton steps, halved until they lower the loss; the first coefficient is the intercept."""
    a = np.hstack([np.ones((len(x), 1)), x])
    beta = np.zeros(a.shape[1])
    penalty = np.eye(a.shape[1]) * ridge
    penalty[0, 0] = 1e-9

    def loss(b: np.ndarray) -> float:
        z = a @ b
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + b @ penalty @ b / 2)

    now = loss(beta)
    for _ in range(rounds):
        p = sigmoid(a @ beta)
        grad = a.T @ (weight * (y - p)) - penalty @ beta
        hess = (a * (weight * p * (1 - p) + 1e-9)[:, None]).T @ a + penalty
        step = np.linalg.solve(hess, grad)
        while (then := loss(beta + step)) > now + 1e-12 * abs(now) and np.abs(step).max() >= 1e-8:
            step = step / 2
        beta, now = beta + step, then
        if np.abs(step).max() < 1e-8:
            break
    return beta


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def binomial_tail(n: int, p: float, below: int) -> float:
    """P(Bin(n, p) < below)."""
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(below))
