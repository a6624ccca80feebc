"""Exact top-k search by distributed histogram selection.

All candidates are scored against all queries, block by block. For each query a global histogram of scores over
an integer range is summed from the partitions; the bin that holds the k-th highest value becomes the next range,
with the bin's own upper end whatever the finer bins cover, until it is one value wide. Then every score from that value on is a result or a tie at the end, and ties go to
the smaller id. A partition's histogram leaves out the bins under its own k-th value, which the global k-th
value cannot be in. Queries go in slices of `slice_queries`, each broadcast with a known size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, new_path, release

SLICE_QUERIES = 4096
BINS = 128
BLOCK = 512
ROWS = 2048
EXACT = 1 << 53
LARGEST = (1 << 62) - 1  # of a score


def integer_vectors(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """vec_id and v, floor(scale * component) as array<long>; without rows of null id and vectors that are null or hold null or non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(fine)
    return out.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(F.lit(scale) * x)).alias("v"))


class Slice:
    """Queries by dimension, with the range of scores that each is looking for."""

    def __init__(self, ids: list[int], vectors: list[list[int]]):
        self.ids = np.array(ids, "i8")
        self.dims: dict[int, np.ndarray] = {}
        for n in sorted({len(v) for v in vectors}):
            self.dims[n] = np.array([i for i, v in enumerate(vectors) if len(v) == n])
        self.matrix = {n: np.array([vectors[i] for i in at], "i8").reshape(len(at), n) for n, at in self.dims.items()}

    def blocks(self, batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query positions, candidate ids, scores queries x candidates) of all pairs of one dimension."""
        for b in batches:
            size = b["v"].map(len).to_numpy()
            for n, at in self.dims.items():
                mine = np.flatnonzero(size == n)
                for lo in range(0, len(mine), ROWS):
                    p = mine[lo : lo + ROWS]
                    x = np.array(b["v"].iloc[p].tolist(), "i8").reshape(len(p), n)
                    ids = b["vec_id"].to_numpy()[p]
                    big = max(1, int(np.abs(x).max(initial=0))) * n
                    for q in range(0, len(at), BLOCK):
                        m = self.matrix[n][q : q + BLOCK]
                        if big * int(np.abs(m).max(initial=0)) < EXACT:  # doubles hold every partial sum
                            s = (m.astype("f8") @ x.T.astype("f8")).astype("i8")
                        else:
                            s = m @ x.T
                        yield at[q : q + BLOCK], ids, s


def top_k(queries: DataFrame, corpus: DataFrame, *, k: int = 10, slice_queries: int = SLICE_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query with rows of the corpus of another id.

    Both inputs are (vec_id long, v array<long>), as `integer_vectors` makes them. Fewer than k candidates give
    fewer rows, none give none; vectors of different length are no pair; rows that repeat an id are candidates of
    their own. Scores must be under 2^62. An empty side gives an empty result.
    """
    spark = corpus.sparkSession
    path, written = new_path(spark, "top-k"), False
    queries, corpus = materialize(queries, "queries"), materialize(corpus, "corpus")
    # the largest norm bounds every score: |q . x| <= |q| |x|
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    reach = corpus.agg(F.max(norm)).first()[0]
    n = queries.count()
    slices = -(-n // slice_queries) if reach is not None else 0
    order = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, slices)))
    for i in range(slices):
        held = queries.where(order == i).select("vec_id", "v").toArrow()  # about slice_queries rows
        if not held.num_rows:
            continue
        part = Slice(held["vec_id"].to_pylist(), held["v"].to_pylist())
        bounds = _select(spark, part, corpus, k, float(reach))
        rows = _passing(spark, part, corpus, k, bounds)
        rank = F.row_number().over(Window.partitionBy("query_id", "_pos").orderBy(F.desc("score"), "vec_id"))
        # a slice's result is written, so that no plan grows with the number of queries
        rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
        written = True
    for x in (queries, corpus):
        release(x)
    schema = "query_id long, rank int, vec_id long, score long"
    return spark.read.schema(schema).parquet(path) if written else spark.createDataFrame([], schema)


def _select(spark, part: Slice, corpus: DataFrame, k: int, reach: float) -> np.ndarray:
    """The k-th highest score of each query, or a bound under all its scores if it has fewer candidates."""
    norms = np.zeros(len(part.ids))
    for n, at in part.dims.items():
        norms[at] = np.sqrt((part.matrix[n].astype("f8") ** 2).sum(1))
    top = np.array([min(int(np.ceil(x * reach * (1 + 1e-9))) + 1, LARGEST) for x in norms], dtype=object)
    low, width = -top, np.array([max(1, -(-(2 * int(t) + 1) // BINS)) for t in top], dtype=object)
    high = low + BINS * width  # exclusive; scores from there on are already taken from `want`
    want = np.full(len(part.ids), k)
    done = np.zeros(len(part.ids), bool)
    first = low.copy()
    while not done.all():
        lo, hi, w = low.astype("i8"), high.astype("i8"), width.astype("i8")
        box = spark.sparkContext.broadcast((part, lo, hi, w, want, done))

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            part, lo, hi, w, want, done = box.value
            bins = np.zeros((len(part.ids), BINS + 1), "i8")  # the last: scores over the range
            for q, ids, s in part.blocks(batches):
                live = ~done[q]
                q, s = q[live], s[live]
                b = (s - lo[q][:, None]) // w[q][:, None]
                ok = (b >= 0) & (s < hi[q][:, None]) & (ids[None, :] != part.ids[q][:, None])
                at, col = np.nonzero(ok)
                bins += np.bincount(q[at] * (BINS + 1) + b[at, col], minlength=bins.size).reshape(bins.shape)
            above = np.cumsum(bins[:, ::-1], axis=1)[:, ::-1] - bins  # scores in higher bins
            q, b = np.nonzero((bins > 0) & (above < want[:, None]))
            if len(q):
                yield pd.DataFrame({"q": q, "b": b, "n": bins[q, b]})

        rows = corpus.mapInPandas(count, "q long, b long, n long").groupBy("q", "b").agg(F.sum("n").alias("n"))
        higher = F.coalesce(F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        wanted = spark.createDataFrame(pd.DataFrame({"q": np.arange(len(want)), "want": want}), "q long, want long")
        hit = rows.withColumn("above", higher).join(F.broadcast(wanted), "q").where("above < want and above + n >= want").select("q", "b", "above").collect()  # a row a query
        seen = {r["q"]: r for r in hit}
        box.unpersist()
        for q in np.flatnonzero(~done):
            r = seen.get(int(q))
            if r is None:  # fewer candidates than k: all of them pass
                done[q], low[q] = True, first[q]
                continue
            low[q] = int(low[q]) + int(r["b"]) * int(width[q])
            high[q] = min(int(high[q]), int(low[q]) + int(width[q]))
            want[q] -= r["above"]
            if width[q] == 1:
                done[q] = True
            else:
                width[q] = max(1, -(-int(width[q]) // BINS))
    return low.astype("i8")


def _passing(spark, part: Slice, corpus: DataFrame, k: int, bounds: np.ndarray) -> DataFrame:
    """Scores from the k-th value on; of a partition's ties at the end the k smallest ids are enough."""
    box = spark.sparkContext.broadcast((part, bounds))

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, floor = box.value
        held = None
        for q, ids, s in part.blocks(batches):
            at, col = np.nonzero((s >= floor[q][:, None]) & (ids[None, :] != part.ids[q][:, None]))
            if not len(at):
                continue
            new = pd.DataFrame({"_pos": q[at], "vec_id": ids[col], "score": s[at, col]})
            held = new if held is None else pd.concat([held, new])
            if len(held) > 200_000:
                held = best(held)
        if held is not None:
            held = best(held)
            yield held.assign(query_id=part.ids[held["_pos"].to_numpy()])[["query_id", "_pos", "vec_id", "score"]]

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.sort_values(["_pos", "score", "vec_id"], ascending=[True, False, True]).groupby("_pos", sort=False).head(k)

    return corpus.mapInPandas(keep, "query_id long, _pos long, vec_id long, score long")
