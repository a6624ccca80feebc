"""Exact retrieval, reranking and context selection over long tables (qid, did, score)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from .batches import numbered

BROADCAST_BYTES = 64 << 20
BLOCK = 256
ROWS = 4096


def _units(vectors) -> np.ndarray:
    x = np.array([np.nan_to_num(np.asarray(v, dtype=float)) for v in vectors])
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def cosine_topk(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(qid, did, score, rank): the k nearest corpus rows (did, v) of each query (qid, v), without the query itself.

    Queries go out in slices of at most 64 MB; each corpus partition scores them block by block and keeps k a
    query, and a window merges the partitions. Ties go to the smaller did; a vector without length has cosine -1.
    """
    spark = corpus.sparkSession
    ids = queries.where("v is not null").select("qid", "v")
    head = ids.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    per = max(1, BROADCAST_BYTES // max(1, 8 * (head["d"] or 1)))
    slices = max(1, -(-head["n"] // per))
    found = None
    for s in range(slices):
        part = ids.where(F.pmod(F.xxhash64("qid"), F.lit(slices)) == s).orderBy("qid").collect()
        if not part:
            continue
        box = spark.sparkContext.broadcast((np.array([r["qid"] for r in part]), _units([r["v"] for r in part])))

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, q = box.value
            zero = ~q.any(1)
            held_s = np.full((len(q), 0), 0.0)
            held_d = np.zeros((len(q), 0), np.int64)
            for b in batches:
                for lo in range(0, len(b), ROWS):
                    p = b.iloc[lo : lo + ROWS]
                    x, did = _units(p["v"]), p["did"].to_numpy()
                    new_s, new_d = [], []
                    for at in range(0, len(q), BLOCK):
                        sc = q[at : at + BLOCK] @ x.T
                        sc[:, ~x.any(1)] = -1.0
                        sc[zero[at : at + BLOCK]] = -1.0
                        sc[names[at : at + BLOCK][:, None] == did[None, :]] = -np.inf
                        alls = np.hstack([held_s[at : at + BLOCK], sc])
                        alld = np.hstack([held_d[at : at + BLOCK], np.broadcast_to(did, sc.shape)])
                        keep = np.lexsort((alld, -alls), axis=1)[:, :k]
                        new_s.append(np.take_along_axis(alls, keep, 1))
                        new_d.append(np.take_along_axis(alld, keep, 1))
                    held_s, held_d = np.vstack(new_s), np.vstack(new_d)
            if held_s.shape[1]:
                ok = np.isfinite(held_s)
                yield pd.DataFrame({"qid": np.repeat(names, held_s.shape[1])[ok.ravel()], "did": held_d.ravel()[ok.ravel()], "score": held_s.ravel()[ok.ravel()]})

        rows = corpus.where("v is not null").select("did", "v").mapInPandas(best, "qid long, did long, score double")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return spark.createDataFrame([], "qid long, did long, score double, rank int")
    return ranked(found).where(F.col("rank") <= k)


def ranked(run: DataFrame) -> DataFrame:
    """Ranks by falling score within a query; ties to the smaller did."""
    return run.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "did")))


def rerank(run: DataFrame, queries: DataFrame, corpus: DataFrame, top_k: int) -> DataFrame:
    """Rescore the first `top_k` of a run with other vectors: (qid, did, score, rank). Candidates are few, so this is two key joins."""
    c = run.where(F.col("rank") <= top_k).select("qid", "did")
    scored = c.join(queries.withColumnRenamed("v", "_q"), "qid").join(corpus.withColumnRenamed("v", "_d"), "did")
    return ranked(scored.select("qid", "did", V.cosine(F.col("_q"), F.col("_d")).alias("score")))


def context_topk(run: DataFrame, k: int) -> DataFrame:
    """(qid, ctx_pos, did): the top k as context; a short list is repeated from its start until k are there."""
    lists = run.where(F.col("rank") <= k).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "did"))).alias("l"))
    pos = lists.select("qid", "l", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("ctx_pos"))
    return pos.select("qid", "ctx_pos", F.get("l", (F.col("ctx_pos") % F.size("l")).cast("int"))["did"].alias("did"))


def context_interpolated(run: DataFrame, random: DataFrame, k: int, seed: str) -> DataFrame:
    """Union of the top k and k random documents (qid, did) per query, in hash order, cut to k."""
    both = run.where(F.col("rank") <= k).select("qid", "did").unionByName(random.select("qid", "did")).distinct()
    pos = F.row_number().over(Window.partitionBy("qid").orderBy(T.hash_order(seed, F.col("qid"), F.col("did")), "did")) - 1
    return both.withColumn("ctx_pos", pos).where(F.col("ctx_pos") < k).select("qid", "ctx_pos", "did")


def context_random(queries: DataFrame, corpus: DataFrame, k: int, seed: str) -> DataFrame:
    """(qid, ctx_pos, did): k documents of the whole corpus for each query, drawn with replacement by hash."""
    n = corpus.count()
    pos = queries.select("qid", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("ctx_pos"))
    drawn = pos.withColumn("rn", F.floor(T.uniform(seed, F.col("qid"), F.col("ctx_pos")) * n).cast("long"))
    return drawn.join(numbered(corpus.select("did"), [F.col("did")]), "rn").select("qid", "ctx_pos", "did")


def context_fake(queries: DataFrame, k: int) -> DataFrame:
    """(qid, ctx_pos, token, mask): a context of k equal tokens, to see what a model makes of none."""
    return queries.select("qid", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("ctx_pos"), F.lit(1).alias("token"), F.lit(1).alias("mask"))


def assemble_context(context: DataFrame, keys: list[str], size: int, null: list[float] | None = None, dropout: float = 0.0, seed: str = "drop") -> DataFrame:
    """(keys..., ctx_pos, v) of context vectors (keys..., ctx_pos, v): the first `size` positions of each context.

    With `null`, a share `dropout` of them (by hash) is replaced by that vector; all of them if dropout is 1. Rows that
    share a context carry its key and join it.
    """
    out = context.where(F.col("ctx_pos") < size)
    if null is not None:
        gone = T.uniform(seed, *[F.col(k) for k in keys], F.col("ctx_pos")) < dropout
        out = out.withColumn("v", F.when(gone, F.array(*[F.lit(float(x)) for x in null])).otherwise(F.col("v").cast("array<double>")))
    return out.select(*keys, "ctx_pos", "v")


def context_pooled(run: DataFrame, corpus: DataFrame, k: int, pools: int = 4) -> DataFrame:
    """(qid, ctx_pos, v): pools x k documents in `pools` runs of k; position j is the mean of the j-th of each run."""
    rows = run.where(F.col("rank") <= pools * k).withColumn("ctx_pos", (F.col("rank") - 1) % k).join(corpus, "did")
    return V.mean_vectors(rows, ["qid", "ctx_pos"], "v", "v")


def ensemble_queries(run: DataFrame, corpus: DataFrame, k: int, slices: int) -> DataFrame:
    """Query-side ensemble: for each query the mean over slices of the mean vector of ranks (j k, (j + 1) k]."""
    rows = run.where(F.col("rank") <= k * slices).withColumn("slice", F.floor((F.col("rank") - 1) / k)).join(corpus, "did")
    return V.mean_vectors(V.mean_vectors(rows, ["qid", "slice"], "v", "v"), ["qid"], "v", "v")


def agreement(first: DataFrame, second: DataFrame) -> DataFrame:
    """Share of queries whose best document is the same in both runs."""
    a = first.where("rank = 1").select("qid", F.col("did").alias("a"))
    b = second.where("rank = 1").select("qid", F.col("did").alias("b"))
    return a.join(b, "qid").agg(F.count("*").alias("n_queries"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("agreement"))


def process_qrels(qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """Judgements joined to corpus rows: (qid, did, rel, idx), idx null for a document that the corpus lacks."""
    return qrels.join(corpus.select("did", "idx"), "did", "left").select("qid", "did", "rel", "idx")


def first_queries(queries: DataFrame, n: int) -> DataFrame:
    """The first `n` queries in the order of their ids: a bounded evaluation set."""
    return queries.orderBy("qid").limit(n)


def large_enough(queries: DataFrame, dataset: str, least: int) -> DataFrame:
    """Queries of the datasets that have at least `least` of them; smaller sets are not evaluated."""
    sizes = queries.groupBy(dataset).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return queries.join(sizes.select(dataset), dataset, "left_semi")
