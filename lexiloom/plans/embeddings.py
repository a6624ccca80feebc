"""Queries over pooling and vector algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import encoder
from ..sources import tables
from .base import VEC_PAIRS, query, shorten, tokens_sql, vec_pairs

#: Token states for the pooling queries: the 64 numbers of a vector as 8 positions of 8, masked by vec_id.
STATES = "st as (select vec_id, list_transform(range(8), lambda t: list_transform(range(8), lambda j: cast(embedding[t * 8 + j + 1] as double))) as h, list_transform(range(8), lambda t: cast(case when t <= vec_id % 8 then 1 else 0 end as integer)) as m from embeddings)"


def states(spark, d):
    e = tables.read_table(spark, d, "embeddings")
    steps = F.sequence(F.lit(0), F.lit(7))
    h = F.transform(steps, lambda t: F.transform(F.slice("embedding", t * 8 + 1, F.lit(8)), lambda x: x.cast("double")))
    return e.select("vec_id", h.alias("h"), F.transform(steps, lambda t: F.when(t <= F.col("vec_id") % 8, 1).otherwise(0)).alias("m"))


def rounded(vector, digits=6):
    return F.transform(vector, lambda x: shorten(x, digits))


def pool_sql(weight: str, total: str) -> str:
    return f"with {STATES} select vec_id, list_transform(range(8), lambda j: round(list_sum(list_transform(range(8), lambda t: h[t + 1][j + 1] * {weight})) / {total}, 6) + 0.0) as v from st"


@query("mean_pool", pool_sql("m[t + 1]", "list_sum(m)"))
def mean_pool(spark, d):
    return states(spark, d).select("vec_id", rounded(V.mean_pool(F.col("h"), F.col("m"))).alias("v"))


@query("weighted_pool", pool_sql("m[t + 1] * (t + 1)", "list_sum(list_transform(range(8), lambda t: m[t + 1] * (t + 1)))"))
def weighted_pool(spark, d):
    return states(spark, d).select("vec_id", rounded(V.weighted_pool(F.col("h"), F.col("m"))).alias("v"))


@query("last_token_pool", f"with {STATES} select vec_id, list_transform(h[greatest(1, cast(list_sum(m) as bigint))], lambda x: round(x, 6) + 0.0) as v from st")
def last_token_pool(spark, d):
    return states(spark, d).select("vec_id", rounded(V.last_token_pool(F.col("h"), F.col("m"))).alias("v"))


@query(
    "mean_pool_segments",
    f"with {STATES} select vec_id, list_transform(range(4), lambda s: list_transform(range(8), lambda j: round(case when m[2 * s + 1] + m[2 * s + 2] > 0 then (h[2 * s + 1][j + 1] * m[2 * s + 1] + h[2 * s + 2][j + 1] * m[2 * s + 2]) / (m[2 * s + 1] + m[2 * s + 2] + 1e-9) else list_sum(list_transform(range(8), lambda t: h[t + 1][j + 1])) / 8 end, 5) + 0.0)) as v from st",
)
def mean_pool_segments(spark, d):
    return states(spark, d).select("vec_id", F.transform(V.mean_pool_segments(F.col("h"), F.col("m"), 2), lambda v: rounded(v, 5)).alias("v"))


@query("l2_normalize", "select vec_id, list_transform(embedding, lambda x: round(cast(x as double) / sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))), 5) + 0.0) as v from embeddings")
def l2_normalize(spark, d):
    e = tables.read_table(spark, d, "embeddings")
    return e.select("vec_id", rounded(V.normalize(F.col("embedding")), 5).alias("v"))


@query("instruction_mask", f"with t as (select doc_id, {tokens_sql('text', 50, 32)} as ids from documents) select doc_id, list_transform(range(len(ids)), lambda i: cast(case when i <= coalesce(list_position(ids[2:], 7), 0) and coalesce(list_position(ids[2:], 7), 0) > 0 then 0 else 1 end as integer)) as mask from t")
def instruction_mask(spark, d):
    t = tables.read_table(spark, d, "documents").select("doc_id", T.token_ids(F.col("text"), 50, 32).alias("ids"))
    return t.select("doc_id", V.instruction_mask(F.col("ids"), F.transform("ids", lambda i: F.lit(1)), 7).alias("mask"))


@query("context_truncate", "with r as (select vec_id, label, row_number() over (partition by label order by vec_id) - 1 as pos from embeddings) select label, pos, vec_id from r where pos < 16")
def context_truncate(spark, d):
    from pyspark.sql import Window

    e = tables.read_table(spark, d, "embeddings")
    pos = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long")
    return e.withColumn("pos", pos).where("pos < 16").select("label", "pos", "vec_id")


MAXSIM = "c as (select vec_id as centroid, cast(embedding as double[]) as c from embeddings where vec_id < 16), s as (select e.vec_id, c.centroid, list_dot_product(cast(e.embedding as double[]), c.c) as s from embeddings e cross join c)"


@query("maxsim_assign", f"with {MAXSIM} select vec_id, cast(arg_max(centroid, s) as integer) as nearest, cast(arg_min(centroid, s) as integer) as farthest from s group by 1")
def maxsim_assign(spark, d):
    from ..operators import clustering

    e = tables.read_table(spark, d, "embeddings")
    c = clustering.collect_centroids(e.where("vec_id < 16").select(F.col("vec_id").alias("cluster"), F.col("embedding").alias("centroid")))
    near = clustering.assign(e, c, "embedding").withColumnRenamed("cluster", "nearest")
    return clustering.assign(near, c, "embedding", maximize=False).select("vec_id", "nearest", F.col("cluster").alias("farthest"))


@query("pair_similarity", f"with {VEC_PAIRS} select round(avg(list_dot_product(q, x)), 6) as similarity, count(*) as n from vp where i < 100")
def pair_similarity(spark, d):
    return vec_pairs(spark, d).where("i < 100").agg(F.round(F.avg(V.dot(F.col("q"), F.col("x"))), 6).alias("similarity"), F.count("*").alias("n"))


HASHED = f"t as (select item_id, {tokens_sql('text', 1 << 30, 512)} as ids from benchmark), h as (select item_id, list_transform(range(32), lambda j: coalesce(list_sum(list_transform(ids, lambda i: case when i % 32 = j then case when (i // 32) % 2 = 0 then 1.0 else -1.0 end else 0.0 end)), 0.0)) as v from t)"


@query("encode_hashing", f"with {HASHED} select item_id, list_transform(v, lambda x: round(cast(x as double) / greatest(sqrt(list_dot_product(cast(v as double[]), cast(v as double[]))), 1e-12), 5) + 0.0) as embedding from h")
def encode_hashing(spark, d):
    b = tables.read_table(spark, d, "benchmark")
    return b.select("item_id", rounded(encoder.hashing_embedding(F.col("text"), 32), 5).alias("embedding"))


@query("encode_udf")
def encode_udf(spark, d):
    """The encoder seam over Arrow batches: word-hash counts as the plugged-in encoder."""
    import numpy as np

    def encode(texts):
        import zlib

        out = np.zeros((len(texts), 32), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                out[i, zlib.crc32(w.encode()) % 32] += 1
        return out

    e = encoder.Encoder(encode, {"query": "search_query: ", "document": "search_document: "})
    return e.apply(tables.read_table(spark, d, "benchmark").select("item_id", "text"), "text").select("item_id", "embedding")


#: The Gramian and its 2^12-th power, which keeps the leading direction only.
GRAMIAN = "xs as (select cast(embedding as double[]) as v from embeddings), un as (select row_number() over () as r, v from xs), cells as (select r, unnest(v) as x, generate_subscripts(v, 1) as j from un), g as (select a.j as i, b.j as j, sum(a.x * b.x) as x from cells a join cells b on a.r = b.r group by 1, 2), g0 as (select list(row order by i) as m from (select i, list(x order by j) as row from g group by 1))"
SQUARED = "".join(f", g{n + 1} as (select list_transform(p, lambda r: list_transform(r, lambda x: x / t)) as m from (select p, list_sum(list_transform(range(64), lambda i: p[i + 1][i + 1])) as t from (select list_transform(m, lambda r: list_transform(m, lambda c: list_dot_product(r, c))) as p from g{n})))" for n in range(12))


@query(
    "svd_downscale",
    f"with {GRAMIAN}{SQUARED}, top as (select list_sum(list_transform(range(64), lambda i: list_dot_product(g0.m[i + 1], g12.m[i + 1]))) as top, list_sum(list_transform(range(64), lambda i: g0.m[i + 1][i + 1])) as total from g0, g12) "
    "select (select count(*) from embeddings) as n, 64 as size_before, 16 as size_after, true as unit_length, round(top, 3) as top, round(total, 3) as total from top",
)
def svd_downscale(spark, d):
    """The reduced vectors, and the largest squared singular value and their sum, which the leading direction and all of them reach."""
    e = tables.read_table(spark, d, "embeddings")
    basis, out = encoder.gramian_svd(e, "embedding", 16)
    unit = F.bool_and(F.abs(V.norm(F.col("reduced")) - 1) < 1e-9)
    first = F.array(*[F.lit(float(x)) for x in basis[:, 0]])
    out = out.withColumn("_p", V.dot(F.col("embedding"), first))
    return out.agg(
        F.count("*").alias("n"), F.max(F.size("embedding")).alias("size_before"), F.max(F.size("reduced")).alias("size_after"), unit.alias("unit_length"), F.round(F.sum(F.col("_p") ** 2), 3).alias("top"), F.round(F.sum(V.dot(F.col("embedding"), F.col("embedding"))), 3).alias("total")
    )
