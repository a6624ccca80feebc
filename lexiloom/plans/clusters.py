"""Queries over clustering, packing and their diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import clustering as C
from ..sources import tables
from .base import TEXT_PAIRS, VEC_PAIRS, query, shorten, text_pairs, vec_pairs

#: The label of a vector is its cluster in the queries that need a given assignment.
CENTROIDS = "parts as (select label as cluster, unnest(embedding) as x, generate_subscripts(embedding, 1) as j from embeddings), means as (select cluster, j, avg(cast(x as double)) as x from parts group by 1, 2), cents as (select cluster, list(x order by j) as c from means group by 1)"


def labelled(spark, d):
    return tables.read_table(spark, d, "embeddings").select("vec_id", F.col("label").alias("cluster"), "embedding")


@query(
    "bm25_scores",
    r"with tok as (select doc_id as idx, unnest(regexp_extract_all(lower(text), '([\p{L}\p{N}]+)', 1)) as token from documents), tf as (select idx, token, count(*) as tf from tok group by 1, 2), "
    r"len as (select doc_id as idx, len(regexp_extract_all(lower(text), '([\p{L}\p{N}]+)', 1)) as l from documents), st as (select count(*) as n, avg(l) as mean from len), df as (select token, count(*) as df from tf group by 1) "
    r"select idx, token, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / mean)), 5) as weight from tf join len using (idx) join df using (token) cross join st",
)
def bm25_scores(spark, d):
    return C.bm25(tables.read_table(spark, d, "documents").select(F.col("doc_id").alias("idx"), "text"), "idx", "text").select("idx", "token", F.round("weight", 5).alias("weight"))


def kmeans_sql(k: int, iterations: int) -> str:
    """Paired spherical k-means, unrolled."""
    unit = lambda v: f"list_transform({v}, lambda x: x / sqrt(list_dot_product({v}, {v})))"
    ctes = [VEC_PAIRS, "cat as (select i, 0 as side, list_concat(q, x) as v from vp union all select i, 1, list_concat(x, q) from vp)", f"r as (select i, side, {unit('v')} as v from cat)"]
    ctes.append(f"c0 as (select cast(rn - 1 as integer) as cluster, v as c from (select v, row_number() over (order by md5(concat_ws('|', 'init', cast(i as varchar))), i) as rn from r where side = 0) where rn <= {k})")
    for n in range(iterations):
        ctes += [
            f"a{n} as (select i, side, arg_min(cluster, (-round(list_dot_product(v, c), 12), cluster)) as cluster, any_value(v) as v from r cross join c{n} group by 1, 2)",
            f"p{n} as (select cluster, unnest(v) as x, generate_subscripts(v, 1) as j from a{n})",
            f"m{n} as (select cluster, list(x order by j) as v from (select cluster, j, avg(x) as x from p{n} group by 1, 2) group by 1)",
            f"c{n + 1} as (select cluster, coalesce({unit('m.v')}, o.c) as c from c{n} o left join m{n} m using (cluster))",
        ]
    ctes.append(f"fin as (select i, arg_min(cluster, (-round(list_dot_product(v, c), 12), cluster)) as cluster from r cross join c{iterations} where side = 0 group by 1)")
    return "with " + ", ".join(ctes)


@query("paired_kmeans_assign", kmeans_sql(8, 3) + " select i, cluster from fin")
def paired_kmeans_assign(spark, d):
    return C.paired_kmeans(vec_pairs(spark, d).select("i", "q", "x"), 8, 3)


@query("cluster_dataset", kmeans_sql(16, 2) + " select cluster, count(*) as n from fin group by 1")
def cluster_dataset(spark, d):
    """k from the cluster size (16 clusters at the test scale), then sizes."""
    return C.paired_kmeans(vec_pairs(spark, d).select("i", "q", "x"), 16, 2).groupBy("cluster").agg(F.count("*").alias("n"))


def grouped_kmeans_sql(group: str, k: str, iterations: int) -> str:
    """`kmeans_sql` in every group by itself; `group` and `k`, the clusters of a group of n rows, are expressions."""
    unit = lambda v: f"list_transform({v}, lambda x: x / sqrt(list_dot_product({v}, {v})))"
    ctes = [VEC_PAIRS, f"gp as (select *, {group} as g from vp, (select count(*) as total from vp))", f"ks as (select g, {k} as k from (select g, count(*) as n, any_value(total) as total from gp group by 1))"]
    ctes += ["cat as (select i, g, 0 as side, list_concat(q, x) as v from gp union all select i, g, 1, list_concat(x, q) from gp)", f"r as (select i, g, side, {unit('v')} as v from cat)"]
    ctes.append("c0 as (select g, cast(rn - 1 as integer) as cluster, v as c from (select g, v, row_number() over (partition by g order by md5(concat_ws('|', 'init', cast(i as varchar))), i) as rn from r where side = 0) join ks using (g) where rn <= k)")
    for n in range(iterations):
        ctes += [
            f"a{n} as (select i, g, side, arg_min(cluster, (-round(list_dot_product(v, c), 12), cluster)) as cluster, any_value(v) as v from r join c{n} using (g) group by 1, 2, 3)",
            f"p{n} as (select g, cluster, unnest(v) as x, generate_subscripts(v, 1) as j from a{n})",
            f"m{n} as (select g, cluster, list(x order by j) as v from (select g, cluster, j, avg(x) as x from p{n} group by 1, 2, 3) group by 1, 2)",
            f"c{n + 1} as (select g, cluster, coalesce({unit('m.v')}, o.c) as c from c{n} o left join m{n} m using (g, cluster))",
        ]
    ctes.append(f"fin as (select i, g, arg_min(cluster, (-round(list_dot_product(v, c), 12), cluster)) as cluster from r join c{iterations} using (g) where side = 0 group by 1, 2)")
    return "with " + ", ".join(ctes)


@query("cluster_within_domain", grouped_kmeans_sql("domain", "greatest(1, cast(ceil(n / 10.0) as integer))", 2) + " select i, g as domain, cluster from fin")
def cluster_within_domain(spark, d):
    """Clusters of about 10 pairs in each domain, by its own size: (i, domain, cluster)."""
    return C.within_domains(vec_pairs(spark, d), "domain", 10, 2)


SHARDS = "cast(ceil(total / 100.0) as bigint)"
SHARD_K = f"greatest(1, cast(ceil(ceil(cast(total as double) / {SHARDS}) / 16.0) as integer))"


@query(
    "cluster_sharded",
    grouped_kmeans_sql(f"cast(cast(('0x' || substr(md5(cast(i as varchar)), 1, 8)) as bigint) % {SHARDS} as integer)", SHARD_K, 2) + ", size as (select any_value(k) as k from ks) select i, g as shard, cast(g * size.k + cluster as integer) as cluster from fin, size",
)
def cluster_sharded(spark, d):
    return C.sharded(vec_pairs(spark, d).select("i", "q", "x"), 16, 100, 2)


@query(
    "kmeans_farthest_init",
    "with recursive e as (select vec_id, cast(embedding as double[]) as v from embeddings), s as (select 0 as step, cast(0 as bigint) as vec_id, [cast(0 as bigint)] as chosen union all "
    "select step + 1, nxt, list_append(chosen, nxt) from (select s.step, s.chosen, (select arg_min(b.vec_id, (b.best, b.vec_id)) from (select e.vec_id, max(round(list_dot_product(e.v, c.v), 10)) as best from e, e c where list_contains(s.chosen, c.vec_id) and not list_contains(s.chosen, e.vec_id) group by 1) b) as nxt from s where s.step < 7)) "
    "select step, vec_id from s",
)
def kmeans_farthest_init(spark, d):
    e = tables.read_table(spark, d, "embeddings").select("vec_id", "embedding")
    order = C.farthest_first(e, "vec_id", "embedding", 8, 0)
    return spark.createDataFrame(list(enumerate(order)), "step int, vec_id long")


@query(
    "kmeans_lloyd_step",
    r"with w as (select item_id as idx, unnest(regexp_extract_all(lower(text), '([\p{L}\p{N}]+)', 1)) as token from benchmark), v as (select idx, token, cast(count(*) as double) as w from w group by 1, 2), c as (select cast(idx as integer) as cluster, token, w from v where idx < 4), "
    r"s as (select v.idx, c.cluster, sum(v.w * c.w) as s from v join c using (token) group by 1, 2), a as (select idx, arg_min(cluster, (-round(s, 10), cluster)) as cluster from s group by 1), ch as (select idx, coalesce(cluster, 0) as cluster from (select distinct idx from v) left join a using (idx)), "
    r"n as (select cluster, count(*) as n from ch group by 1), m as (select cluster, token, sum(w) / any_value(n) as w from v join ch using (idx) join n using (cluster) group by 1, 2), kept as (select * from c where cluster not in (select cluster from n)) select cluster, token, round(w, 6) as w from (select * from m union all select * from kept)",
)
def kmeans_lloyd_step(spark, d):
    from ..functions import text as T

    b = tables.read_table(spark, d, "benchmark")
    v = b.select(F.col("item_id").alias("idx"), F.explode(T.words(F.col("text"))).alias("token")).groupBy("idx", "token").agg(F.count("*").cast("double").alias("w"))
    c = v.where("idx < 4").select(F.col("idx").cast("int").alias("cluster"), "token", "w")
    return C.sparse_lloyd(v, v, c)[1].select("cluster", "token", F.round("w", 6).alias("w"))


@query("cluster_members", "select label as cluster, list_sort(list(vec_id)) as rows from embeddings group by 1")
def cluster_members(spark, d):
    return C.members(labelled(spark, d), "vec_id")


@query("cluster_centroids", f"with {CENTROIDS} select cluster, list_transform(c, lambda x: round(x, 6) + 0.0) as centroid from cents")
def cluster_centroids(spark, d):
    m = V.mean_vectors(labelled(spark, d), ["cluster"], "embedding")
    return m.select("cluster", F.transform("centroid", lambda x: shorten(x)).alias("centroid"))


@query("cluster_sizes", "select label as cluster, count(*) as n from embeddings group by 1")
def cluster_sizes(spark, d):
    return labelled(spark, d).groupBy("cluster").agg(F.count("*").alias("n"))


@query(
    "tsp_order",
    f"with recursive {CENTROIDS}, t as (select 0 as position, 0 as cluster, [0] as seen union all select position + 1, nxt, list_append(seen, nxt) from (select t.position, t.seen, (select arg_min(b.cluster, (round(list_sum(list_transform(range(64), lambda j: (b.c[j + 1] - a.c[j + 1]) * (b.c[j + 1] - a.c[j + 1]))), 12), b.cluster)) from cents a, cents b where a.cluster = t.cluster and not list_contains(t.seen, b.cluster)) as nxt from t where len(t.seen) < (select count(*) from cents))) select position, cluster from t",
)
def tsp_order(spark, d):
    m = V.mean_vectors(labelled(spark, d), ["cluster"], "embedding")
    return spark.createDataFrame(list(enumerate(C.greedy_order(m, 0))), "position int, cluster int")


BY_DOMAIN = "parts as (select label as domain, cast(vec_id // 50 as integer) as cluster, unnest(embedding) as x, generate_subscripts(embedding, 1) as j from embeddings), means as (select domain, cluster, j, avg(cast(x as double)) as x from parts group by 1, 2, 3), cents as (select domain, cluster, list(x order by j) as c from means group by 1, 2)"


@query(
    "tsp_order_by_domain",
    f"with recursive {BY_DOMAIN}, t as (select domain, 0 as position, min(cluster) as cluster, [min(cluster)] as seen from cents group by 1 union all "
    "select domain, position + 1, nxt, list_append(seen, nxt) from (select t.domain, any_value(t.position) as position, any_value(t.seen) as seen, arg_min(b.cluster, (round(list_sum(list_transform(range(64), lambda j: (b.c[j + 1] - a.c[j + 1]) * (b.c[j + 1] - a.c[j + 1]))), 12), b.cluster)) as nxt "
    "from t join cents a on a.domain = t.domain and a.cluster = t.cluster join cents b on b.domain = t.domain and not list_contains(t.seen, b.cluster) group by 1)) select domain, position, cluster from t",
)
def tsp_order_by_domain(spark, d):
    rows = labelled(spark, d).select(F.col("cluster").alias("domain"), F.floor(F.col("vec_id") / 50).cast("int").alias("cluster"), "embedding")
    return C.greedy_order_by_domain(V.mean_vectors(rows, ["domain", "cluster"], "embedding"), "domain")


@query("doc_freq_idf", r"with t as (select unnest(list_distinct(regexp_extract_all(lower(text), '([\p{L}\p{N}]+)', 1))) as token from documents), n as (select count(*) as n from documents) select token, count(*) as df, round(ln(cast(any_value(n) as double) / count(*)), 6) as idf from t cross join n group by 1")
def doc_freq_idf(spark, d):
    return C.document_frequency(tables.read_table(spark, d, "documents"), "doc_id", "text").select("token", "df", F.round("idf", 6).alias("idf"))


@query(
    "hard_batch",
    "with recursive e as (select vec_id as idx, cast(embedding as double[]) as v from embeddings), s as (select 0 as step, cast(null as bigint) as idx, list_transform(range(64), lambda j: cast(0 as double)) as total, cast([] as bigint[]) as seen union all "
    "select step + 1, p.idx, list_transform(range(64), lambda j: total[j + 1] + p.v[j + 1]), list_append(seen, p.idx) from (select s.step, s.total, s.seen, (select arg_min({'idx': e.idx, 'v': e.v}, (round(list_sum(list_transform(range(64), lambda j: (s.total[j + 1] + e.v[j + 1]) * (s.total[j + 1] + e.v[j + 1]))), 10), e.idx)) from e where not list_contains(s.seen, e.idx)) as p from s where s.step < 16)) "
    "select idx from s where step > 0",
)
def hard_batch(spark, d):
    e = tables.read_table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("v"))
    return spark.createDataFrame([(i,) for i in C.hard_batch(e, 16)], "idx long")


@query("pair_lengths", f"with {TEXT_PAIRS} select dataset, round(avg(length(query)), 4) as query_chars, round(avg(length(document)), 4) as document_chars, count(*) as n from tp group by 1")
def pair_lengths(spark, d):
    return text_pairs(spark, d).groupBy("dataset").agg(F.round(F.avg(F.length("query")), 4).alias("query_chars"), F.round(F.avg(F.length("document")), 4).alias("document_chars"), F.count("*").alias("n"))
