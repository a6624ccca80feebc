"""Queries over retrieval, reranking, context selection, metrics and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics as M
from ..operators import retrieval as R
from ..sources import tables
from .base import query, shorten, uniform_sql, values

#: Queries are the vectors whose id is divisible by 10, the corpus is all vectors, a document of the query's label is
#: relevant: 2 if the parity of q div 10 and d agree, else 1.
BASE = (
    "e as (select vec_id, label, cast(embedding as double[]) as v from embeddings), sc as (select q.vec_id as qid, d.vec_id as did, q.label as ql, d.label as dl, list_dot_product(q.v, d.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(d.v, d.v)) as score from e q join e d on q.vec_id % 10 = 0 and q.vec_id <> d.vec_id), "
    "run as (select qid, did, score, rank from (select qid, did, score, row_number() over (partition by qid order by score desc, did) as rank from sc) where rank <= 100), "
    "qrels as (select qid, did, case when (qid // 10) % 2 = did % 2 then 2 else 1 end as rel from sc where ql = dl)"
)


def queries(spark, d):
    return tables.read_table(spark, d, "embeddings").where("vec_id % 10 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v"))


def corpus(spark, d):
    return tables.read_table(spark, d, "embeddings").select(F.col("vec_id").alias("did"), F.col("embedding").alias("v"))


def run(spark, d, k=100):
    return R.cosine_topk(queries(spark, d), corpus(spark, d), k)


def qrels(spark, d):
    e = tables.read_table(spark, d, "embeddings")
    q = e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("qid"), "label")
    rel = F.when(F.floor(F.col("qid") / 10) % 2 == F.col("did") % 2, 2).otherwise(1)
    return q.join(e.select(F.col("vec_id").alias("did"), "label"), "label").where("qid <> did").select("qid", "did", rel.alias("rel"))


@query("cosine_topk", f"with {BASE} select qid, did, round(score, 6) + 0.0 as score, cast(rank as integer) as rank from run where rank <= 10")
def cosine_topk(spark, d):
    return run(spark, d, 10).withColumn("score", shorten(F.col("score")))


@query("similarity_top5", f"with {BASE} select qid, list(did order by rank) as best, round(max(score), 6) as top from run where rank <= 5 group by 1")
def similarity_top5(spark, d):
    rows = run(spark, d, 5).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "did"))).alias("l"), F.round(F.max("score"), 6).alias("top"))
    return rows.select("qid", F.transform("l", lambda s: s["did"]).alias("best"), "top")


#: The second model of the rerank queries sees the first half of each vector.
RERANK = f"{BASE}, h as (select vec_id, v[1:32] as v from e), rs as (select run.qid, run.did, list_dot_product(q.v, d.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(d.v, d.v)) as score from run join h q on q.vec_id = run.qid join h d on d.vec_id = run.did where run.rank <= 20), rr as (select qid, did, score, row_number() over (partition by qid order by score desc, did) as rank from rs)"


def half(df):
    return df.withColumn("v", F.slice("v", 1, 32))


def reranked(spark, d):
    return R.rerank(run(spark, d, 20), half(queries(spark, d)), half(corpus(spark, d)), 20)


@query("rerank_topk", f"with {RERANK} select qid, did, round(score, 6) + 0.0 as score, cast(rank as integer) as rank from rr")
def rerank_topk(spark, d):
    return reranked(spark, d).select("qid", "did", shorten(F.col("score")).alias("score"), "rank")


@query("rerank_agreement", f"with {RERANK} select count(*) as n_queries, avg(cast(a.did = b.did as double)) as agreement from run a join rr b on a.qid = b.qid and a.rank = 1 and b.rank = 1")
def rerank_agreement(spark, d):
    return R.agreement(run(spark, d, 20), reranked(spark, d))


@query("context_topk", f"with {BASE}, l as (select qid, list(did order by rank) as l from run where rank <= 3 group by 1) select qid, cast(unnest(range(8)) as integer) as ctx_pos, unnest(list_transform(range(8), lambda p: l[p % len(l) + 1])) as did from l")
def context_topk(spark, d):
    return R.context_topk(run(spark, d, 3).where("rank <= 3"), 8)


RANDOM = "rnd as (select qid, did from (select q.vec_id as qid, c.vec_id as did, row_number() over (partition by q.vec_id order by c.vec_id) as k from e q join e c on q.vec_id % 10 = 0 and c.label = q.label and c.vec_id <> q.vec_id) where k <= 8)"


def label_mates(spark, d):
    from pyspark.sql import Window

    rows = qrels(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy("did")))
    return rows.where("k <= 8").select("qid", "did")


@query("context_interp", f"with {BASE}, {RANDOM}, u as (select qid, did from run where rank <= 8 union select qid, did from rnd), p as (select qid, did, row_number() over (partition by qid order by md5(concat_ws('|', 'mix', cast(qid as varchar), cast(did as varchar))), did) - 1 as p from u) select qid, cast(p as integer) as ctx_pos, did from p where p < 8")
def context_interp(spark, d):
    return R.context_interpolated(run(spark, d, 8), label_mates(spark, d), 8, "mix")


@query("context_random", f"with q as (select vec_id as qid from embeddings where vec_id % 10 = 0), n as (select count(*) as n from embeddings), c as (select vec_id as did, row_number() over (order by vec_id) - 1 as rn from embeddings), p as (select qid, cast(ctx_pos as integer) as ctx_pos from q cross join (select unnest(range(8)) as ctx_pos)), w as (select qid, ctx_pos, cast(floor({uniform_sql(chr(39) + 'rand' + chr(39), 'cast(qid as varchar)', 'cast(ctx_pos as varchar)')} * n) as bigint) as rn from p, n) select qid, ctx_pos, did from w join c using (rn)")
def context_random(spark, d):
    return R.context_random(queries(spark, d).select("qid"), corpus(spark, d), 8, "rand")


@query("context_fake", "select vec_id as qid, cast(unnest(range(8)) as integer) as ctx_pos, cast(1 as integer) as token, cast(1 as integer) as mask from embeddings where vec_id % 10 = 0")
def context_fake(spark, d):
    return R.context_fake(queries(spark, d).select("qid"), 8)


@query("context_assemble", f"with {BASE}, c as (select qid, cast(rank - 1 as integer) as ctx_pos, e.v[1:4] as v from run join e on e.vec_id = run.did where rank <= 6) select qid, ctx_pos, list_transform(case when {uniform_sql(chr(39) + 'drop' + chr(39), 'cast(qid as varchar)', 'cast(ctx_pos as varchar)')} < 0.25 then [0.5, 0.5, 0.5, 0.5] else v end, lambda x: round(x, 6) + 0.0) as v from c")
def context_assemble(spark, d):
    """The first 6 of 10 context vectors, a quarter of them replaced by the null vector."""
    rows = run(spark, d, 10).join(corpus(spark, d), "did").select("qid", (F.col("rank") - 1).alias("ctx_pos"), F.slice("v", 1, 4).alias("v"))
    out = R.assemble_context(rows, ["qid"], 6, null=[0.5] * 4, dropout=0.25)
    return out.select("qid", "ctx_pos", F.transform("v", lambda x: shorten(x)).alias("v"))


def mean_sql(rows: str, keys: str) -> str:
    return f"select {keys}, list(x order by j) as v from (select {keys}, j, avg(x) as x from (select {keys}, unnest(v) as x, generate_subscripts(v, 1) as j from ({rows})) group by {keys}, j) group by {keys}"


@query("context_pool", f"with {BASE}, p as (select qid, cast((rank - 1) % 4 as integer) as ctx_pos, e.v from run join e on e.vec_id = run.did where rank <= 16), m as ({mean_sql('select * from p', 'qid, ctx_pos')}) select qid, ctx_pos, list_transform(v, lambda x: round(x, 6) + 0.0) as v from m")
def context_pool(spark, d):
    out = R.context_pooled(run(spark, d, 16), corpus(spark, d), 4)
    return out.select("qid", "ctx_pos", F.transform("v", lambda x: shorten(x)).alias("v"))


@query("ensemble_query", f"with {BASE}, p as (select qid, (rank - 1) // 4 as slice, e.v from run join e on e.vec_id = run.did where rank <= 12), m as ({mean_sql('select * from p', 'qid, slice')}), w as ({mean_sql('select qid, v from m', 'qid')}) select qid, list_transform(v, lambda x: round(x, 6) + 0.0) as v from w")
def ensemble_query(spark, d):
    out = R.ensemble_queries(run(spark, d, 12), corpus(spark, d), 4, 3)
    return out.select("qid", F.transform("v", lambda x: shorten(x)).alias("v"))


@query("process_qrels", "with q as (select doc_id as did, doc_id % 7 as qid, 1 as rel from documents where doc_id % 3 = 0 union all select doc_id + 1000000, doc_id % 7, 1 from documents where doc_id % 50 = 0) select cast(qid as varchar) as qid, count(*) as judged, count(*) filter (d.doc_id is null) as missing from q left join documents d on d.doc_id = q.did group by 1")
def process_qrels(spark, d):
    t = tables.read_table(spark, d, "documents")
    q = t.where("doc_id % 3 = 0").select(F.col("doc_id").alias("did")).select("did", (F.col("did") % 7).alias("qid"))
    q = q.unionByName(t.where("doc_id % 50 = 0").select((F.col("doc_id") + 1000000).alias("did"), (F.col("doc_id") % 7).alias("qid"))).withColumn("rel", F.lit(1))
    out = R.process_qrels(q, t.select(F.col("doc_id").alias("did"), F.col("doc_id").alias("idx")))
    return out.groupBy(F.col("qid").cast("string").alias("qid")).agg(F.count("*").alias("judged"), F.count_if(F.col("idx").isNull()).alias("missing"))


KS = (1, 5, 10, 100)
METRIC = f"{BASE}, k as (select unnest([1, 5, 10, 100]) as k), ideal as (select qid, rel, row_number() over (partition by qid order by rel desc, did) as r from qrels), hits as (select run.qid, rank, rel, row_number() over (partition by run.qid order by rank) as hit from run join qrels using (qid, did))"


def metric_sql(name: str) -> str:
    per = {
        "ndcg": "coalesce((select sum(rel / log2(rank + 1)) from hits h where h.qid = q.qid and h.rank <= k), 0) / (select sum(rel / log2(r + 1)) from ideal i where i.qid = q.qid and r <= k)",
        "map": "coalesce((select sum(cast(hit as double) / rank) from hits h where h.qid = q.qid and h.rank <= k), 0) / (select count(*) from ideal i where i.qid = q.qid)",
        "recall": "cast((select count(*) from hits h where h.qid = q.qid and h.rank <= k) as double) / (select count(*) from ideal i where i.qid = q.qid)",
        "precision": "cast((select count(*) from hits h where h.qid = q.qid and h.rank <= k) as double) / k",
    }[name]
    return f"with {METRIC}, per as (select q.qid, k, {per} as value from (select distinct qid from qrels) q cross join k) select '{name}' as metric, k, round(avg(value), 6) as value from per group by 2"


def metric(name):
    @query(f"{name}_at_k", metric_sql(name))
    def one(spark, d):
        return M.ranking_metrics(run(spark, d), qrels(spark, d), KS).where(F.col("metric") == name).select("metric", "k", F.round("value", 6).alias("value"))

    return one


for _name in ("ndcg", "map", "recall", "precision"):
    metric(_name)


@query("score_weighted_qrels", f"with {BASE} select round(avg(coalesce(score, 0) * rel), 6) as mean, round(sum(coalesce(score, 0) * rel), 4) as sum, count(*) as total from qrels left join run using (qid, did)")
def score_weighted_qrels(spark, d):
    return M.score_weighted(run(spark, d), qrels(spark, d)).select(F.round("mean", 6).alias("mean"), F.round("sum", 4).alias("sum"), "total")


@query(
    "ndcg_rollup",
    f"with {METRIC}, per as (select ql as dataset, q.qid, coalesce((select sum(rel / log2(rank + 1)) from hits h where h.qid = q.qid and h.rank <= 10), 0) / (select sum(rel / log2(r + 1)) from ideal i where i.qid = q.qid and r <= 10) as v from (select distinct qid, ql from sc where ql = dl) q), s as (select dataset, avg(v) as v from per group by 1) select round(sum(v), 6) as ndcg_sum, round(avg(v), 6) as ndcg_mean, count(*) as datasets from s",
)
def ndcg_rollup(spark, d):
    """NDCG@10 by dataset (the label of the query) in one pass, then sum and mean over datasets."""
    from pyspark.sql import Window

    good = qrels(spark, d)
    ideal = good.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel"), "did"))).where("r <= 10").groupBy("qid").agg(F.sum(F.col("rel") / F.log2(F.col("r") + 1)).alias("ideal"))
    dcg = run(spark, d, 10).join(good, ["qid", "did"]).groupBy("qid").agg(F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"))
    dataset = tables.read_table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.col("label").alias("dataset"))
    per = ideal.join(dcg, "qid", "left").join(dataset, "qid").groupBy("dataset").agg(F.avg(F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("v"))
    return per.agg(F.round(F.sum("v"), 6).alias("ndcg_sum"), F.round(F.avg("v"), 6).alias("ndcg_mean"), F.count("*").alias("datasets"))


# reports

RESULTS = [("task_a", "ndcg_at_10", 0.61234), ("task_a", "ndcg_at_10_std", 0.01), ("task_a", "main_score", 0.6), ("task_b", "accuracy", 0.8), ("task_b", "evaluation_time", 12.0), ("task_c", "v_measure", 0.455), ("task_d", "cos_sim_ap", 0.9123), ("task_d", "best_threshold", 0.7)]
TASKS = [("task_a", "retrieval"), ("task_b", "classification"), ("task_c", "clustering"), ("task_d", "pairs"), ("task_e", "pairs"), ("task_f", "classification")]
RESULTS_SQL = "res as (select * from (values " + ", ".join(f"('{t}', '{m}', cast({v} as double))" for t, m, v in RESULTS) + ") t(task, metric, value)), flat as (select task, metric, value * 100 as value from res where not (metric like '%std%' or metric like '%evaluation_time%' or metric like '%main_score%' or metric like '%threshold%'))"
TASKS_SQL = "tasks as (select * from (values " + ", ".join(f"('{t}', '{c}')" for t, c in TASKS) + ") t(task, category))"


def results(spark):
    return M.flatten_results(values(spark, RESULTS, "task string, metric string, value double"))


@query("flatten_results", f"with {RESULTS_SQL} select task, metric, round(value, 6) as value from flat")
def flatten_results(spark, d):
    return results(spark).select("task", "metric", F.round("value", 6).alias("value"))


@query("leaderboard", f"with {RESULTS_SQL}, {TASKS_SQL}, j as (select category, round(value, 2) as value from tasks left join flat using (task)) select category, case when count(value) = count(*) then avg(value) end as average from j group by 1 union all select 'overall', case when count(value) = count(*) then avg(value) end from j")
def leaderboard(spark, d):
    return M.leaderboard(results(spark).select("task", "value"), values(spark, TASKS, "task string, category string"))


@query("leaderboard_wide", f"with {RESULTS_SQL}, {TASKS_SQL}, j as (select category, round(value, 2) as value from tasks left join flat using (task)), a as (select category, case when count(value) = count(*) then avg(value) end as v from j group by 1 union all select 'overall', case when count(value) = count(*) then avg(value) end from j) select " + ", ".join(f"max(case when category = '{c}' then v end) as {c}" for c in ("overall", "retrieval", "classification", "clustering", "pairs")) + " from a")
def leaderboard_wide(spark, d):
    return M.leaderboard_wide(results(spark).select("task", "value"), values(spark, TASKS, "task string, category string"), ["retrieval", "classification", "clustering", "pairs"])


RESULT_FILES = {
    "alpha": '{"test": {"accuracy": 0.5, "main_score": 0.5, "cos": {"spearman": 0.25, "pearson": 0.75, "spearman_std": 0.1}}, "dataset_revision": "r1"}',
    "beta": '{"dev": {"map": 0.5}, "test": {"map": 0.125}, "dataset_revision": null}',
    "gamma": '{"test": {"de": {"f1": 0.25}, "en": {"f1": 0.75}, "evaluation_time": 9.0}}',
    "delta": '{"validation": {"f1": 0.5}}',
}
MAIN_METRICS = {"retrieval": "map", "sts": "cos_spearman", "mining": "f1"}


def result_files(spark):
    """The files above, written and read back as a folder of results."""
    from ..work import new_path

    folder = new_path(spark, "results")
    values(spark, list(RESULT_FILES.items()), "task string, content string").write.partitionBy("task").text(folder)
    raw = spark.read.text(folder, wholetext=True)
    flat = M.parse_results(raw.select("task", F.col("value").alias("content")), {"beta": "dev", "delta": "dev"}, {"gamma": ["de", "en", "fr"]})
    return flat


@query("results_nested", "select task, split, lang, metric, cast(value as double) as value from (values ('alpha', 'test', 'default', 'accuracy', 50.0), ('alpha', 'test', 'default', 'cos_spearman', 25.0), ('alpha', 'test', 'default', 'cos_pearson', 75.0), ('beta', 'dev', 'default', 'map', 50.0), ('gamma', 'test', 'de', 'f1', 25.0), ('gamma', 'test', 'en', 'f1', 75.0)) t(task, split, lang, metric, value)")
def results_nested(spark, d):
    """Splits, languages and sub-metrics of result files, without bookkeeping metrics, as percentages."""
    flat = result_files(spark)
    skip = F.lit(False)
    for s in M.SKIPPED:
        skip = skip | F.col("metric").contains(s)
    return flat.where(~skip).select("task", "split", "lang", "metric", (F.col("value") * 100).alias("value"))


@query("main_scores_named", "select task, cast(value as double) as value from (values ('alpha', 25.0), ('beta', 50.0)) t(task, value)")
def main_scores_named(spark, d):
    """The one metric that its category names, of each task."""
    tasks = values(spark, [("alpha", "sts"), ("beta", "retrieval"), ("delta", "mining")], "task string, category string")
    return M.main_scores(results_nested(spark, d), tasks, MAIN_METRICS)


@query("running_averages", 'select event_type as key, event_id // 100 as "window", round(avg(value), 6) as value from events group by 1, 2')
def running_averages(spark, d):
    log = tables.read_table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("step"), "value")
    return M.running_averages(log, 100).withColumn("value", F.round("value", 6))


@query("task_category_prefixes", f"with {TASKS_SQL} select task, category, case when category in ('clustering', 'pairs') then true else false end as is_symmetric, category || ': ' as q_prefix from tasks")
def task_category_prefixes(spark, d):
    t = values(spark, TASKS, "task string, category string")
    return t.select("task", "category", F.col("category").isin("clustering", "pairs").alias("is_symmetric"), T.prefixed_short(F.col("category"), F.lit("")).alias("q_prefix"))


@query("query_subsample", f"with {BASE} select qid, did, cast(rank as integer) as rank from run where rank <= 5 and qid in (select distinct qid from run order by qid limit 8)")
def query_subsample(spark, d):
    return R.cosine_topk(R.first_queries(queries(spark, d), 8), corpus(spark, d), 5).select("qid", "did", "rank")


@query("large_enough", "with q as (select vec_id as qid, label from embeddings where vec_id % 10 = 0) select qid, label from q where label in (select label from q group by 1 having count(*) >= 5)")
def large_enough(spark, d):
    q = tables.read_table(spark, d, "embeddings").where("vec_id % 10 = 0").select(F.col("vec_id").alias("qid"), "label")
    return R.large_enough(q, "label", 5).select("qid", "label")


@query("main_scores", f"with {RESULTS_SQL}, {TASKS_SQL} select task, category, category = 'clustering' as normalized, max(value) as score from flat join tasks using (task) group by 1, 2, 3")
def main_scores(spark, d):
    """One score a task, and whether its evaluation normalises embeddings (clustering tasks do)."""
    t = values(spark, TASKS, "task string, category string")
    return results(spark).join(t, "task").groupBy("task", "category").agg(F.max("value").alias("score")).select("task", "category", F.expr("category = 'clustering'").alias("normalized"), "score")
