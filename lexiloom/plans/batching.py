"""Queries over samplers, negatives, masks and in-batch losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import batches as B
from ..operators import negatives as N
from ..sources import tables
from .base import VEC_PAIRS, query, shorten, tokens_sql, uniform_sql, vec_pairs


def order_sql(*keys: str) -> str:
    return f"md5(concat_ws('|', {', '.join(keys)}))"


@query(
    "sample_random",
    f"with n as (select count(*) as n from documents), r as (select doc_id, row_number() over (order by {order_sql(chr(39) + '42' + chr(39), 'cast(doc_id as varchar)')}, doc_id) - 1 as rn from documents), p as (select n // 4 // 16 * 16 as per from n) "
    "select doc_id, cast(rn // per as integer) as rank, (rn % per) // 16 as batch_id, cast(rn % per % 16 as integer) as pos from r, p where rn < per * 4",
)
def sample_random(spark, d):
    return B.sample_random(tables.read_table(spark, d, "documents"), "doc_id", 42, 0, 16, 4)


def groups_sql(table: str, idx: str, groups: list[str], batch: int, world: int, order: str | None = None) -> str:
    size = batch * world
    keys = ", ".join([order or order_sql("'42'", *[f"cast({g} as varchar)" for g in groups]), *groups, order_sql("'42'", f"cast({idx} as varchar)"), idx])
    return (
        f"with r as (select {idx}, row_number() over (order by {keys}) - 1 as rn from {table}), f as (select count(*) // {size} as full_ from {table}), b as (select {idx}, rn // {size} as b from r, f where rn // {size} < full_), "
        f"o as (select b, row_number() over (order by {order_sql(chr(39) + '42' + chr(39), 'cast(b as varchar)')}, b) - 1 as batch_id from (select distinct b from b)), "
        f"p as (select {idx}, b, row_number() over (partition by b order by {order_sql(chr(39) + '42' + chr(39), chr(39) + 'in' + chr(39), f'cast({idx} as varchar)')}, {idx}) - 1 as pos from b) "
        f"select {idx}, batch_id, cast(pos % {batch} as integer) as pos, cast(pos // {batch} as integer) as rank from p join o using (b)"
    )


@query("sample_domain", groups_sql("documents", "doc_id", ["source"], 16, 2))
def sample_domain(spark, d):
    return B.sample_groups(tables.read_table(spark, d, "documents"), "doc_id", ["source"], 42, 0, 16, 2)


@query("sample_cluster", groups_sql("embeddings", "vec_id", ["label"], 16, 1))
def sample_cluster(spark, d):
    return B.sample_groups(tables.read_table(spark, d, "embeddings"), "vec_id", ["label"], 42, 0, 16)


WITHIN = "(select vec_id, label as domain, vec_id // 100 as cluster from embeddings)"


@query("sample_cluster_within_domain", groups_sql(WITHIN, "vec_id", ["domain", "cluster"], 16, 1, order="md5(cast(domain as varchar))"))
def sample_cluster_within_domain(spark, d):
    e = tables.read_table(spark, d, "embeddings").select("vec_id", F.col("label").alias("domain"), F.floor(F.col("vec_id") / 100).alias("cluster"))
    return B.sample_groups(e, "vec_id", ["domain", "cluster"], 42, 0, 16, order=F.md5(F.col("domain").cast("string")))


@query(
    "context_sample",
    f"with b as ({groups_sql('embeddings', 'vec_id', ['label'], 16, 1)}), s as (select unnest(['query', 'document']) as side), r as (select batch_id, side, vec_id, row_number() over (partition by batch_id, side order by md5(concat_ws('|', 'ctx', side, cast(vec_id as varchar))), vec_id) - 1 as p from b cross join s) select batch_id, side, cast(p as integer) as ctx_pos, vec_id as idx from r where p < 6",
)
def context_sample(spark, d):
    return B.context_sample(sample_cluster(spark, d).withColumnRenamed("vec_id", "idx"), 6, "ctx")


@query(
    "minicorpus",
    f"with r as (select doc_id, row_number() over (order by doc_id) - 1 as rn from documents), n as (select count(*) as n from documents), w as (select unnest(range(512)) as draw), p as (select draw, cast(floor({uniform_sql(chr(39) + 'mini' + chr(39), 'cast(draw as varchar)')} * n) as bigint) as rn from w, n) select draw, doc_id from p join r using (rn)",
)
def minicorpus(spark, d):
    return B.minicorpus(tables.read_table(spark, d, "documents"), "doc_id", 512, "mini")


@query("view_batch", f"with b as ({groups_sql('documents', 'doc_id', ['source'], 16, 2)}) select pos, rank, doc_id, case when length(text) > 200 then substr(text, 1, 200) || '...' else text end as preview from b join documents using (doc_id) where batch_id = 3")
def view_batch(spark, d):
    rows = sample_domain(spark, d).where("batch_id = 3")
    return rows.join(tables.read_table(spark, d, "documents"), "doc_id").select("pos", "rank", "doc_id", T.preview(F.col("text")).alias("preview"))


TOKEN_BATCH = f"tk as (select doc_id, doc_id // 16 as batch_id, {tokens_sql('text', 1000, 32)} as ids from documents)"


@query(
    "batch_token_stats",
    f"with {TOKEN_BATCH}, f as (select batch_id, ids[1] as t, count(*) as n from tk where len(ids) > 0 group by 1, 2), m as (select batch_id, arg_min(t, (-n, t)) as first_token, cast(max(n) as double) / sum(n) as share from f group by 1), "
    "u as (select batch_id, count(distinct t) as unique_ids from (select batch_id, unnest(ids) as t from tk) group by 1), l as (select batch_id, avg(len(ids)) as mean_length from tk group by 1) select batch_id, unique_ids, first_token, round(share, 6) as share, round(mean_length, 6) as mean_length from l left join m using (batch_id) left join u using (batch_id)",
)
def batch_token_stats(spark, d):
    t = tables.read_table(spark, d, "documents").select(F.floor(F.col("doc_id") / 16).alias("batch_id"), T.token_ids(F.col("text"), 1000, 32).alias("ids"))
    first = t.where(F.size("ids") > 0).groupBy("batch_id", F.get("ids", F.lit(0)).alias("t")).agg(F.count("*").alias("n"))
    mode = first.groupBy("batch_id").agg(F.max_by("t", F.struct("n", -F.col("t"))).alias("first_token"), (F.max("n") / F.sum("n")).alias("share"))
    unique = t.select("batch_id", F.explode("ids").alias("t")).groupBy("batch_id").agg(F.count_distinct("t").alias("unique_ids"))
    length = t.groupBy("batch_id").agg(F.avg(F.size("ids")).alias("mean_length"))
    out = length.join(mode, "batch_id", "left").join(unique, "batch_id", "left")
    return out.select("batch_id", "unique_ids", "first_token", F.round("share", 6).alias("share"), F.round("mean_length", 6).alias("mean_length"))


# negatives

NEGATIVES = "neg as (select doc_id, list_transform(range(7), lambda i: 'n' || ((doc_id * 3 + i) % 11)) as negs, list_transform(range(doc_id % 5), lambda i: 'n' || i) as few from documents)"


def negative_lists(spark, d):
    t = tables.read_table(spark, d, "documents")
    some = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.concat(F.lit("n"), ((F.col("doc_id") * 3 + i) % 11).cast("string")))
    few = F.transform(F.slice(F.array(*map(F.lit, range(5))), F.lit(1), (F.col("doc_id") % 5).cast("int")), lambda i: F.concat(F.lit("n"), i.cast("string")))
    return t.select("doc_id", some.alias("negs"), few.alias("few"))


def sample_sql(col: str, k: int) -> str:
    return f"list_transform((list_sort(list_transform(range(len({col})), lambda i: {{'h': md5(concat_ws('|', 'neg', cast(doc_id as varchar), cast(i as varchar))), 'x': {col}[i + 1]}})))[1:{k}], lambda s: s.x)"


@query("sample_negatives", f"with {NEGATIVES} select doc_id, {sample_sql('negs', 3)} as negatives from neg")
def sample_negatives(spark, d):
    return negative_lists(spark, d).select("doc_id", N.sample(F.col("negs"), 3, F.col("doc_id")).alias("negatives"))


@query("sample_negatives_fill", f"with {NEGATIVES} select doc_id, case when len(few) >= 3 then {sample_sql('few', 3)} when len(few) > 0 then list_transform(range(3), lambda i: few[cast(floor({uniform_sql(chr(39) + 'fill' + chr(39), 'cast(doc_id as varchar)', 'cast(i as varchar)')} * len(few)) as bigint) + 1]) else few end as negatives from neg")
def sample_negatives_fill(spark, d):
    return negative_lists(spark, d).select("doc_id", N.sample_fill(F.col("few"), 3, F.col("doc_id")).alias("negatives"))


@query("explode_negatives", f"with {NEGATIVES} select doc_id, cast(generate_subscripts(negs, 1) - 1 as integer) as pos, unnest(negs) as negative from neg")
def explode_negatives(spark, d):
    return negative_lists(spark, d).select("doc_id", F.posexplode("negs").alias("pos", "negative"))


#: Three systems rank the vectors after a query by three rescorings; positives are vectors of its label.
MINED = (
    "mq as (select vec_id as qid, label from embeddings where vec_id % 10 = 0), pos as (select q.qid, min(round(8 - abs(d.vec_id - q.qid) / 100.0, 6)) as least, list(d.vec_id order by d.vec_id) as positives from mq q join embeddings d on d.label = q.label and d.vec_id <> q.qid and d.vec_id < q.qid + 60 and d.vec_id > q.qid - 60 group by 1), "
    "cand as (select q.qid, s.system, (q.qid + j.j * s.system) % 200 as pid, round(((q.qid * 7 + j.j * 13 * s.system) % 100) / 10.0, 6) as ce, j.j from mq q cross join (select unnest([1, 2, 3]) as system) s cross join (select unnest(range(12)) as j) j)"
)


def mined(spark, d):
    e = tables.read_table(spark, d, "embeddings").select("vec_id", "label")
    q = e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("qid"), "label")
    near = q.join(e.withColumnRenamed("vec_id", "pid"), "label").where("pid <> qid and pid < qid + 60 and pid > qid - 60")
    pos = near.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pid", F.round(8 - F.abs(F.col("pid") - F.col("qid")) / 100.0, 6).alias("ce")))).alias("pos"))
    j = F.sequence(F.lit(0), F.lit(11))
    system = lambda s: F.transform(j, lambda x: F.struct(((F.col("qid") + x * s) % 200).alias("pid"), F.round(((F.col("qid") * 7 + x * 13 * s) % 100) / 10.0, 6).alias("ce")))
    return pos.withColumn("neg", F.array(*[F.struct(F.lit(str(s)).alias("system"), system(s).alias("cands")) for s in (1, 2, 3)]))


@query(
    "mine_hard_negatives",
    f"with recursive {MINED}, seq as (select c.qid, c.pid, c.system, row_number() over (partition by c.qid order by c.system, c.j) as k, c.ce <= p.least - 3 as fine from cand c join pos p using (qid)), "
    "f as (select qid, cast(0 as bigint) as k, cast([] as bigint[]) as added, 0 as system, 0 as new_ from pos union all "
    "select f.qid, f.k + 1, case when s.fine and (case when s.system <> f.system then 0 else f.new_ end) < 5 and not list_contains(f.added, s.pid) then list_append(f.added, s.pid) else f.added end, s.system, "
    "(case when s.system <> f.system then 0 else f.new_ end) + (case when s.fine and (case when s.system <> f.system then 0 else f.new_ end) < 5 and not list_contains(f.added, s.pid) then 1 else 0 end) from f join seq s on s.qid = f.qid and s.k = f.k + 1) "
    "select f.qid, p.positives, f.added as negatives from f join pos p using (qid) where f.k = 36 and len(f.added) > 0",
)
def mine_hard_negatives(spark, d):
    return N.mine(mined(spark, d))


@query("hn_index_join", "select d.doc_id as idx, e.label is not null as found, len(e.embedding) as size from documents d left join embeddings e on e.vec_id = d.doc_id")
def hn_index_join(spark, d):
    docs = tables.read_table(spark, d, "documents").select(F.col("doc_id").alias("idx"))
    index = tables.read_table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("v"))
    return N.join_index(docs, index, "embedding").select("idx", F.col("embedding").isNotNull().alias("found"), F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("long").alias("size"))


@query("dup_labels", "select a.source as batch, a.doc_id as a, b.doc_id as b from documents a join documents b on a.source = b.source and md5(a.text) = md5(b.text) and a.doc_id < b.doc_id")
def dup_labels(spark, d):
    return N.duplicate_labels(tables.read_table(spark, d, "documents").withColumnRenamed("source", "batch"), "batch", "doc_id", "text")


# in-batch scores and losses

SCORES = f"{VEC_PAIRS}, sc as (select a.i // 16 as batch_id, a.i as qi, b.i as di, list_dot_product(a.q, b.x) / sqrt(list_dot_product(a.q, a.q) * list_dot_product(b.x, b.x)) as score from vp a join vp b on a.i // 16 = b.i // 16), mk as (select *, score >= max(case when qi = di then score end) over (partition by batch_id, qi) and qi <> di as masked from sc)"


def scores(spark, d):
    return B.batch_scores(vec_pairs(spark, d).withColumn("batch_id", F.floor(F.col("i") / 16)))


@query("batch_scores", f"with {SCORES} select batch_id, qi, di, round(score, 6) + 0.0 as score from sc")
def batch_scores(spark, d):
    return scores(spark, d).withColumn("score", shorten(F.col("score")))


@query("mask_false_negatives", f"with {SCORES} select batch_id, qi, di, masked from mk")
def mask_false_negatives(spark, d):
    return B.mask_false_negatives(scores(spark, d), 1.0).select("batch_id", "qi", "di", "masked")


@query("hn_stats", f"with {SCORES} select batch_id, count(*) filter (masked) as exceed, round(avg(score), 6) + 0.0 as mean, round(max(score), 6) + 0.0 as highest, round(min(score), 6) + 0.0 as lowest, round(avg(cast(masked as integer)), 6) as masked_share from mk group by 1")
def hn_stats(spark, d):
    m = B.mask_false_negatives(scores(spark, d), 1.0)
    return m.groupBy("batch_id").agg(
        F.count_if("masked").alias("exceed"), shorten(F.avg("score")).alias("mean"), shorten(F.max("score")).alias("highest"), shorten(F.min("score")).alias("lowest"), F.round(F.avg(F.col("masked").cast("int")), 6).alias("masked_share")
    )


LOSS = f"{SCORES}, s as (select batch_id, qi, di, case when masked then -1e10 else 50 * score end as s from mk), t as (select *, max(s) over (partition by batch_id, qi) as top from s), l as (select batch_id, qi, any_value(top) + ln(sum(exp(s - top))) - max(case when qi = di then s end) as loss, arg_min(di, (-s, di)) as best from t group by 1, 2)"


@query("contrastive_loss", f"with {LOSS} select batch_id, round(avg(loss), 5) as loss from l group by 1")
def contrastive_loss(spark, d):
    return B.contrastive_loss(B.mask_false_negatives(scores(spark, d), 1.0), 50.0).select("batch_id", F.round("loss", 5).alias("loss"))


@query("inbatch_accuracy", f"with {LOSS} select batch_id, round(avg(cast(best = qi as double)), 6) as accuracy from l group by 1")
def inbatch_accuracy(spark, d):
    return B.contrastive_loss(B.mask_false_negatives(scores(spark, d), 1.0), 50.0).select("batch_id", F.round("accuracy", 6).alias("accuracy"))


#: A pair is a positive of the pairs of its domain in its batch, too.
POSITIVES = f"{SCORES}, ps as (select s.batch_id, s.qi, s.di, s.score, s.qi = s.di or a.domain = b.domain as positive from sc s join vp a on a.i = s.qi join vp b on b.i = s.di), pm as (select *, score >= max(case when qi = di then score end) over (partition by batch_id, qi) and not positive as masked from ps)"


def equal_domains(spark, d):
    p = vec_pairs(spark, d).select("i", "domain", F.floor(F.col("i") / 16).alias("batch_id"))
    a, b = p.withColumnRenamed("i", "a"), p.withColumnRenamed("i", "b")
    return a.join(b, ["batch_id", "domain"]).where("a < b").select("a", "b")  # within batches of 16


@query(
    "contrastive_loss_soft",
    f"with {POSITIVES}, s as (select *, case when masked then -1e10 else 50 * score end as s from pm), t as (select *, max(s) over (partition by batch_id, qi) as top from s), l as (select batch_id, qi, any_value(top) + ln(sum(exp(s - top))) - avg(case when positive then s end) as loss, arg_min(positive, (-s, di)) as hit from t group by 1, 2) "
    "select batch_id, round(4 * avg(loss), 4) as loss, round(avg(cast(hit as double)), 6) as accuracy from l group by 1",
)
def contrastive_loss_soft(spark, d):
    """Several positives a query, which share its label; scaled to 4 ranks."""
    marked = B.with_positives(B.mask_false_negatives(scores(spark, d), 1.0), equal_domains(spark, d))
    return B.contrastive_loss(marked, 50.0, world=4).select("batch_id", F.round("loss", 4).alias("loss"), F.round("accuracy", 6).alias("accuracy"))


#: The hard negative of a pair is the query vector of its neighbour.
NEGATIVE_SCORES = f"{VEC_PAIRS}, cols as (select i // 16 as batch_id, i as di, i as owner, x as v from vp union all select a.i // 16, 1000000 + a.i, a.i, b.q from vp a join vp b on b.i = a.i + 1 - 2 * (a.i % 2)), ns as (select q.i // 16 as batch_id, q.i as qi, c.di, c.owner, list_dot_product(q.q, c.v) / sqrt(list_dot_product(q.q, q.q) * list_dot_product(c.v, c.v)) as score from vp q join cols c on c.batch_id = q.i // 16), own as (select *, max(case when qi = di then score end) over (partition by batch_id, qi) as own from ns)"


def scores_with_negatives(spark, d):
    p = vec_pairs(spark, d).withColumn("batch_id", F.floor(F.col("i") / 16))
    neighbour = (F.col("i") + 1 - 2 * (F.col("i") % 2)).alias("owner")
    mined = p.select(neighbour, F.col("q").alias("v")).select("owner", (F.lit(1000000) + F.col("owner")).alias("did"), "v")
    return B.negative_scores(p, mined)


@query("mask_hard_negatives", f"with {NEGATIVE_SCORES} select batch_id, qi, di, score >= own and owner <> qi and qi <> di as in_batch, (score >= own or owner <> qi) and qi <> di as alone from own")
def mask_hard_negatives(spark, d):
    """Both rules: the columns of the batch as negatives beside the mined ones, and the mined ones alone."""
    s = scores_with_negatives(spark, d)
    first = B.mask_false_negatives(s, 1.0, in_batch=True).withColumnRenamed("masked", "in_batch")
    return first.join(B.mask_false_negatives(s, 1.0, in_batch=False).select("batch_id", "qi", "di", F.col("masked").alias("alone")), ["batch_id", "qi", "di"]).select("batch_id", "qi", "di", "in_batch", "alone")


@query(
    "contrastive_loss_negatives",
    f"with {NEGATIVE_SCORES}, s as (select batch_id, qi, di, case when score >= own and owner <> qi and qi <> di then -1e10 else 50 * score end as s from own), t as (select *, max(s) over (partition by batch_id, qi) as top from s), l as (select batch_id, qi, any_value(top) + ln(sum(exp(s - top))) - max(case when qi = di then s end) as loss from t group by 1, 2) select batch_id, round(avg(loss), 5) as loss from l group by 1",
)
def contrastive_loss_negatives(spark, d):
    return B.contrastive_loss(B.mask_false_negatives(scores_with_negatives(spark, d), 1.0), 50.0).select("batch_id", F.round("loss", 5).alias("loss"))


@query("cut_padding", f"with {TOKEN_BATCH}, n as (select batch_id, max(len(ids)) as n from tk group by 1) select doc_id, list_concat(ids, list_transform(range(n - len(ids)), lambda i: cast(0 as bigint))) as input_ids, list_transform(range(n), lambda i: cast(case when i < len(ids) then 1 else 0 end as integer)) as mask from tk join n using (batch_id)")
def cut_padding(spark, d):
    """Batches padded to 40 positions and cut to their longest row."""
    t = tables.read_table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 16).alias("batch_id"), T.token_ids(F.col("text"), 1000, 32).alias("ids"))
    padded = t.select("doc_id", "batch_id", T.pad(F.col("ids"), 40).alias("input_ids"), T.attention_mask(F.col("ids"), 40).alias("mask"))
    return B.cut_padding(padded, "batch_id", "input_ids", "mask").select("doc_id", "input_ids", "mask")


@query("inputs_for_prefix", "select doc_id, text as ids, source as attention from documents")
def inputs_for_prefix(spark, d):
    t = tables.read_table(spark, d, "documents").select("doc_id", F.col("text").alias("query_ids"), F.col("source").alias("query_attention"), F.col("lang").alias("document_ids"))
    return B.inputs_for(t, "query_", "doc_id")


RANDOM_PAIRS = "select i, batch_id from (with n as (select count(*) // 16 * 16 as per from vp), r as (select i, row_number() over (order by " + order_sql("'42'", "cast(i as varchar)") + ", i) - 1 as rn from vp) select i, rn // 16 as batch_id from r, n where rn < per)"
CLUSTERED = "(select *, i // 10 as cluster from vp)"
PLACED = (
    f"pl as (select 'random' as strategy, i, batch_id from ({RANDOM_PAIRS}) union all select 'domain', i, batch_id from ({groups_sql('vp', 'i', ['domain'], 16, 1)}) "
    f"union all select 'cluster_within_domain', i, batch_id from ({groups_sql(CLUSTERED, 'i', ['domain', 'cluster'], 16, 1, order=order_sql(chr(39) + '42' + chr(39), 'cast(domain as varchar)'))}))"
)


@query(
    "eval_by_sampler",
    f"with {VEC_PAIRS}, {PLACED}, sc as (select pa.strategy, pa.batch_id, a.i as qi, b.i as di, list_dot_product(a.q, b.x) / sqrt(list_dot_product(a.q, a.q) * list_dot_product(b.x, b.x)) as score from pl pa join pl pb on pa.strategy = pb.strategy and pa.batch_id = pb.batch_id join vp a on a.i = pa.i join vp b on b.i = pb.i), "
    "mk as (select *, score >= max(case when qi = di then score end) over (partition by strategy, batch_id, qi) and qi <> di as masked from sc), s as (select *, case when masked then -1e10 else 50 * score end as s from mk), t as (select *, max(s) over (partition by strategy, batch_id, qi) as top from s), "
    "l as (select strategy, batch_id, qi, any_value(top) + ln(sum(exp(s - top))) - max(case when qi = di then s end) as loss from t group by 1, 2, 3), b as (select strategy, batch_id, avg(loss) as loss from l group by 1, 2) select strategy, round(avg(loss), 4) as loss, count(*) as batches from b group by 1",
)
def eval_by_sampler(spark, d):
    """Mean loss of the batches that each sampler makes over the vector pairs."""
    p = vec_pairs(spark, d).withColumn("cluster", F.floor(F.col("i") / 10))
    out = None
    for name in ("random", "domain", "cluster_within_domain"):
        placed = B.get_sampler(name, p, "i", seed=42, epoch=0, batch=16, domain="domain").select("i", "batch_id")
        loss = B.contrastive_loss(B.mask_false_negatives(B.batch_scores(p.join(placed, "i")), 1.0), 50.0)
        part = loss.agg(F.lit(name).alias("strategy"), F.round(F.avg("loss"), 4).alias("loss"), F.count("*").alias("batches"))
        out = part if out is None else out.unionByName(part)
    return out


@query("sample_packed_clusters", groups_sql("(select vec_id, label, (label * 7) % 10 as place from embeddings)", "vec_id", ["label"], 16, 1, order="place"))
def sample_packed_clusters(spark, d):
    """Clusters in the order of a tour, here that of label x 7 modulo 10, instead of a random one."""
    from ..operators import clustering

    e = tables.read_table(spark, d, "embeddings").select("vec_id", "label")
    order = sorted(range(10), key=lambda c: c * 7 % 10)
    return B.sample_groups(clustering.packed(e, "label", order), "vec_id", ["label"], 42, 0, 16, order=F.col("place"))
