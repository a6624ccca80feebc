"""Batch construction: hash-ordered samplers, in-batch scores, masks and losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..work import materialize

STRATEGIES = ("random", "domain", "cluster", "cluster_within_domain")
BROADCAST_DRAWS = 1_000_000  # of two numbers


def numbered(df: DataFrame, order: list[Column], name: str = "rn") -> DataFrame:
    """Positions 0, 1, 2, ... in a total order, without one task that sorts all rows: ranges are numbered apart, after the ranges before.

    Range borders are sampled anew whenever the exchange is planned, so the rows are written once with the range they
    fell in, and sizes and rows both come from what was written.
    """
    staged = df.withColumn("_sort", F.struct(*order)).repartitionByRange("_sort").withColumn("_part", F.spark_partition_id())
    staged = materialize(staged, "ranges")
    local = F.row_number().over(Window.partitionBy("_part").orderBy("_sort")) - 1
    sizes = staged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))  # one row a range, as many as shuffle partitions
    out = staged.withColumn("_local", local).join(F.broadcast(starts), "_part")
    return out.withColumn(name, (F.col("_before") + F.col("_local")).cast("long")).drop("_part", "_local", "_before", "_sort")


def sample_random(df: DataFrame, idx: str, seed: int, epoch: int, batch: int, world: int) -> DataFrame:
    """A permutation of all rows by hash; rank r takes one contiguous chunk of whole batches: (idx, rank, batch_id, pos)."""
    n = df.count()
    per = n // world // batch * batch
    rows = numbered(df.select(idx), [T.hash_order(str(seed + epoch), F.col(idx)), F.col(idx)]).where(F.col("rn") < per * world)
    rank, at = F.floor(F.col("rn") / max(1, per)), F.col("rn") % max(1, per)
    return rows.select(idx, rank.cast("int").alias("rank"), F.floor(at / batch).cast("long").alias("batch_id"), (at % batch).cast("int").alias("pos"))


def sample_groups(df: DataFrame, idx: str, groups: list[str], seed: int, epoch: int, batch: int, world: int = 1, order: Column | None = None) -> DataFrame:
    """Batches of rows that share a group (domain, cluster, or cluster within domain): (idx, batch_id, pos, rank).

    Rows are hash-ordered inside a group, groups stand in the order of `order` (by default their hash), the whole is cut into batches of
    batch x world, the short tail is dropped, batches are permuted by hash and shuffled inside; rank r takes every
    block of `batch` positions.
    """
    size = batch * world
    group = order if order is not None else T.hash_order(str(seed), *[F.col(g) for g in groups])
    keys = [F.col("_group"), *[F.col(g) for g in groups], T.hash_order(str(seed), F.col(idx)), F.col(idx)]
    rows = numbered(df.select(idx, *groups, group.alias("_group")), keys).withColumn("_b", F.floor(F.col("rn") / size).cast("long"))
    full = df.count() // size
    rows = rows.where(F.col("_b") < full)
    batches = df.sparkSession.range(full).select(F.col("id").alias("_b"))
    batches = numbered(batches, [T.hash_order(str(seed + epoch), F.col("_b")), F.col("_b")], "batch_id")
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(T.hash_order(str(seed + epoch), F.lit("in"), F.col(idx)), idx)) - 1
    placed = rows.withColumn("pos", inside).join(batches, "_b")
    return placed.select(idx, "batch_id", (F.col("pos") % batch).cast("int").alias("pos"), F.floor(F.col("pos") / batch).cast("int").alias("rank"))


def context_sample(batches: DataFrame, size: int, seed: str) -> DataFrame:
    """For each batch two independent hash samples of at most `size` members: (batch_id, side, ctx_pos, idx)."""
    out = None
    for side in ("query", "document"):
        pos = F.row_number().over(Window.partitionBy("batch_id").orderBy(T.hash_order(seed, F.lit(side), F.col("idx")), "idx")) - 1
        part = batches.withColumn("ctx_pos", pos).where(F.col("ctx_pos") < size).select("batch_id", F.lit(side).alias("side"), "ctx_pos", "idx")
        out = part if out is None else out.unionByName(part)
    return out


def minicorpus(docs: DataFrame, idx: str, size: int, seed: str) -> DataFrame:
    """Exactly `size` draws with replacement: (draw, idx). None from an empty table."""
    n = docs.count()
    rows = numbered(docs.select(idx), [F.col(idx)])
    draws = docs.sparkSession.range(size).select(F.col("id").alias("draw"), F.floor(T.uniform(seed, F.col("id")) * n).cast("long").alias("rn"))
    return rows.join(F.broadcast(draws) if size <= BROADCAST_DRAWS else draws, "rn").select("draw", idx)


def batch_scores(pairs: DataFrame, batch: str = "batch_id") -> DataFrame:
    """All query-document scores inside a batch: (batch_id, qi, di, score) of pairs (i, q, x). A batch has a fixed size."""
    a = pairs.select(batch, F.col("i").alias("qi"), V.normalize(F.col("q")).alias("_q"))
    b = pairs.select(batch, F.col("i").alias("di"), V.normalize(F.col("x")).alias("_x"))
    return a.join(b, batch).select(batch, "qi", "di", V.dot(F.col("_q"), F.col("_x")).alias("score"))


def negative_scores(pairs: DataFrame, negatives: DataFrame, batch: str = "batch_id") -> DataFrame:
    """`batch_scores` with the hard negatives (owner, did, v) of the batch as further columns: (batch_id, qi, di, owner, score).

    owner is the pair that a column belongs to: its own for a document, that it was mined for for a negative. di tells
    columns apart, so ids of negatives must differ from those of pairs.
    """
    q = pairs.select(batch, F.col("i").alias("qi"), V.normalize(F.col("q")).alias("_q"))
    own = pairs.select(batch, F.col("i").alias("di"), F.col("i").alias("owner"), V.normalize(F.col("x")).alias("_x"))
    mined = negatives.join(pairs.select(batch, F.col("i").alias("owner")), "owner").select(batch, F.col("did").alias("di"), "owner", V.normalize(F.col("v")).alias("_x"))
    return q.join(own.unionByName(mined), batch).select(batch, "qi", "di", "owner", V.dot(F.col("_q"), F.col("_x")).alias("score"))


def mask_false_negatives(scores: DataFrame, threshold: float | None, in_batch: bool = True) -> DataFrame:
    """scores with `masked`, which never covers the positive.

    Columns at least as good as the row's own positive (threshold 1.0) or as `threshold` are masked; no threshold masks
    none. With hard negatives (a column `owner`) those mined for the row itself are never masked where columns of the
    batch count as negatives (`in_batch`); where they do not, all columns of other owners are masked as well.
    """
    positive = F.col("qi") == F.col("di")
    own = F.max(F.when(positive, F.col("score"))).over(Window.partitionBy("batch_id", "qi"))
    high = F.lit(False) if not threshold else F.col("score") >= (own if threshold == 1.0 else F.lit(threshold))
    if "owner" in scores.columns:
        match = F.col("owner") == F.col("qi")
        high = high & ~match if in_batch else high | ~match
    return scores.withColumn("masked", high & ~positive)


def with_positives(scores: DataFrame, equal: DataFrame) -> DataFrame:
    """scores with `positive`: the row's own column and those that `equal` (a, b), in either order, calls the same; at most one row a pair."""
    both = equal.select(F.col("a").alias("qi"), F.col("b").alias("di")).unionByName(equal.select(F.col("b").alias("qi"), F.col("a").alias("di"))).distinct()
    found = scores.join(both.withColumn("_same", F.lit(True)), ["qi", "di"], "left")
    return found.withColumn("positive", F.coalesce("_same", F.lit(False)) | (F.col("qi") == F.col("di"))).drop("_same")


def contrastive_loss(scores: DataFrame, temperature: float, world: int = 1) -> DataFrame:
    """(batch_id, loss, accuracy): mean cross entropy over the unmasked columns, and the share of queries whose best column is a positive.

    The positives of a row (column `positive`; without it the row's own column) share the label equally and are never
    masked. `world` scales the loss to the number of ranks that share their negatives.
    """
    positive = F.col("positive") if "positive" in scores.columns else F.col("qi") == F.col("di")
    s = F.when(F.col("masked") & ~positive, F.lit(-1e10)).otherwise(F.col("score") * temperature)
    top = F.max(s).over(Window.partitionBy("batch_id", "qi"))
    rows = scores.withColumn("_p", positive).withColumn("s", s).withColumn("top", top)
    per = rows.groupBy("batch_id", "qi").agg(
        (F.max("top") + F.log(F.sum(F.exp(F.col("s") - F.col("top")))) - F.avg(F.when(F.col("_p"), F.col("s")))).alias("loss"),
        F.max_by("_p", F.struct(F.col("s"), -F.col("di"))).alias("hit"),
    )
    return per.groupBy("batch_id").agg((F.avg("loss") * world).alias("loss"), F.avg(F.col("hit").cast("double")).alias("accuracy"))


def cut_padding(rows: DataFrame, batch: str, ids: str, mask: str, pad: int = 0) -> DataFrame:
    """All rows with `ids` and `mask` cut where, for the first time, all rows of the batch are padding; without such a place they stay."""
    spread = rows.select(batch, F.posexplode(ids).alias("_at", "_id"))
    empty = spread.groupBy(batch, "_at").agg(F.bool_and(F.col("_id") == pad).alias("_all")).where("_all")
    first = empty.groupBy(batch).agg(F.min("_at").alias("_end"))
    end = F.coalesce("_end", F.size(ids))
    return rows.join(first, batch, "left").withColumns({ids: F.slice(ids, F.lit(1), end), mask: F.slice(mask, F.lit(1), end)}).drop("_end")


def inputs_for(rows: DataFrame, prefix: str, *keys: str) -> DataFrame:
    """The columns of one input, `prefix` taken out of their names wherever it stands, beside `keys`."""
    return rows.select(*keys, *[F.col(c).alias(c.replace(prefix, "")) for c in rows.columns if c.startswith(prefix)])


def get_sampler(strategy: str, df: DataFrame, idx: str, *, seed: int, epoch: int, batch: int, world: int = 1, domain: str = "dataset", cluster: str = "cluster") -> DataFrame:
    """Batches by one of the four strategies; an unknown one is an error."""
    if strategy == "random":
        return sample_random(df, idx, seed, epoch, batch, world)
    if strategy == "domain":
        return sample_groups(df, idx, [domain], seed, epoch, batch, world)
    if strategy == "cluster":
        return sample_groups(df, idx, [cluster], seed, epoch, batch, world)
    if strategy == "cluster_within_domain":
        return sample_groups(df, idx, [domain, cluster], seed, epoch, batch, world, order=T.hash_order(str(seed), F.col(domain)))
    raise ValueError(f"unknown sampling strategy {strategy!r}; one of {STRATEGIES}")


def sampler_fingerprint(strategy: str, **config) -> str:
    """Key of a batch plan: the md5 of its configuration."""
    from ..sources.cache import cache_key

    return cache_key(strategy=strategy, **config)


def running_rank(df: DataFrame, key: str, world: int) -> DataFrame:
    """`rank` by key modulo the number of readers; only for exports, as Spark deals out its own tasks."""
    return df.withColumn("rank", F.pmod(F.col(key), F.lit(world)).cast("int"))
