"""Hard negatives: mining, sampling, and the join of precomputed indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def mine(rows: DataFrame, margin: float = 3.0, per_system: int = 5) -> DataFrame:
    """(qid, positives, negatives) of (qid, pos array<struct<pid, ce>>, neg array<struct<system, cands array<struct<pid, ce>>>>).

    Systems count in order: a candidate is added if its score is at most the smallest positive score less `margin`
    and no system before has added it; a system ends after `per_system` additions. Queries with no positive or no
    negative go. The fold runs inside the row, so rows stay where they are.
    """
    limit = F.array_min(F.transform("pos", lambda p: p["ce"])) - margin

    def one(added: Column, system: Column) -> Column:
        start = F.struct(added.alias("all"), F.lit(0).alias("new"))
        fine = lambda a, c: (c["ce"] <= limit) & (a["new"] < per_system) & ~F.array_contains(a["all"], c["pid"])
        step = lambda a, c: F.struct(F.when(fine(a, c), F.concat(a["all"], F.array(c["pid"]))).otherwise(a["all"]).alias("all"), F.when(fine(a, c), a["new"] + 1).otherwise(a["new"]).alias("new"))
        return F.aggregate(system["cands"], start, step, lambda a: a["all"])

    kind = rows.schema["pos"].dataType.elementType["pid"].dataType.simpleString()
    out = rows.select("qid", F.transform("pos", lambda p: p["pid"]).alias("positives"), F.aggregate("neg", F.array().cast(f"array<{kind}>"), one).alias("negatives"))
    return out.where((F.size("positives") > 0) & (F.size("negatives") > 0))


def sample(negatives: Column, k: int, *keys: Column) -> Column:
    """At most k different elements, in hash order of their position."""
    ordered = F.array_sort(F.transform(negatives, lambda x, i: F.struct(T.hash_order("neg", *keys, i).alias("h"), x.alias("x"))))
    return F.transform(F.slice(ordered, 1, k), lambda s: s["x"])


def sample_fill(negatives: Column, k: int, *keys: Column) -> Column:
    """Exactly k elements: without replacement where there are k, else with."""
    n = F.size(negatives)
    drawn = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.get(negatives, F.floor(T.uniform("fill", *keys, i) * n).cast("int")))
    return F.when(n >= k, sample(negatives, k, *keys)).when(n > 0, drawn).otherwise(negatives)


def join_index(pairs: DataFrame, index: DataFrame, column: str) -> DataFrame:
    """Attach precomputed vectors by key, never by position."""
    return pairs.join(index.select("idx", F.col("v").alias(column)), "idx", "left")


def duplicate_labels(rows: DataFrame, batch: str, idx: str, text: str) -> DataFrame:
    """(batch, a, b): pairs of a batch with equal text, which count as positives of each other. A batch has a fixed size."""
    t = rows.select(batch, F.col(idx).alias("a"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("_k"))
    return t.join(t.withColumnRenamed("a", "b"), [batch, "_k"]).where("a < b").select(batch, "a", "b")
