"""Ranking metrics and report roll-ups."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SKIPPED = ("std", "evaluation_time", "main_score", "threshold")


def ranking_metrics(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 100)) -> DataFrame:
    """(metric, k, value): ndcg, map, recall and precision, means over the judged queries.

    run: (qid, did, score, rank); qrels: (qid, did, rel). Gain is the relevance, the discount log2(rank + 1), and
    the ideal comes from the judgements; average precision and recall divide by all relevant documents.
    """
    good = qrels.where("rel > 0")
    ideal_rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel"), "did"))
    ideal = good.withColumn("r", ideal_rank)
    hits = run.join(good, ["qid", "did"]).withColumn("hit", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    gain = F.col("rel") / F.log2(F.col("rank") + 1)
    per_ideal = ideal.groupBy("qid").agg(F.count("*").alias("relevant"), *[F.sum(F.when(F.col("r") <= k, F.col("rel") / F.log2(F.col("r") + 1))).alias(f"ideal_{k}") for k in ks])
    per_hit = hits.groupBy("qid").agg(
        *[F.sum(F.when(F.col("rank") <= k, gain)).alias(f"dcg_{k}") for k in ks],
        *[F.sum(F.when(F.col("rank") <= k, F.col("hit") / F.col("rank"))).alias(f"ap_{k}") for k in ks],
        *[F.sum(F.when(F.col("rank") <= k, 1)).alias(f"hits_{k}") for k in ks],
    )
    per = per_ideal.join(per_hit, "qid", "left").na.fill(0.0)
    out = []
    for k in ks:
        out += [
            F.struct(F.lit("ndcg").alias("metric"), F.lit(k).alias("k"), F.avg(F.coalesce(F.col(f"dcg_{k}") / F.col(f"ideal_{k}"), F.lit(0.0))).alias("value")),
            F.struct(F.lit("map").alias("metric"), F.lit(k).alias("k"), F.avg(F.coalesce(F.col(f"ap_{k}") / F.col("relevant"), F.lit(0.0))).alias("value")),
            F.struct(F.lit("recall").alias("metric"), F.lit(k).alias("k"), F.avg(F.coalesce(F.col(f"hits_{k}") / F.col("relevant"), F.lit(0.0))).alias("value")),
            F.struct(F.lit("precision").alias("metric"), F.lit(k).alias("k"), F.avg(F.coalesce(F.col(f"hits_{k}") / F.lit(k), F.lit(0.0))).alias("value")),
        ]
    return per.agg(F.array(*out).alias("m")).select(F.explode("m").alias("m")).select("m.metric", "m.k", "m.value")


def score_weighted(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Mean, sum and number of score x relevance over the judgements of the retrieved queries; a missing score is 0."""
    asked = run.select("qid").distinct()
    rows = qrels.join(asked, "qid", "left_semi").join(run.select("qid", "did", "score"), ["qid", "did"], "left")
    value = F.coalesce("score", F.lit(0.0)) * F.col("rel")
    return rows.agg(F.avg(value).alias("mean"), F.sum(value).alias("sum"), F.count("*").alias("total"))


def flatten_results(entries: DataFrame) -> DataFrame:
    """(task, metric, value x 100) of parsed entries (task, metric, value), without bookkeeping metrics."""
    skip = F.lit(False)
    for s in SKIPPED:
        skip = skip | F.col("metric").contains(s)
    return entries.where(~skip).select("task", "metric", (F.col("value") * 100).alias("value"))


def parse_results(raw: DataFrame, splits: dict[str, str] | None = None, languages: dict[str, list[str]] | None = None) -> DataFrame:
    """(task, split, lang, metric, value) of result files (task, content).

    A file is {split: {metric: value or {sub: value}}}, with a level of languages below the split for the tasks that
    `languages` gives more than one. The split is that of `splits` where the file has it, else test; a file without
    test is left out, as is a language it lacks. The metric of a sub-value is named metric_sub. Numbers only.
    """
    splits, languages = splits or {}, languages or {}

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for task, content in zip(b["task"], b["content"]):
                found = json.loads(content)
                split = splits.get(task) if splits.get(task) in found else "test"
                if split not in found:
                    continue
                several = len(languages.get(task, ())) > 1
                for lang in languages[task] if several else ["default"]:
                    scores = found[split].get(lang) if several else found[split]
                    for metric, value in (scores or {}).items():
                        for sub, x in (value if isinstance(value, dict) else {metric: value}).items():
                            if isinstance(x, (int, float)):
                                rows.append((task, split, lang, metric if sub == metric else f"{metric}_{sub}", float(x)))
            yield pd.DataFrame(rows, columns=["task", "split", "lang", "metric", "value"])

    return raw.select("task", "content").mapInPandas(entries, "task string, split string, lang string, metric string, value double")


def main_scores(flat: DataFrame, tasks: DataFrame, named: dict[str, str]) -> DataFrame:
    """(task, value): of the flat results of each task (task, category) the metric that `named` gives its category."""
    wanted = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])
    rows = flat.join(tasks, "task").where(F.col("metric") == F.try_element_at(wanted, F.col("category")))
    return rows.groupBy("task").agg(F.first("value").alias("value"))


def leaderboard_wide(scores: DataFrame, tasks: DataFrame, categories: list[str]) -> DataFrame:
    """`leaderboard` as one row: a column for the overall average and one for each category."""
    return leaderboard(scores, tasks).groupBy().pivot("category", ["overall", *categories]).agg(F.first("average"))


def leaderboard(scores: DataFrame, tasks: DataFrame) -> DataFrame:
    """(category, average): rounded means of task scores per category and overall; any missing task makes the mean null.

    scores: (task, value); tasks: (task, category), the whole list of tasks.
    """
    rows = tasks.join(scores, "task", "left").select("category", F.round("value", 2).alias("value"))
    whole = F.when(F.count("value") == F.count("*"), F.avg("value")).alias("average")
    return rows.groupBy("category").agg(whole).unionByName(rows.agg(whole).select(F.lit("overall").alias("category"), "average"))


def running_averages(log: DataFrame, every: int) -> DataFrame:
    """(key, window, value): means of (step, key, value) since the last flush, which comes every `every` steps."""
    return log.groupBy("key", F.floor(F.col("step") / every).alias("window")).agg(F.avg("value").alias("value"))
