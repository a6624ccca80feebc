"""Operators on small fixtures: golden results, edge cases and invariances."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.functions import vectors as V
from lexiloom.operators import batches, clustering, encoder, metrics, negatives, retrieval
from lexiloom.sources import cache, tables
from lexiloom.streaming.metrics import windowed_averages


def blobs(spark):
    rng = np.random.default_rng(0)
    centres = [100 * rng.normal(size=8), 100 * rng.normal(size=8), rng.normal(size=8) * 30]
    rows, i = [], 0
    for c, n in zip(centres, (6, 9, 5)):
        for _ in range(n):
            rows.append((i, (c + rng.normal(size=8)).tolist()))
            i += 1
    return spark.createDataFrame(rows, "i long, q array<double>").withColumn("x", F.col("q"))


def test_paired_kmeans_finds_blobs(spark):
    got = {r["i"]: r["cluster"] for r in clustering.paired_kmeans(blobs(spark), 3, 10).collect()}
    best = {tuple(sorted(i for i in got if got[i] == c)) for c in set(got.values())}
    assert len(got) == 20 and sum(map(len, best)) == 20
    # no cluster mixes two blobs unless two seeds fell into one blob
    whole = [set(range(6)), set(range(6, 15)), set(range(15, 20))]
    assert all(any(set(c) <= w for w in whole) for c in best) or len(best) < 3


def test_kmeans_keeps_empty_clusters(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.9, 0.1], 0)], "i long, v array<double>, cluster int")
    old = {0: {0: np.array([1.0, 0.0]), 1: np.array([0.0, 1.0])}}
    new = clustering.update(rows, old, "v")
    assert np.allclose(new[0][1], [0.0, 1.0])


def test_greedy_order(spark):
    c = spark.createDataFrame([(0, [0.0]), (1, [5.0]), (2, [1.0]), (3, [2.0])], "cluster int, centroid array<double>")
    assert clustering.greedy_order(c, 0) == [0, 2, 3, 1]
    assert clustering.greedy_order(c.where("cluster = 1")) == [1]


def test_hard_batch_sees_every_row(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(450, 4))
    x[400:] /= 50  # the shortest rows come last
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx long, v array<double>").repartition(3)
    total, left, want = np.zeros(4), np.ones(450, bool), []
    for _ in range(4):
        at = int(np.where(left, np.round(((total + x) ** 2).sum(1), 10), np.inf).argmin())
        total, left[at] = total + x[at], False
        want.append(at)
    assert max(want) >= 400 and clustering.hard_batch(df, 4) == want
    assert len(clustering.hard_batch(df.limit(2), 4)) == 2


def test_topk_excludes_self_and_orders_ties(spark):
    c = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(4)] + [(4, [0.0, 0.0]), (5, [0.0, 1.0])], "did long, v array<double>")
    q = c.where("did in (1, 4)").select(F.col("did").alias("qid"), "v")
    rows = retrieval.cosine_topk(q, c, 3).orderBy("qid", "rank").collect()
    assert [(r["qid"], r["did"]) for r in rows if r["qid"] == 1] == [(1, 0), (1, 2), (1, 3)]
    assert all(r["score"] == -1.0 for r in rows if r["qid"] == 4)
    assert retrieval.cosine_topk(q.limit(0), c, 3).count() == 0


def test_topk_is_independent_of_partitions(spark):
    rng = np.random.default_rng(1)
    c = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(200)], "did long, v array<double>")
    q = c.where("did < 5").select(F.col("did").alias("qid"), "v")
    a, b = (sorted(map(tuple, retrieval.cosine_topk(q, c.repartition(n), 7).select("qid", "did", "rank").collect())) for n in (1, 9))
    assert a == b


def test_metrics_by_hand(spark):
    run = retrieval.ranked(spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.8), (1, 12, 0.7)], "qid long, did long, score double"))
    qrels = spark.createDataFrame([(1, 11, 1), (1, 99, 1)], "qid long, did long, rel int")
    got = {(r["metric"], r["k"]): r["value"] for r in metrics.ranking_metrics(run, qrels, (1, 5)).collect()}
    assert got["recall", 5] == 0.5 and got["precision", 5] == pytest.approx(0.2) and got["map", 5] == pytest.approx(0.25)
    assert got["ndcg", 5] == pytest.approx((1 / np.log2(3)) / (1 + 1 / np.log2(3))) and got["ndcg", 1] == 0


def test_leaderboard_null_rule(spark):
    s = spark.createDataFrame([("a", 1.0)], "task string, value double")
    t = spark.createDataFrame([("a", "x"), ("b", "y")], "task string, category string")
    assert {r["category"]: r["average"] for r in metrics.leaderboard(s, t).collect()} == {"x": 1.0, "y": None, "overall": None}


def test_mining_is_a_fold(spark):
    schema = "qid long, pos array<struct<pid: long, ce: double>>, neg array<struct<system: string, cands: array<struct<pid: long, ce: double>>>>"
    rows = [(1, [(1, 9.0)], [("a", [(10 + i, 1.0) for i in range(7)]), ("b", [(15, 1.0), (10, 1.0), (30, 8.0), (31, 6.0)])]), (2, [], [("a", [(1, 1.0)])])]
    got = negatives.mine(spark.createDataFrame(rows, schema)).collect()
    assert [(r["qid"], r["negatives"]) for r in got] == [(1, [10, 11, 12, 13, 14, 15, 31])]


def test_sample_fill(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, []), (3, ["a", "b", "c", "d"])], "id long, n array<string>")
    got = {r["id"]: r["s"] for r in df.select("id", negatives.sample_fill(F.col("n"), 3, F.col("id")).alias("s")).collect()}
    assert got[1] == ["a", "a", "a"] and got[2] == [] and len(set(got[3])) == 3


def test_batches_cover_every_row_once(spark):
    df = spark.range(103).select(F.col("id").alias("idx"), (F.col("id") % 3).alias("g"))
    b = batches.sample_groups(df, "idx", ["g"], 1, 0, 5, 2).collect()
    assert len(b) == 100 == len({r["idx"] for r in b}) and {r["rank"] for r in b} == {0, 1}
    assert {r["batch_id"] for r in b} == set(range(10))
    r = batches.sample_random(df, "idx", 1, 0, 5, 2).collect()
    assert len(r) == 100 == len({x["idx"] for x in r})


def test_mask_never_hides_the_positive(spark):
    s = spark.createDataFrame([(0, 1, 1, 0.2), (0, 1, 2, 0.9), (0, 2, 2, 0.9), (0, 2, 1, 0.1)], "batch_id long, qi long, di long, score double")
    m = {(r["qi"], r["di"]): r["masked"] for r in batches.mask_false_negatives(s, 1.0).collect()}
    assert m == {(1, 1): False, (1, 2): True, (2, 2): False, (2, 1): False}
    out = batches.contrastive_loss(batches.mask_false_negatives(s, 1.0), 1.0).first()
    assert out["accuracy"] == 1.0 and out["loss"] > 0


def test_text_functions(spark):
    df = spark.createDataFrame([(None,), ("",), ("Ab é9",)], "t string")
    got = df.select(T.fix_empty(F.col("t")), T.words(F.col("t")), T.preview(F.col("t"), 2)).collect()
    assert [tuple(r) for r in got] == [("[empty]", [], ""), ("[empty]", [], ""), ("Ab é9", ["ab", "é9"], "Ab...")]


def test_pooling_of_an_empty_mask(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]], [0, 0])], "h array<array<double>>, m array<int>")
    r = df.select(V.last_token_pool(F.col("h"), F.col("m")).alias("last"), V.mean_pool_segments(F.col("h"), F.col("m"), 1).alias("seg")).first()
    assert r["last"] == [1.0, 2.0] and r["seg"] == [[2.0, 3.0], [2.0, 3.0]]


def test_encoder_prompts(spark):
    e = encoder.Encoder(lambda texts: np.array([[len(t), 1.0] for t in texts]), {"query": "q: "}, normalize=False)
    df = spark.createDataFrame([("abc",), (None,)], "t string")
    assert [r["embedding"][0] for r in e.apply(df, "t", "query").collect()] == [6.0, 10.0]
    with pytest.raises(ValueError):
        e.apply(df, "t", "other")


def test_cache(spark, tmp_path):
    c, made = cache.Cache(spark, tmp_path.as_uri()), []
    make = lambda: made.append(1) or spark.range(3)
    assert c.get("x", make, a=1, _skip=2).count() == 3 and c.get("x", make, a=1, _skip=5).count() == 3 and len(made) == 1
    assert cache.cache_key(b=1, a=2) == cache.cache_key(a=2, b=1)
    both = c.get_all(lambda: {"p": spark.range(1), "q": spark.range(2)}, ["p", "q"], v=1)
    assert both["q"].count() == 2


def test_readers_and_writers(spark, tmp_path):
    with gzip.open(tmp_path / "mined.jsonl.gz", "wt") as f:
        f.write(json.dumps({"qid": "1", "pos": [{"pid": "2", "ce-score": 1.5}], "neg": {"bm25": [{"pid": "3", "ce-score": 0.5}]}}) + "\n")
    assert tables.read_mined(spark, str(tmp_path / "mined.jsonl.gz")).first()["neg"]["bm25"][0]["pid"] == "3"
    (tmp_path / "q.jsonl").write_text(json.dumps({"query-id": 7, "corpus-id": 8, "score": 2}) + "\n")
    assert tuple(tables.read_qrels(spark, str(tmp_path / "q.jsonl")).first()) == ("7", "8", 2)
    (tmp_path / "res").mkdir()
    (tmp_path / "res/task_a.json").write_text('{"test": {"ndcg": 0.5}}')
    assert tables.read_results(spark, str(tmp_path / "res")).first()["task"] == "task_a"
    df = spark.range(10).select(F.col("id").alias("idx"), (F.col("id") % 3).alias("cluster"))
    tables.write_embeddings(df.coalesce(1), str(tmp_path / "emb"), 4)
    assert len(list((tmp_path / "emb").glob("*.parquet"))) == 3
    tables.write_assignments_text(df, str(tmp_path / "txt"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "txt")).collect()].count("0") == 4
    with pytest.raises(ValueError):
        tables.text_column(df)
    flat = tables.text_column(spark.createDataFrame([(["a", "b"],)], "sentences array<string>"))
    assert [r[0] for r in flat.collect()] == ["a", "b"]


def test_streaming_averages_match_batch(spark, sf_dir, tmp_path):
    log = tables.read_table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("key"), "value")
    log.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    q = windowed_averages(stream, "1 day").writeStream.outputMode("complete").format("memory").queryName("averages").start()
    q.processAllAvailable()
    q.stop()
    a = sorted((r["key"], r["start"], r["n"], round(r["value"], 6)) for r in spark.sql("select * from averages").collect())
    b = sorted((r["key"], r["start"], r["n"], round(r["value"], 6)) for r in windowed_averages(log, "1 day").collect())
    assert a == b


def test_svd_keeps_the_leading_directions(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 2)) @ rng.normal(size=(2, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")
    basis, _ = encoder.gramian_svd(df, "v", 2)
    assert np.allclose(x @ basis @ basis.T, x)


def test_factories(spark, tmp_path):
    df = spark.range(64).select(F.col("id").alias("idx"), (F.col("id") % 2).alias("dataset"), (F.col("id") % 4).alias("cluster"))
    for s in batches.STRATEGIES:
        assert batches.get_sampler(s, df, "idx", seed=1, epoch=0, batch=8).count() == 64
    with pytest.raises(ValueError):
        batches.get_sampler("other", df, "idx", seed=1, epoch=0, batch=8)
    assert batches.sampler_fingerprint("random", seed=1) != batches.sampler_fingerprint("random", seed=2)
    c = spark.createDataFrame([(0, [0.0]), (1, [5.0])], "cluster int, centroid array<double>")
    assert sorted(clustering.order_clusters("random", c)) == [0, 1] == clustering.order_clusters("tsp_greedy", c)
    with pytest.raises(ValueError):
        clustering.order_clusters("other", c)
    df.select("idx", "cluster").write.parquet(str(tmp_path / "a"))
    assert tables.convert_assignments(spark, str(tmp_path / "a"), str(tmp_path / "b")) and not tables.convert_assignments(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    e = encoder.Encoder(lambda texts: np.array([[len(t), 1.0] for t in texts]))
    p = spark.createDataFrame([(0, "a", "bb"), (1, "ccc", None)], "i long, query string, document string")
    assert clustering.embed_for_clustering(p, e).count() == 2
    assert encoder.embed_with_cache(cache.Cache(spark, tmp_path.as_uri()), e, p, "i", "query", model="len", dataset="p").count() == 2


def test_positions_of_many_rows_in_many_ranges(spark):
    """Every position once, though the ranges are sampled and the sides of the join read different columns."""
    from lexiloom.functions import text as T

    n = 2_000_000
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(n).withColumnRenamed("id", "i")
        rows = batches.numbered(df, [T.hash_order("x", F.col("i")), F.col("i")])
        got = rows.agg(F.count_distinct("rn"), F.min("rn"), F.max("rn"), F.count_distinct("i")).first()
        assert tuple(got) == (n, 0, n - 1, n)
        picked = batches.sample_random(df, "i", 1, 0, 16, 4)
        assert picked.count() == n // 4 // 16 * 64
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_centroids_in_slices_and_restarts(spark, monkeypatch):
    df = blobs(spark).select("i", V.normalize(F.col("q")).alias("v"))
    c = clustering.first_rows(df, "i", "v", 5)
    whole = {r["i"]: r["cluster"] for r in clustering.assign(df, c).collect()}
    low = {r["i"]: r["cluster"] for r in clustering.assign(df, c, maximize=False).collect()}
    monkeypatch.setattr(clustering, "CENTROID_BYTES", 130)  # two centroids a slice
    assert {r["i"]: r["cluster"] for r in clustering.assign(df, c).collect()} == whole
    assert {r["i"]: r["cluster"] for r in clustering.assign(df, c, maximize=False).collect()} == low
    monkeypatch.undo()
    pairs = blobs(spark)
    rows = clustering.side(pairs, "q", "x")

    def worth(got):
        means = clustering.collect_centroids(V.mean_vectors(got.join(rows, "i"), ["cluster"], "v"))
        return clustering.objective(rows, {0: {k: v / np.linalg.norm(v) for k, v in means[0].items()}}, "v")

    assert worth(clustering.paired_kmeans(pairs, 3, 2, restarts=3)) >= worth(clustering.paired_kmeans(pairs, 3, 2)) - 1e-9


def test_work_folder(spark, monkeypatch):
    from lexiloom import work

    kept = work.materialize(spark.range(3), "kept")
    gone = work.materialize(spark.range(3), "gone")
    work.release(gone)
    assert kept.count() == 3 and work.work_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    work.clear(spark)
    with pytest.raises(Exception):
        spark.read.parquet(kept._lexiloom_path)


def test_entry_names_only_two_modules_as_optional(tmp_path):
    """A missing library of an operator is an error, not a silent loss of queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "lexiloom", tmp_path / "lexiloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    (tmp_path / "lexiloom" / "llm").mkdir()
    (tmp_path / "lexiloom" / "llm" / "__init__.py").write_text("")
    (tmp_path / "lexiloom" / "llm" / "queries.py").write_text("import no_such_library\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert done.returncode and "no_such_library" in done.stderr


def test_sparse_kmeans_against_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    x = np.where(rng.random((40, 12)) < 0.4, rng.integers(1, 6, (40, 12)), 0).astype(float)
    q = np.where(rng.random((40, 12)) < 0.4, rng.integers(1, 6, (40, 12)), 0).astype(float)
    q[0] = 0
    q[0, 3] = 1
    for minimize in (False, True):
        c = x[:5].copy()
        for _ in range(4):
            s = q @ c.T
            own = (s if minimize else -s).argmin(1)
            new = np.array([x[own == k].mean(0) if (own == k).any() else c[k] for k in range(5)])
            done = np.abs(new - c).max() < 1e-12
            c = new
            if done:
                break
        long = lambda m, name: spark.createDataFrame([(i, f"t{j}", float(m[i, j])) for i in range(len(m)) for j in range(12) if m[i, j]], f"{name} int, token string, w double")
        got = clustering.sparse_kmeans(long(q, "idx"), long(x, "idx"), long(x[:5], "cluster"), iterations=4, tolerance=0.0, minimize=minimize)
        assert {r["idx"]: r["cluster"] for r in got.collect()} == {i: int(k) for i, k in enumerate(own) if q[i].any()}


def test_orders_and_assignments_as_text(spark, tmp_path):
    rows = spark.createDataFrame([(i, i * 7 % 5) for i in range(200)], "idx long, cluster int").repartition(3)
    path = (tmp_path / "a").as_uri()
    tables.write_assignments_text(rows, path)
    assert {r["idx"]: r["cluster"] for r in tables.read_assignments_text(spark, path).collect()} == {i: i * 7 % 5 for i in range(200)}
    order = spark.createDataFrame([(0, 4), (1, 0), (2, 3)], "position int, cluster int")
    tables.write_order_text(order, (tmp_path / "o").as_uri())
    assert sorted(map(tuple, tables.read_order_text(spark, (tmp_path / "o").as_uri()).collect())) == [(0, 4), (1, 0), (2, 3)]
    store, calls = cache.Cache(spark, (tmp_path / "c").as_uri()), []
    cents = spark.createDataFrame([(0, [0.0]), (1, [5.0]), (2, [1.0])], "cluster int, centroid array<double>")
    for _ in range(2):
        calls.append(clustering.cached_order(store, "tsp_greedy", cents, model="m"))
    assert calls == [[0, 2, 1], [0, 2, 1]]


def test_bm25_vectors_of_pairs(spark):
    pairs = spark.createDataFrame([(0, "red fox", "the red fox runs"), (1, "blue", "a blue bird"), (2, "", "the end")], "i long, query string, document string")
    same = clustering.embed_for_clustering(pairs, "bm25", "document", "document").collect()
    both = {(r["i"], r["token"]): (r["q"], r["x"]) for r in clustering.embed_for_clustering(pairs, "bm25").collect()}
    assert same and all(r["q"] == r["x"] > 0 for r in same)
    assert both[0, "red"][0] > 0 and both[0, "runs"] == (0.0, both[0, "runs"][1]) and both[0, "runs"][1] > 0


def test_result_files_of_odd_shapes(spark):
    raw = spark.createDataFrame([("a", "{}"), ("b", '{"test": {}}'), ("c", '{"test": {"x": {"x": 1, "y": "text", "z": null}}}')], "task string, content string")
    got = [(r["task"], r["metric"], r["value"]) for r in metrics.parse_results(raw).collect()]
    assert got == [("c", "x", 1.0)]
    assert metrics.parse_results(raw.limit(0)).count() == 0


def test_sharded_runs_all_shards_in_the_same_jobs(spark):
    from lexiloom import work

    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3).tolist(), rng.normal(size=3).tolist() if i % 50 else None) for i in range(400)]
    pairs = spark.createDataFrame(rows, "i long, q array<double>, x array<double>")
    before = len(work._written)
    out = clustering.sharded(pairs, 4, 10, 2)
    assert len(work._written) - before == 1  # 40 shards, one table
    got = {r["i"]: (r["shard"], r["cluster"]) for r in out.collect()}
    assert len(got) == 400 and {i for i, (_, c) in got.items() if c < 0} == set(range(0, 400, 50))
    assert all(s * 3 <= c < (s + 1) * 3 for s, c in got.values() if c >= 0) and len({s for s, _ in got.values()}) == 40
    by_shard = {shard_bytes: {tuple(r) for r in clustering.sharded(pairs, 4, 150, 2, shard_bytes=shard_bytes).collect()} for shard_bytes in (0, 8 * 6 * 130, 1 << 20)}
    assert by_shard[0] == by_shard[8 * 6 * 130] == by_shard[1 << 20]  # in turn, some in turn, in tasks
