"""The pipeline's stages against plain versions of their decisions."""

import corpus_pipeline
from pyspark.sql import functions as F

from lexiloom.llm import neardup, quality, toxicity


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "toxicity", "near_dedup", "secrets", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality"](spark, docs, sf_dir)
    want = quality.score_quality(docs, quality.fit_quality(docs, labels)).where("quality_label = 1")
    assert good.columns == docs.columns and set(good.collect()) == set(want.select(*docs.columns).collect())
    calm = stage["toxicity"](spark, docs, sf_dir)
    want = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).where("toxicity_label = 0")
    assert set(calm.collect()) == set(want.select(*docs.columns).collect())
    one = stage["near_dedup"](spark, docs, sf_dir)
    kept = neardup.near_duplicates(docs).where("kept").select("doc_id")
    assert sorted(r[0] for r in one.select("doc_id").collect()) == sorted(r[0] for r in kept.collect())
    secret = docs.withColumn("text", F.when(F.col("doc_id") < 5, F.lit("é token = 'abcdef123' end")).otherwise(F.lit("nothing here")))
    clean = {r["doc_id"]: r for r in stage["secrets"](spark, secret, sf_dir).collect()}
    assert clean[0]["text"] == "é [SECRET]' end" and clean[0]["n_chars"] == len(clean[0]["text"]) and clean[7]["text"] == "nothing here"
    assert stage["secrets"](spark, docs, sf_dir).columns == docs.columns


def test_near_dedup_of_rows_without_id(spark, sf_dir):
    rows = [(1, "a b c d e f g"), (2, "A b c d e f g"), (None, "a b  c d e f g"), (None, "x y z p q r s"), (None, None), (None, "a b c d e f h i")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, sf_dir)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([rows[0], *rows[3:]], key=str)


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert rows and all(sum(n for _, n in b) <= 4096 for b in bins.values())


def odd_documents(spark):
    rows = [(1, "", "en"), (2, None, "en"), (3, "one two three four five six", "en"), (3, "one two three four five six", "en"), (4, "One two three four five  six", "en"), (None, None, "en"), (5, "word " * 20000, "en"), (6, "token = 'abcdef123'", None)]
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")


def folder(spark, tmp_path, docs, labels):
    docs.write.parquet((tmp_path / "documents.parquet").as_uri())
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet((tmp_path / "labels.parquet").as_uri())
    return tmp_path.as_uri()


def test_odd_rows_pass_all_stages(spark, tmp_path):
    """Null and empty texts, copies, a null id and a very long text; without labels nothing is rejected."""
    docs = odd_documents(spark)
    d = folder(spark, tmp_path, docs, [])
    stage = dict(corpus_pipeline.STAGES)
    for name in ("quality", "toxicity"):
        assert sorted(map(str, stage[name](spark, docs, d).collect())) == sorted(map(str, docs.collect()))
    rows = corpus_pipeline.run(spark, d).collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 3, None, 5, 6}  # 4 copies 3; empty texts copy nothing
    assert sum(r["doc_id"] == 3 for r in rows) == 1 and [r["length"] for r in rows if r["doc_id"] in (1, 2, None)] == [1, 1, 1]
    long = sorted((r["start"], r["length"]) for r in rows if r["doc_id"] == 5)
    assert [s for s, _ in long] == [4096 * k for k in range(len(long))] and sum(n for _, n in long) == 20001


def test_empty_table(spark, tmp_path):
    docs = odd_documents(spark).limit(0)
    d = folder(spark, tmp_path, docs, [(1, 1, 0), (2, 0, 1)])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, d).count() == 0, name
    assert corpus_pipeline.run(spark, d).count() == 0


def test_run_against_plain_decisions(spark, sf_dir):
    """The rows of run() from scores and components collected once, and plain code for what they mean."""
    import re

    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {r["doc_id"] for r in quality.score_quality(docs, quality.fit_quality(docs, labels)).collect() if r["quality_score"] >= 0.5}
    left = docs.where(F.col("doc_id").isin(list(good)))
    calm = {r["doc_id"] for r in toxicity.score_toxicity(left, toxicity.fit_toxicity(left, labels)).collect() if r["toxicity_score"] < 0.5}
    assert 0.7 * len(text) < len(calm) < len(good) < len(text)

    def shingled(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, lead = {i: shingled(text[i]) for i in calm}, {i: i for i in calm}

    def find(i):
        while lead[i] != i:
            i = lead[i]
        return i

    ids = sorted(calm)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                lead[max(x, y)] = min(x, y)
    kept = {i for i in calm if find(i) == i}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == kept and len(kept) < len(calm)
    whole, secret = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), re.compile(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6}|AKIA[A-Z0-9]{16}|[0-9a-f]{24}")
    plain = [i for i in kept if not secret.search(text[i]) and not re.search(r"[A-Za-z0-9+/_=-]{16}", text[i])]
    assert len(plain) > 20
    for i in plain:  # texts without anything like a secret go through as they are
        assert sum(r["length"] for r in rows if r["doc_id"] == i) == len(whole.encode(text[i], add_special_tokens=False).ids) + 1
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(bins) == -(-sum(r["length"] for r in rows) // 4096)
