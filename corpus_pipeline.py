"""The curation pipeline over `documents`, in five stages; each works on all that the one before kept.

1. quality: the compression classifier, learned from `labels.quality`; rejected documents go.
2. toxicity: nearest labelled examples, learned from `labels.toxic`; rejected documents go.
   Neither rejects anything where the labels of a class are missing.
3. near_dedup: MinHash near-duplicates of five-word shingles and a similarity of 0.8 or more; the smallest doc_id of each group stays, and rows without a doc_id that copy none.
4. secrets: what the secret scan finds is replaced by a mark in the text.
5. packing: documents are tokenized and packed into sequences of at most 4096 tokens.

Stages 1 to 4 return the columns of `documents`; n_chars follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import neardup, packing, quality, secrets, toxicity
from lexiloom.llm.common import materialize, release, table
from lexiloom.llm.queries import SEQUENCE_TOKENS, tokenizer_file

ORACLE_SQL = None  # classifiers and tokenizers are beyond SQL; tests hold the stages against plain versions


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    if not model.fitted:
        return docs
    return quality.score_quality(docs, model).where("quality_label = 1").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    if not model.fitted:
        return docs
    return toxicity.score_toxicity(docs, model).where("toxicity_label = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(docs.select("doc_id", "text"), with_key=True)
    kept = found.where("kept and doc_id is not null").select("doc_id").distinct()
    whole = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    copies = found.where("doc_id is null and not kept").select("set_key").distinct()  # a row without an id is known by its set
    nameless = neardup.with_set_key(docs.where("doc_id is null")).join(copies, "set_key", "left_anti")
    return whole.select(*docs.columns).unionByName(nameless.select(*docs.columns))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(docs, secrets.fit_markov(docs))
    hit = found.select(*docs.columns, "secret_spans", (F.size("secret_spans") > 0).alias("_hit"))
    clean = secrets.redact(hit)
    return clean.withColumn("n_chars", F.when(F.col("_hit"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize_pieces(docs, tokenizer_path=tokenizer_file("word_bpe_49k.json"), end_id=1, capacity=SEQUENCE_TOKENS)
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digests, capacity=SEQUENCE_TOKENS)


STAGES = [("quality", keep_good), ("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("secrets", mask_secrets), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        release(before)
    return docs
