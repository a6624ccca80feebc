"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary, htmltext, neardup, packing, quality, secrets, sentencepieces, topk, toxicity, vectordup
from .common import fold, new_path, table

SEQUENCE_TOKENS = 4096


def tokenizer_file(name: str) -> str:
    """Where the installed package of public tokenizers keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    out = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.col("toxicity_score").alias("score"), F.col("toxicity_label").alias("predicted"), F.to_json("toxicity_evidence").alias("evidence"))


def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectordup.vector_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1)
    out = quality.score_quality(docs, quality.fit_quality(docs, labels))
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_label").alias("predicted"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.integer_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return topk.top_k(rows.where("vec_id % 100 = 0"), rows, k=10)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether decoding them gives the text back."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file("piece_bpe_32k.model")
    out = sentencepieces.decode(sentencepieces.encode(docs, model_path=path), model_path=path)
    back = F.col("piece_text") == F.coalesce("text", F.lit(""))
    return out.select("doc_id", (F.octet_length("piece_ids") / 4).cast("long").alias("n_ids"), F.crc32("piece_ids").alias("ids_crc32"), back.alias("round_trip"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), numerator=85, denominator=100)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = secrets.find_secrets(docs, secrets.fit_markov(docs)).select("doc_id", "secret_spans")
    spans = F.col("secret_spans")
    base = F.filter(spans, lambda s: s["kind"] != "markov")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(secrets.span_text(base).cast("binary"), 256).alias("base_sha256"), secrets.span_text(spans).alias("spans"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.tokenize_pieces(docs, tokenizer_path=tokenizer_file("word_bpe_49k.json"), end_id=1, capacity=SEQUENCE_TOKENS)
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digests, capacity=SEQUENCE_TOKENS)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = htmltext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = new_path(spark, "token-file")
    binary.write_tokens(docs, path, tokenizer_path=tokenizer_file("byte_bpe_50k.json"), end_id=2)
    return binary.read_tokens(spark, path, digest=True)


QUERIES = {"op1_toxicity": op1_toxicity, "op2_topk": op2_topk, "op3_sentencepiece": op3_sentencepiece, "op4_near_dedup": op4_near_dedup, "op5_secrets": op5_secrets, "op6_packing": op6_packing, "op7_html_text": op7_html_text, "op8_token_file": op8_token_file, "op9_vector_dedup": op9_vector_dedup, "op10_quality": op10_quality}

OP4_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] else list_distinct(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i : i + 4], ' '))) end as s from words
), items as (
  select doc_id, len(s) as n, unnest(s) as g from sets
), shared as (
  select a.doc_id as u, b.doc_id as v, any_value(a.n) + any_value(b.n) - count(*) as either, count(*) as both_
  from items a join items b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2
), links as (
  select u, v from shared where 100 * both_ >= 85 * either
), reach as (
  select doc_id as node, doc_id as other from sets
  union
  select r.node, l.v as other from reach r join links l on r.other = l.u
), least as (
  select node, min(other) as component_id from reach group by 1
)
select doc_id, cast(len(s) as bigint) as n_shingles, component_id, doc_id = component_id as kept from sets join least on doc_id = node
"""

OP2_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as e from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from s qualify rank <= 10
"""

OP9_SQL = """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as u, b.vec_id as v from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.98
), reach as (
  select vec_id as node, vec_id as other from embeddings
  union
  select r.node, l.v from reach r join links l on r.other = l.u
)
select vec_id, (select count(*) from links where u = vec_id) as n_links, component_id, vec_id = component_id as kept
from embeddings join (select node, min(other) as component_id from reach group by 1) on node = vec_id
"""

ORACLES: dict[str, str] = {"op2_topk": OP2_SQL, "op4_near_dedup": OP4_SQL, "op9_vector_dedup": OP9_SQL}
