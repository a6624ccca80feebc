"""Queries over scans, prefixes, texts and tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import cache, tables
from ..work import new_path
from .base import CONV_PAIRS, TEXT_PAIRS, conv_pairs, query, text_pairs, tokens_sql, uniform_sql, values

VOCABULARY, MAX_LENGTH = 30522, 32

PREFIXES = [(f"src{i}", ("search_query", "classify", "cluster", "search_query")[i % 4], ("search_document", "classify", "cluster", "passage")[i % 4], i % 4 in (1, 2)) for i in range(20)]
PREFIX_SCHEMA = "dataset string, q_prefix string, d_prefix string, is_symmetric boolean"
PREFIX_SQL = "dim as (select * from (values " + ", ".join(f"('{d}', '{q}', '{p}', {str(s).lower()})" for d, q, p, s in PREFIXES) + ") t(dataset, q_prefix, d_prefix, is_symmetric))"


@query("scan_documents", "select doc_id, lang, source, n_chars from documents")
def scan_documents(spark, d):
    return tables.read_dataset(spark, f"{d}/documents.parquet").select("doc_id", "lang", "source", "n_chars")


@query("prefix_dim", f"with {PREFIX_SQL} select * from dim")
def prefix_dim(spark, d):
    """Written as a YAML list and read back."""
    path = new_path(spark, "prefixes")
    lines = [x for name, q, p, s in PREFIXES for x in (f"- name: {name}", f"  query_prefix: {q}", f"  document_prefix: {p}", f"  is_symmetric: {str(s).lower()}")]
    spark.createDataFrame([("\n".join(lines),)], "line string").coalesce(1).write.text(path)
    return tables.read_prefixes(spark, path)


@query("text_pairs", f"with {TEXT_PAIRS} select * from tp")
def pairs(spark, d):
    return text_pairs(spark, d)


@query("conv_pairs", f"with {CONV_PAIRS} select * from cp")
def conversation_pairs(spark, d):
    return conv_pairs(spark, d)


@query("embedding_shards", "select vec_id // 100 as shard, count(*) as n, min(vec_id) as first, max(vec_id) as last from embeddings group by 1")
def embedding_shards(spark, d):
    e = tables.read_table(spark, d, "embeddings")
    return e.groupBy(tables.shard_of(F.col("vec_id"), 100).alias("shard")).agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.max("vec_id").alias("last"))


@query("cluster_export_txt", "select vec_id as idx, cast(label as varchar) as line from embeddings")
def cluster_export(spark, d):
    """Written one id a line in the order of idx, and read back by line number."""
    path = new_path(spark, "assignments")
    tables.write_assignments_text(tables.read_table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.col("label").alias("cluster")), path)
    return tables.read_assignments_text(spark, path).select("idx", F.col("cluster").cast("string").alias("line"))


@query("cache_key", """select md5('{"batch_size": "512", "column": "document", "dataset": "' || source || '"}') as cache_key, source from (select distinct source from documents)""")
def cache_key(spark, d):
    names = [r[0] for r in tables.read_table(spark, d, "documents").select("source").distinct().collect()]  # a row a dataset
    return values(spark, [(cache.cache_key(dataset=n, column="document", batch_size=512, _verbose=True), n) for n in names], "cache_key string, source string")


@query("fingerprints", "select doc_id, md5(concat_ws('__', cast(doc_id as varchar), lang, source)) as fingerprint from documents")
def fingerprints(spark, d):
    t = tables.read_table(spark, d, "documents")
    return t.select("doc_id", cache.fingerprint(F.col("doc_id").cast("string"), F.col("lang"), F.col("source")).alias("fingerprint"))


@query("subdomain_index", "select source as dataset, list_sort(list(doc_id)) as rows from documents group by 1")
def subdomain_index(spark, d):
    return text_pairs(spark, d).groupBy("dataset").agg(F.array_sort(F.collect_list("idx")).alias("rows"))


@query("subdomain_sizes", "select source as dataset, count(*) as n, cast(row_number() over (order by count(*), source) as integer) as place from documents group by 1")
def subdomain_sizes(spark, d):
    from pyspark.sql import Window

    n = text_pairs(spark, d).groupBy("dataset").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy("n", "dataset")))  # one row a dataset


@query("union_splits", "select text as query, text as document, [text] as negative, source as dataset from documents where source in ('src0', 'src1')")
def union_splits(spark, d):
    t = tables.read_table(spark, d, "documents")
    split = lambda s: t.where(F.col("source") == s).select(F.col("text").alias("query"), F.array("text").alias("pos"), F.array("text").alias("neg"))
    return tables.union_splits({s: split(s) for s in ("src0", "src1")})


@query("select_rows", "select k.pos, d.doc_id, d.n_chars from (select unnest(range(20)) as pos) k join documents d on d.doc_id = (k.pos * 37) % 200")
def select_rows(spark, d):
    wanted = spark.range(20).select(F.col("id").alias("pos"), (F.col("id") * 37 % 200).alias("doc_id"))
    return tables.read_table(spark, d, "documents").join(F.broadcast(wanted), "doc_id").select("pos", "doc_id", "n_chars")


@query("range_slice", "select doc_id, source from documents where doc_id between 50 and 149")
def range_slice(spark, d):
    return tables.read_table(spark, d, "documents").where("doc_id between 50 and 149").select("doc_id", "source")


@query("filter_subdomain", "select doc_id, n_chars from documents where source = 'src3'")
def filter_subdomain(spark, d):
    return tables.read_table(spark, d, "documents").where("source = 'src3'").select("doc_id", "n_chars")


@query("prefix_short", f"with {TEXT_PAIRS}, {PREFIX_SQL} select idx, q_prefix || ': ' || query as query, d_prefix || ': ' || document as document from tp join dim using (dataset)")
def prefix_short(spark, d):
    p = text_pairs(spark, d).join(F.broadcast(values(spark, PREFIXES, PREFIX_SCHEMA)), "dataset")
    return p.select("idx", T.prefixed_short(F.col("q_prefix"), F.col("query")).alias("query"), T.prefixed_short(F.col("d_prefix"), F.col("document")).alias("document"))


@query("prefix_long", f"with {TEXT_PAIRS}, {PREFIX_SQL} select idx, q_prefix || '<s> ' || query as query, case when is_symmetric then q_prefix || '<s> ' || document else document end as document from tp join dim using (dataset)")
def prefix_long(spark, d):
    p = text_pairs(spark, d).join(F.broadcast(values(spark, PREFIXES, PREFIX_SCHEMA)), "dataset")
    doc = F.when(F.col("is_symmetric"), T.prefixed_long(F.col("q_prefix"), "<s>", F.col("document"))).otherwise(F.col("document"))
    return p.select("idx", T.prefixed_long(F.col("q_prefix"), "<s>", F.col("query")).alias("query"), doc.alias("document"))


@query("prefix_fixed", f"with {TEXT_PAIRS} select idx, 'search_query: ' || query as query, 'search_document: ' || document as document from tp")
def prefix_fixed(spark, d):
    return text_pairs(spark, d).select("idx", F.concat(F.lit("search_query: "), "query").alias("query"), F.concat(F.lit("search_document: "), "document").alias("document"))


RENAMES = {"src0": "web", "src1": "news", "src2": "forum"}


@query("remap_dataset", "select doc_id, case source when 'src0' then 'web' when 'src1' then 'news' when 'src2' then 'forum' else source end as dataset from documents")
def remap_dataset(spark, d):
    names = F.create_map(*[F.lit(x) for kv in RENAMES.items() for x in kv])
    return tables.read_table(spark, d, "documents").select("doc_id", F.coalesce(F.try_element_at(names, F.col("source")), F.col("source")).alias("dataset"))


@query("truncate_chars", "select doc_id, substr(text, 1, 128) as text from documents")
def truncate_chars(spark, d):
    return tables.read_table(spark, d, "documents").select("doc_id", T.truncate_chars(F.col("text"), MAX_LENGTH).alias("text"))


@query("empty_fix", f"with {TEXT_PAIRS} select idx, case when length(coalesce(query, '')) = 0 then '[empty]' else query end as query from tp")
def empty_fix(spark, d):
    return text_pairs(spark, d).select("idx", T.fix_empty(F.col("query")).alias("query"))


@query("tokenize_words", f"select doc_id, {tokens_sql('text', VOCABULARY, MAX_LENGTH)} as input_ids, cast(len({tokens_sql('text', VOCABULARY, MAX_LENGTH)}) as integer) as length from documents")
def tokenize_words(spark, d):
    t = tables.read_table(spark, d, "documents").select("doc_id", T.token_ids(F.col("text"), VOCABULARY, MAX_LENGTH).alias("input_ids"))
    return t.select("doc_id", "input_ids", F.size("input_ids").alias("length"))


@query("vocab_hash", r"with w as (select distinct unnest(regexp_extract_all(lower(text), '([\p{L}\p{N}]+)', 1)) as w from benchmark) select md5(string_agg(w, '' order by w)) as vocabulary from w")
def vocab_hash(spark, d):
    w = tables.read_table(spark, d, "benchmark").select(F.explode(T.words(F.col("text"))).alias("w")).distinct()
    return w.agg(F.md5(F.array_join(F.array_sort(F.collect_list("w")), "")).alias("vocabulary"))


@query("pad_tokens", f"with t as (select doc_id, {tokens_sql('text', VOCABULARY, 24)} as ids from documents) select doc_id, list_concat(ids, list_transform(range(32 - len(ids)), lambda i: cast(0 as bigint))) as input_ids, list_transform(range(32), lambda i: cast(case when i < len(ids) then 1 else 0 end as integer)) as mask from t")
def pad_tokens(spark, d):
    t = tables.read_table(spark, d, "documents").select("doc_id", T.token_ids(F.col("text"), VOCABULARY, 24).alias("ids"))
    return t.select("doc_id", T.pad(F.col("ids"), MAX_LENGTH).alias("input_ids"), T.attention_mask(F.col("ids"), MAX_LENGTH).alias("mask"))


@query(
    "independent_crop",
    f"with t as (select doc_id, {tokens_sql('text', VOCABULARY, MAX_LENGTH)} as ids from documents), s as (select doc_id, ids, len(ids) as n, greatest(1, len(ids) // 2) as l from t where len(ids) >= 4) "
    f"select doc_id, ids[1 + cast(floor({uniform_sql(chr(39) + 'crop1' + chr(39), 'cast(doc_id as varchar)')} * (n - l)) as bigint) + 1 : 1 + cast(floor({uniform_sql(chr(39) + 'crop1' + chr(39), 'cast(doc_id as varchar)')} * (n - l)) as bigint) + l] as crop1, "
    f"ids[1 + cast(floor({uniform_sql(chr(39) + 'crop2' + chr(39), 'cast(doc_id as varchar)')} * (n - l)) as bigint) + 1 : 1 + cast(floor({uniform_sql(chr(39) + 'crop2' + chr(39), 'cast(doc_id as varchar)')} * (n - l)) as bigint) + l] as crop2 from s",
)
def independent_crop(spark, d):
    """Two crops of half the tokens, each from position 1 on, at hash-drawn starts."""
    t = tables.read_table(spark, d, "documents").select("doc_id", T.token_ids(F.col("text"), VOCABULARY, MAX_LENGTH).alias("ids"))
    t = t.withColumn("n", F.size("ids")).where("n >= 4").withColumn("l", F.greatest(F.lit(1), F.floor(F.col("n") / 2).cast("int")))
    crop = lambda k: F.slice("ids", F.floor(T.uniform(k, F.col("doc_id")) * (F.col("n") - F.col("l"))).cast("int") + 2, F.col("l")).alias(k)
    return t.select("doc_id", crop("crop1"), crop("crop2"))


@query(
    "mlm_mask",
    f"with t as (select doc_id, unnest({tokens_sql('text', VOCABULARY, MAX_LENGTH)}) as id, generate_subscripts({tokens_sql('text', VOCABULARY, MAX_LENGTH)}, 1) - 1 as pos from documents), "
    f"u as (select *, {uniform_sql(chr(39) + 'mlm' + chr(39), 'cast(doc_id as varchar)', 'cast(pos as varchar)')} as u, {uniform_sql(chr(39) + 'how' + chr(39), 'cast(doc_id as varchar)', 'cast(pos as varchar)')} as h from t) "
    f"select doc_id, cast(pos as integer) as pos, case when u >= 0.3 then id when h < 0.8 then 103 when h < 0.9 then cast(floor((h - 0.8) * 10 * {VOCABULARY}) as bigint) else id end as input_id, case when u < 0.3 then id else -100 end as label from u",
)
def mlm_mask(spark, d):
    """Masking for language modelling: 30 % of the tokens; of these 80 % become the mask, 10 % another token, 10 % stay."""
    t = tables.read_table(spark, d, "documents").select("doc_id", F.posexplode(T.token_ids(F.col("text"), VOCABULARY, MAX_LENGTH)).alias("pos", "id"))
    u, h = T.uniform("mlm", F.col("doc_id"), F.col("pos")), T.uniform("how", F.col("doc_id"), F.col("pos"))
    drawn = F.when(u >= 0.3, F.col("id")).when(h < 0.8, F.lit(103)).when(h < 0.9, F.floor((h - 0.8) * 10 * VOCABULARY)).otherwise(F.col("id"))
    return t.select("doc_id", "pos", drawn.cast("long").alias("input_id"), F.when(u < 0.3, F.col("id")).otherwise(F.lit(-100)).cast("long").alias("label"))


@query("collapse_tokens", "select doc_id, regexp_replace('<s><s> ' || replace(coalesce(text, ''), '. ', '.<s><s> ') || '<s><s><s>', '(<s>)+', '<s>', 'g') as text from documents")
def collapse_tokens(spark, d):
    t = tables.read_table(spark, d, "documents")
    marked = F.replace(T.text_or_empty(F.col("text")), F.lit(". "), F.lit(".<s><s> "))  # repeats at both ends and within
    return t.select("doc_id", T.collapse_repeats(F.concat(F.lit("<s><s> "), marked, F.lit("<s><s><s>")), "<s>").alias("text"))


@query("preview", "select doc_id, case when length(text) > 200 then substr(text, 1, 200) || '...' else text end as preview from documents")
def preview(spark, d):
    return tables.read_table(spark, d, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


@query("corpus_text", "select doc_id, trim(source || ' ' || text, ' ') as text from documents")
def corpus_text(spark, d):
    return tables.read_table(spark, d, "documents").select("doc_id", T.corpus_text(F.col("source"), F.col("text")).alias("text"))


@query("strip_extension", r"select page_id, regexp_replace(regexp_extract(url, '([^/?#]*)([?#].*)?$', 1), '\.[^.]*$', '') as name, regexp_replace(url, '[^A-Za-z0-9_.-]', '_', 'g') as safe from pages")
def strip_extension(spark, d):
    p = tables.read_table(spark, d, "pages")
    return p.select("page_id", F.regexp_replace(F.regexp_extract("url", r"([^/?#]*)([?#].*)?$", 1), r"\.[^.]*$", "").alias("name"), F.regexp_replace("url", "[^A-Za-z0-9_.-]", "_").alias("safe"))


@query("text_column", "select item_id, text from benchmark")
def resolve_text(spark, d):
    """The text column by precedence; here `text`, beside the key."""
    b = tables.read_table(spark, d, "benchmark")
    return b.select("item_id", F.col(tables.text_column(b).columns[0]))
