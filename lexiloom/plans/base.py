"""Registration of queries and the fixtures they share, as DataFrames and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with the SQL that gives the same rows."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, query, document, dataset): a document with its first sentence as query."""
    d = read_table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("idx"), F.regexp_extract("text", r"^([^.\n]*)", 1).alias("query"), F.col("text").alias("document"), F.col("source").alias("dataset"))


TEXT_PAIRS = r"tp as (select doc_id as idx, regexp_extract(text, '^([^.\n]*)', 1) as query, text as document, source as dataset from documents)"


def conv_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, query, document): a user turn and the answer after it."""
    c = read_table(spark, sf_dir, "conversations")
    ask = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    answer = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("document"))
    return ask.join(answer, ["conv_id", "turn"])


CONV_PAIRS = "cp as (select a.conv_id, a.turn, a.text as query, b.text as document from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1 where a.role = 'user' and b.role = 'assistant')"


def vec_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, q, x, domain): vectors 2i and 2i + 1, and the label of the first."""
    e = read_table(spark, sf_dir, "embeddings")
    i = F.floor(F.col("vec_id") / 2).cast("long").alias("i")
    q = e.where("vec_id % 2 = 0").select(i, F.col("embedding").alias("q"), F.col("label").alias("domain"))
    x = e.where("vec_id % 2 = 1").select(i, F.col("embedding").alias("x"))
    return q.join(x, "i").select("i", "q", "x", "domain")


VEC_PAIRS = "vp as (select a.vec_id // 2 as i, cast(a.embedding as double[]) as q, cast(b.embedding as double[]) as x, a.label as domain from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 where a.vec_id % 2 = 0)"


def uniform_sql(*keys: str) -> str:
    """`functions.text.uniform` in SQL."""
    return f"(cast(('0x' || substr(md5(concat_ws('|', {', '.join(keys)})), 1, 8)) as bigint) / 4294967296.0)"


def tokens_sql(text: str, vocabulary: int, length: int) -> str:
    """`functions.text.token_ids` in SQL."""
    words = rf"regexp_extract_all(lower(coalesce({text}, '')), '([\p{{L}}\p{{N}}]+)', 1)"
    return f"list_transform(({words})[1:{length}], lambda w: cast(('0x' || substr(md5(w), 1, 8)) as bigint) % {vocabulary - 1} + 1)"


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def shorten(c, digits: int = 6):
    """Doubles are compared to `digits` places; zero has one sign."""
    return F.round(c, digits) + F.lit(0.0)


T = T  # the text functions, for the query modules
