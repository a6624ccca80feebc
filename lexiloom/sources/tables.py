"""Scans and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

PAIR = S.StructType([S.StructField("idx", S.LongType()), S.StructField("query", S.StringType()), S.StructField("document", S.StringType()), S.StructField("dataset", S.StringType())])
TRIPLET = S.StructType([*PAIR.fields, S.StructField("negative", S.ArrayType(S.StringType()))])
_SCORED = S.ArrayType(S.StructType([S.StructField("pid", S.StringType()), S.StructField("ce-score", S.DoubleType())]))
MINED = S.StructType([S.StructField("qid", S.StringType()), S.StructField("pos", _SCORED), S.StructField("neg", S.MapType(S.StringType(), _SCORED))])
QRELS = S.StructType([S.StructField("query-id", S.StringType()), S.StructField("corpus-id", S.StringType()), S.StructField("score", S.IntegerType())])


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A dataset folder of Parquet shards; rows have no order, so an `idx` column identifies them."""
    return spark.read.parquet(path)


def read_mined(spark: SparkSession, path: str) -> DataFrame:
    """Mined negatives as JSON lines, plain or gzip; the order of systems is that of the names in `neg`."""
    return spark.read.schema(MINED).json(path)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Relevance judgements as JSON lines; ids become strings."""
    q = spark.read.schema(QRELS).json(path)
    return q.select(F.col("query-id").alias("qid"), F.col("corpus-id").alias("did"), F.col("score").alias("rel"))


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of result files, one JSON document a task: (task, content)."""
    raw = spark.read.text(folder, wholetext=True)
    return raw.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("task"), F.col("value").alias("content"))


def read_prefixes(spark: SparkSession, path: str) -> DataFrame:
    """A YAML list of dataset entries as a small dimension table."""
    import yaml

    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    rows = [(e["name"], e.get("query_prefix"), e.get("document_prefix"), bool(e.get("is_symmetric", False))) for e in yaml.safe_load(text)]
    return spark.createDataFrame(rows, "dataset string, q_prefix string, d_prefix string, is_symmetric boolean")


def write_embeddings(df: DataFrame, path: str, rows_per_file: int = 2_000_000) -> None:
    """Parquet shards of at most `rows_per_file` rows; the commit marker is the writer's own _SUCCESS file."""
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)


def shard_of(idx: Column, rows_per_shard: int) -> Column:
    return F.floor(idx / rows_per_shard).cast("long")


def write_assignments_text(df: DataFrame, path: str, idx: str = "idx", cluster: str = "cluster") -> None:
    """One cluster id a line in the order of idx; ranges are sorted apart and written in order, without one big sort task."""
    df.select(idx, F.col(cluster).cast("string").alias("line")).orderBy(idx).select("line").write.text(path)


def read_assignments_text(spark: SparkSession, path: str) -> DataFrame:
    """(idx, cluster) of one cluster id a line: idx is the number of the line, files in the order of their names.

    A file is read in one task, so it should be a range of rows, as `write_assignments_text` makes them.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("_file"), F.split(F.rtrim(F.col("value"), F.lit("\n")), "\n").alias("_lines"))
    sizes = files.select("_file", F.size("_lines").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a file
    starts = sizes.select("_file", before.alias("_start"))
    lines = files.select("_file", F.posexplode("_lines").alias("_at", "line")).join(starts, "_file")
    return lines.select((F.col("_start") + F.col("_at")).cast("long").alias("idx"), F.col("line").cast("int").alias("cluster"))


def write_order_text(order: DataFrame, path: str, position: str = "position", value: str = "cluster") -> None:
    """One value a line in the order of `position`: a tour over clusters, a row a cluster."""
    write_assignments_text(order, path, position, value)


def read_order_text(spark: SparkSession, path: str) -> DataFrame:
    """(position, cluster) of `write_order_text`."""
    return read_assignments_text(spark, path).withColumnRenamed("idx", "position")


def text_column(df: DataFrame) -> DataFrame:
    """The one text column of an evaluation set: (sentence1, sentence2) joined, else sentences, text, or positive; lists are flattened."""
    names = set(df.columns)
    if {"sentence1", "sentence2"} <= names:
        col = F.concat_ws(" ", "sentence1", "sentence2")
    elif "sentences" in names:
        col = F.col("sentences")
    elif "text" in names:
        col = F.col("text")
    elif {"query", "positive"} <= names:
        col = F.col("positive")
    else:
        raise ValueError(f"no text column among {sorted(names)}")
    out = df.select(col.alias("text"))
    return out.select(F.explode("text").alias("text")) if isinstance(out.schema["text"].dataType, S.ArrayType) else out


def union_splits(splits: dict[str, DataFrame]) -> DataFrame:
    """Splits of (query, pos, neg) as one table (query, document, negative, dataset)."""
    out = None
    for name, df in splits.items():
        part = df.select("query", F.try_element_at("pos", F.lit(1)).alias("document"), F.col("neg").alias("negative"), F.lit(name).alias("dataset"))
        out = part if out is None else out.unionByName(part)
    return out


def convert_assignments(spark: SparkSession, source: str, target: str) -> bool:
    """Write an assignment table (idx, cluster) as one id a line; False if the target is there already."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
    if path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return False
    write_assignments_text(spark.read.parquet(source), target)
    return True
