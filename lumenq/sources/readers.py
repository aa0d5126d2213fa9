"""Readers: CSV, JSON documents, JSON lines (plain or gzip), Parquet, logs and prediction files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Longest field of a CSV file.
FIELD_CHARS = 1 << 24

LOG = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("ts", T.DoubleType()),
        T.StructField("caller", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("questions", T.StringType()),
        T.StructField("answers", T.StringType()),
        T.StructField("served_by", T.StringType()),
        T.StructField("shadow", T.StringType()),
        T.StructField("outcomes", T.StringType()),
    ]
)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return bool(found)


def read_csv(spark: SparkSession, paths: list[str], columns: list[str] | None = None, line_sep: str | None = None) -> DataFrame:
    """Rows of CSV files with a header, all text, quoted line breaks allowed; ``file_no`` keeps the files' order.

    With ``line_sep`` only that ends a row and carriage returns in fields stay; else it is detected.
    """
    parts = []
    for k, path in enumerate(paths):
        rows = spark.read.csv(path, header=True, multiLine=True, escape='"', maxCharsPerColumn=FIELD_CHARS, encoding="UTF-8", lineSep=line_sep)
        parts.append((rows.select(columns) if columns else rows).withColumn("file_no", F.lit(k)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines, gzip or not; blank lines are skipped."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.json(path)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.select(columns) if columns else rows


def read_any(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """By suffix: ``.parquet``; ``.csv`` or none; anything else is JSON lines."""
    if path.endswith(".parquet"):
        return read_parquet(spark, path, columns)
    name = path.rsplit("/", 1)[-1]
    rows = read_csv(spark, [path]).drop("file_no") if name.endswith(".csv") or "." not in name else read_jsonl(spark, path)
    return rows.select(columns) if columns else rows


def read_domains(spark: SparkSession, data_path: str, domains_path: str, split: str = "test") -> DataFrame:
    """Two JSON documents: [text, intent] pairs by split, and intents by domain; one row per pair with its domain."""
    data = spark.read.schema(f"`{split}` array<array<string>>").json(data_path, multiLine=True)
    pairs = data.select(F.explode(split).alias("x")).select(F.col("x")[0].alias("text"), F.col("x")[1].alias("intent"))
    wide = spark.read.text(domains_path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    lookup = wide.select(F.explode("m").alias("domain", "intents")).select(F.replace("domain", F.lit("_"), F.lit(" ")).alias("domain"), F.explode("intents").alias("i__"))
    return pairs.join(lookup, F.col("intent") == F.col("i__")).drop("i__")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log's lines with ``log_pos``, their number in the order of appends, files and lines; no file gives an empty log.

    The lines of each file block are counted, blocks are put in order (one row a block, so a
    small sort), and a line's number is that of its block's first line and its place in the
    block. However files are packed into tasks, a later append has larger numbers. Fields that
    are JSON stay JSON text.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType([T.StructField("log_pos", T.LongType()), *LOG.fields]))
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    placed = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("at"))
    blocks = placed.groupBy("file", "begin").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "begin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(F.col("file").alias("f__"), F.col("begin").alias("b__"), "first", before.alias("before"))
    numbered = placed.join(blocks, (F.col("file") == F.col("f__")) & (F.col("begin") == F.col("b__"))).where(F.trim("value") != "")
    return numbered.select((F.col("before") + F.col("at") - F.col("first")).alias("log_pos"), F.from_json("value", LOG).alias("r")).select("log_pos", "r.*")


def stream_log(spark: SparkSession, path: str) -> DataFrame:
    """The log as a stream of lines, in order of arrival."""
    return spark.readStream.option("recursiveFileLookup", "true").text(path).where(F.trim("value") != "").select(F.from_json("value", LOG).alias("r")).select("r.*")


def read_predictions(spark: SparkSession, train: str, test: str, labels: list[str] | None = None) -> DataFrame:
    """Both halves of a prediction file, train first: ``half``, ``task``, ``p`` aligned to the labels, ``y``.

    Without ``labels`` each line has its task's.
    """
    schema = "task string, probabilities map<string,double>, label string, labels array<string>"
    halves = [read_jsonl(spark, path, schema).withColumn("half", F.lit(k)) for k, path in enumerate((train, test))]
    wanted: Column = F.col("labels") if labels is None else F.array(*map(F.lit, labels))
    rows = halves[0].unionByName(halves[1])
    return rows.select("half", "task", F.transform(wanted, lambda o: F.try_element_at("probabilities", o)).alias("p"), (F.array_position(wanted, F.col("label")) - 1).cast("int").alias("y"))


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at ``path``; made and written first if it isn't there."""
    if not exists(spark, path):
        make().write.parquet(path)
    return spark.read.parquet(path)
