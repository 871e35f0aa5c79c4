"""Scans of texts, JSONL records and checkpoints. Order is an explicit column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oakloom.operators.corpus import explode_lines

RECORD = "prompt string, response string"


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row per file; of a folder its .txt files, not those below. ``path`` gives the order.

    Bytes that aren't UTF-8 are an error when the row is read, as they are in strict decoding.
    """
    files = spark.read.format("binaryFile").load(path) if path.endswith(".txt") else spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "false").load(path)
    return files.select(F.col("path"), F.decode("content", "UTF-8").alias("text"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line): the lines of these files by the rule of splitlines; order by path and line_no."""
    return explode_lines(text_files(spark, path), "path")


def jsonl_records(spark: SparkSession, path: str) -> DataFrame:
    """(prompt, response) of a JSONL file: blank lines are skipped, broken ones are an error, further keys are ignored.

    A record without one of the keys, or with null there, is an error when the row is read.
    """
    rows = spark.read.schema(RECORD).option("mode", "FAILFAST").json(path)
    return rows.select(*(F.coalesce(c, F.raise_error(F.lit(f"record without {c}")).cast("string")).alias(c) for c in ("prompt", "response")))


def parsed_records(lines: DataFrame, line: str = "line") -> DataFrame:
    """Other columns with (prompt, response) of a column of JSON lines; both null where a line is no object."""
    parsed = F.from_json(F.col(line), RECORD, {"mode": "PERMISSIVE"})
    return lines.withColumn("prompt", parsed["prompt"]).withColumn("response", parsed["response"])


def checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """Checkpoint rows (filename, global_step, best_eval_loss); a missing step is 0, a missing best infinite."""
    rows = spark.read.parquet(path)
    for column, kind, default in (("global_step", "bigint", 0), ("best_eval_loss", "double", float("inf"))):
        if column not in rows.columns:
            rows = rows.withColumn(column, F.lit(None).cast(kind))
        rows = rows.withColumn(column, F.coalesce(F.col(column).cast(kind), F.lit(default).cast(kind)))
    return rows


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def relational(spark: SparkSession, url: str, name: str, split_by: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 64, **options: str) -> DataFrame:
    """A table of a database by JDBC; its driver must be on the class path.

    With ``split_by``, a whole-number column, and its ``bounds``, the rows are read in that many parts by as many connections; without, by one.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if split_by:
        if bounds is None:
            lo, hi = spark.read.format("jdbc").options(url=url, query=f"SELECT min({split_by}) AS lo, max({split_by}) AS hi FROM {name}", **options).load().first()
            bounds = (int(lo or 0), int(hi or 0))
        reader = reader.options(partitionColumn=split_by, lowerBound=str(bounds[0]), upperBound=str(bounds[1] + 1), numPartitions=str(parts))
    return reader.load()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on its own file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def existing(paths: DataFrame, column: str) -> DataFrame:
    """The rows whose path is there; each distinct folder is listed once, by the driver."""
    spark = paths.sparkSession
    folder = F.regexp_extract(column, "^(.*)/[^/]*$", 1)
    listed = [f"{r[0]}/*" for r in paths.select(folder).where(F.col(column).isNotNull()).distinct().toLocalIterator() if exists(spark, r[0])]
    if not listed:
        return paths.limit(0)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(listed).select(F.regexp_replace("path", "^file:/+", "/").alias("_path"))
    return paths.join(found, F.regexp_replace(column, "^file:/+", "/") == F.col("_path"), "left_semi")
