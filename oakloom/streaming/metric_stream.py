"""The metric log as a stream: running aggregates, latest values, late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oakloom.operators.metrics import delivered_once, finite

LOG = "run string, key string, value double, step bigint, seq bigint"


def metric_stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """Rows of a folder of Parquet files that grows."""
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_means(stream: DataFrame) -> DataFrame:
    """(run, key, n, mean, lowest) so far; for complete or update mode."""
    return stream.groupBy("run", "key").agg(F.count(F.lit(1)).alias("n"), F.avg(finite("value")).alias("mean"), F.min(finite("value")).alias("lowest"))


def event_windows(stream: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour", by: str = "event_type") -> DataFrame:
    """(window_start, by, n, total) of tumbling windows; a window is given out once the watermark has passed it, rows later than that are dropped."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), by, "n", "total")


def keep_latest(stream: DataFrame, path: str, checkpoint: str):
    """Starts a query that merges each batch into a table of the last row of each run, key and step; a batch that comes again changes nothing.

    Each batch writes the table's next version, so the table it reads is never the one it writes, and deletes the one before that, which no batch can need again. Returns the started query.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        before = f"{path}/version={number - 1}"
        rows = batch.select("run", "key", "value", "step", "seq")
        if number:
            rows = spark.read.parquet(before).select(*rows.columns).unionByName(rows)
        delivered_once(rows).write.mode("overwrite").parquet(f"{path}/version={number}")
        if number > 1:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={number - 2}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
