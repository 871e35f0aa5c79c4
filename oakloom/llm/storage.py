"""Tables that cut a plan's lineage and outlive a lost executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []
_left: dict[str, object] = {}


@atexit.register
def _tidy() -> None:
    for path, context in list(_left.items()):
        _delete(path, context)
    for path in _own:
        shutil.rmtree(path, ignore_errors=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a temporary folder in local mode, and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="oakloom-"))
    return "file://" + _own[0]


def _delete(path: str, context) -> None:
    """Deletes a table on its own file system."""
    try:
        target = context._gateway.jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the driver's JVM may be gone already
        pass
    _left.pop(path, None)


def written(df: DataFrame, name: str, dictionary: int | None = None) -> DataFrame:
    """The rows of ``df``, written once as a table in the shared folder and read back. ``dictionary``: bytes of a column's dictionary of values.

    The table lies there until it is ``dropped``, or, where a result still reads it, until the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/oakloom-{name}-{uuid.uuid4().hex}"
    _left[path] = spark.sparkContext
    (df.write.option("parquet.dictionary.page.size", dictionary) if dictionary else df.write).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_to = path
    return back


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        _delete(df._written_to, df.sparkSession.sparkContext)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_enough(df: DataFrame, column: str, rows: int, size: int) -> bool:
    """Whether a table is proven small: at most ``rows`` rows and ``size`` code points in ``column``."""
    n, chars = df.agg(F.count("*"), F.coalesce(F.sum(F.length(column).cast("bigint")), F.lit(0))).first()
    return n <= rows and chars <= size
