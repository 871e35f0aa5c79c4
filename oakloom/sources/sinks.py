"""Sinks: text, appended rows, run logs, staged tables."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oakloom.operators.registry import next_ids, with_parent, without_parent


def write_text(lines: DataFrame, path: str, order: list[str], one_file: bool = False) -> None:
    """Lines in order, replacing what is there; parts follow each other by name. ``one_file`` gives one part, for what one task can write."""
    ordered = lines.repartition(1).sortWithinPartitions(*order) if one_file else lines.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select("line").write.mode("overwrite").text(path)


def join_parts(spark: SparkSession, folder: str, target: str) -> None:
    """The parts of a text folder as one file, by name, without the last line's end: the bytes go from file to file, not through the driver's memory."""
    files, _ = _files(spark, target)
    staged = _path(spark, f"{target}_staged_{uuid.uuid4().hex}")
    parts = sorted((s.getPath() for s in files.listStatus(_path(spark, folder)) if s.getPath().getName().startswith("part-") and s.getLen()), key=lambda p: p.getName())
    out = files.create(staged, True)
    try:
        for k, part in enumerate(parts):
            source = files.open(part)
            size = files.getFileStatus(part).getLen() - (k == len(parts) - 1)
            try:
                spark._jvm.org.apache.commons.io.IOUtils.copyLarge(source, out, 0, size)
            finally:
                source.close()
    finally:
        out.close()
    _move(files, staged, _path(spark, target))


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    conf = spark._jsc.hadoopConfiguration()
    return _path(spark, path).getFileSystem(conf), conf


def _move(files, staged, target) -> None:
    """Puts what is staged in the target's place. File systems tell a failed rename by its result; what stood there before is put back then."""
    old = None
    if files.exists(target):
        old = target.suffix(f"_old_{uuid.uuid4().hex}")
        if not files.rename(target, old):
            raise OSError(f"{target} could not be moved aside")
    if not files.rename(staged, target):
        if old is not None and not files.rename(old, target):
            raise OSError(f"{target} could not be replaced; what it held is in {old}")
        raise OSError(f"{staged} could not be moved to {target}")
    if old is not None:
        files.delete(old, True)


def insert(rows: DataFrame, path: str, order: str, ties: tuple[str, ...] = (), defaults: dict[str, object] | None = None) -> DataFrame:
    """Appends rows with ids after the largest one there, missing columns by default, and returns them. One writer at a time."""
    spark = rows.sparkSession
    existing = spark.read.parquet(path)
    for column, value in (defaults or {}).items():
        given = F.col(column) if column in rows.columns else F.lit(None)
        rows = rows.withColumn(column, F.coalesce(given, value if hasattr(value, "_jc") else F.lit(value)))
    fields = [f for f in existing.schema if f.name != "id"]
    extra = [] if order in existing.columns else [order]
    known = rows.select(*extra, *(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields))
    new = next_ids(known, existing, order, ties).select(*existing.columns)
    staged = f"{path.rstrip('/')}_staged_{uuid.uuid4().hex}"
    new.write.parquet(staged)
    added = spark.read.schema(existing.schema).parquet(staged)
    added.write.mode("append").parquet(path)
    return added


def insert_children(rows: DataFrame, parents: DataFrame, foreign: str, path: str, order: str, ties: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(added, refused): appends the rows whose parent exists."""
    return insert(with_parent(rows, parents, foreign), path, order, ties), without_parent(rows, parents, foreign)


def replace_table(rows: DataFrame, path: str) -> None:
    """Writes beside the table and then puts the new one in its place, so that readers never meet half of it; a failed move puts the old one back."""
    staged = f"{path.rstrip('/')}_staged_{uuid.uuid4().hex}"
    rows.write.parquet(staged)
    files, _ = _files(rows.sparkSession, path)
    _move(files, _path(rows.sparkSession, staged), _path(rows.sparkSession, path))


def param_rows(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, key, value): the entries of a JSON object column as a run's parameters, each as text."""
    return rows.select(key, F.explode(F.from_json(column, "map<string,string>")).alias("key", "value"))


def create_table(spark: SparkSession, name: str, schema: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet")


class RunLog:
    """Appends parameters, metrics and artifacts of a run to several stores; a store that fails only warns."""

    def __init__(self, spark: SparkSession, run: str, stores: list[str]):
        self.spark, self.run, self.stores = spark, run, stores

    def _append(self, kind: str, rows: DataFrame) -> int:
        return sum(self._try(lambda s=s: rows.write.mode("append").parquet(f"{s}/{kind}")) for s in self.stores)

    @staticmethod
    def _try(act: Callable[[], None]) -> bool:
        try:
            act()
        except Exception as error:  # a store may be missing; the run goes on
            logging.getLogger(__name__).warning("a run store failed: %s", error)
            return False
        return True

    def start(self, config: dict[str, object] | None = None, name: str | None = None) -> int:
        """Writes the run's header and its parameters; the number of stores that took the header."""
        took = self._status("running", name)
        if config:
            self.params(config)
        return took

    def finish(self, status: str = "finished") -> int:
        return self._status(status)

    def _status(self, status: str, name: str | None = None) -> int:
        rows = self.spark.range(1).select(F.lit(self.run).alias("run"), F.lit(name).cast("string").alias("name"), F.lit(status).alias("status"), utc_now().alias("at"))
        return self._append("runs", rows)

    def params(self, values: dict[str, object]) -> int:
        """Number of stores that took the (run, key, value) rows."""
        return self._append("params", self.spark.createDataFrame([(self.run, k, str(v)) for k, v in values.items()], "run string, key string, value string"))

    def metrics(self, values: dict[str, float], step: int | None, seq: int) -> int:
        rows = [(self.run, k, float(v), step, seq + i) for i, (k, v) in enumerate(values.items())]
        return self._append("metrics", self.spark.createDataFrame(rows, "run string, key string, value double, step bigint, seq bigint"))

    def checkpoint(self, step: int, best: float | None, filename: str | None = None) -> int:
        name = filename or f"checkpoint_step_{step}.pt"
        return self._append("checkpoints", self.spark.createDataFrame([(self.run, name, step, best)], "run string, filename string, global_step bigint, best_eval_loss double"))

    def artifact(self, local: str, target: str | None = None) -> int:
        """Copies a file into each store and notes it there; a store whose copy fails gets no note."""
        name = "/".join(x for x in (target, local.rstrip("/").rpartition("/")[2]) if x)

        def put(store: str) -> None:
            files, conf = _files(self.spark, store)
            self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(_files(self.spark, local)[0], _path(self.spark, local), files, _path(self.spark, f"{store}/artifact_files/{self.run}/{name}"), False, conf)
            rows = self.spark.createDataFrame([(self.run, local, name)], "run string, local_path string, artifact_path string")
            rows.write.mode("append").parquet(f"{store}/artifacts")

        return sum(self._try(lambda s=s: put(s)) for s in self.stores)


def utc_now():
    """The present time as UTC, for default columns."""
    return F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
