"""Experiments and registered models as relations: pages, lookups, latest states, merges, validation.

Mutations are rows appended to logs; the current state is a query over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oakloom.operators.windows import numbered_batches

# The statuses of experiments.
STATUSES = ("created", "running", "completed", "failed", "cancelled")


def where_equal(df: DataFrame, **wanted: object) -> DataFrame:
    """Equality filters; those that are None don't apply."""
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def page(df: DataFrame, newest: str = "created_at", number: int = 1, size: int = 20, tie: str = "id", **wanted: object) -> DataFrame:
    """One page, the newest first; equal times go by the larger id."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("page counts from 1 and has 1 to 100 rows")
    return where_equal(df, **wanted).orderBy(F.desc(newest), F.desc(tie)).offset((number - 1) * size).limit(size)


def page_total(df: DataFrame, **wanted: object) -> DataFrame:
    """(total): the number of rows that the pages hold together."""
    return where_equal(df, **wanted).agg(F.count(F.lit(1)).alias("total"))


def lookup(df: DataFrame, key: str, value: object):
    """The one row of a key; LookupError where there is none, ValueError where there are several."""
    found = df.where(F.col(key) == value).limit(2).collect()
    if not found:
        raise LookupError(f"no row with {key} = {value}")
    if len(found) > 1:
        raise ValueError(f"several rows with {key} = {value}")
    return found[0]


def with_parent(children: DataFrame, parents: DataFrame, foreign: str, key: str = "id") -> DataFrame:
    """Rows whose foreign key stands in the parents; a null one doesn't."""
    return children.join(parents.select(F.col(key).alias(foreign)), foreign, "left_semi").select(*children.columns)


def without_parent(children: DataFrame, parents: DataFrame, foreign: str, key: str = "id") -> DataFrame:
    """Rows whose foreign key, null ones too, stands in no parent."""
    return children.join(parents.select(F.col(key).alias(foreign)), foreign, "left_anti").select(*children.columns)


def children_of(parents: DataFrame, children: DataFrame, foreign: str, key: str = "id") -> DataFrame:
    """Parents' keys with their children's columns, for many parents at once."""
    return parents.select(F.col(key).alias(foreign)).join(children, foreign)


def latest(log: DataFrame, key: str | list[str], value: str, order: list[str]) -> DataFrame:
    """(key, value): the last value of each key in the order; an explicit null stays null."""
    keys = [key] if isinstance(key, str) else key
    pick = F.max(F.struct(*order, F.struct(value).alias("_kept")))["_kept"][value].alias(value)
    return log.groupBy(*keys).agg(pick)


def merged_metrics(base: DataFrame, patches: DataFrame, order: str = "seq") -> DataFrame:
    """(id, key, value): maps of metrics as rows, patched key by key; later patches win, an explicit null too."""
    first = base.select("id", "key", "value", F.lit(None).cast("bigint").alias(order))
    log = first.unionByName(patches.select("id", "key", "value", order))
    return log.groupBy("id", "key").agg(F.max(F.struct(F.coalesce(order, F.lit(-(2**63))).alias("at"), F.struct("value").alias("kept")))["kept"]["value"].alias("value"))


def json_entries(df: DataFrame, key: str, json: str) -> DataFrame:
    """(key, name, value): the top-level numbers of a JSON object column; an explicit null is a row with null; null and broken objects have none."""
    entries = F.from_json(F.col(json), "map<string,double>", {"mode": "PERMISSIVE"})
    return df.select(key, F.explode(entries).alias("name", "value"))


def latest_version(models: DataFrame, name: str = "name", version: str = "version", **wanted: object) -> DataFrame:
    """(name, version): the numerically largest version as text. A version that is no whole number makes the answer of its name null."""
    number = F.expr(f"try_cast(`{version}` AS bigint)")
    broken = F.bool_or(number.isNull() & F.col(version).isNotNull())
    return where_equal(models, **wanted).groupBy(name).agg(F.when(~F.coalesce(broken, F.lit(False)), F.max(number)).cast("string").alias(version))


def registered(models: DataFrame, new: DataFrame, order: str, name: str = "name", version: str = "version") -> DataFrame:
    """The new rows with their versions as text: per name one more than the largest there, without gaps, in the order of a column. Names are case-sensitive; a null name is one of its own.

    A version there that is no whole number doesn't count. One writer at a time, as for other inserts.
    """
    last = models.groupBy(F.col(name).alias("_name")).agg(F.coalesce(F.max(F.expr(f"try_cast(`{version}` AS bigint)")), F.lit(0)).alias("_last"))
    placed = new.drop(version).withColumn("_at", F.row_number().over(Window.partitionBy(name).orderBy(order)))
    joined = placed.join(last, placed[name].eqNullSafe(last["_name"]), "left")
    return joined.withColumn(version, (F.coalesce("_last", F.lit(0)) + F.col("_at")).cast("string")).drop("_name", "_last", "_at")


def staged(models: DataFrame, changes: DataFrame, keys: tuple[str, ...] = ("name", "version"), column: str = "stage", order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(models, missing): the models with the stage of their last change, an explicit null too, and the changes of versions that aren't there."""
    ids = models.select(*keys).distinct()
    last = changes.groupBy(*keys).agg(F.max(F.struct(F.col(order).alias("at"), F.struct(column).alias("kept")))["kept"].alias("_kept"))
    after = models.join(last, list(keys), "left").withColumn(column, F.when(F.col("_kept").isNotNull(), F.col("_kept")[column]).otherwise(F.col(column)))
    return after.select(*models.columns), changes.join(ids, list(keys), "left_anti").select(*changes.columns)


def updated(rows: DataFrame, changes: DataFrame, column: str, at: str = "updated_at", key: str = "id", order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(rows, missing): the rows with the value of their last change and its time in ``at``, and the changes of ids that aren't there.

    changes: (key, column, at, order). Of several changes the one of the largest order holds; a row without changes stays as it is.
    """
    last = changes.groupBy(key).agg(F.max(F.struct(F.col(order).alias("o"), F.struct(column, at).alias("kept")))["kept"].alias("_kept"))
    after = rows.join(last, key, "left")
    for c in (column, at):
        after = after.withColumn(c, F.when(F.col("_kept").isNotNull(), F.col("_kept")[c]).otherwise(F.col(c)))
    return after.select(*rows.columns), changes.join(rows.select(key), key, "left_anti").select(*changes.columns)


def patched_metrics(rows: DataFrame, patches: DataFrame, column: str = "metrics", key: str = "id", order: str = "seq") -> DataFrame:
    """The rows with their JSON map of numbers patched by rows (key, map, order): later patches win key by key, explicit nulls too; keys in the map go by name."""
    base = json_entries(rows, key, column).select(key, F.col("name").alias("_k"), "value", F.lit(-(2**63)).alias("_o"))
    more = patches.select(key, F.explode("patch").alias("_k", "value"), F.col(order).alias("_o"))
    last = base.unionByName(more).groupBy(key, "_k").agg(F.max(F.struct("_o", F.struct("value").alias("kept")))["kept"]["value"].alias("value"))
    entries = F.array_sort(F.collect_list(F.struct("_k", "value")))
    maps = last.groupBy(key).agg(F.to_json(F.map_from_entries(entries), {"ignoreNullFields": "false"}).alias("_patched"))
    touched = patches.select(key).distinct().withColumn("_touched", F.lit(True))
    after = rows.join(maps, key, "left").join(touched, key, "left")
    return after.withColumn(column, F.when(F.col("_touched"), F.col("_patched")).otherwise(F.col(column))).select(*rows.columns)


def resolved_version(models: DataFrame, name: str, version: str | None = None, stage: str | None = None) -> str:
    """The version to load: the one asked for, else the latest of the stage, else the latest; LookupError where there is none."""
    if version is not None:
        return version
    found = latest_version(models.where(F.col("name") == name), **({"stage": stage} if stage else {})).first()
    if found is None or found.version is None:
        raise LookupError(f"no version of {name}")
    return found.version


def next_ids(rows: DataFrame, existing: DataFrame, order: str, ties: tuple[str, ...] = (), key: str = "id") -> DataFrame:
    """New rows with ids that follow the largest existing one without gaps, in the order of a whole-number column, then ``ties``."""
    last = existing.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    return numbered_batches(rows, order, 1, ties).withColumn(key, (F.col("batch_id") + 1 + last).cast("bigint")).drop("batch_id", "row")


def violations(rules: dict[str, Column]) -> Column:
    """Array of the names of the rules that a row breaks; a rule whose value is null is broken."""
    broken = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    return F.filter(F.array(*broken), lambda x: x.isNotNull())


def experiment_rules() -> dict[str, Column]:
    return {
        "name": F.length("name").between(1, 255),
        "description": F.col("description").isNull() | (F.length("description") <= 1000),
        "status": F.col("status").isin(*STATUSES),
    }


def request_rules() -> dict[str, Column]:
    """Rules of a generation request; a temperature of 0 passes here and is refused where it would divide."""
    return {
        "text": F.length("text") >= 1,
        "max_length": F.col("max_length").between(1, 2048),
        "temperature": F.col("temperature").between(0.0, 2.0),
        "top_p": F.col("top_p").between(0.0, 1.0),
    }


def readiness(checks: DataFrame, ok: str = "ok") -> DataFrame:
    """(status): ok where all services are, else degraded; null counts as not ok."""
    return checks.agg(F.when(F.coalesce(F.bool_and(F.coalesce(ok, F.lit(False))), F.lit(True)), "ok").otherwise("degraded").alias("status"))
