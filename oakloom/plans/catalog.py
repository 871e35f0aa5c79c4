"""Named queries over the test tables and the SQL that must give the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oakloom.functions import numerics as N
from oakloom.functions import text as X
from oakloom.functions import tokens as T
from oakloom.operators import corpus, metrics, model, registry, sampling, windows
from oakloom.sources import sinks
from oakloom.sources.files import parsed_records, table

# Added before means are rounded: values of six digits make ties, which the engines' sums in different order would break differently.
TIE = 1.3e-9

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def keep(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# The line ends and white space of oakloom.functions.text in the dialect of the SQL engine.
_END = r"\r\n|[\n\x0B\f\r\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
_SPACE = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


_LINES_SQL = f"""
    parts AS (SELECT doc_id, source, lang, string_split_regex(text, '{_END}') AS p FROM documents WHERE text IS NOT NULL),
    whole AS (SELECT doc_id, source, lang, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS p FROM parts),
    lines AS (SELECT doc_id, source, lang, unnest(p) AS line, generate_subscripts(p, 1) - 1 AS line_no FROM whole),
    stripped AS (SELECT doc_id, source, lang, line_no, {_strip_sql("line")} AS line FROM lines)"""


def _document_lines(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", "source", "lang", F.posexplode(X.lines("text")).alias("line_no", "line"))


# Corpus


@query(f"""WITH {_LINES_SQL}
    SELECT source, count(*) AS lines_in, count(*) FILTER (length(line) BETWEEN 10 AND 10000) AS lines_out,
      coalesce(sum(length(line)) FILTER (length(line) BETWEEN 10 AND 10000), 0)::BIGINT AS chars_out FROM stripped GROUP BY source""")
def clean_stats(spark, folder):
    return corpus.clean_stats(_document_lines(spark, folder), ["source"])


@query(f"WITH {_LINES_SQL} SELECT doc_id, line_no, line FROM stripped WHERE length(line) BETWEEN 10 AND 10000")
def clean_lines(spark, folder):
    return corpus.clean_lines(_document_lines(spark, folder)).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line")


@query(f"WITH {_LINES_SQL} SELECT source, lang, count(*) AS lines FROM stripped WHERE length(line) BETWEEN 10 AND 10000 GROUP BY source, lang")
def corpus_by_source_lang(spark, folder):
    return corpus.clean_lines(_document_lines(spark, folder)).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("lines"))


@query(f"""SELECT path, source, count(*) AS lines_in, count(*) FILTER (length(s) BETWEEN 10 AND 10000) AS lines_out,
      coalesce(sum(length(s)) FILTER (length(s) BETWEEN 10 AND 10000), 0)::BIGINT AS chars_out
    FROM (SELECT path, source, {_strip_sql("line")} AS s FROM corpus_lines) GROUP BY path, source""")
def corpus_file_stats(spark, folder):
    return corpus.clean_stats(table(spark, folder, "corpus_lines"), ["path", "source"])


@query(f"""SELECT doc_id, coalesce(length(text), 0) AS tokens,
      len(list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}+'), lambda x: x <> '')) AS words, left(text, 50) AS preview FROM documents""")
def token_counts(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("tokens"), X.word_count("text").alias("words"), F.left("text", F.lit(50)).alias("preview"))


@query("""WITH t AS (SELECT doc_id, list_transform(string_split(text, ''), lambda c: unicode(c)) AS x FROM documents WHERE text <> '')
    SELECT doc_id, len(x) AS n, list_sum(x)::BIGINT AS total, list_sum(x[-8:])::BIGINT AS tail FROM t""")
def code_point_tokens(spark, folder):
    t = table(spark, folder, "documents").where("text <> ''").select("doc_id", T.code_points("text").alias("x"))
    add = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, v: a + v)
    return t.select("doc_id", F.size("x").cast("bigint").alias("n"), add(F.col("x")).alias("total"), add(T.keep_last("x", 8)).alias("tail"))


# Windows and samples


def _weighted(c: Column | str) -> Column:
    """Sum of position times value, positions from 1: it changes with the order."""

    @F.arrow_udf("bigint")
    def weighted(arrays: pa.Array) -> pa.Array:
        ends = arrays.offsets.to_numpy().astype(np.int64)
        flat = arrays.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(np.int64)
        place = np.arange(1, len(flat) + 1) - np.repeat(ends[:-1] - ends[0], np.diff(ends))
        sums = np.concatenate([[0], np.cumsum(flat * place)])
        return pa.array(sums[ends[1:] - ends[0]] - sums[ends[:-1] - ends[0]])

    return weighted(c)


def _weighted_sql(c: str) -> str:
    return f"list_sum(list_transform({c}, lambda v, i: v::BIGINT * i))::BIGINT"


_STREAM_SQL = """SELECT string_agg(text, '' ORDER BY doc_id) AS t FROM documents WHERE text <> ''"""


def _window_sql(stream: str, length: int, stride: int) -> str:
    return f"""WITH s AS ({stream}),
    k AS (SELECT t, unnest(range(0, CASE WHEN length(t) > {length} THEN (length(t) - {length} + {stride - 1}) // {stride} ELSE 0 END)) AS k FROM s),
    w AS (SELECT k, list_transform(string_split(substr(t, k * {stride} + 1, {length + 1}), ''), lambda c: unicode(c)) AS x FROM k)
    SELECT k::BIGINT AS k, len(x) AS n, {_weighted_sql("x")} AS weighted, x[1]::BIGINT AS first, x[-1]::BIGINT AS last FROM w"""


def _window_numbers(packed: DataFrame) -> DataFrame:
    first, last = F.ascii(F.left("window", F.lit(1))), F.ascii(F.right("window", F.lit(1)))
    return packed.select("k", F.length("window").cast("bigint").alias("n"), _weighted(T.code_points("window")).alias("weighted"), first.cast("bigint").alias("first"), last.cast("bigint").alias("last"))


@query(_window_sql(_STREAM_SQL, 512, 384))
def pack_windows(spark, folder):
    return _window_numbers(windows.pack_texts(table(spark, folder, "documents"), "doc_id", "text", 512, 384))


@query(_window_sql("SELECT string_agg(text, '' ORDER BY doc_id // 9, doc_id) AS t FROM documents WHERE text <> ''", 256, 256))
def pack_windows_repeated_keys(spark, folder):
    """Nine documents of each key, which stay whole and go by the ties."""
    docs = table(spark, folder, "documents").withColumn("key", F.expr("doc_id div 9"))
    return _window_numbers(windows.pack_texts(docs, "key", "text", 256, ties=("doc_id",)))


@query(f"""WITH s AS (SELECT flatten(list(x ORDER BY vec_id // 5, vec_id)) AS t FROM (SELECT vec_id, list_transform(embedding, lambda v: floor(v * 100)::INTEGER) AS x FROM embeddings)),
    k AS (SELECT t, unnest(range(0, (len(t) - 100 + 69) // 70)) AS k FROM s)
    SELECT k::BIGINT AS k, {_weighted_sql("t[k * 70 + 1 : k * 70 + 101]")} AS weighted FROM k""")
def pack_token_arrays(spark, folder):
    """Token arrays instead of texts, with repeated keys."""
    rows = table(spark, folder, "embeddings").select("vec_id", F.expr("vec_id div 5").alias("key"), F.transform("embedding", lambda v: F.floor(v.cast("double") * 100).cast("int")).alias("tokens"))
    return windows.pack_windows(rows, "key", "tokens", 100, 70, ties=("vec_id",)).select("k", _weighted("window").alias("weighted"))


@query(f"""WITH d AS (SELECT doc_id, list_transform(string_split(text, ''), lambda c: unicode(c)) AS x FROM documents WHERE length(text) > 256),
    k AS (SELECT doc_id, x, unnest(range(0, len(x) - 256, 192)) AS i FROM d)
    SELECT doc_id, (i // 192)::BIGINT AS k, {_weighted_sql("x[i + 1 : i + 256]")} AS inputs, {_weighted_sql("x[i + 2 : i + 257]")} AS labels FROM k""")
def document_windows(spark, folder):
    docs = table(spark, folder, "documents").where(F.length("text") > 256).select("doc_id", T.code_points("text").alias("tokens"))
    each = docs.select("doc_id", F.posexplode(windows.document_windows("tokens", 256, 192)).alias("k", "w"))
    ids, labels = windows.next_token_pair("w")
    return each.select("doc_id", F.col("k").cast("bigint").alias("k"), _weighted(ids).alias("inputs"), _weighted(labels).alias("labels"))


_PROMPT_SQL = "'### Instruction:' || chr(10) || prompt || chr(10) || chr(10) || '### Response:' || chr(10)"


@query(f"SELECT sample_id, {_PROMPT_SQL} AS prompt_text, {_PROMPT_SQL} || response || '<end>' AS full_text FROM sft_samples WHERE prompt IS NOT NULL AND response IS NOT NULL")
def sft_texts(spark, folder):
    s = table(spark, folder, "sft_samples").where("prompt is not null and response is not null")
    return s.select("sample_id", X.prompt_text("prompt").alias("prompt_text"), X.full_text("prompt", "response", "<end>").alias("full_text"))


_FULL_SQL = f"(SELECT sample_id, length({_PROMPT_SQL}) AS p, list_transform(string_split(left({_PROMPT_SQL} || response, 512), ''), lambda c: unicode(c)) AS x FROM sft_samples WHERE prompt IS NOT NULL AND response IS NOT NULL)"
_LABELS_SQL = "list_transform(x, lambda v, i: CASE WHEN i <= p THEN -100 ELSE v END)"


def _full_texts(spark: SparkSession, folder: str, most: int = 512) -> DataFrame:
    """(sample_id, prompt_length, full, own): texts cut to ``most`` code points, and their lengths."""
    s = table(spark, folder, "sft_samples").where("prompt is not null and response is not null")
    full = F.left(X.full_text("prompt", "response"), F.lit(most))
    return s.select("sample_id", F.length(X.prompt_text("prompt")).alias("prompt_length"), full.alias("full"), F.length(full).alias("own"))


def _masked(texts: DataFrame, most: int = 512) -> DataFrame:
    s = texts.withColumn("tokens", T.code_points("full")).drop("full")
    ids, labels = windows.masked_labels("tokens", F.col("prompt_length"), most)
    return s.withColumn("input_ids", ids).withColumn("labels", labels)


@query(f"""SELECT sample_id, len(x) AS tokens, len(list_filter({_LABELS_SQL}, lambda v: v = -100)) AS masked, p >= len(x) AS trains_nothing,
    {_weighted_sql("x")} AS inputs, {_weighted_sql(_LABELS_SQL)} AS targets FROM {_FULL_SQL}""")
def sft_masked(spark, folder):
    ignored = (F.size("labels") - F.size(F.array_remove("labels", windows.IGNORED))).cast("bigint")
    return _masked(_full_texts(spark, folder)).select("sample_id", F.size("input_ids").cast("bigint").alias("tokens"), ignored.alias("masked"), windows.trains_nothing("labels").alias("trains_nothing"), _weighted("input_ids").alias("inputs"), _weighted("labels").alias("targets"))


@query(f"""WITH s AS (SELECT sample_id, p, x, row_number() OVER (ORDER BY sample_id) - 1 AS r FROM {_FULL_SQL}),
    w AS (SELECT *, max(len(x)) OVER (PARTITION BY r // 8) AS width FROM s)
    SELECT sample_id, (r // 8)::BIGINT AS batch_id, (r % 8)::BIGINT AS row, width, width - len(x) AS padding,
      {_weighted_sql("x")} AS inputs, {_weighted_sql(_LABELS_SQL)} - 100 * ((width * (width + 1) - len(x) * (len(x) + 1)) // 2)::BIGINT AS targets FROM w""")
def padded_batches(spark, folder):
    # texts are numbered and get their widths before they become arrays of numbers
    numbered = windows.with_width(windows.numbered_batches(_full_texts(spark, folder), "sample_id", 8), "own")
    padded = windows.padded(_masked(numbered), width="width")
    padding = (F.size("input_ids") - F.col("own")).cast("bigint")
    return padded.select("sample_id", "batch_id", "row", F.size("labels").cast("bigint").alias("width"), padding.alias("padding"), _weighted("input_ids").alias("inputs"), _weighted("labels").alias("targets"))


@query("""WITH s AS (SELECT sample_id, prompt, row_number() OVER (ORDER BY sample_id) - 1 AS place, count(*) OVER () AS samples FROM sft_samples WHERE prompt IS NOT NULL AND response IS NOT NULL)
    SELECT samples, place, sample_id, prompt FROM s WHERE place IN (0, 17, samples - 1)""")
def samples_by_index(spark, folder):
    """Length of the dataset with its first, eighteenth and last sample."""
    s = table(spark, folder, "sft_samples").where("prompt is not null and response is not null").select("sample_id", "prompt")
    return windows.items(s, "sample_id", [0, 17, -1])


@query("""WITH s AS (SELECT sample_id, ('0x' || left(md5(sample_id::VARCHAR || ':42'), 15))::BIGINT AS h FROM sft_samples),
    n AS (SELECT sample_id, row_number() OVER (ORDER BY h, sample_id) - 1 AS r FROM s)
    SELECT sample_id, (r // 8)::BIGINT AS batch_id, (r % 8)::BIGINT AS row FROM n""")
def shuffled_batches(spark, folder):
    s = table(spark, folder, "sft_samples").select("sample_id", windows.seeded("sample_id").alias("at"))
    return windows.numbered_batches(s, "at", 8, ("sample_id",)).select("sample_id", "batch_id", "row")


@query()
def byte_pair_counts(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", T.byte_pairs(T.vocabulary_path())("text").alias("t"))
    return docs.select("doc_id", F.size("t").alias("tokens"), T.out_of_range(F.col("t"), 50_257).alias("out_of_range"))


@query(r"""SELECT sample_id, json_extract_string(line, '$.prompt') AS prompt, json_extract_string(line, '$.response') AS response FROM
      (SELECT sample_id, CASE WHEN json_valid(line) AND json_type(line) = 'OBJECT' AND NOT regexp_matches(line, ',\s*\}\s*$') THEN line END AS line FROM sft_raw)
    WHERE json_extract_string(line, '$.prompt') IS NOT NULL AND json_extract_string(line, '$.response') IS NOT NULL""")
def parsed_jsonl(spark, folder):
    return parsed_records(table(spark, folder, "sft_raw")).where("prompt is not null and response is not null").select("sample_id", "prompt", "response")


# Registry


@query("SELECT id, name, status, created_at FROM experiments WHERE status = 'completed' ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 20")
def list_page(spark, folder):
    return registry.page(table(spark, folder, "experiments"), number=2, size=20, status="completed").select("id", "name", "status", "created_at")


@query("SELECT count(*) AS total FROM experiments WHERE status = 'completed'")
def list_count(spark, folder):
    return registry.page_total(table(spark, folder, "experiments"), status="completed")


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40")
def order_page(spark, folder):
    return registry.page(table(spark, folder, "orders"), "o_orderdate", 3, 20, "o_orderkey", o_orderstatus="O").select("o_orderkey", "o_orderdate", "o_totalprice")


@query("SELECT id, name, status FROM experiments WHERE id = 7")
def point_lookup(spark, folder):
    return registry.where_equal(table(spark, folder, "experiments"), id=7).select("id", "name", "status")


@query("""SELECT m.experiment_id, m.id, m.name, m.registered_at FROM experiments e JOIN registered_models m ON m.experiment_id = e.id""")
def models_for_experiment(spark, folder):
    found = registry.children_of(table(spark, folder, "experiments"), table(spark, folder, "registered_models"), "experiment_id")
    return found.select("experiment_id", "id", "name", "registered_at")


@query("""SELECT id, name, registered_at FROM registered_models WHERE experiment_id =
      (SELECT experiment_id FROM registered_models WHERE experiment_id IS NOT NULL GROUP BY experiment_id ORDER BY count(*) DESC, experiment_id LIMIT 1) ORDER BY registered_at DESC, id DESC""")
def models_of_one_experiment(spark, folder):
    """Of the experiment with most models."""
    models = table(spark, folder, "registered_models")
    most = models.where("experiment_id is not null").groupBy("experiment_id").count().orderBy(F.desc("count"), "experiment_id").first()
    models = registry.where_equal(models, experiment_id=most.experiment_id if most else -1)
    return models.orderBy(F.desc("registered_at"), F.desc("id")).select("id", "name", "registered_at")


@query("SELECT id, experiment_id, name FROM registered_models WHERE experiment_id IN (SELECT id FROM experiments)")
def register_valid(spark, folder):
    return registry.with_parent(table(spark, folder, "registered_models"), table(spark, folder, "experiments"), "experiment_id").select("id", "experiment_id", "name")


@query("SELECT id, experiment_id, name FROM registered_models m WHERE NOT EXISTS (SELECT 1 FROM experiments e WHERE e.id = m.experiment_id)")
def register_invalid(spark, folder):
    return registry.without_parent(table(spark, folder, "registered_models"), table(spark, folder, "experiments"), "experiment_id").select("id", "experiment_id", "name")


@query("SELECT user_id, event_type AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_status(spark, folder):
    return registry.latest(table(spark, folder, "events"), "user_id", "event_type", ["ts", "event_id"]).select("user_id", F.col("event_type").alias("status"))


@query("""WITH b AS (SELECT e.id, j.key, try_cast(j.value AS DOUBLE) AS value, -1 AS seq FROM experiments e, json_each(e.metrics) j),
    first AS (SELECT name, min(id) AS id FROM experiments GROUP BY name),
    p AS (SELECT f.id, m.key, m.value, m.seq FROM metric_log m JOIN first f ON f.name = m.run),
    a AS (SELECT *, row_number() OVER (PARTITION BY id, key ORDER BY seq DESC) AS r FROM (SELECT * FROM b UNION ALL SELECT * FROM p))
    SELECT id, key, CASE WHEN isnan(value) OR isinf(value) THEN NULL ELSE value END AS value FROM a WHERE r = 1""")
def metrics_merge(spark, folder):
    experiments = table(spark, folder, "experiments")
    base = registry.json_entries(experiments, "id", "metrics").withColumnRenamed("name", "key")
    first = experiments.groupBy("name").agg(F.min("id").alias("id")).withColumnRenamed("name", "run")
    return registry.merged_metrics(base, table(spark, folder, "metric_log").join(first, "run")).select("id", "key", metrics.finite("value").alias("value"))


def _versions(spark: SparkSession, folder: str) -> DataFrame:
    models = table(spark, folder, "registered_models")
    return models.select("id", "name", F.get_json_object("parameters", "$.version").alias("version"), F.get_json_object("parameters", "$.stage").alias("stage"))


_VERSIONS_SQL = "WITH v AS (SELECT id, name, json_extract_string(parameters, '$.version') AS version, json_extract_string(parameters, '$.stage') AS stage FROM registered_models)"


@query(f"""{_VERSIONS_SQL} SELECT name, CASE WHEN coalesce(bool_or(version IS NOT NULL AND try_cast(version AS BIGINT) IS NULL), false) THEN NULL
    ELSE max(try_cast(version AS BIGINT)) END::VARCHAR AS version FROM v GROUP BY name""")
def latest_version(spark, folder):
    return registry.latest_version(_versions(spark, folder))


@query(f"{_VERSIONS_SQL} SELECT name, max(try_cast(version AS BIGINT))::VARCHAR AS version FROM v WHERE stage = 'Production' GROUP BY name")
def latest_production_version(spark, folder):
    return registry.latest_version(_versions(spark, folder), stage="Production")


@query(f"{_VERSIONS_SQL} SELECT name, stage FROM (SELECT *, row_number() OVER (PARTITION BY name, version ORDER BY id DESC) AS r FROM v) WHERE r = 1 AND version = '3'")
def stage_of_version(spark, folder):
    return registry.latest(_versions(spark, folder), ["name", "version"], "stage", ["id"]).where("version = '3'").select("name", "stage")


@query(f"""{_VERSIONS_SQL}, l AS (SELECT name, coalesce(max(try_cast(version AS BIGINT)), 0) AS last FROM v GROUP BY name),
    n AS (SELECT id, name, row_number() OVER (PARTITION BY name ORDER BY id) AS r FROM registered_models WHERE experiment_id IN (SELECT id FROM experiments))
    SELECT n.id, n.name, (l.last + n.r)::VARCHAR AS version FROM n JOIN l ON l.name IS NOT DISTINCT FROM n.name""")
def registered_version(spark, folder):
    """Every model with an experiment is registered once more: each gets the next version of its name."""
    new = registry.with_parent(table(spark, folder, "registered_models"), table(spark, folder, "experiments"), "experiment_id").select("id", "name")
    return registry.registered(_versions(spark, folder), new, "id")


_CHANGES_SQL = """c AS (SELECT name, version, stage, id AS seq FROM (SELECT id, name, (1 + id % 4)::VARCHAR AS version, CASE id % 3 WHEN 0 THEN 'Staging' WHEN 1 THEN 'Production' END AS stage FROM registered_models))"""


@query(f"""{_VERSIONS_SQL}, {_CHANGES_SQL},
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, version ORDER BY seq DESC) AS r FROM c WHERE name IS NOT NULL) WHERE r = 1)
    SELECT v.id, v.name, v.version, CASE WHEN k.seq IS NOT NULL THEN k.stage ELSE v.stage END AS stage FROM v LEFT JOIN k ON k.name = v.name AND k.version = v.version""")
def staged_version(spark, folder):
    """Stages after a log of changes, of which the last of a version holds."""
    return registry.staged(_versions(spark, folder), _stage_changes(spark, folder))[0]


@query(f"""{_VERSIONS_SQL}, {_CHANGES_SQL} SELECT name, version, seq FROM c WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.name = c.name AND v.version = c.version)""")
def staged_missing(spark, folder):
    """Changes of versions that aren't there."""
    return registry.staged(_versions(spark, folder), _stage_changes(spark, folder))[1].select("name", "version", "seq")


def _stage_changes(spark: SparkSession, folder: str) -> DataFrame:
    stage = F.when(F.col("id") % 3 == 0, "Staging").when(F.col("id") % 3 == 1, "Production")
    return table(spark, folder, "registered_models").select("name", (1 + F.col("id") % 4).cast("string").alias("version"), stage.alias("stage"), F.col("id").alias("seq"))


def _status_changes(spark: SparkSession, folder: str) -> DataFrame:
    """A log of status changes: the events, as if their users were experiments."""
    return table(spark, folder, "events").select(F.col("user_id").cast("bigint").alias("id"), F.col("event_type").alias("status"), F.col("ts").alias("updated_at"), F.col("event_id").alias("seq"))


@query("""WITH k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1)
    SELECT e.id, CASE WHEN k.event_id IS NOT NULL THEN k.event_type ELSE e.status END AS status, CASE WHEN k.event_id IS NOT NULL THEN k.ts ELSE e.updated_at END AS updated_at
    FROM experiments e LEFT JOIN k ON k.user_id = e.id""")
def status_update(spark, folder):
    """Experiments after a log of status changes: the last one holds, and its time."""
    return registry.updated(table(spark, folder, "experiments"), _status_changes(spark, folder), "status")[0].select("id", "status", "updated_at")


@query("SELECT user_id::BIGINT AS id, event_id AS seq FROM events WHERE user_id NOT IN (SELECT id FROM experiments)")
def status_update_missing(spark, folder):
    """Changes of experiments that aren't there."""
    return registry.updated(table(spark, folder, "experiments"), _status_changes(spark, folder), "status")[1].select("id", "seq")


@query("""WITH b AS (SELECT e.id, j.key, try_cast(j.value AS DOUBLE) AS value, -1 AS seq FROM experiments e, json_each(e.metrics) j),
    t AS (SELECT experiment_id AS id, id AS seq, metrics FROM registered_models WHERE experiment_id IS NOT NULL AND metrics IS NOT NULL),
    p AS (SELECT t.id, j.key, try_cast(j.value AS DOUBLE) AS value, t.seq FROM t, json_each(t.metrics) j),
    a AS (SELECT *, row_number() OVER (PARTITION BY id, key ORDER BY seq DESC) AS r FROM (SELECT * FROM b UNION ALL SELECT * FROM p))
    SELECT a.id, a.key, a.value FROM a JOIN experiments e ON e.id = a.id WHERE r = 1""")
def metrics_patch(spark, folder):
    """Experiments whose metrics are patched by those of their models, read back from the written JSON."""
    models = table(spark, folder, "registered_models").where("experiment_id is not null and metrics is not null")
    patches = models.select(F.col("experiment_id").alias("id"), F.from_json("metrics", "map<string,double>").alias("patch"), F.col("id").alias("seq")).where("patch is not null")
    after = registry.patched_metrics(table(spark, folder, "experiments"), patches)
    return registry.json_entries(after, "id", "metrics").withColumnRenamed("name", "key")


@query("""SELECT item_id, length(passage) BETWEEN 1 AND 99999999 AS text, length(passage) BETWEEN 1 AND 2048 AND (item_id % 5) / 2.0 BETWEEN 0 AND 2 AND (item_id % 7) / 5.0 BETWEEN 0 AND 1 AS valid FROM eval_items""")
def request_validation(spark, folder):
    asks = table(spark, folder, "eval_items").select("item_id", F.col("passage").alias("text"), F.length("passage").alias("max_length"), (F.col("item_id") % 5 / 2.0).alias("temperature"), (F.col("item_id") % 7 / 5.0).alias("top_p"))
    broken = registry.violations(registry.request_rules())
    return asks.select("item_id", (~F.array_contains(broken, "text")).alias("text"), (F.size(broken) == 0).alias("valid"))


@query("""SELECT id, length(name) BETWEEN 1 AND 255 AND coalesce(length(description) <= 1000, true) AND status IN ('created', 'running', 'completed', 'failed', 'cancelled') AS valid FROM experiments""")
def validation(spark, folder):
    return table(spark, folder, "experiments").select("id", (F.size(registry.violations(registry.experiment_rules())) == 0).alias("valid"))


@query("SELECT CASE WHEN bool_and(coalesce(c_acctbal > -900, false)) THEN 'ok' ELSE 'degraded' END AS status FROM customer")
def readiness(spark, folder):
    return registry.readiness(table(spark, folder, "customer").select((F.col("c_acctbal") > -900).alias("ok")))


@query("""SELECT doc_id, '[Model output for: ' || left(text, 50) || '...]' AS answer, length(text) AS input_chars FROM documents WHERE length(text) >= 1""")
def placeholder_inference(spark, folder):
    docs = table(spark, folder, "documents").where(F.length("text") >= 1)
    return docs.select("doc_id", X.echo_answer("text").alias("answer"), F.length("text").cast("bigint").alias("input_chars"))


# Metrics

_ONCE_SQL = """once AS (SELECT run, key, step, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY run, key, step, CASE WHEN step IS NULL THEN seq END ORDER BY seq DESC) AS r FROM metric_log) WHERE r = 1),
    fin AS (SELECT run, key, step, seq, CASE WHEN NOT isnan(value) AND NOT isinf(value) THEN value END AS value FROM once)"""


@query(f"WITH {_ONCE_SQL} SELECT run, key, step, seq, value FROM fin")
def metric_series(spark, folder):
    return metrics.delivered_once(table(spark, folder, "metric_log")).select("run", "key", "step", "seq", metrics.finite("value").alias("value"))


@query("SELECT run, key, step, seq FROM metric_log WHERE step % 500 = 0")
def every_n_steps(spark, folder):
    return table(spark, folder, "metric_log").where(metrics.every("step", 500)).select("run", "key", "step", "seq")


@query(f"""WITH {_ONCE_SQL} SELECT run, ((step - 1) // 500)::BIGINT AS epoch, round(avg(value) + {TIE}, 6) AS mean_loss, count(*) AS batches
    FROM fin WHERE key = 'train/loss' AND step IS NOT NULL GROUP BY ALL""")
def epoch_mean(spark, folder):
    log = metrics.delivered_once(table(spark, folder, "metric_log").where("key = 'train/loss'"))
    return metrics.epoch_means(log, 500).select("run", "epoch", F.round(F.col("mean_loss") + TIE, 6).alias("mean_loss"), "batches")


@query(f"""WITH {_ONCE_SQL}, m AS (SELECT run, step, avg(value) AS v FROM fin WHERE key = 'eval/loss' GROUP BY run, step)
    SELECT run, round(coalesce(avg(v), 0) + {TIE}, 6) AS eval_loss, round(exp(coalesce(avg(v), 0)), 4) AS perplexity FROM m GROUP BY run""")
def eval_loss_perplexity(spark, folder):
    log = metrics.delivered_once(table(spark, folder, "metric_log").where("key = 'eval/loss'")).withColumn("value", metrics.finite("value"))
    return metrics.eval_loss(log, "step", "value", ["run"]).select("run", F.round(F.col("eval_loss") + TIE, 6).alias("eval_loss"), F.round("perplexity", 4).alias("perplexity"))


@query(f"""WITH {_ONCE_SQL}, b AS (SELECT run, step, seq, value, min(value) OVER (PARTITION BY run ORDER BY step NULLS FIRST, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM fin WHERE key = 'eval/loss')
    SELECT run, step, seq, coalesce(value < coalesce(best, 'inf'::DOUBLE), false) AS improved, best AS best_before FROM b""")
def running_best(spark, folder):
    log = metrics.delivered_once(table(spark, folder, "metric_log").where("key = 'eval/loss'"))
    best = F.when(F.col("best_before") != float("inf"), F.col("best_before"))
    return metrics.running_best(log).select("run", "step", "seq", "improved", best.alias("best_before"))


@query(f"""WITH t AS (SELECT name, try_cast(json_extract_string(training_config_snapshot, '$.num_epochs') AS BIGINT) * 1000 AS total,
      try_cast(json_extract_string(training_config_snapshot, '$.warmup_ratio') AS DOUBLE) AS ratio, id FROM experiments)
    SELECT id, total, floor(total * ratio)::BIGINT AS warmup FROM t""")
def total_steps(spark, folder):
    number = lambda k, kind: F.expr(f"try_cast(get_json_object(training_config_snapshot, '$.{k}') AS {kind})")
    e = table(spark, folder, "experiments").select("id", number("num_epochs", "bigint").alias("epochs"), number("warmup_ratio", "double").alias("ratio"))
    total, warmup = metrics.total_steps(F.lit(1000), F.col("epochs"), F.col("ratio"))
    return e.select("id", total.alias("total"), warmup.alias("warmup"))


@query(f"""SELECT range AS step, round(CASE WHEN range < 100 THEN range / 100.0 ELSE 0.1 + 0.9 * 0.5 * (1 + cos({math.pi} * ((range - 100) / 900.0))) END, 9)::DOUBLE AS factor FROM range(1000)""")
def lr_schedule(spark, folder):
    return metrics.schedule(spark, 1000, 100).select("step", F.round("factor", 9).alias("factor"))


@query("""SELECT run, key, count(*) AS n, min(CASE WHEN NOT isnan(value) AND NOT isinf(value) THEN value END) AS lowest, max(step) AS last_step FROM metric_log GROUP BY run, key""")
def metric_summary(spark, folder):
    log = table(spark, folder, "metric_log")
    return log.groupBy("run", "key").agg(F.count(F.lit(1)).alias("n"), F.min(metrics.finite("value")).alias("lowest"), F.max("step").alias("last_step"))


def _manifest(spark: SparkSession) -> DataFrame:
    shapes = model.ModelConfig().parameters()
    return spark.createDataFrame([(n, int(math.prod(s)), "norm" not in n) for n, s in shapes.items()], "name string, numel bigint, requires_grad boolean")


_MANIFEST_SQL = "WITH p AS (SELECT * FROM (VALUES {}) AS v(name, numel, requires_grad))".format(
    ", ".join(f"('{n}', {math.prod(s)}::BIGINT, {str('norm' not in n).lower()})" for n, s in model.ModelConfig().parameters().items())
)


@query(f"{_MANIFEST_SQL} SELECT name, CASE WHEN regexp_matches(name, 'bias|norm|embed') THEN 0.0 ELSE 0.01 END::DOUBLE AS decay FROM p")
def weight_decay_groups(spark, folder):
    return _manifest(spark).select("name", metrics.weight_decay("name").alias("decay"))


@query(f"{_MANIFEST_SQL} SELECT sum(numel)::BIGINT AS total, (sum(numel) FILTER (requires_grad))::BIGINT AS trainable FROM p")
def param_count(spark, folder):
    return metrics.parameter_counts(_manifest(spark))


@query("""WITH n AS (SELECT o_orderkey, (o_totalprice * CASE o_orderkey % 4 WHEN 0 THEN 0.001 WHEN 1 THEN 1 WHEN 2 THEN 100 ELSE 100000 END)::BIGINT AS n FROM orders)
    SELECT o_orderkey, CASE WHEN n >= 1000000000 THEN printf('%.2fB', n / 1e9) WHEN n >= 1000000 THEN printf('%.2fM', n / 1e6) WHEN n >= 1000 THEN printf('%.2fK', n / 1e3) ELSE n::VARCHAR END AS label FROM n""")
def human_number(spark, folder):
    scale = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 0.001D WHEN 1 THEN 1D WHEN 2 THEN 100D ELSE 100000D END")
    return table(spark, folder, "orders").select("o_orderkey", X.human_number(F.rint(F.col("o_totalprice") * scale).cast("bigint")).alias("label"))


@query("""WITH p AS (SELECT e.id, j.key, j.value ->> '$' AS value FROM experiments e, json_each(e.training_config_snapshot) j)
    SELECT id, key, try_cast(value AS DOUBLE) AS number, CASE WHEN try_cast(value AS DOUBLE) IS NULL THEN value END AS text FROM p""")
def param_log(spark, folder):
    rows = sinks.param_rows(table(spark, folder, "experiments"), "id", "training_config_snapshot")
    number = F.expr("try_cast(value AS double)")
    return rows.select("id", "key", number.alias("number"), F.when(number.isNull(), F.col("value")).alias("text"))


@query(f"""WITH {_ONCE_SQL}, b AS (SELECT run, step, seq, value, min(value) OVER (PARTITION BY run ORDER BY step NULLS FIRST, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM fin WHERE key = 'eval/loss')
    SELECT run, step, 'best_model.pt' AS filename FROM b WHERE value < coalesce(best, 'inf'::DOUBLE) AND step IS NOT NULL
    UNION ALL SELECT run, step, 'checkpoint_step_' || step || '.pt' FROM (SELECT DISTINCT run, step FROM metric_log WHERE step % 1000 = 0)""")
def checkpoints_written(spark, folder):
    log = table(spark, folder, "metric_log")
    best = metrics.running_best(metrics.delivered_once(log.where("key = 'eval/loss'"))).where("improved and step is not null")
    saved = log.where(metrics.every("step", 1000)).select("run", "step").distinct()
    return best.select("run", "step", F.lit("best_model.pt").alias("filename")).unionByName(saved.withColumn("filename", F.concat(F.lit("checkpoint_step_"), "step", F.lit(".pt"))))


@query("""WITH n AS (SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier)
    SELECT s_suppkey, s_name, r + (SELECT max(id) FROM experiments) AS id FROM n""")
def inserted_ids(spark, folder):
    rows = table(spark, folder, "supplier").select("s_suppkey", "s_name")
    return registry.next_ids(rows, table(spark, folder, "experiments"), "s_suppkey")


@query("SELECT q.range AS query, k.range AS key, k.range <= q.range AS attends FROM range(32) q, range(32) k")
def causal_mask(spark, folder):
    keys = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(31).cast("bigint"))).alias("key")
    return spark.range(32).select(F.col("id").alias("query"), keys).withColumn("attends", N.attends(F.col("query"), F.col("key")))


# Numerics


def _embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").withColumn("x", F.col("embedding").cast("array<double>"))


_X = "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"


def _positions(df: DataFrame, column: str) -> DataFrame:
    out = df.select("vec_id", F.posexplode(column).alias("i", "v"))
    return out.select("vec_id", F.col("i").cast("bigint").alias("i"), F.round("v", 8).alias("v"))


@query(f"""{_X}, n AS (SELECT vec_id, x, 1 / sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x) + 1e-6) AS s FROM e)
    SELECT vec_id, generate_subscripts(x, 1) - 1 AS i, round(unnest(x) * s, 8) AS v FROM n""")
def rmsnorm(spark, folder):
    return _positions(_embeddings(spark, folder).select("vec_id", N.rms_norm("x").alias("y")), "y")


@query(f"""{_X}, m AS (SELECT vec_id, list_transform(x, lambda v: exp((v - list_max(x)) / 0.7)) AS y FROM e)
    SELECT vec_id, generate_subscripts(y, 1) - 1 AS i, round(unnest(y) / list_sum(y), 8) AS v FROM m""")
def softmax(spark, folder):
    return _positions(_embeddings(spark, folder).select("vec_id", N.softmax("x", 0.7).alias("y")), "y")


@query(f"""{_X}, u AS (SELECT vec_id, x, generate_subscripts(x, 1) - 1 AS i, unnest(x) AS v FROM e),
    a AS (SELECT vec_id, i, v, CASE WHEN i < 32 THEN -x[i + 33] ELSE x[i - 31] END AS turned, (vec_id % 128) / pow(10000.0, 2 * (i % 32) / 64.0) AS angle FROM u)
    SELECT vec_id, i, round(v * cos(angle) + turned * sin(angle), 8) AS v FROM a""")
def rope(spark, folder):
    e = _embeddings(spark, folder).select("vec_id", N.apply_rope("x", (F.col("vec_id") % 128).cast("double"), 64).alias("y"))
    return _positions(e, "y")


@query(f"""{_X} SELECT vec_id, round(list_max(x) + ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))) - x[label + 1], 8) AS loss FROM e""")
def cross_entropy(spark, folder):
    return _embeddings(spark, folder).select("vec_id", F.round(N.cross_entropy("x", "label"), 8).alias("loss"))


@query(f"""{_X}, l AS (SELECT list_max(x) + ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))) - x[label + 1] AS loss, vec_id % 3 = 0 AS ignored FROM e)
    SELECT round(avg(loss) FILTER (NOT ignored), 8) AS loss, count(*) FILTER (NOT ignored) AS n FROM l""")
def cross_entropy_mean(spark, folder):
    """The mean over positions whose target isn't ignored."""
    target = F.when(F.col("vec_id") % 3 == 0, windows.IGNORED).otherwise(F.col("label")).alias("target")
    losses = _embeddings(spark, folder).select("x", target).select(N.cross_entropy("x", "target").alias("loss"))
    return losses.agg(F.round(F.avg("loss"), 8).alias("loss"), F.count("loss").alias("n"))


_NUCLEUS_SQL = f"""{_X}, u AS (SELECT vec_id, generate_subscripts(x, 1) - 1 AS token, unnest(list_transform(x, lambda v: exp((v - list_max(x)) / 0.05))) AS w FROM e),
    p AS (SELECT vec_id, token, w / sum(w) OVER (PARTITION BY vec_id) AS p FROM u),
    r AS (SELECT vec_id, token, p, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, token) AS rank, sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC, token ROWS UNBOUNDED PRECEDING) AS s FROM p)"""


@query(f"{_NUCLEUS_SQL} SELECT vec_id, token, rank FROM r WHERE rank = 1 OR s <= 0.9")
def nucleus(spark, folder):
    kept = sampling.nucleus(_embeddings(spark, folder), "vec_id", "x", 0.9, 0.05)
    return kept.select("vec_id", F.col("token").cast("bigint").alias("token"), F.col("rank").cast("bigint").alias("rank"))


@query(f"""{_NUCLEUS_SQL}, k AS (SELECT * FROM r WHERE rank = 1 OR s <= 0.9),
    c AS (SELECT vec_id, token, rank, sum(p) OVER (PARTITION BY vec_id ORDER BY rank ROWS UNBOUNDED PRECEDING) / sum(p) OVER (PARTITION BY vec_id) AS reached,
      max(rank) OVER (PARTITION BY vec_id) AS last, ('0x' || left(md5(vec_id::VARCHAR || ':42'), 13))::BIGINT / 4503599627370496.0 AS u FROM k)
    SELECT vec_id, arg_min(token, rank)::BIGINT AS token FROM c WHERE reached > u OR rank = last GROUP BY vec_id""")
def nucleus_draws(spark, folder):
    draws = sampling.drawn(sampling.nucleus(_embeddings(spark, folder), "vec_id", "x", 0.9, 0.05), "vec_id")
    return draws.select("vec_id", F.col("token").cast("bigint").alias("token"))


@query(f"""{_X} SELECT vec_id, round(least(1.0, 0.5 / (sqrt(list_sum(list_transform(x, lambda v: v * v))) + 1e-6)), 8) AS scale,
    round(list_sum(list_transform(x, lambda v: v / (1 + exp(-v)) * v)), 8) AS gated FROM e""")
def clip_and_gate(spark, folder):
    e = _embeddings(spark, folder)
    return e.select("vec_id", F.round(N.norm_scale("x", 0.5), 8).alias("scale"), F.round(N.dot(F.transform("x", N.silu), F.col("x")), 8).alias("gated"))


# Model

_TINY = model.ModelConfig(vocab_size=256, n_embed=32, n_layer=2, n_head=4, max_seq_len=48)


def _passages(spark: SparkSession, folder: str) -> DataFrame:
    tokens = F.transform(T.code_points("passage"), lambda c: F.pmod(c, F.lit(_TINY.vocab_size)))
    return table(spark, folder, "eval_items").where("length(passage) > 0").select("item_id", tokens.alias("tokens"))


def _model_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Windows that cover each passage: every token but its last is read, every one but its first a label."""
    each = _passages(spark, folder).select("item_id", F.posexplode(windows.covering_windows("tokens", _TINY.max_seq_len)).alias("k", "w"))
    ids, labels = windows.next_token_pair("w")
    return each.select("item_id", F.col("k").cast("bigint").alias("k"), ids.alias("input_ids"), labels.alias("labels"))


@query()
def forward_logits(spark, folder):
    return model.last_logits(_model_samples(spark, folder), ["item_id", "k"], "input_ids", model.initial_weights(_TINY), _TINY)


@query()
def model_eval_loss(spark, folder):
    losses = model.sequence_losses(_model_samples(spark, folder), "item_id", model.initial_weights(_TINY), _TINY)
    return metrics.eval_loss(losses.withColumn("batch_id", F.expr("item_id div 8")))


@query()
def greedy_generate(spark, folder):
    return model.generated(_passages(spark, folder), "item_id", "tokens", model.initial_weights(_TINY), _TINY, 8)
