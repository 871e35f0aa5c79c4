"""The pN_ queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oakloom.llm.defects import response_defects
from oakloom.llm.leaks import leaked_items
from oakloom.llm.neardups import near_duplicates, pairs_in_groups, representative_pairs
from oakloom.llm.overlap import cross_split_overlaps, overlap_report
from oakloom.llm.packing import counted, pack_counts, pack_documents, packing_report
from oakloom.llm.quality import not_prose, text_quality
from oakloom.llm.splitting import limits_by_path, split_responses
from oakloom.llm.storage import table
from oakloom.llm.variants import collapsed, format_variants


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    found = cross_split_overlaps(table(spark, folder, "corpus_lines"), table(spark, folder, "data_configs"))
    ids = F.least("train_id", "eval_id").alias("line_id_a"), F.greatest("train_id", "eval_id").alias("line_id_b")
    return found.select(*ids).distinct()


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    return overlap_report(cross_split_overlaps(table(spark, folder, "corpus_lines"), table(spark, folder, "data_configs")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = format_variants(table(spark, folder, "sft_samples"), table(spark, folder, "sft_raw"))
    return found.where("sample_id <> first_id").select("first_id", "sample_id")


def p2_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    return collapsed(table(spark, folder, "sft_samples"), table(spark, folder, "sft_raw"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs_in_groups(near_duplicates(table(spark, folder, "sft_samples")))


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "sft_samples")).select("sample_id", "group_id")


def p3_representatives(spark: SparkSession, folder: str) -> DataFrame:
    return representative_pairs(near_duplicates(table(spark, folder, "sft_samples")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    cut = split_responses(table(spark, folder, "sft_samples"), table(spark, folder, "data_configs"), with_text=False)
    return cut.where("piece_no = 1").select("sample_id")


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_responses(table(spark, folder, "sft_samples"), table(spark, folder, "data_configs"))


def p4_restored(spark: SparkSession, folder: str) -> DataFrame:
    """(sample_id, pieces_fit, restored): the text that the pieces make without their overlaps, as an MD5, and whether all are within the limit."""
    rows = F.array_sort(F.collect_list(F.struct("piece_no", "start", "end", "text")))
    each = p4_pieces(spark, folder).groupBy("sample_id").agg(rows.alias("p"))
    new = F.transform("p", lambda x, i: F.when(i == 0, x["text"]).otherwise(F.substring(x["text"], F.get(F.col("p"), i - 1)["end"] - x["start"] + 1, F.length(x["text"]))))
    fits = F.forall("p", lambda x: F.length(x["text"]) == x["end"] - x["start"])
    limits = limits_by_path(table(spark, folder, "data_configs"))  # six rows
    limit = table(spark, folder, "sft_samples").join(limits, "path").select("sample_id", "max_length")
    longest = F.array_max(F.transform("p", lambda x: F.length(x["text"])))
    return each.join(limit, "sample_id").select("sample_id", (fits & (longest <= F.col("max_length"))).alias("pieces_fit"), F.md5(F.array_join(new, "")).alias("restored"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return response_defects(table(spark, folder, "sft_samples"), table(spark, folder, "common_words"))


def _capacity(spark: SparkSession, folder: str) -> int:
    """The max_length of the config whose training data are many files."""
    return table(spark, folder, "data_configs").where("name = 'pretrain_multi'").first().max_length


def p6_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), _capacity(spark, folder))


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """For the max_length of every data config: sequences after the search, without it, and the least number possible."""
    counts = counted(table(spark, folder, "documents"))
    sizes = sorted({r.max_length for r in table(spark, folder, "data_configs").where("max_length > 0").select("max_length").distinct().collect()})

    def rows(n: int) -> DataFrame:
        with_search, without = (packing_report(pack_counts(counts, n, search=x), n).withColumn("max_length", F.lit(n)) for x in (True, False))
        return with_search.join(without.select("max_length", F.col("sequences").alias("without_search")), "max_length")

    each = [rows(n) for n in sizes]
    return functools.reduce(DataFrame.unionByName, each)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return text_quality(table(spark, folder, "documents"), table(spark, folder, "common_words"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return not_prose(p8_statistics(spark, folder))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_report": p1_report, "p2_found": p2_found, "p2_collapsed": p2_collapsed, "p3_found": p3_found, "p3_groups": p3_groups, "p3_representatives": p3_representatives, "p4_found": p4_found, "p4_pieces": p4_pieces, "p4_restored": p4_restored, "p5_found": p5_found, "p6_sequences": p6_sequences, "p6_report": p6_report, "p7_found": p7_found, "p8_statistics": p8_statistics, "p8_found": p8_found}


def oracle_sql() -> dict[str, str]:
    return {
        "p4_restored": """
            WITH limits AS (
              SELECT path, min(max_length) AS max_length FROM (
                SELECT train_path AS path, max_length FROM data_configs UNION ALL
                SELECT val_path, max_length FROM data_configs UNION ALL
                SELECT test_path, max_length FROM data_configs) WHERE max_length > 0 GROUP BY path)
            SELECT sample_id, true AS pieces_fit, md5(response) AS restored FROM sft_samples JOIN limits USING (path) WHERE length(response) > max_length""",
        "p4_found": """
            WITH limits AS (
              SELECT path, min(max_length) AS max_length FROM (
                SELECT train_path AS path, max_length FROM data_configs UNION ALL
                SELECT val_path, max_length FROM data_configs UNION ALL
                SELECT test_path, max_length FROM data_configs) WHERE max_length > 0 GROUP BY path)
            SELECT sample_id FROM sft_samples JOIN limits USING (path) WHERE length(response) > max_length""",
    }
