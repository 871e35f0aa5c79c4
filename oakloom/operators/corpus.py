"""Lines of a corpus: cleaned, counted, grouped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oakloom.functions.text import lines, strip, within_band


def explode_lines(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, line): the lines of each text from 0; null and empty texts have none."""
    return texts.select(key, F.posexplode(lines(text)).alias("line_no", "line"))


def clean_lines(source: DataFrame, line: str = "line", least: int = 10, most: int = 10_000) -> DataFrame:
    """Lines stripped, then kept where their length lies in the band; other columns stay."""
    return source.withColumn(line, strip(line)).where(within_band(line, least, most))


def clean_stats(source: DataFrame, by: list[str | Column], line: str = "line", least: int = 10, most: int = 10_000) -> DataFrame:
    """(by, lines_in, lines_out, chars_out) in one pass: lines before and after cleaning."""
    stripped = strip(line)
    kept = within_band(stripped, least, most)
    return source.groupBy(*by).agg(
        F.count(F.lit(1)).alias("lines_in"),
        F.count_if(kept).alias("lines_out"),
        F.coalesce(F.sum(F.when(kept, F.length(stripped).cast("bigint"))), F.lit(0).cast("bigint")).alias("chars_out"),
    )
