"""Text as columns: lines, stripping, lengths, templates. Built-in expressions only, but for ``human_number``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The line ends of str.splitlines and the 29 white-space characters of str.strip, as Java classes.
LINE_END = "\\r\\n|[\\n\\x0B\\f\\r\\x1C\\x1D\\x1E\\x85\\u2028\\u2029]"
SPACE = "[\\t-\\r\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"
SPACES = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
# The prompt template of fine-tuning records.
TEMPLATE_HEAD, TEMPLATE_TAIL = "### Instruction:\n", "\n\n### Response:\n"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lines(text: Column | str) -> Column:
    """Array of a text's lines as splitlines gives them: no empty line after a final line end; null for null."""
    parts = F.split(_col(text), LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def strip(text: Column | str) -> Column:
    """Without white space at both ends, by Unicode; ``trim`` by itself would take spaces only. Reads the ends alone, unlike a pattern."""
    return F.btrim(_col(text), F.lit(SPACES))


def within_band(text: Column | str, least: int = 10, most: int = 10_000) -> Column:
    """Whether the number of code points lies in the closed band; null counts as outside."""
    return F.coalesce(F.length(_col(text)).between(least, most), F.lit(False))


def word_count(text: Column | str) -> Column:
    """Number of words between white space; 0 for null."""
    parts = F.split(F.coalesce(_col(text), F.lit("")), f"{SPACE}+")
    return F.size(F.filter(parts, lambda x: x != "")).cast("bigint")


def prompt_text(prompt: Column | str) -> Column:
    """The prompt in its template."""
    return F.concat(F.lit(TEMPLATE_HEAD), _col(prompt), F.lit(TEMPLATE_TAIL))


def full_text(prompt: Column | str, response: Column | str, end: str = "") -> Column:
    return F.concat(prompt_text(prompt), _col(response), F.lit(end))


def echo_answer(text: Column | str) -> Column:
    """The answer of the placeholder model: it names the first 50 code points of the input."""
    return F.concat(F.lit("[Model output for: "), F.left(_col(text), F.lit(50)), F.lit("...]"))


def without_prefix(text: Column | str, prompt: Column | str) -> Column:
    """Generated text without its prompt, stripped."""
    return strip(F.substring(_col(text), F.length(_col(prompt)) + 1, F.length(_col(text))))


@F.pandas_udf(StringType())
def human_number(n: pd.Series) -> pd.Series:
    """4.12M, 4.50B, 1.00K, 999. Rounds half to even on the binary value, which format_string doesn't; null stays null."""

    def one(x):
        if pd.isna(x):
            return None
        for size, unit in ((1_000_000_000, "B"), (1_000_000, "M"), (1_000, "K")):
            if x >= size:
                return f"{x / size:.2f}{unit}"
        return str(int(x))

    return n.map(one).astype(object)
