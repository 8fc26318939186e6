"""Folding and searching text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


#: Fixed value: the label of a size that isn't known.
UNKNOWN_SIZE = "未知"


@F.pandas_udf(StringType())
def _fold(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", unicodedata.normalize("NFC", x).casefold()))


@F.pandas_udf(StringType())
def _fold_recognised(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split()))


def _plain(column: Column) -> Column:
    return ~column.rlike("[^\\x00-\\x7F]")


def fold_text(column: Column) -> Column:
    """Composed and case-folded text. Plain ASCII stays in the JVM; Python sees only the rest."""
    return F.when(_plain(column), F.lower(column)).otherwise(_fold(F.when(~_plain(column), column)))


def fold_recognised(column: Column) -> Column:
    """Recognised text as it is searched: compatibility-composed, case-folded, blanks collapsed."""
    return _fold_recognised(column)


def fold_literal(text: str) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())


def contains(text: Column, literal: str) -> Column:
    """Whether ``text`` has ``literal`` as it stands: no character is a wildcard."""
    return F.instr(text, literal) > 0


def snippet(text: Column, literal: str) -> Column:
    """160 characters from up to 40 before the first occurrence, NULL without one."""
    at = F.instr(text, literal)
    return F.when(at > 0, F.substr(text, F.greatest(F.lit(1), at - 40), F.lit(160)))


def file_name(path: Column) -> Column:
    """The last part of a Windows or POSIX path."""
    return F.element_at(F.split(path, "[\\\\/]"), -1)


def size_label(size: Column) -> Column:
    """Bytes as people read them: in KB with one decimal, from 1 MB on in MB with two, halves to the even digit; the fixed word for unknown sizes."""
    label = F.when(size >= 1 << 20, F.format_string("%.2f MB", F.bround(size / (1 << 20), 2))).otherwise(F.format_string("%.1f KB", F.bround(size / 1024, 1)))
    return F.when(size >= 0, label).otherwise(UNKNOWN_SIZE)


def escaped(text: Column) -> Column:
    """Text that is safe in HTML, quotes included."""
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def leading_blocks(texts: Column, most_blocks: int, most_chars: int) -> Column:
    """The first blocks (array of texts without NULLs), at most so many, whose text of lines has at most so many characters."""
    start = F.struct(F.lit(0).alias("kept"), F.lit(0).alias("chars"), F.lit(False).alias("full"))

    def add(state: Column, text: Column) -> Column:
        chars = state["chars"] + F.length(text) + F.when(state["kept"] > 0, 1).otherwise(0)
        full = state["full"] | (state["kept"] >= most_blocks) | (chars > most_chars)
        return F.struct(
            F.when(full, state["kept"]).otherwise(state["kept"] + 1).alias("kept"), F.when(full, state["chars"]).otherwise(chars).alias("chars"), full.alias("full")
        )

    return F.slice(texts, F.lit(1), F.aggregate(texts, start, add)["kept"])
