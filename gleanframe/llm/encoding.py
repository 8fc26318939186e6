"""Problem 7: the corpus as token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanframe.llm.tokens import decode, encode, encode_with_offsets, misplaced, tokenizer_path
from gleanframe.sources.tables import table

TOKENIZER = "byte_bpe_50k"


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode(table(spark, folder, "documents", ["doc_id", "text"]), "doc_id", "text", tokenizer_path(TOKENIZER))


def p7_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """The texts again, from their ids."""
    return decode(p7_ids(spark, folder), "doc_id", "ids", tokenizer_path(TOKENIZER))


def p7_span_totals(spark: SparkSession, folder: str) -> DataFrame:
    """For each document with tokens, their number and the last character that they cover, which is the text's length."""
    documents = table(spark, folder, "documents", ["doc_id", "text"])
    return encode_with_offsets(documents, "doc_id", "text", tokenizer_path(TOKENIZER)).groupBy("doc_id").agg(
        F.min("first_char").cast("bigint").alias("first_char"), F.max("end_char").cast("bigint").alias("end_char")
    )


def p7_misplaced(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens whose bytes aren't those of the slice of the text that their offsets name. There are none."""
    return misplaced(table(spark, folder, "documents", ["doc_id", "text"]), "doc_id", "text", tokenizer_path(TOKENIZER))


QUERIES = {"p7_ids": p7_ids, "p7_decoded": p7_decoded, "p7_span_totals": p7_span_totals, "p7_misplaced": p7_misplaced}
SQL = {
    "p7_misplaced": "select doc_id, cast(0 as int) as position from documents where false",
    "p7_decoded": "select doc_id, coalesce(text, '') as text from documents",
    "p7_span_totals": "select doc_id, cast(0 as bigint) as first_char, cast(length(text) as bigint) as end_char from documents where text <> ''",
}
