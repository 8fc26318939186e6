"""Problem 9: text statistics, and which documents are no prose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanframe.llm.quality import classify, document_statistics, outlierness, prose_model
from gleanframe.llm.text_stats import STATISTICS
from gleanframe.session import cut
from gleanframe.sources.tables import table


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents", ["doc_id", "text", "lang"])
    stats = cut(document_statistics(documents, "doc_id", "text", "lang", table(spark, folder, "common_words", ["lang", "word"])))
    return outlierness(stats, "doc_id", prose_model(stats))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "document_labels", ["doc_id", "text_kind"])
    return classify(_scored(spark, folder), labels, "doc_id", "text_kind").where("text_kind <> 'prose'")


def p9_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """The five statistics of every document, its distance from prose, what each statistic adds to the squared distance, and
    the one that adds most."""
    scored = _scored(spark, folder)
    named = {n: F.round(F.col("stats")[STATISTICS.index(n)], 6) for n in STATISTICS[1:5]}
    names = F.array(*map(F.lit, STATISTICS))
    return scored.select(
        "doc_id",
        F.round(F.expm1(F.col("stats")[0])).cast("bigint").alias("word_count"),
        *(c.alias(n) for n, c in named.items()),
        "language",
        F.round("distance", 6).alias("distance"),
        F.map_from_arrays(names, F.transform("contributions", lambda c: F.round(c, 6))).alias("contributions"),
        F.element_at(names, F.array_position("contributions", F.array_max("contributions")).cast("int")).alias("most_unusual"),
    )


QUERIES = {"p9_found": p9_found, "p9_statistics": p9_statistics}
SQL: dict[str, str] = {}
