"""Problem 8: documents in token windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanframe.llm.encoding import TOKENIZER
from gleanframe.llm.packing import pack_documents, utilisation
from gleanframe.llm.tokens import count_tokens, tokenizer_path
from gleanframe.session import cut
from gleanframe.sources.tables import table


def _windows(spark: SparkSession, folder: str) -> dict[int, int]:
    rows = table(spark, folder, "token_windows").where("capacity_tokens > 0 and window_id is not null").collect()
    return {r["window_id"]: r["capacity_tokens"] for r in rows}


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents", ["doc_id", "text"])
    tokens = count_tokens(documents, "doc_id", "text", tokenizer_path(TOKENIZER))
    packed = pack_documents(tokens, _windows(spark, folder))
    return packed.withColumnsRenamed({"first_unit": "first_token", "n_units": "n_tokens"})


def p8_utilisation(spark: SparkSession, folder: str) -> DataFrame:
    return utilisation(p8_containers(spark, folder).withColumnRenamed("n_tokens", "n_units"), _windows(spark, folder))


def p8_faults(spark: SparkSession, folder: str) -> DataFrame:
    """What no packing may have: containers that hold more than their capacity, documents split though they fit, pieces that
    don't follow one another, and documents without a text that are in a container, or the other way round. There are none."""
    documents = table(spark, folder, "documents", ["doc_id", "text"])
    windows = table(spark, folder, "token_windows").where("capacity_tokens > 0 and window_id is not null").select("window_id", "capacity_tokens")
    packed = cut(p8_containers(spark, folder)).join(F.broadcast(windows), "window_id")  # a row a window
    fault = lambda df, name, what: df.select(F.lit(what).alias("fault"), "window_id", F.col(name).alias("id"))
    filled = packed.groupBy("window_id", "container_id", "capacity_tokens").agg(F.sum("n_tokens").alias("n")).where("n > capacity_tokens or n < 1")
    pieces = packed.groupBy("window_id", "doc_id", "capacity_tokens").agg(
        F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces"), F.max("piece_no").alias("last"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"), F.count_distinct("first_token").alias("starts")
    )
    split = pieces.where("pieces > 1 and n <= capacity_tokens or pieces <> last + 1 or n <> end or starts <> pieces")
    wanted = documents.where("text <> ''").select("doc_id").crossJoin(F.broadcast(windows.select("window_id")))
    have = pieces.select("doc_id", "window_id")
    lost = wanted.join(have, ["doc_id", "window_id"], "left_anti").unionByName(have.join(wanted, ["doc_id", "window_id"], "left_anti"))
    return fault(filled, "container_id", "overfull").unionByName(fault(split, "doc_id", "split")).unionByName(fault(lost, "doc_id", "lost"))


QUERIES = {"p8_containers": p8_containers, "p8_utilisation": p8_utilisation, "p8_faults": p8_faults}
SQL = {"p8_faults": "select 'overfull' as fault, window_id, cast(0 as bigint) as id from token_windows where false"}
