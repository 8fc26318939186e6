"""Problem 4: objects in the lists of nested documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanframe.functions.ids import clean_id
from gleanframe.operators.current import current_rows
from gleanframe.operators.shredding import flat_table, shred
from gleanframe.sources.tables import table

#: Fields that are lists in these documents.
LIST_FIELDS = ("items", "batches", "previous_attempts", "calls", "edits", "steps", "regions")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    photos = current_rows(
        table(spark, folder, "photos").select(clean_id("photo_id").alias("record_key"), "updated_at", F.col("metadata_json").alias("document")),
        "record_key",
        [F.col("updated_at").desc_nulls_last(), F.col("document").desc_nulls_last()],
    ).select(F.lit("metadata_json").alias("source_field"), "record_key", "document")
    runs = current_rows(
        table(spark, folder, "ai_review_runs").select(clean_id("run_id").alias("record_key"), "revision", "updated_at", "plan_json", "approval_history_json"),
        "record_key",
        [F.col("revision").desc_nulls_last(), F.col("updated_at").desc_nulls_last(), F.col("plan_json").desc_nulls_last(), F.col("approval_history_json").desc_nulls_last()],
    ).select(
        F.expr("stack(2, 'plan_json', plan_json, 'approval_history_json', approval_history_json) as (source_field, document)"),
        "record_key",
    ).select("source_field", "record_key", "document")
    return photos.unionByName(runs).where("document is not null")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return shred(_documents(spark, folder), LIST_FIELDS, ["approval_history_json"]).select(
        "source_field", "record_key", "parent_path", "node_path"
    )


def p4_edit_steps(spark: SparkSession, folder: str) -> DataFrame:
    """The table of editing steps, linked to their edits."""
    rows = shred(_documents(spark, folder).where("source_field = 'metadata_json'"), LIST_FIELDS, with_values=True)
    return flat_table(rows, "$.edits[].steps[]", {"op": "string", "amount": "double", "mask.feather": "int"})


def p4_loose(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose parent is no row of the same document: there are none, every row can be joined with its parent."""
    rows = p4_found(spark, folder)
    parents = rows.select("source_field", "record_key", F.col("node_path").alias("parent_path"))
    return rows.where("parent_path <> '$'").join(parents, ["source_field", "record_key", "parent_path"], "left_anti").select("source_field", "record_key", "node_path")


QUERIES = {"p4_found": p4_found, "p4_edit_steps": p4_edit_steps, "p4_loose": p4_loose}
SQL = {"p4_loose": "select '' as source_field, run_id as record_key, '' as node_path from ai_review_runs where false"}
