"""Folders as scopes: many-to-many membership, unions, intersections, and what adding members would do."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanframe.functions.ids import clean_id


def memberships(rows: DataFrame, folder: str = "folder_id", item: str = "photo_id") -> DataFrame:
    """(folder_id, item), tidy and distinct; rows that refer to nothing are left out."""
    tidy = rows.select(clean_id(folder).alias("folder_id"), clean_id(item).alias("item"))
    return tidy.where("folder_id is not null and item is not null").distinct()


def scope(members: DataFrame, folders: list[str] | None, mode: str = "union", everything: DataFrame | None = None) -> DataFrame:
    """(item) in any (union) or every one (intersection) of the folders; without folders the whole of ``everything``."""
    if not folders:
        if everything is None:
            raise ValueError("no folders and no whole")
        return everything.select("item").distinct()
    wanted = sorted(set(folders))
    chosen = members.where(F.col("folder_id").isin(wanted))
    if mode == "union":
        return chosen.select("item").distinct()
    return chosen.groupBy("item").agg(F.count_distinct("folder_id").alias("n")).where(F.col("n") == len(wanted)).select("item")


def folder_sizes(folders: DataFrame, members: DataFrame) -> DataFrame:
    """(folder_id, members), 0 for an empty folder."""
    n = members.groupBy("folder_id").agg(F.count(F.lit(1)).alias("members"))
    return folders.select(clean_id("folder_id").alias("folder_id")).distinct().join(n, "folder_id", "left").na.fill(0, ["members"])


def addition_counts(members: DataFrame, folder_id: str, asked: DataFrame) -> DataFrame:
    """(requested, unique_items, duplicates, added, unchanged) of adding ``asked`` (item) to a folder."""
    there = members.where(F.col("folder_id") == folder_id).select("item", F.lit(1).alias("_there"))
    one = asked.groupBy("item").agg(F.count(F.lit(1)).alias("n")).join(there, "item", "left")
    return one.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("requested"), F.count(F.lit(1)).alias("unique_items"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.count_if(F.col("_there").isNull()).alias("added"), F.count_if(F.col("_there").isNotNull()).alias("unchanged"),
    )


def not_offered(selected: DataFrame, offered: DataFrame) -> DataFrame:
    """Selected items that weren't offered; a selection with any is refused."""
    return selected.select("item").join(offered.select("item"), "item", "left_anti").distinct()


def item_folders(members: DataFrame, items: DataFrame, folders: DataFrame) -> DataFrame:
    """(folder_id) of the known folders that hold any of ``items`` (item)."""
    holding = members.join(items.select("item"), "item", "left_semi").select("folder_id").distinct()
    return folders.select(clean_id("folder_id").alias("folder_id")).where("folder_id is not null").distinct().join(holding, "folder_id", "left_semi")


def first_positions(lists: DataFrame, group: str, item: str, position: str) -> DataFrame:
    """(group, item, place): each list without repetitions, in the order of first mention, from 1. Rows without an item are left out."""
    first = lists.where(F.col(item).isNotNull()).groupBy(group, item).agg(F.min(position).alias("_at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("_at", item))).drop("_at")


def all_of(*lists: DataFrame) -> DataFrame:
    """The rows of lists one after another, repetitions included, with ``origin``: the number of their list from 0."""
    found = None
    for n, rows in enumerate(lists):
        part = rows.withColumn("origin", F.lit(n))
        found = part if found is None else found.unionByName(part)
    return found


def create_folder(folders: DataFrame, folder_id: str, name: str, key: str) -> DataFrame:
    """``folders`` (folder_id, name, name_key) with one more; a name whose key is taken is refused."""
    if not folders.where(F.col("name_key") == key).isEmpty():
        raise ValueError("a folder of that name exists")
    return folders.select("folder_id", "name", "name_key").unionByName(folders.sparkSession.createDataFrame([(folder_id, name, key)], "folder_id string, name string, name_key string"))


def rename_folder(folders: DataFrame, folder_id: str, name: str, key: str) -> tuple[DataFrame, dict[str, int]]:
    """The folders after renaming, and (renamed, unchanged); another folder's name is refused, an unknown folder too."""
    there = folders.where((F.col("folder_id") == folder_id) | (F.col("name_key") == key)).select("folder_id", "name").collect()  # two at most
    own = [r["name"] for r in there if r["folder_id"] == folder_id]
    if not own:
        raise ValueError("no such folder")
    if len(there) > len(own):
        raise ValueError("a folder of that name exists")
    changed = int(own[0] != name)
    mine = F.col("folder_id") == folder_id
    renamed = folders.withColumns({"name": F.when(mine, name).otherwise(F.col("name")), "name_key": F.when(mine, key).otherwise(F.col("name_key"))})
    return renamed, {"renamed": changed, "unchanged": 1 - changed}


def delete_folder(folders: DataFrame, members: DataFrame, folder_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Folders and memberships without a folder, and the counts (deleted, removed) as a row; the items stay."""
    gone = folders.where(F.col("folder_id") == folder_id).agg(F.count(F.lit(1)).alias("deleted"))
    removed = members.where(F.col("folder_id") == folder_id).agg(F.count(F.lit(1)).alias("removed"))
    return folders.where(F.col("folder_id") != folder_id), members.where(F.col("folder_id") != folder_id), gone.crossJoin(removed)  # a row each


def removal_counts(members: DataFrame, folder_id: str, asked: DataFrame) -> DataFrame:
    """(requested, unique_items, duplicates, removed, unchanged) of taking ``asked`` (item) out of a folder."""
    added = addition_counts(members, folder_id, asked)
    return added.select("requested", "unique_items", "duplicates", F.col("unchanged").alias("removed"), F.col("added").alias("unchanged"))


def without_items(members: DataFrame, folder_id: str, asked: DataFrame) -> DataFrame:
    """Memberships after taking ``asked`` (item) out of a folder."""
    inside = F.col("folder_id") == folder_id
    return members.where(~inside).unionByName(members.where(inside).join(asked.select("item"), "item", "left_anti").select(*members.columns))
