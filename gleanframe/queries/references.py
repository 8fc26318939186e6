"""Problem 3: references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanframe.operators.references import Reference, live_parents, orphan_references, orphan_report
from gleanframe.sources.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    read = lambda name, *columns: table(spark, folder, name, list(columns))
    removed = read("removed_keys", "table_name", "key_value", "removed_at")
    return orphan_references(
        [
            Reference("virtual_folder_photos", read("virtual_folder_photos", "folder_id", "photo_id", "added_at"), "folder_id", "photo_id", "added_at", "photos"),
            Reference("image_feature_embedding_dependencies", read("image_feature_embedding_dependencies", "result_id", "source_result_id", "created_at"), "result_id", "source_result_id", "created_at", "image_embedding_results"),
            Reference("image_embedding_results", read("image_embedding_results", "result_id", "profile_id", "created_at"), "result_id", "profile_id", "created_at", "image_embedding_profiles"),
        ],
        [
            live_parents("photos", read("photos", "photo_id", "created_at"), "photo_id", "created_at", removed),
            live_parents("image_embedding_results", read("image_embedding_results", "result_id", "created_at"), "result_id", "created_at", removed),
            live_parents("image_embedding_profiles", read("image_embedding_profiles", "profile_id", "created_at"), "profile_id", "created_at", removed),
        ],
    )


def p3_by_month(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_report(p3_found(spark, folder))


_FOUND = """
with gone as (
  select lower(trim(table_name)) as target, lower(trim(key_value)) as k, max(removed_at) as removed_at
  from removed_keys where trim(key_value) <> '' group by 1, 2),
targets as (
  select 'photos' as target, lower(trim(photo_id)) as k, min(created_at) as created_at from photos where trim(photo_id) <> '' group by 1, 2
  union all
  select 'image_embedding_results', lower(trim(result_id)), min(created_at) from image_embedding_results where trim(result_id) <> '' group by 1, 2
  union all
  select 'image_embedding_profiles', lower(trim(profile_id)), min(created_at) from image_embedding_profiles where trim(profile_id) <> '' group by 1, 2),
refs as (
  select 'virtual_folder_photos' as table_name, 'photos' as target, lower(trim(folder_id)) as record_key, lower(trim(photo_id)) as ref_key, added_at as at
  from virtual_folder_photos where trim(photo_id) <> ''
  union all
  select 'image_feature_embedding_dependencies', 'image_embedding_results', lower(trim(result_id)), lower(trim(source_result_id)), created_at
  from image_feature_embedding_dependencies where trim(source_result_id) <> ''
  union all
  select 'image_embedding_results', 'image_embedding_profiles', lower(trim(result_id)), lower(trim(profile_id)), created_at
  from image_embedding_results where trim(profile_id) <> '')
select distinct r.table_name, nullif(r.record_key, '') as record_key, r.ref_key,
       coalesce(strftime(r.at, '%Y-%m'), 'unknown') as period_month
from refs r left join targets t on t.target = r.target and t.k = r.ref_key
left join gone g on g.target = r.target and g.k = r.ref_key
where t.k is null or g.removed_at >= t.created_at or (g.removed_at is not null and t.created_at is null) or t.created_at > r.at
"""

QUERIES = {"p3_found": p3_found, "p3_by_month": p3_by_month}
SQL = {
    "p3_found": _FOUND,
    "p3_by_month": f"""select table_name, period_month, count(*) as "references", count(distinct record_key) as records,
       count(distinct ref_key) as missing_keys from ({_FOUND}) group by 1, 2""",
}
