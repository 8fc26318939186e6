"""Whole cells, coverage through dependencies, ranks by direction, compositions, folder changes, dates of saved metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanframe.functions.dates import date_bucket, saved_date
from gleanframe.functions.ids import clean_id
from gleanframe.functions.text import contains, escaped, fold_literal, fold_recognised, leading_blocks, size_label
from gleanframe.functions.vectors import vector_status
from gleanframe.operators import duplicate_scan as ds
from gleanframe.operators import geometry as g
from gleanframe.operators import predicates as p
from gleanframe.operators import reviews as r
from gleanframe.operators import scopes as sc
from gleanframe.operators import search as s
from gleanframe.operators import versions as v
from gleanframe.operators.current import current_rows
from gleanframe.operators.ordering import average_rank_percentile, monotone_times, numbered
from gleanframe.plans.encoders import hashed_encoder, semantic_ranks
from gleanframe.queries.conditions import _CELLS, condition_cells
from gleanframe.queries.duplicates import REFERENCE_DISTANCE, _photo_prints, current_photos
from gleanframe.queries.store import _DIFF, _members, _two_folders, scan_diff
from gleanframe.sources.tables import table


def _dated(spark, folder):
    photos = current_photos(spark, folder, "metadata_json", "ingest_state")
    text, reason = saved_date(F.col("ingest_state"), F.col("metadata_json"))
    return photos.select("photo_id", text.alias("taken"), reason.alias("reason"))


def photo_date_folders(spark, folder):
    """Photos by the year, month and day of their saved EXIF date."""
    dated = _dated(spark, folder).where("reason is null")
    each = F.array(*(F.struct(F.lit(k).alias("granularity"), date_bucket(F.col("taken"), k).alias("folder")) for k in ("year", "month", "day")))
    return dated.select(F.inline(each)).groupBy("granularity", "folder").agg(F.count(F.lit(1)).alias("photos"))


def photo_date_skips(spark, folder):
    return _dated(spark, folder).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("photos"))


def date_folder_plan(spark, folder):
    """What putting photos into folders of their months would do: a folder's photos that are in any folder of the album already, and those that aren't."""
    dated = _dated(spark, folder).where("reason is null").select(F.col("photo_id").alias("item"), date_bucket(F.col("taken"), "month").alias("name"))
    inside = _members(spark, folder).select("item").distinct().withColumn("there", F.lit(1))
    return dated.join(inside, "item", "left").groupBy("name").agg(
        F.count(F.lit(1)).alias("requested"), F.count("there").alias("elsewhere"), F.count_if(F.col("there").isNull()).alias("unplaced")
    )


_INPUTS, _RECORDED = ["content_version", "thumbnail_profile"], ["vector_hash", "input_image_hash"]


def _dependencies(spark, folder):
    features = table(spark, folder, "image_feature_embedding_dependencies", ["result_id", "photo_id", "source_result_id", *_INPUTS, *_RECORDED, "created_at"])
    rows = features.select(clean_id("result_id").alias("result_id"), clean_id("photo_id").alias("item"), clean_id("source_result_id").alias("source_id"), *_INPUTS, *_RECORDED, "created_at")
    latest = current_rows(rows.distinct(), "result_id", [F.col("created_at").desc_nulls_last(), F.col("source_id").desc_nulls_last(), F.col("content_version").desc_nulls_last(), F.col("vector_hash").desc_nulls_last()])
    photos = current_photos(spark, folder, "ingest_state", *_INPUTS).select(F.col("photo_id").alias("item"), (F.col("ingest_state") == "available").alias("usable"), *_INPUTS)
    results = table(spark, folder, "image_embedding_results", ["result_id", "vector", *_INPUTS, *_RECORDED, "created_at"])
    sources = results.select(clean_id("result_id").alias("source_id"), (vector_status(F.col("vector"), 64) == "ready").alias("valid"), *_INPUTS, *_RECORDED, "created_at")
    sources = current_rows(sources, "source_id", [F.col("created_at").desc_nulls_last(), F.col("valid").desc_nulls_last(), F.col("content_version").desc_nulls_last(), F.col("vector_hash").desc_nulls_last()])
    return v.dependency_coverage(latest, photos, sources, _INPUTS, _RECORDED)


def dependency_coverage(spark, folder):
    """Each scene result: whether it is ready, and what is wrong with its source."""
    return _dependencies(spark, folder)


def dependency_gaps(spark, folder):
    """The cells that scene results' coverage gives, and what a run does about them."""
    gap = p.coverage_unknown(F.col("coverage"), F.lit(True), F.col("upstream"))
    planned = v.plan_actions(_dependencies(spark, folder)).select("action", gap["status"].alias("status"), gap["reason"].alias("reason"))
    return planned.groupBy("action", "status", "reason").agg(F.count(F.lit(1)).alias("results"))


def dependency_closure(spark, folder):
    """What each photo's scene results reach: their sources, step by step, from features to vectors to profiles."""
    features = table(spark, folder, "image_feature_embedding_dependencies", ["result_id", "source_result_id"]).select(clean_id("result_id").alias("source"), clean_id("source_result_id").alias("target"))
    results = table(spark, folder, "image_embedding_results", ["result_id", "profile_id"]).select(clean_id("result_id").alias("source"), clean_id("profile_id").alias("target"))
    edges = features.unionByName(results).where("source is not null and target is not null").distinct()
    return v.reachable(edges, features.select(F.col("source").alias("node")).where("node is not null")).groupBy("steps").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("node").alias("nodes"))


def rank_percentiles(spark, folder):
    """Best values of users by type of event: of purchases lower ones are better, of logins any value counts alike."""
    rows = table(spark, folder, "events", ["user_id", "event_type", "value"]).where("value is not null and not isnan(value)")
    best = rows.groupBy(F.col("user_id").alias("item"), F.col("event_type").alias("condition_id")).agg(F.max("value").alias("raw_score"))
    kinds = best.select("condition_id").distinct().orderBy("condition_id").limit(2).collect()  # two names
    low, exact = (F.col("condition_id") == (kinds[i]["condition_id"] if len(kinds) > i else None) for i in range(2))
    found = average_rank_percentile(best, "condition_id", "item", "raw_score", lower=low, exact=exact)
    return found.select("item", "condition_id", F.round("normalized", 6).alias("normalized"))


def position_cells(spark, folder):
    """Whole cells of the condition that the main subject is in the left third; pictures without one are unknown."""
    objects = _boxes(spark, folder)
    c = g.composition(F.col("objects"))
    found = objects.select("item", F.col("result"), c.alias("c"))
    matched = p.horizontal_third(F.col("c.center_x")) == "left"
    evidence = F.struct(F.round("c.center_x", 6).alias("center_x"), F.round("c.center_y", 6).alias("center_y"))
    gap = F.when(F.col("c.subject_index").isNull(), F.struct(F.lit("unknown_invalid").alias("status"), F.lit("no_primary_subject").alias("reason")))
    cell = p.whole_cell(matched, "exact", "higher", F.array("result"), evidence, unknown=gap)
    return found.select("item", F.inline(F.array(cell))).withColumns({"sources": F.array_join("sources", ","), "evidence": F.to_json("evidence")})


def _boxes(spark, folder):
    """Orders as pictures, their lines as objects; lines that were returned aren't objects."""
    x, y = (F.col("l_partkey") % 50) / 100, (F.col("l_suppkey") % 50) / 100
    box = F.array(x, y, x + F.col("l_quantity") / 100, y + F.col("l_discount") + 0.05)
    rows = table(spark, folder, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag"])
    one = F.when(F.col("l_returnflag") != "R", F.struct(F.col("l_tax").alias("score"), box.alias("box")))
    held = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(one)).alias("objects"))
    return held.select(F.col("l_orderkey").alias("item"), F.concat(F.lit("objects_"), F.col("l_orderkey").cast("string")).alias("result"), "objects")


def compositions(spark, folder):
    """Areas and main subjects of pictures."""
    c = g.composition(F.col("objects"))
    found = _boxes(spark, folder).select("item", c.alias("c"))
    return found.select("item", *(F.round(f"c.{n}", 6).alias(n) for n in ("union_area", "bounding_area", "uncovered_fraction", "center_x", "center_y", "subject_area", "thirds_distance")))


def near_duplicate_hamming(spark, folder):
    """Cells of photos that resemble another's vector: photos without a fingerprint are unknown."""
    photos = _photo_prints(spark, folder)
    unknown = F.when(F.col("content").isNull(), "unknown_invalid").when(F.col("bits").isNull(), "unknown_missing_index")
    scope = photos.select("photo_id", unknown.alias("unknown"), "bits")
    # every photo as a content of its own, so that only fingerprints speak
    cells = ds.cells_of_items(scope.where("unknown is null").withColumn("content", F.col("photo_id")), "photo_id", "content", "bits", REFERENCE_DISTANCE)
    links = ds.item_matches(cells).select("item", F.col("similar_peers").alias("peers"), F.col("best_distance").alias("least_distance"), F.col("best_match").alias("best_peer"))
    return p.near_duplicate_cells(scope, "photo_id", "unknown", links)


def recognised_text(spark, folder):
    """Texts that contain a literal once widths, case and blanks are folded."""
    literal = fold_literal("Market  Stall".replace("  ", " "))
    rows = table(spark, folder, "documents", ["doc_id", "text"]).where("text is not null")
    return rows.where(contains(fold_recognised(F.col("text")), literal)).select("doc_id")


def text_blocks(spark, folder):
    """How much of each text's lines a recogniser of 4 blocks and 200 characters would return."""
    rows = table(spark, folder, "documents", ["doc_id", "text"]).where("text is not null")
    lines = rows.select("doc_id", F.split("text", "\n").alias("lines"))
    kept = lines.select("doc_id", F.size("lines").alias("total"), F.size(leading_blocks(F.col("lines"), 4, 200)).alias("returned"))
    return kept.withColumn("complete", F.col("total") == F.col("returned"))


def size_labels(spark, folder):
    """Sizes of photos as people read them, and their names, safe in HTML."""
    photos = current_photos(spark, folder, "size_bytes", "original_relative_path")
    return photos.select("photo_id", size_label(F.col("size_bytes")).alias("size"), escaped(F.col("original_relative_path")).alias("path"))


def item_folders(spark, folder):
    """The folders that hold a photo of the album's second largest folder."""
    members = _members(spark, folder)
    _, second = _two_folders(members)
    return sc.item_folders(members, members.where(F.col("folder_id") == second), table(spark, folder, "virtual_folders", ["folder_id"]))


def folder_deletion(spark, folder):
    """The counts of deleting the largest folder, and what is left."""
    members = _members(spark, folder)
    folders = table(spark, folder, "virtual_folders", ["folder_id"]).select(clean_id("folder_id").alias("folder_id")).distinct()
    _, kept, counts = sc.delete_folder(folders, members, _two_folders(members)[0])
    return counts.crossJoin(kept.agg(F.count(F.lit(1)).alias("memberships"), F.count_distinct("item").alias("items")))  # a row each


def folder_removal(spark, folder):
    """The counts of taking the second largest folder's photos out of the largest."""
    members = _members(spark, folder)
    first, second = _two_folders(members)
    return sc.removal_counts(members, first, members.where(F.col("folder_id") == second).select("item"))


def ordered_requests(spark, folder):
    """Each folder's photos in the order in which they were first added."""
    rows = table(spark, folder, "virtual_folder_photos", ["folder_id", "photo_id", "added_at"]).select(clean_id("folder_id").alias("folder_id"), clean_id("photo_id").alias("item"), F.coalesce("added_at", F.lit("9999-01-01").cast("timestamp_ntz")).alias("at"))
    return sc.first_positions(rows.where("folder_id is not null"), "folder_id", "item", "at")


def joined_lists(spark, folder):
    """Photos of folders and of the album, listed one after another, by origin."""
    photos = table(spark, folder, "photos", ["photo_id"]).select(clean_id("photo_id").alias("item"))
    return sc.all_of(_members(spark, folder).select("item"), photos).groupBy("origin").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("item").alias("items"))


def strict_times(spark, folder):
    """Events of a user with times that grow strictly, a microsecond at least."""
    rows = table(spark, folder, "events", ["event_id", "user_id", "ts"]).withColumn("ts", F.date_trunc("hour", "ts"))
    placed = monotone_times(rows, "user_id", [F.col("ts"), F.col("event_id")], "ts")
    return placed.select("event_id", F.unix_micros("stamp").alias("micros"))


def batch_results(spark, folder):
    """Labels in the order of their documents' batches of four: results of a run, by batch, place and rater."""
    placed = numbered(table(spark, folder, "documents", ["doc_id"]), [F.col("doc_id")])
    batches = placed.select("doc_id", F.floor((F.col("number") - 1) / 4).alias("batch"))
    labels = table(spark, folder, "document_labels", ["doc_id", "rater", "text_kind"]).distinct()
    joined = labels.join(batches, "doc_id")
    return numbered(joined, [F.col("batch"), F.col("doc_id"), F.col("rater"), F.col("text_kind")], "place").select("place", "batch", "doc_id", "rater", "text_kind")


def attempt_usage(spark, folder):
    """What batches of requests used: the last report of each attempt counts, and a total is complete if all have reported."""
    rows = table(spark, folder, "events", ["user_id", "event_type", "event_id", "value"])
    return r.attempt_totals(rows, "user_id", "event_type", [F.col("event_id")], F.when(F.col("value") > 20, F.floor("value")))


def pool_cells(spark, folder):
    """Every condition's cells of the pool of two semantic conditions and structured matches."""
    return s.pool_cells(condition_cells(spark, folder).where("condition_id <> 'centre'"), 10).select("item", "condition_id", "status", "raw_score")


def scan_changes(spark, folder):
    """Photos whose scan found a change."""
    return scan_diff(spark, folder).where("change <> 'unchanged'")


def semantic_search(spark, folder):
    """The 20 items that are nearest to an encoded text, with ranks and gaps."""
    encoder = hashed_encoder(64)
    rows = table(spark, folder, "embeddings", ["vec_id", "embedding"])
    found = semantic_ranks(rows, "vec_id", "embedding", encoder.vector("море", "the sea at dusk"), 20)
    return found.select("vec_id", "raw_score", "rank", F.round("gap_from_best", 6).alias("gap_from_best"), F.round("gap_to_next", 6).alias("gap_to_next"))


QUERIES = {
    f.__name__: f
    for f in (
        photo_date_folders, photo_date_skips, date_folder_plan, dependency_coverage, dependency_gaps, dependency_closure, rank_percentiles, position_cells, compositions,
        near_duplicate_hamming, recognised_text, text_blocks, size_labels, item_folders, folder_deletion, folder_removal, ordered_requests, joined_lists, strict_times, batch_results, attempt_usage, pool_cells, scan_changes, semantic_search,
    )
}

_CUR = "(select * from (select lower(trim(photo_id)) as pid, *, row_number() over (partition by lower(trim(photo_id)) order by updated_at desc nulls last) as k from photos where trim(photo_id) <> '') where k = 1)"
_M = "m as (select distinct lower(trim(folder_id)) as f, lower(trim(photo_id)) as item from virtual_folder_photos where trim(folder_id) <> '' and trim(photo_id) <> ''), two as (select f, row_number() over (order by count(*) desc, f) as k from m group by 1 order by k limit 2)"
_DATES = rf"""dated as (select pid, t, case when coalesce(ingest_state, '') <> 'available' then 'metadata_unavailable' when coalesce(exif, 'NULL') not in ('NULL', 'OBJECT') then 'invalid_exif_type'
    when coalesce(kind, 'NULL') = 'NULL' or kind = 'VARCHAR' and t = '' then 'missing_datetime_original' when kind <> 'VARCHAR' then 'invalid_datetime_original_type'
    when not regexp_full_match(t, '[0-9]{{4}}:[0-9]{{2}}:[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}') then 'invalid_datetime_original_format'
    when try_strptime(t, '%Y:%m:%d %H:%M:%S') is null or t[1:4] = '0000' then 'invalid_datetime_original_value' end as reason
  from (select pid, ingest_state, json_type(j, '$.exif') as exif, json_type(j, '$.exif.datetime_original') as kind, json_extract_string(j, '$.exif.datetime_original') as t
    from (select pid, ingest_state, case when json_valid(metadata_json) then json(metadata_json) end as j from {_CUR})))"""
_DEPENDENCIES = f"""deps as (select rid, item, case when coalesce(p.ingest_state, '') <> 'available' then 'invalid_input' when upstream is not null then 'dependency_missing'
      when not coalesce(d.c = p.content_version and d.t = p.thumbnail_profile and d.h = s.h and d.i = s.i, false) then 'stale' else 'ready' end as coverage, case when coalesce(p.ingest_state, '') = 'available' then upstream end as upstream
  from (select lower(trim(result_id)) as rid, lower(trim(photo_id)) as item, nullif(lower(trim(source_result_id)), '') as sid, content_version as c, thumbnail_profile as t, vector_hash as h, input_image_hash as i
      from image_feature_embedding_dependencies where trim(result_id) <> '' qualify row_number() over (partition by lower(trim(result_id)) order by created_at desc nulls last, nullif(lower(trim(source_result_id)), '') desc nulls last, content_version desc nulls last, vector_hash desc nulls last) = 1) d
  left join {_CUR} p on p.pid = d.item
  left join (select lower(trim(result_id)) as sid, content_version as c, thumbnail_profile as t, vector_hash as h, input_image_hash as i, ok from (select *, coalesce(len(vector) = 64 and len(list_filter(vector, lambda x: x is null or not isfinite(x))) = 0
        and abs(sqrt(list_sum(list_transform(vector, lambda x: cast(x as double) * x))) - 1) <= 1e-4, false) as ok from image_embedding_results where trim(result_id) <> '')
      qualify row_number() over (partition by lower(trim(result_id)) order by created_at desc nulls last, ok desc, content_version desc nulls last, vector_hash desc nulls last) = 1) s on s.sid = d.sid,
  lateral (select case when s.sid is null then 'missing' when not s.ok then 'invalid_vector' when not coalesce(s.c = p.content_version and s.t = p.thumbnail_profile, false) then 'stale' end as upstream))"""
_OBJECTS = """o as (select l_orderkey as item, (l_partkey % 50) / 100.0::double as x1, (l_suppkey % 50) / 100.0::double as y1, (l_partkey % 50) / 100.0::double + l_quantity / 100 as x2,
    (l_suppkey % 50) / 100.0::double + l_discount + 0.05 as y2, l_tax from lineitem where l_returnflag <> 'R'),
  a as (select distinct l_orderkey as item from lineitem),
  xs as (select item, x as lo, lead(x) over (partition by item order by x) as hi from (select item, x1 as x from o union select item, x2 from o)),
  iv as (select xs.item, lo, hi, y1, y2, max(y2) over (partition by xs.item, lo order by y1, y2 rows between unbounded preceding and 1 preceding) as reach from xs join o on o.item = xs.item and x1 <= lo and x2 >= hi where hi is not null),
  u as (select item, least(1, sum((hi - lo) * greatest(0, y2 - greatest(y1, coalesce(reach, y1))))) as area from iv group by 1),
  b as (select item, (max(x2) - min(x1)) * (max(y2) - min(y1)) as around from o group by 1),
  s as (select item, (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy, (x2 - x1) * (y2 - y1) as size from o qualify row_number() over (partition by item order by (x2 - x1) * (y2 - y1) desc, l_tax desc, x1, y1, x2, y2) = 1)"""
_PRINTS = """latest as (select * from (select lower(trim(photo_id)) as pid, vector, row_number() over (partition by lower(trim(photo_id)) order by created_at desc nulls last, lower(trim(result_id)) desc nulls last) as k
    from image_embedding_results where lower(trim(profile_id)) = (select lower(trim(profile_id)) from image_embedding_profiles where is_default = 1 order by created_at desc, 1 limit 1)) where k = 1),
  prints as (select pid, array_to_string(list_transform(vector, lambda x: case when x > 0 then '1' else '0' end), '') as text from latest
    where len(vector) = 64 and len(list_filter(vector, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0)"""
_EDGES = """e as (select lower(trim(result_id)) as s, lower(trim(source_result_id)) as t from image_feature_embedding_dependencies where trim(result_id) <> '' and trim(source_result_id) <> ''
  union select lower(trim(result_id)), lower(trim(profile_id)) from image_embedding_results where trim(result_id) <> '' and trim(profile_id) <> '')"""

# The axis of the text: the first eight bytes of its SHA-256, modulo 64, are the last six bits of the eighth byte.
_AXIS = "(select (16 * (instr('0123456789abcdef', h[15]) - 1) + instr('0123456789abcdef', h[16]) - 1) % 64 + 1 as axis from (select sha256('the sea at dusk') as h))"
SQL = {
    "pool_cells": f"""with {_CELLS}, near as (select item, row_number() over (partition by condition_id order by raw_score desc, item) as n from cells where status = 'eligible'),
  pool as (select item from cells where status = 'matched' and condition_id <> 'centre' union select item from near where n <= 10)
select item, condition_id, status, raw_score from cells where condition_id <> 'centre' and item in (select item from pool)""",
    "scan_changes": f"select * from ({_DIFF}) where change <> 'unchanged'",
    "semantic_search": f"""with x as (select vec_id, round(cast(embedding[axis] as double) / sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * x))), 6) as raw_score from embeddings, {_AXIS}),
  r as (select *, row_number() over (order by raw_score desc, vec_id) as rank, max(raw_score) over () as best, lead(raw_score) over (order by raw_score desc, vec_id) as next from x)
select vec_id, raw_score, cast(rank as int) as rank, round(best - raw_score, 6) as gap_from_best, round(raw_score - next, 6) as gap_to_next from r where rank <= 20""",
    "photo_date_folders": f"with {_DATES} select granularity, replace(t[1:n], ':', '-') as folder, count(*) as photos from dated, (values ('year', 4), ('month', 7), ('day', 10)) g(granularity, n) where reason is null group by 1, 2",
    "photo_date_skips": f"with {_DATES} select reason, count(*) as photos from dated where reason is not null group by 1",
    "date_folder_plan": f"with {_DATES}, {_M} select replace(t[1:7], ':', '-') as name, count(*) as requested, count(i.item) as elsewhere, count(*) filter (where i.item is null) as unplaced from dated left join (select distinct item from m) i on i.item = pid where reason is null group by 1",
    "dependency_coverage": f"with {_DEPENDENCIES} select rid as result_id, coverage, upstream from deps",
    "dependency_gaps": f"""with {_DEPENDENCIES} select case coverage when 'ready' then 'reuse' when 'stale' then 'compute' else 'skip' end as action,
  case coverage when 'ready' then null when 'stale' then 'unknown_stale' when 'invalid_input' then 'unknown_invalid' else case upstream when 'stale' then 'unknown_stale' when 'invalid_vector' then 'unknown_invalid' else 'unknown_missing_index' end end as status,
  case coverage when 'ready' then null when 'stale' then 'saved_input_changed' when 'invalid_input' then 'invalid_saved_result' else case upstream when 'stale' then 'stale_dependency' when 'invalid_vector' then 'invalid_dependency' else 'missing_dependency' end end as reason, count(*) as results
from deps group by 1, 2, 3""",
    "dependency_closure": f"""with recursive {_EDGES}, starts as (select distinct lower(trim(result_id)) as s from image_feature_embedding_dependencies where trim(result_id) <> ''),
  w(start, node, steps) as (select s, t, 1 from e where s in (select s from starts) union select start, t, steps + 1 from w join e on s = node where steps < 9),
  least_steps as (select start, node, min(steps) as steps from w group by 1, 2) select cast(steps as int) as steps, count(*) as pairs, count(distinct node) as nodes from least_steps group by 1""",
    "rank_percentiles": """with best as (select user_id as item, event_type as condition_id, max(value) as v from events where value is not null and not isnan(value) group by 1, 2),
  kinds as (select condition_id, row_number() over (order by condition_id) as k from (select distinct condition_id from best)),
  ranked as (select item, condition_id, k, count(*) over (partition by condition_id) as n, count(*) over (partition by condition_id, v) as t, rank() over (partition by condition_id order by case when k = 1 then -v else v end) as r from best join kinds using (condition_id))
select item, condition_id, round(case when k = 2 or t = n then 1.0 else (2 * (r - 1) + t - 1) / (2.0 * (n - 1)) end, 6) as normalized from ranked""",
    "position_cells": f"""with {_OBJECTS} select a.item, case when s.item is null then 'unknown_invalid' when cx < 1/3 then 'matched' else 'not_matched' end as status, case when cx < 1/3 then 1.0::double end as raw_score, 'exact' as score_type, 'higher' as direction,
  'objects_' || a.item as sources, case when s.item is not null then '{{"center_x":' || cast(round(cx, 6) as varchar) || ',"center_y":' || cast(round(cy, 6) as varchar) || '}}' end as evidence, case when s.item is null then 'no_primary_subject' end as reason from a left join s using (item)""",
    "compositions": f"""with {_OBJECTS} select item, round(coalesce(area, 0), 6) as union_area, round(coalesce(around, 0), 6) as bounding_area, round(1 - coalesce(area, 0), 6) as uncovered_fraction, round(cx, 6) as center_x, round(cy, 6) as center_y, round(size, 6) as subject_area,
  round(least(sqrt((cx-1/3)**2 + (cy-1/3)**2), sqrt((cx-1/3)**2 + (cy-2/3)**2), sqrt((cx-2/3)**2 + (cy-1/3)**2), sqrt((cx-2/3)**2 + (cy-2/3)**2)), 6) as thirds_distance from a left join u using (item) left join b using (item) left join s using (item)""",
    "near_duplicate_hamming": f"""with {_PRINTS}, scope as (select c.pid, case when not coalesce(c.ingest_state = 'available' and regexp_full_match(c.content_version, '[0-9a-f]{{64}}'), false) then 'unknown_invalid' when p.text is null then 'unknown_missing_index' end as unknown, p.text
    from {_CUR} c left join prints p on p.pid = c.pid),
  none as (select case min(case unknown when 'unknown_invalid' then 1 when 'unknown_missing_index' then 3 end) when 1 then 'unknown_invalid' when 3 then 'unknown_missing_index' else 'not_matched' end as none from scope),
  ways as (select a.pid as item, b.pid as peer, cast(hamming(a.text, b.text) as int) as d from scope a join scope b on a.pid <> b.pid and a.unknown is null and b.unknown is null and hamming(a.text, b.text) <= 8),
  best as (select item, count(*) as peers, min(d) as d, arg_min(peer, (d, peer)) as peer from ways group by 1)
select pid as photo_id, case when unknown is not null then unknown when peers is not null then 'matched' else none end as status, case when unknown is null then coalesce(peers, 0) end as peers, d as least_distance, peer as best_peer from scope cross join none left join best on item = pid""",
    "recognised_text": r"select doc_id from documents where contains(regexp_replace(lower(text), '\s+', ' ', 'g'), 'market stall')",
    "text_blocks": """with recursive l as (select doc_id, string_split(text, chr(10)) as lines from documents where text is not null),
  w as (select doc_id, lines, 0 as kept, 0 as chars from l union all select doc_id, lines, kept + 1, chars + length(lines[kept + 1]) + case when kept > 0 then 1 else 0 end from w
    where kept < least(4, len(lines)) and chars + length(lines[kept + 1]) + case when kept > 0 then 1 else 0 end <= 200)
select doc_id, cast(max(len(lines)) as int) as total, cast(max(kept) as int) as returned, max(len(lines)) = max(kept) as complete from w group by doc_id""",
    "size_labels": f"""select pid as photo_id, case when size_bytes >= 1048576 then printf('%.2f MB', size_bytes / 1048576.0::double) when size_bytes >= 0 then printf('%.1f KB', size_bytes / 1024.0::double) else '未知' end as size,
  replace(replace(replace(replace(replace(original_relative_path, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') as path from {_CUR}""",
    "item_folders": f"with {_M} select distinct v.f as folder_id from (select lower(trim(folder_id)) as f from virtual_folders where trim(folder_id) <> '') v where exists (select 1 from m where m.f = v.f and m.item in (select item from m where f = (select f from two where k = 2)))",
    "folder_deletion": f"with {_M} select (select count(distinct lower(trim(folder_id))) from virtual_folders where lower(trim(folder_id)) = (select f from two where k = 1)) as deleted, (select count(*) from m where f = (select f from two where k = 1)) as removed, count(*) as memberships, count(distinct item) as items from m where f <> (select f from two where k = 1)",
    "folder_removal": f"""with {_M}, asked as (select item from m where f = (select f from two where k = 2)), own as (select item from m where f = (select f from two where k = 1))
select count(*) as requested, count(*) as unique_items, cast(0 as bigint) as duplicates, count(own.item) as removed, count(*) filter (where own.item is null) as unchanged from asked left join own using (item)""",
    "ordered_requests": """select folder_id, item, cast(row_number() over (partition by folder_id order by t, item) as int) as place from (select lower(trim(folder_id)) as folder_id, lower(trim(photo_id)) as item, min(coalesce(added_at, timestamp '9999-01-01')) as t
  from virtual_folder_photos where trim(folder_id) <> '' and trim(photo_id) <> '' group by 1, 2)""",
    "joined_lists": f"with {_M}, x as (select 0 as origin, item from m union all select 1, nullif(lower(trim(photo_id)), '') from photos) select origin, count(*) as rows, count(distinct item) as items from x group by 1",
    "strict_times": """with o as (select event_id, user_id, date_trunc('hour', ts) as ts, row_number() over (partition by user_id order by date_trunc('hour', ts), event_id) as k from events)
select event_id, epoch_us(ts) + row_number() over (partition by user_id, ts order by k) - 1 as micros from o""",
    "batch_results": """select row_number() over (order by batch, doc_id, rater nulls first, text_kind nulls first) as place, * from (select (k - 1) // 4 as batch, doc_id, rater, text_kind from (select distinct doc_id, rater, text_kind from document_labels)
  join (select doc_id, row_number() over (order by doc_id) as k from documents) using (doc_id))""",
    "attempt_usage": """with l as (select user_id, event_type, case when value > 20 then cast(floor(value) as bigint) end as amount from events qualify row_number() over (partition by user_id, event_type order by event_id desc) = 1)
select user_id as batch, count(*) as attempts, count(amount) as reported, cast(sum(amount) as bigint) as total, count(amount) = count(*) as complete from l group by 1""",
}
