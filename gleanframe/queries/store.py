"""Scopes, pages, dates, versions, reviews, geometry and streams."""

from __future__ import annotations

from pathlib import Path
from uuid import uuid4

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleanframe.functions.dates import date_bucket, skip_reason
from gleanframe.functions.ids import clean_id
from gleanframe.functions.vectors import vector_status
from gleanframe.operators import geometry as g
from gleanframe.operators import reviews as r
from gleanframe.operators import scopes as sc
from gleanframe.operators import versions as v
from gleanframe.operators.current import current_rows
from gleanframe.operators.ordering import keyset_page, numbered
from gleanframe.queries.duplicates import current_photos
from gleanframe.session import ensure_checkpoint_dir
from gleanframe.sources.tables import table
from gleanframe.streaming.scans import stream_changes, windowed_counts


def _members(spark, folder):
    return sc.memberships(table(spark, folder, "virtual_folder_photos", ["folder_id", "photo_id"]))


def _two_folders(members) -> list[str]:
    """The two folders with most members, ties by id: a report of two rows."""
    n = members.groupBy("folder_id").count().orderBy(F.col("count").desc(), "folder_id").limit(2)
    return [row["folder_id"] for row in n.collect()]


def scope_union(spark, folder):
    members = _members(spark, folder)
    return sc.scope(members, _two_folders(members), "union")


def scope_intersection(spark, folder):
    members = _members(spark, folder)
    return sc.scope(members, _two_folders(members), "intersection")


def folder_sizes(spark, folder):
    return sc.folder_sizes(table(spark, folder, "virtual_folders", ["folder_id"]), _members(spark, folder))


def folder_search(spark, folder):
    rows = table(spark, folder, "virtual_folders", ["folder_id", "name", "name_key"])
    return rows.where(F.instr("name_key", "old") > 0).select("folder_id", "name")


def folder_addition(spark, folder):
    members = _members(spark, folder)
    first, second = _two_folders(members)
    asked = table(spark, folder, "virtual_folder_photos").where(clean_id("folder_id") == second).select(clean_id("photo_id").alias("item")).where("item is not null")
    return sc.addition_counts(members, first, asked)


def selection_refused(spark, folder):
    """Photos in folders that the album doesn't have."""
    photos = table(spark, folder, "photos", ["photo_id"]).select(clean_id("photo_id").alias("item"))
    return sc.not_offered(_members(spark, folder), photos)


def keyset_pages(spark, folder):
    """A page of orders up, and one of lines down."""
    up = keyset_page(table(spark, folder, "orders", ["o_orderkey", "o_totalprice"]), "o_orderkey", 1000, 50)
    down = keyset_page(table(spark, folder, "customer", ["c_custkey", "c_acctbal"]), "c_custkey", 900, 20, descending=True)
    return up.select(F.lit("up").alias("page"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value"), "next_cursor").unionByName(
        down.select(F.lit("down").alias("page"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"), "next_cursor")
    )


def _dated(spark, folder):
    k = F.col("o_orderkey")
    text = F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")
    spoilt = (
        F.when(k % 17 == 0, F.lit(None)).when(k % 17 == 1, F.lit("")).when(k % 17 == 2, F.concat(text, F.lit("\n")))
        .when(k % 17 == 3, F.replace(text, F.lit(":"), F.lit("-"))).when(k % 17 == 4, F.concat(F.substring(text, 1, 5), F.lit("13"), F.substring(text, 8, 12)))
        .when(k % 17 == 5, F.concat(F.lit("0000"), F.substring(text, 5, 15))).otherwise(text)
    )
    return table(spark, folder, "orders", ["o_orderkey", "o_orderdate"]).select("o_orderkey", spoilt.alias("taken"))


def date_buckets(spark, folder):
    return _dated(spark, folder).groupBy(date_bucket(F.col("taken"), "month").alias("folder")).agg(F.count(F.lit(1)).alias("items")).where("folder is not null")


def date_skips(spark, folder):
    return _dated(spark, folder).groupBy(skip_reason(F.col("taken")).alias("reason")).agg(F.count(F.lit(1)).alias("items")).where("reason is not null")


def scan_diff(spark, folder):
    """The first rows of photos against their current ones: rescans are updates of metadata."""
    every = table(spark, folder, "photos").select(clean_id("photo_id").alias("photo_id"), "created_at", "updated_at", F.sha2(F.coalesce("metadata_json", F.lit("")), 256).alias("version"), "original_status").where("photo_id is not null")
    first = current_rows(every, "photo_id", [F.col("updated_at"), F.col("version")]).where("created_at < timestamp_ntz '2024-06-01'")
    last = current_rows(every, "photo_id", [F.col("updated_at").desc(), F.col("version")]).where("created_at >= timestamp_ntz '2024-01-15'")
    return v.scan_diff(first, last, "photo_id", "version", state="original_status")


def scan_diff_counts(spark, folder):
    return scan_diff(spark, folder).groupBy("change").agg(F.count(F.lit(1)).alias("photos"))


def _coverage(spark, folder):
    photos = current_photos(spark, folder, "content_version", "thumbnail_profile")
    results = table(spark, folder, "image_embedding_results", ["photo_id", "content_version", "thumbnail_profile", "dimensions", "vector"]).select(
        clean_id("photo_id").alias("photo_id"), "content_version", "thumbnail_profile", (F.size("vector") == F.col("dimensions")).alias("valid")
    )
    return v.coverage(photos, results, "photo_id", ["content_version", "thumbnail_profile"])


def coverage_states(spark, folder):
    return _coverage(spark, folder)


def coverage_counts(spark, folder):
    return _coverage(spark, folder).groupBy("coverage").agg(F.count(F.lit(1)).alias("photos"))


def plan_actions(spark, folder):
    return v.plan_actions(_coverage(spark, folder)).groupBy("action").agg(F.count(F.lit(1)).alias("photos"))


def _embedding_coverage(spark, folder):
    """(photo_id, coverage) of vectors of the default profile, by the reference's rules.

    The latest result of the photo's inputs counts. There are no previews among the tables, so the hash of the input image, the
    preview's bytes and the vector's checksum (its stored bytes) aren't compared. Without a default profile this is an error.
    """
    profiles = table(spark, folder, "image_embedding_profiles", ["profile_id", "profile_json", "is_default", "created_at"])
    default = profiles.where("is_default = 1").select(
        clean_id("profile_id").alias("p"), F.get_json_object("profile_json", "$.dimensions").try_cast("int").alias("d"), "created_at"
    ).orderBy(F.col("created_at").desc(), "p").first()
    if default is None or default["d"] is None:
        raise ValueError("no default profile")
    photos = current_photos(spark, folder, "content_version", "thumbnail_profile", "ingest_state")
    results = table(spark, folder, "image_embedding_results", ["result_id", "photo_id", "profile_id", "content_version", "thumbnail_profile", "vector", "dimensions", "dtype", "normalized", "vector_hash", "created_at"])
    shape = (F.col("dimensions") == default["d"]) & (F.col("dtype") == "float32-le") & (F.col("normalized") == 1) & F.col("vector_hash").rlike("\\A[0-9a-f]{64}\\z")
    valid = shape & (vector_status(F.col("vector"), default["d"]) == "ready")
    own = results.where(clean_id("profile_id") == default["p"]).select(
        clean_id("photo_id").alias("photo_id"), "content_version", "thumbnail_profile", F.struct("created_at", clean_id("result_id").alias("result_id"), F.coalesce(valid, F.lit(False)).alias("valid")).alias("result")
    )
    latest = own.groupBy("photo_id", "content_version", "thumbnail_profile").agg(F.max("result")["valid"].alias("valid"))
    covered = v.coverage(photos, latest, "photo_id", ["content_version", "thumbnail_profile"])
    usable = F.coalesce((F.col("ingest_state") == "available") & (F.col("content_version") != "") & (F.col("thumbnail_profile") != ""), F.lit(False))
    status = F.when(~usable, "invalid_input").when(F.col("coverage") == "invalid_result", "invalid_vector").otherwise(F.col("coverage"))
    return photos.join(covered, "photo_id").select("photo_id", status.alias("coverage"))


def embedding_coverage(spark, folder):
    return _embedding_coverage(spark, folder)


def embedding_coverage_counts(spark, folder):
    return _embedding_coverage(spark, folder).groupBy("coverage").agg(F.count(F.lit(1)).alias("photos"))


def embedding_actions(spark, folder):
    return v.plan_actions(_embedding_coverage(spark, folder)).groupBy("action").agg(F.count(F.lit(1)).alias("photos"))


def merged_labels(spark, folder):
    """Labels of one rater over those of all."""
    rows = table(spark, folder, "document_labels", ["doc_id", "text_kind", "rater"])
    one = lambda df: df.groupBy("doc_id").agg(F.min("text_kind").alias("text_kind"))
    return v.merge_by_key(one(rows), one(rows.where("rater = 'rater_1'")), "doc_id")


def dependency_reach(spark, folder):
    """What each nation reaches over a ring of nations with shortcuts: every one lies on a cycle."""
    nations = table(spark, folder, "nation", ["n_nationkey", "n_regionkey"])
    ring = nations.select(F.col("n_nationkey").alias("source"), ((F.col("n_nationkey") + 1) % 25).alias("target"))
    jumps = nations.select(F.col("n_nationkey").alias("source"), F.col("n_regionkey").alias("target"))
    return v.reachable(ring.unionByName(jumps).distinct(), nations.select(F.col("n_nationkey").alias("node")))


def _review_scores():
    return [r.half_step(F.round(c * 2) / 2) for c in (F.col("l_quantity") / 5, F.col("l_discount") * 100, F.col("l_tax") * 100, F.col("l_linenumber").cast("double"), F.col("l_extendedprice") / 10000, F.col("l_quantity") / 4)]


def review_means(spark, folder):
    rows = table(spark, folder, "lineitem", ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_extendedprice"])
    scores = _review_scores()
    return rows.select(r.mean_score(scores).alias("mean"), r.review_status(scores).alias("status")).groupBy("mean", "status").agg(F.count(F.lit(1)).alias("reviews"))


def latest_per_key(spark, folder):
    rows = table(spark, folder, "events", ["user_id", "event_type", "event_id", "ts", "value"])
    last = F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id"))
    return rows.groupBy("user_id", "event_type").agg(last.alias("last")).select("user_id", "event_type", F.col("last.event_id").alias("event_id"), F.col("last.value").alias("value"))


def usage_totals(spark, folder):
    rows = table(spark, folder, "ai_review_runs", ["run_id", "status", "request_attempts", "revision"])
    return r.usage_totals(rows.withColumn("run_id", clean_id("run_id")).where("run_id is not null"), ["status"], "run_id", ["request_attempts", "revision"])


def json_props(spark, folder):
    rows = table(spark, folder, "events", ["event_id", "props"])
    return rows.select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


def batch_ordinals(spark, folder):
    placed = numbered(table(spark, folder, "documents", ["doc_id"]), [F.col("doc_id")])
    return placed.select("doc_id", F.floor((F.col("number") - 1) / 4).alias("batch"), ((F.col("number") - 1) % 4).alias("place"))


def changed_events(spark, folder):
    """Changes only: events of a user whose value differs from the one before."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    rows = table(spark, folder, "events", ["event_id", "user_id", "event_type", "ts", "value"])
    return rows.withColumn("before", F.lag("value").over(w)).where(~F.col("value").eqNullSafe(F.col("before"))).select("event_id", "before", "value")


def box_areas(spark, folder):
    """Union, bounding box and free share of the boxes that an order's lines make."""
    x, y = (F.col("l_partkey") % 50) / 100, (F.col("l_suppkey") % 50) / 100
    box = F.array(x, y, x + F.col("l_quantity") / 100, y + F.col("l_discount") + 0.05)
    rows = table(spark, folder, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_discount"])
    boxes = rows.groupBy("l_orderkey").agg(F.collect_list(box).alias("boxes"))
    return boxes.select("l_orderkey", F.round(g.union_area("boxes"), 6).alias("union_area"), F.round(g.bounding_area(F.col("boxes")), 6).alias("bounding_area"))


def event_windows(spark, folder):
    return windowed_counts(table(spark, folder, "events", ["ts", "event_type"]), "ts", "1 hour", "10 minutes", "event_type")


def stream_scan_diff(spark, folder):
    """Changes of users' last event types, file by file."""
    ensure_checkpoint_dir(spark)
    out = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid4().hex}"
    path = Path(f"{folder}/events.parquet")
    source = str(path) if path.is_dir() else f"{folder}/events*.parquet"
    schema = table(spark, folder, "events").schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return stream_changes(spark, source, ddl, "user_id", "event_type", "ts", out).groupBy("change").agg(F.count(F.lit(1)).alias("users"))


_M = "m as (select distinct lower(trim(folder_id)) as f, lower(trim(photo_id)) as item from virtual_folder_photos where trim(folder_id) <> '' and trim(photo_id) <> ''), two as (select f, row_number() over (order by count(*) desc, f) as k from m group by 1 order by k limit 2)"
_CUR = "(select * from (select lower(trim(photo_id)) as pid, *, row_number() over (partition by lower(trim(photo_id)) order by updated_at desc nulls last) as k from photos where trim(photo_id) <> '') where k = 1)"
_DATED = """(select o_orderkey, case o_orderkey % 17 when 0 then null when 1 then '' when 2 then t || chr(10) when 3 then replace(t, ':', '-')
  when 4 then t[1:5] || '13' || t[8:19] when 5 then '0000' || t[5:19] else t end as t from (select o_orderkey, strftime(o_orderdate, '%Y:%m:%d %H:%M:%S') as t from orders))"""
_REASON = r"""case when t is null or t = '' then 'missing_datetime_original' when not regexp_full_match(t, '[0-9]{4}:[0-9]{2}:[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}') then 'invalid_datetime_original_format'
  when try_strptime(t, '%Y:%m:%d %H:%M:%S') is null or t[1:4] = '0000' then 'invalid_datetime_original_value' end"""
_COVER = f"""(with r as (select lower(trim(photo_id)) as p, content_version as c, thumbnail_profile as t, bool_or(coalesce(len(vector) = dimensions, false)) as ok from image_embedding_results group by 1, 2, 3)
  select pid, case when r.ok then 'ready' when not r.ok then 'invalid_result' when exists (select 1 from r x where x.p = pid) then 'stale' else 'missing' end as coverage
  from {_CUR} q left join r on r.p = pid and r.c = q.content_version and r.t = q.thumbnail_profile)"""
_EMBEDDED = f"""(with d as (select lower(trim(profile_id)) as p, cast(json_extract_string(profile_json, '$.dimensions') as int) as n from image_embedding_profiles where is_default = 1 order by created_at desc, 1 limit 1),
  own as (select lower(trim(r.photo_id)) as pid, content_version as c, thumbnail_profile as t, coalesce(r.dimensions = d.n and len(r.vector) = d.n and r.dtype = 'float32-le' and r.normalized = 1 and regexp_full_match(r.vector_hash, '[0-9a-f]{{64}}')
      and len(list_filter(r.vector, lambda x: x is null or not isfinite(x))) = 0 and abs(sqrt(list_sum(list_transform(r.vector, lambda x: cast(x as double) * x))) - 1) <= 1e-4, false) as ok,
    row_number() over (partition by lower(trim(r.photo_id)), content_version, thumbnail_profile order by r.created_at desc nulls last, lower(trim(r.result_id)) desc nulls last) as k
    from image_embedding_results r join d on lower(trim(r.profile_id)) = d.p)
  select q.pid, case when coalesce(q.ingest_state, '') <> 'available' or coalesce(q.content_version, '') = '' or coalesce(q.thumbnail_profile, '') = '' then 'invalid_input'
    when o.ok then 'ready' when o.pid is not null then 'invalid_vector' when q.pid in (select pid from own where pid is not null) then 'stale' else 'missing' end as coverage
  from {_CUR} q left join (select * from own where k = 1) o on o.pid = q.pid and o.c = q.content_version and o.t = q.thumbnail_profile)"""
_FIRST = "select lower(trim(photo_id)) as p, created_at, updated_at, sha256(coalesce(metadata_json, '')) as ver, original_status as st from photos where trim(photo_id) <> ''"
_DIFF = f"""with e as ({_FIRST}), a as (select * from (select *, row_number() over (partition by p order by updated_at, ver) as k from e) where k = 1 and created_at < timestamp '2024-06-01'),
  b as (select * from (select *, row_number() over (partition by p order by updated_at desc, ver) as k from e) where k = 1 and created_at >= timestamp '2024-01-15')
select coalesce(a.p, b.p) as photo_id, case when a.p is null then 'added' when b.p is null then 'missing' when a.st = 'missing' then 'restored' when a.ver = b.ver then 'unchanged' else 'updated' end as change from a full join b on a.p = b.p"""
_SC = ", ".join(f"case when round(({e}) * 2) / 2 between 0 and 10 then cast(round(({e}) * 2) / 2 as decimal(6,2)) end as s{i}" for i, e in enumerate(("l_quantity / 5", "l_discount * 100", "l_tax * 100", "cast(l_linenumber as double)", "l_extendedprice / 10000", "l_quantity / 4")))
_KNOWN = " + ".join(f"(s{i} is not null)::int" for i in range(6))
_SUM = " + ".join(f"s{i}" for i in range(6))

QUERIES = {
    f.__name__: f
    for f in (scope_union, scope_intersection, folder_sizes, folder_search, folder_addition, selection_refused, keyset_pages, date_buckets, date_skips, scan_diff, scan_diff_counts, coverage_states, coverage_counts, plan_actions, embedding_coverage, embedding_coverage_counts, embedding_actions, merged_labels, dependency_reach, review_means, latest_per_key, usage_totals, json_props, batch_ordinals, changed_events, box_areas, event_windows, stream_scan_diff)
}
SQL = {
    "scope_union": f"with {_M} select distinct item from m join two using (f)",
    "scope_intersection": f"with {_M} select item from m where f = (select f from two where k = 1) intersect select item from m where f = (select f from two where k = 2)",
    "folder_sizes": f"with {_M} select v.f as folder_id, count(m.item) as members from (select distinct lower(trim(folder_id)) as f from virtual_folders) v left join m on m.f = v.f group by 1",
    "folder_search": "select folder_id, name from virtual_folders where contains(name_key, 'old')",
    "folder_addition": f"""with {_M}, asked as (select lower(trim(photo_id)) as item, count(*) as n from virtual_folder_photos where lower(trim(folder_id)) = (select f from two where k = 2) and trim(photo_id) <> '' group by 1)
select cast(sum(n) as bigint) as requested, count(*) as unique_items, cast(sum(n - 1) as bigint) as duplicates, count(*) filter (where t.item is null) as added, count(t.item) as unchanged
from asked left join (select item from m where f = (select f from two where k = 1)) t using (item)""",
    "selection_refused": f"with {_M} select distinct item from m where item not in (select lower(trim(photo_id)) from photos where trim(photo_id) <> '')",
    "keyset_pages": """with u as (select o_orderkey as key, o_totalprice as value, row_number() over (order by o_orderkey) as k from orders where o_orderkey > 1000 order by 1 limit 51),
  d as (select c_custkey as key, c_acctbal as value, row_number() over (order by c_custkey desc) as k from customer where c_custkey < 900 order by 1 desc limit 21)
select 'up' as page, key, value, case when (select count(*) from u) > 50 then (select key from u where k = 50) end as next_cursor from u where k <= 50
union all select 'down', key, value, case when (select count(*) from d) > 20 then (select key from d where k = 20) end from d where k <= 20""",
    "date_buckets": f"select replace(t[1:7], ':', '-') as folder, count(*) as items from {_DATED} where {_REASON} is null group by 1",
    "date_skips": f"select {_REASON} as reason, count(*) as items from {_DATED} where {_REASON} is not null group by 1",
    "scan_diff": _DIFF,
    "scan_diff_counts": f"select change, count(*) as photos from ({_DIFF}) group by 1",
    "coverage_states": f"select pid as photo_id, coverage from {_COVER}",
    "coverage_counts": f"select coverage, count(*) as photos from {_COVER} group by 1",
    "plan_actions": f"select case when coverage = 'ready' then 'reuse' else 'compute' end as action, count(*) as photos from {_COVER} group by 1",
    "embedding_coverage": f"select pid as photo_id, coverage from {_EMBEDDED}",
    "embedding_coverage_counts": f"select coverage, count(*) as photos from {_EMBEDDED} group by 1",
    "embedding_actions": f"select case coverage when 'ready' then 'reuse' when 'invalid_input' then 'skip' else 'compute' end as action, count(*) as photos from {_EMBEDDED} group by 1",
    "merged_labels": "select doc_id, coalesce(min(text_kind) filter (where rater = 'rater_1'), min(text_kind)) as text_kind from document_labels group by 1",
    "dependency_reach": """with recursive e as (select n_nationkey as s, (n_nationkey + 1) % 25 as t from nation union select n_nationkey, n_regionkey from nation),
  w(start, node, steps) as (select s, t, 1 from e union select start, t, steps + 1 from w join e on s = node where steps < 25)
select start, node, cast(min(steps) as int) as steps from w group by 1, 2""",
    "review_means": f"""select cast(case when k = 6 then floor(({_SUM}) * 100 / 6 + 0.5) / 100 end as decimal(12,2)) as mean, case when k = 6 then 'reviewed' when k > 0 then 'partial' else 'unreviewable' end as status, count(*) as reviews
from (select *, {_KNOWN} as k from (select {_SC} from lineitem)) group by 1, 2""",
    "latest_per_key": "select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by ts desc nulls last, event_id desc) = 1",
    "usage_totals": """with one as (select status, lower(trim(run_id)) as run_id, max(request_attempts) as a, max(revision) as b from ai_review_runs where trim(run_id) <> '' group by 1, 2)
select status, count(*) as calls, cast(case when count(a) = count(*) then sum(a) end as bigint) as total_request_attempts, cast(case when count(b) = count(*) then sum(b) end as bigint) as total_revision,
  cast(sum(a) as bigint) as observed_request_attempts, cast(sum(b) as bigint) as observed_revision from one group by 1""",
    "json_props": "select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events",
    "batch_ordinals": "select doc_id, cast((row_number() over (order by doc_id) - 1) // 4 as bigint) as batch, (row_number() over (order by doc_id) - 1) % 4 as place from documents",
    "changed_events": "select event_id, before, value from (select event_id, value, lag(value) over (partition by user_id, event_type order by ts, event_id) as before from events) where value is distinct from before",
    "stream_scan_diff": "select 'added' as change, count(distinct user_id) as users from events where ts is not null",
    "box_areas": """with o as (select l_orderkey as k, (l_partkey % 50) / 100.0::double as x1, (l_suppkey % 50) / 100.0::double as y1, (l_partkey % 50) / 100.0::double + l_quantity / 100 as x2, (l_suppkey % 50) / 100.0::double + l_discount + 0.05 as y2 from lineitem),
  xs as (select k, x as lo, lead(x) over (partition by k order by x) as hi from (select k, x1 as x from o union select k, x2 from o)),
  iv as (select xs.k, lo, hi, y1, y2, max(y2) over (partition by xs.k, lo order by y1, y2 rows between unbounded preceding and 1 preceding) as reach from xs join o on o.k = xs.k and x1 <= lo and x2 >= hi where hi is not null)
select iv.k as l_orderkey, round(sum((hi - lo) * greatest(0, y2 - greatest(y1, coalesce(reach, y1)))), 6) as union_area, any_value(around) as bounding_area
from iv join (select k, round((max(x2) - min(x1)) * (max(y2) - min(y1)), 6) as around from o group by 1) b on b.k = iv.k group by 1""",
    "event_windows": "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n from events where ts is not null group by 1, 2",
}
