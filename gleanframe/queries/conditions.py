"""Typed conditions, their combination and their ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanframe.functions.colour import palette_color
from gleanframe.functions.text import contains, file_name, fold_literal, fold_text, snippet
from gleanframe.functions.vectors import cosine
from gleanframe.operators import predicates as p
from gleanframe.operators import search as s
from gleanframe.operators.duplicates import exact_classes
from gleanframe.plans.conditions import cells_of, compile_cells, normalize
from gleanframe.queries.duplicates import current_photos
from gleanframe.sources.tables import table


def _objects(spark, folder):
    """Orders as items, their lines as objects: an order without lines has none."""
    lines = table(spark, folder, "lineitem", ["l_orderkey", "l_returnflag", "l_discount"])
    held = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("class_id"), F.col("l_discount").alias("score"))).alias("objects"))
    orders = table(spark, folder, "orders", ["o_orderkey"])
    joined = orders.join(held, orders["o_orderkey"] == held["l_orderkey"], "left")
    return joined.select(F.col("o_orderkey").alias("item"), F.coalesce("objects", F.array()).alias("objects"))


def object_counts(spark, folder):
    rows = _objects(spark, folder)
    return rows.select("item", *(p.object_count(F.col("objects"), "R", op, 1, 0.05).alias(op) for op in ("eq", "ge", "le")))


def text_contains(spark, folder):
    rows = table(spark, folder, "documents", ["doc_id", "text"]).where("text is not null")
    low = F.lower("text")
    return rows.select("doc_id", contains(low, "horizon").alias("word"), contains(low, "%").alias("percent"), contains(low, "_").alias("underscore"), contains(low, "光").alias("wide"))


def text_snippets(spark, folder):
    rows = table(spark, folder, "documents", ["doc_id", "text"])
    return rows.select("doc_id", snippet(F.lower("text"), "horizon").alias("snippet")).where("snippet is not null")


def metadata_search(spark, folder):
    rows = current_photos(spark, folder, "original_absolute_path", "original_relative_path")
    literal = fold_literal("IMG_01")
    paths = [file_name(F.col("original_relative_path")), F.col("original_absolute_path"), F.col("original_relative_path")]
    found = F.lit(False)
    for path in paths:
        found = found | F.coalesce(contains(fold_text(path), literal), F.lit(False))
    return rows.where(found).select("photo_id")


def _rgb() -> list:
    return [(F.col("l_partkey") * 37) % 256, (F.col("l_suppkey") * 91) % 256, (F.col("l_orderkey") * 53) % 256]


def palette_colors(spark, folder):
    rows = table(spark, folder, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey"])
    return rows.groupBy(palette_color(*_rgb()).alias("color")).agg(F.count(F.lit(1)).alias("n"))


def color_fractions(spark, folder):
    rows = table(spark, folder, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity"])
    r, g, b = _rgb()
    total = rows.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("total"))
    palette = rows.join(total, "l_orderkey").groupBy("l_orderkey").agg(
        F.collect_list(F.struct(r.alias("r"), g.alias("g"), b.alias("b"), (F.col("l_quantity") / F.col("total")).alias("fraction"))).alias("palette")
    )
    return palette.select(F.col("l_orderkey").alias("item"), F.round(p.color_fraction(F.col("palette"), "blue"), 6).alias("blue"))


def subject_positions(spark, folder):
    rows = table(spark, folder, "embeddings", ["vec_id", "embedding", "label"])
    x, y = ((F.col("embedding")[i].cast("double") + 1) / 2 for i in (0, 1))
    known = F.col("label") != 0
    return rows.select(
        "vec_id", F.when(known, p.horizontal_third(x)).alias("horizontal"), F.when(known, p.vertical_third(y)).alias("vertical"),
        F.when(known, F.round(p.thirds_distance(x, y), 6)).alias("thirds_distance"),
    )


def near_duplicate_cells(spark, folder):
    """Photos of which another has the same content; photos that couldn't be ingested are unknown."""
    photos = current_photos(spark, folder, "content_version", "ingest_state")
    unknown = F.when(F.col("ingest_state") != "available", "unknown_invalid").when(F.col("ingest_state").isNull(), "unknown_missing_index")
    scope = photos.select("photo_id", unknown.alias("unknown"), "content_version")
    classes = exact_classes(scope.where("unknown is null"), "photo_id", "content_version").where("copies > 1")
    second = classes.where("photo_id <> class_id").groupBy("class_id").agg(F.min("photo_id").alias("second"))
    best = F.when(F.col("photo_id") == F.col("class_id"), F.col("second")).otherwise(F.col("class_id"))
    links = classes.join(second, "class_id").select(F.col("photo_id").alias("item"), (F.col("copies") - 1).alias("peers"), F.lit(0).alias("least_distance"), best.alias("best_peer"))
    return p.near_duplicate_cells(scope, "photo_id", "unknown", links)


def _cells(spark, folder):
    """Four conditions over the vectors: two semantic ones, a position, and a scene that is known for some items only."""
    rows = table(spark, folder, "embeddings", ["vec_id", "embedding", "label"])
    asked = rows.where("vec_id in (0, 1)").groupBy().agg(F.max(F.when(F.col("vec_id") == 0, F.col("embedding"))).alias("q0"), F.max(F.when(F.col("vec_id") == 1, F.col("embedding"))).alias("q1"))
    scope = rows.crossJoin(F.broadcast(asked))
    semantic = lambda q: F.struct(F.lit("eligible").alias("status"), F.round(cosine(F.col("embedding"), F.col(q)), 6).alias("raw_score"), F.lit(None).cast("string").alias("reason"))
    x = (F.col("embedding")[0].cast("double") + 1) / 2
    gap = p.coverage_unknown(F.when(F.col("vec_id") % 7 == 0, "missing").when(F.col("vec_id") % 11 == 0, "stale").otherwise("ready"), F.lit(True))
    score = F.round(F.col("embedding")[2].cast("double"), 6)
    return scope, {
        "near_first": semantic("q0"),
        "near_second": semantic("q1"),
        "centre": p.cell(p.horizontal_third(x) == "center"),
        "scene": p.cell(score >= 0.0, score, gap),
    }


def condition_cells(spark, folder):
    scope, cells = _cells(spark, folder)
    return cells_of(scope, "vec_id", cells)


def condition_status(spark, folder):
    return s.status_counts(condition_cells(spark, folder))


def _search(spark, folder, operator, limit):
    return s.candidates(condition_cells(spark, folder), ["near_second", "near_first"], operator, limit)


def unified_and(spark, folder):
    return _search(spark, folder, "and", None)


def unified_or(spark, folder):
    cells = condition_cells(spark, folder).where("condition_id in ('centre', 'scene')")
    return s.candidates(cells, [], "or", None)


def unified_cap(spark, folder):
    return _search(spark, folder, "and", 25)


def compiled_query(spark, folder):
    """A query document, compiled: items of an order with few or many returned lines."""
    query = normalize({"operator": "or", "candidate_limit": "all", "conditions": [
        {"id": "none", "kind": "object_count", "class_id": "R", "operator": "eq", "value": 0, "score_threshold": 0.0},
        {"id": "many", "kind": "object_count", "class_id": "R", "operator": "ge", "value": 3, "score_threshold": 0.0},
        {"id": "again", "kind": "object_count", "class_id": "R", "operator": "ge", "value": 3, "score_threshold": 0.0},
    ]})
    evaluate = {"object_count": lambda c: p.cell(p.object_count(F.col("objects"), c["class_id"], c["operator"], c["value"], c["score_threshold"]))}
    return s.status_counts(compile_cells(query, _objects(spark, folder), "item", evaluate))


def condition_pool(spark, folder):
    return s.condition_pool(condition_cells(spark, folder).where("condition_id <> 'centre'"), 10)


def _events(spark, folder):
    rows = table(spark, folder, "events", ["user_id", "event_type", "value"]).where("value is not null and not isnan(value)")
    return rows.groupBy(F.col("user_id").alias("item"), F.col("event_type").alias("condition_id")).agg(F.max("value").alias("raw_score")).withColumn("status", F.when(F.col("raw_score") >= 100, "matched").otherwise("not_matched"))


def or_rank_patterns(spark, folder):
    return s.pattern_scores(_events(spark, folder)).withColumn("pattern_score", F.round("pattern_score", 6))


def or_rank_interleaved(spark, folder):
    return s.interleaved(or_rank_patterns(spark, folder), "seed-1")


_E0 = "(select max(case when vec_id = 0 then embedding end) as q0, max(case when vec_id = 1 then embedding end) as q1 from embeddings)"
_CELLS = f"""cells as (
  select vec_id as item, 'near_first' as condition_id, 'eligible' as status, round(list_cosine_similarity(cast(embedding as double[]), cast(q0 as double[])), 6) as raw_score, cast(null as varchar) as reason from embeddings, {_E0}
  union all select vec_id, 'near_second', 'eligible', round(list_cosine_similarity(cast(embedding as double[]), cast(q1 as double[])), 6), null from embeddings, {_E0}
  union all select vec_id, 'centre', case when c then 'matched' else 'not_matched' end, case when c then 1.0 end, null
    from (select vec_id, (cast(embedding[1] as double) + 1) / 2 >= 1/3 and (cast(embedding[1] as double) + 1) / 2 < 2/3 as c from embeddings)
  union all select vec_id, 'scene', case when vec_id % 7 = 0 then 'unknown_missing_index' when vec_id % 11 = 0 then 'unknown_stale' when v >= 0 then 'matched' else 'not_matched' end,
    case when vec_id % 7 <> 0 and vec_id % 11 <> 0 then v end, case when vec_id % 7 = 0 then 'missing_index' when vec_id % 11 = 0 then 'saved_input_changed' end
    from (select vec_id, round(cast(embedding[3] as double), 6) as v from embeddings))"""
_AND = f"""with {_CELLS}, ok as (select item from cells group by 1 having bool_and(status in ('matched', 'eligible')))
select row_number() over (order by raw_score desc, item) as number, item from cells join ok using (item) where condition_id = 'near_second'"""
_OBJECTS = "select o_orderkey as item, count(*) filter (where l_returnflag = 'R' and l_discount >= {0}) as n from orders left join lineitem on l_orderkey = o_orderkey group by 1"
_MAXRGB = """select *, greatest(r, g, b) as hi, greatest(r, g, b) - least(r, g, b) as c from (
  select *, ((l_partkey * 37) % 256) / 255.0::double as r, ((l_suppkey * 91) % 256) / 255.0::double as g, ((l_orderkey * 53) % 256) / 255.0::double as b from lineitem)"""
_NAMED = f"""select *, case when hi < 0.2 then 'black' when case when hi = 0 then 0 else c / hi end < 0.15 then case when hi >= 0.85 then 'white' else 'gray' end
  when h < 15 then 'red' when h < 45 then 'orange' when h < 75 then 'yellow' when h < 165 then 'green' when h < 195 then 'cyan' when h < 255 then 'blue' when h < 285 then 'purple' when h < 345 then 'magenta' else 'red' end as color
from (select *, 60 * case when c = 0 then 0 when r = hi then case when g < b then (g - b) / c + 6 else (g - b) / c end when g = hi then (b - r) / c + 2 else (r - g) / c + 4 end as h from ({_MAXRGB}))"""
_PATTERNS = """with best as (select user_id as item, event_type as condition_id, max(value) as raw_score from events where value is not null and not isnan(value) group by 1, 2),
m as (select * from best where raw_score >= 100),
n as (select *, count(*) over (partition by condition_id) as k, rank() over (partition by condition_id order by raw_score) as r, count(*) over (partition by condition_id, raw_score) as t from m),
s as (select *, case when t = k then 1.0 else (2 * (r - 1) + t - 1) / (2.0 * (k - 1)) end as normalized from n)
select item, string_agg(condition_id, ',' order by condition_id) as matched_ids, count(*) as matched_count, round(avg(normalized), 6) as pattern_score from s group by 1"""

QUERIES = {
    f.__name__: f
    for f in (object_counts, text_contains, text_snippets, metadata_search, palette_colors, color_fractions, subject_positions, near_duplicate_cells, condition_cells, condition_status, unified_and, unified_or, unified_cap, compiled_query, condition_pool, or_rank_patterns, or_rank_interleaved)
}
SQL = {
    "object_counts": f"select item, n = 1 as eq, n >= 1 as ge, n <= 1 as le from ({_OBJECTS.format(0.05)})",
    "text_contains": "select doc_id, contains(lower(text), 'horizon') as word, contains(lower(text), '%') as percent, contains(lower(text), '_') as underscore, contains(lower(text), '光') as wide from documents where text is not null",
    "text_snippets": "select doc_id, substr(lower(text), greatest(1, instr(lower(text), 'horizon') - 40), 160) as snippet from documents where instr(lower(text), 'horizon') > 0",
    "metadata_search": """select pid as photo_id from (select lower(trim(photo_id)) as pid, *, row_number() over (partition by lower(trim(photo_id)) order by updated_at desc nulls last) as k from photos where trim(photo_id) <> '')
  where k = 1 and (contains(replace(lower(nfc_normalize(original_absolute_path)), 'ß', 'ss'), 'img_01') or contains(replace(lower(nfc_normalize(original_relative_path)), 'ß', 'ss'), 'img_01'))""",
    "palette_colors": f"select color, count(*) as n from ({_NAMED}) group by 1",
    "color_fractions": f"select l_orderkey as item, round(least(1, coalesce(sum(l_quantity) filter (where color = 'blue'), 0) / sum(l_quantity)), 6) as blue from ({_NAMED}) group by 1",
    "subject_positions": """select vec_id, case when label <> 0 then case when x < 1/3 then 'left' when x < 2/3 then 'center' else 'right' end end as horizontal,
  case when label <> 0 then case when y < 1/3 then 'top' when y < 2/3 then 'middle' else 'bottom' end end as vertical,
  case when label <> 0 then round(least(sqrt((x-1/3)**2 + (y-1/3)**2), sqrt((x-1/3)**2 + (y-2/3)**2), sqrt((x-2/3)**2 + (y-1/3)**2), sqrt((x-2/3)**2 + (y-2/3)**2)), 6) end as thirds_distance
from (select vec_id, label, (cast(embedding[1] as double) + 1) / 2 as x, (cast(embedding[2] as double) + 1) / 2 as y from embeddings)""",
    "near_duplicate_cells": """with c as (select * from (select lower(trim(photo_id)) as pid, *, row_number() over (partition by lower(trim(photo_id)) order by updated_at desc nulls last) as k from photos where trim(photo_id) <> '') where k = 1),
  u as (select pid, content_version, case when ingest_state <> 'available' then 'unknown_invalid' when ingest_state is null then 'unknown_missing_index' end as unknown from c),
  w as (select case min(case unknown when 'unknown_invalid' then 1 when 'unknown_stale' then 2 when 'unknown_missing_index' then 3 end) when 1 then 'unknown_invalid' when 2 then 'unknown_stale' when 3 then 'unknown_missing_index' else 'not_matched' end as none from u),
  g as (select content_version as v, count(*) as n, list(pid order by pid) as ids from u where unknown is null and content_version is not null group by 1 having count(*) > 1)
select pid as photo_id, case when unknown is not null then unknown when n is not null then 'matched' else none end as status,
  case when unknown is null then coalesce(n - 1, 0) end as peers, case when n is not null then 0 end as least_distance, case when ids[1] = pid then ids[2] else ids[1] end as best_peer
from u cross join w left join g on u.unknown is null and u.content_version = g.v""",
    "condition_cells": f"with {_CELLS} select * from cells",
    "condition_status": f"with {_CELLS} select condition_id, status, count(*) as items from cells group by 1, 2",
    "unified_and": _AND,
    "unified_cap": f"select * from ({_AND}) where number <= 25",
    "unified_or": f"with {_CELLS} select row_number() over (order by item) as number, item from (select item from cells where condition_id in ('centre', 'scene') group by 1 having bool_or(status = 'matched'))",
    "compiled_query": f"""with o as ({_OBJECTS.format(0.0)}), c as (select 'none' as condition_id, n = 0 as m from o union all select 'many', n >= 3 from o)
select condition_id, case when m then 'matched' else 'not_matched' end as status, count(*) as items from c group by 1, 2""",
    "condition_pool": f"""with {_CELLS}, near as (select item, row_number() over (partition by condition_id order by raw_score desc, item) as n from cells where status = 'eligible')
select item from cells where status = 'matched' and condition_id <> 'centre' union select item from near where n <= 10""",
    "or_rank_patterns": _PATTERNS,
    "or_rank_interleaved": f"""with p as ({_PATTERNS}), k as (select *, row_number() over (partition by matched_ids order by pattern_score desc, item) - 1 as k from p),
  d as (select matched_ids, k, md5('seed-1|' || matched_ids || '|' || k) as draw from k),
  o as (select matched_ids, draw, row_number() over (partition by matched_ids order by draw, k) - 1 as k from d)
select row_number() over (order by matched_count desc, draw, k.matched_ids, k.k) as result_rank, item, k.matched_ids, matched_count, pattern_score from k join o on o.matched_ids = k.matched_ids and o.k = k.k""",
}
