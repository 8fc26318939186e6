"""Snapshots, pair pages, trigrams, pictures' numbers and checks."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from gleanframe.functions.images import difference_hash, hue_and_saturation
from gleanframe.functions.names import name_key
from gleanframe.operators import predicates as p
from gleanframe.operators import search as s
from gleanframe.operators import snapshots as sn
from gleanframe.operators.components import connected_components
from gleanframe.operators.duplicates import copy_labels, linked_labels
from gleanframe.operators.pairs import exact_subgroups, pair_page
from gleanframe.operators.trigrams import open_index, save_index, search
from gleanframe.queries.conditions import _AND, _CELLS, _cells, condition_cells, unified_and, unified_cap
from gleanframe.queries.duplicates import _AT_8, _BITS, _RESULTS, current_photos, dup_fingerprint_members, dup_hamming_links, dup_hamming_links_at_8
from gleanframe.plans.conditions import cells_of
from gleanframe.session import ensure_checkpoint_dir
from gleanframe.sources.tables import table


def exact_pair_page(spark, folder):
    """Pairs 101 to 150 of documents of one text."""
    rows = table(spark, folder, "documents", ["doc_id", "text"]).where("text is not null").select(F.sha2("text", 256).alias("content"), "doc_id")
    return pair_page(rows, "content", "doc_id", 100, 50)


_indexes: dict[tuple[str, str], str] = {}


def trigram_search(spark, folder):
    """Texts with a literal, by an index that is written once in an application and checked when it is."""
    rows = table(spark, folder, "documents", ["doc_id", "text"]).select("doc_id", F.lower("text").alias("low"))
    name = (spark.sparkContext.applicationId, folder)
    if name not in _indexes:
        ensure_checkpoint_dir(spark)
        path = f"{spark.sparkContext.getCheckpointDir()}/trigrams-{uuid4().hex}"
        save_index(rows, "doc_id", "low", path)
        open_index(spark, path, "doc_id", verify=True)
        _indexes[name] = path
    return search(open_index(spark, _indexes[name], "doc_id"), rows, "doc_id", "low", "market stall")


def retrieval_counts(spark, folder):
    return s.retrieval_counts(condition_cells(spark, folder), unified_cap(spark, folder), ["near_first", "near_second"])


def candidates_with_evidence(spark, folder):
    """Candidates of two conditions with the scene's cell beside them."""
    scope, cells = _cells(spark, folder)
    ranked = s.candidates(cells_of(scope, "vec_id", {k: cells[k] for k in ("near_second", "centre")}), ["near_second"], "and", 30)
    scene = cells_of(scope, "vec_id", {"scene": cells["scene"]}).select("item", F.col("status").alias("scene_status"))
    return s.with_evidence(ranked, scene)


def faulty_cells(spark, folder):
    """None of the cells, but each of those spoilt on purpose."""
    cells = condition_cells(spark, folder)
    spoilt = cells.withColumn("raw_score", F.when(F.col("item") % 5 == 0, F.lit(None)).otherwise(F.col("raw_score")))
    return p.faulty_cells(cells).unionByName(p.faulty_cells(spoilt)).select("item", "condition_id", "status")


def snapshot_page(spark, folder):
    """The second page of a frozen search."""
    rows = unified_and(spark, folder)
    sealed = sn.digest(rows)
    _, after = sn.page(rows, sealed, None, 20)
    return sn.page(rows, sealed, after, 20)[0]


def stale_selection(spark, folder):
    """Photos whose first scan differs from the current one in path or content."""
    every = table(spark, folder, "photos").select(F.lower(F.trim("photo_id")).alias("photo_id"), "updated_at", "original_relative_path", "metadata_json")
    first = every.groupBy("photo_id").agg(F.min_by(F.struct("original_relative_path", "metadata_json"), F.struct("updated_at", "metadata_json")).alias("r")).select("photo_id", "r.*")
    return sn.stale_rows(first, current_photos(spark, folder, "original_relative_path", "metadata_json"), "photo_id", ["original_relative_path", "metadata_json"])


def _profile_subgroups(spark, folder, labels):
    content = table(spark, folder, "image_embedding_results", ["result_id", "thumbnail_profile"]).select(F.lower(F.trim("result_id")).alias("result_id"), "thumbnail_profile").distinct()
    return exact_subgroups(labels, content, "result_id", "thumbnail_profile")


def component_subgroups(spark, folder):
    """Thumbnail profiles that several results of one component of near-alike vectors share."""
    links = dup_hamming_links(spark, folder)
    return _profile_subgroups(spark, folder, connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))


def component_subgroups_at_8(spark, folder):
    return _profile_subgroups(spark, folder, linked_labels(dup_hamming_links_at_8(spark, folder)))


def result_subgroups(spark, folder):
    """Thumbnail profiles that several results of one component share, copies included, at the reference's distance."""
    members = dup_fingerprint_members(spark, folder)
    placed = copy_labels(members.select("class_id", "copies").distinct(), dup_hamming_links_at_8(spark, folder))
    return _profile_subgroups(spark, folder, members.join(placed, "class_id").select(F.col("result_id").alias("v"), "label"))


def difference_hashes(spark, folder):
    """Hashes of the first 8 rows of 9 numbers made of each vector's elements and their neighbours."""
    grid = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: F.element_at("embedding", (i % 64 + 1).cast("int")))
    return table(spark, folder, "embeddings", ["vec_id", "embedding"]).select("vec_id", difference_hash(grid).alias("hash"))


def hue_histogram(spark, folder):
    """Colours in twelve hues of 30 degrees, and their mean saturation."""
    r, g, b = ((F.col(c) * k) % 256 for c, k in (("l_partkey", 37), ("l_suppkey", 91), ("l_orderkey", 53)))
    hue, saturation = hue_and_saturation(r, g, b)
    rows = table(spark, folder, "lineitem", ["l_partkey", "l_suppkey", "l_orderkey"])
    return rows.select(F.floor(hue / 30).alias("bin"), saturation.alias("s")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 6).alias("saturation"))


def folder_name_keys(spark, folder):
    return table(spark, folder, "virtual_folders", ["folder_id", "name"]).select("folder_id", name_key("name").alias("key"))


QUERIES = {
    f.__name__: f
    for f in (exact_pair_page, trigram_search, retrieval_counts, candidates_with_evidence, faulty_cells, snapshot_page, stale_selection, component_subgroups, component_subgroups_at_8, result_subgroups, difference_hashes, hue_histogram, folder_name_keys)
}
_RGB = "(l_partkey * 37) % 256 as r, (l_suppkey * 91) % 256 as g, (l_orderkey * 53) % 256 as b"
_GOOD = """coalesce(case when status in ('unknown_missing_index', 'unknown_stale', 'unknown_invalid') then raw_score is null and reason is not null
  when status in ('matched', 'eligible') then raw_score is not null and reason is null when status = 'not_matched' then reason is null else false end and (raw_score is null or raw_score between -1 and 1), false)"""
SQL = {
    "exact_pair_page": """with d as (select sha256(text) as content, doc_id from documents where text is not null)
select row_number() over (order by x.content, x.doc_id, y.doc_id) as pair_no, x.content, x.doc_id as a, y.doc_id as b from d x join d y on x.content = y.content and x.doc_id < y.doc_id qualify pair_no between 101 and 150""",
    "trigram_search": "select doc_id from documents where contains(lower(text), 'market stall')",
    "retrieval_counts": f"""select condition_id, count(*) filter (where status = 'eligible') as eligible, count(*) filter (where status <> 'eligible') as ineligible, count(*) filter (where status = 'eligible' and item not in (select item from ({_AND}) where number <= 25)) as unretrieved
from (with {_CELLS} select * from cells where condition_id in ('near_first', 'near_second')) group by 1""",
    "candidates_with_evidence": f"""with {_CELLS}, ok as (select item from cells where condition_id = 'centre' and status = 'matched'),
  ranked as (select row_number() over (order by raw_score desc, item) as number, item from cells join ok using (item) where condition_id = 'near_second' qualify number <= 30)
select r.number, r.item, c.status as scene_status from ranked r left join cells c on c.item = r.item and c.condition_id = 'scene'""",
    "faulty_cells": f"with {_CELLS}, spoilt as (select item, condition_id, status, case when item % 5 = 0 then null else raw_score end as raw_score, reason from cells) select item, condition_id, status from spoilt where not {_GOOD}",
    "snapshot_page": f"select * from ({_AND}) where number between 21 and 40",
    "stale_selection": """with e as (select lower(trim(photo_id)) as photo_id, updated_at, original_relative_path as p, metadata_json as m from photos),
  a as (select * from e qualify row_number() over (partition by photo_id order by updated_at, m) = 1), b as (select * from e qualify row_number() over (partition by photo_id order by updated_at desc) = 1)
select photo_id from a join b using (photo_id) where a.p is distinct from b.p or a.m is distinct from b.m""",
    "component_subgroups": f"""with recursive {_BITS}, ways as (select a, b from links union select b, a from links), reach(v, o) as (select a, a from ways union select r.v, w.b from reach r join ways w on w.a = r.o),
  label as (select v, min(o) as label from reach group by 1), c as (select distinct lower(trim(result_id)) as v, thumbnail_profile as content from image_embedding_results where thumbnail_profile is not null)
select label, content, count(*) as members from label join c using (v) group by 1, 2 having count(*) > 1""",
    "component_subgroups_at_8": f"""with recursive {_AT_8} select label, content, count(*) as members
from label join (select distinct lower(trim(result_id)) as v, thumbnail_profile as content from image_embedding_results where thumbnail_profile is not null) using (v) group by 1, 2 having count(*) > 1""",
    "result_subgroups": f"""with recursive {_RESULTS} select label, content, count(*) as members
from label join (select distinct lower(trim(result_id)) as v, thumbnail_profile as content from image_embedding_results where thumbnail_profile is not null) using (v) group by 1, 2 having count(*) > 1""",
    "difference_hashes": """select vec_id, cast(list_sum(list_transform(range(1, 64), lambda i: case when e[(i // 8 * 9 + i % 8) % 64 + 1] > e[(i // 8 * 9 + i % 8 + 1) % 64 + 1] then cast(1 as hugeint) << (63 - i) else cast(0 as hugeint) end)) as bigint)
  + case when e[1] > e[2] then (-9223372036854775807 - 1)::bigint else 0::bigint end as hash from (select vec_id, embedding as e from embeddings)""",
    "hue_histogram": f"""select cast(floor(case when c = 0 then 0 when r = hi then case when g < b then 60 * ((g - b) / c + 6) else 60 * ((g - b) / c) end when g = hi then 60 * ((b - r) / c + 2) else 60 * ((r - g) / c + 4) end / 30) as bigint) as bin,
  count(*) as n, round(avg(case when hi = 0 then 0 else c / hi end), 6) as saturation
from (select *, cast(greatest(r, g, b) as double) as hi, cast(greatest(r, g, b) - least(r, g, b) as double) as c from (select {_RGB} from lineitem)) group by 1""",
    "folder_name_keys": "select folder_id, replace(lower(nfc_normalize(trim(name))), 'ß', 'ss') as key from virtual_folders",
}
