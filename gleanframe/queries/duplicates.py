"""Duplicates by content and by fingerprint, and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanframe.functions.ids import clean_id
from gleanframe.functions.vectors import cosine, dot, vector_status
from gleanframe.operators import duplicate_scan as ds
from gleanframe.operators import duplicates as d
from gleanframe.operators.current import current_rows
from gleanframe.operators.ordering import ranked_with_gaps
from gleanframe.sources.tables import table

DISTANCE = 4
REFERENCE_DISTANCE = 8  # the reference's default


def current_photos(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    rows = table(spark, folder, "photos").select(clean_id("photo_id").alias("photo_id"), "updated_at", *columns)
    return current_rows(rows, "photo_id", [F.col("updated_at").desc_nulls_last()])


def dup_exact_groups(spark, folder):
    return d.exact_groups(current_photos(spark, folder, "content_version"), "photo_id", "content_version")


def dup_exact_members(spark, folder):
    return d.exact_classes(current_photos(spark, folder, "content_version"), "photo_id", "content_version").where("copies > 1")


def dup_text_groups(spark, folder):
    rows = table(spark, folder, "documents", ["doc_id", "text"]).select("doc_id", F.sha2("text", 256).alias("content"))
    return d.exact_groups(rows, "doc_id", "content")


def _bits(spark, folder) -> DataFrame:
    """(item, bits) of the image vectors of 64 numbers."""
    rows = table(spark, folder, "image_embedding_results", ["result_id", "vector"]).where(vector_status(F.col("vector"), 64).isin("ready", "not_unit"))
    return rows.select(clean_id("result_id").alias("item"), d.sign_bits("vector").alias("bits"))


def _fingerprints(spark, folder) -> DataFrame:
    """One row a fingerprint of the image vectors of 64 numbers: (bits, item), item the least result with it."""
    return _bits(spark, folder).groupBy("bits").agg(F.min("item").alias("item"))


def dup_fingerprint_classes(spark, folder):
    return _fingerprints(spark, folder)


def dup_hamming_links(spark, folder):
    return d.hamming_links(_fingerprints(spark, folder), "item", "bits", DISTANCE)


def dup_components(spark, folder):
    return d.duplicate_groups(dup_hamming_links(spark, folder))


def dup_peer_summary(spark, folder):
    return d.peer_summary(dup_hamming_links(spark, folder))


def dup_hamming_links_at_8(spark, folder):
    return d.hamming_links(_fingerprints(spark, folder), "item", "bits", REFERENCE_DISTANCE)


def dup_components_at_8(spark, folder):
    links = dup_hamming_links_at_8(spark, folder)
    return d.duplicate_groups(links, d.linked_labels(links))


def dup_peer_summary_at_8(spark, folder):
    return d.peer_summary(dup_hamming_links_at_8(spark, folder))


def dup_fingerprint_members(spark, folder):
    """Every usable result with the least result of its fingerprint and their number."""
    return d.exact_classes(_bits(spark, folder), "item", "bits").withColumnRenamed("item", "result_id")


def _classes(spark, folder) -> DataFrame:
    """(bits, class_id, copies): each fingerprint with its least result and the number of its results."""
    return _bits(spark, folder).where("item is not null").distinct().groupBy("bits").agg(F.min("item").alias("class_id"), F.count(F.lit(1)).alias("copies"))


def dup_result_groups(spark, folder):
    """Groups of results, copies included, at the reference's distance."""
    classes = _classes(spark, folder)
    return d.copy_groups(classes, d.copy_links(classes, REFERENCE_DISTANCE))


def dup_result_peers(spark, folder):
    """The peers of results, copies included, at the reference's distance."""
    return d.copy_peers(dup_fingerprint_members(spark, folder), "result_id", d.copy_links(_classes(spark, folder), REFERENCE_DISTANCE))


def _photo_prints(spark, folder) -> DataFrame:
    """(photo_id, content, bits) of current photos: the content of those that could be ingested, the sign bits of the latest
    usable vector of the default profile."""
    photos = current_photos(spark, folder, "content_version", "ingest_state")
    good = (F.col("ingest_state") == "available") & F.col("content_version").rlike("\\A[0-9a-f]{64}\\z")
    default = table(spark, folder, "image_embedding_profiles", ["profile_id", "is_default", "created_at"]).where("is_default = 1").select(clean_id("profile_id").alias("p"), "created_at").orderBy(F.col("created_at").desc(), "p").limit(1)
    results = table(spark, folder, "image_embedding_results", ["result_id", "photo_id", "profile_id", "vector", "created_at"])
    own = results.join(F.broadcast(default.select("p")), clean_id("profile_id") == F.col("p")).select(clean_id("photo_id").alias("photo_id"), clean_id("result_id").alias("result_id"), "created_at", "vector")
    latest = current_rows(own, "photo_id", [F.col("created_at").desc_nulls_last(), F.col("result_id").desc_nulls_last()])
    usable = latest.where(vector_status(F.col("vector"), 64).isin("ready", "not_unit")).select("photo_id", d.sign_bits("vector").alias("bits"))
    valid = photos.select("photo_id", F.when(good, F.col("content_version")).alias("content"))
    return valid.join(usable, "photo_id", "left").select("photo_id", "content", F.when(F.col("content").isNotNull(), F.col("bits")).alias("bits"))


def _scan(spark, folder, distance=REFERENCE_DISTANCE):
    return ds.cells_of_items(_photo_prints(spark, folder), "photo_id", "content", "bits", distance)


def dup_scan_groups(spark, folder):
    """Groups of duplicate photos, exact and similar ones together."""
    return ds.scan_groups(_scan(spark, folder))


def dup_scan_matches(spark, folder):
    """Each photo with a duplicate: its peers and its best match."""
    return ds.item_matches(_scan(spark, folder))


def dup_scan_summary(spark, folder):
    """Numbers of a scan, by kind of group."""
    return dup_scan_groups(spark, folder).groupBy("kind").agg(
        F.count(F.lit(1)).alias("groups"), F.sum("members").alias("photos"), F.sum("exact_pairs").alias("exact_pairs"), F.sum("similar_pairs").alias("similar_pairs")
    )


def dup_hamming_links_at_20(spark, folder):
    """Pairs of photos' vectors that are within 20 bits, beyond which bands don't help."""
    prints = _photo_prints(spark, folder).where("bits is not null").groupBy("bits").agg(F.min("photo_id").alias("item"))
    return d.hamming_links(prints, "item", "bits", 20)


def cosine_topk(spark, folder):
    rows = table(spark, folder, "embeddings", ["vec_id", "embedding"])
    query = rows.where("vec_id = 0").select(F.col("embedding").alias("q"))
    scored = rows.crossJoin(F.broadcast(query.limit(1))).select("vec_id", cosine(F.col("embedding"), F.col("q")).alias("score"))
    ranked = ranked_with_gaps(scored.withColumn("score", F.round("score", 6)), "score", "vec_id", 20)
    return ranked.select("vec_id", "score", "rank", F.round("gap_from_best", 6).alias("gap_from_best"), F.round("gap_to_next", 6).alias("gap_to_next"))


def _prototypes(spark, folder) -> DataFrame:
    """(label, prototype): the mean vector of each label, of unit length; as many rows as labels."""
    rows = table(spark, folder, "embeddings", ["label", "embedding"]).select("label", F.posexplode("embedding").alias("at", "x"))
    means = rows.groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("m"))
    whole = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda s: s["m"]).alias("mean"))
    return whole.select("label", F.transform("mean", lambda x: F.try_divide(x, F.sqrt(dot(F.col("mean"), F.col("mean"))))).alias("prototype"))


def scene_prototypes(spark, folder):
    """The elements of the labels' prototypes."""
    return _prototypes(spark, folder).select("label", F.posexplode("prototype").alias("at", "x")).select("label", "at", F.round("x", 6).alias("x"))


def scene_scores(spark, folder):
    items = table(spark, folder, "embeddings", ["vec_id", "embedding"])
    scored = items.crossJoin(_prototypes(spark, folder))
    return scored.select("vec_id", "label", F.round(cosine(F.col("embedding"), F.col("prototype")), 6).alias("score"))


def scene_predicate(spark, folder):
    return scene_scores(spark, folder).where("label = 3").select("vec_id", F.when(F.col("score") >= 0.1, "matched").otherwise("not_matched").alias("status"))


def vector_states(spark, folder):
    rows = table(spark, folder, "image_embedding_results", ["result_id", "vector"])
    return rows.groupBy(vector_status(F.col("vector"), 64).alias("status")).agg(F.count(F.lit(1)).alias("results"))


_CURRENT = """current as (select * from (select lower(trim(photo_id)) as pid, *, row_number() over (partition by lower(trim(photo_id))
  order by updated_at desc nulls last) as k from photos where trim(photo_id) <> '') where k = 1)"""
_BITS = """bits as (select bits, min(item) as item from (select lower(trim(result_id)) as item,
    cast(list_sum(list_transform(range(1, 64), lambda i: case when vector[i + 1] > 0 then cast(1 as hugeint) << (63 - i) else cast(0 as hugeint) end)) as bigint)
    + case when vector[1] > 0 then (-9223372036854775807 - 1)::bigint else 0::bigint end as bits
  from image_embedding_results where len(vector) = 64 and len(list_filter(vector, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(vector, lambda x: x <> 0)) > 0) group by 1),
links as (select a.item as a, b.item as b, cast(bit_count(xor(a.bits, b.bits)) as int) as distance from bits a join bits b on a.item < b.item and bit_count(xor(a.bits, b.bits)) <= 4)"""

# The same at the reference's distance; fingerprints as text of 64 digits, compared digit by digit.
_AT_8 = """bits as (select text, min(item) as item from (select lower(trim(result_id)) as item, array_to_string(list_transform(vector, lambda x: case when x > 0 then '1' else '0' end), '') as text
  from image_embedding_results where len(vector) = 64 and len(list_filter(vector, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0) group by 1),
links as (select a.item as a, b.item as b, cast(hamming(a.text, b.text) as int) as distance from bits a join bits b on a.item < b.item and hamming(a.text, b.text) <= 8),
ways as (select a as item, b as peer, distance from links union all select b, a, distance from links),
reach(v, o) as (select item, item from ways union select r.v, w.peer from reach r join ways w on w.item = r.o), label as (select v, min(o) as label from reach group by 1)"""

# All results, copies too, compared pair by pair.
_RESULTS = """results as (select distinct lower(trim(result_id)) as item, array_to_string(list_transform(vector, lambda x: case when x > 0 then '1' else '0' end), '') as text
  from image_embedding_results where trim(result_id) <> '' and len(vector) = 64 and len(list_filter(vector, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0),
ways as (select a.item, b.item as peer, cast(hamming(a.text, b.text) as int) as distance from results a join results b on a.item <> b.item and hamming(a.text, b.text) <= 8),
reach(v, o) as (select item, item from ways union select r.v, w.peer from reach r join ways w on w.item = r.o), label as (select v, min(o) as label from reach group by 1)"""

QUERIES = {
    f.__name__: f
    for f in (dup_scan_groups, dup_scan_matches, dup_scan_summary, dup_hamming_links_at_20, scene_prototypes, dup_exact_groups, dup_exact_members, dup_text_groups, dup_fingerprint_classes, dup_hamming_links, dup_components, dup_peer_summary, dup_hamming_links_at_8, dup_components_at_8, dup_peer_summary_at_8, dup_fingerprint_members, dup_result_groups, dup_result_peers, cosine_topk, scene_scores, scene_predicate, vector_states)
}
_SCENES = """scores as (with m as (select label, i, avg(cast(embedding[i] as double)) as m from embeddings, range(1, 65) t(i) group by 1, 2),
  p as (select label, list(m order by i) as p from m group by 1)
  select vec_id, p.label, round(list_cosine_similarity(cast(embedding as double[]), p.p), 6) as score from embeddings, p)"""
# Photo by photo, every two compared.
_PHOTO = f"""{_CURRENT}, latest as (select * from (select lower(trim(photo_id)) as pid, vector, row_number() over (partition by lower(trim(photo_id)) order by created_at desc nulls last, lower(trim(result_id)) desc nulls last) as k
    from image_embedding_results where lower(trim(profile_id)) = (select lower(trim(profile_id)) from image_embedding_profiles where is_default = 1 order by created_at desc, 1 limit 1)) where k = 1),
  prints as (select pid, array_to_string(list_transform(vector, lambda x: case when x > 0 then '1' else '0' end), '') as text from latest
    where len(vector) = 64 and len(list_filter(vector, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0),
  photo as (select c.pid, c.content_version as content, p.text from current c left join prints p using (pid) where c.ingest_state = 'available' and regexp_full_match(c.content_version, '[0-9a-f]{{64}}'))"""
_SCAN = f"""{_PHOTO}, ways as (select a.pid as item, b.pid as peer, a.content = b.content as exact, cast(case when a.content = b.content then 0 else hamming(a.text, b.text) end as int) as distance
    from photo a join photo b on a.pid <> b.pid and (a.content = b.content or hamming(a.text, b.text) <= 8))"""
_SCANNED = f"""{_SCAN}, reach(v, o) as (select item, item from ways union select r.v, w.peer from reach r join ways w on w.item = r.o), label as (select v, min(o) as g from reach group by 1),
  pairs as (select g, count(*) filter (where exact) as exact_pairs, count(*) filter (where not exact) as similar_pairs, min(distance) filter (where not exact) as min_distance from ways join label on v = item where item < peer group by 1),
  groups as (select g as group_id, case when similar_pairs = 0 then 'exact' when exact_pairs > 0 then 'mixed' else 'similar' end as kind, members, exact_pairs, similar_pairs, min_distance from pairs join (select g, count(*) as members from label group by 1) using (g))"""
SQL = {
    "dup_scan_groups": f"with recursive {_SCANNED} select row_number() over (order by kind <> 'exact', coalesce(min_distance, -1), members desc, group_id) as number, * from groups",
    "dup_scan_matches": f"""with recursive {_SCAN} select item, count(*) filter (where exact) as exact_peers, count(*) filter (where not exact) as similar_peers, min(distance) filter (where not exact) as min_distance,
  case when bool_or(exact) then 'exact' else 'hamming' end as metric, cast(case when bool_or(exact) then 0 else min(distance) end as int) as best_distance,
  coalesce(min(peer) filter (where exact), arg_min(peer, (distance, peer))) as best_match from ways group by 1""",
    "dup_scan_summary": f"with recursive {_SCANNED} select kind, count(*) as groups, cast(sum(members) as bigint) as photos, cast(sum(exact_pairs) as bigint) as exact_pairs, cast(sum(similar_pairs) as bigint) as similar_pairs from groups group by 1",
    "dup_hamming_links_at_20": f"with {_PHOTO}, one as (select text, min(pid) as item from photo where text is not null group by 1) select a.item as a, b.item as b, cast(hamming(a.text, b.text) as int) as distance from one a join one b on a.item < b.item and hamming(a.text, b.text) <= 20",
    "dup_exact_groups": f"with {_CURRENT} select content_version, min(pid) as class_id, count(*) as members, count(*) * (count(*) - 1) // 2 as exact_pairs from current where content_version is not null group by 1 having count(*) > 1",
    "dup_exact_members": f"with {_CURRENT} select pid as photo_id, min(pid) over w as class_id, count(*) over w as copies from current where content_version is not null window w as (partition by content_version) qualify copies > 1",
    "dup_text_groups": "select sha256(text) as content, min(doc_id) as class_id, count(*) as members, count(*) * (count(*) - 1) // 2 as exact_pairs from documents where text is not null group by 1 having count(*) > 1",
    "dup_fingerprint_classes": f"with {_BITS} select bits, item from bits",
    "dup_hamming_links": f"with {_BITS} select * from links",
    "dup_components": f"""with recursive {_BITS}, ways as (select a, b from links union select b, a from links),
  reach(v, o) as (select a, a from ways union select r.v, w.b from reach r join ways w on w.a = r.o),
  label as (select v, min(o) as g from reach group by 1)
select g as group_id, count(*) as members, any_value(links) as links, any_value(lo) as least_distance,
  any_value(case when hi = 0 then 'exact' when lo = 0 then 'mixed' else 'similar' end) as kind
from label join (select g as e, count(*) as links, min(distance) as lo, max(distance) as hi from links join label on v = a group by 1) on e = g group by 1""",
    "dup_peer_summary": f"""with {_BITS}, ways as (select a as item, b as peer, distance from links union all select b, a, distance from links)
select item, count(*) as peers, min(distance) as least_distance, arg_min(peer, (distance, peer)) as best_peer from ways group by 1""",
    "dup_hamming_links_at_8": f"with recursive {_AT_8} select * from links",
    "dup_components_at_8": f"""with recursive {_AT_8} select label as group_id, any_value(members) as members, count(*) as links, min(distance) as least_distance,
  case when max(distance) = 0 then 'exact' when min(distance) = 0 then 'mixed' else 'similar' end as kind
from links join label on v = a join (select label, count(*) as members from label group by 1) using (label) group by 1""",
    "dup_peer_summary_at_8": f"with recursive {_AT_8} select item, count(*) as peers, min(distance) as least_distance, arg_min(peer, (distance, peer)) as best_peer from ways group by 1",
    "dup_fingerprint_members": f"with recursive {_RESULTS} select item as result_id, min(item) over w as class_id, count(*) over w as copies from results window w as (partition by text)",
    "dup_result_groups": f"""with recursive {_RESULTS}, pairs as (select label, count(*) filter (where distance = 0) as exact_pairs, count(*) filter (where distance > 0) as similar_pairs, min(distance) filter (where distance > 0) as least_distance
  from ways join label on v = item where item < peer group by 1)
select label as group_id, (select count(*) from label l where l.label = p.label) as members, exact_pairs, similar_pairs, least_distance,
  case when similar_pairs = 0 then 'exact' when exact_pairs = 0 then 'similar' else 'mixed' end as kind from pairs p""",
    "dup_result_peers": f"""with recursive {_RESULTS} select item, count(*) filter (where distance = 0) as exact_peers, count(*) filter (where distance > 0) as similar_peers,
  min(distance) as least_distance, arg_min(peer, (distance, peer)) as best_peer from ways group by 1""",
    "scene_prototypes": """with m as (select label, i, avg(cast(embedding[i] as double)) as m from embeddings, range(1, 65) t(i) group by 1, 2), n as (select label, sqrt(sum(m * m)) as n from m group by 1)
select label, cast(i - 1 as int) as at, round(m / n, 6) as x from m join n using (label)""",
    "cosine_topk": """with s as (select e.vec_id, round(list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[])), 6) as score from embeddings e, (select embedding from embeddings where vec_id = 0) q),
  r as (select *, row_number() over (order by score desc, vec_id) as rank, max(score) over () as best, lead(score) over (order by score desc, vec_id) as next from s)
select vec_id, score, cast(rank as int) as rank, round(best - score, 6) as gap_from_best, round(score - next, 6) as gap_to_next from r where rank <= 20""",
    "scene_scores": f"with {_SCENES} select * from scores",
    "scene_predicate": f"with {_SCENES} select vec_id, case when score >= 0.1 then 'matched' else 'not_matched' end as status from scores where label = 3",
    "vector_states": """select case when vector is null then 'missing' when len(vector) <> 64 then 'wrong_dimensions'
    when len(list_filter(vector, lambda x: x is null or not isfinite(x))) > 0 then 'not_finite'
    when len(list_filter(vector, lambda x: x <> 0)) = 0 then 'zero'
    when abs(sqrt(list_sum(list_transform(vector, lambda x: cast(x as double) * x))) - 1) > 1e-4 then 'not_unit' else 'ready' end as status,
  count(*) as results from image_embedding_results group by 1""",
}
