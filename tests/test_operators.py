from __future__ import annotations

import random

import pytest
from conftest import normal
from pyspark.sql import functions as F

from gleanframe.functions.colour import palette_color
from gleanframe.functions.dates import date_bucket, skip_reason
from gleanframe.functions.text import contains, file_name, fold_recognised, fold_text, snippet
from gleanframe.functions.vectors import cosine, vector_status
from gleanframe.operators import duplicates as d
from gleanframe.operators import geometry as g
from gleanframe.operators import ordering as o
from gleanframe.operators import predicates as p
from gleanframe.operators import reviews as r
from gleanframe.operators import scopes as sc
from gleanframe.operators import search as s
from gleanframe.operators import versions as v
from gleanframe.operators.components import connected_components
from gleanframe.plans.conditions import InvalidQuery, fingerprint, normalize
from gleanframe.streaming.scans import stream_changes


def components(edges):
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            for x in (a, b):
                if label[x] != low:
                    label[x], changed = low, True
    return label


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 130)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    df = spark.createDataFrame([*edges, (5, 5), (None, 4), (1, 0)], "u bigint, v bigint")
    kept = [e for e in edges if e[0] != e[1]]
    assert dict(map(tuple, connected_components(df).collect())) == components(kept)
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


@pytest.mark.parametrize("distance", [0, 1, 3, 8])
def test_hamming_links_equal_all_pairs(spark, distance):
    rng = random.Random(distance)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = base + [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(10))) & (2**64 - 1) for b in base for _ in range(3)] + [0, 1, 3, 2**64 - 1]
    signed = [x - 2**64 if x >= 2**63 else x for x in (y & (2**64 - 1) for y in values)]
    df = spark.createDataFrame(list(enumerate(signed)) + [(None, 1), (999, None)], "k int, h bigint")
    expected = [(i, j, ((a ^ b) & (2**64 - 1)).bit_count()) for i, a in enumerate(signed) for j, b in enumerate(signed) if i < j and ((a ^ b) & (2**64 - 1)).bit_count() <= distance]
    assert sorted(map(tuple, d.hamming_links(df, "k", "h", distance).collect())) == expected


def test_duplicate_groups(spark):
    links = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("x", "y", 0), ("p", "q", 0), ("q", "r", 3)], "a string, b string, distance int")
    assert sorted(map(tuple, d.duplicate_groups(links).collect())) == [("a", 3, 2, 1, "similar"), ("p", 3, 2, 0, "mixed"), ("x", 2, 1, 0, "exact")]
    assert sorted(map(tuple, d.peer_summary(links).collect()))[:2] == [("a", 1, 1, "b"), ("b", 2, 1, "a")]
    items = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "1"), ("c", None), (None, "1"), ("d", "2")], "k string, c string")
    assert sorted(map(tuple, d.exact_groups(items, "k", "c").collect())) == [("1", "a", 2, 1)]


def test_hash_from_hex(spark):
    df = spark.createDataFrame([("00000000000000ff",), ("ffffffffffffffff",), ("zz",), ("00000000000000FF",), (None,)], "x string")
    assert [x[0] for x in df.select(d.hash_from_hex("x")).collect()] == [255, -1, None, None, None]


def test_percentiles(spark):
    rows = [("c", i, x) for i, x in enumerate([-0.9, -0.3, -0.3, 0.4])] + [("one", 1, 5.0)] + [("same", i, 2.0) for i in range(3)]
    got = o.average_rank_percentile(spark.createDataFrame(rows, "g string, k int, x double"), "g", "k", "x")
    assert normal(map(tuple, got.select("g", "k", "normalized").collect())) == normal(
        [("c", 0, 0.0), ("c", 1, 0.5), ("c", 2, 0.5), ("c", 3, 1.0), ("one", 1, 1.0), ("same", 0, 1.0), ("same", 1, 1.0), ("same", 2, 1.0)]
    )


def test_numbered_and_pages(spark):
    df = spark.range(0, 1000, 1, 7).withColumn("x", (F.col("id") * 7919) % 1009)
    got = [tuple(x) for x in o.numbered(df, [F.col("x")]).select("number", "x").orderBy("number").collect()]
    assert [n for n, _ in got] == list(range(1, 1001)) and [x for _, x in got] == sorted(x for _, x in got)
    assert o.numbered(df.limit(0), [F.col("x")]).count() == 0
    page = o.keyset_page(spark.range(10), "id", 6, 3)
    assert [(x["id"], x["next_cursor"]) for x in page.orderBy("id").collect()] == [(7, None), (8, None), (9, None)]
    assert [(x["id"], x["next_cursor"]) for x in o.keyset_page(spark.range(10), "id", 9, 2, True).orderBy("id").collect()] == [(7, 7), (8, 7)]


def test_colours(spark):
    named = {(255, 0, 0): "red", (50, 50, 50): "black", (51, 51, 51): "gray", (216, 216, 216): "gray", (217, 217, 217): "white", (255, 128, 0): "orange", (255, 255, 0): "yellow", (0, 255, 0): "green", (0, 255, 255): "cyan", (0, 0, 255): "blue", (128, 0, 255): "purple", (255, 0, 255): "magenta", (255, 0, 30): "red", (0, 0, 0): "black"}
    df = spark.createDataFrame([(*k, n) for k, n in named.items()], "r int, g int, b int, n string")
    assert df.where(palette_color(F.col("r"), F.col("g"), F.col("b")) != F.col("n")).count() == 0
    assert spark.range(1).select(palette_color(F.lit(None).cast("int"), F.lit(1), F.lit(1))).first()[0] is None


def test_text(spark):
    df = spark.createDataFrame([("Straße ÄÖ",), ("PLAIN",), (None,), ("",), ("ﬁne  Ｔｅｘｔ\n x",)], "t string")
    assert [x[0] for x in df.select(fold_text(F.col("t"))).collect()] == ["strasse äö", "plain", None, "", "fine  ｔｅｘｔ\n x"]
    assert df.select(fold_recognised(F.col("t"))).collect()[4][0] == "fine text x"
    assert df.select(contains(F.col("t"), "%")).collect()[0][0] is False
    long = spark.createDataFrame([("a" * 100 + "needle" + "b" * 300,)], "t string")
    assert long.select(snippet(F.col("t"), "needle")).first()[0] == "a" * 40 + "needle" + "b" * 114
    paths = spark.createDataFrame([("C:\\x\\y.jpg",), ("/a/b.png",), ("c",)], "p string")
    assert [x[0] for x in paths.select(file_name(F.col("p"))).collect()] == ["y.jpg", "b.png", "c"]


def test_dates(spark):
    cases = {"2024:02:29 10:00:00": ("2024-02-29", None), "2023:02:29 10:00:00": (None, "invalid_datetime_original_value"), "0000:01:01 00:00:00": (None, "invalid_datetime_original_value"), "2024:02:29 10:00:00\n": (None, "invalid_datetime_original_format"), "": (None, "missing_datetime_original"), "2024-02-29": (None, "invalid_datetime_original_format"), "2024:01:01 24:00:00": (None, "invalid_datetime_original_value")}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    got = {x["t"]: (x["b"], x["s"]) for x in df.select("t", date_bucket(F.col("t"), "day").alias("b"), skip_reason(F.col("t")).alias("s")).collect()}
    assert got == cases | {None: (None, "missing_datetime_original")}


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([0.6, 0.8],), ([0.0, 0.0],), (None,), ([float("nan"), 1.0],), ([3.0, 4.0],), ([1.0],)], "v array<float>")
    assert [x[0] for x in df.select(vector_status(F.col("v"), 2)).collect()] == ["ready", "ready", "zero", "missing", "not_finite", "not_unit", "wrong_dimensions"]
    c = df.limit(4).select(F.round(cosine(F.col("v"), F.array(F.lit(1.0), F.lit(0.0))), 6)).collect()
    assert [x[0] for x in c] == [1.0, 0.6, None, None]


def test_coverage_decides_first(spark):
    cases = [("ready", True, None, None), ("ready", False, None, "unknown_invalid"), ("missing", True, None, "unknown_missing_index"), (None, True, None, "unknown_missing_index"), ("stale", True, None, "unknown_stale"), ("dependency_missing", True, "stale", "unknown_stale"), ("dependency_missing", True, "invalid_vector", "unknown_invalid"), ("dependency_missing", True, None, "unknown_missing_index"), ("invalid_result", True, None, "unknown_invalid")]
    df = spark.createDataFrame(cases, "c string, ok boolean, up string, expected string")
    got = df.select(p.coverage_unknown(F.col("c"), F.col("ok"), F.col("up"))["status"].alias("s"), "expected").collect()
    assert all(x["s"] == x["expected"] for x in got)
    cell = p.cell(F.lit(False), None, p.coverage_unknown(F.col("c"), F.col("ok"), F.col("up")))
    assert {x[0]["status"] for x in df.where("c = 'stale'").select(cell).collect()} == {"unknown_stale"}


def test_no_peer_is_not_no_match_while_some_are_unknown(spark):
    links = spark.createDataFrame([("a", 1, 0, "b"), ("b", 1, 0, "a")], "item string, peers bigint, least_distance int, best_peer string")
    scope = spark.createDataFrame([("a", None), ("b", None), ("c", None), ("d", "unknown_stale"), ("e", "unknown_missing_index")], "k string, unknown string")
    assert {x["k"]: x["status"] for x in p.near_duplicate_cells(scope, "k", "unknown", links).collect()} == {"a": "matched", "b": "matched", "c": "unknown_stale", "d": "unknown_stale", "e": "unknown_missing_index"}
    known = scope.where("unknown is null")
    assert {x["k"]: x["status"] for x in p.near_duplicate_cells(known, "k", "unknown", links).collect()}["c"] == "not_matched"


def cells(spark, rows):
    return spark.createDataFrame(rows, "item string, condition_id string, status string, raw_score double")


def test_queues(spark):
    c = cells(spark, [("a", "q", "eligible", 0.1), ("b", "q", "eligible", 0.9), ("c", "q", "unknown_stale", None), ("a", "r", "eligible", 0.9), ("b", "r", "eligible", 0.1), ("c", "r", "eligible", 0.5), ("d", "s", "matched", 1.0), ("e", "s", "unknown_invalid", None)])
    assert [x["item"] for x in s.candidates(c, ["q", "r"], "or").orderBy("number").collect()] == ["b", "a", "c", "d"]
    assert [x["item"] for x in s.candidates(c, ["q", "r"], "or", 2).orderBy("number").collect()] == ["b", "a"]
    assert sorted(x["item"] for x in s.supported(c, "and").collect()) == ["a", "b", "d"]


def test_interleaving_keeps_order_within_patterns(spark):
    rng = random.Random(1)
    c = cells(spark, [(f"i{i:03}", k, "matched" if rng.random() < 0.6 else "not_matched", rng.random()) for i in range(60) for k in "xyz"])
    scores = s.pattern_scores(c)
    ranked = s.interleaved(scores, "s").orderBy("result_rank").collect()
    assert [x["result_rank"] for x in ranked] == list(range(1, len(ranked) + 1)) and len(ranked) == scores.count()
    assert [x["matched_count"] for x in ranked] == sorted((x["matched_count"] for x in ranked), reverse=True)
    for pattern in {x["matched_ids"] for x in ranked}:
        own = [(-x["pattern_score"], x["item"]) for x in ranked if x["matched_ids"] == pattern]
        assert own == sorted(own)
    assert [x["item"] for x in ranked] == [x["item"] for x in s.interleaved(scores.repartition(3), "s").orderBy("result_rank").collect()]


def test_queries_are_closed_documents():
    good = {"conditions": [{"id": "a", "kind": "scene", "scene_id": "x", "minimum": 0.1}, {"id": "b", "kind": "scene", "minimum": 0.1, "scene_id": "x"}], "operator": "and"}
    q = normalize(good)
    assert len(q.conditions) == 1 and q.aliases == {"b": "a"} and q.limit == 10
    for bad in ({}, good | {"more": 1}, good | {"operator": None}, good | {"candidate_limit": 0}, {"conditions": [{"id": "a", "kind": "scene", "scene_id": "x", "minimum": 2}]}, {"conditions": [{"id": "a", "kind": "none"}]}):
        with pytest.raises(InvalidQuery):
            normalize(bad)
    assert fingerprint({"b": 1, "a": "ß"}) == fingerprint({"a": "ß", "b": 1})


def test_scopes(spark):
    members = sc.memberships(spark.createDataFrame([("F1", "a"), ("f1 ", "A "), ("f1", "b"), ("f2", "b"), ("f2", None), ("f2", "c")], "folder_id string, photo_id string"))
    pick = lambda mode, fs: sorted(x[0] for x in sc.scope(members, fs, mode).collect())
    assert pick("union", ["f1", "f2"]) == ["a", "b", "c"] and pick("intersection", ["f1", "f2", "f1"]) == ["b"] and pick("intersection", ["f1", "none"]) == []
    asked = spark.createDataFrame([("a",), ("z",), ("z",)], "item string")
    assert tuple(sc.addition_counts(members, "f1", asked).first()) == (3, 2, 1, 1, 1)
    with pytest.raises(ValueError):
        sc.scope(members, [])


def test_versions(spark):
    old = spark.createDataFrame([("a", "1", "ok"), ("b", "1", "ok"), ("c", "1", "missing"), ("d", "1", "ok")], "k string, x string, st string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1"), ("e", "1")], "k string, x string")
    diff = lambda **kw: {r["k"]: r["change"] for r in v.scan_diff(old, new, "k", "x", "st", **kw).collect()}
    assert diff() == {"a": "unchanged", "b": "updated", "c": "restored", "d": "missing", "e": "added"}
    assert "d" not in diff(complete=False)
    assert v.same_rows(new, new.repartition(2)) and not v.same_rows(new, new.unionByName(new.limit(1)))
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "source int, target int")
    got = sorted(map(tuple, v.reachable(edges, spark.createDataFrame([(1,), (4,)], "node int")).collect()))
    assert got == [(1, 1, 3), (1, 2, 1), (1, 3, 2), (4, 5, 1)]


def test_reviews(spark):
    df = spark.createDataFrame([(7.0, 7.0, 7.5), (7.0, None, 7.0), (None, None, None), (7.3, 11.0, -1.0)], "a double, b double, c double")
    scores = [r.half_step(F.col(c)) for c in "abc"]
    got = [(None if x[0] is None else float(x[0]), x[1]) for x in df.select(r.mean_score(scores), r.review_status(scores)).collect()]
    assert got == [(7.17, "reviewed"), (None, "partial"), (None, "unreviewable"), (None, "unreviewable")]
    calls = spark.createDataFrame([("r", 1, 5), ("r", 1, 5), ("r", 2, None), ("s", 3, 4)], "run string, id int, n int")
    assert sorted(map(tuple, r.usage_totals(calls, ["run"], "id", ["n"]).collect())) == [("r", 2, None, 5), ("s", 1, 4, 4)]


def test_geometry(spark):
    cases = [([[0.0, 0.0, 1.0, 1.0]], 1.0), ([[0.0, 0.0, 0.5, 0.5], [0.25, 0.25, 0.75, 0.75]], 0.4375), ([], 0.0), (None, None), ([[0.0, 0.0, 0.5, 0.25], [0.0, 0.0, 0.5, 0.25]], 0.125)]
    df = spark.createDataFrame([(b,) for b, _ in cases], "b array<array<double>>")
    assert [x[0] for x in df.select(g.union_area("b")).collect()] == [a for _, a in cases]
    assert df.select(g.bounding_area(F.col("b"))).collect()[1][0] == 0.5625
    kept = spark.createDataFrame([([[0.0, 0.0, 1.0, 1.0], [0.0, 0.0, 1.0, 0.9], [2.0, 2.0, 3.0, 3.0]], [0.5, 0.9, 0.1], 0.5)], "b array<array<double>>, s array<double>, l double")
    assert kept.select(g.suppress_overlaps("b", "s", "l")).first()[0] == [1, 2]


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    for n, rows in enumerate([[("a", "1", 1), ("b", "1", 1)], [("a", "2", 2), ("c", "1", 2)], [("b", "1", 3)]]):
        spark.createDataFrame(rows, "k string, x string, t bigint").coalesce(1).write.mode("append").parquet(str(source))
        del n
    got = stream_changes(spark, str(source), "k string, x string, t bigint", "k", "x", "t", str(tmp_path / "out"))
    assert sorted((x["change"]) for x in got.collect()).count("added") == 3
