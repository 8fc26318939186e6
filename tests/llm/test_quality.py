from __future__ import annotations

import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanframe.llm.quality import KINDS, QualitySettings, classify, document_statistics, outlierness, prose_limit, prose_model
from gleanframe.llm.text_stats import STATISTICS, language_of, statistics, words_of

COMMON = {"en": frozenset("the a of and is in it was to we".split()), "de": frozenset("der die das und ist nicht".split()), "zh-CN": frozenset("的了在是"), "ja": frozenset("のにはを")}


def stats(text, lang="en"):
    return dict(zip(STATISTICS, statistics(text, lang, words_of(text), COMMON[lang])))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=400))
def test_finite_for_any_text(text):
    words = words_of(text)
    lang = language_of(text, words, None, COMMON)
    values = statistics(text, lang, words, COMMON[lang])
    assert len(values) == len(STATISTICS) and all(math.isfinite(v) for v in values)


def test_values():
    s = stats("The light is in the room. It was a good day.")
    assert round(math.expm1(s["word_count"])) == 11 and s["punctuated_line_share"] == 1 and s["sentence_share"] == 1
    assert s["mean_word_length"] == sum(map(len, words_of("The light is in the room It was a good day"))) / 11
    assert s["symbol_ratio"] == 2 / 44 and s["common_word_share"] == 7 / 11
    assert stats("- apple\n- pear\n- plum")["bullet_share"] == 1
    assert stats("a | b | c\n1 | 2 | 3")["field_share"] == 1
    assert stats("fence, fence, fence, fence")["top_segment_share"] == 1
    assert stats("   \n ") == dict.fromkeys(STATISTICS, 0.0)


def test_language():
    pick = lambda t, d=None: language_of(t, words_of(t), d, COMMON)
    assert [pick("der Hund und die Katze"), pick("桥洞的阴影"), pick("静かな影は橋の"), pick("xyz", " DE "), pick("xyz", "zz")] == ["de", "zh-CN", "ja", "de", "de"]


def test_held_out_labels(spark):
    """Half of the labels decide on the other half; some labels are wrong, so not all can be met."""
    folder = "/root/testdata/sf0.1"
    read = lambda n: spark.read.parquet(f"{folder}/{n}.parquet")
    labels = read("document_labels").select("doc_id", F.lower(F.trim("text_kind")).alias("text_kind"))
    documents = read("documents").join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    scored = document_statistics(documents, "doc_id", "text", "lang", read("common_words")).cache()
    scored = outlierness(scored, "doc_id", prose_model(scored)).cache()
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    got = classify(scored, labels.where(half == 0), "doc_id", "text_kind")
    both = got.join(labels.where(half == 1).withColumnRenamed("text_kind", "true"), "doc_id").select("text_kind", "true").collect()
    assert sum(a == b for a, b in both) / len(both) > 0.9
    row = scored.orderBy(F.col("distance").desc()).first()
    assert abs(sum(row["contributions"]) - row["distance"] ** 2) < 1e-6 * max(1, row["distance"] ** 2)


def test_distance_decides_prose(spark):
    """Documents within the limit are prose whatever the labels say; the limit is the root of a chi-square quantile."""
    assert abs(prose_limit(QualitySettings(), 38) ** 2 - 70.70) < 0.1  # of 38 degrees of freedom at 0.999
    n = len(STATISTICS)
    rows = [(i, "en", [0.0] * n, 1.0 if i < 10 else 50.0 + i, [float(i % 3)] * n) for i in range(40)]
    scored = spark.createDataFrame(rows, "doc_id bigint, language string, stats array<double>, distance double, contributions array<double>")
    labels = spark.createDataFrame([(i, "junk" if i % 2 else "table") for i in range(40)], "doc_id bigint, text_kind string")
    out = {r["doc_id"]: r["text_kind"] for r in classify(scored, labels, "doc_id", "text_kind").collect()}
    assert {k for k, v in out.items() if v == "prose"} == set(range(10)) and len(out) == 40


def test_statistics_query_gives_all_contributions(spark, data):
    from gleanframe.llm.prose import p9_statistics

    rows = p9_statistics(spark, data).where("language is not null").limit(50).collect()
    assert all(set(r["contributions"]) == set(STATISTICS) for r in rows)
    assert all(abs(sum(r["contributions"].values()) - r["distance"] ** 2) < 1e-3 * max(1, r["distance"] ** 2) for r in rows)


def test_edge_cases(spark):
    schema = "doc_id bigint, text string, lang string, stats string"
    rows = [(1, None, None, ""), (2, "", "en", ""), (3, " \n", "en", ""), (4, "the cat is in the house and it was good to see.", "xx", ""), (5, "a1b2 " * 20000, None, ""), (5, "a1b2 " * 20000, None, "")]
    words = spark.createDataFrame([("en", "the"), ("en", "is"), ("en", None), (None, "x")], "lang string, word string")
    got = document_statistics(spark.createDataFrame(rows, schema), "doc_id", "text", "lang", words)
    assert got.count() == 6 and {r["doc_id"]: r["language"] for r in got.collect()}[3] is None
    model = prose_model(got)
    kinds = classify(outlierness(got, "doc_id", model), spark.createDataFrame([], "doc_id bigint, text_kind string"), "doc_id", "text_kind")
    out = {r["doc_id"]: r["text_kind"] for r in kinds.collect()}
    assert set(out) == {4, 5} and out[4] == "prose" and set(out.values()) <= set(KINDS)
    none = document_statistics(spark.createDataFrame([], schema), "doc_id", "text", "lang", words)
    assert outlierness(none, "doc_id", prose_model(none)).count() == 0
