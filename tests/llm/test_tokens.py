from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanframe.llm import tokens as t
from gleanframe.llm.packing import pack, plan_containers, utilisation

PATH = t.tokenizer_path("byte_bpe_50k")
SAMPLES = [None, "", "   ", "Hello world", "<|endoftext|>", "naïve café 👩‍👩‍👧 日本語 العربية", "\x00\x1f�‮", "a" * 500, "x " * 300, "\n\n\t  \r\n", "é́"]


def test_ids_are_the_tokenizers(spark):
    df = spark.createDataFrame(list(enumerate(SAMPLES)), "ids int, text string")
    got = {r["key"]: list(r["ids"]) for r in t.encode(df.withColumnRenamed("ids", "key"), "key", "text", PATH).collect()}
    direct = t._open(PATH)
    for i, text in enumerate(SAMPLES):
        assert got[i] == (direct.encode(text, add_special_tokens=False).ids if text else [])
    assert 50256 not in got[4]


def test_round_trip(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(SAMPLES)], "k int, text string")
    back = {r["k"]: r["text"] for r in t.decode(t.encode(df, "k", "text", PATH), "k", "ids", PATH).collect()}
    assert back == {i: x or "" for i, x in enumerate(SAMPLES)}
    assert t.encode(df.limit(0), "k", "text", PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=300).filter(lambda x: not any(0xD800 <= ord(c) < 0xE000 for c in x)), st.integers(1, 40))
def test_pieces_do_not_change_ids(text, most):
    cut = t.pieces(text, most)
    assert "".join(cut) == text
    direct = t._open(PATH)
    assert [i for p in cut for i in direct.encode(p, add_special_tokens=False).ids] == direct.encode(text, add_special_tokens=False).ids
    ids, counts = t.encode_texts(PATH, [text])
    assert t.decode_ids(PATH, ids.tolist()) == text and counts[0] == len(ids)


def test_spans(spark):
    text = "a 👩 日本é"
    ids = t._open(PATH).encode(text, add_special_tokens=False).ids
    first, end = t.token_spans(PATH, ids)
    assert first[0] == 0 and end[-1] == len(text)
    table = t.byte_table(PATH)
    for i, (a, b) in enumerate(zip(first, end)):
        piece = table[ids[i]]
        assert a < b and piece in text[a:b].encode()
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "k int, text string")
    rows = t.encode_with_offsets(df, "k", "text", PATH).orderBy("position").collect()
    assert [(r["id"], r["first_char"], r["end_char"]) for r in rows] == list(zip(ids, first, end))


@settings(max_examples=120, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=20), st.integers(50, 60))
def test_plan_places_every_item_within_capacity(counts, capacity):
    plan = plan_containers(dict(counts), capacity)
    fill = [0] * plan.containers
    placed = dict.fromkeys(counts, 0)
    by_size: dict = {}
    for size, start, first, per in sorted(plan.rows):
        by_size.setdefault(size, []).append((start, first, per))
    for size, n in counts.items():
        rows = by_size[size]
        for number in range(n):
            start, first, per = next(r for r in reversed(rows) if r[0] <= number)
            fill[first + (number - start) // per] += size
            placed[size] += 1
    assert placed == counts and all(0 < f <= capacity for f in fill)
    total = sum(s * n for s, n in counts.items())
    assert plan.containers <= max(1, 2 * -(-total // capacity)) or not total
    # a container opened for class j holds j items of it; only the last one of a class may hold fewer
    of_class: list[dict] = [{} for _ in range(plan.containers)]
    for size, n in counts.items():
        for number in range(n):
            start, first, per = next(r for r in reversed(by_size[size]) if r[0] <= number)
            at = of_class[first + (number - start) // per]
            at[capacity // size] = at.get(capacity // size, 0) + 1
    last = {}
    for first, times, j, own in plan.opened:
        for c in range(first, first + times):
            assert of_class[c][j] == own <= j and min(of_class[c]) == j
            assert last.get(j, j) == j  # none of the class was opened after one with fewer
            last[j] = own
    assert sum(times for _, times, _, _ in plan.opened) == plan.containers


@pytest.mark.parametrize("at_once", [1 << 20, 7])
def test_pack(spark, monkeypatch, at_once):
    from gleanframe.llm import packing

    monkeypatch.setattr(packing, "NUMBERED_AT_ONCE", at_once)
    sizes = [5, 5, 5, 0, None, 23, 10, 1, 1, 1, 7, 7, 30, 9, 5, 5, 5, 5] * 3
    df = spark.createDataFrame([(i // 2, s, "c") for i, s in enumerate(sizes)], "k int, n int, container_id string")
    out = pack(df, {1: 10, 2: 25}, "k", "n").collect()
    for w, c in ((1, 10), (2, 25)):
        rows = [r for r in out if r["window_id"] == w]
        fill: dict = {}
        for r in rows:
            fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["n_units"]
        assert max(fill.values()) <= c and sum(fill.values()) == sum(s or 0 for s in sizes)
        assert sorted(fill) == list(range(len(fill)))
        assert all(r["piece_no"] == 0 or r["first_unit"] == r["piece_no"] * c for r in rows)
    used = utilisation(pack(df, {1: 10}, "k", "n"), {1: 10}).first()
    assert used["units"] == sum(s or 0 for s in sizes) and 0 <= used["unused_share"] < 0.2
    assert pack(df.limit(0), {1: 10}, "k", "n").count() == 0 and pack(df, {}, "k", "n").count() == 0
    assert pack(df.where("n = 0"), {1: 10}, "k", "n").count() == 0
    assert F is not None
