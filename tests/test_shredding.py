from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanframe.operators.shredding import Shredder, Unreadable, as_list, flat_table, parse, shred, tables_of

LISTS = ("items", "steps")


def brute(document, root_is_list=False):
    found = set()

    def go(x, place, parent):
        if isinstance(x, list):
            for i, y in enumerate(x):
                at = f"{place}[{i}]"
                if isinstance(y, dict):
                    found.add((parent, at))
                    go(y, at, at)
                elif isinstance(y, list):
                    go(y, at, parent)
        elif isinstance(x, dict):
            for k, y in x.items():
                held = as_list(y) if k in LISTS else None
                go(y if held is None else held, f"{place}.{k}", parent)

    go(as_list(document) if root_is_list else document, "$", "$")
    return found


def shredded(documents, root_is_list=False):
    s = Shredder(LISTS, True)
    for d in documents:
        s.add(d, root_is_list)
    return [(int(d), p, n) for _, docs, parents, places, _ in tables_of(s) for d, p, n in zip(docs, parents, places)]


json_values = st.recursive(
    st.none() | st.booleans() | st.integers(-3, 3) | st.sampled_from(["", "x", '{"a": 1}', '[{"b": 2}, 3]', "[", '"[{}]"']),
    lambda x: st.lists(x, max_size=4) | st.dictionaries(st.sampled_from(["items", "steps", "a", "b", "c%d", "d.e"]), x, max_size=4),
    max_leaves=25,
)


@settings(max_examples=150, deadline=None)
@given(st.lists(json_values, min_size=1, max_size=6), st.booleans())
def test_equals_recursion(documents, root):
    # a field name with a dot makes the places of two fields alike; the brute force counts them once
    got = shredded(documents, root)
    for i, d in enumerate(documents):
        assert {(p, n) for k, p, n in got if k == i} == brute(d, root)


def test_parse():
    assert parse('"\\"[1]\\""') == [1]
    assert parse("1" * 5000) == float("inf") or parse("1" * 5000) > 0
    for bad in ("", "nan", "NaN", '{"a": Infinity}', "[1", '"x"', "{'a': 1}", "[" * 100000):
        with pytest.raises(Unreadable):
            parse(bad)


def test_tables(spark):
    docs = [
        ("m", "k1", json.dumps({"items": [{"a": 1, "n": {"b": "x"}}, None, {"steps": {"op": "y"}}]}), "extra"),
        ("m", "k2", json.dumps(json.dumps({"items": json.dumps([{"a": 2.5}])})), "extra"),
        ("m", "k3", None, ""), ("m", "k4", "{", ""), ("m", "k5", "[]", ""), ("r", "k6", '{"z": 1}', ""), ("m", None, '{"items": {}}', ""),
    ]
    df = spark.createDataFrame(docs, "source_field string, record_key string, document string, values string")
    out = shred(df, LISTS, ["r"], with_values=True)
    rows = sorted((r["record_key"] or "", r["parent_path"], r["node_path"], r["table_path"]) for r in out.collect())
    assert rows == [
        ("", "$", "$.items[0]", "$.items[]"),
        ("k1", "$", "$.items[0]", "$.items[]"), ("k1", "$", "$.items[2]", "$.items[]"), ("k1", "$.items[2]", "$.items[2].steps[0]", "$.items[].steps[]"),
        ("k2", "$", "$.items[0]", "$.items[]"), ("k6", "$", "$[0]", "$[]"),
    ]
    flat = {r["record_key"]: (r["a"], r["n_b"]) for r in flat_table(out, "$.items[]", {"a": "double", "n.b": "string"}).where("record_key is not null and node_path = '$.items[0]'").collect()}
    assert flat == {"k1": (1.0, "x"), "k2": (2.5, None)}


def test_empty(spark):
    assert shred(spark.createDataFrame([], "source_field string, record_key string, document string"), LISTS).count() == 0


def test_deep_documents(spark):
    docs = [("m", "lists", "[" * 6000 + "{}" + "]" * 6000), ("m", "objects", '{"a":' * 4000 + "[{}]" + "}" * 4000), ("m", "both", '{"a":[' * 40 + "{}" + "]}" * 40), ("m", "beyond", "[" * 10**6 + "]" * 10**6)]
    out = shred(spark.createDataFrame(docs, "source_field string, record_key string, document string"), LISTS)
    assert {r[0]: r[1] for r in out.groupBy("record_key").count().collect()} == {"lists": 1, "objects": 1, "both": 40}
