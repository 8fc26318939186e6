from __future__ import annotations

import sys
from importlib import import_module
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import check

llm = import_module("gleanframe.llm")
MODULES = [import_module(f"gleanframe.llm.{n}") for n in llm.QUERY_MODULES]


@pytest.mark.parametrize(("module", "name"), [(m, n) for m in MODULES for n in m.SQL], ids=lambda x: x if isinstance(x, str) else "")
def test_equals_sql(module, name, spark, data, sql):
    check(module, name, spark, data, sql)


@pytest.mark.parametrize("name", ["p5_recall", "p6_described", "p8_utilisation", "p9_statistics"])
def test_runs(name, spark, data):
    query = next(m.QUERIES[name] for m in MODULES if name in m.QUERIES)
    assert query(spark, data).count() > 0


def test_recall_is_high(spark, data):
    from gleanframe.llm.similar import p5_recall

    assert p5_recall(spark, "/root/testdata/sf0.01").first()["recall"] >= 0.9
