from __future__ import annotations

from importlib import import_module

import pytest
from oracle import check

import __spark_entry__ as entry

MODULES = [import_module(f"gleanframe.queries.{n}") for n in entry._CORE]


@pytest.mark.parametrize(("module", "name"), [(m, n) for m in MODULES for n in m.SQL], ids=lambda x: x if isinstance(x, str) else "")
def test_equals_sql(module, name, spark, data, sql):
    check(module, name, spark, data, sql)


def test_entry(spark):
    assert entry.entry(spark).columns == ["table_name", "record_key", "ref_key", "period_month"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["p4_found", "p4_edit_steps"])
def test_runs(name, spark, data):
    assert entry.queries()[name](spark, data).count() > 0
