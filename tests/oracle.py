"""Compares a query with its SQL."""

from __future__ import annotations

from conftest import normal


def check(module, name, spark, data, sql) -> None:
    names, expected = sql(module.SQL[name], data)
    got = module.QUERIES[name](spark, data)
    assert sorted(got.columns) == names
    assert normal(map(tuple, got.select(*(f"`{n}`" for n in names)).collect())) == normal(expected)
