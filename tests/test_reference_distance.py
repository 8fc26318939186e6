from __future__ import annotations

import random

from gleanframe.operators.components import connected_components
from gleanframe.operators.duplicates import linked_labels
from gleanframe.queries.duplicates import dup_hamming_links, dup_hamming_links_at_8


def test_links_of_five_to_eight_bits_are_there(spark, data):
    wide = {tuple(r) for r in dup_hamming_links_at_8(spark, data).collect()}
    assert {r[2] for r in wide} >= {5, 6, 7, 8} and max(r[2] for r in wide) == 8
    assert {r for r in wide if r[2] <= 4} == {tuple(r) for r in dup_hamming_links(spark, data).collect()}


def test_labels_over_stars_are_the_components(spark):
    draw = random.Random(5)
    edges = [(f"i{a:03}", f"i{b:03}") for a, b in ((draw.randrange(400), draw.randrange(400)) for _ in range(260))] + [(f"j{i:03}", f"j{i + 1:03}") for i in range(90)]
    rows = spark.createDataFrame([(*edge, 1) for edge in edges], "a string, b string, distance int").repartition(3)
    expected = connected_components(rows.selectExpr("a as u", "b as v"))
    assert sorted(map(tuple, linked_labels(rows).collect())) == sorted(map(tuple, expected.collect()))
