from __future__ import annotations

from gleanframe.operators.duplicates import copy_groups, copy_links, copy_peers, exact_classes


def test_copies_are_members_and_peers(spark):
    """Copies alone, copies with a near one, and two near ones; one item is alone."""
    bits = {"a": 0, "b": 0, "c": 0, "d": 1, "e": -1, "f": -1, "g": 255 << 20, "h": 511 << 20, "i": (1 << 40) - 1}
    items = spark.createDataFrame(list(bits.items()), "item string, bits bigint")
    members = exact_classes(items, "item", "bits")
    classes = members.join(items, "item").select("class_id", "copies", "bits").distinct()
    links = copy_links(classes, 4)
    assert sorted(map(tuple, copy_groups(classes, links).collect())) == [("a", 4, 3, 3, 1, "mixed"), ("e", 2, 1, 0, None, "exact"), ("g", 2, 0, 1, 1, "similar")]
    assert sorted(map(tuple, copy_peers(members, "item", links).collect())) == [
        ("a", 2, 1, 0, "b"), ("b", 2, 1, 0, "a"), ("c", 2, 1, 0, "a"), ("d", 0, 3, 1, "a"),
        ("e", 1, 0, 0, "f"), ("f", 1, 0, 0, "e"), ("g", 0, 1, 1, "h"), ("h", 0, 1, 1, "g"),
    ]
