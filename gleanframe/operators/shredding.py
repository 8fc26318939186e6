"""Deeply nested JSON documents as related flat tables, by columnar shredding.

Every repeated path of the documents, such as ``batches[].items[]``, is a column of entries with a repetition level (the
depth of the list that repeats: 0 starts a document) and a definition level (how many repeated ancestors are there). An
element that is absent leaves an entry of a lower definition level, so the column alone says where each element stood. The
rows of one repeated ancestor, their own places and their parents' places come from its level sequences only.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: What an entry of a level column stands for.
ABSENT, OBJECT, OTHER = 0, 1, 2

_SCHEMA = "source_field string, record_key string, table_path string, parent_path string, node_path string, values map<string,string>"


class Unreadable(ValueError):
    """The text isn't a JSON document."""


def _refuse(name: str) -> None:
    raise Unreadable(name)


def parse(text: str):
    """The value of a strict JSON text; a text that holds a string again is read again, however often wrapped."""
    value = text
    while isinstance(value, str):
        try:
            value = json.loads(value, parse_constant=_refuse)
        except (ValueError, RecursionError) as error:
            if isinstance(error, ValueError) and "integer string conversion" in str(error):
                value = json.loads(value, parse_constant=_refuse, parse_int=float)
                continue
            raise Unreadable(str(error)[:80]) from None
    return value


def as_list(value):
    """The list that a list field stands for, or None: wrapped text is read, a single object is a list of one."""
    if isinstance(value, str):
        try:
            value = parse(value)
        except Unreadable:
            return None
    if isinstance(value, dict):
        return [value]
    return value if isinstance(value, list) else None


class Column:
    """The level sequences of one repeated path, and the values of the fields that its elements hold directly."""

    __slots__ = ("children", "definition", "depth", "fields", "kind", "name", "parent", "repetition")

    def __init__(self, parent: Column | None, name: str | None):
        self.parent, self.name = parent, name
        self.depth = parent.depth + 1 if parent else 0
        self.repetition: list[int] = []
        self.definition: list[int] = []
        self.kind: list[int] = []
        self.children: dict[str, Column] = {}
        self.fields: list[dict | None] | None = None

    def child(self, name: str) -> Column:
        """The column of a list below this path. A new one gets an absent entry for each earlier element of its parent."""
        found = self.children.get(name)
        if found is None:
            found = self.children[name] = Column(self, name)
            found.repetition = self.repetition[:-1]
            found.definition = self.definition[:-1]
            found.kind = [ABSENT] * len(found.repetition)
            if self.fields is not None:
                found.fields = [None] * len(found.repetition)
        return found

    def add(self, repetition: int, definition: int, kind: int) -> None:
        self.repetition.append(repetition)
        self.definition.append(definition)
        self.kind.append(kind)
        if self.fields is not None:
            self.fields.append({} if kind else None)

    def absent(self, repetition: int, definition: int) -> None:
        self.add(repetition, definition, ABSENT)
        for c in self.children.values():
            c.absent(repetition, definition)

    def walk(self) -> Iterator[Column]:
        stack = [self]
        while stack:
            column = stack.pop()
            yield column
            stack.extend(reversed(column.children.values()))


class Shredder:
    """Shreds documents one after another into level columns below ``root``."""

    def __init__(self, list_fields: Iterable[str], with_values: bool):
        self.list_fields = frozenset(list_fields)
        self.root = Column(None, None)
        if with_values:
            self.root.fields = []

    def add(self, document, root_is_list: bool) -> None:
        """One parsed document; ``root_is_list``: a single object in the place of the document is a list of one."""
        self.root.add(0, 0, OBJECT)
        if root_is_list:
            document = as_list(document)
        self._element(self.root, document, 0)

    def _element(self, column: Column, value, repetition: int) -> None:
        """What lies below one element: its lists, and for the known lists that it lacks an absent entry."""
        seen = set()
        if isinstance(value, dict):
            self._fields(column, value, "", repetition, seen)
        elif isinstance(value, list):
            self._list(column.child(""), value, repetition)
            seen.add("")
        if len(seen) < len(column.children):
            for name, c in column.children.items():
                if name not in seen:
                    c.absent(repetition, column.depth)

    def _fields(self, column: Column, value: dict, prefix: str, repetition: int, seen: set) -> None:
        for name, x in value.items():
            if name in self.list_fields:
                held = as_list(x)
                if held is not None:
                    x = held
            path = f"{prefix}.{name}"
            if isinstance(x, list):
                if path not in seen:
                    seen.add(path)
                    self._list(column.child(path), x, repetition)
            elif isinstance(x, dict):
                self._fields(column, x, path, repetition, seen)
            elif column.fields is not None and x is not None:
                column.fields[-1][path[1:]] = x if isinstance(x, str) else json.dumps(x)

    def _list(self, column: Column, value: list, repetition: int) -> None:
        depth = column.depth
        if not value:
            column.absent(repetition, depth - 1)
        for x in value:
            column.add(repetition, depth, OBJECT if isinstance(x, dict) else OTHER)
            if column.children or isinstance(x, (dict, list)):
                self._element(column, x, repetition)
            repetition = depth


def positions(column: Column) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """From the level sequences: which entries are objects, their indexes at depths 1 to the column's, their documents."""
    repetition = np.asarray(column.repetition, np.int32)
    keep = (np.asarray(column.kind, np.int8) == OBJECT) & (np.asarray(column.definition, np.int32) == column.depth)
    at = np.arange(len(repetition))
    indexes = []
    for k in range(1, column.depth + 1):
        steps = np.cumsum(repetition == k)
        start = np.maximum.accumulate(np.where(repetition < k, at, 0))
        indexes.append((steps - steps[start])[keep])
    return keep, indexes, (np.cumsum(repetition == 0) - 1)[keep]


def _place(column: Column) -> str:
    names = []
    while column.parent is not None:
        names.append(column.name.replace("%", "%%") + "[%d]")
        column = column.parent
    return "$" + "".join(reversed(names))


def _enclosing(column: Column) -> Column:
    """The column of the nearest enclosing objects: a list straight in a list is no object."""
    while column.name == "" and column.parent is not None:
        column = column.parent
    return column.parent or column


def tables_of(shredder: Shredder) -> Iterator[tuple[str, np.ndarray, list[str], list[str], list[dict] | None]]:
    """For each repeated path: its name, each object's document, parent's place, own place, and field values."""
    for column in shredder.root.walk():
        if column.parent is None:
            continue
        if OBJECT not in column.kind:
            continue
        keep, indexes, documents = positions(column)
        own, above = _place(column), _enclosing(column)
        places = [own % t for t in zip(*(i.tolist() for i in indexes))]
        if above.depth:
            up = _place(above)
            parents = [up % t for t in zip(*(i.tolist() for i in indexes[: above.depth]))]
        else:
            parents = ["$"] * len(places)
        values = None if column.fields is None else [f for f, k in zip(column.fields, keep.tolist()) if k]
        yield own.replace("%d", "").replace("%%", "%"), documents, parents, places, values


def shred(
    documents: DataFrame, list_fields: Iterable[str], root_lists: Iterable[str] = (), with_values: bool = False
) -> DataFrame:
    """The objects in lists of JSON documents as flat rows that know their parent.

    ``documents``: (source_field string, record_key string, document string), one row a document; other columns are
    ignored. ``list_fields``: fields that are lists, where a single object or wrapped text may stand for the list.
    ``root_lists``: source fields whose whole document is such a list. Result: (source_field, record_key, table_path,
    parent_path, node_path, values); ``table_path`` is the repeated path as in ``$.batches[].items[]``, ``values`` the
    scalar fields that the object holds directly or in nested objects, as text, or NULL unless ``with_values``.

    Every element of a list counts for its index, objects alone come out. A NULL document, a text that isn't strict JSON
    (NaN, trailing text, nesting beyond the parser's limit), an empty list or a list of scalars gives no rows. Of a field
    that an object repeats, the last one counts. No shuffle.
    """
    names, roots = tuple(list_fields), frozenset(root_lists)
    columns = ["source_field", "record_key", "document"]

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The parser has a limit of its own, near 10,000 levels; whatever it reads is walked.
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 100_000))
        for batch in stream:
            shredder, rows = Shredder(names, with_values), []
            kinds = batch.column(0).to_pylist()
            for row, text in enumerate(batch.column(2)):
                text = text.as_py()
                if text is None:
                    continue
                try:
                    document = parse(text)
                except Unreadable:
                    continue
                shredder.add(document, kinds[row] in roots)
                rows.append(row)
            rows = np.asarray(rows, np.int64)
            for path, docs, parents, places, values in tables_of(shredder):
                taken = pa.array(rows[docs])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(taken),
                        batch.column(1).take(taken),
                        pa.array([path] * len(places), pa.string()),
                        pa.array(parents, pa.string()),
                        pa.array(places, pa.string()),
                        pa.array([None if v is None else list(v.items()) for v in values] if values else [None] * len(places), pa.map_(pa.string(), pa.string())),
                    ],
                    ["source_field", "record_key", "table_path", "parent_path", "node_path", "values"],
                )

    return documents.select(*columns).mapInArrow(batches, _SCHEMA)


def flat_table(shredded: DataFrame, table_path: str, fields: dict[str, str]) -> DataFrame:
    """One related table: the rows of ``table_path`` with typed columns for ``fields`` (field path to type)."""
    from pyspark.sql import functions as F

    return shredded.where(F.col("table_path") == table_path).select(
        "source_field",
        "record_key",
        "parent_path",
        "node_path",
        *(F.col("values")[name].try_cast(kind).alias(name.replace(".", "_")) for name, kind in fields.items()),
    )
