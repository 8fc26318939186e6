"""Encoding a corpus with a public tokenizer, and back.

The vocabulary file is a parameter and is opened once in each Python worker. Texts pass through in Arrow batches; a batch is
encoded in slices of bounded length, and a text beyond that length is cut where the tokenizer's own pre-tokenizer
always cuts, so that its ids are those of the whole text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the vocabulary files lie; a parameter of every operator.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")

#: Characters encoded at once, and from which a single text is cut.
SLICE = 1 << 18

#: A blank between two visible characters: byte-level pre-tokenizers begin a piece at such a blank, whatever surrounds it.
_SEAM = re.compile(r"(?<=[^\s]) (?=[^\s])")


def tokenizer_path(name: str, folder: str | None = None) -> str:
    return f"{folder or TOKENIZER_DIR}/{name}.json"


@lru_cache(maxsize=4)
def _open(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_padding()
    t.no_truncation()
    return t


def pieces(text: str, most: int = SLICE) -> list[str]:
    """``text`` in pieces of about ``most`` characters, cut only at blanks between visible characters."""
    out, start = [], 0
    while len(text) - start > most:
        seam = _SEAM.search(text, start + most)
        if seam is None:
            break
        out.append(text[start : seam.start()])
        start = seam.start()
    out.append(text[start:])
    return out


def _slices(texts: list[str], most: int = SLICE) -> Iterator[tuple[list[int], list[str]]]:
    """Pieces of texts with their texts' numbers, in groups of about ``most`` characters."""
    rows, group, size = [], [], 0
    for i, text in enumerate(texts):
        for piece in pieces(text, most):
            rows.append(i)
            group.append(piece)
            size += len(piece)
            if size >= most:
                yield rows, group
                rows, group, size = [], [], 0
    if rows:
        yield rows, group


def encode_texts(path: str, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after another (int32), and the number of ids of each text."""
    tokenizer, ids = _open(path), []
    counts = np.zeros(len(texts), np.int64)
    for rows, group in _slices([t or "" for t in texts]):
        for i, e in zip(rows, tokenizer.encode_batch_fast(group, add_special_tokens=False)):
            counts[i] += len(e.ids)
            ids.append(np.asarray(e.ids, np.int32))
    return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), counts


def _lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def _text_batches(stream: Iterator[pa.RecordBatch], most: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Batches of at most about ``most`` bytes, or one row."""
    for batch in stream:
        step = max(1, batch.num_rows * most // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def encode(documents: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, ids): the ids of each text, without special tokens; strings that look like those are ordinary text.

    A NULL or empty text has an empty list. Rows are neither shuffled nor joined: a repeated key gives a row each time.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text_batches(stream):
            ids, counts = encode_texts(path, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(pa.array(ids), counts)], [key, "ids"])

    kind = dict(documents.dtypes)[key]
    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(documents: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, n_tokens): the number of ids of each text, 0 for NULL and empty texts."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text_batches(stream):
            _, counts = encode_texts(path, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts)], [key, "n_tokens"])

    kind = dict(documents.dtypes)[key]
    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, others from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in shown}
    for n, b in enumerate(sorted(set(range(256)) - set(shown))):
        table[chr(256 + n)] = b
    return table


@lru_cache(maxsize=4)
def byte_table(path: str) -> tuple[bytes, ...]:
    """The bytes of each id of a byte-level vocabulary; an added token stands for its own text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_alphabet()
    vocabulary = spec["model"]["vocab"]
    added = {a["id"]: a["content"].encode() for a in spec.get("added_tokens", [])}
    table = [b""] * (max([*vocabulary.values(), *added]) + 1)
    for word, i in vocabulary.items():
        table[i] = added.get(i) or bytes(letters[c] for c in word)
    for i, word in added.items():
        table[i] = word
    return tuple(table)


def decode_ids(path: str, ids) -> str:
    """The text of a list of ids. A character split over several tokens is put together again from their bytes; bytes that
    make no character become U+FFFD."""
    table = byte_table(path)
    return b"".join(table[i] for i in ids).decode("utf-8", "replace")


def decode(encoded: DataFrame, key: str, ids: str, path: str) -> DataFrame:
    """(key, text): the text of each list of ids; NULL stays NULL, an empty list gives an empty text."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text_batches(stream):
            texts = [None if x is None else decode_ids(path, x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    kind = dict(encoded.dtypes)[key]
    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")


def token_spans(path: str, ids) -> tuple[list[int], list[int]]:
    """First character and end of each token, in characters of the decoded text. A token that holds a part of a character
    covers that whole character, so tokens that share one overlap."""
    table = byte_table(path)
    sizes = np.asarray([len(table[i]) for i in ids], np.int64)
    data = np.frombuffer(b"".join(table[i] for i in ids), np.uint8)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    opened = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    first = np.where(sizes > 0, opened[np.minimum(starts + 1, len(data))] - 1, opened[starts])
    return first.tolist(), opened[ends].tolist()


def encode_with_offsets(documents: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, position, id, first_char, end_char): a row for each token, with its characters in the text."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text_batches(stream, 1 << 22):
            ids, counts = encode_texts(path, batch.column(1).to_pylist())
            ends = np.cumsum(counts)
            firsts, lasts = [], []
            for start, end in zip(ends - counts, ends):
                f, e = token_spans(path, ids[start:end].tolist())
                firsts += f
                lasts += e
            row = np.repeat(np.arange(len(counts)), counts)
            position = np.arange(len(ids)) - np.repeat(ends - counts, counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(position, pa.int32()), pa.array(ids), pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32())],
                [key, "position", "id", "first_char", "end_char"],
            )

    kind = dict(documents.dtypes)[key]
    return documents.select(key, text).mapInArrow(
        run, f"`{key}` {kind}, position int, id int, first_char int, end_char int"
    )


def misplaced(documents: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, position) of tokens whose bytes aren't those of their characters in the text: all of them, where they begin and end
    with a character, a part of them in their place, where a character is split. There are none in well-formed texts."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(path)
        for batch in _text_batches(stream, 1 << 22):
            texts = batch.column(1).to_pylist()
            ids, counts = encode_texts(path, texts)
            row, position = [], []
            at = 0
            for r, (t, n) in enumerate(zip(texts, counts.tolist())):
                own = ids[at : at + n].tolist()
                at += n
                before = 0  # bytes of the text before this token
                ends = np.cumsum([0, *(len(c.encode("utf-8", "surrogatepass")) for c in t or "")])  # bytes before each character
                for k, (i, first, end) in enumerate(zip(own, *token_spans(path, own))):
                    start = before - int(ends[min(first, len(ends) - 1)])
                    if (t[first:end].encode("utf-8", "surrogatepass"))[start : start + len(table[i])] != table[i] or start < 0 or end - first > max(1, len(table[i])):
                        row.append(r)
                        position.append(k)
                    before += len(table[i])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(position, pa.int32())], [key, "position"])

    kind = dict(documents.dtypes)[key]
    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, position int")
