"""Encoders of query texts: registered by profile, run once on the driver, their vectors literals of the plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanframe.functions.names import latin_query
from gleanframe.functions.vectors import cosine
from gleanframe.operators.ordering import ranked_with_gaps
from gleanframe.plans.conditions import fingerprint


@dataclass(frozen=True)
class TextEncoder:
    """``recipe``: the document that the profile id is made of, with the number of dimensions; ``encode``: texts to a matrix of unit rows."""

    recipe: dict
    encode: Callable[[list[str]], np.ndarray]

    @property
    def profile_id(self) -> str:
        return fingerprint(self.recipe)

    def vector(self, text: str, instead: str | None = None) -> list[float]:
        """The vector of a query text (or of what is given instead of it), checked for its shape, finiteness and unit length."""
        found = np.asarray(self.encode([latin_query(text, instead)]), np.float64)
        if found.shape != (1, self.recipe["dimensions"]) or not np.isfinite(found).all() or abs(np.linalg.norm(found) - 1) > 1e-4:
            raise ValueError("the encoder gives no unit vector of its profile's dimensions")
        return found[0].tolist()


def hashed_encoder(dimensions: int) -> TextEncoder:
    """An encoder without a model, for tests: a text is the axis that its SHA-256 names."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions))
        for i, t in enumerate(texts):
            out[i, int.from_bytes(sha256(t.encode()).digest()[:8], "big") % dimensions] = 1
        return out

    return TextEncoder({"kind": "hashed", "dimensions": dimensions}, encode)


def semantic_cell(vector: Column, query: list[float]) -> Column:
    """The cell of a semantic condition: eligible with its cosine, never a truth value; a vector without one is unknown."""
    score = F.round(cosine(vector, F.array(*map(F.lit, query))), 6)
    known = score.isNotNull() & ~F.isnan(score)
    return F.struct(
        F.when(known, "eligible").otherwise("unknown_missing_index").alias("status"), F.when(known, score).alias("raw_score"),
        F.lit("cosine").alias("score_type"), F.lit("higher").alias("direction"), F.when(~known, "missing_index").alias("reason"),
    )


def semantic_ranks(rows: DataFrame, item: str, vector: str, query: list[float], k: int) -> DataFrame:
    """(item, status, raw_score, rank, gap_from_best, gap_to_next) of the ``k`` best items."""
    cells = rows.select(item, F.inline(F.array(semantic_cell(F.col(vector), query)))).where("status = 'eligible'")
    return ranked_with_gaps(cells.select(item, "status", "raw_score"), "raw_score", item, k)
