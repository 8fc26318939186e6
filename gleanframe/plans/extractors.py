"""Extractors of features by component: registered functions over batches of inputs, run where a plan says compute."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanframe.plans.conditions import fingerprint


@dataclass(frozen=True)
class Extractor:
    """``run``: a batch of inputs to results in ``schema``; ``recipe``: the document that its profile id is made of."""

    component: str
    recipe: dict
    schema: str
    run: Callable[[pd.DataFrame], pd.DataFrame]

    @property
    def profile_id(self) -> str:
        return fingerprint({"component": self.component, "recipe": self.recipe})


class Registry:
    def __init__(self) -> None:
        self._known: dict[str, Extractor] = {}

    def register(self, extractor: Extractor) -> str:
        """The profile id; registering the same recipe again changes nothing."""
        known = self._known.setdefault(extractor.profile_id, extractor)
        if known.schema != extractor.schema:
            raise ValueError("one recipe with two schemas")
        return extractor.profile_id

    def execute(self, profile_id: str, plan: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
        """Results of the plan's rows with action compute that ``done`` hasn't got: running it again computes nothing twice."""
        extractor = self._known[profile_id]
        left = plan.where(F.col("action") == "compute").join(done.select(*key), key, "left_anti")

        def batches(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in stream:
                yield extractor.run(batch)

        return left.mapInPandas(batches, extractor.schema)
