"""Telling natural prose from lists, tables and junk by how far a text's statistics lie from its language's prose.

The statistics of all documents give, for each language, a robust mean and covariance of prose: from documents that are mostly
sentences, concentration steps keep those nearest to the current centre. A document's Mahalanobis distance divides into one
contribution for each statistic. A document within the distance that nearly all normal prose keeps is prose. What makes the others
outlying tells what they are: a forest, fitted on a bounded sample of hand labels, names their kind from the distance and its contributions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanframe.llm.text_stats import STATISTICS, describe
from gleanframe.llm.vectors import in_batches
from gleanframe.session import cut

KINDS = ("prose", "list", "table", "junk")
_P = len(STATISTICS)
_SENTENCES, _REPEATED, _COMMON = (STATISTICS.index(n) for n in ("sentence_share", "repeated_share", "common_word_share"))


@dataclass(frozen=True)
class QualitySettings:
    """``most_labels`` bounds the labelled documents that the forest is fitted on, taken by a hash of their key.
    ``keep``: the share of a language's prose that a concentration step keeps. ``few``: documents below which a language
    takes the centre of all languages. ``normal``: how many deviations from the mean of a normal distribution leave as much beyond
    them as ``prose_limit`` does. ``most_words`` bounds the list of common words, which is sent to the workers."""

    most_labels: int = 20000
    keep: float = 0.85
    steps: int = 3
    few: int = 200
    normal: float = 3.0902  # one in a thousand
    most_words: int = 100000
    trees: int = 80
    depth: int = 10


def prose_limit(settings: QualitySettings, statistics: int = _P) -> float:
    """The distance that all but a small share of normal prose keeps: the root of a chi-square quantile (Wilson and Hilferty)."""
    part = 2 / (9 * statistics)
    return math.sqrt(statistics * (1 - part + settings.normal * math.sqrt(part)) ** 3)


def document_statistics(documents: DataFrame, key: str, text: str, language: str, common_words: DataFrame, settings: QualitySettings = QualitySettings()) -> DataFrame:
    """(key, language, stats): the values of ``STATISTICS`` over each whole text, a row a document.

    A NULL, empty or blank text has zeros and its language is NULL. A missing, misspelt or wrong language is replaced by what
    the text's script and common words say. No shuffle.
    """
    rows = common_words.where("lang is not null and word is not null").select(F.trim("lang"), F.lower(F.trim("word"))).limit(settings.most_words + 1).collect()
    if len(rows) > settings.most_words:
        raise ValueError(f"more than {settings.most_words} common words")
    common: dict[str, set] = {}
    for lang, word in rows:
        common.setdefault(lang, set()).update(list(word) if lang[:2] in ("zh", "ja") else [word])
    frozen = {k: frozenset(v) for k, v in common.items()}
    kind = dict(documents.dtypes)[key]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        languages, values = [], []
        for t, declared in zip(batch.column(1), batch.column(2).to_pylist()):
            lang, found = describe(t.as_py() or "", declared, frozen)
            languages.append(lang)
            values.extend(found)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * _P, pa.int32()), pa.array(values, pa.float64()))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(languages, pa.string()), lists], [key, "language", "stats"])

    return documents.select(key, text, language).mapInArrow(in_batches(run), f"`{key}` {kind}, language string, stats array<double>")


def _stats(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, _P)


class ProseModel:
    """Centre and inverse covariance of prose for each language, with a common one for languages with few documents."""

    def __init__(self, sums: dict[str, tuple[float, np.ndarray, np.ndarray]], few: int):
        total = [sum(x) for x in zip(*sums.values())] if sums else [0.0, np.zeros(_P), np.eye(_P)]
        self.common = self._fit(*total)
        self.by_language = {k: self._fit(*v) for k, v in sums.items() if v[0] >= few}

    @staticmethod
    def _fit(n: float, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if n < 2:
            return first / max(n, 1), np.eye(_P)
        mean = first / n
        covariance = second / n - np.outer(mean, mean)
        # A little of the diagonal keeps it invertible where a statistic hardly varies in prose.
        spread = np.diag(covariance).clip(0)
        return mean, np.linalg.pinv(covariance + np.diag(0.02 * spread + 1e-4))

    def contributions(self, languages: list[str | None], x: np.ndarray) -> np.ndarray:
        """What each statistic adds to each document's squared distance; rows sum to it."""
        out = np.zeros_like(x)
        which = np.asarray([k or "" for k in languages], object)
        for lang in set(which.tolist()):
            rows = np.flatnonzero(which == lang)
            mean, inverse = self.by_language.get(lang, self.common)
            d = x[rows] - mean
            out[rows] = d * (d @ inverse)
        return out


#: Sums that are added up at once.
_AT_ONCE = 64


def _sums(stats: DataFrame, chosen, few: int) -> ProseModel:
    """Counts, sums and products of the chosen rows of each language, added up in partitions and then in a tree."""
    schema = "part int, language string, n double, first array<double>, second array<double>"

    def add(rows: dict, lang: str, n: float, first: np.ndarray, second: np.ndarray) -> None:
        old = rows.get(lang)
        rows[lang] = (n, first, second) if old is None else (old[0] + n, old[1] + first, old[2] + second)

    def table(rows: dict) -> pa.RecordBatch:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        return pa.RecordBatch.from_arrays(
            [pa.array([part] * len(rows), pa.int32()), pa.array(list(rows), pa.string()), pa.array([v[0] for v in rows.values()], pa.float64()), pa.array([v[1].tolist() for v in rows.values()], pa.list_(pa.float64())), pa.array([v[2].ravel().tolist() for v in rows.values()], pa.list_(pa.float64()))],
            ["part", "language", "n", "first", "second"],
        )

    def partition(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict = {}
        for batch in stream:
            if batch.num_rows:
                x, languages = _stats(batch.column(1)), np.asarray(batch.column(0).to_pylist(), object)
                keep = chosen(languages.tolist(), x)
                for lang in set(languages[keep].tolist()):
                    part = x[keep & (languages == lang)]
                    add(rows, lang, float(len(part)), part.sum(0), part.T @ part)
        yield table(rows)

    def together(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict = {}
        for batch in stream:
            for lang, n, first, second in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                add(rows, lang, n, np.asarray(first), np.asarray(second).reshape(_P, _P))
        yield table(rows)

    parts = stats.where("language is not null").select("language", "stats").mapInArrow(partition, schema)
    number = stats.rdd.getNumPartitions()
    while number > _AT_ONCE:  # a tree of sums
        number = -(-number // _AT_ONCE)
        parts = parts.repartition(number, "part").mapInArrow(together, schema)
    totals: dict = {}
    for r in parts.toLocalIterator():  # of the last few sums, a row each for a language
        add(totals, r["language"], r["n"], np.asarray(r["first"]), np.asarray(r["second"]).reshape(_P, _P))
    return ProseModel(totals, few)


def prose_model(stats: DataFrame, settings: QualitySettings = QualitySettings()) -> ProseModel:
    """The robust centre of each language's prose, from the statistics of all documents."""

    def sentences(languages: list, x: np.ndarray) -> np.ndarray:
        return (x[:, _SENTENCES] > 0.6) & (x[:, _REPEATED] < 0.3) & (x[:, _COMMON] > 0.1)

    spark = stats.sparkSession
    model = _sums(stats, sentences, settings.few)
    for _ in range(settings.steps):
        shared = spark.sparkContext.broadcast(model)

        def squared(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            x, languages = _stats(batch.column(1)), batch.column(0).to_pylist()
            d = shared.value.contributions(languages, x).sum(1)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.where(sentences(languages, x), d, np.nan))], ["language", "d"])

        distances = stats.where("language is not null").select("language", "stats").mapInArrow(in_batches(squared), "language string, d double")
        limits = dict(distances.where("not isnan(d)").groupBy("language").agg(F.percentile_approx("d", settings.keep, 1000)).collect())

        def near(languages: list, x: np.ndarray, shared=shared, limits=limits) -> np.ndarray:
            d = shared.value.contributions(languages, x).sum(1)
            return sentences(languages, x) & (d <= np.asarray([limits.get(k, np.inf) for k in languages]))

        model = _sums(stats, near, settings.few)
    return model


def outlierness(stats: DataFrame, key: str, model: ProseModel) -> DataFrame:
    """(key, language, stats, distance, contributions): the Mahalanobis distance of each document from its language's prose
    and each statistic's part of the squared distance, in the order of ``STATISTICS``."""
    shared = stats.sparkSession.sparkContext.broadcast(model)
    kind = dict(stats.dtypes)[key]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _stats(batch.column(2))
        c = shared.value.contributions(batch.column(1).to_pylist(), x)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1) * _P, pa.int32()), pa.array(c.ravel()))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.sqrt(c.sum(1).clip(0))), lists], [key, "language", "stats", "distance", "contributions"])

    return stats.select(key, "language", "stats").mapInArrow(in_batches(run), f"`{key}` {kind}, language string, stats array<double>, distance double, contributions array<double>")


def _labelled(labels: DataFrame, key: str, kind: str) -> DataFrame:
    """(key, label): what most raters say of a document; of equally many the first in ``KINDS``."""
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.lower(F.trim(F.col(kind)))).cast("int") - 1
    votes = labels.select(key, number.alias("label")).where("label >= 0").groupBy(key, "label").count()
    return votes.groupBy(key).agg(F.max_by("label", F.struct("count", (-F.col("label")).alias("m"))).alias("label"))


def classify(scored: DataFrame, labels: DataFrame, key: str, kind: str, settings: QualitySettings = QualitySettings()) -> DataFrame:
    """(key, text_kind) of each document with a text. One within ``prose_limit`` of its language's prose is prose; a forest over
    the distance and its contributions names the kind of the others, which may be prose too, but unusual.

    Labels in any case, with blanks around them; unknown ones are ignored, repeated ones vote. Where outlying documents have
    labels of fewer than two kinds, the largest share of lines names theirs: sentences, items, fields and pairs, noise.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    limit = prose_limit(settings)
    known = scored.where("language is not null")
    prose = known.where(F.col("distance") <= limit).select(key, F.lit(KINDS[0]).alias("text_kind"))
    squashed = F.transform("contributions", lambda c: F.signum(c) * F.log1p(F.abs(c)))
    outlying = known.where(~(F.col("distance") <= limit))
    ready = outlying.select(key, array_to_vector(F.concat(squashed, F.array(F.log1p("distance")))).alias("features"))
    sample = _labelled(labels, key, kind).orderBy(F.xxhash64(key), key).limit(settings.most_labels)
    train = cut(ready.join(sample, key).select("features", F.col("label").cast("double").alias("label")))
    if train.select("label").distinct().count() < 2:
        share = lambda *names: sum(F.col("stats")[STATISTICS.index(n)] for n in names)
        shares = F.array(share("sentence_share"), share("item_share"), share("field_share", "pair_share"), share("noise_share"))
        named = outlying.select(key, F.element_at(F.array(*map(F.lit, KINDS)), F.array_position(shares, F.array_max(shares)).cast("int")).alias("text_kind"))
    else:
        forest = RandomForestClassifier(numTrees=settings.trees, maxDepth=settings.depth, maxBins=64, featureSubsetStrategy="onethird", seed=7, minInstancesPerNode=2).fit(train)
        chosen = forest.setProbabilityCol("").setRawPredictionCol("").transform(ready)
        named = chosen.select(key, F.element_at(F.array(*map(F.lit, KINDS)), F.col("prediction").cast("int") + 1).alias("text_kind"))
    return prose.unionByName(named)
