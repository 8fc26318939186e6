"""Session helpers: where lineage is cut, and how temporary tables are kept."""

from __future__ import annotations

import tempfile

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Observation, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names in ``spark.checkpoint.dir``.

    Only a session on one machine without that setting, as in tests, gets a folder of its own; on a cluster, where executors
    would write to their own disks, its lack is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="gleanframe-checkpoint-"))


def _plain_scan(kept: DataFrame) -> DataFrame:
    """A checkpoint as a scan without the size estimate of the plan that made it; as it is where Spark's own classes differ."""
    try:
        jvm = kept.sparkSession._jsparkSession
        return DataFrame(jvm.internalCreateDataFrame(kept._jdf.queryExecution().toRdd(), kept._jdf.schema(), False), kept.sparkSession)
    except (AttributeError, TypeError, Py4JError):
        return kept


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint: computed once, kept in the shared folder, without lineage.

    A checkpoint keeps the size estimate of the plan that made it. Over the rounds of an iteration such estimates multiply
    until their arithmetic takes longer than the work, so the result is a plain scan of the kept rows, whose size adaptive
    execution measures.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return _plain_scan(df.checkpoint(eager=True))


def counted(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """``cut`` and aggregates over its rows, from one job."""
    seen = Observation()
    kept = cut(df.observe(seen, *(c.alias(name) for name, c in measures.items())))
    return kept, seen.get
