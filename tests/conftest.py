from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    import os

    os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data() -> str:
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sql():
    """Runs SQL over the tables of a folder in DuckDB and gives sorted rows."""
    import duckdb

    def run(text: str, folder: str) -> tuple[list[str], list[tuple]]:
        con = duckdb.connect()
        for path in Path(folder).glob("*.parquet"):
            con.sql(f"create view {path.stem} as select * from read_parquet('{path}')")
        con.sql(f"create table result as {text}")
        names = sorted(r[0] for r in con.sql("describe result").fetchall())
        return names, con.sql(f"select {', '.join(chr(34) + n + chr(34) for n in names)} from result").fetchall()

    return run


def normal(rows) -> list:
    """Rows as sorted lists of comparable values."""
    return sorted((tuple(None if v is None else round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v for v in r) for r in rows), key=repr)
