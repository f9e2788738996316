import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent.parent}:{os.environ.get('PYTHONPATH', '')}"

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    folder = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(folder / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return DATA


def same_rows(spark_df, relation) -> None:
    """Compares a Spark result with a DuckDB relation: columns by name, rows in any order."""

    def plain(v):
        if isinstance(v, float):
            return round(v, 6) + 0.0
        return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v

    names = sorted(spark_df.columns)
    assert names == sorted(relation.columns)
    mine = sorted((tuple(plain(r[c]) for c in names) for r in spark_df.collect()), key=repr)
    at = [relation.columns.index(c) for c in names]
    theirs = sorted((tuple(plain(r[k]) for k in at) for r in relation.fetchall()), key=repr)
    assert mine == theirs
