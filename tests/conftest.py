import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.fixture(scope="session")
def same():
    def rows(frame):
        plain = lambda v: None if v is None or str(v) in ("nan", "<NA>", "NaT") else int(v) if isinstance(v, float) and v == int(v) else v
        return sorted(str(tuple(map(plain, r))) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))

    def compare(result, expected):
        assert sorted(result.columns) == sorted(expected.columns)
        assert rows(result) == rows(expected)

    return compare
