import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (str(ROOT), os.environ.get("PYTHONPATH", "")) if p)

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", tmp_path_factory.mktemp("work").as_uri())
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


def plain(v):
    """Values as comparable text: floats to six digits, rows and structs as mappings."""
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.6g}" if abs(v) > 1e-9 else "0"
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return str({k: plain(x) for k, x in v.items()})
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def table(rows, columns):
    """Rows as a sorted list, independent of the order of rows and columns."""
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(plain(r[i]) for i in at) for r in rows)
