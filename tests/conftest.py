import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in sorted(Path(SF).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def same_rows(left, right):
    """Whether two pandas frames hold the same rows, whatever their order."""
    columns = sorted(left.columns)
    assert columns == sorted(right.columns)

    def plain(df):
        df = df[columns].copy()
        for c in columns:
            if df[c].dtype.kind in "ifu" or str(df[c].dtype) in ("Int64", "Float64"):
                df[c] = df[c].astype("float64").round(6)
        return df.astype(str).sort_values(columns).reset_index(drop=True)

    return plain(left).equals(plain(right))
