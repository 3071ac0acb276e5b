import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from sensorloom.plans.local import local_session

    return local_session(4, 4)


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    from check import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.fixture
def series(spark):
    """Build a positioned frame from {subject: {column: values}}."""
    import pandas as pd

    def build(data):
        parts = []
        for sid, cols in data.items():
            pdf = pd.DataFrame(cols)
            pdf.insert(0, "pos", range(len(pdf)))
            pdf.insert(0, "subject_id", sid)
            parts.append(pdf)
        return spark.createDataFrame(pd.concat(parts, ignore_index=True))

    return build
