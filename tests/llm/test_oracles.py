"""The queries that SQL can express against their SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from mapweave.llm.queries import ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the driver's tables are absent")


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query(spark, name):
    db = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    assert rows(QUERIES[name](spark, SF_DIR).toPandas()) == rows(db.execute(ORACLE_SQL[name]).df())
