"""Every twin against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from mapweave.plans import twins

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the driver's tables are absent")


@pytest.fixture(scope="module")
def db():
    out = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        out.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return out


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", twins.QUERIES)
def test_twin(spark, db, name):
    got = twins.QUERIES[name](spark, SF_DIR)
    want = db.execute(twins.ORACLE_SQL[name]).df()
    assert len(want) and sorted(got.columns) == sorted(want.columns)
    assert rows(got.toPandas()) == rows(want)
