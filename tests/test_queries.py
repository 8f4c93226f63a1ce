import glob
import os

import duckdb
import pytest

from quarry.operators.chunks import pack_sentences
from quarry.plans.catalogue import ORACLES, QUERIES

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return c


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    cell = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(map(str, df.where(df.notna(), None).map(cell).values.tolist()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, D).toPandas()
    assert len(got) or name in ORACLES
    if name in ORACLES:
        want = duck.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_packer():
    s = ["a b c.", "d e.", "f g h.", "i"]
    assert pack_sentences(s, 5, 2) == ["a b c. d e.", "d e. f g h.", "i"]
    assert pack_sentences(["a b c d e"], 3, 1) == ["a b c", "c d e", "e"]
    assert pack_sentences([], 5, 2) == []
