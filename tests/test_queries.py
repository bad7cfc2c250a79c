import glob
import os

import duckdb
import pytest

from quire.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    frame = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    rows = sorted(tuple(repr(r[c]) for c in columns) for r in frame.collect())
    if name in catalogue.ORACLES:
        got = duck.execute(catalogue.ORACLES[name])
        at = [d[0] for d in got.description]
        assert sorted(at) == columns
        assert rows == sorted(tuple(repr(r[at.index(c)]) for c in columns) for r in got.fetchall())
    else:
        assert rows


def test_only_the_running_head_goes(spark, tmp_path):
    """A short line that two of three turns share, turns without a text, a turn that stands twice, other line ends."""
    rows = [(1, 0, "Eins zwei.\nThe."), (1, 1, "Drei vier.\nThe."), (1, 2, "Ende gut."), (2, 0, None), (2, 1, "x y z"), (3, 5, "same turn"), (3, 5, "another"), (4, 0, "one\r\ntwo\n\n"), (5, 0, None), (6, 0, "A.\nA."), (6, 1, "A.")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = catalogue.QUERIES["furniture_fuzzy"](spark, str(tmp_path)).select("doc_id", "page_number", "text")
    sql = f"WITH conversations AS (SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet') SELECT doc_id, page_number, text FROM ({catalogue.ORACLES['furniture_fuzzy']})"
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, duckdb.sql(sql).fetchall()))
