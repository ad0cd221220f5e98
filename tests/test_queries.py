"""Every query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tessella import plans


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{small}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def rows(frame):
    columns = sorted(frame.columns)
    plain = frame[columns].astype(object).where(frame[columns].notna(), None)
    return columns, sorted(tuple(str(int(v)) if isinstance(v, float) and v == int(v) else str(v) for v in r) for r in plain.values)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, small, duck, name):
    found = rows(plans.QUERIES[name](spark, small).toPandas())
    assert found[1], "no rows"
    assert found == rows(duck.sql(plans.ORACLES[name]).df())


def test_min_length_judges_whole_texts(spark, tmp_path):
    texts = [" " * 8 + "x" * 20, "ab" + " " * 30 + "y" * 20, " " * 30 + "x" * 19 + " ", "short", "z" * 20, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(r.doc_id for r in plans.QUERIES["f8_min_length"](spark, str(tmp_path)).collect()) == [0, 1, 4]
