"""Every query with SQL gives DuckDB's rows on the smallest tables; the others run."""

import glob
import os

import duckdb
import pytest

from lexquarry.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([repr(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order)) for r in data])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name in SQL:
        want = duck.sql(SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert rows(df.columns, got) == rows(want.columns, want.fetchall())
    else:
        assert got


def test_pushdown(spark):
    plan = QUERIES["doc_list_infos"](spark, SF)._jdf.queryExecution().toString()
    assert "EqualTo(source,src1)" in plan and "text" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_speakable_markdown(spark, duck):
    from pyspark.sql import functions as F

    from lexquarry.functions.text import speakable
    from lexquarry.plans.conversations import SPOKEN_SQL

    text = "# Title\n\n- **one** [S1, S2] .\n2) see [here](https://a.b/c) | `x`\n> quoted\n```\ncode\n```\nend_ !"
    got = spark.createDataFrame([(text,)], "text string").select(speakable(F.col("text"))).first()[0]
    want = duck.execute(f"SELECT trim({SPOKEN_SQL}, ' ') FROM (SELECT ? AS text)", [text]).fetchone()[0]
    assert got == want == "Title one. see here x quoted end!"
