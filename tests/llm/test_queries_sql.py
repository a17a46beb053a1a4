"""The registered training-data queries against their SQL in DuckDB, over the smallest tables; the others give whole results."""

import math
import os

import duckdb
import pytest

from versemill.llm.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries()[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted(repr([plain(v) for v in r]) for r in df.select(*names).collect())
    result = con.execute(oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    assert got == sorted(repr([plain(r[k]) for k in at]) for r in result.fetchall())


@pytest.mark.parametrize(("name", "table"), [("op1_toxicity", "documents"), ("op2_line_dedup", "documents"), ("op6_html_extraction", "pages"), ("op7_language_id", "documents"), ("op9_document_fingerprints", "documents"), ("op12_token_counts", "documents")])
def test_a_row_for_each_row(spark, name, table):
    assert queries()[name](spark, DATA).count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()
