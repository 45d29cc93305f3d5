"""Ids of large tables do not fit in 32 bits."""

import pytest

from oreline.plans.catalogue import QUERIES, SQL

from .oracle import SF, assert_same, tables


@pytest.mark.parametrize("name", ["daily_report", "issue_mail", "parse_report"])
def test_reports_of_large_ids(spark, tmp_path, name):
    con = tables()
    con.execute(f"COPY (SELECT * REPLACE (doc_id + 3000000 AS doc_id) FROM '{SF}/documents.parquet' WHERE doc_id < 60) TO '{tmp_path}/documents.parquet'")
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    assert_same(QUERIES[name](spark, str(tmp_path)).toPandas(), con, SQL[name])
