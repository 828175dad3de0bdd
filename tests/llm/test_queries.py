"""The queries of the operators with SQL give DuckDB's rows; the others have a row a document or page."""

import duckdb
import pytest

from lodestone.llm.queries import ORACLE_SQL, QUERIES

COUNTED = {"op3_url_filter": "pages", "urls_ruled": "pages", "op10_embedding_dedup": "embeddings"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    if name in ORACLE_SQL:
        want = c.sql(ORACLE_SQL[name]).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        assert sorted(map(str, got[cols].itertuples(index=False, name=None))) == sorted(map(str, want[cols].itertuples(index=False, name=None)))
    n = c.sql(f"SELECT count(*) FROM {COUNTED.get(name, 'documents')}").fetchall()[0][0]
    assert len(got) >= n if name == "op1_pack" else len(got) == n
