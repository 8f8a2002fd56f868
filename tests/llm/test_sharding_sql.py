import os

import pytest

from millrace.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_query_against_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{FOLDER}/documents.parquet')")
    columns = "doc_id, size, text_crc32, law, shard, slot, grown_shard"
    want = sorted(c.sql(f"select {columns} from ({ORACLE['op5_sharding']})").fetchall())
    assert sorted(map(tuple, QUERIES["op5_sharding"](spark, FOLDER).select(*columns.split(", ")).collect())) == want
