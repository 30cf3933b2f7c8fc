import time

import duckdb
import pytest

from quillmark.llm import common, queries
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, "/root/testdata/sf0.01", queries.queries()[name], queries.oracle_sql()[name]) >= 500


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_is_fast_enough_for_whole_tables(name):
    con, began = duckdb.connect(), time.perf_counter()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.01/{t}.parquet'")
    con.execute(queries.oracle_sql()[name]).fetchall()
    assert time.perf_counter() - began < 60


def test_only_a_local_master_may_lack_the_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.stage_root(Session())
    Context.master = "local[4]"
    assert common.stage_root(Session()).startswith("file:")
