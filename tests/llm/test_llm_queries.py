"""Registered queries against SQL on the smallest tables."""

import pytest
from compare import connect, differences

from haulframe.llm.oracles import ORACLE
from haulframe.llm.queries import QUERIES, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, ORACLE[name]) is None


@pytest.mark.parametrize("name", ["op1_warc", "op2_decontaminate", "op6_shards", "op10_chat"])
def test_native_queries_run_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_pipeline_keeps_the_columns_of_documents(spark):
    import corpus_pipeline

    docs = first = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.schema == first.schema
    rows = corpus_pipeline.run(spark, SF).collect()
    kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert kept and {r["doc_id"] for r in rows} == kept
