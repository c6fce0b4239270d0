import pytest

import corpus_pipeline
from oracle_check import differences
from palimpsest.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), ORACLE_SQL[name], SF) is None


def test_pipeline_stages_keep_columns_and_agree_with_their_operators(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name == corpus_pipeline.STAGES[-1][0]:
            assert {r[0] for r in out.select("doc_id").distinct().collect()} == {r[0] for r in before.select("doc_id").distinct().collect()}
        else:
            assert out.columns == docs.columns and 0 < out.count() <= 2 * before.count()
        before = out
