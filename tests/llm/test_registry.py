import pytest
from shared import DATA, same_as_duckdb

import corpus_pipeline
from marlstone.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    same_as_duckdb(spark, duck, registry.QUERIES[name], registry.ORACLES[name])


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, DATA))
        assert docs.columns == columns, name
        if name != "mixing":
            assert 0 < docs.count() <= before
            before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.agg({"length": "sum"}).first()[0] > 0
    whole = corpus_pipeline.run(spark, DATA)
    assert whole.agg({"length": "sum"}).first()[0] == packed.agg({"length": "sum"}).first()[0]


def test_names_of_the_queries():
    assert sorted(registry.QUERIES) == sorted("op1_exact_dedup op2_substring_dedup op3_quality_rules op4_pii op5_warc op6_toxicity op7_minhash_near_dedup op8_mixing op9_chat_formatting op10_packing op11_language op12_importance op13_alignment".split())
