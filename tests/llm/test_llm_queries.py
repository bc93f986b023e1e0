"""Queries of the llm subpackage against their SQL, and the pipeline's stages against brute force."""

import pytest

from tests.oracle import check, connection
from townmeter.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(name, spark, sf_dir):
    check(spark, connection(sf_dir), sf_dir, queries.queries()[name], queries.oracle_sql()[name])


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, len(queries.queries()) + 1))


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = corpus_pipeline.keep_good(spark, docs, sf_dir)
    want = connection(sf_dir).execute(f"with {queries.quality_sql()} select doc_id from quality where kept").fetchall()
    assert sorted(r.doc_id for r in good.collect()) == sorted(i for (i,) in want)
    for stage in (corpus_pipeline.keep_one_of_each, corpus_pipeline.mask_personal_data, corpus_pipeline.mix_sources):
        assert stage(spark, good, sf_dir).columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mixing", "encoding"]
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert out and {r.doc_id for r in out} <= {r.doc_id for r in good.collect()} and all(r.n_tokens > 0 for r in out)
