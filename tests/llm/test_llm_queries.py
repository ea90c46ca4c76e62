"""Registered queries against SQL, and the pipeline stage by stage."""

import os
import re

import pytest

from tallymark.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    from test_queries import compared

    compared(spark, name, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF).cache()
        assert docs.dtypes == before.dtypes, name
        kept.append(docs.count())
    assert kept[0] > kept[1] > kept[2] == kept[3] > 0
    assert not [r for r in docs.collect() if re.search(r"AKIA[A-Z0-9]{14}|[0-9a-f]{16}", r.text)]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted((r.doc_id, r.text) for r in last) == sorted((r.doc_id, r.text) for r in docs.collect())
    assert all(len(r.token_ids) == r.n_tokens for r in last)


def test_pipeline_takes_odd_rows(spark):
    import corpus_pipeline
    from pyspark.sql import functions as F
    from test_llm_text import ODD, odd

    for empty in (False, True):
        docs = odd(spark, empty).select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("long").alias("n_chars"), "size", "spans", "n_words", F.lit(1).alias("kept"), F.lit(2).alias("copies"))
        counts = []
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before = docs
            docs = stage(spark, docs, SF).cache()
            assert docs.dtypes == before.dtypes, name
            counts.append(docs.count())
        last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert last.columns == ["doc_id", "n_tokens", "token_ids", "text"] and last.count() == counts[-1]
        assert counts[0] < len(ODD) and counts == sorted(counts[:2], reverse=True) + counts[2:]
