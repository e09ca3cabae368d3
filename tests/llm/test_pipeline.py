import corpus_pipeline
import pytest
from brute import components, fingerprint
from conftest import documents

from weft.llm import queries

OPS = [f"op{i}_" for i in range(1, 14)]


def test_every_operator_has_one_query():
    assert sorted(k[: k.index("_") + 1] for k in queries.QUERIES) == sorted(OPS)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()] + [(10_001, "12 34", "en", "src1")]
    now = documents(spark, rows).select(*docs.columns)
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
        assert now.columns == docs.columns
        after[name] = [tuple(r) for r in now.collect()]
        now = spark.createDataFrame(after[name], docs.schema)
    first = after["language_id"]
    assert 10_001 not in {r[0] for r in first} and len(first) >= 0.98 * len(rows)
    want = set(components([r[0] for r in first], [fingerprint(r[1]) for r in first]))
    assert {r[0] for r in after["near_duplicates"]} == want and len(after["near_duplicates"]) == len(want)
    assert {r[0] for r in after["substring_dedup"]} == want
    assert {r[0] for r in after["source_mix"]} <= {r[0] for r in after["decontaminate"]} < want


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_hard_rows_and_none(spark, sf, hard, empty):
    got = corpus_pipeline.apply(spark, hard, sf)
    assert got.columns == hard.columns and not got.where("text is null or n_chars is null").count()
    assert {r.doc_id for r in got.collect()} <= {r.doc_id for r in hard.collect()}
    none = corpus_pipeline.apply(spark, empty, sf)
    assert none.columns == hard.columns and none.count() == 0
