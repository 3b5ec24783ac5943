"""The registered queries over the smallest tables, against plain versions and held-out labels."""

import collections

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from tessera.llm import queries
from tests.llm import brute


@pytest.fixture(scope="module")
def docs(sf):
    t = pq.read_table(f"{sf}/documents.parquet").to_pydict()
    return list(zip(t["doc_id"], t["text"], strict=True))


def rows(df, *columns):
    return collections.Counter(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_exact_queries(spark, sf, docs):
    bench = pq.read_table(f"{sf}/benchmark.parquet").to_pydict()
    vec = pq.read_table(f"{sf}/embeddings.parquet").to_pydict()
    assert rows(queries.op3_minhash_near_dedup(spark, sf)) == collections.Counter(brute.near(docs))
    assert rows(queries.op6_suffix_dedup(spark, sf)) == collections.Counter(brute.repeats(docs))
    assert rows(queries.op7_decontamination(spark, sf)) == collections.Counter(brute.contaminated(docs, list(zip(bench["item_id"], bench["text"], strict=True))))
    assert rows(queries.op9_secret_scan(spark, sf), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == collections.Counter(brute.secrets(docs))
    assert rows(queries.op8_exact_topk(spark, sf)) == collections.Counter(brute.top(list(zip(vec["vec_id"], vec["embedding"], strict=True))))


def test_types_of_the_contract(spark, sf):
    want = {
        "op1_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
        "op3_minhash_near_dedup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
        "op4_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op5_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
        "op6_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
        "op7_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
        "op8_exact_topk": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
        "op9_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
        "op10_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    }
    for name, kinds in want.items():
        assert dict(queries.QUERIES[name](spark, sf).dtypes) == kinds, name


def test_languages_hold_out(spark, sf):
    out = queries.op10_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.where("lang = lang_pred").count() >= 0.95 * out.count()


def test_pipeline_stages(spark, sf):
    names = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    df = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, sf)
        assert df.columns == names, name
    out = corpus_pipeline.run(spark, sf)
    assert out.count() == out.select("doc_id").distinct().count() and out.where("taken > 3 * size").count() == 0
