"""The registered queries against their SQL, and the pipeline against its stages by brute force."""

import pytest
from oracle import assert_equal

import corpus_pipeline
import entityflow.llm.queries as Q

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, name):
    assert assert_equal(Q.queries()[name](spark, DATA), Q.oracle_sql()[name], DATA) > 0


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_whole_result(spark, name):
    frame = Q.queries()[name](spark, DATA)
    n = spark.read.parquet(f"{DATA}/documents.parquet").count() + (spark.read.parquet(f"{DATA}/pages.parquet").count() if name.startswith("op1_") else 0)
    assert frame.count() == n


def test_pipeline(spark):
    from test_ops import SPACED, brute_components, brute_hits, brute_secrets, shingled

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "mixing"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, DATA)
        after = {r["doc_id"]: r for r in out.collect()}
        if name == "language_id":
            assert after.keys() == before.keys() and {k: r["lang"] for k, r in after.items()} == {k: r["lang"] for k, r in before.items()}
        elif name == "near_dedup":
            want = brute_components({k: shingled(r["text"], 5, SPACED) for k, r in before.items()}, 80, 100)
            assert after.keys() == {k for k, c in want.items() if k == c}
        elif name == "decontamination":
            assert after.keys() == {k for k, r in before.items() if not brute_hits(r["text"], items)[1]}
        elif name == "secret_scan":
            assert after.keys() == before.keys()
            for k, r in before.items():
                spans = brute_secrets(r["text"])
                assert ("[SECRET]" in after[k]["text"]) >= bool(spans) and not brute_secrets(after[k]["text"])
                assert after[k]["n_chars"] == len(after[k]["text"])
        else:
            assert len(after) == len(before) and sum(r["taken"] for r in after.values()) > 0
        if name != "mixing":
            assert out.columns == corpus_pipeline.COLUMNS
        docs = spark.createDataFrame(out.collect(), out.schema) if name != "mixing" else out
    assert corpus_pipeline.run(spark, DATA).count() == len(after)
