"""The pipeline's stages on small tables."""

import re

import corpus_pipeline as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_chain(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert len(names) == 5
    before = docs
    kept = {}
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, before, sf).persist()
        assert after.columns == docs.columns
        kept[name] = {r["doc_id"] for r in after.select("doc_id").collect()}
        before = after
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    gone = {r["doc_id"] for r in docs.select("doc_id").collect()} - kept["toxicity"]
    assert gone and all(labels.get(i, 1) for i in gone)
    assert kept["line dedup"] == kept["toxicity"] and kept["n-gram Jaccard join"] <= kept["line dedup"]
    out = P.STAGES[-1][1](spark, before, sf)
    r = out.collect()
    assert len(r) == before.count() and all(x["round_trip"] and x["n_tokens"] == len(x["token_ids"]) for x in r)


def test_run(spark):
    df = P.run(spark, "/root/testdata/sf0.001")
    assert df.columns == ["doc_id", "source", "n_tokens", "token_ids", "round_trip"] and df.count() > 50
