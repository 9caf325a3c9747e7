"""The pipeline against a plain version of its stages on the smallest tables."""

import hashlib
from collections import Counter

import corpus_pipeline
from tests.llm.test_operators import library, plain_components, plain_fingerprint, plain_spans
from verbatlas.llm import mixing, quality

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_steps(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}

    good = {r["doc_id"] for r in quality.judged(spark.read.parquet(f"{SF}/documents.parquet")).where("kept").collect()}
    fps = {i: plain_fingerprint(docs[i]["text"]) for i in good}
    roots = plain_components(set(fps.values()))
    least = {}
    for i in sorted(good):
        least.setdefault(roots[fps[i]], i)
    single = set(least.values())
    assert set(out) <= single and len(single) < len(docs)

    kept = spark.createDataFrame([tuple(docs[i]) for i in single], spark.read.parquet(f"{SF}/documents.parquet").schema)
    clean = {r["doc_id"]: r["text"] for r in corpus_pipeline.personal_data(spark, kept, SF).collect()}
    assert all(plain_spans(t) == "" for t in clean.values()) and all(clean[i] == docs[i]["text"] for i in single if not plain_spans(docs[i]["text"]))
    frame = spark.createDataFrame([(i, t, docs[i]["lang"], docs[i]["source"], len(t)) for i, t in clean.items()], kept.schema)
    assert set(out) == {r["doc_id"] for r in mixing.mixed(frame).where("sampled").collect()}
    for (_, r), ids in zip(out.items(), library([clean[i] for i in out]), strict=True):
        assert r["ids"] == ids and r["decoded_sha256"] == hashlib.sha256(clean[r["doc_id"]].encode()).hexdigest()


def test_stages_return_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for _, f in corpus_pipeline.STAGES[:4]:
        assert f(spark, docs, SF).columns == docs.columns
        assert f(spark, docs.where("FALSE"), SF).count() == 0
    twice = docs.unionByName(docs)
    assert Counter(r[0] for r in corpus_pipeline.near_duplicates(spark, twice, SF).select("doc_id").collect()).most_common(1)[0][1] == 1
