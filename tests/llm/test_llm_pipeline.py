"""The corpus pipeline over the smallest tables, stage by stage against brute force."""

import corpus_pipeline
from pyspark.sql import functions as F

from sheaf.llm import langid, mixing, toxicity
from sheaf.llm.queries import oracle_sql, queries
from test_llm_alike import brute_kept

DIR = "/root/testdata/sf0.001"


def test_stages_follow_one_another(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    before = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        after = step(spark, before, DIR).cache()
        assert after.columns == list(corpus_pipeline.COLUMNS)
        kept = {r["doc_id"] for r in after.select("doc_id").collect()}
        given = {r["doc_id"]: r for r in before.collect()}
        if name == "language":
            classifier = langid.Classifier(langid.fit_dictionaries(before))
            said = {i: classifier.predict(r["text"]) for i, r in given.items()}
            assert kept == {i for i, s in said.items() if s[0] != "und" and s[2] >= langid.NARROW}
        elif name == "toxicity":
            machine = toxicity.train(before, spark.read.parquet(f"{DIR}/labels.parquet"))
            rows = {i: [machine.index[b] for b in toxicity.buckets(r["text"]) if b in machine.index] for i, r in given.items()}
            assert kept == {i for i, x in rows.items() if machine.score(x) < toxicity.THRESHOLD}
        elif name == "near_duplicates":
            assert sorted(kept) == brute_kept([(i, r["text"]) for i, r in given.items()])
        else:
            times = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(before).filter("size > 0").collect()}
            got = {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()}
            assert got == {i: n for i, n in times.items() if n}
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, DIR)
    assert packed.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 1024


def test_registered():
    assert {k.split("_")[0] for k in queries()} == {f"op{n}" for n in range(1, 11)}
    assert set(oracle_sql()) <= set(queries())
