"""Ids through every operator whose kernels run in Python, and through the pipeline: exact, null or repeated."""

from collections import Counter

import corpus_pipeline
import pytest

from sheaf.llm import counts, langid, media, packing, sketch, simhash, tokenfiles, toxicity
from sheaf.plans.staging import own_stages, stage_path

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
IDS = [None, (1 << 53) + 1, (1 << 62) + 3, -(1 << 63), (1 << 63) - 1, 5, 5, None, (1 << 53) + 1]
TEXTS = ["the cat sat on the mat", "a dog ran to the park", None, "", "one more thing to say", "five", "five again", "no name", "a dog ran to the park"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None, (1 << 53) + 1) for i, t in zip(IDS, TEXTS)]
    return spark.createDataFrame(rows, COLUMNS).coalesce(1)


def scored(docs):
    return toxicity.score_frame(docs, toxicity.Machine())


def identified(docs):
    return langid.identify(docs, langid.fit_dictionaries(docs))


def filed(docs):
    path = stage_path(docs.sparkSession, "ids")
    tokenfiles.write_token_files(docs, path)
    return tokenfiles.read_token_files(docs.sparkSession, path)


def described(docs):
    return media.describe_media(media.store_media(docs))


OPERATORS = [scored, identified, filed, packing.pack_documents, described, counts.count_tokens, simhash.near_duplicates, sketch.fingerprint_edits]


@pytest.mark.parametrize("operator", OPERATORS, ids=lambda f: f.__name__)
def test_ids_come_back_unchanged(spark, docs, operator):
    with own_stages(spark):
        clash = docs.selectExpr("*", "'x' as score", "1 as n_bytes", "2 as length", "3 as fp", "4 as size", "5 as part", "6 as margin")
        got = operator(clash).select("doc_id").collect()
    assert Counter(r["doc_id"] for r in got) == Counter(IDS)


def test_ids_through_the_pipeline(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    known = {i for i in IDS if i is not None}
    with own_stages(spark):
        before = docs
        for _, step in corpus_pipeline.STAGES[:-1]:
            before = step(spark, before, str(tmp_path))
            got = before.collect()
            assert {r["doc_id"] for r in got} <= {*known, None} and {r["n_chars"] for r in got} <= {(1 << 53) + 1}
        packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
        assert packed and {r["doc_id"] for r in packed} <= {*known, None}


def test_empty_tables_through_the_pipeline(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    with own_stages(spark):
        assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
