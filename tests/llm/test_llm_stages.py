"""The pipeline's packing stage against the library's ids, piece by piece."""

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
from tokenizers import Tokenizer

from sheaf.llm.tokenfiles import default_tokenizer

END, CAPACITY = 2, 1024


def test_packed_rows_are_all_pieces_without_gaps(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id < 120")
    docs = docs.unionByName(docs.filter("doc_id < 20"))  # the mixture repeats documents
    library = Tokenizer.from_file(default_tokenizer())
    want: Counter = Counter()
    for r in docs.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, END]
        first = len(ids) % CAPACITY or CAPACITY
        bounds = [0, *range(min(first, len(ids)), len(ids) + 1, CAPACITY)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            want[(r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    rows = corpus_pipeline.pack(spark, docs, "").collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    ends: dict = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= CAPACITY and sorted(ends) == list(range(len(ends)))
