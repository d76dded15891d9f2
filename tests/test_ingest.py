"""A folder of files as a pile: what is read and skipped, what is kept, and what can be asked of it."""

import random

import pytest
from pyspark.sql import functions as F

from sheaf.operators import cluster
from sheaf.plans import ingest, staging
from sheaf.sources import corpus, pdf
from sheaf.sources.store import Store


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    sheets = corpus.generate()
    corpus.write_corpus(str(root), [*sheets[:3], *sheets[31:34]])
    again = root / "again"
    again.mkdir()
    (again / sheets[0].name).write_bytes((root / sheets[0].name).read_bytes())  # the same name and size
    (again / sheets[1].name).write_bytes((root / sheets[1].name).read_bytes() + b"\n")  # the same name only
    (root / "broken.PDF").write_bytes(b"%PDF-1.4 nothing")
    (root / "notes.txt").write_text("no")
    return root


def test_files_are_deduplicated_and_skipped_ones_counted(spark, folder):
    kept, skipped = pdf.list_files(spark, f"file://{folder}")
    names = sorted(r["doc_id"].rsplit("/", 1)[-1] for r in kept.collect())
    sheets = corpus.generate()
    assert names == sorted([s.name for s in (*sheets[:3], *sheets[31:34])] + [sheets[1].name, "broken.PDF"])
    assert skipped == 3  # a copy, the truth, the notes
    assert kept.select("doc_id").distinct().count() == kept.count()


def test_a_folder_becomes_a_pile(spark, folder, tmp_path):
    root = f"file://{tmp_path}"
    records = list(ingest.ingest_folder(spark, root, f"file://{folder}", "post"))
    assert {r["skipped"] for r in records} == {3} and records[-1]["stage"] == "done"
    store = Store(spark, root, "post")
    assert [r["doc_id"] for r in store.read("unreadable").collect()] == ["broken.PDF"]
    name = corpus.generate()[2].name
    assert store.document_bytes(name) == (folder / name).read_bytes() and store.document_bytes("none.pdf") is None
    regions = store.regions(name).collect()
    assert regions and all(r["box"]["w"] > 0 and r["page"] == 0 for r in regions)
    assert {r["doc_id"] for r in store.cells().filter("page is not null").collect()} >= {name}
    kind = store.kind_named("INVOICE")
    assert kind is not None and store.kind_named("nothing so") is None
    assert not (tmp_path / "none").exists()
    empty = tmp_path / "empty"
    empty.mkdir()
    with pytest.raises(ValueError, match="no PDF file"):
        list(ingest.ingest_folder(spark, root, f"file://{empty}"))
    assert [r["project"] for r in Store.projects(spark, root).collect()] == ["post"]


def test_the_demo_pile_is_made_once(spark, tmp_path):
    root = f"file://{tmp_path}"
    store, records = ingest.demo(spark, root)
    assert records and store.status() == "discovered"
    again, none = ingest.demo(spark, root)
    assert none == [] and again.path == store.path
    listed = Store.projects(spark, root).collect()
    assert [(r["project"], r["status"]) for r in listed] == [(ingest.DEMO, "discovered")]


def test_truth_is_written_and_read(spark, tmp_path):
    sheets = corpus.generate()
    corpus.write_corpus(str(tmp_path), sheets[:1])
    (tmp_path / "truth.json").write_text(corpus.truth_json(sheets))
    read = corpus.read_truth(spark, f"file://{tmp_path}/truth.json")
    want = {(s.name, s.kind, f, t) for s in sheets for f, t in s.truth.items()}
    assert {tuple(r) for r in read.collect()} == want
    assert {tuple(r) for r in corpus.by_kind(read).collect()} == {("invoice", 31), ("receipt", 5), ("statement", 2)}
    assert (tmp_path / sheets[0].name).read_bytes().startswith(b"%PDF")


def plain_clusters(signed, threshold=0.82):
    """Leader clustering document by document."""
    leaders, found = [], {}
    for i, s in sorted(signed):
        scores = [(cluster.similarity_of(s, x), k) for k, x in enumerate(leaders)]
        best = max(scores, default=(0, 0))
        if best[0] < threshold:
            leaders.append(s)
            best = (1, len(leaders) - 1)
        found[i] = best[1]
    return found


@pytest.mark.parametrize("batch", [3, 4096])
def test_leaders_by_batches_equal_one_by_one(spark, monkeypatch, batch):
    monkeypatch.setattr(cluster, "BATCH", batch)
    r = random.Random(3)
    rows = []
    for i in range(90):
        base = (("6x8", 4, 2, 7, [3, 1, 0], 0), ("6x8", 0, 0, 0, [0, 0, 0], 6), ("2x5", 2, 1, 2, [0, 1, 1], 1))[i % 3]
        rows.append((f"d{i:03d}", (base[0], base[1], base[2] + r.randint(0, 2), base[3] + r.randint(0, 4), [x + r.randint(0, 1) for x in base[4]], base[5] + r.randint(0, 3))))
    kind = "struct<shape:string,table_columns:int,row_scale:int,field_count:int,types:array<int>,narrative_lines:int>"
    df = spark.createDataFrame(rows, f"doc_id string, signature {kind}").repartition(3)
    got = {q["doc_id"]: q["leader"] for q in cluster.cluster_documents(df).collect()}
    want = plain_clusters(rows)
    assert {frozenset(k for k in got if got[k] == v) for v in got.values()} == {frozenset(k for k in want if want[k] == v) for v in want.values()}


def test_stage_folders_belong_to_their_run(spark):
    path = lambda df: df.inputFiles()[0]
    outside = staging.stage(spark.range(3), "outside")
    with staging.own_stages(spark) as run:
        inside = staging.stage(spark.range(3), "inside")
        assert run.name in path(inside) and run.name not in path(outside)
    assert outside.agg(F.sum("id")).first()[0] == 3
    with pytest.raises(Exception):
        inside.count()
