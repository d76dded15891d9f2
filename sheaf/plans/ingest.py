"""From tokens to reviewed-ready cells: analyse, cluster, reconcile, resolve, canonicalise, store.

Every stage is a DataFrame; stage tables cut the lineage between them. Progress comes as records of the
stages in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf import constants as C
from sheaf.operators import cells as cell_ops
from sheaf.operators import cluster, extract, geometry, reconcile
from sheaf.plans.staging import Run, stage
from sheaf.sources import corpus, pdf
from sheaf.sources.store import Store

UNTITLED, DEMO = "Untitled pile", "Demo pile"


@dataclass
class Pile:
    """What an ingest found, as DataFrames."""

    documents: DataFrame
    kinds: DataFrame
    fields: DataFrame
    cells: DataFrame
    candidates: DataFrame
    pairs: DataFrame


def discover(tokens: DataFrame, pages: DataFrame) -> Pile:
    """Kinds, fields and canonical cells of a pile of tokens (see geometry.TOKENS and geometry.PAGES)."""
    tokens = geometry.normalise_tokens(tokens)
    analysed = stage(extract.analyse_pile(tokens, pages), "analysed")
    kinds = stage(cluster.cluster_documents(cluster.signatures(analysed)), "kinds")
    found = analysed.select("doc_id", "said", F.col("width").alias("page_width"), F.col("height").alias("page_height"))
    documents = kinds.select("doc_id", "kind").join(found, "doc_id")
    documents = documents.join(geometry.document_totals(tokens, pages), "doc_id", "left")
    candidates = stage(extract.candidates_of(analysed).join(documents.select("doc_id", "kind", "page_width", "page_height"), "doc_id"), "candidates")
    sizes = documents.groupBy("kind").agg(F.count(F.lit(1)).alias("documents"))
    stats = stage(reconcile.label_stats(candidates), "label-stats")
    together = stage(reconcile.cooccurrence(candidates), "together")
    pairs = stage(reconcile.pair_scores(stats, together), "pairs")
    roots = stage(reconcile.merge_groups(stats, pairs, together), "roots")
    fields = reconcile.fields_of(stats, roots, pairs, sizes).filter(F.col("coverage") >= C.COVERAGE_FLOOR)
    fields = fields.withColumn("field", F.concat_ws(":", F.col("kind").cast("string"), "field")).withColumn("included", F.lit(True))
    fields = stage(fields, "fields")
    named = reconcile.kind_names(sizes, documents.select("kind", "doc_id", "said"), fields)
    labels = fields.select("kind", "field", F.explode(F.concat(F.array("name"), "aliases")).alias("label"))
    resolved = cell_ops.resolve_cells(candidates, labels, documents, fields)
    cells = cell_ops.canonical(resolved, order=["doc_id"]).withColumn("cell_id", F.concat_ws("|", "doc_id", "field"))
    cells = cells.withColumn("document", F.col("doc_id"))
    return Pile(stage(documents, "documents"), stage(named, "named"), fields, stage(cells, "cells"), candidates, pairs)


def ingest(store: Store, tokens: DataFrame, pages: DataFrame) -> Iterator[dict]:
    """Discover and store a pile; yields progress records. A failure is logged as the project's status.

    The stage tables of the run go when it ends, for all that is kept has been stored by then.
    """
    store.log("project_events", [(store.project, store.sequence(), "ingesting", None)])
    run = Run(store.spark)
    try:
        total = pages.select("doc_id").distinct().count()
        yield {"stage": "parsing", "done": total, "total": total, "message": f"{total} documents"}
        yield {"stage": "analysing", "done": 0, "total": total, "message": "finding tables and fields"}
        with run:
            pile = discover(tokens, pages)
        kinds = pile.kinds.count()
        yield {"stage": "clustering", "done": kinds, "total": kinds, "message": f"{kinds} kinds"}
        fields = pile.fields.count()
        yield {"stage": "reconciling", "done": fields, "total": fields, "message": f"{fields} fields"}
        for name in ("documents", "kinds", "fields", "cells", "candidates"):
            store.write(name, getattr(pile, name))
        yield {"stage": "storing", "done": 1, "total": 1, "message": "stored"}
    except Exception as e:
        store.log("project_events", [(store.project, store.sequence(), "failed", str(e)[:500])])
        raise
    finally:
        run.drop()
    store.log("project_events", [(store.project, store.sequence(), "discovered", None)])
    yield {"stage": "done", "done": total, "total": total, "message": "ready"}


def ingest_folder(spark: SparkSession, root: str, folder: str, name: str = UNTITLED) -> Iterator[dict]:
    """A folder of PDF files as the pile ``name`` under ``root``: files, discovered tables, progress records.

    Raises ValueError before anything is stored if the folder has no PDF file. The first record says how
    many files were skipped, and unreadable ones are kept as the table ``unreadable``.
    """
    kept, skipped = pdf.list_files(spark, folder)
    if kept.isEmpty():
        raise ValueError("there is no PDF file to ingest")
    store = Store(spark, root, name)
    store.write("files", pdf.read_contents(spark, folder, kept))
    tokens, pages, unreadable = pdf.tokens_of(store.read("files"))
    store.write("unreadable", unreadable)
    for record in ingest(store, tokens, pages):
        yield record | {"skipped": skipped}


def demo(spark: SparkSession, root: str) -> tuple[Store, list[dict]]:
    """The generated pile as a project; one that is there already and didn't fail is used again."""
    store = Store(spark, root, DEMO)
    if store.exists("project_events") and store.status() in ("discovered", "committed"):
        return store, []
    tokens, pages, _ = corpus.pile(spark)
    return store, list(ingest(store, tokens, pages))
