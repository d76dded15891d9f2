"""The stored state of piles: Parquet tables that are written once or appended to, never updated.

projects, documents, kinds, fields and cells are written by an ingest; cell_events, field_events,
corrections and project_events are logs. What is current is a fold of base and log. Tables are kept in
one folder per project, so deleting a pile deletes a folder; a commit saves its typed table first and
logs the table's name last, so a failed commit leaves the former one in force.
"""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf import constants as C
from sheaf.functions.labels import column_base, distinct_names
from sheaf.functions.values import with_value
from sheaf.operators import cells as cell_ops
from sheaf.operators import review

LOGS = {
    "project_events": "project string, seq long, status string, detail string",
    "cell_events": review.EVENTS,
    "field_events": "field string, seq long, name string, type string, included boolean",
    "corrections": "project string, field string, cell_id string, before_raw string, after_value string, signature string, seq long",
    "kind_tables": "kind int, table_name string, seq long",
}


def slug(name: str) -> str:
    return re.sub(r"^_|_$", "", re.sub(r"[^a-z0-9]+", "_", name.lower()))


class Store:
    """Tables of one project under ``root``/``project``."""

    def __init__(self, spark: SparkSession, root: str, project: str):
        self.spark, self.project, self.path = spark, project, f"{root.rstrip('/')}/{project}"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, table: str) -> bool:
        p, fs = self._fs(f"{self.path}/{table}")
        return fs.exists(p)

    def write(self, table: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{table}")

    def append(self, table: str, df: DataFrame) -> None:
        df.write.mode("append").parquet(f"{self.path}/{table}")

    def read(self, table: str) -> DataFrame:
        if table in LOGS:
            if not self.exists(table):
                return self.spark.createDataFrame([], LOGS[table])
            return self.spark.read.schema(LOGS[table]).parquet(f"{self.path}/{table}")
        return self.spark.read.parquet(f"{self.path}/{table}")

    def log(self, table: str, rows: list[tuple]) -> None:
        self.append(table, self.spark.createDataFrame(rows, LOGS[table]))

    def sequence(self) -> int:
        """A number larger than any before it in this project's logs."""
        return time.time_ns()

    def status(self) -> str:
        last = self.read("project_events").agg(F.max_by("status", "seq")).first()[0]
        return last or "ingesting"

    def fields(self) -> DataFrame:
        return review.patch_fields(self.read("fields"), self.read("field_events"))

    def cells(self) -> DataFrame:
        """Current cells; a correction's value is typed alone, without its column's date style."""
        now = review.current_cells(self.read("cells"), self.read("cell_events"))
        typed = with_value(now, F.col("corrected_to"), "__new")
        return typed.withColumn("value", F.when(F.col("corrected_to").isNotNull(), F.col("__new")).otherwise(F.col("value"))).drop("__new")

    def confirm(self, cell_id: str) -> None:
        self.log("cell_events", [(cell_id, self.sequence(), "confirmed", None, C.CONFIRMED)])

    def correct(self, cell_id: str, after: str) -> tuple[review.Signature, DataFrame]:
        """Log a correction; the rule it shows and the cells the rule would change are returned, not applied."""
        cell = self.cells().filter(F.col("cell_id") == cell_id).select("field", "raw").first()
        if cell is None:
            raise LookupError(f"there is no cell {cell_id}")
        signature, seq = review.classify(cell["raw"] or "", after), self.sequence()
        self.log("cell_events", [(cell_id, seq, "corrected", after.strip(), C.CONFIRMED)])
        self.log("corrections", [(self.project, cell["field"], cell_id, cell["raw"], after.strip(), signature.key, seq)])
        return signature, review.preview(signature, review.siblings(self.cells(), cell["field"]), cell_id)

    def approve(self, approved: DataFrame) -> int:
        """Apply an approved list (cell_id, after); cells reviewed meanwhile are left alone."""
        path = f"{self.path}/cell_events"
        before = self.read("cell_events").count()
        review.apply_batch(self.cells(), approved, self.sequence()).write.mode("append").parquet(path)
        return self.read("cell_events").count() - before

    def patch_field(self, field: str, name: str | None = None, type: str | None = None, included: bool | None = None) -> None:
        if type is not None and type not in C.COLUMN_TYPES:
            raise ValueError(f"unknown type {type}")
        self.log("field_events", [(field, self.sequence(), name, type, included)])

    def commit(self, kind: int) -> tuple[str, DataFrame]:
        """Build a kind's typed table from the fields as they now stand, and log it as the kind's table."""
        row = self.read("kinds").filter(F.col("kind") == kind).first()
        if row is None:
            raise LookupError(f"there is no kind {kind}")
        shown = self.fields().filter((F.col("kind") == kind) & F.col("included")).orderBy("position").collect()
        if not shown:
            raise ValueError("this kind has no fields to commit")
        names = distinct_names([column_base(r["name"]) for r in shown])
        table = f"extract_{slug(row['name'])}_{slug(self.project)}"
        own = self.cells().filter(F.col("kind") == kind).withColumn("document", F.col("doc_id"))
        wide = cell_ops.commit_table(own, [(r["field"], n, r["type"]) for r, n in zip(shown, names)])
        wide.select("document", *names, "_needs_review").write.mode("overwrite").saveAsTable(table)
        seq = self.sequence()
        self.log("kind_tables", [(kind, table, seq)])
        self.log("project_events", [(self.project, seq, "committed", table)])
        return table, self.spark.table(table)

    def table_of(self, kind: int) -> DataFrame | None:
        """The committed table of a kind, or None before its first commit."""
        name = self.read("kind_tables").filter(F.col("kind") == kind).agg(F.max_by("table_name", "seq")).first()[0]
        return self.spark.table(name) if name else None

    def overview(self) -> DataFrame:
        """kind, name, documents, fields, needs_review, largest kinds first."""
        docs = self.read("documents").groupBy("kind").agg(F.countDistinct("doc_id").alias("documents"))
        fields = self.fields().filter("included").groupBy("kind").agg(F.count(F.lit(1)).alias("fields"))
        open_ = self.cells().groupBy("kind").agg(F.count_if(cell_ops.needs_review()).alias("needs_review"))
        joined = self.read("kinds").join(docs, "kind", "left").join(fields, "kind", "left").join(open_, "kind", "left")
        return joined.na.fill(0, ["documents", "fields", "needs_review"]).orderBy(F.col("documents").desc(), "kind")

    def document_bytes(self, doc_id: str) -> bytes | None:
        """The file that a document was read from, or None if the pile didn't come from files."""
        if not self.exists("files"):
            return None
        row = self.read("files").filter(F.col("doc_id") == doc_id).select("content").first()
        return bytes(row["content"]) if row else None

    def kind_named(self, beginning: str) -> int | None:
        """The first kind whose name begins so, case aside."""
        row = self.read("kinds").filter(F.lower("name").startswith(beginning.lower())).orderBy("kind").select("kind").first()
        return row["kind"] if row else None

    def regions(self, doc_id: str) -> DataFrame:
        """Where a document's cells stand: cell_id, field, page, box, label_box, status, confidence."""
        cells = self.cells().filter((F.col("doc_id") == doc_id) & F.col("page").isNotNull())
        return cells.select("cell_id", "field", "page", "box", "label_box", "status", "confidence")

    @staticmethod
    def projects(spark: SparkSession, root: str) -> DataFrame:
        """project, created, status of every pile under ``root``, the newest first."""
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/*/project_events")
        found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
        paths = [str(f.getPath()) for f in found or []]
        events = spark.read.schema(LOGS["project_events"]).parquet(*paths) if paths else spark.createDataFrame([], LOGS["project_events"])
        own = events.groupBy("project").agg(F.min("seq").alias("created"), F.max_by("status", "seq").alias("status"))
        return own.orderBy(F.col("created").desc())

    def delete(self) -> None:
        """Drop every committed table, then the project's folder."""
        for r in self.read("kind_tables").select("table_name").distinct().collect():
            self.spark.sql(f"DROP TABLE IF EXISTS `{r['table_name']}`")
        p, fs = self._fs(self.path)
        fs.delete(p, True)
