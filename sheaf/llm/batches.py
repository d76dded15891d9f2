"""Kernels over whole texts, batch by batch in Arrow.

The columns that a kernel only carries along stay Arrow arrays from end to end: a null id beside a large
one never turns either into a float, and a kernel sees texts alone. Texts are long, so the session's
batches are made smaller where they were larger than ``SLICE_ROWS`` rows, and are handed on in slices of
that many: what a task holds at once stays bounded on both sides.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a batch, and rows that are worked on together.
SLICE_ROWS = 1024
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"

Texts = list[str | None]
#: Called once in each task; what it returns is called with each slice's texts.
OneToOne = Callable[[], Callable[[Texts], Sequence]]
OneToMany = Callable[[], Callable[[Texts], Iterator[tuple[list[int], Sequence]]]]


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, SLICE_ROWS):
            yield b.slice(at, SLICE_ROWS)


def give_back() -> None:
    """Return freed memory to the system at the end of a task; a worker goes on to other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def bound_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on sends at most SLICE_ROWS rows to Python in one batch."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH_CONF)) <= SLICE_ROWS:
        conf.set(BATCH_CONF, str(SLICE_ROWS))
    return df


def _carried(docs: DataFrame, keep: Sequence[str], texts: Sequence[str], added: str) -> tuple[DataFrame, StructType]:
    bound_batches(docs)
    new = StructType.fromDDL(added)
    schema = StructType([*docs.select(*keep).schema.fields, *new.fields])
    return docs.select(*keep, *[t for t in texts if t not in keep]), schema


def with_results(docs: DataFrame, keep: Sequence[str], added: str, start: OneToOne, *texts: str) -> DataFrame:
    """``keep`` as it is and the columns ``added``, of which the kernel gives one sequence each for a slice.

    The kernel is given the columns ``texts`` (``text`` if none is named), each as a list.
    """
    texts = texts or ("text",)
    rows, schema = _carried(docs, keep, texts, added)
    types = [f.type for f in to_arrow_schema(StructType.fromDDL(added))]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for b in sliced(batches):
            made = work(*[b.column(t).to_pylist() for t in texts])
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], *[pa.array(m, t) for m, t in zip(made, types)]], names)
        del work
        give_back()

    return rows.mapInArrow(run, schema)


def with_many(docs: DataFrame, keep: Sequence[str], added: str, start: OneToMany, text: str = "text") -> DataFrame:
    """Any number of rows for each text: the kernel gives (numbers of the slice's rows, sequences) parts.

    A kernel with an attribute ``close`` has it called at the end of its task.
    """
    rows, schema = _carried(docs, keep, (text,), added)
    types = [f.type for f in to_arrow_schema(StructType.fromDDL(added))]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for b in sliced(batches):
            for of, made in work(b.column(text).to_pylist()):
                at = pa.array(of, pa.int32())
                yield pa.RecordBatch.from_arrays([*[b.column(k).take(at) for k in keep], *[pa.array(m, t) for m, t in zip(made, types)]], names)
        getattr(work, "close", lambda: None)()
        del work
        give_back()

    return rows.mapInArrow(run, schema)
