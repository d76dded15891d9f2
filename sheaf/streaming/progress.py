"""Progress as newline-delimited JSON: written as lines, read back from chunks cut anywhere."""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterable, Iterator
from typing import Any

STAGES = ("parsing", "analysing", "clustering", "reconciling", "storing", "done")


class ProgressError(RuntimeError):
    """An error that the sender reported inside the stream."""


def line(stage: str, done: int, total: int, message: str = "") -> bytes:
    record = {"stage": stage, "done": done, "total": total, "message": message}
    return (json.dumps(record, ensure_ascii=False) + "\n").encode()


def iter_ndjson(chunks: Iterable[bytes]) -> Iterator[Any]:
    """Objects of a byte stream. Chunks may end inside a line or a character; blank lines are skipped, the tail counts."""
    decoder, rest = codecs.getincrementaldecoder("utf-8")(), ""
    for chunk in chunks:
        *whole, rest = (rest + decoder.decode(chunk)).split("\n")
        yield from (json.loads(x) for x in whole if x.strip())
    rest += decoder.decode(b"", final=True)
    if rest.strip():
        yield json.loads(rest)


def follow(chunks: Iterable[bytes]) -> Iterator[Any]:
    """Like ``iter_ndjson``, but a record with an ``error`` is raised."""
    for record in iter_ndjson(chunks):
        if isinstance(record, dict) and record.get("error"):
            raise ProgressError(str(record["error"]))
        yield record
