"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words (runs of letters, lower-cased) and the words' first four and five
letters, hashed into 2**20 buckets; presence counts, not frequency, so a long text isn't diluted. The
machine's logit is ``w0 + sum(w_i) + sum_{i<j} <v_i, v_j>`` over the buckets present: the pairwise part
learns, say, that an insult next to a group's name weighs more than both alone.

It is fitted on a bounded sample (``FIT_ROWS``) of the labelled rows outside the held-out quarter:
buckets in at least ``MIN_DF`` sampled texts whose log odds differ from zero by ``MIN_Z`` standard
errors are kept (at most ``MAX_FEATURES``), then all weights are fitted together by Adam. Labels, lang,
source and doc_id never enter a score. Scoring is a map over whole texts with the small model shipped
along; it needs no shuffle.

Cases: null and blank texts score as a text without terms; without labels (or with one class only)
every score is the smoothed base rate; repeated label rows count by their maximum; of rows that repeat a
labelled id one is learned from and all are scored; labels of unknown documents and null labels are
ignored; extra columns are ignored, null ids are scored and never fitted; ids come back bit by bit.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.batches import give_back, with_results

FIT_ROWS = 8000
BUCKETS = 1 << 20
MIN_DF = 4
MIN_Z = 2.5
MAX_FEATURES = 4096
FACTORS = 6
THRESHOLD = 0.3
MEMO = 200_000
WORD = re.compile(r"[^\W\d_]+")


def held_out(id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def word_buckets(word: str) -> tuple[int, ...]:
    terms = [word] + [f"{n}^{word[:n]}" for n in (4, 5) if len(word) >= n]
    return tuple(zlib.crc32(t.encode("utf-8", "replace")) % BUCKETS for t in terms)


def words(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def buckets(text: str | None) -> list[int]:
    return sorted({b for w in words(text) for b in word_buckets(w)})


@dataclass
class Machine:
    """bias, linear weights and factors over the kept buckets; ``index`` maps a bucket to its row."""

    bias: float = 0.0
    index: dict[int, int] = field(default_factory=dict)
    w: np.ndarray = field(default_factory=lambda: np.zeros(0))
    v: np.ndarray = field(default_factory=lambda: np.zeros((0, FACTORS)))

    def logit(self, rows: list[int]) -> float:
        if not rows:
            return self.bias
        v = self.v[rows]
        total = v.sum(axis=0)
        return float(self.bias + self.w[rows].sum() + 0.5 * ((total * total).sum() - (v * v).sum()))

    def score(self, rows: list[int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(rows), -40, 40))))


def select_features(samples: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Buckets whose presence goes with the label, by the z score of their smoothed log odds."""
    pos = int(labels.sum())
    neg = len(labels) - pos
    # text by text and for the buckets that can be kept alone, so that the driver holds no copies of the sample
    held = np.zeros((2, BUCKETS), np.int32)
    for s, y in zip(samples, labels):
        np.add.at(held[int(y)], s, 1)
    often = np.flatnonzero(held[0] + held[1] >= MIN_DF)
    a, b = held[1, often] + 0.5, held[0, often] + 0.5
    odds = np.log(a / (pos + 1 - a).clip(0.5)) - np.log(b / (neg + 1 - b).clip(0.5))
    z = odds / np.sqrt(1 / a + 1 / (pos + 1 - a).clip(0.5) + 1 / b + 1 / (neg + 1 - b).clip(0.5))
    best = np.argsort(-np.abs(z), kind="stable")[:MAX_FEATURES]
    return often[np.sort(best[np.abs(z[best]) >= MIN_Z])]


def fit(samples: list[np.ndarray], labels: np.ndarray, steps: int = 200, rate: float = 0.05, l2: float = 2e-4) -> Machine:
    n, pos = len(labels), float(labels.sum())
    bias = float(np.log((pos + 0.5) / (n - pos + 0.5))) if n else -10.0
    if not n or pos in (0, n) or not sum(map(len, samples)):
        return Machine(bias)
    kept = select_features(samples, labels)
    if not len(kept):
        return Machine(bias)
    lookup = np.full(BUCKETS, -1)
    lookup[kept] = np.arange(len(kept))
    rows = [x[x >= 0] for x in (lookup[s] for s in samples)]
    flat, doc = np.concatenate(rows), np.repeat(np.arange(n), [len(r) for r in rows])
    del rows
    m = len(kept)
    theta = np.concatenate(([bias], np.zeros(m), np.random.default_rng(0).normal(0, 0.01, m * FACTORS)))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, v = theta[1 : m + 1], theta[m + 1 :].reshape(m, FACTORS)
        # factor by factor, so that the driver holds one number for each feature of a text at a time
        totals, gv = np.empty((FACTORS, n)), np.empty((m, FACTORS))
        logit = theta[0] + np.bincount(doc, w[flat], n)
        for k in range(FACTORS):
            vf = v[flat, k]
            totals[k] = np.bincount(doc, vf, n)
            logit += 0.5 * (totals[k] ** 2 - np.bincount(doc, vf * vf, n))
        miss = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - labels) / n
        each = miss[doc]
        for k in range(FACTORS):
            gv[:, k] = np.bincount(flat, each * (totals[k][doc] - v[flat, k]), m) + l2 * v[:, k]
        grad = np.concatenate(([miss.sum()], np.bincount(flat, each, m) + l2 * w, gv.ravel()))
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    index = {int(b): i for i, b in enumerate(kept)}
    return Machine(float(theta[0]), index, theta[1 : m + 1].copy(), theta[m + 1 :].reshape(m, FACTORS).copy())


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Machine:
    """Fit on at most ``fit_rows`` labelled documents outside the held-out quarter, taken in hash order.

    Only the chosen ids are broadcast, and there are at most fit_rows of them; rows that repeat an id are
    reduced to one (the one of the least terms) before anything comes to the driver.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    known = known.filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = known.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(fit_rows)

    def start():
        return lambda texts: ([np.array(buckets(t), dtype="<i4").tobytes() for t in texts],)

    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    terms = with_results(rows, ("doc_id", "toxic"), "terms binary", start)
    got = terms.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("terms").alias("terms")).orderBy("doc_id").toArrow()
    samples = [np.frombuffer(x, dtype="<i4") for x in got.column("terms").to_pylist()]
    marks = np.array([float(x > 0) for x in got.column("toxic").to_pylist()])
    del got
    give_back()
    machine = fit(samples, marks)
    del samples
    give_back()
    return machine


def score_frame(docs: DataFrame, machine: Machine, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``docs`` reduced to ``keep``, with ``score`` of every whole text."""

    def start():
        memo: dict[str, tuple[int, ...]] = {}
        index = machine.index

        def score(text: str | None) -> float:
            rows: set[int] = set()
            for w in words(text):
                got = memo.get(w)
                if got is None:
                    if len(memo) >= MEMO:
                        memo.clear()
                    got = memo[w] = tuple(index[x] for x in word_buckets(w) if x in index)
                rows.update(got)
            return machine.score(sorted(rows))

        return lambda texts: ([score(t) for t in texts],)

    return with_results(docs, keep, "score double", start)


def op2(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_frame(docs, train(docs, labels))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
