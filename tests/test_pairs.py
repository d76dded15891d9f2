"""Scores and reasons of label pairs against a plain twin."""

import math
import random

import pytest

from sheaf import constants as C
from sheaf.operators import reconcile

STATS = "kind int, label string, ord int, type string, shapes array<string>, rank double, px double, py double"
WORDS = {"Due Date": {"due", "date"}, "Date": {"date"}, "Inv. No": {"invoice", "number"}, "Invoice Number": {"invoice", "number"},
         "Payment Due": {"payment", "due"}, "Total": {"total"}, "Amount Total": {"amount", "total"}, "Ref": {"reference"}}


def plain(a, b, together):
    if together:
        return 0.0, True, [C.REASONS["apart"].format(a=a["label"], b=b["label"])]
    same = a["type"] == b["type"]
    if not same and {a["type"], b["type"]} not in ({"identifier", "text"}, {"money", "number"}):
        return 0.0, False, [C.REASONS["unlike"]]
    score, why = 0.0, []
    x, y = WORDS[a["label"]], WORDS[b["label"]]
    name = min(1, len(x & y) / len(x | y) + (0.25 if x <= y or y <= x else 0))
    if name > 0.15:
        score += name * 0.45
        why.append(C.REASONS["same_name" if name > 0.6 else "shared_word"])
    if a["type"] in ("identifier", "text"):
        if set(a["shapes"]) & set(b["shapes"]):
            score += 0.18
            why.append(C.REASONS["shape"].format(shape=a["shapes"][0]))
    elif same:
        score += 0.12
        why.append(C.REASONS["type"].format(type="amounts" if a["type"] == "money" else a["type"] + " values"))
    score += 0.12 * same
    gap = abs(a["rank"] - b["rank"])
    if gap < 0.25:
        score += 0.3
        place = math.floor(a["rank"] + 0.5) + 1
        why.append(C.REASONS["rank"].format(ordinal=["", "first", "second", "third", "4th"][place], type=a["type"]))
    elif gap < 0.75:
        score += 0.18
        why.append(C.REASONS["near_rank"].format(type=a["type"]))
    near = max(0, 1 - (abs(a["px"] - b["px"]) * 1.6 + abs(a["py"] - b["py"])) / 0.5)
    if near > 0.3:
        score += near * 0.15
        why.append(C.REASONS["place"])
    return (min(1, score), False, why) if len(why) >= 2 else (0.0, False, [C.REASONS["weak"]])


def test_pair_scores_equal_a_plain_twin(spark):
    r = random.Random(7)
    stats = [
        {"kind": kind, "label": label, "ord": k, "type": r.choice(["text", "identifier", "date", "money", "number"]),
         "shapes": r.sample(["A9", "9-9", "A", "9/9"], 2), "rank": r.random() * 3, "px": r.random() / 2, "py": r.random() / 2}
        for kind in range(12) for k, label in enumerate(WORDS)
    ]
    met = {(kind, *sorted(r.sample(list(WORDS), 2))) for kind in range(12)}
    got = reconcile.pair_scores(
        spark.createDataFrame([tuple(s.values()) for s in stats], STATS), spark.createDataFrame(sorted(met), "kind int, a string, b string")
    ).collect()
    found = {(q["kind"], q["a"], q["b"]): q for q in got}
    pairs = [(a, b) for a in stats for b in stats if a["kind"] == b["kind"] and a["ord"] < b["ord"]]
    assert len(got) == len(found) == len(pairs)
    for a, b in pairs:
        q = found[(a["kind"], a["label"], b["label"])]
        score, blocked, why = plain(a, b, (a["kind"], *sorted((a["label"], b["label"]))) in met)
        assert q["score"] == pytest.approx(score, abs=1e-12) and (q["blocked"], q["reasons"]) == (blocked, why)


def test_more_candidates_go_to_more_tasks(spark, monkeypatch):
    """Each sort of the statistics holds a whole task's rows."""
    rows = [(0, f"d{i}", k, w, "v 1", "text", 1.0 * k, 2.0, 8.0, 8.0) for i in range(50) for k, w in enumerate(WORDS)]
    c = spark.createDataFrame(rows, "kind int, doc_id string, ord int, label string, value string, type string, x double, y double, page_width double, page_height double")
    whole = {r["label"]: r for r in reconcile.label_stats(c).collect()}
    monkeypatch.setattr(reconcile, "TASK_ROWS", 10)
    assert "hashpartitioning(doc_id" in (plan := reconcile.ranked(c)._jdf.queryExecution().executedPlan().toString()) and ", 40)" in plan
    assert {r["label"]: r for r in reconcile.label_stats(c).collect()} == whole
