"""The audit of filters against brute force."""

import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from meritgraph.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(rows, labels):
    failed = []
    for i, text, _ in rows:
        t = text or ""
        w = WORD.findall(t)
        failed.append({
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and any(j is not None and j < i and (other or "") == t for j, other, _ in rows),
        })
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    out = {}
    for part in {p or "" for *_, p in rows}:
        mine = [(rows[k][0], failed[k]) for k in range(len(rows)) if (rows[k][2] or "") == part]
        removals = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            alive = mine
            for step, f in enumerate(order):
                here, dead = [x for x in alive if x[1][f]], len(mine) - len(alive)
                redundant = sum(x[1][f] for x in mine) - len(here)
                alive = [x for x in alive if not x[1][f]]
                removals[f] += len(here)
                assert dead + len(here) + len(alive) == len(mine)
                out[part, "".join(order), step + 1] = [f, len(alive), len(here), redundant, sum(x[1][f] and sum(x[1].values()) == 1 for x in mine), sum(x[0] in good for x in here), sum(x[0] in toxic for x in here)]
        for key in out:
            if key[0] == part:
                out[key].append(removals[out[key][0]])
    return {k: tuple(v[1:]) for k, v in out.items()}


def got(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"mask": F.lit("x"), "part": F.lit(1), "digest": F.lit(2)})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit.audit(audit.cells(docs, marks)).collect()}


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr("meritgraph.llm.common.LEAST_HOT", 4)  # copies beyond this are a hot text
    rng = random.Random(1)
    long = [" ".join(f"w{rng.randrange(k)}" for _ in range(80)) for k in (30, 60, 500, 500)]
    texts = [None, "", " \n", "UPPER case", "has # in it", long[0], long[1], long[2], long[3].upper(), long[3] + " 5%", "é漢😀 " * 60, "X" * 300_000]
    rows = [(rng.choice([None, *range(40)]) if rng.random() < 0.3 else k, rng.choice(texts), rng.choice(["a", "b", "", None])) for k in range(120)]
    labels = [(k % 70, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(100)] + [(None, 1, 1)]
    assert got(spark, rows, labels) == slow(rows, labels)


def test_empty(spark):
    assert got(spark, [], [(1, 1, 1)]) == {}
    one = got(spark, [(1, "x", "s"), (1, "x", "s")], [])
    assert len(one) == 600 and one["s", "EABCD", 1][:2] == (2, 0)  # of one id, neither is the copy
