"""SimHash near-duplicates against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from meritgraph.llm import simhash
from meritgraph.llm.components import components


def slow(text, size=4):
    w = (text or "").encode().lower().split()
    n = min(size, len(w))
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(len(w) - n + 1)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(fps, radius):
    """fingerprint: the least one that links reach."""
    fps = np.array(sorted(set(fps)), dtype=np.uint64)
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius) + i + 1:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return {int(fps[i]): int(fps[find(i)]) for i in range(len(fps))}


def test_fingerprints_are_the_votes(monkeypatch):
    texts = [None, "", " \n ", "a", "A b", "A b c d", "a\tb\nc d e f g " * 50, "x" * 500 + " y z", " " * 300 + "a b c d e", "é漢😀 " * 100]
    for text in texts:
        assert simhash.fingerprint(text and text.encode(), 4) == slow(text)
    monkeypatch.setattr(simhash, "PIECE", 64)
    for text in texts:
        assert simhash.fingerprint(text and text.encode(), 4) == slow(text)


@pytest.mark.parametrize("radius,most", [(4, 1 << 21), (4, 60_000), (3, 60_000), (0, 100), (1, 2_000)])
def test_links_lose_no_component(spark, monkeypatch, radius, most):
    """Families of close fingerprints, with beginnings short enough and, where few variants are allowed, lengthened."""
    monkeypatch.setattr(simhash, "MAX_VARIANTS", most)
    rng, fps = random.Random(radius), [0, 1, (1 << 64) - 1]
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(40):
            x = base
            for _ in range(rng.choice([0, 1, 2, 3, 5, 7])):
                x ^= 1 << rng.randrange(64)
            fps.append(x)
    fps = sorted({*fps, *(rng.getrandbits(64) for _ in range(60))})
    found = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long").repartition(3)
    got, want = {}, {}
    for r in components(simhash.links(found, radius)).collect():
        got.setdefault(r.component, set()).add(int(np.int64(r.node).view(np.uint64)))
    for k, v in groups(fps, radius).items():
        want.setdefault(v, set()).add(k)
    assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in want.values() if len(x) > 1}


def test_a_family_is_not_linked_in_pairs(spark):
    """All 2,016 fingerprints with two bits set are within four bits of each other."""
    family = [(1 << i | 1 << j) for i in range(64) for j in range(i)]
    found = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in family], "fp long")
    linked = simhash.links(found)
    assert linked.count() < 10 * len(family)
    drawn = components(linked)
    assert (drawn.count(), drawn.select("component").distinct().count()) == (len(family), 1)


def test_radius_is_checked(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([], "fp long"), 65)


def test_odd_rows(spark):
    rows = [(5, None), (3, ""), (4, " \n"), (7, "one"), (6, "One"), (7, "one"), (None, "one"), (None, "no id here"), (9, "a b c d e f " * 30), (8, "A b c d e f " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit("x"), "n": F.lit(1), "a.b": F.lit(2)})
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == sorted([("5", "3"), ("3", "3"), ("4", "3"), ("7", "6"), ("6", "6"), ("7", "6"), ("None", "6"), ("None", "None"), ("9", "8"), ("8", "8")])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    fps = {i: slow(t) for i, t in texts.items()}
    drawn, least = groups(fps.values(), 4), {}
    for i in sorted(fps):
        least.setdefault(drawn[fps[i]], i)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op11_simhash_neardup(spark, folder).collect()}
    assert got == {i: (f"{fps[i]:016x}", least[drawn[fps[i]]]) for i in fps}
