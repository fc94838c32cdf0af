"""Near-duplicates by SimHash, matched in the middle: fingerprints link if they differ in ``radius`` bits at most.

A text's shingles vote on 64 bits with their XXH64; a bit is set if over half of them set it. Two fingerprints within
the radius share a variant that is within half the radius of one and within the other half of the other, so every
distinct fingerprint stands for all its variants within half the radius (2,081 for radius 4), and those who share a
variant are linked. Variants are shuffled in bundles: a bundle holds the variants of one fingerprint that begin with
the same bits, and travels as the fingerprint itself, so a fingerprint is sent once for each beginning that its variants
have (46 for 9 bits) instead of once for each variant, and the task that gets a beginning writes the variants out. The
beginning is as long as the number of fingerprints asks for; beginnings with more than MAX_VARIANTS variants (families
of close fingerprints) are lengthened, step by step to the whole 64 bits, where one variant's owners are 2,081 at most.
The owners of a variant are each linked with the one nearest to it, which loses no component: for an even radius all
owners of a variant are within the radius of each other, for an odd one all are within it of an owner in the inner half.
The task that meets them verifies them by counting bits and returns only what draws its fingerprints together, one row
for each but the least of those that hang together, so a family of close fingerprints is no row for each of its pairs.

Null, empty and blank texts have no shingles and the fingerprint zero, which is linked like any other; texts of fewer
words than a shingle has are one shingle. Very long texts are read in pieces of about PIECE bytes cut at white space.
Repeated rows and equal fingerprints are one node. A row without an id belongs to its fingerprint's component, links
others through it, but never names it; a component without any id has the name null. An empty table gives no rows. Only
doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meritgraph.llm.common import checkpointed, join_counted, table, written
from meritgraph.llm.components import components

SEED = 42
PIECE = 1 << 20
BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: Variants that a beginning should have on average, and may have at most before it is lengthened by STEP bits.
VARIANTS, MAX_VARIANTS, STEP = 1 << 19, 1 << 21, 8
#: Beginnings of one fingerprint in the first step, at most.
MAX_STARTS = 5_000
#: Lists of beginnings are broadcast up to this many rows (under 16 MB); longer ones are joined by shuffle.
BROADCAST_ROWS = 500_000


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, by pieces."""
    at = 0
    while len(data) - at > PIECE and (cut := BLANK.search(data, at + PIECE)):
        yield data[at : cut.start()].split()  # of bytes: splits at ASCII white space only
        at = cut.start()
    yield data[at:].split()


def fingerprint(text: bytes | None, size: int) -> int:
    """The 64 bits, unsigned."""
    votes, total, left = np.zeros(64, dtype=np.int64), 0, []

    def count(words: list[bytes]) -> None:
        nonlocal total
        joined = map(b" ".join, zip(*(words[j:] for j in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
        h = np.array([xxhash.xxh64_intdigest(x, SEED) for x in joined], dtype="<u8")
        for at in range(0, len(h), PIECE // 64):
            part = h[at : at + PIECE // 64]
            votes[:] += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(h)

    for words in _pieces((text or b"").lower()):
        left += words
        if len(left) >= size:
            count(left)
            left = left[len(left) - size + 1 :]
    if not total and left:
        count(left)
    bits = 2 * votes > total
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id, fp (the 64 bits as a long), a row for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x, size) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _ball(bits: int, radius: int) -> int:
    return sum(math.comb(bits, k) for k in range(min(bits, radius) + 1))


@lru_cache(maxsize=8)
def _masks(bits: int, radius: int) -> list[tuple[int, int]]:
    """The changes of ``bits`` bits within the radius, and how many bits each changes, fewest first."""
    return [(sum(1 << b for b in flips), k) for k in range(min(bits, radius) + 1) for flips in combinations(range(bits), k)]


def _lengthened(bundles: DataFrame, by: int, radius: int) -> DataFrame:
    """Bundles (fp, bits, start, used) with beginnings of ``by`` more bits: a bundle for each beginning of variants."""
    changes = F.array(*(F.struct(F.lit(m).cast("long").alias("mask"), F.lit(k).alias("k")) for m, k in _masks(by, radius)))
    able = F.filter(changes, lambda x: x["k"] <= radius - F.col("used"))
    own = bundles.withColumn("x", F.explode(able)).withColumn("bits", F.col("bits") + by)
    # the next bits of the fingerprint itself
    ahead = F.call_function("shiftrightunsigned", "fp", F.lit(64) - F.col("bits")).bitwiseAND(F.lit((1 << by) - 1))
    start = F.shiftleft("start", by).bitwiseOR(ahead.bitwiseXOR(F.col("x.mask")))
    return own.select("fp", "bits", start.alias("start"), (F.col("used") + F.col("x.k")).alias("used"))


def _bundles(found: DataFrame, radius: int) -> DataFrame:
    """(fp, bits, start, used) of the distinct fingerprints ``found`` (fp): ``start`` is a beginning of ``bits`` bits,
    ``used`` the bits in which it differs from the fingerprint's own."""
    n, half = found.count(), radius - radius // 2
    first = min(32, max(1, math.ceil(math.log2(max(1, n * _ball(64, half) / VARIANTS)))))
    while _ball(first, half) > MAX_STARTS:
        first -= 1
    bundles = written(_lengthened(found.select("fp", F.lit(0).alias("bits"), F.lit(0).cast("long").alias("start"), F.lit(0).alias("used")), first, half))
    done, bits = [], first
    while True:
        held = F.element_at(F.array(*(F.lit(_ball(64 - bits, half - k)).cast("double") for k in range(half + 1))), F.col("used") + 1)
        large = bundles.groupBy("start").agg(F.sum(held).alias("held")).where(F.col("held") > MAX_VARIANTS).select("start")
        large = checkpointed(large)
        n_large = large.count() if bits < 64 else 0
        if not n_large:
            return _union([*done, bundles])
        few = F.broadcast(large) if n_large <= BROADCAST_ROWS else large
        done.append(bundles.join(few, "start", "left_anti").select(*bundles.columns))
        more = min(STEP, 64 - bits)
        bits += more
        bundles = written(_lengthened(bundles.join(few, "start", "left_semi").select(*bundles.columns), more, half))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of 0 to n - 1 that each reaches over the links (a, b)."""
    root = np.arange(n)
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            return root
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]


def _met(part: pa.Table, radius: int) -> pa.Table:
    """(a, b): owners of the same variant, of one beginning's bundles, each with the least that their links reach."""
    half, bits = radius - radius // 2, part.column("bits")[0].as_py()
    part = part.sort_by("fp")  # so that the same few fingerprints are the nearest ones again and again
    fps, used = part.column("fp").to_numpy().view(np.uint64), part.column("used").to_numpy()
    low = np.uint64((1 << (64 - bits)) - 1)
    masks = _masks(64 - bits, half)
    flips, changed = np.array([m for m, _ in masks], dtype=np.uint64), np.array([k for _, k in masks])
    keys, owners, inner = [], [], []
    for k in range(half + 1):  # in the order of a variant's distance from its owner
        for spent in range(k + 1):
            who = np.flatnonzero(used == spent)
            own = flips[changed == k - spent]
            if len(who) and len(own):
                keys.append(((fps[who] & low)[:, None] ^ own[None, :]).ravel())
                owners.append(np.repeat(who.astype(np.int32), len(own)))
                inner.append(np.full(len(who) * len(own), k <= radius // 2))
    none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    if not keys:
        return none
    key = np.concatenate(keys)
    ordered = np.sort(key)
    shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(shared):
        return none
    at = np.minimum(np.searchsorted(shared, key), len(shared) - 1)
    hit = np.flatnonzero(shared[at] == key)
    hit = hit[np.argsort(at[hit], kind="stable")]
    owner, run = np.concatenate(owners)[hit], at[hit]
    begins = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    nearest = np.repeat(begins, np.diff(np.append(begins, len(run))))
    linked = np.concatenate(inner)[hit][nearest] & (owner != owner[nearest])
    a, b = owner[nearest][linked], owner[linked]
    within = np.bitwise_count(fps[a] ^ fps[b]) <= radius
    root = _roots(len(fps), a[within], b[within])
    other = np.flatnonzero(root != np.arange(len(fps)))
    return pa.table({"a": fps.view(np.int64)[root[other]], "b": fps.view(np.int64)[other]})


def links(found: DataFrame, radius: int = 4) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints ``found`` (fp, materialised) that verified links draw together, maybe
    over others: their components are those of all pairs within the radius."""
    if not 0 <= radius <= 64:
        raise ValueError(f"a radius of {radius} bits")

    def compare(part: pa.Table) -> pa.Table:
        return _met(part, radius)

    near = _bundles(found, radius).groupBy("bits", "start").applyInArrow(compare, "a long, b long")
    return checkpointed(near.distinct())


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, size: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp, component_id (least doc_id that links reach); a row for each row of ``docs``."""
    own = written(fingerprints(docs, size))
    classes = checkpointed(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    drawn = components(links(classes.select("fp"), radius)).withColumnRenamed("node", "fp")
    named = checkpointed(classes.join(drawn, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    groups = checkpointed(named.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("n")))
    found = join_counted(named.select("fp", "component", F.col("n").alias("copies")), groups.select("component", "component_id", "n"), ["component"], classes.count())
    return join_counted(own, checkpointed(found.select("fp", "component_id", F.col("copies").alias("n"))), ["fp"], own.count()).select("doc_id", "fp", "component_id")


def op11_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")
