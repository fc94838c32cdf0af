"""Near-duplicates by bottom-k MinHash sketches.

One hash function orders the shingles of a text; the SKETCH least hashes are its sketch. Texts with the same set of
shingles form a class, and only the classes' representatives go on. A representative enters the inverted lists of the
rarest of its retained values: as many that a pair at the threshold must meet in one of them. Lists of up to LIST
members give all their pairs. Longer ones (large families of near copies, frequent passages) give each member's pair
with the list's centre; once the links found so far are drawn together, each member that is not in the centre's
component is compared with all members of other components, in blocks that return only what links components, so no
link is lost and no family becomes a row for each of its pairs. A 64-bit signature (one bit of the least hash of each of 64 ranges) and the set sizes drop most chance
meetings inside the lists; the overlap of the pair's union sketch then estimates the similarity, and what may reach the
threshold is confirmed on the full sets. Components are drawn on confirmed links.

Misses: a pair at the very threshold fails the filters with a probability of about 1e-6 (five standard deviations);
sets are compared by 64-bit hashes of their shingles.

Null, empty and blank texts have no shingles, are linked with nothing and are kept; texts of fewer words than a
shingle has are one shingle. Rows without an id are linked with nothing. Repeated rows get the same answer each; rows of
one id with different texts are judged each by its own text. An empty table gives no rows. Only doc_id and text are
read. Very long texts are hashed whole; of their sets, blocks hold a bounded number of shingles.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meritgraph.llm.common import checkpointed, gathered, join_counted, packed, table, written
from meritgraph.llm.components import components

SKETCH = 48
LIST = 12
SIGNATURE_BITS = 20
#: Bounds of one side of a block: members, and shingles in their sets (8 MB).
BLOCK, BLOCK_SHINGLES = 1_024, 1 << 20
#: Lists of ids are broadcast up to this many rows (under 16 MB); longer ones are joined by shuffle.
BROADCAST_IDS = 500_000
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles of ``size`` words; A-Z count as a-z."""
    found = (text or b"").lower().split()  # of bytes: ASCII letters and white space only
    if not found:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))
    n = min(size, len(h))
    acc = _mixed(h[: len(h) - n + 1] + np.uint64(n))
    for j in range(1, n):
        acc = _mixed(acc * M1 + h[j : len(h) - n + 1 + j])
    return np.unique(acc)


def signature(found: np.ndarray) -> int:
    """One bit of the least hash in each of 64 ranges dealt by the hash's last bits; 0 for an empty range."""
    place, first = np.unique(found & np.uint64(63), return_index=True)
    bits = (found[first] >> np.uint64(7)) & np.uint64(1)
    return int(np.bitwise_or.reduce(bits << place)) if len(found) else 0


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_hash, n (distinct shingles), digest of the set, sig, sketch (the least hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, sig, sketch = [], [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                found = shingles(text, size)
                n.append(len(found))
                digest.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                sig.append(np.uint64(signature(found)).view(np.int64))
                sketch.append(found[:SKETCH].view(np.int64))
            columns = [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.int64()), pa.array(sketch, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n", "digest", "sig", "sketch"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, n long, digest binary, sig long, sketch array<bigint>")


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, set) of the documents whose id is in ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for at in range(0, len(texts), 500):
                found = [shingles(text, size).view(np.int64) for text in texts[at : at + 500]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 500), pa.array(found, pa.list_(pa.int64()))], names=["id", "set"])

    own = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    read = docs.select("doc_id", "text").join(own, F.col("doc_id") == F.col("id"), "left_semi")
    return read.mapInArrow(run, "id long, set array<bigint>").dropDuplicates(["id"])


def _confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the threshold."""
    share = percent / 100
    least = math.floor(SKETCH * share - 5 * math.sqrt(SKETCH * share * (1 - share)))
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n").alias(f"n{x}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    # the union's sketch: the least hashes of both; what both hold of it estimates the similarity
    union = F.slice(F.array_sort(F.array_union(_unsigned("sa"), _unsigned("sb"))), 1, SKETCH)
    common = F.size(F.array_intersect(F.array_intersect(union, _unsigned("sa")), _unsigned("sb")))
    whole = (F.col("na") <= SKETCH) & (F.col("nb") <= SKETCH)
    inter = F.size(F.array_intersect("sa", "sb"))
    likely = F.when(whole, 100 * inter >= percent * (F.col("na") + F.col("nb") - inter)).otherwise(common >= least)
    met = packed(met.where(likely).select("a", "b", "na", "nb"))
    ids = checkpointed(met.select(F.col("a").alias("id")).union(met.select("b")).distinct())
    sets = checkpointed(_sets(docs, ids, size))
    full = met.join(sets.withColumnRenamed("id", "a").withColumnRenamed("set", "fa"), "a").join(sets.withColumnRenamed("id", "b").withColumnRenamed("set", "fb"), "b")
    inter = F.size(F.array_intersect("fa", "fb"))
    return checkpointed(full.where(100 * inter >= percent * (F.col("na") + F.col("nb") - inter)).select("a", "b"))


def _unsigned(name: str):
    """Hashes as they are ordered in the sketch: with the sign bit turned."""
    return F.transform(name, lambda x: x.bitwiseXOR(F.lit(-(2**63))))


def _near(a, b, percent: int):
    """Sizes within the threshold, signatures close."""
    sizes = (100 * F.least(a["n"], b["n"])) >= percent * F.greatest(a["n"], b["n"])
    return sizes & (F.bit_count(a["sig"].bitwiseXOR(b["sig"])) <= SIGNATURE_BITS)


def _lists(classes: DataFrame, percent: int) -> DataFrame:
    """Members of inverted lists: value, rep, n, sig, size of the list, centre."""
    share = percent / 100
    least = math.floor(SKETCH * share - 5 * math.sqrt(SKETCH * share * (1 - share)))
    entries = classes.select("rep", "n", "sig", F.explode("sketch").alias("value"))
    counts = checkpointed(entries.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    # values of one class never meet another, but count as the rarest that it has
    total = classes.agg(F.sum(F.size("sketch"))).first()[0] or 0
    met = join_counted(entries.withColumnRenamed("n", "held"), counts.withColumn("df", F.col("n")), ["value"], total).withColumnRenamed("held", "n")
    shared = met.groupBy("rep").agg(F.max("n").alias("n"), F.max("sig").alias("sig"), F.sort_array(F.collect_list(F.struct("df", "value"))).alias("shared"))
    held = F.least("n", F.lit(SKETCH)).cast("int")
    needed = F.when(F.col("n") * 100 <= SKETCH * percent, F.ceil(F.col("n") * percent / 100)).otherwise(F.least(F.lit(least), F.ceil(F.col("n") * percent / 100))).cast("int")
    places = held - needed + 1 - (held - F.size("shared"))
    # the centre is the member that has most in common with many: of a family of near copies, the least edited
    hub = F.size(F.filter("shared", lambda x: x["df"] > LIST))
    own = shared.where(places > 0).select("rep", "n", "sig", hub.alias("hub"), F.explode(F.slice("shared", F.lit(1), F.greatest(places, F.lit(1)))).alias("x"))
    own = checkpointed(own.select("rep", "n", "sig", "hub", F.col("x.value").alias("value")))
    lists = own.groupBy("value").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("hub", F.xxhash64("rep").alias("h"), "rep", "n", "sig")).alias("centre")).where("size > 1")
    lists = checkpointed(lists)
    total = own.count()
    own, lists = gathered(own, total), gathered(lists, total)
    met = checkpointed(join_counted(own.withColumnRenamed("n", "held"), lists.withColumn("n", F.col("size")), ["value"], total).withColumnRenamed("held", "n"))
    return gathered(met, total)


def links(docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, component) of all representatives that are linked with another."""
    lists = _lists(classes, percent)
    own = F.struct("rep", "n", "sig")
    short = lists.where(F.col("size") <= LIST).groupBy("value").agg(F.collect_list(own).alias("l"))
    pairs = F.flatten(F.transform("l", lambda a: F.transform(F.filter("l", lambda b: (a["rep"] < b["rep"]) & _near(a, b, percent)), lambda b: F.struct(a["rep"].alias("a"), b["rep"].alias("b")))))
    first = short.select(F.inline(pairs))
    long = lists.where((F.col("size") > LIST) & (F.col("rep") != F.col("centre.rep")))
    star = long.where(_near(own, F.col("centre"), percent)).select(F.least("rep", "centre.rep").alias("a"), F.greatest("rep", "centre.rep").alias("b"))
    found = _confirmed(docs, classes, checkpointed(first.union(star).distinct()), size, percent)
    drawn = components(found)
    # members of long lists that are not in their centre's component, against all others of the list
    names = drawn.select(F.col("node").alias("rep"), "component")
    inside = lists.where(F.col("size") > LIST).join(names, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    centres = names.select(F.col("rep").alias("c"), F.col("component").alias("cc"))
    inside = inside.join(centres, F.col("centre.rep") == F.col("c"), "left").withColumn("cc", F.coalesce("cc", "centre.rep"))
    inside = packed(inside.select("value", "rep", "n", "sig", "component", "cc"))
    apart = inside.where("component <> cc")
    if apart.isEmpty():
        return drawn
    of = lambda s: {"n": F.col(f"{s}.n"), "sig": F.col(f"{s}.sig")}
    blocks = checkpointed(_blocks(apart, inside, F.lit(0)))
    few, many = _dealt(apart, blocks, 0), _dealt(inside, blocks, 1)
    same = (F.col("l.value") == F.col("r.value")) & (F.col("l.i") == F.col("r.i")) & (F.col("l.j") == F.col("r.j"))
    met = same & (F.col("l.component") != F.col("r.component")) & _near(of("l"), of("r"), percent)
    some = lambda x, y: packed(x.join(y, met, "left_semi").select("value", "rep", "component", "n").distinct())
    more = _across(docs, some(few.alias("l"), many.alias("r")), some(many.alias("r"), few.alias("l")), size, percent)
    if more.isEmpty():
        return drawn
    return components(found.union(more))


def _blocks(few: DataFrame, many: DataFrame, shingles: Column) -> DataFrame:
    """Into how many blocks either side of a list (value) is cut: of BLOCK members and BLOCK_SHINGLES shingles at most."""
    of = lambda k: F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(shingles) / BLOCK_SHINGLES)).cast("int").alias(k)
    return few.groupBy("value").agg(of("kf")).join(many.groupBy("value").agg(of("km")), "value")


def _dealt(members: DataFrame, blocks: DataFrame, side: int) -> DataFrame:
    """A row of each member for each pair of blocks (i, j) that its own block is in; no pair of blocks is large."""
    own, other = ("kf", "km") if side == 0 else ("km", "kf")
    found = members.join(F.broadcast(blocks) if blocks.count() <= BROADCAST_IDS else blocks, "value")
    mine, each = F.pmod(F.xxhash64("rep"), F.col(own)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(other) - 1))
    i, j = (mine, each) if side == 0 else (each, mine)
    return found.select(*members.columns, i.alias("i"), j.alias("j"))


def _across(docs: DataFrame, few: DataFrame, many: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between members (value, rep, component, n) of ``few`` and of ``many`` of the same list and of
    different components: for each member of ``few`` one link to each component that it has any with.

    Lists are cut into blocks of at most about BLOCK members and BLOCK_SHINGLES shingles on either side; each pair of
    blocks is one task's work, on full sets, so that no row is made for a pair without a link."""
    ids = checkpointed(few.select("rep").union(many.select("rep")).distinct().withColumnRenamed("rep", "id"))
    sets = checkpointed(_sets(docs, ids, size))
    blocks = checkpointed(_blocks(few, many, F.col("n")))
    both = (_dealt(x, blocks, k).select("value", "i", "j", F.lit(k).alias("side"), F.col("rep").alias("id"), "component") for k, x in enumerate((few, many)))
    rows = reduce(DataFrame.union, both).join(sets, "id")

    def compare(part: pa.Table) -> pa.Table:
        side, ids, component = (part.column(c).to_numpy() for c in ("side", "id", "component"))
        column = part.column("set").combine_chunks()
        column = column if isinstance(column, pa.ListArray) else column.chunk(0)
        at, values = column.offsets.to_numpy(), column.values.to_numpy()
        lengths = np.diff(at)
        owner = np.repeat(np.arange(len(ids)), lengths)
        flat = values[at[0] : at[-1]]
        right = side[owner] == 1
        order = np.argsort(flat[right], kind="stable")
        known, places = flat[right][order], owner[right][order]  # postings of the many
        a, b = [], []
        for k in np.flatnonzero(side == 0):
            own = values[at[k] : at[k + 1]]
            lo, hi = np.searchsorted(known, own), np.searchsorted(known, own, side="right")
            hits = np.concatenate([places[x:y] for x, y in zip(lo, hi, strict=True)]) if len(own) else places[:0]
            shared = np.bincount(hits, minlength=len(ids))
            other = np.flatnonzero(shared)
            inter = shared[other]
            ok = (100 * inter >= percent * (len(own) + lengths[other] - inter)) & (component[other] != component[k])
            _, first = np.unique(component[other[ok]], return_index=True)
            a += [ids[k]] * len(first)
            b += ids[other[ok][first]].tolist()
        low, high = np.minimum(a, b) if a else [], np.maximum(a, b) if a else []
        return pa.table({"a": pa.array(low, pa.int64()), "b": pa.array(high, pa.int64())})

    found = rows.groupBy("value", "i", "j").applyInArrow(compare, "a long, b long")
    return checkpointed(found.distinct())


def _one_text_each(docs: DataFrame, sketched: DataFrame) -> DataFrame | None:
    """``docs`` with ids of their own for the rows of ids that have several texts; None if there are none."""
    texts = sketched.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b")).where("a <> b")
    several = checkpointed(texts.select(F.col("doc_id").alias("several")))
    n = several.count()
    if not n:
        return None
    met = docs.join(F.broadcast(several) if n <= BROADCAST_IDS else several, F.col("doc_id") == F.col("several"), "left")
    own = F.when(F.col("several").isNotNull(), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id"))
    return written(met.select(own.alias("doc_id"), "text", F.col("doc_id").alias("was")))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id (least doc_id of the linked documents), kept; a row for each row of
    ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = checkpointed(sketches(docs, size))
    split = _one_text_each(docs, sketched)
    if split is not None:
        was = split.select(F.col("doc_id").alias("own"), "was", F.xxhash64("text").alias("own_hash")).distinct()
        docs, sketched = split, checkpointed(sketches(split, size))
    some = sketched.where("n > 0 AND doc_id IS NOT NULL")
    classes = packed(some.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch")))
    drawn = links(docs, classes.select("rep", "n", "sig", "sketch"), size, percent)
    of = classes.select("digest", "rep").join(drawn.withColumnRenamed("node", "rep"), "rep", "left")
    of = of.select(F.col("digest").alias("d"), F.coalesce("component", "rep").alias("component_id"))
    own = sketched.select("doc_id", "text_hash", "n", "digest").join(of, (F.col("digest") == F.col("d")) & (F.col("n") > 0) & F.col("doc_id").isNotNull(), "left")
    found = own.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    if split is not None:  # back to the ids as they were
        named = found.join(was, F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("text_hash") == F.col("own_hash")))
        least = named.groupBy("component_id").agg(F.min("was").alias("least")).withColumnRenamed("component_id", "c")
        named = named.join(least, F.col("component_id") == F.col("c"), "left")
        found = named.select(F.col("was").alias("doc_id"), "text_hash", "n_shingles", F.col("least").alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op2_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2).drop("text_hash")
