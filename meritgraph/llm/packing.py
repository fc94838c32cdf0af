"""Packing into optimal length buckets.

Lengths are counted over all documents into a histogram whose bins are exact up to EXACT tokens and grow by 1/64 above,
so it has a bounded number of rows at any size. Dynamic programming over the bins chooses the bucket ends that
minimise padding (each text is padded to the longest of its bucket). Buckets end where bins do: they are optimal on
lengths up to EXACT, and above that the longest text of a bin is under 1/64 longer than its shortest, so the padding is
within 1/64 of the tokens of the best. Inside a bucket, texts are dealt by hash to
sections of about SECTION_ROWS, and each section is cut into batches of rows that fill the token budget, so no group
grows with the input and only a section's last batch can be short.

Tokens are words unless another length column is named. Only the columns that the caller keeps and the text are read. Null and empty texts have length 0 and are packed with the
shortest. A text that is longer than the budget is a batch of its own, whole. Repeated rows take a place each; an empty
table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meritgraph.llm.common import checkpointed, fresh, table, words

BUCKETS = 12
BUDGET = 16_384
EXACT = 256
SECTION_ROWS = 20_000


def length_bin(n: Column) -> Column:
    """Bin of a length: itself up to EXACT, then 64 bins for each doubling."""
    return F.when(n <= EXACT, n).otherwise(EXACT + F.ceil(64 * F.log2(n / EXACT))).cast("int")


def bucket_ends(histogram: list[tuple[int, int, int]], buckets: int) -> list[int]:
    """Indices of the bins that end the buckets, of least padding in all. histogram: (longest, rows, tokens) of each
    bin, by length."""
    n = len(histogram)
    if not n:
        return []
    longest = np.array([h[0] for h in histogram], dtype=np.float64)
    rows = np.concatenate([[0], np.cumsum([h[1] for h in histogram], dtype=np.float64)])
    tokens = np.concatenate([[0], np.cumsum([h[2] for h in histogram], dtype=np.float64)])
    best = np.concatenate([[0.0], longest * rows[1:] - tokens[1:]])  # with one bucket over bins 0..j-1
    back = [np.zeros(n + 1, dtype=int)]
    for _ in range(1, min(buckets, n)):
        new, own = best.copy(), np.arange(n + 1)
        for j in range(1, n + 1):
            cost = best[:j] + longest[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            k = int(np.argmin(cost))
            new[j], own[j] = (cost[k], k) if cost[k] < best[j] else (best[j], -1)
        best = new
        back.append(own)
    ends, j = [], n
    for own in reversed(back):
        if own[j] == -1:  # fewer buckets do as well
            continue
        ends.append(j - 1)
        j = int(own[j])
        if j == 0:
            break
    return ends[::-1]


def pack(docs: DataFrame, keep: list[str], length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """The columns ``keep`` of ``docs`` with n_tokens, bucket, padded_to, batch (an id over all) and slot in the batch."""
    n = (F.size(words(F.col("text"))) if length is None else F.coalesce(length, F.lit(0))).cast("int")
    # rows that agree in what is kept (all without an id, say) are told apart by their text
    dealt = F.xxhash64(*keep, *(["text"] if "text" in docs.columns else []))
    sized = checkpointed(docs.select(*keep, n.alias("n_tokens"), dealt.alias(fresh("dealt", docs.columns))))
    bins = sized.groupBy(length_bin(F.col("n_tokens")).alias("bin")).agg(F.max("n_tokens").alias("longest"), F.count(F.lit(1)).alias("rows"), F.sum("n_tokens").alias("tokens"))
    found = sorted((r.bin, r.longest, r.rows, r.tokens) for r in bins.collect())  # a few thousand at most
    ends = bucket_ends([x[1:] for x in found], buckets)
    longest = [found[e][1] for e in ends]
    held = [sum(x[2] for x in found[a + 1 : e + 1]) for a, e in zip([-1, *ends], ends)]
    sections = [max(1, math.ceil(x / SECTION_ROWS)) for x in held]
    of = lambda values: F.get(F.array(*map(F.lit, values)) if values else F.array(F.lit(0)), F.col("bucket"))
    bounds = F.array(*map(F.lit, longest)).cast("array<int>") if longest else F.array().cast("array<int>")
    placed = sized.withColumn("bucket", F.size(F.filter(bounds, lambda b: b < F.col("n_tokens")))).withColumn("padded_to", of(longest))
    key = F.col(sized.columns[-1])
    placed = placed.withColumn("section", F.pmod(key, of(sections)).cast("int"))
    rows = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("padded_to"), F.lit(1)))).cast("int")
    place = F.row_number().over(Window.partitionBy("bucket", "section").orderBy(key, *keep)) - 1
    placed = placed.withColumn("place", place).withColumn("rows", rows)
    batch = F.format_string("%d-%d-%d", "bucket", "section", F.floor(F.col("place") / F.col("rows")))
    return placed.select(*keep, "n_tokens", "bucket", "padded_to", batch.alias("batch"), (F.col("place") % F.col("rows")).cast("int").alias("slot"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), ["doc_id"])
