"""How filters interact: what each of them removes in every order in which they can be applied. DataFrame functions only.

Five native expressions give each document a mask of the filters that it fails. Four depend on its text alone; the fifth
(the text of a smaller doc_id) needs the least doc_id of each text, from a grouping by the text's digest. Documents are
then counted by part and mask, 32 cells a part with partial sums, and everything else follows from the cells: a filter
removes, in an order, the documents of those masks that have its bit and none of the bits before it. So the 120 orders
cost nothing that grows with the documents.

A filter's sum over all orders is taken from the cells as well: of the orders, the share 1 / k has a given one of a
mask's k bits first, so a document of that mask is removed by it in 120 / k of them.

Null texts count as empty, null parts as the empty string. Very long texts are read once and shuffled only as digests
(SHA-256). Rows without an id are no copy of any row, and no row is a copy of theirs; rows of one id with the same text
are not copies of each other, for neither has the smaller id, and each row is counted. A label holds if any row of
``labels`` for the id has it; rows of ``labels`` without an id count for nothing. Columns of other names are not read. An
empty table has no parts and gives no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meritgraph.llm.common import UPPER, checkpointed, join_counted, let, table, words, written

MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_UPPER_PERCENT = 5
SYMBOLS = "#$%&*|"
#: The filters that a text alone decides, and the one that needs all texts; a filter's bit is its place.
FILTERS = ("A", "B", "C", "D", "E")
COPY = FILTERS.index("E")
COUNTS = ("n", "good", "toxic")


def failures(text: Column) -> Column:
    """The mask of the filters A to D that a text fails."""
    text = F.coalesce(text, F.lit(""))
    without = lambda chars: F.length(F.translate(text, chars, ""))

    def mask(w: Column) -> Column:
        failed = (
            F.size(w) < MIN_WORDS, 100 * F.size(F.array_distinct(w)) < MIN_DISTINCT_PERCENT * F.size(w),
            100 * (F.length(text) - without(UPPER)).cast("long") > MAX_UPPER_PERCENT * F.length(text).cast("long"), without(SYMBOLS) < F.length(text),
        )
        return reduce(Column.__add__, (F.when(x, 1 << i).otherwise(0) for i, x in enumerate(failed)))

    return let(words(text), mask)


def cells(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, mask): n documents, good and toxic ones (long)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), failures(F.col("text")).alias("mask"))
    own = written(own)
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    marks = checkpointed(marks)
    zero = F.lit(0).cast("long")
    known = own.where("doc_id IS NOT NULL").join(marks, "doc_id", "left")
    rows = known.unionByName(own.where("doc_id IS NULL"), allowMissingColumns=True)  # so that they don't meet in one task
    rows = written(rows.select("doc_id", "part", "digest", "mask", F.coalesce("good", zero).alias("good"), F.coalesce("toxic", zero).alias("toxic")))
    several = checkpointed(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")).where("n > 1"))
    sums = lambda x, sign: x.groupBy("part", "mask").agg((sign * F.count(F.lit(1))).alias("n"), *((sign * F.sum(c)).alias(c) for c in COUNTS[1:]))
    later = join_counted(rows, several, ["digest"], rows.count()).where("doc_id > least")
    moved = written(sums(later, 1))  # copies: out of the cell without their bit, into the one with it
    taken = moved.select("part", "mask", *((-F.col(c)).alias(c) for c in COUNTS))
    given = moved.withColumn("mask", F.col("mask") + (1 << COPY))
    return sums(rows, 1).union(taken).union(given.select(*taken.columns)).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in COUNTS))


def audit(found: DataFrame, filters: tuple[str, ...] = FILTERS) -> DataFrame:
    """Every step of every order of the filters, for each part of the cells ``found`` (part, mask, n, good, toxic)."""
    orders = [(order, step, filters.index(f), sum(1 << filters.index(x) for x in order[:step])) for order in permutations(filters) for step, f in enumerate(order)]
    steps = F.array(*(F.struct(F.lit("".join(o)).alias("filter_order"), F.lit(s + 1).alias("step"), F.lit(1 << b).alias("bit"), F.lit(before).alias("before")) for o, s, b, before in orders))
    each = found.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))  # 2^filters at most
    each = each.withColumn("s", F.explode(steps)).select("part", "cells", "s.*")

    def total(which, value=lambda c: c["n"]) -> Column:
        return F.aggregate(F.filter("cells", which), F.lit(0).cast("long"), lambda a, c: a + value(c))

    bit, before = F.col("bit"), F.col("before")
    has = lambda c: c["mask"].bitwiseAND(bit) != 0
    gone = lambda c: c["mask"].bitwiseAND(before) != 0
    here = lambda c: has(c) & ~gone(c)
    n_orders = len(orders) // len(filters)
    return each.select(
        "part", "filter_order", "step",
        total(lambda c: ~has(c) & ~gone(c)).alias("kept"), total(here).alias("removed"), total(lambda c: has(c) & gone(c)).alias("redundant"),
        total(lambda c: c["mask"] == bit).alias("unique_fails"), total(here, lambda c: c["good"]).alias("good_lost"), total(here, lambda c: c["toxic"]).alias("toxic_lost"),
        total(has, lambda c: (n_orders * c["n"] / F.bit_count(c["mask"])).cast("long")).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP13_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
m AS (SELECT w.doc_id, part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS c,
       regexp_matches(text, '[#$%&*|]') AS d, coalesce(w.doc_id > least, false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
       FROM w LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
k AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS failed,
       count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY ALL),
s AS (SELECT part, filter_order, step, filter_order[step] AS f, k.*, failed LIKE '%' || filter_order[step] || '%' AS has,
       len(list_intersect(string_split(failed, ''), string_split(filter_order[1:step - 1], ''))) > 0 AND step > 1 AND failed <> '' AS gone
       FROM k, o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
g AS (SELECT part, filter_order, step::INTEGER AS step, f, sum(CASE WHEN NOT has AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN has AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
       sum(CASE WHEN has AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN failed = f THEN n ELSE 0 END)::BIGINT AS unique_fails,
       sum(CASE WHEN has AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN has AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM s GROUP BY ALL)
SELECT * EXCLUDE (f), (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM g
"""
