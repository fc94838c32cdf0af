"""References in texts, and closures over references."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritgraph.operators.frames import checkpointed

#: Numbers (#12), people (@name), and links.
NUMBER, PERSON, LINK = r"(?:^|[^\w&])#(\d+)", r"(?:^|[^\w/])@([A-Za-z0-9][A-Za-z0-9-]*)", r"https?://[^\s<>\"')\]]+"
HREF = r"<a\s[^>]*href=\"([^\"]*)\""


def without_code(text: Column) -> Column:
    """Text without fenced and inline code, where nothing refers."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?(```|\z)", " "), r"`[^`\n]*`", " ")


def references(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, ref, n): distinct references of a text and how often it makes them."""
    plain = rows.select(key, without_code(F.col(text)).alias("_t"))
    of = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("ref"))
    found = F.concat(*(F.transform(F.regexp_extract_all("_t", F.lit(p), F.lit(g)), of(k)) for k, p, g in (("number", NUMBER, 1), ("person", PERSON, 1), ("link", LINK, 0))))
    return plain.select(key, F.inline(found)).groupBy(key, "kind", "ref").agg(F.count(F.lit(1)).alias("n"))


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, href, n) of anchors."""
    return pages.select(key, F.explode(F.regexp_extract_all(F.col(html), F.lit(HREF), F.lit(1))).alias("href")).groupBy(key, "href").agg(F.count(F.lit(1)).alias("n"))


def resolve(refs: DataFrame, dictionaries: list[DataFrame], ref: str = "ref") -> DataFrame:
    """``refs`` with address: that of the first dictionary (ref, address) that knows the reference, or null."""
    out = refs
    for i, d in enumerate(dictionaries):
        out = out.join(d.select(F.col("ref").alias(f"_r{i}"), F.col("address").alias(f"_a{i}")), F.col(ref) == F.col(f"_r{i}"), "left")
    names = [f"_{x}{i}" for i in range(len(dictionaries)) for x in "ra"]
    return out.withColumn("address", F.coalesce(*(f"_a{i}" for i in range(len(dictionaries))))).drop(*names)


def reachable(edges: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """(node, distance) of all nodes that can be reached from ``roots`` (node) along (src, dst), or of those within
    ``most`` steps: a frontier a round, against what is known, so cycles end."""
    known = checkpointed(roots.select("node").distinct().withColumn("distance", F.lit(0)))
    frontier = known
    for k in itertools.count(1) if most is None else range(1, most + 1):
        onward = edges.join(frontier, F.col("src") == F.col("node")).select(F.col("dst").alias("node")).distinct()
        frontier = checkpointed(onward.join(known, "node", "left_anti").withColumn("distance", F.lit(k)))
        if frontier.isEmpty():
            break
        known = checkpointed(known.union(frontier))
    return known
