"""Objects of a mirrored source, kept as facts about them and put together on demand.

A mirror learns about objects bit by bit: that one exists, what type it has, its own values, the object that a field
leads to, the next page of a connection. Each is a row of its own with the number (``seq``) of the update that brought
it, so updates append and never rewrite, and what holds is the last word on each fact:

objects (id, typename or null while unknown, seq), primitives (id, field, value as JSON text, seq), links (id, field,
child or null, seq), entries (id, field, ord, child or null, seq) of connections.

``assemble`` joins facts level by level, from the leaves of a selection up, so the graph of objects may have cycles. A
connection becomes an array in its object's row: begin at objects whose connections are small (a pull, not its
repository), and have what is above from ``parents``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritgraph.operators.frames import checkpointed
from meritgraph.operators.references import reachable


@dataclass(frozen=True)
class Store:
    objects: DataFrame
    primitives: DataFrame
    links: DataFrame
    entries: DataFrame


@dataclass(frozen=True)
class Node:
    """The object that a field leads to: of any type if ``typename`` is None."""

    shape: dict
    typename: str | None = None


@dataclass(frozen=True)
class Many:
    """The objects of a connection, in order."""

    shape: dict
    typename: str | None = None


def folded(updates: Store, blocked: DataFrame | None = None, kept: bool = True) -> Store:
    """What holds after all updates: one row for each fact. A typename that was unknown is taken from a later (or an
    earlier) update that knows it; two different ones are an error. Children that are ``blocked`` (id) become null. Facts are
    written once if they are ``kept``; else, for plans that name each kind once, only what these ask for is folded."""
    seen = checkpointed(updates.objects.groupBy("id").agg(F.min("typename").alias("typename"), F.max("typename").alias("other"), F.max("seq").alias("seq")))
    wrong = seen.where("typename <> other").limit(5).collect()
    if wrong:
        raise ValueError(f"objects of two types: {sorted((r.id, r.typename, r.other) for r in wrong)}")

    def last(rows: DataFrame, by: list[str], value: str) -> DataFrame:
        # values of one update that contradict each other count by their order
        return rows.groupBy(*by).agg(F.max(F.struct("seq", value)).alias("x")).select(*by, F.col(f"x.{value}").alias(value), F.col("x.seq").alias("seq"))

    def without(rows: DataFrame) -> DataFrame:
        if blocked is None:
            return rows
        met = rows.join(blocked.select(F.col("id").alias("_b")).distinct(), F.col("child") == F.col("_b"), "left")
        return met.withColumn("child", F.when(F.col("_b").isNull(), F.col("child"))).drop("_b")

    found = Store(seen.drop("other"), last(updates.primitives, ["id", "field"], "value"), without(last(updates.links, ["id", "field"], "child")), without(last(updates.entries, ["id", "field", "ord"], "child")))
    return Store(found.objects, *(checkpointed(x) for x in (found.primitives, found.links, found.entries))) if kept else found


def unknown(store: Store) -> DataFrame:
    """(id): objects that others lead to, or that are registered, without a type: the next to ask for."""
    led = store.links.select("child").union(store.entries.select("child")).where("child IS NOT NULL").select(F.col("child").alias("id"))
    typed = store.objects.where("typename IS NOT NULL").select("id")
    return led.union(store.objects.where("typename IS NULL").select("id")).distinct().join(typed, "id", "left_anti")


def stale(objects: DataFrame, updates: DataFrame, since: int) -> DataFrame:
    """(id, typename) of typed objects whose last update (id, ms) lies before ``since``, or that were never updated."""
    last = updates.groupBy("id").agg(F.max("ms").alias("ms"))
    return objects.where("typename IS NOT NULL").join(last, "id", "left").where(F.col("ms").isNull() | (F.col("ms") < since)).select("id", "typename")


def reached(store: Store, roots: DataFrame) -> DataFrame:
    """(id, distance) of all objects that ``roots`` (id) lead to, themselves included."""
    edges = store.links.select("id", "child").union(store.entries.select("id", "child")).where("child IS NOT NULL")
    return reachable(checkpointed(edges.select(F.col("id").alias("src"), F.col("child").alias("dst")).distinct()), roots.select(F.col("id").alias("node"))).select(F.col("node").alias("id"), "distance")


def parents(store: Store, field: str) -> DataFrame:
    """(id, parent): whose connection ``field`` an object is in."""
    return store.entries.where((F.col("field") == field) & F.col("child").isNotNull()).select(F.col("child").alias("id"), F.col("id").alias("parent")).distinct()


def values(store: Store, ids: DataFrame, fields: dict[str, str]) -> DataFrame:
    """``ids`` (id, ...) with the primitives ``fields`` (field: type); null where one was never learned. A value of
    another type is an error when rows are read."""
    if not fields:
        return ids
    cast = lambda f, t: F.variant_get(F.parse_json(F.max(F.when(F.col("field") == f, F.col("value")))), "$", t).alias(f)
    wide = store.primitives.where(F.col("field").isin(list(fields))).groupBy("id").agg(*(cast(f, t) for f, t in fields.items()))
    return ids.join(wide, "id", "left")


def assemble(store: Store, shape: dict, typename: str | None = None) -> DataFrame:
    """(id, typename, and a column for each field of ``shape``) of the objects of a type (all typed ones if None). A field
    is a primitive's type in Spark's words, or a Node or Many with a shape of its own; those are structs with id and
    typename in front, arrays keep the connection's order, and children that are null or untyped are left out."""
    rows = store.objects.where("typename IS NOT NULL" if typename is None else F.col("typename") == typename).select("id", "typename")
    rows = values(store, rows, {f: t for f, t in shape.items() if isinstance(t, str)})
    for field, below in shape.items():
        if isinstance(below, str):
            continue
        inner = assemble(store, below.shape, below.typename)
        inner = inner.select(F.col("id").alias("child"), F.struct(*inner.columns).alias("one"))
        at = F.col("field") == field
        if isinstance(below, Node):
            led = store.links.where(at & F.col("child").isNotNull()).select("id", "child").join(inner, "child").select(F.col("id").alias("_k"), F.col("one").alias(field))
            rows = rows.join(led, F.col("id") == F.col("_k"), "left").drop("_k")
        else:
            members = store.entries.where(at & F.col("child").isNotNull()).select("id", "ord", "child").join(inner, "child")
            ordered = F.transform(F.sort_array(F.collect_list(F.struct("ord", "child", "one"))), lambda x: x["one"])
            rows = rows.join(members.groupBy(F.col("id").alias("_k")).agg(ordered.alias(field)), F.col("id") == F.col("_k"), "left").drop("_k").withColumn(field, F.coalesce(field, F.array()))
    return rows.select("id", "typename", *shape)


#: What a forge's types are called in its graph, and the connections that tell a child's parent.
KINDS = {"Repository": "repo", "Issue": "issue", "PullRequest": "pull", "PullRequestReview": "review", "IssueComment": "comment", "PullRequestReviewComment": "comment", "Commit": "commit"}
ABOVE = ("issues", "pullRequests", "reviews", "comments")


def forge_entities(store: Store) -> DataFrame:
    """The entities of ``forge.graph`` (kind, key, parent, author, description, ms, merged_as, hash) of a forge's objects:
    keys, titles, times and commits' hashes are their primitives, authors and merge commits their links, and a parent is
    the object in whose connection one is."""
    named = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    own = store.objects.where(F.col("typename").isin(list(KINDS))).select("id", named[F.col("typename")].alias("kind"))
    own = values(store, own, {"key": "string", "title": "string", "createdAt": "bigint", "oid": "string"})
    place: Column = F.concat(F.lit("repository/"), F.col("kind"), F.lit("/"), F.col("key"), F.lit("/"))
    own = checkpointed(own.withColumn("a", place))
    known = own.select(F.col("id").alias("_i"), F.col("a").alias("_a"))
    above = store.entries.where(F.col("field").isin(list(ABOVE)) & F.col("child").isNotNull()).groupBy(F.col("child").alias("_c")).agg(F.min("id").alias("_p"))
    logins = values(store, store.objects.where("typename IN ('User', 'Bot', 'Organization')").select("id"), {"login": "string"})
    authors = store.links.where("field = 'author'").select(F.col("id").alias("_w"), F.col("child")).join(logins.withColumnRenamed("id", "child"), "child").drop("child")
    merges = store.links.where("field = 'mergeCommit'").select(F.col("id").alias("_m"), F.col("child").alias("_i")).join(known, "_i").select("_m", F.col("_a").alias("merged_as"))
    met = own.join(above, F.col("id") == F.col("_c"), "left").join(known, F.col("_p") == F.col("_i"), "left").join(authors, F.col("id") == F.col("_w"), "left").join(merges, F.col("id") == F.col("_m"), "left")
    return met.select("kind", "key", F.col("_a").alias("parent"), F.col("login").alias("author"), F.col("title").alias("description"), F.col("createdAt").alias("ms"), "merged_as", F.col("oid").alias("hash"))
