"""Contribution graphs: nodes (address, description, timestamp_ms or null) and directed edges (address, src, dst,
timestamp_ms). Edges whose ends are not among the nodes dangle, which is allowed."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritgraph.functions.addresses import has_prefix

NODE = ["address", "description", "timestamp_ms"]
EDGE = ["address", "src", "dst", "timestamp_ms"]


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame


def nodes(g: Graph, prefix: str = "") -> DataFrame:
    return g.nodes.where(has_prefix(F.col("address"), prefix))


def edges(g: Graph, prefix: str = "", src: str = "", dst: str = "", dangling: bool = True) -> DataFrame:
    found = g.edges.where(has_prefix(F.col("address"), prefix) & has_prefix(F.col("src"), src) & has_prefix(F.col("dst"), dst))
    return found if dangling else solid(Graph(g.nodes, found))


def solid(g: Graph) -> DataFrame:
    """Edges with both ends among the nodes."""
    ends = g.nodes.select(F.col("address").alias("end"))
    return g.edges.join(ends, F.col("src") == F.col("end"), "left_semi").join(ends, F.col("dst") == F.col("end"), "left_semi")


def with_dangling(g: Graph) -> DataFrame:
    """All edges with ``dangling``."""
    s, d = g.nodes.select(F.col("address").alias("s")), g.nodes.select(F.col("address").alias("d"))
    found = g.edges.join(s, F.col("src") == F.col("s"), "left").join(d, F.col("dst") == F.col("d"), "left")
    return found.withColumn("dangling", F.col("s").isNull() | F.col("d").isNull()).drop("s", "d")


def neighbors(g: Graph, root: str, direction: str = "ANY", node_prefix: str = "", edge_prefix: str = "") -> DataFrame:
    """(neighbor, edge): nodes at the far end of the root's edges; a loop once; dangling edges not at all."""
    if g.nodes.where(F.col("address") == root).isEmpty():
        raise ValueError(f"no such node: {root}")
    own = edges(g, edge_prefix)
    out = own.where(F.col("src") == root).select(F.col("dst").alias("neighbor"), F.col("address").alias("edge"))
    into = own.where((F.col("dst") == root) & (F.lit(direction == "IN") | (F.col("src") != root))).select(F.col("src").alias("neighbor"), F.col("address").alias("edge"))
    found = {"OUT": out, "IN": into, "ANY": out.union(into)}[direction].where(has_prefix(F.col("neighbor"), node_prefix))
    return found.join(g.nodes, F.col("neighbor") == F.col("address"), "left_semi")


def _same(rows: DataFrame, columns: list[str], what: str) -> DataFrame:
    """One row an address; an error where two differ."""
    other = [c for c in columns if c != "address"]
    found = rows.groupBy("address").agg(F.min(F.struct(*other)).alias("a"), F.max(F.struct(*other)).alias("b"))
    checked = F.when(F.col("a").eqNullSafe(F.col("b")), F.col("a")).otherwise(F.raise_error(F.concat(F.lit(f"conflicting {what}: "), "address")).cast(found.schema["a"].dataType))
    return found.select("address", checked.alias("a")).select("address", *(F.col(f"a.{c}").alias(c) for c in other)).select(*columns)


def merge(graphs: list[Graph]) -> Graph:
    """The union by address; equal repeats are fine, conflicts are errors when rows are read."""
    all_nodes = reduce(DataFrame.unionByName, (g.nodes.select(*NODE) for g in graphs))
    all_edges = reduce(DataFrame.unionByName, (g.edges.select(*EDGE) for g in graphs))
    return Graph(_same(all_nodes, NODE, "nodes"), _same(all_edges, EDGE, "edges"))


def contract(g: Graph, contractions: DataFrame) -> Graph:
    """``contractions`` (old, address, description, timestamp_ms): replaces old nodes, rewrites the ends of all edges
    (dangling ones too) and adds each replacement once. A replacement that is replaced itself, and an old node with two
    replacements, are errors."""
    names = contractions.select("old", F.col("address").alias("new")).distinct()
    wrong = names.groupBy("old").count().where("count > 1").select("old").union(names.select("old").join(names.select(F.col("new").alias("n")).distinct(), F.col("old") == F.col("n"), "left_semi")).limit(5).collect()
    if wrong:
        raise ValueError(f"contractions that contradict each other: {sorted({r.old for r in wrong})}")
    kept = g.nodes.join(names, F.col("address") == F.col("old"), "left_anti").select(*NODE)
    added = contractions.select(*NODE).dropDuplicates(["address"])
    s, d = (names.select(F.col("old").alias(f"{x}o"), F.col("new").alias(f"{x}n")) for x in "sd")
    moved = g.edges.join(s, F.col("src") == F.col("so"), "left").join(d, F.col("dst") == F.col("do"), "left")
    return Graph(kept.unionByName(added), moved.select("address", F.coalesce("sn", "src").alias("src"), F.coalesce("dn", "dst").alias("dst"), "timestamp_ms"))


def without(g: Graph, gone: DataFrame, what: str = "nodes") -> Graph:
    """Without the nodes or edges whose address is in ``gone``; edges of deleted nodes are left to dangle."""
    kept = getattr(g, what).join(gone.select(F.col("address").alias("gone")), F.col("address") == F.col("gone"), "left_anti")
    return Graph(kept, g.edges) if what == "nodes" else Graph(g.nodes, kept)


def difference(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """(address, change) of rows that are in one only or differ: ``removed``, ``added``, ``changed``."""
    other = [c for c in columns if c != "address"]
    left, right = (x.select(F.col("address").alias(f"{n}_address"), F.struct(*other).alias(n)) for x, n in ((a, "a"), (b, "b")))
    met = left.join(right, F.col("a_address") == F.col("b_address"), "full_outer")
    change = F.when(F.col("b_address").isNull(), "removed").when(F.col("a_address").isNull(), "added").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return met.select(F.coalesce("a_address", "b_address").alias("address"), change.alias("change")).where("change IS NOT NULL")


def equals(a: Graph, b: Graph) -> bool:
    same = lambda x, y, c: difference(x, y, c).isEmpty()
    return same(a.nodes, b.nodes, NODE) and same(a.edges, b.edges, EDGE)


def degree(g: Graph, by: Column | None = None) -> DataFrame:
    """(address, n_in, n_out) over edges that don't dangle."""
    own = solid(g)
    ends = own.select(F.col("src").alias("address"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(own.select("dst", F.lit(1), F.lit(0)))
    return ends.groupBy("address").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
