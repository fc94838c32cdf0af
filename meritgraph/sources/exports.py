"""Writers: dictionary-coded graphs, node and edge files for graph databases, payout lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meritgraph.functions.addresses import head
from meritgraph.functions.money import plain
from meritgraph.operators.graph import Graph
from meritgraph.operators.order import with_index

ROWS_A_FILE = 500_000


def coded(g: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(addresses, nodes, edges): every address that is a node or an end of an edge has an index in sorted order, and
    nodes and edges name their addresses by it."""
    every = g.nodes.select("address").union(g.edges.select("src")).union(g.edges.select("dst")).distinct()
    names = with_index(every, "address")
    n = g.nodes.join(names, "address").select("index", "description", "timestamp_ms")
    s, d = names.select(F.col("address").alias("src"), F.col("index").alias("src_index")), names.select(F.col("address").alias("dst"), F.col("index").alias("dst_index"))
    return names, n, g.edges.join(s, "src").join(d, "dst").select("address", "src_index", "dst_index", "timestamp_ms")


def decoded(addresses: DataFrame, nodes: DataFrame, edges: DataFrame) -> Graph:
    n = nodes.join(addresses, "index").select("address", "description", "timestamp_ms")
    s, d = addresses.select(F.col("address").alias("src"), F.col("index").alias("src_index")), addresses.select(F.col("address").alias("dst"), F.col("index").alias("dst_index"))
    return Graph(n, edges.join(s, "src_index").join(d, "dst_index").select("address", "src", "dst", "timestamp_ms"))


def node_rows(g: Graph, scores: DataFrame) -> DataFrame:
    """Rows of a graph database's node file: the type is the first two segments, the plugin the first; descriptions
    keep plain characters only."""
    clean = F.regexp_replace("description", r"[^a-zA-Z0-9/:\[\]() \-.#]", "")
    met = g.nodes.join(scores, "address", "left")
    return met.select(F.col("address").alias("address:ID"), head(F.col("address"), 2).alias("nodeType:LABEL"), head(F.col("address"), 1).alias("plugin:LABEL"), clean.alias("description"), "timestamp_ms", F.coalesce("score", F.lit(0.0)).alias("score"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("maxRecordsPerFile", ROWS_A_FILE).csv(path)


def payout_lines(payable: DataFrame, token: str | None = None) -> DataFrame:
    """(line): ``address,amount``, with ``erc20,token,`` before it for a token."""
    return payable.select(F.concat(F.lit(f"erc20,{token}," if token else ""), "address", F.lit(","), plain(F.col("amount"))).alias("line"))
