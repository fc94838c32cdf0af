"""The driver tables as a contribution graph: users are participants without a time, events are contributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meritgraph.functions.addresses import address
from meritgraph.functions.weeks import millis
from meritgraph.operators.frames import checkpointed
from meritgraph.operators.graph import Graph
from meritgraph.operators.weights import with_products
from meritgraph.sources.tables import table

NODE_WEIGHTS = [("", 1.0), ("event/", 1.0), ("event/purchase/", 4.0), ("event/signup/", 2.0), ("event/error/", 0.0), ("event/click/", 0.5), ("user/", 0.0)]
EDGE_WEIGHTS = [("authors/", 0.5, 1.0), ("mentions/", 1.0, 0.25), ("mentions/purchase/", 2.0, 1.0), ("authors/click/", 1.0, 0.5)]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long") * 2
    return table(spark, sf_dir, "events").select("event_id", millis(F.col("ts")).alias("ms"), "user_id", "event_type", "value", k.alias("k"))


def event_graph(spark: SparkSession, sf_dir: str, parts: int | None = None) -> Graph:
    """user -> event (authors) and event -> user (mentions); some mentioned users don't exist, so their edges dangle. The
    events are dealt to ``parts``, or stay as they are read."""
    e = events(spark, sf_dir)
    if parts is not None:
        e = e.repartition(parts, "event_id")
    user, event = address("user", F.col("user_id")), address("event", F.col("event_type"), F.col("event_id"))
    users = e.select("user_id").distinct().select(user.alias("address"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("description"), F.lit(None).cast("long").alias("timestamp_ms"))
    nodes = users.unionByName(e.select(event.alias("address"), F.col("event_type").alias("description"), F.col("ms").alias("timestamp_ms")))
    authors = e.select(address("authors", F.col("event_type"), F.col("event_id")).alias("address"), user.alias("src"), event.alias("dst"), F.col("ms").alias("timestamp_ms"))
    mentions = e.select(address("mentions", F.col("event_type"), F.col("event_id")).alias("address"), event.alias("src"), address("user", F.col("k")).alias("dst"), F.col("ms").alias("timestamp_ms"))
    return Graph(nodes, authors.unionByName(mentions))


def kept_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph, read and built once, for plans that name it many times."""
    # a small file is one split, and what follows would be one task
    g = event_graph(spark, sf_dir, 4 * spark.sparkContext.defaultParallelism)
    return Graph(checkpointed(g.nodes), checkpointed(g.edges))


def node_weights(spark: SparkSession, g: Graph) -> DataFrame:
    return with_products(g.nodes, spark.createDataFrame(NODE_WEIGHTS, "prefix string, weight double"), ["weight"])


def edge_weights(spark: SparkSession, g: Graph) -> DataFrame:
    return with_products(g.edges, spark.createDataFrame(EDGE_WEIGHTS, "prefix string, forwards double, backwards double"), ["forwards", "backwards"])


def participants(g: Graph) -> DataFrame:
    return g.nodes.where(F.startswith("address", F.lit("user/"))).select("address", F.split("address", "/")[1].alias("id"))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x!r}::DOUBLE" if isinstance(x, float) else str(x) for x in r) + ")" for r in rows)


WEEK_SQL = "({0} - ((({0} - 259200000) % 604800000 + 604800000) % 604800000))"
GRAPH_SQL = """
ev AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, user_id, event_type, value, CAST(props->>'k' AS BIGINT) * 2 AS k FROM events),
nodes AS (SELECT DISTINCT 'user/' || user_id || '/' AS address, 'user ' || user_id AS description, NULL::BIGINT AS timestamp_ms FROM ev
  UNION ALL SELECT 'event/' || event_type || '/' || event_id || '/', event_type, ms FROM ev),
edges AS (SELECT 'authors/' || event_type || '/' || event_id || '/' AS address, 'user/' || user_id || '/' AS src, 'event/' || event_type || '/' || event_id || '/' AS dst, ms AS timestamp_ms FROM ev
  UNION ALL SELECT 'mentions/' || event_type || '/' || event_id || '/', 'event/' || event_type || '/' || event_id || '/', 'user/' || k || '/', ms FROM ev),
solid AS (SELECT e.* FROM edges e SEMI JOIN nodes s ON e.src = s.address SEMI JOIN nodes d ON e.dst = d.address)
"""
WEIGHTS_SQL = GRAPH_SQL + f""",
nwt(prefix, weight) AS (VALUES {_values(NODE_WEIGHTS)}),
ewt(prefix, forwards, backwards) AS (VALUES {_values(EDGE_WEIGHTS)}),
nw AS (SELECT n.address, n.timestamp_ms, coalesce(product(weight), 1.0) AS weight FROM nodes n LEFT JOIN nwt ON starts_with(n.address, prefix) GROUP BY ALL),
ew AS (SELECT e.address, e.src, e.dst, e.timestamp_ms, coalesce(product(forwards), 1.0) AS forwards, coalesce(product(backwards), 1.0) AS backwards FROM edges e LEFT JOIN ewt ON starts_with(e.address, prefix) GROUP BY ALL),
sw AS (SELECT w.* FROM ew w SEMI JOIN solid s ON w.address = s.address)
"""
