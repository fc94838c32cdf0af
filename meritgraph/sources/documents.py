"""JSON documents of graphs, weights, processes with scores, and views: read into tables and written from them.

In a document an address is an array of parts, or one text with a NUL after its kind (N or E) and after each part; parts
may hold ``/``, which our addresses keep as NUL. Lists name nodes by position: in the sorted addresses of a graph, or in
a process's own nodes followed by its virtual ones (the seed; then for each epoch its sum and every participant's node).
Positions are joined, never looked up in an array; a position that no node has is an error when rows are read.

Programs that share these documents hold each as one string, so a document is some 512 MB at most: one task parses it,
and one task sorts and writes its lines. Graphs of any size are kept as the tables of ``exports.coded``. ``producer`` is
the first word of the documents' types."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meritgraph.functions.addresses import parts
from meritgraph.operators.graph import Graph
from meritgraph.operators.markov import SEED, epoch_node, sum_node
from meritgraph.operators.order import with_index

VERSIONS = {"graph": "0.8.0", "weightedGraph": "0.1.0", "weights": "0.2.0"}  # fixed values of the documents

HEADER = "type string, version string"
GRAPH = "sortedNodeAddresses array<array<string>>, nodes array<struct<index:long,description:string,timestampMs:long>>, edges array<struct<address:array<string>,srcIndex:long,dstIndex:long,timestampMs:long>>"
WEIGHTS = "nodeWeights map<string,double>, edgeWeights map<string,struct<forwards:double,backwards:double>>"
PROCESS = (
    "nodes array<struct<address:string,description:string,mint:double,timestampMs:long>>, participants array<struct<address:string,description:string,id:string>>, epochStarts array<long>, "
    "indexedEdges array<struct<address:string,reversed:boolean,src:long,dst:long,transitionProbability:double>>, indexedMints array<array<double>>"
)
VIEW = (
    "participants array<struct<active:boolean,identity:struct<id:string,name:string,subtype:string>,credPerInterval:array<double>,grainEarnedPerInterval:array<string>>>, "
    "intervals array<struct<startTimeMs:long,endTimeMs:long>>"
)
Lines = list[tuple[str, DataFrame | None]]


def of_parts(p: Column) -> Column:
    """Our address of an array of parts."""
    own = F.transform(p, lambda x: F.concat(F.replace(x, F.lit("/"), F.lit("\0")), F.lit("/")))
    return F.array_join(own, "")


def to_parts(a: Column) -> Column:
    return F.transform(parts(a), lambda x: F.replace(x, F.lit("\0"), F.lit("/")))


def of_text(raw: Column) -> Column:
    """Our address of a text with NULs."""
    split = F.split(raw, "\0")
    return of_parts(F.slice(split, F.lit(2), F.size(split) - 2))


def to_text(a: Column, kind: str) -> Column:
    return F.concat(F.lit(f"{kind}\0"), F.array_join(F.transform(to_parts(a), lambda x: F.concat(x, F.lit("\0"))), ""))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def _checked(found: list, kind: str, producer: str) -> None:
    """``found``: (type, version) of the document's head."""
    if len(found) != 1:
        raise ValueError("the document doesn't say what it is")
    if found[0][0] != f"{producer}/{kind}":
        raise ValueError(f"expected {producer}/{kind}, got {found[0][0]}")
    if found[0][1] != VERSIONS[kind]:
        raise ValueError(f"{found[0][0]}: version {found[0][1]} isn't supported")


def _body(spark: SparkSession, path: str, schema: str, kind: str, producer: str) -> DataFrame:
    """The second of a document's two parts, which are read as two rows."""
    rows = _read(spark, path, f"{HEADER}, {schema}")
    _checked([(r.type, r.version) for r in rows.where("type IS NOT NULL").select("type", "version").limit(2).collect()], kind, producer)
    return rows.where("type IS NULL")


def _named(rows: DataFrame, names: DataFrame, at: str, to: str) -> DataFrame:
    """``rows`` with the address (``to``) in place of the position ``at``."""
    met = rows.join(names.select(F.col("index").alias("_i"), F.col("address").alias("_a")), F.col(at) == F.col("_i"), "left")
    stop = F.raise_error(F.concat(F.lit("no node has position "), F.coalesce(F.col(at).cast("string"), F.lit("null"))))
    return met.withColumn(to, F.coalesce("_a", stop.cast("string"))).drop("_i", "_a", *({at} - {to}))


def _placed(rows: DataFrame, names: DataFrame, address: str, to: str) -> DataFrame:
    """``rows`` with the position ``to`` in place of an address."""
    met = rows.join(names.select(F.col("index").alias("_i"), F.col("address").alias("_a")), F.col(address) == F.col("_a"), "left")
    stop = F.raise_error(F.concat(F.lit("no such node: "), F.coalesce(address, F.lit("null"))))
    return met.withColumn(to, F.coalesce("_i", stop.cast("long"))).drop("_i", "_a", *({address} - {to}))


def _graph(rows: DataFrame) -> Graph:
    names = rows.select(F.posexplode("sortedNodeAddresses").alias("index", "_k")).select("index", of_parts(F.col("_k")).alias("address"))
    n = _named(rows.select(F.inline("nodes")), names, "index", "address")
    e = rows.select(F.inline("edges")).withColumn("address", of_parts(F.col("address")))
    e = _named(_named(e, names, "srcIndex", "src"), names, "dstIndex", "dst")
    return Graph(n.select("address", "description", F.col("timestampMs").alias("timestamp_ms")), e.select("address", "src", "dst", F.col("timestampMs").alias("timestamp_ms")))


def _weights(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    n = rows.select(F.explode("nodeWeights").alias("_k", "weight")).select(of_text(F.col("_k")).alias("prefix"), "weight")
    e = rows.select(F.explode("edgeWeights").alias("_k", "_w")).select(of_text(F.col("_k")).alias("prefix"), "_w.forwards", "_w.backwards")
    return n, e


def read_graph(spark: SparkSession, path: str, producer: str) -> Graph:
    return _graph(_body(spark, path, GRAPH, "graph", producer))


def read_weights(spark: SparkSession, path: str, producer: str) -> tuple[DataFrame, DataFrame]:
    """(node_weights, edge_weights) as in ``weights``."""
    return _weights(_body(spark, path, WEIGHTS, "weights", producer))


def read_weighted_graph(spark: SparkSession, path: str, producer: str) -> tuple[Graph, DataFrame, DataFrame]:
    both = {"graphJSON": ("graph", GRAPH), "weightsJSON": ("weights", WEIGHTS)}
    inner = ", ".join(f"{c} array<struct<{HEADER}, {s}>>" for c, (_, s) in both.items())
    body, parts_ = _body(spark, path, inner, "weightedGraph", producer), []
    for c, (kind, _) in both.items():
        rows = body.select(F.inline(c))
        _checked([(r.type, r.version) for r in rows.where("type IS NOT NULL").select("type", "version").limit(2).collect()], kind, producer)
        parts_.append(rows.where("type IS NULL"))
    return _graph(parts_[0]), *_weights(parts_[1])


@dataclass(frozen=True)
class Process:
    """nodes (address, description, mint, timestamp_ms), edges (address, reversed, src, dst, pr), participants (address, description,
    id), epochs (start_ms), mints (address, pr): the seed's moves, and scores (address, score), or None. Virtual nodes
    have the addresses that ``markov`` gives them."""

    nodes: DataFrame
    edges: DataFrame
    participants: DataFrame
    epochs: DataFrame
    mints: DataFrame
    scores: DataFrame | None = None


def node_order(nodes: DataFrame, participants: DataFrame, epochs: DataFrame) -> DataFrame:
    """(address, index) of all nodes of a process. nodes (address, index) and participants (id, index) have positions from
    0; epochs (start_ms) are as many as there are weeks, and the driver sees them."""
    n, p = nodes.count(), participants.count()
    starts = sorted(r.start_ms for r in epochs.select("start_ms").collect())
    base = lambda e: F.lit(n + 1) + e * F.lit(p + 1)  # noqa: E731  position of an epoch's sum
    seed = nodes.sparkSession.range(1).select(F.lit(SEED).alias("address"), F.lit(n).cast("long").alias("index"))
    weeks = F.posexplode(F.array(*map(F.lit, starts)).cast("array<long>")).alias("_e", "_s")
    sums = nodes.sparkSession.range(1).select(weeks).select(sum_node(F.col("_s")).alias("address"), base(F.col("_e")).cast("long").alias("index"))
    grid = participants.select("id", F.col("index").alias("_j"), weeks)
    grid = grid.select(epoch_node(F.col("_s"), F.replace("id", F.lit("/"), F.lit("\0"))).alias("address"), (base(F.col("_e")) + 1 + F.col("_j")).cast("long").alias("index"))
    return nodes.select("address", F.col("index").cast("long")).unionByName(seed).unionByName(sums).unionByName(grid)


def _process(body: DataFrame, scores: DataFrame | None) -> Process:
    at = lambda c, *names: body.select(F.posexplode(c).alias("index", "_x")).select("index", *(F.col(f"_x.{x}") for x in names))
    nodes = at("nodes", "address", "description", "mint", "timestampMs").withColumn("address", of_text(F.col("address"))).withColumnRenamed("timestampMs", "timestamp_ms")
    people = at("participants", "address", "description", "id").withColumn("address", of_text(F.col("address")))
    epochs = body.select(F.explode("epochStarts").alias("start_ms"))
    order = node_order(nodes, people, epochs)
    e = body.select(F.inline("indexedEdges")).withColumn("address", of_text(F.col("address")))
    e = _named(_named(e, order, "src", "src"), order, "dst", "dst")
    mints = body.select(F.explode("indexedMints").alias("_m")).select(F.col("_m")[0].cast("long").alias("index"), F.col("_m")[1].alias("pr"))
    named = _named(scores, order, "index", "address").select("address", "score") if scores is not None else None
    return Process(nodes.drop("index"), e.select("address", "reversed", "src", "dst", F.col("transitionProbability").alias("pr")), people.drop("index"), epochs, _named(mints, order, "index", "address").select("address", "pr"), named)


def read_process(spark: SparkSession, path: str) -> Process:
    """A process; its epochs have to be in ascending order, as they are written."""
    return _process(_read(spark, path, PROCESS), None)


def read_scored(spark: SparkSession, path: str) -> Process:
    """A process with scores, which stand in the order of its nodes."""
    rows = _read(spark, path, f"mpg struct<{PROCESS}>, scores array<double>")
    return _process(rows.select("mpg.*"), rows.select(F.posexplode("scores").alias("index", "score")))


def read_view(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(view, identities): the long form of ``views``, and (id, name, subtype, active). A participant whose lists aren't as
    long as that of the intervals is an error."""
    rows = _read(spark, path, VIEW)
    people = rows.select(F.size("intervals").alias("_n"), F.inline("participants"))
    weeks = rows.select(F.posexplode("intervals").alias("_k", "_w")).select("_k", F.col("_w.startTimeMs").alias("start_ms"), F.col("_w.endTimeMs").alias("end_ms"))
    fits = (F.size("credPerInterval") == F.col("_n")) & (F.size("grainEarnedPerInterval") == F.col("_n"))
    cred = F.when(fits, F.col("credPerInterval")).otherwise(F.raise_error(F.concat(F.lit("lists of another length than the intervals: "), F.col("identity.id"))).cast("array<double>"))
    each = people.select(F.col("identity.id").alias("id"), F.posexplode(F.arrays_zip(cred.alias("s"), F.col("grainEarnedPerInterval").alias("e"))).alias("_k", "_v"))
    long = each.join(weeks, "_k").select("id", "start_ms", "end_ms", F.col("_v.s").alias("score"), F.col("_v.e").cast("decimal(38,0)").alias("earned"))
    return long, people.select("identity.*", "active")


# Documents are written as lines (section, at, value), which in this order are one document.


def _json(*columns: Column) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _member(key: Column, value: Column) -> Column:
    """``"key":value``, without braces."""
    text = F.to_json(F.create_map(key, value))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def _lines(spark: SparkSession, sections: Lines) -> DataFrame:
    """Texts, and rows (at from 0, value) whose values are parted by commas."""
    out = []
    for i, (text, rows) in enumerate(sections):
        out.append(spark.range(1).select(F.lit(2 * i).alias("section"), F.lit(0).cast("long").alias("at"), F.lit(text).alias("value")))
        if rows is not None:
            out.append(rows.select(F.lit(2 * i + 1).alias("section"), "at", F.concat(F.when(F.col("at") > 0, ",").otherwise(""), "value").alias("value")))
    return reduce(DataFrame.unionByName, out)


def _head(kind: str, producer: str) -> str:
    return f'[{{"type":"{producer}/{kind}","version":"{VERSIONS[kind]}"}},'


def _graph_sections(g: Graph) -> Lines:
    every = g.nodes.select("address").union(g.edges.select("src")).union(g.edges.select("dst")).distinct()
    names = with_index(every.withColumn("_k", to_parts(F.col("address"))), "_k")
    e = with_index(_placed(_placed(g.edges, names, "src", "srcIndex"), names, "dst", "dstIndex").withColumn("_k", to_parts(F.col("address"))), "_k", "at")
    n = with_index(_placed(g.nodes, names, "address", "index"), "index", "at")
    ms = F.col("timestamp_ms").alias("timestampMs")
    return [
        ('{"edges":[', e.select("at", _json(F.col("_k").alias("address"), F.col("dstIndex"), F.col("srcIndex"), ms).alias("value"))),
        ('],"nodes":[', n.select("at", _json(F.col("description"), F.col("index"), ms).alias("value"))),
        ('],"sortedNodeAddresses":[', names.select(F.col("index").alias("at"), F.to_json("_k").alias("value"))),
        ("]}", None),
    ]


def _weight_sections(node_weights: DataFrame, edge_weights: DataFrame) -> Lines:
    e = with_index(edge_weights.withColumn("_k", to_text(F.col("prefix"), "E")), "_k", "at")
    n = with_index(node_weights.withColumn("_k", to_text(F.col("prefix"), "N")), "_k", "at")
    return [
        ('{"edgeWeights":{', e.select("at", _member(F.col("_k"), F.struct("backwards", "forwards")).alias("value"))),
        ('},"nodeWeights":{', n.select("at", _member(F.col("_k"), F.col("weight")).alias("value"))),
        ("}}", None),
    ]


def graph_lines(g: Graph, producer: str) -> DataFrame:
    """Every address that is a node or an end of an edge has its position among the sorted ones; edges may dangle."""
    return _lines(g.nodes.sparkSession, [(_head("graph", producer), None), *_graph_sections(g), ("]", None)])


def weight_lines(node_weights: DataFrame, edge_weights: DataFrame, producer: str) -> DataFrame:
    return _lines(node_weights.sparkSession, [(_head("weights", producer), None), *_weight_sections(node_weights, edge_weights), ("]", None)])


def weighted_graph_lines(g: Graph, node_weights: DataFrame, edge_weights: DataFrame, producer: str) -> DataFrame:
    own, more = _graph_sections(g), _weight_sections(node_weights, edge_weights)
    sections = [(_head("weightedGraph", producer) + '{"graphJSON":' + _head("graph", producer), None), *own, ('],"weightsJSON":' + _head("weights", producer), None), *more, ("]}]", None)]
    return _lines(g.nodes.sparkSession, sections)


def _process_sections(x: Process) -> tuple[Lines, DataFrame]:
    """The members of a process but for its parameters; and the order of its nodes."""
    nodes = with_index(x.nodes.withColumn("_k", to_parts(F.col("address"))), "_k")
    people = with_index(x.participants, "id")
    order = node_order(nodes, people, x.epochs)
    e = _placed(_placed(x.edges, order, "src", "src"), order, "dst", "dst").withColumn("_k", F.struct(to_parts(F.col("address")).alias("a"), F.col("reversed").alias("r")))
    e, m = with_index(e, "_k", "at"), with_index(_placed(x.mints, order, "address", "index"), "index", "at")
    own = to_text(F.col("address"), "N").alias("address")
    weeks = with_index(x.epochs.select("start_ms"), "start_ms", "at")
    return [
        ('{"epochStarts":[', weeks.select("at", F.col("start_ms").cast("string").alias("value"))),
        ('],"indexedEdges":[', e.select("at", _json(to_text(F.col("address"), "E").alias("address"), F.col("dst"), F.col("reversed"), F.col("src"), F.col("pr").alias("transitionProbability")).alias("value"))),
        ('],"indexedMints":[', m.select("at", F.concat(F.lit("["), F.col("index").cast("string"), F.lit(","), F.col("pr").cast("string"), F.lit("]")).alias("value"))),
        ('],"nodes":[', nodes.select(F.col("index").alias("at"), _json(own, F.col("description"), F.col("mint"), F.col("timestamp_ms").alias("timestampMs")).alias("value"))),
        ('],"participants":[', people.select(F.col("index").alias("at"), _json(own, F.col("description"), F.col("id")).alias("value"))),
    ], order


def scored_lines(x: Process, parameters: str, last_ms: int) -> DataFrame:
    """A process with its scores, by position. ``parameters``: the process's parameters as a JSON object. A node without
    a score has 0."""
    sections, order = _process_sections(x)
    scores = order.join(x.scores, "address", "left").select(F.col("index").alias("at"), F.coalesce("score", F.lit(0.0)).cast("string").alias("value"))
    tail = f'],"lastEpochEndMs":{last_ms},"parameters":{parameters},"personalAttributions":[]}},"scores":['
    (first, rows), *rest = sections
    return _lines(order.sparkSession, [('{"mpg":' + first, rows), *rest, (tail, scores), ("]}", None)])


def write(lines: DataFrame, path: str) -> None:
    """A folder with one file that is the document."""
    lines.repartition(1).sortWithinPartitions("section", "at").select("value").write.mode("overwrite").text(path)
