"""Initiatives as contribution graphs.

initiatives (id, title, ms, completed, incomplete, complete: weights or null), links (id, field, url) with a field of
DEPENDENCY, REFERENCE, CONTRIBUTION or CHAMPION, entries (id, field, key, title, ms or null, weight or null),
contributors (id, field, key, url). dictionary (url, address) says which node a URL names; URLs that name none are left
out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritgraph.functions.addresses import address
from meritgraph.operators.builders import slug
from meritgraph.operators.graph import Graph

#: The edge of each field, and whether it leads away from the initiative.
FIELDS = {"DEPENDENCY": ("dependsOn", True), "REFERENCE": ("references", True), "CONTRIBUTION": ("contributesTo", False), "CHAMPION": ("champions", False)}


def normalised(entries: DataFrame, initiatives: DataFrame) -> DataFrame:
    """Entries with a key (a slug of the title where none is given) and a time (the initiative's where none is given);
    two entries of a field with one key are an error when rows are read."""
    own = entries.withColumn("key", F.coalesce("key", slug(F.col("title"))))
    n = own.groupBy("id", "field", "key").agg(F.count(F.lit(1)).alias("_n")).withColumnsRenamed({"id": "_i", "field": "_f", "key": "_k"})
    met = own.join(n, (F.col("id") == F.col("_i")) & (F.col("field") == F.col("_f")) & (F.col("key") == F.col("_k")))
    once = F.when(F.col("_n") == 1, F.col("key")).otherwise(F.raise_error(F.concat(F.lit("two entries with the key "), "key")).cast("string"))
    times = initiatives.select(F.col("id").alias("_i"), F.col("ms").alias("_ms"))
    return met.withColumn("key", once).drop("_n", "_i", "_f", "_k").join(times, F.col("id") == F.col("_i")).withColumn("ms", F.coalesce("ms", "_ms")).drop("_i", "_ms")


def graph(initiatives: DataFrame, links: DataFrame, entries: DataFrame, contributors: DataFrame, dictionary: DataFrame) -> tuple[Graph, DataFrame]:
    """(graph, node weights (prefix, weight)): an initiative weighs what its state says, an entry what it says itself."""
    a = lambda c: address("initiatives", "initiative", F.col(c))
    known = dictionary.dropDuplicates(["url"]).withColumnRenamed("address", "other")
    entries = normalised(entries, initiatives).withColumn("node", address("initiatives", "entry", F.col("field"), F.col("id"), F.col("key")))
    times = initiatives.select(F.col("id").alias("_i"), F.col("ms").alias("own_ms"))
    ends = links.join(known, "url").select("id", "field", "other").union(entries.select("id", "field", F.col("node")))
    ends = ends.join(times, F.col("id") == F.col("_i")).withColumn("own", a("id"))
    pick = lambda i: F.create_map(*(F.lit(x) for k, v in FIELDS.items() for x in (k, v[i])))[F.col("field")]
    edge = lambda src, dst: [src.alias("src"), dst.alias("dst")]
    out = F.col("out")
    ends = ends.withColumn("kind", pick(0)).withColumn("out", pick(1)).where("kind IS NOT NULL")
    edges = ends.select(F.concat(F.lit("initiatives/"), "kind", F.lit("/"), "own", "other").alias("address"), *edge(F.when(out, F.col("own")).otherwise(F.col("other")), F.when(out, F.col("other")).otherwise(F.col("own"))), F.col("own_ms").cast("long").alias("timestamp_ms"))
    by = contributors.join(known, "url").join(entries.select("id", "field", "key", "node", "ms"), ["id", "field", "key"])
    edges = edges.union(by.select(F.concat(F.lit("initiatives/contributesToEntry/"), "node", "other").alias("address"), *edge(F.col("other"), F.col("node")), F.col("ms").cast("long").alias("timestamp_ms")))
    nodes = initiatives.select(a("id").alias("address"), F.col("title").alias("description"), F.col("ms").cast("long").alias("timestamp_ms")).union(entries.select("node", "title", F.col("ms").cast("long")))
    state: Column = F.when(F.col("completed"), F.col("complete")).otherwise(F.col("incomplete"))
    weights = initiatives.select(a("id").alias("prefix"), state.alias("weight")).where("weight IS NOT NULL AND weight <> 0").union(entries.where("weight IS NOT NULL").select("node", "weight"))
    return Graph(nodes, edges.dropDuplicates(["address"])), weights


def read(spark, folder: str) -> DataFrame:
    """(name, initiative struct) of a folder of JSON files, one initiative each; a file that doesn't parse is an error."""
    entry = "struct<key:string,title:string,timestampIso:string,weight:double,contributors:array<string>>"
    spec = f"struct<urls:array<string>,entries:array<{entry}>>"
    schema = f"title string, timestampIso string, weight struct<incomplete:double,complete:double>, completed boolean, champions array<string>, dependencies {spec}, references {spec}, contributions {spec}"
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(f"{folder}/*.json")
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("name"), F.struct(*rows.columns).alias("initiative"))


def tables(read_rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(initiatives, links, entries, contributors) of what ``read`` gives; ids are file names."""
    i = lambda c: F.col(f"initiative.{c}")
    ms = lambda c: (F.to_timestamp(c).cast("double") * 1000).cast("long")
    first = read_rows.select(F.col("name").alias("id"), i("title").alias("title"), ms(i("timestampIso")).alias("ms"), F.coalesce(i("completed"), F.lit(False)).alias("completed"), i("weight.incomplete").alias("incomplete"), i("weight.complete").alias("complete"))
    fields = {"DEPENDENCY": "dependencies", "REFERENCE": "references", "CONTRIBUTION": "contributions"}
    each = F.array(*(F.struct(F.lit(k).alias("field"), i(f"{v}.urls").alias("urls"), i(f"{v}.entries").alias("entries")) for k, v in fields.items()))
    flat = read_rows.select(F.col("name").alias("id"), F.inline(each))
    links = flat.select("id", "field", F.explode("urls").alias("url")).union(read_rows.select("name", F.lit("CHAMPION"), F.explode(i("champions"))))
    entries = flat.select("id", "field", F.explode("entries").alias("e"))
    rows = entries.select("id", "field", F.coalesce("e.key", slug(F.col("e.title"))).alias("key"), F.col("e.title").alias("title"), ms(F.col("e.timestampIso")).alias("ms"), F.col("e.weight").alias("weight"))
    return first, links, rows, entries.select("id", "field", F.coalesce("e.key", slug(F.col("e.title"))).alias("key"), F.explode("e.contributors").alias("url"))
