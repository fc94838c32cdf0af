"""Repositories as contribution graphs and as contributions.

entities (kind, key, parent, author, description, ms, merged_as, hash): repo, issue, pull, review, comment and commit
with the address of their parent, the login of their author, the commit that merged a pull (an address, else null), and
a commit's hash. reactions (target, kind, author, ms), references (src, dst, ms) name entities by address.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritgraph.functions.addresses import address
from meritgraph.operators.builders import REPOSITORY_EDGES, REPOSITORY_NODES
from meritgraph.operators.graph import Graph

#: The reactions that are taken for praise, and the edges they become.
POSITIVE = {"THUMBS_UP": "thumbsUp", "HEART": "heart", "HOORAY": "hooray", "ROCKET": "rocket"}


def entity(kind: Column | str, key: Column | str) -> Column:
    return F.concat(F.lit("repository/"), F.lit(kind) if isinstance(kind, str) else kind, F.lit("/"), F.col(key) if isinstance(key, str) else key, F.lit("/"))


def user(login: str, bots: list[str]) -> Column:
    kind = F.when(F.col(login).isin(bots), "bot").otherwise("user") if bots else F.lit("user")
    return F.concat(F.lit("repository/"), kind, F.lit("/"), F.col(login), F.lit("/"))


def graph(entities: DataFrame, reactions: DataFrame, references: DataFrame, bots: list[str] | None = None) -> tuple[Graph, DataFrame]:
    """(graph, node weights (prefix, weight)): pulls that were never merged weigh nothing. Only positive reactions
    become edges; equal edges are one, of the first time."""
    bots = bots or []
    own = entities.withColumn("a", entity(F.col("kind"), "key"))
    authored = own.where("author IS NOT NULL")
    praise = F.create_map(*(F.lit(x) for kv in POSITIVE.items() for x in kv))
    liked = reactions.withColumn("k", F.try_element_at(praise, F.col("kind"))).where("k IS NOT NULL AND author IS NOT NULL")
    people = authored.select("author").union(liked.select("author")).distinct()
    nodes = own.select(F.col("a").alias("address"), F.col("description"), F.col("ms").cast("long").alias("timestamp_ms")).union(people.select(user("author", bots), F.col("author"), F.lit(None).cast("long")))
    who = user("author", bots)

    def edge(rows: DataFrame, kind: Column, src: Column, dst: Column) -> DataFrame:
        return rows.select(kind.alias("k"), src.alias("src"), dst.alias("dst"), F.col("ms").cast("long").alias("timestamp_ms"))

    a, of = F.col("a"), F.lit
    found = edge(authored, of("authors"), who, a)
    found = found.union(edge(own.where("kind IN ('issue', 'pull', 'review', 'comment') AND parent IS NOT NULL"), of("hasParent"), a, F.col("parent")))
    found = found.union(edge(own.where("kind = 'pull' AND merged_as IS NOT NULL"), of("mergedAs"), a, F.col("merged_as")))
    found = found.union(edge(own.where("kind = 'commit' AND hash IS NOT NULL"), of("correspondsToCommit"), a, address("git", "commit", F.col("hash"))))
    found = found.union(edge(references, of("references"), F.col("src"), F.col("dst")))
    found = found.union(edge(liked, F.col("k"), who, F.col("target")))
    # few are equal, so they meet before any are summed, in a fixed number of parts: no task keeps the edges of a whole split
    dealt_out = found.repartition(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), "src", "dst")
    edges = dealt_out.groupBy("k", "src", "dst").agg(F.min("timestamp_ms").alias("timestamp_ms"))
    edges = edges.select(F.concat(F.lit("repository/"), "k", F.lit("/"), "src", "dst").alias("address"), "src", "dst", "timestamp_ms")
    unmerged = own.where("kind = 'pull' AND merged_as IS NULL").select(F.col("a").alias("prefix"), F.lit(0.0).alias("weight"))
    return Graph(nodes, edges), unmerged


def default_weights(spark) -> tuple[DataFrame, DataFrame]:
    """(prefix, weight) and (prefix, forwards, backwards) of the types."""
    n = spark.createDataFrame([(f"repository/{k}/", w) for k, w in REPOSITORY_NODES.items()], "prefix string, weight double")
    return n, spark.createDataFrame([(f"repository/{k}/", f, b) for k, (f, b) in REPOSITORY_EDGES.items()], "prefix string, forwards double, backwards double")


def contributions(entities: DataFrame, reactions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(expressions, operands, shares) of merged pulls and of their reviews, as ``expressions`` scores them: the
    repository's weight plus reactions by others than the authors (a review's: those to its comments). Times are those of
    the merge and of the review. shares (contribution, participant, key, subkey, ord). A pull's or review's repository is
    its key up to the last ``/``."""
    own = entities.withColumn("a", entity(F.col("kind"), "key"))
    commits = own.where("kind = 'commit'").select(F.col("a").alias("merged_as"), F.col("author").alias("committer"), F.col("ms").alias("merged_ms"))
    pulls = own.where("kind = 'pull'").join(commits, "merged_as").withColumn("repo", F.regexp_replace("key", "/[^/]*$", ""))
    reviews = own.where("kind = 'review'").join(pulls.select(F.col("a").alias("parent"), F.col("repo")), "parent")
    comments = own.where("kind = 'comment'").select(F.col("a").alias("target"), F.col("parent").alias("of"))
    r = reactions.select("target", F.col("kind").alias("subkey"), F.col("author").alias("by"))
    to_pulls = pulls.select("a", "author").join(r.withColumnRenamed("target", "a"), "a")
    to_reviews = reviews.select("a", "author").join(r.join(comments, "target").withColumnRenamed("of", "a"), "a")
    others = ~F.col("by").eqNullSafe(F.col("author"))
    both = pulls.select("a", "repo", F.lit("pull").alias("key"), F.col("merged_ms").alias("timestamp_ms")).union(reviews.select("a", "repo", F.lit("review"), "ms"))
    row = lambda p, op: F.struct(F.lit(p).alias("path"), F.lit(op).alias("operator"))
    expressions = both.select(F.col("a").alias("contribution"), "timestamp_ms", F.inline(F.array(row("0", "ADD"), row("0.0", "key:reactions"))))
    operands = both.select(F.col("a").alias("contribution"), F.lit("0").alias("path"), F.lit(0).alias("ord"), "key", F.col("repo").alias("subkey"))
    praised = to_pulls.where(others).select("a", "subkey").union(to_reviews.where(others).select("a", "subkey"))
    operands = operands.union(praised.select("a", F.lit("0.0"), F.lit(0), F.lit("reaction"), "subkey"))
    share = lambda rows, who, key, o: rows.where(F.col(who).isNotNull()).select(F.col("a").alias("contribution"), F.col(who).alias("participant"), F.lit(key).alias("key"), F.col("repo").alias("subkey"), F.lit(o).alias("ord"))
    shares = share(pulls, "author", "pullAuthor", 0).union(share(pulls, "committer", "commitAuthor", 1)).union(share(reviews, "author", "pullAuthor", 0))
    return expressions, operands, shares
