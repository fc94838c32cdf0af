"""Rows of forums, chats and repositories as nodes, edges and weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritgraph.functions.addresses import address
from meritgraph.operators.graph import Graph

#: The weight of a like by the trust level of who gives it.
TRUST = {0: 0.0, 1: 0.1, 2: 1.0, 3: 1.25, 4: 1.5}
#: Node and edge weights (forwards, backwards) of the types of each kind of source.
REPOSITORY_NODES = {"repo": 0.0, "issue": 0.0, "pull": 4.0, "review": 1.0, "comment": 0.0, "commit": 0.0, "user": 0.0, "bot": 0.0}
REPOSITORY_EDGES = {"authors": (0.5, 1.0), "hasParent": (1.0, 0.25), "mergedAs": (0.5, 1.0), "references": (1.0, 0.0), "heart": (2.0, 0.0), "thumbsUp": (1.0, 0.0), "hooray": (4.0, 0.0), "rocket": (1.0, 0.0), "correspondsToCommit": (1.0, 1.0)}
FORUM_EDGES = {"topicContainsPost": (0.125, 1.0), "topicHasLikedPost": (1.0, 0.0), "replyTo": (1.0, 0.0), "authorsTopic": (0.0, 0.0), "authorsPost": (0.25, 1.0), "createsLike": (1.0, 0.0), "likes": (1.0, 0.0), "references": (0.5, 0.0)}
CHAT_EDGES = {"authors": (0.25, 1.0), "addsReaction": (1.0, 0.0625), "reactsTo": (1.0, 0.0625), "mentions": (1.0, 0.0625), "props": (19.0, 0.0625)}


def weight_table(spark, source: str, edges: dict[str, tuple[float, float]]) -> DataFrame:
    return spark.createDataFrame([(f"{source}/{k}/", f, b) for k, (f, b) in edges.items()], "prefix string, forwards double, backwards double")


def edge(kind: Column, key: Column, src: Column, dst: Column, ms: Column) -> Column:
    return F.struct(F.concat(kind, key).alias("address"), src.alias("src"), dst.alias("dst"), ms.cast("long").alias("timestamp_ms"))


def forum(topics: DataFrame, posts: DataFrame, likes: DataFrame) -> Graph:
    """topics (topic_id, author, title, ms), posts (post_id, topic_id, author, reply_to, ms), likes (post_id, author,
    ms). Authors become nodes without a time."""
    user = lambda c: address("forum", "user", F.col(c))
    topic, post, like = address("forum", "topic", F.col("topic_id")), address("forum", "post", F.col("post_id")), address("forum", "like", F.col("author"), F.col("post_id"))
    people = reduce(DataFrame.union, (x.select("author") for x in (topics, posts, likes))).distinct()
    node = lambda df, a, d, ms: df.select(a.alias("address"), d.cast("string").alias("description"), ms.cast("long").alias("timestamp_ms"))
    nodes = node(topics, topic, F.col("title"), F.col("ms")).union(node(posts, post, F.lit("post"), F.col("ms"))).union(node(likes, like, F.lit("like"), F.col("ms"))).union(node(people, user("author"), F.col("author"), F.lit(None)))
    kind = lambda k: F.lit(f"forum/{k}/")
    ms = F.col("ms")
    of_topic = topics.select(edge(kind("authorsTopic"), topic, user("author"), topic, ms).alias("e"))
    parent = F.when(F.col("reply_to").isNotNull(), edge(kind("replyTo"), post, post, address("forum", "post", F.col("reply_to")), ms))
    of_post = posts.select(F.explode(F.array_compact(F.array(edge(kind("authorsPost"), post, user("author"), post, ms), edge(kind("topicContainsPost"), post, topic, post, ms), parent))).alias("e"))
    of_like = likes.select(F.explode(F.array(edge(kind("createsLike"), like, user("author"), like, ms), edge(kind("likes"), like, like, post, ms))).alias("e"))
    return Graph(nodes, of_topic.union(of_post).union(of_like).select("e.*"))


def like_weights(likes: DataFrame, factors: list[str], trust: str = "trust") -> DataFrame:
    """``likes`` with weight: by trust (0 where unknown), times all other factors (1 where null)."""
    known = F.create_map(*(F.lit(x) for kv in TRUST.items() for x in kv))
    weight = F.coalesce(F.try_element_at(known, F.col(trust)), F.lit(0.0))
    for f in factors:
        weight = weight * F.coalesce(F.col(f), F.lit(1.0))
    return likes.withColumn("weight", weight)


def liked_posts(likes: DataFrame) -> DataFrame:
    """(post, n_likes, weight) over likes that weigh anything."""
    return likes.groupBy("post").agg(F.count_if(F.col("weight") != 0).alias("n_likes"), F.sum("weight").alias("weight"))


def reaction_weights(reactions: DataFrame, emoji: DataFrame, default: float, dampener: float = 0.0, averaging: bool = True, props: str | None = None) -> DataFrame:
    """``reactions`` (message, author, reacter, emoji) with weight: the emoji's, over the number of people other than
    the author who reacted (plus a dampener; undivided where that is 0); a reaction to one's own message weighs nothing
    outside of channels flagged by ``props``."""
    others = reactions.where("reacter <> author").select("message", "reacter").distinct().groupBy("message").agg(F.count(F.lit(1)).alias("_d"))
    met = reactions.join(F.broadcast(emoji), "emoji", "left").join(others, "message", "left")  # emoji weights are configuration
    over = F.coalesce("_d", F.lit(0)) + F.lit(dampener)
    weight = F.coalesce("weight", F.lit(default)) / (F.when(over == 0, 1.0).otherwise(over) if averaging else F.lit(1.0))
    own = F.col("reacter") == F.col("author")
    if props:
        own &= ~F.col(props)
    return met.withColumn("weight", F.when(own, 0.0).otherwise(weight)).drop("_d")


def commit_graph(commits: DataFrame) -> Graph:
    """From (hash, summary, created_ms, parents)."""
    a = address("git", "commit", F.col("hash"))
    nodes = commits.select(a.alias("address"), F.col("summary").alias("description"), F.col("created_ms").alias("timestamp_ms"))
    up = commits.select(a.alias("src"), "hash", F.explode("parents").alias("p"), "created_ms")
    return Graph(nodes, up.select(address("git", "hasParent", F.col("hash"), F.col("p")).alias("address"), "src", address("git", "commit", F.col("p")).alias("dst"), F.col("created_ms").alias("timestamp_ms")))


def coerced_name(text: Column) -> Column:
    """Letters, digits and hyphens only, at most 42."""
    return F.substring(F.regexp_replace(text, "[^A-Za-z0-9-]", "-"), 1, 42)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
