"""Forums: replies, tags, like weights and liked posts from their mirror tables.

posts (post, topic, index, reply_to_index or null, author), likes (post, author, ms), users (author, trust), topics
(topic, category), tags (topic, tag)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritgraph.functions.addresses import address
from meritgraph.operators import builders
from meritgraph.operators.builders import TRUST
from meritgraph.operators.graph import Graph

#: Kinds of links of a forum, in the order in which they are tried: the first that fits a path names its kind.
LINKS = (("post", r"^/t/[^/]+/(\d+)/(\d+)(?:[?#].*)?$"), ("topic", r"^/t/[^/]+/(\d+)/?(?:[?#].*)?$"), ("user", r"^/u/([^/?#]+)/?(?:[?#].*)?$"))


def _answered() -> Column:
    """The index that a post answers, or null."""
    return F.coalesce("reply_to_index", F.when(F.col("index") > 1, F.lit(1)))


def replies(posts: DataFrame) -> DataFrame:
    """(post, parent): the post of the topic that it answers; posts after the first that name none answer the first."""
    own = posts.select("post", F.col("topic").alias("t"), _answered().alias("i")).where("i IS NOT NULL")
    at = posts.select(F.col("post").alias("parent"), "topic", "index")
    return own.join(at, (F.col("t") == F.col("topic")) & (F.col("i") == F.col("index"))).select("post", "parent")


def with_tags(topics: DataFrame, tags: DataFrame) -> DataFrame:
    """``topics`` with tags, a sorted array, empty where there are none."""
    packed = tags.groupBy(F.col("topic").alias("_t")).agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    return topics.join(packed, F.col("topic") == F.col("_t"), "left").drop("_t").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def _known(weights: dict[str, float], name: Column) -> Column:
    found = F.try_element_at(F.create_map(*(F.lit(x) for kv in sorted(weights.items()) for x in kv)), name) if weights else F.lit(None).cast("double")
    return F.coalesce(found, F.lit(1.0))


def like_weights(likes: DataFrame, users: DataFrame, posts: DataFrame, topics: DataFrame, tags: DataFrame, categories: dict[str, float], tag_weights: dict[str, float], beside: tuple[str, ...] = ()) -> DataFrame:
    """``likes`` with topic, weight and the posts' columns ``beside``: by the trust of who gives it (0 where unknown), times the weight of the topic's
    category and of each of its tags (1 where not set)."""
    trust = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in TRUST.items() for x in kv)), F.col("trust").cast("int")), F.lit(0.0))
    of = F.aggregate("tags", F.lit(1.0), lambda a, t: a * _known(tag_weights, t))
    met = likes.join(users.select("author", "trust"), "author", "left").join(posts.select("post", "topic", *beside), "post").join(with_tags(topics, tags), "topic", "left")
    weight = trust * _known(categories, F.col("category").cast("string")) * F.coalesce(of, F.lit(1.0))
    return met.select(*likes.columns, "topic", *beside, weight.alias("weight"))


def liked_posts(weighed: DataFrame, beside: tuple[str, ...] = ()) -> DataFrame:
    """Edges (address, src, dst, weight, and the posts' columns ``beside``) from topics to their liked posts, by the summed
    weight of the likes; posts whose likes weigh nothing have none."""
    sums = weighed.groupBy("topic", "post").agg(F.sum("weight").alias("weight"), *(F.min(c).alias(c) for c in beside)).where("weight <> 0")
    t, p = address("forum", "topic", F.col("topic")), address("forum", "post", F.col("post"))
    return sums.select(F.concat(F.lit("forum/topicHasLikedPost/"), t, p).alias("address"), t.alias("src"), p.alias("dst"), "weight", *beside)


def links(texts: DataFrame, key: str, html: str, server: str) -> DataFrame:
    """(key, kind, a, b): links of anchors to this server (in any case), by the first kind that fits: a post (topic,
    index), a topic, or a user's decoded name. Others are left out."""
    href = F.regexp_extract_all(F.col(html), F.lit(r"<a\s[^>]*href=\"([^\"]*)\""), F.lit(1))
    rows = texts.select(key, F.explode(href).alias("u")).select(key, F.lower(F.regexp_extract("u", r"^(https?://[^/?#]+)", 1)).alias("s"), F.regexp_replace("u", r"^https?://[^/?#]+", "").alias("p"))
    own = rows.where(F.col("s") == server.lower().rstrip("/"))
    kind = F.coalesce(*(F.when(F.col("p").rlike(x), F.lit(k)) for k, x in LINKS))
    a = F.coalesce(*(F.when(F.col("p").rlike(x), F.regexp_extract("p", x, 1)) for _, x in LINKS))
    found = own.withColumn("kind", kind).where("kind IS NOT NULL")
    return found.select(key, "kind", F.when(F.col("kind") == "user", F.url_decode(a)).otherwise(a).alias("a"), F.when(F.col("kind") == "post", F.regexp_extract("p", LINKS[0][1], 2)).alias("b"))


def existing(found: DataFrame, posts: DataFrame, users: DataFrame) -> DataFrame:
    """``found`` links with address, null where the forum has no such thing; users are found in any case."""
    p = posts.select(F.col("topic").cast("string").alias("pt"), F.col("index").cast("string").alias("pi"), address("forum", "post", F.col("post")).alias("pa"))
    t = posts.select(F.col("topic").cast("string").alias("tt"), address("forum", "topic", F.col("topic")).alias("ta")).distinct()
    u = users.select(F.lower("author").alias("un"), address("forum", "user", F.col("author")).alias("ua")).dropDuplicates(["un"])
    met = found.join(p, (F.col("kind") == "post") & (F.col("a") == F.col("pt")) & (F.col("b") == F.col("pi")), "left")
    met = met.join(t, (F.col("kind") == "topic") & (F.col("a") == F.col("tt")), "left").join(u, (F.col("kind") == "user") & (F.lower("a") == F.col("un")), "left")
    return met.withColumn("address", F.coalesce("pa", "ta", "ua")).select(*found.columns, "address")


def graph(posts: DataFrame, likes: DataFrame, users: DataFrame, topics: DataFrame, tags: DataFrame, categories: dict[str, float], tag_weights: dict[str, float], found: DataFrame | None = None) -> tuple[Graph, DataFrame]:
    """(graph, weights (address, weight)) of a forum: topics and posts with ms besides, topics with author and title.
    Replies name their parents, topics lead to their liked posts at the posts' times, and posts to what they refer to
    (``found``: post, address, as ``existing`` gives them; null and repeated addresses count once or not at all). Weights
    are those of likes, as nodes, and of the edges to liked posts."""
    at = posts.select(F.col("post").alias("parent"), F.col("topic").alias("t"), F.col("index").alias("i"))
    answered = posts.join(at, (F.col("topic") == F.col("t")) & (_answered() == F.col("i")), "left").select(F.col("post").alias("post_id"), F.col("topic").alias("topic_id"), "author", F.col("parent").alias("reply_to"), "ms")
    base = builders.forum(topics.withColumnRenamed("topic", "topic_id"), answered, likes.withColumnRenamed("post", "post_id"))
    times = posts.select("post", "topic", F.col("ms").cast("long").alias("timestamp_ms"))
    weighed = like_weights(likes, users, times, topics.select("topic", "category"), tags, categories, tag_weights, ("timestamp_ms",))
    liked = liked_posts(weighed, ("timestamp_ms",))
    edges = base.edges.unionByName(liked.select("address", "src", "dst", "timestamp_ms"))
    if found is not None:
        own = found.where("address IS NOT NULL").select("post", F.col("address").alias("dst")).join(times.drop("topic"), "post").distinct()
        p = address("forum", "post", F.col("post"))
        edges = edges.unionByName(own.select(F.concat(F.lit("forum/references/"), p, "dst").alias("address"), p.alias("src"), "dst", "timestamp_ms"))
    of_likes = weighed.select(address("forum", "like", F.col("author"), F.col("post")).alias("address"), "weight")
    return Graph(base.nodes, edges), of_likes.unionByName(liked.select("address", "weight"))
