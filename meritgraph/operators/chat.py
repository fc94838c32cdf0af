"""Chats as contribution graphs and as contributions.

messages (channel, message, author, non_user, ms), reactions (message, reacter, emoji), mentions (message, member, n),
members (member, name, roles array<string>), channels (channel, parent). Weights of roles, channels and emoji are
configuration: (name, weight) tables with a default beside them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meritgraph.functions.addresses import address
from meritgraph.operators.graph import Graph


@dataclass(frozen=True)
class Weights:
    roles: dict[str, float] = field(default_factory=dict)
    channels: dict[str, float] = field(default_factory=dict)
    emoji: dict[str, float] = field(default_factory=dict)
    role_default: float = 1.0
    channel_default: float = 1.0
    emoji_default: float = 1.0
    averaging: bool = False
    dampener: float = 0.0
    #: Channels in which praise of others is the point: reactions to one's own message count, mentions are props.
    props: tuple[str, ...] = ()


def _lookup(known: dict[str, float], name: Column) -> Column:
    """Null where the name has no weight of its own."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in sorted(known.items()) for x in kv)), name) if known else F.lit(None).cast("double")


def loadable(channels: DataFrame, weights: Weights, nsfw: bool = False) -> DataFrame:
    """Text channels that weigh something; marked ones only with ``nsfw``. channels (channel, parent, type, nsfw)."""
    kept = channels.where((F.col("type") == "GUILD_TEXT") & (channel_weight(weights) != 0))
    return kept if nsfw else kept.where(~F.col("nsfw"))


def channel_weight(weights: Weights) -> Column:
    """A channel's own weight, else its parent's, else the default."""
    return F.coalesce(_lookup(weights.channels, F.col("channel")), _lookup(weights.channels, F.col("parent")), F.lit(weights.channel_default))


def role_weight(weights: Weights, roles: str = "roles") -> Column:
    """The greatest of the default and the weights of a member's roles."""
    own = F.transform(F.coalesce(F.col(roles), F.array().cast("array<string>")), lambda r: F.coalesce(_lookup(weights.roles, r), F.lit(weights.role_default)))
    return F.greatest(F.lit(weights.role_default), F.coalesce(F.array_max(own), F.lit(weights.role_default)))


def counted(messages: DataFrame, reactions: DataFrame, mentions: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What counts: reactions and mentions of people who are still members, and users' messages that have any."""
    there = members.select(F.col("member").alias("_m"))
    r = reactions.join(there, F.col("reacter") == F.col("_m"), "left_semi")
    n = mentions.join(there, F.col("member") == F.col("_m"), "left_semi")
    answered = r.select(F.col("message").alias("_m")).union(n.select("message")).distinct()
    return messages.where(~F.col("non_user")).join(answered, F.col("message") == F.col("_m"), "left_semi"), r, n


def reaction_weights(messages: DataFrame, reactions: DataFrame, members: DataFrame, weights: Weights) -> DataFrame:
    """``reactions`` with author, channel, parent, ms and weight: role x channel x emoji, with averaging over the summed
    role weights of the other people who reacted to the message (plus the dampener; undivided where that is 0). A reaction to one's own message
    weighs nothing outside of props channels. messages carry parent."""
    met = reactions.join(messages.select("message", "author", "channel", "parent", "ms"), "message")
    met = met.join(members.select(F.col("member").alias("reacter"), role_weight(weights).alias("_role")), "reacter")
    own = (F.col("reacter") == F.col("author")) & ~F.col("channel").isin(list(weights.props))
    weight = F.col("_role") * channel_weight(weights) * F.coalesce(_lookup(weights.emoji, F.col("emoji")), F.lit(weights.emoji_default))
    if weights.averaging:
        people = met.where(~F.col("reacter").eqNullSafe(F.col("author"))).groupBy("message", "reacter").agg(F.max("_role").alias("_role"))
        over = people.groupBy("message").agg(F.sum("_role").alias("_over"))
        met = met.join(over, "message", "left")
        total = F.coalesce("_over", F.lit(0.0)) + F.lit(weights.dampener)
        weight = weight * F.when(total == 0, 1.0).otherwise(1 / total)
    return met.withColumn("weight", F.when(own, 0.0).otherwise(weight)).drop("_role", *(["_over"] if weights.averaging else []))


def graph(messages: DataFrame, reactions: DataFrame, mentions: DataFrame, members: DataFrame, weights: Weights, simple: bool = False) -> tuple[Graph, DataFrame, DataFrame]:
    """(graph, node weights (prefix, weight), edge weights (prefix, forwards, backwards)) over what counts. Messages
    whose reactions weigh nothing are left out. ``simple``: no nodes for reactions, messages bear their weight."""
    msgs, reacts, named = counted(messages, reactions, mentions, members)
    weighed = reaction_weights(msgs, reacts, members, weights)
    total = weighed.groupBy("message").agg(F.sum("weight").alias("total")).where("total <> 0")
    kept = msgs.join(total, "message")
    member = lambda c: address("chat", "member", F.col(c))
    message = address("chat", "message", F.col("channel"), F.col("message"))
    reaction = address("chat", "reaction", F.col("emoji"), F.col("reacter"), F.col("channel"), F.col("message"))
    node = lambda df, a, d, ms: df.select(a.alias("address"), d.cast("string").alias("description"), ms.cast("long").alias("timestamp_ms"))
    edge = lambda df, kind, key, src, dst: df.select(F.concat(F.lit(f"chat/{kind}/"), key).alias("address"), src.alias("src"), dst.alias("dst"), F.col("ms").cast("long").alias("timestamp_ms"))
    known = members.select(F.col("member").alias("author"), "name")
    authored = kept.join(known.select("author"), "author", "left_semi")
    # a person who reacts twice with the same emoji has one reaction
    counted_reactions = weighed.where("weight <> 0").dropDuplicates(["message", "reacter", "emoji"])
    in_props = F.col("channel").isin(list(weights.props))
    pointed = named.groupBy("message", "member").agg(F.sum("n").alias("n")).join(kept, "message")
    people = authored.select("author").union(pointed.select("member"))
    if not simple:
        people = people.union(counted_reactions.select("reacter"))
    people = people.distinct().join(known, "author")
    nodes = node(kept, message, F.concat(F.lit("message in "), "channel"), F.col("ms")).union(node(people, member("author"), F.col("name"), F.lit(None)))
    edges = edge(authored, "authors", F.concat(member("author"), message), member("author"), message)
    kind = F.when(in_props, F.lit("chat/props/")).otherwise(F.lit("chat/mentions/"))
    points = pointed.select(F.concat(kind, message, member("member")).alias("address"), message.alias("src"), member("member").alias("dst"), F.col("ms").cast("long").alias("timestamp_ms"), "n")
    edges = edges.union(points.drop("n"))
    if simple:
        node_weights = kept.select(message.alias("prefix"), F.col("total").alias("weight"))
    else:
        nodes = nodes.union(node(counted_reactions, reaction, F.concat_ws(" ", F.lit("reaction"), "emoji"), F.col("ms")))
        edges = edges.union(edge(counted_reactions, "reactsTo", F.concat(reaction, message), reaction, message)).union(edge(counted_reactions, "addsReaction", F.concat(member("reacter"), reaction), member("reacter"), reaction))
        node_weights = counted_reactions.select(reaction.alias("prefix"), "weight")
    edge_weights = points.where("n > 1").select(F.col("address").alias("prefix"), F.col("n").cast("double").alias("forwards"), F.lit(1.0).alias("backwards"))
    return Graph(nodes, edges), node_weights, edge_weights


def contributions(messages: DataFrame, reactions: DataFrame, mentions: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(expressions (contribution, path, operator), operands (contribution, path, ord, key, subkey), shares
    (contribution, participant, key, subkey, n)) of what counts, for scoring by configuration: across its reacters, each
    the greatest of its roles times its emoji; times its channel's or category's weight. Authors' reactions to
    themselves don't count. messages carry parent."""
    msgs, reacts, named = counted(messages, reactions, mentions, members)
    own = msgs.select(F.concat_ws("/", "channel", "message").alias("contribution"), "message", "channel", "parent", "author")
    met = reacts.join(own.select("message", "contribution", "author"), "message").where(~F.col("reacter").eqNullSafe(F.col("author")))
    people = met.groupBy("contribution", "reacter").agg(F.sort_array(F.collect_list("emoji")).alias("emoji"))
    people = people.withColumn("i", F.row_number().over(Window.partitionBy("contribution").orderBy("reacter")) - 1)
    people = people.join(members.select(F.col("member").alias("reacter"), "roles"), "reacter")
    path = F.concat(F.lit("0.0."), F.col("i").cast("string"))
    row = lambda p, op: F.struct(p.alias("path"), F.lit(op).alias("operator"))
    each = own.select("contribution", F.inline(F.array(row(F.lit("0"), "MULTIPLY"), row(F.lit("0.0"), "key:reactionsAcrossParticipants"), row(F.lit("0.1"), "FIRST"))))
    each = each.union(people.select("contribution", F.inline(F.array(row(path, "MULTIPLY"), row(F.concat(path, F.lit(".0")), "MAX"), row(F.concat(path, F.lit(".1")), "key:reactionsOfSingleParticipant")))))
    leaf = lambda p, o, key, sub: F.struct(p.alias("path"), o.cast("int").alias("ord"), F.lit(key).alias("key"), sub.alias("subkey"))
    place = own.select("contribution", F.inline(F.array(leaf(F.lit("0.1"), F.lit(0), "channel", F.col("channel")), leaf(F.lit("0.1"), F.lit(1), "category", F.coalesce("parent", F.lit(""))))))
    listed = lambda name, key, end: people.select("contribution", path.alias("p"), F.posexplode(name).alias("ord", "subkey")).select("contribution", F.concat("p", F.lit(end)).alias("path"), F.col("ord").cast("int").alias("ord"), F.lit(key).alias("key"), "subkey")
    operands = place.unionByName(listed("roles", "role", ".0")).unionByName(listed("emoji", "emoji", ".1"))
    shares = named.join(own, "message").where("n > 0").groupBy("contribution", F.col("member").alias("participant"), F.col("channel").alias("subkey")).agg(F.sum("n").cast("long").alias("n"))
    shares = shares.select("contribution", "participant", F.lit("mention").alias("key"), "subkey", "n")
    authors = own.join(members.select(F.col("member").alias("author")), "author", "left_semi").select("contribution", F.col("author").alias("participant"), F.lit("author").alias("key"), F.lit(None).cast("string").alias("subkey"), F.lit(1).cast("long").alias("n"))
    return each, operands, shares.unionByName(authors)


def reload_from(messages: DataFrame, n: int) -> DataFrame:
    """(channel, message, ms) of each channel's n-th message from the end, or its first where it has fewer."""
    last = Window.partitionBy("channel").orderBy(F.desc("ms"), F.desc("message"))
    ranked = messages.select("channel", "message", "ms", F.row_number().over(last).alias("_k")).where(F.col("_k") <= n)
    return ranked.groupBy("channel").agg(F.max_by(F.struct("message", "ms"), "_k").alias("x")).select("channel", "x.message", "x.ms")


def mention_counts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, member, n): how often a text mentions each ``<@id>`` or ``<@!id>``."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"<@!?(\d+)>"), F.lit(1))
    return texts.select(key, F.explode(found).alias("member")).groupBy(key, "member").agg(F.count(F.lit(1)).alias("n"))
