"""Queries over chats and repositories made of the driver tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meritgraph.functions.weeks import millis
from meritgraph.functions.addresses import address
from meritgraph.operators import chat, expressions, forge, forum, initiatives, markdown, mirror, views
from meritgraph.operators.asof import asof_join
from meritgraph.operators.frames import checkpointed
from meritgraph.operators.order import with_index
from meritgraph.plans.domain import GRAPH_SQL, event_graph
from meritgraph.sources import documents, tables

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


CHAT = chat.Weights(
    roles={"n3": 2.0, "n7": 5.0, "s1": 3.0}, channels={"1-URGENT": 2.0, "5-LOW": 0.0, "p3": 4.0}, emoji={"RF": 2.0, "NO": 0.5, "AO": 0.0},
    role_default=0.5, averaging=True, dampener=0.25, props=("2-HIGH",),
)


def _chat(spark, sf):
    """Orders are messages, lines reactions, suppliers members; suppliers in debt have left."""
    o, l, s = (tables.table(spark, sf, t) for t in ("orders", "lineitem", "supplier"))
    parent = F.concat(F.lit("p"), (F.col("o_custkey") % 5).cast("string"))
    messages = o.select(F.col("o_orderpriority").alias("channel"), F.col("o_orderkey").alias("message"), (F.col("o_custkey") % 150).cast("string").alias("author"), (F.col("o_orderstatus") == "P").alias("non_user"), millis(F.col("o_orderdate")).alias("ms"), parent.alias("parent"))
    reactions = l.where("l_linenumber > 1").select(F.col("l_orderkey").alias("message"), F.col("l_suppkey").cast("string").alias("reacter"), F.concat("l_returnflag", "l_linestatus").alias("emoji"))
    mentions = l.where("l_linenumber = 1").select(F.col("l_orderkey").alias("message"), (F.col("l_partkey") % 120).cast("string").alias("member"), F.lit(1).alias("n"))
    roles = F.array(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), F.concat(F.lit("s"), (F.col("s_suppkey") % 3).cast("string")))
    members = s.where("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("member"), F.col("s_name").alias("name"), roles.alias("roles"))
    return messages, reactions, mentions, members


CHAT_SQL = """me AS (SELECT s_suppkey::VARCHAR AS member, s_name AS name, ['n' || s_nationkey, 's' || (s_suppkey % 3)] AS roles,
  greatest(0.5, CASE s_nationkey WHEN 3 THEN 2.0 WHEN 7 THEN 5.0 ELSE 0.5 END, CASE WHEN s_suppkey % 3 = 1 THEN 3.0 ELSE 0.5 END)::DOUBLE AS role FROM supplier WHERE s_acctbal > 0),
re AS (SELECT l_orderkey AS message, l_suppkey::VARCHAR AS reacter, l_returnflag || l_linestatus AS emoji FROM lineitem WHERE l_linenumber > 1 AND l_suppkey::VARCHAR IN (SELECT member FROM me)),
mn AS (SELECT l_orderkey AS message, (l_partkey % 120)::VARCHAR AS member, count(*) AS n FROM lineitem WHERE l_linenumber = 1 AND (l_partkey % 120)::VARCHAR IN (SELECT member FROM me) GROUP BY 1, 2),
ms AS (SELECT o_orderpriority AS channel, o_orderkey AS message, (o_custkey % 150)::VARCHAR AS author, epoch_us(o_orderdate) // 1000 AS ms, 'p' || (o_custkey % 5) AS parent FROM orders WHERE o_orderstatus <> 'P' AND (o_orderkey IN (SELECT message FROM re) OR o_orderkey IN (SELECT message FROM mn))),
ov AS (SELECT message, sum(role) AS over FROM (SELECT DISTINCT message, reacter, role FROM re JOIN ms USING (message) JOIN me ON reacter = member WHERE reacter <> author) GROUP BY 1),
rw AS (SELECT re.*, ms.author, ms.channel, ms.ms, CASE WHEN reacter = author AND channel <> '2-HIGH' THEN 0.0 ELSE role * CASE channel WHEN '1-URGENT' THEN 2.0 WHEN '5-LOW' THEN 0.0 ELSE CASE WHEN parent = 'p3' THEN 4.0 ELSE 1.0 END END
  * CASE emoji WHEN 'RF' THEN 2.0 WHEN 'NO' THEN 0.5 WHEN 'AO' THEN 0.0 ELSE 1.0 END / (coalesce(over, 0) + 0.25) END AS weight FROM re JOIN ms USING (message) JOIN me ON reacter = member LEFT JOIN ov USING (message)),
kp AS (SELECT ms.*, total FROM ms JOIN (SELECT message, sum(weight) AS total FROM rw GROUP BY 1 HAVING sum(weight) <> 0) USING (message))"""


@query(f"WITH {CHAT_SQL} SELECT message, reacter, emoji, count(*) AS n, round(sum(weight), 9) AS weight FROM rw GROUP BY 1, 2, 3")
def chat_reaction_weights(spark, sf):
    messages, reactions, mentions, members = _chat(spark, sf)
    m, r, _ = chat.counted(messages, reactions, mentions, members)
    found = chat.reaction_weights(m, r, members, CHAT)
    return found.groupBy("message", "reacter", "emoji").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 9).alias("weight"))


_CM, _CR = "'chat/message/' || channel || '/' || message || '/'", "'chat/reaction/' || emoji || '/' || reacter || '/' || channel || '/' || message || '/'"


@query(f"""WITH {CHAT_SQL}, rx AS (SELECT DISTINCT message, channel, reacter, emoji, ms FROM rw WHERE weight <> 0)
SELECT 'chat/authors/chat/member/' || author || '/' || {_CM} AS address, 'chat/member/' || author || '/' AS src, {_CM} AS dst, ms AS timestamp_ms FROM kp WHERE author IN (SELECT member FROM me)
UNION ALL SELECT CASE WHEN channel = '2-HIGH' THEN 'chat/props/' ELSE 'chat/mentions/' END || {_CM} || 'chat/member/' || member || '/', {_CM}, 'chat/member/' || member || '/', ms FROM kp JOIN mn USING (message)
UNION ALL SELECT 'chat/reactsTo/' || {_CR} || {_CM}, {_CR}, {_CM}, ms FROM rx
UNION ALL SELECT 'chat/addsReaction/chat/member/' || reacter || '/' || {_CR}, 'chat/member/' || reacter || '/', {_CR}, ms FROM rx""")
def chat_edges(spark, sf):
    return chat.graph(*_chat(spark, sf), CHAT)[0].edges


@query(f"""WITH {CHAT_SQL}, pe AS (SELECT author AS member FROM kp UNION SELECT member FROM kp JOIN mn USING (message))
SELECT {_CM} AS address, 'message in ' || channel AS description, ms AS timestamp_ms, round(total, 9) AS weight FROM kp
UNION ALL SELECT 'chat/member/' || member || '/', name, NULL, NULL FROM pe JOIN me USING (member)""")
def chat_simple_nodes(spark, sf):
    """Nodes of the simple form, with the weights of messages."""
    g, weights, _ = chat.graph(*_chat(spark, sf), CHAT, simple=True)
    met = g.nodes.join(weights, F.col("address") == F.col("prefix"), "left")
    return met.select("address", "description", "timestamp_ms", F.round("weight", 9).alias("weight"))


@query(f"""WITH {CHAT_SQL}, c AS (SELECT *, channel || '/' || message AS contribution FROM ms), p AS (SELECT contribution, reacter, list_sort(list(emoji)) AS emoji, row_number() OVER (PARTITION BY contribution ORDER BY reacter) - 1 AS i FROM re JOIN c USING (message) WHERE reacter <> author GROUP BY 1, 2),
x AS (SELECT contribution, '0.1' AS path, 0 AS ord, 'channel' AS key, channel AS subkey FROM c UNION ALL SELECT contribution, '0.1', 1, 'category', parent FROM c
UNION ALL SELECT contribution, '0.0.' || i || '.0', k, 'role', roles[k + 1] FROM p JOIN me ON reacter = member, (VALUES (0), (1)) t(k)
UNION ALL SELECT contribution, '0.0.' || i || '.1', k::INTEGER, 'emoji', emoji[k + 1] FROM (SELECT *, unnest(range(len(emoji))) AS k FROM p))
SELECT contribution, path, ord, key, subkey FROM x""")
def chat_operands(spark, sf):
    return chat.contributions(*_chat(spark, sf))[1]


@query(f"""WITH {CHAT_SQL}, c AS (SELECT *, channel || '/' || message AS contribution FROM ms)
SELECT contribution, member AS participant, 'mention' AS key, channel AS subkey, n FROM c JOIN mn USING (message) UNION ALL SELECT contribution, author, 'author', NULL, 1 FROM c WHERE author IN (SELECT member FROM me)""")
def chat_shares(spark, sf):
    return chat.contributions(*_chat(spark, sf))[2]


@query("""SELECT o_orderpriority AS channel, max_by(o_orderkey, k) AS message FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k <= 50 GROUP BY 1""")
def chat_reload_from(spark, sf):
    return chat.reload_from(_chat(spark, sf)[0], 50).select("channel", "message")


def _forge(spark, sf):
    """Orders are pulls of the repositories that their priorities name, merged where they are finished; first lines
    are reviews, second ones comments on those, the others reactions."""
    o, l = (tables.table(spark, sf, t) for t in ("orders", "lineitem"))
    none = F.lit(None).cast("string")
    repo = F.concat(F.lit("org/"), "o_orderpriority")
    ms = millis(F.col("o_orderdate"))
    number = F.concat(repo, F.lit("/"), F.col("o_orderkey").cast("string"))
    of = lambda rows, kind, key, parent, author, text, ms, merged=none, h=none: rows.select(F.lit(kind).alias("kind"), key.alias("key"), parent.alias("parent"), author.cast("string").alias("author"), text.cast("string").alias("description"), ms.cast("long").alias("ms"), merged.alias("merged_as"), h.alias("hash"))
    h = F.md5(F.col("o_orderkey").cast("string"))
    done = o.where("o_orderstatus = 'F'")
    met = l.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_shipdate").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    sub = lambda k: F.concat(number, F.lit(f"/{k}"))
    ship = millis(F.col("l_shipdate"))
    first = met.groupBy("o_orderkey", "o_orderpriority", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"), F.min("l_shipdate").alias("l_shipdate"))
    entities = of(o.select("o_orderpriority").distinct(), "repo", repo, none, none, F.col("o_orderpriority"), F.lit(None))
    entities = entities.union(of(o, "pull", number, forge.entity("repo", repo), F.col("o_custkey"), F.col("o_orderstatus"), ms, F.when(F.col("o_orderstatus") == "F", forge.entity("commit", h)), none))
    entities = entities.union(of(done, "commit", h, none, F.col("o_custkey") % 7, F.lit("merge"), ms + 1, none, h))
    entities = entities.union(of(first.where("l_linenumber = 1"), "review", sub("review"), forge.entity("pull", number), F.col("l_suppkey"), F.lit("review"), ship))
    entities = entities.union(of(first.where("l_linenumber = 2"), "comment", sub("comment"), forge.entity("review", sub("review")), F.col("l_suppkey"), F.lit("comment"), ship))
    kind = F.when(F.col("l_returnflag") == "R", "HEART").when(F.col("l_returnflag") == "A", "CONFUSED").otherwise("ROCKET")
    target = F.when(F.col("l_linenumber") == 3, forge.entity("comment", sub("comment"))).otherwise(forge.entity("pull", number))
    reactions = met.where("l_linenumber > 2").select(target.alias("target"), kind.alias("kind"), F.col("l_suppkey").cast("string").alias("author"), ship.alias("ms"))
    references = met.where("l_linenumber = 2 AND l_partkey % 3 = 0").groupBy("o_orderkey", "o_orderpriority").agg(F.min("l_shipdate").alias("l_shipdate")).select(forge.entity("comment", sub("comment")).alias("src"), forge.entity("repo", repo).alias("dst"), ship.alias("ms"))
    return entities, reactions, references


FORGE_SQL = """o AS (SELECT o_orderkey, o_custkey, o_orderstatus, 'org/' || o_orderpriority AS repo, 'org/' || o_orderpriority || '/' || o_orderkey AS nr, epoch_us(o_orderdate) // 1000 AS ms, md5(o_orderkey::VARCHAR) AS h FROM orders),
m AS (SELECT o.*, l_linenumber AS n, l_suppkey, l_partkey, CASE l_returnflag WHEN 'R' THEN 'HEART' WHEN 'A' THEN 'CONFUSED' ELSE 'ROCKET' END AS kind, epoch_us(l_shipdate) // 1000 AS ship FROM lineitem JOIN o ON l_orderkey = o_orderkey),
f AS (SELECT nr, repo, o_orderstatus, h, n, min(l_suppkey) AS who, min(ship) AS ship FROM m GROUP BY ALL),
x AS (SELECT CASE WHEN n = 3 THEN 'repository/comment/' || nr || '/comment/' ELSE 'repository/pull/' || nr || '/' END AS target, kind, l_suppkey::VARCHAR AS author, ship AS ms, nr, n, o_custkey, o_orderstatus FROM m WHERE n > 2)"""


@query(f"""WITH {FORGE_SQL}, e AS (SELECT 'authors' AS k, 'repository/user/' || o_custkey || '/' AS src, 'repository/pull/' || nr || '/' AS dst, ms FROM o
UNION ALL SELECT 'authors', 'repository/user/' || (o_custkey % 7) || '/', 'repository/commit/' || h || '/', ms + 1 FROM o WHERE o_orderstatus = 'F'
UNION ALL SELECT 'authors', 'repository/user/' || who || '/', CASE n WHEN 1 THEN 'repository/review/' || nr || '/review/' ELSE 'repository/comment/' || nr || '/comment/' END, ship FROM f WHERE n < 3
UNION ALL SELECT 'hasParent', 'repository/pull/' || nr || '/', 'repository/repo/' || repo || '/', ms FROM o
UNION ALL SELECT 'hasParent', CASE n WHEN 1 THEN 'repository/review/' || nr || '/review/' ELSE 'repository/comment/' || nr || '/comment/' END, CASE n WHEN 1 THEN 'repository/pull/' || nr || '/' ELSE 'repository/review/' || nr || '/review/' END, ship FROM f WHERE n < 3
UNION ALL SELECT 'mergedAs', 'repository/pull/' || nr || '/', 'repository/commit/' || h || '/', ms FROM o WHERE o_orderstatus = 'F'
UNION ALL SELECT 'correspondsToCommit', 'repository/commit/' || h || '/', 'git/commit/' || h || '/', ms + 1 FROM o WHERE o_orderstatus = 'F'
UNION ALL SELECT 'references', 'repository/comment/' || nr || '/comment/', 'repository/repo/' || repo || '/', min(ship) FROM m WHERE n = 2 AND l_partkey % 3 = 0 GROUP BY nr, repo
UNION ALL SELECT CASE kind WHEN 'HEART' THEN 'heart' ELSE 'rocket' END, 'repository/user/' || author || '/', target, NULL FROM x WHERE kind <> 'CONFUSED')
SELECT DISTINCT 'repository/' || k || '/' || src || dst AS address, src, dst, CASE WHEN k IN ('heart', 'rocket') THEN NULL ELSE ms END AS timestamp_ms FROM e""")
def forge_edges(spark, sf):
    """All edges; of equal praise on several days no day is told."""
    edges = forge.graph(*_forge(spark, sf))[0].edges
    praise = F.split_part("address", F.lit("/"), F.lit(2)).isin("heart", "rocket")
    return edges.withColumn("timestamp_ms", F.when(~praise, F.col("timestamp_ms")))


@query(f"""WITH {FORGE_SQL}, u AS (SELECT o_custkey::VARCHAR AS u FROM o UNION SELECT (o_custkey % 7)::VARCHAR FROM o WHERE o_orderstatus = 'F' UNION SELECT who::VARCHAR FROM f WHERE n < 3 UNION SELECT author FROM x WHERE kind <> 'CONFUSED')
SELECT split_part(address, '/', 2) AS kind, count(*) AS n, count(t) AS n_timed, count(*) FILTER (WHERE w = 0) AS n_unmerged FROM (
SELECT DISTINCT 'repository/repo/' || repo AS address, NULL::BIGINT AS t, NULL AS w FROM o UNION ALL SELECT 'repository/pull/', ms, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 0 END FROM o UNION ALL SELECT 'repository/commit/', ms, NULL FROM o WHERE o_orderstatus = 'F'
UNION ALL SELECT CASE n WHEN 1 THEN 'repository/review/' ELSE 'repository/comment/' END, ship, NULL FROM f WHERE n < 3 UNION ALL SELECT 'repository/user/' || u, NULL, NULL FROM u) GROUP BY 1""")
def forge_nodes(spark, sf):
    g, unmerged = forge.graph(*_forge(spark, sf))
    met = g.nodes.join(unmerged, F.col("address") == F.col("prefix"), "left")
    return met.groupBy(F.split_part("address", F.lit("/"), F.lit(2)).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count("timestamp_ms").alias("n_timed"), F.count_if(F.col("weight") == 0).alias("n_unmerged"))


@query(f"""WITH {FORGE_SQL}, a AS (SELECT 'repository/pull/' || nr || '/' AS contribution, '0' AS path, 'pull' AS key, repo AS subkey FROM o WHERE o_orderstatus = 'F'
UNION ALL SELECT 'repository/review/' || nr || '/review/', '0', 'review', repo FROM f WHERE n = 1 AND o_orderstatus = 'F'
UNION ALL SELECT target, '0.0', 'reaction', kind FROM x WHERE n > 3 AND o_orderstatus = 'F' AND author <> o_custkey::VARCHAR
UNION ALL SELECT 'repository/review/' || nr || '/review/', '0.0', 'reaction', kind FROM x JOIN f r USING (nr) JOIN f c USING (nr) WHERE x.n = 3 AND r.n = 1 AND c.n = 2 AND x.o_orderstatus = 'F' AND author <> r.who::VARCHAR)
SELECT contribution, path, key, subkey, count(*) AS n FROM a GROUP BY ALL""")
def forge_operands(spark, sf):
    entities, reactions, _ = _forge(spark, sf)
    return forge.contributions(entities, reactions)[1].groupBy("contribution", "path", "key", "subkey").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {FORGE_SQL} SELECT 'repository/pull/' || nr || '/' AS contribution, o_custkey::VARCHAR AS participant, 'pullAuthor' AS key, repo AS subkey, 0 AS ord FROM o WHERE o_orderstatus = 'F'
UNION ALL SELECT 'repository/pull/' || nr || '/', (o_custkey % 7)::VARCHAR, 'commitAuthor', repo, 1 FROM o WHERE o_orderstatus = 'F' UNION ALL SELECT 'repository/review/' || nr || '/review/', who::VARCHAR, 'pullAuthor', repo, 0 FROM f WHERE n = 1 AND o_orderstatus = 'F'""")
def forge_shares(spark, sf):
    entities, reactions, _ = _forge(spark, sf)
    return forge.contributions(entities, reactions)[2]


def _initiatives(spark, sf):
    """Parts are initiatives; suppliers and other parts are linked to them, and each has an entry."""
    p = tables.table(spark, sf, "part")
    i = p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), (F.col("p_partkey") * 1000).alias("ms"), (F.col("p_size") % 2 == 0).alias("completed"), F.when(F.col("p_size") % 3 > 0, F.col("p_size") / 2).alias("incomplete"), F.when(F.col("p_size") % 3 > 0, F.col("p_size") * 1.0).alias("complete"))
    link = lambda f, url: F.struct(F.lit(f).alias("field"), url.cast("string").alias("url"))
    k = F.col("p_partkey")
    links = p.select(k.cast("string").alias("id"), F.inline(F.array(link("DEPENDENCY", F.concat(F.lit("part:"), (k + 7).cast("string"))), link("REFERENCE", F.concat(F.lit("part:"), (k % 5).cast("string"))), link("CHAMPION", F.concat(F.lit("supplier:"), (k % 13).cast("string"))))))
    entries = p.where("p_partkey % 4 = 0").select(k.cast("string").alias("id"), F.lit("CONTRIBUTION").alias("field"), F.lit(None).cast("string").alias("key"), F.concat(F.lit("Made of "), "p_type", F.lit("!")).alias("title"), F.when(k % 8 == 0, k).alias("ms"), F.when(k % 3 == 0, k * 1.0).alias("weight"))
    contributors = entries.select("id", "field", initiatives.slug(F.col("title")).alias("key"), F.concat(F.lit("supplier:"), (F.col("id").cast("long") % 11).cast("string")).alias("url"))
    s = tables.table(spark, sf, "supplier")
    known = p.select(F.concat(F.lit("part:"), k.cast("string")).alias("url"), address("initiatives", "initiative", k).alias("address")).union(s.where("s_suppkey < 12").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")), address("user", F.col("s_suppkey"))))
    return i, links, entries, contributors, known


_INITIATIVES = """p AS (SELECT p_partkey AS k, 'initiatives/initiative/' || p_partkey || '/' AS a, p_name, p_size, p_type FROM part),
en AS (SELECT *, 'initiatives/entry/CONTRIBUTION/' || k || '/' || regexp_replace(lower('made-of-' || p_type), '[^a-z0-9]+', '-', 'g') || '/' AS e FROM p WHERE k % 4 = 0)"""


@query(f"""WITH {_INITIATIVES} SELECT 'initiatives/dependsOn/' || p.a || q.a AS address, p.a AS src, q.a AS dst, p.k * 1000 AS timestamp_ms FROM p JOIN p q ON q.k = p.k + 7
UNION ALL SELECT 'initiatives/references/' || p.a || q.a, p.a, q.a, p.k * 1000 FROM p JOIN p q ON q.k = p.k % 5
UNION ALL SELECT 'initiatives/champions/' || a || 'user/' || (k % 13) || '/', 'user/' || (k % 13) || '/', a, k * 1000 FROM p JOIN supplier ON s_suppkey = k % 13 WHERE s_suppkey < 12
UNION ALL SELECT 'initiatives/contributesTo/' || a || e, e, a, k * 1000 FROM en
UNION ALL SELECT 'initiatives/contributesToEntry/' || e || 'user/' || (k % 11) || '/', 'user/' || (k % 11) || '/', e, CASE WHEN k % 8 = 0 THEN k ELSE k * 1000 END FROM en JOIN supplier ON s_suppkey = k % 11""")
def initiative_edges(spark, sf):
    return initiatives.graph(*_initiatives(spark, sf))[0].edges


@query(f"""WITH {_INITIATIVES}, w AS (SELECT a, CASE WHEN p_size % 3 > 0 THEN CASE WHEN p_size % 2 = 0 THEN p_size * 1.0 ELSE p_size / 2.0 END END::DOUBLE AS w FROM p) SELECT a AS prefix, w AS weight FROM w WHERE w IS NOT NULL AND w <> 0 UNION ALL SELECT e, k::DOUBLE FROM en WHERE k % 3 = 0""")
def initiative_weights(spark, sf):
    return initiatives.graph(*_initiatives(spark, sf))[1]


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, epoch_us(l_shipdate) // 1000 AS ms, l_suppkey % 20 AS c FROM lineitem), o AS (SELECT o_custkey % 20 AS c, epoch_us(o_orderdate) // 1000 AS s, max(o_totalprice) AS value FROM orders GROUP BY 1, 2)
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.ms, o.value FROM l ASOF LEFT JOIN o ON l.c = o.c AND l.ms >= o.s""")
def asof_many_periods(spark, sf):
    """The last order of a group of customers before each line was shipped: as many periods as orders."""
    l = tables.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", millis(F.col("l_shipdate")).alias("ms"), (F.col("l_suppkey") % 20).alias("c"))
    o = tables.table(spark, sf, "orders").select((F.col("o_custkey") % 20).alias("c"), millis(F.col("o_orderdate")).alias("s"), F.col("o_totalprice").alias("value"))
    return asof_join(l, o, "ms", "s", "value", by=["c"]).drop("c")


_OPERATORS = [(1, "reactionsAcrossParticipants", "ADD"), (1, "reactionsOfSingleParticipant", "MAX")]
_ROLES = {"n3": 2.0, "n7": 5.0, "s1": 3.0}
_EMOJI = {"RF": 2.0, "NO": 0.5}


@query(f"""WITH {CHAT_SQL}, c AS (SELECT *, channel || '/' || message AS contribution FROM ms),
p AS (SELECT contribution, reacter, max(CASE emoji WHEN 'RF' THEN 2.0 WHEN 'NO' THEN 0.5 END) AS e, count(*) AS n FROM re JOIN c USING (message) WHERE reacter <> author GROUP BY 1, 2),
r AS (SELECT p.*, greatest(CASE s_nationkey WHEN 3 THEN 2.0 WHEN 7 THEN 5.0 END, CASE WHEN s_suppkey % 3 = 1 THEN 3.0 END) AS g FROM p JOIN supplier ON s_suppkey::VARCHAR = reacter)
SELECT c.contribution, round(coalesce(sum(CASE WHEN reacter IS NULL THEN 0.0 ELSE coalesce(g, 1.0) * coalesce(e, 1.0) END), 0) * CASE channel WHEN '1-URGENT' THEN 2.0 WHEN '5-LOW' THEN 0.0 ELSE CASE WHEN parent = 'p3' THEN 4.0 ELSE 1.0 END END, 9) AS score FROM c LEFT JOIN r USING (contribution) GROUP BY c.contribution, channel, parent""")
def chat_scores(spark, sf):
    """Messages scored by configured operators."""
    trees, operands, _ = chat.contributions(*_chat(spark, sf))
    rows = [(1, "role", None, 1.0), (1, "emoji", None, 1.0), (1, "channel", None, 1.0), (1, "category", None, 1.0), (1, "channel", "1-URGENT", 2.0), (1, "channel", "5-LOW", 0.0), (1, "category", "p3", 4.0)]
    rows += [(1, "role", k, w) for k, w in _ROLES.items()] + [(1, "emoji", k, w) for k, w in _EMOJI.items()]
    configs = spark.createDataFrame(rows, "start_ms long, key string, subkey string, weight double")
    operators = spark.createDataFrame(_OPERATORS, "start_ms long, key string, operator string")
    trees = expressions.with_operators(trees.withColumn("config_ms", F.lit(1).cast("long")), operators)
    scored = expressions.score_trees(trees, expressions.weigh(operands.withColumn("config_ms", F.lit(1).cast("long")), configs), 4)
    return scored.where("path = '0'").select("contribution", F.round("score", 9).alias("score"))


def _forum(spark, sf, kept=False):
    """Orders are topics, their lines posts; suppliers like them. The lines are put together once if they are ``kept``."""
    l = tables.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"), F.min("l_partkey").alias("l_partkey"))
    if kept:
        l = checkpointed(l)
    post = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    posts = l.select(post.alias("post"), F.col("l_orderkey").alias("topic"), F.col("l_linenumber").alias("index"), F.when(F.col("l_partkey") % 3 == 0, (F.col("l_partkey") % 4 + 1).cast("int")).alias("reply_to_index"), F.col("l_suppkey").alias("author"), (F.col("l_partkey") + 1).alias("ms"))
    likes = l.where("l_partkey % 2 = 0").select(post.alias("post"), F.col("l_suppkey").alias("author"), F.col("l_partkey").alias("ms"))
    users = tables.table(spark, sf, "supplier").where("s_suppkey % 6 < 5").select(F.col("s_suppkey").alias("author"), (F.col("s_suppkey") % 6).alias("trust"))
    o = tables.table(spark, sf, "orders")
    topics = o.select(F.col("o_orderkey").alias("topic"), F.col("o_orderpriority").alias("category"))
    tags = o.where("o_custkey % 3 = 0").select(F.col("o_orderkey").alias("topic"), F.col("o_orderstatus").alias("tag")).union(o.where("o_custkey % 6 = 0").select("o_orderkey", F.lit("extra")))
    return likes, users, posts, topics, tags


_FORUM = """f AS (SELECT l_orderkey AS topic, l_linenumber AS i, min(l_suppkey) AS author, min(l_partkey) AS k, l_orderkey || '-' || l_linenumber AS post FROM lineitem GROUP BY 1, 2)"""


@query(f"WITH {_FORUM} SELECT a.post, b.post AS parent FROM f a JOIN f b ON a.topic = b.topic AND b.i = CASE WHEN a.k % 3 = 0 THEN a.k % 4 + 1 WHEN a.i > 1 THEN 1 END")
def forum_replies(spark, sf):
    return forum.replies(_forum(spark, sf)[2])


@query(f"""WITH {_FORUM}, w AS (SELECT topic, post, CASE WHEN author % 6 < 5 THEN [0.0, 0.1, 1.0, 1.25, 1.5][author % 6 + 1] ELSE 0.0 END * CASE o_orderpriority WHEN '1-URGENT' THEN 3.0 ELSE 1.0 END * CASE WHEN o_custkey % 3 = 0 AND o_orderstatus = 'F' THEN 0.5 ELSE 1.0 END * CASE WHEN o_custkey % 6 = 0 THEN 2.0 ELSE 1.0 END AS w
FROM f JOIN orders ON o_orderkey = topic WHERE k % 2 = 0)
SELECT 'forum/topicHasLikedPost/forum/topic/' || topic || '/forum/post/' || post || '/' AS address, 'forum/topic/' || topic || '/' AS src, 'forum/post/' || post || '/' AS dst, round(sum(w), 9)::DOUBLE AS weight FROM w GROUP BY topic, post HAVING sum(w) <> 0""")
def forum_liked_posts(spark, sf):
    weighed = forum.like_weights(*_forum(spark, sf), {"1-URGENT": 3.0}, {"F": 0.5, "extra": 2.0})
    return forum.liked_posts(weighed).withColumn("weight", F.round("weight", 9))


@query("""WITH a AS (SELECT o_custkey AS id, sum(o_totalprice) AS s FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS id, sum(o_totalprice) AS s FROM orders GROUP BY 1)
SELECT id, round(a.s, 4) AS before, round(b.s, 4) AS after, round(b.s - a.s, 4) AS change FROM a JOIN b USING (id)""")
def view_changes(spark, sf):
    """Scores before and after, of participants who are in both."""
    o = tables.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("score"), "o_orderkey")
    before = o.where("o_orderkey % 2 = 0")
    after = o.join(before.select("id").distinct(), "id", "left_semi")
    found = views.changes(before, after)
    return found.select("id", *(F.round(c, 4).alias(c) for c in ("before", "after", "change")))


def _mirrored(spark, sf, kept=True):
    """Orders as pulls with their lines as reviews and customers as authors, learned in two updates: the first has old
    titles, knows no review's type and has authors that are blocked or change."""
    o = tables.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    li = tables.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"))
    li = checkpointed(li)  # each kind of facts has its lines
    c = tables.table(spark, sf, "customer").select("c_custkey", "c_name")
    pull, review, person = (lambda *x, p=p: F.concat_ws("-", F.lit(p), *(F.col(i).cast("string") for i in x)) for p in ("P", "R", "U"))
    rows = lambda df, *cols: df.select(*(x if isinstance(x, Column) else F.lit(x) for x in cols))
    json_ = lambda x: F.to_json(F.parse_json(F.concat(F.lit('"'), x, F.lit('"'))))
    objects = rows(o, pull("o_orderkey").alias("id"), F.lit("Pull").alias("typename"), F.lit(1).alias("seq")).union(rows(li, review("l_orderkey", "l_linenumber"), F.lit(None).cast("string"), 1)).union(rows(li, review("l_orderkey", "l_linenumber"), "Review", 2)).union(rows(c, person("c_custkey"), "User", 1))
    primitives = rows(o, pull("o_orderkey").alias("id"), F.lit("title").alias("field"), json_(F.lit("old")).alias("value"), F.lit(1).alias("seq")).union(rows(o, pull("o_orderkey"), "title", json_(F.concat(F.lit("pull "), F.col("o_orderstatus"))), 2))
    primitives = primitives.union(rows(o, pull("o_orderkey"), "cents", F.col("cents").cast("string"), 1)).union(rows(li, review("l_orderkey", "l_linenumber"), "state", json_(F.col("l_returnflag")), 2)).union(rows(c, person("c_custkey"), "login", json_(F.col("c_name")), 1))
    links = rows(o, pull("o_orderkey").alias("id"), F.lit("author").alias("field"), person("o_custkey").alias("child"), F.lit(2).alias("seq")).union(rows(o.where("o_orderkey % 3 = 0"), pull("o_orderkey"), "author", F.lit("U-1"), 1))
    entries = rows(li, pull("l_orderkey").alias("id"), F.lit("reviews").alias("field"), (10 - F.col("l_linenumber")).cast("long").alias("ord"), review("l_orderkey", "l_linenumber").alias("child"), F.lit(2).alias("seq"))
    blocked = c.where("c_custkey % 10 = 0").select(person("c_custkey").alias("id"))
    return mirror.folded(mirror.Store(objects, primitives, links, entries), blocked, kept)


@query("""SELECT 'P-' || o_orderkey AS id, 'pull ' || o_orderstatus AS title, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, CASE WHEN o_custkey % 10 <> 0 THEN c_name END AS author, coalesce(states, '') AS states, coalesce(n, 0)::BIGINT AS n_reviews
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, string_agg(l_linenumber || l_returnflag, ',' ORDER BY l_linenumber DESC) AS states, count(*) AS n FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2) GROUP BY 1) ON l_orderkey = o_orderkey""")
def mirror_pulls(spark, sf):
    """Nested objects put together from facts: pulls with their author and, in order, their reviews."""
    found = mirror.assemble(_mirrored(spark, sf), {"title": "string", "cents": "bigint", "author": mirror.Node({"login": "string"}), "reviews": mirror.Many({"state": "string"}, "Review")}, "Pull")
    states = F.array_join(F.transform("reviews", lambda r: F.concat(F.element_at(F.split(r["id"], "-"), -1), r["state"])), ",")
    return found.select("id", "title", "cents", F.col("author.login").alias("author"), states.alias("states"), F.size("reviews").cast("long").alias("n_reviews"))


@query("""SELECT 'R-' || l_orderkey || '-' || l_linenumber AS id, 'P-' || l_orderkey AS parent, CASE WHEN l_returnflag = 'R' THEN 0 END AS fresh FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2) WHERE l_returnflag <> 'N'""")
def mirror_parents(spark, sf):
    """Reviews with the pull in whose connection they are, and whether they were updated since."""
    s = _mirrored(spark, sf, False)
    state = mirror.values(s, s.objects.where("typename = 'Review'").select("id", "typename"), {"state": "string"})
    state = checkpointed(state)
    updates = state.where("state <> 'A'").select("id", F.when(F.col("state") == "R", 200).otherwise(50).cast("long").alias("ms"))
    old = mirror.stale(state.where("state <> 'N'"), updates, 100).select("id", F.lit(None).cast("int").alias("fresh"))
    met = mirror.parents(s, "reviews").join(state.where("state <> 'N'").select("id"), "id").join(old.withColumn("old", F.lit(True)), "id", "left")
    return met.select("id", "parent", F.when(F.col("old").isNull(), 0).alias("fresh"))


_AT = "row_number() OVER (ORDER BY {0}) - 1"
_PARTS = "string_split({0}, '/')[:-2]"


@query(f"""WITH {GRAPH_SQL}, x AS (SELECT address, {_AT.format(_PARTS.format('address'))} AS i FROM (SELECT address FROM nodes UNION SELECT src FROM edges UNION SELECT dst FROM edges)),
e AS (SELECT {_AT.format(_PARTS.format('e.address'))} AS "at", json_object('address', {_PARTS.format('e.address')}, 'dstIndex', d.i, 'srcIndex', s.i, 'timestampMs', timestamp_ms)::VARCHAR AS value FROM edges e JOIN x s ON src = s.address JOIN x d ON dst = d.address),
n AS (SELECT {_AT.format('i')} AS "at", json_object('description', description, 'index', i, 'timestampMs', timestamp_ms)::VARCHAR AS value FROM nodes JOIN x USING (address)),
a AS (SELECT 3 AS section, "at", value FROM e UNION ALL SELECT 5, "at", value FROM n UNION ALL SELECT 7, i, to_json({_PARTS.format('address')})::VARCHAR FROM x)
SELECT section, "at", CASE WHEN "at" > 0 THEN ',' ELSE '' END || value AS value FROM a
UNION ALL SELECT * FROM (VALUES (0, 0, '[{{"type":"events/graph","version":"0.8.0"}},'), (2, 0, '{{"edges":['), (4, 0, '],"nodes":['), (6, 0, '],"sortedNodeAddresses":['), (8, 0, ']}}'), (10, 0, ']'))""")
def graph_document(spark, sf):
    """The lines of the events' graph as a JSON document."""
    return documents.graph_lines(event_graph(spark, sf), "events")


@query("""WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey::VARCHAR) - 1 AS j FROM customer), w AS (SELECT y, row_number() OVER (ORDER BY y) - 1 AS e FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders)),
z AS (SELECT (SELECT count(*) FROM part) AS n, (SELECT count(*) FROM customer) AS p)
SELECT 'part/' || p_partkey || '/' AS address, row_number() OVER (ORDER BY ['part', p_partkey::VARCHAR]) - 1 AS index FROM part UNION ALL SELECT 'seed/', n FROM z
UNION ALL SELECT 'sum/' || y || '/', n + 1 + e * (p + 1) FROM w, z UNION ALL SELECT 'epoch/' || y || '/' || c_custkey || '/', n + 1 + e * (p + 1) + 1 + j FROM w, c, z""")
def process_order(spark, sf):
    """Positions of a process whose nodes are parts, whose participants are customers and whose epochs are years."""
    own = tables.table(spark, sf, "part").select(address("part", F.col("p_partkey")).alias("address")).withColumn("_k", documents.to_parts(F.col("address")))
    people = tables.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    years = tables.table(spark, sf, "orders").select(F.year("o_orderdate").alias("start_ms")).distinct()
    return documents.node_order(with_index(own, "_k"), with_index(people, "id"), years)


@query()
def markdown_references(spark, sf):
    """What the documents refer to, whole texts read as Markdown, and the documents that numbers name."""
    docs = tables.table(spark, sf, "documents").select("doc_id", "text")
    found = markdown.references(docs, "doc_id", "text")
    named = docs.select(F.concat(F.lit("#"), F.col("doc_id").cast("string")).alias("ref"), address("document", F.col("doc_id")).alias("address"))
    return found.join(markdown.dictionary([named]), "ref", "left").select("doc_id", "ref", "ref_type", "n", "address")


@query("""SELECT o_orderkey AS id, '#' || (o_orderkey % 50) AS ref, 'BASIC' AS ref_type, 1::BIGINT AS n, 'order/' || (o_orderkey % 50) || '/' AS address FROM orders
UNION ALL SELECT o_orderkey, '@u' || o_custkey, k, 1, 'customer/' || o_custkey || '/' FROM orders, (VALUES ('BASIC'), ('PAIRED_WITH')) v(k)
UNION ALL SELECT o_orderkey, 'o/r#' || (o_orderkey % 7), 'BASIC', 1, NULL FROM orders""")
def markdown_order_references(spark, sf):
    """References in a comment in Markdown for each order."""
    o = tables.table(spark, sf, "orders")
    k, w = F.col("o_orderkey").cast("string"), F.concat(F.lit("u"), F.col("o_custkey").cast("string"))
    number = lambda n: (F.col("o_orderkey") % n).cast("string")
    body = F.concat(k, F.lit(" see **#"), number(50), F.lit("** and `#"), k, F.lit("`\npaired with @"), w, F.lit(", @"), w, F.lit("\n\n    #1\n\n> o/r#"), number(7))
    found = markdown.references(o.select(F.col("o_orderkey").alias("id"), body.alias("body")), "id", "body")
    orders = spark.range(50).select(F.concat(F.lit("#"), F.col("id").cast("string")).alias("ref"), address("order", F.col("id")).alias("address"))
    people = o.select(F.concat(F.lit("@u"), F.col("o_custkey").cast("string")).alias("ref"), address("customer", F.col("o_custkey")).alias("address"))
    return found.join(markdown.dictionary([orders, people]), "ref", "left").select("id", "ref", "ref_type", "n", "address")


_T, _P, _U = "'forum/topic/' || topic || '/'", "'forum/post/' || post || '/'", "'forum/user/' || author || '/'"
_L = "'forum/like/' || author || '/' || post || '/'"


@query(f"""WITH {_FORUM}, t AS (SELECT o_orderkey AS topic, o_custkey AS author, o_orderkey * 10 AS ms FROM orders), k AS (SELECT * FROM f WHERE k % 2 = 0),
w AS (SELECT * FROM k WHERE author % 6 BETWEEN 1 AND 4)
SELECT 'forum/authorsTopic/' || {_T} AS address, {_U} AS src, {_T} AS dst, ms AS timestamp_ms FROM t
UNION ALL SELECT 'forum/authorsPost/' || {_P}, {_U}, {_P}, k + 1 FROM f UNION ALL SELECT 'forum/topicContainsPost/' || {_P}, {_T}, {_P}, k + 1 FROM f
UNION ALL SELECT 'forum/replyTo/forum/post/' || a.post || '/', 'forum/post/' || a.post || '/', 'forum/post/' || b.post || '/', a.k + 1 FROM f a JOIN f b ON a.topic = b.topic AND b.i = CASE WHEN a.k % 3 = 0 THEN a.k % 4 + 1 WHEN a.i > 1 THEN 1 END
UNION ALL SELECT 'forum/createsLike/' || {_L}, {_U}, {_L}, k FROM k UNION ALL SELECT 'forum/likes/' || {_L}, {_L}, {_P}, k FROM k
UNION ALL SELECT 'forum/topicHasLikedPost/' || {_T} || {_P}, {_T}, {_P}, k + 1 FROM w
UNION ALL SELECT 'forum/references/' || {_P} || {_T}, {_P}, {_T}, k + 1 FROM f WHERE i = 2""")
def forum_edges(spark, sf):
    """The whole graph of the forum; second posts refer to their topics."""
    likes, users, posts, topics, tags = _forum(spark, sf, True)
    more = tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("topic"), F.col("o_custkey").alias("author"), F.lit("order").alias("title"), (F.col("o_orderkey") * 10).alias("ms"))
    refs = posts.where("index = 2").select("post", address("forum", "topic", F.col("topic")).alias("address"))
    return forum.graph(posts, likes, users, topics.join(more, "topic"), tags, {"1-URGENT": 3.0}, {"F": 0.5, "extra": 2.0}, refs)[0].edges
