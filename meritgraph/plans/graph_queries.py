"""Queries over the graph of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from meritgraph.functions.addresses import address
from meritgraph.operators import graph, intervals, markov, order, references, timeline, weights
from meritgraph.operators.asof import asof_join
from meritgraph.operators.graph import Graph
from meritgraph.plans import domain
from meritgraph.plans.domain import GRAPH_SQL, WEEK_SQL, WEIGHTS_SQL, edge_weights, event_graph, kept_graph, node_weights, participants
from meritgraph.sources import exports, tables

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {GRAPH_SQL} SELECT address, description, timestamp_ms FROM nodes WHERE starts_with(address, 'event/purchase/')")
def graph_nodes_by_prefix(spark, sf):
    return graph.nodes(event_graph(spark, sf), "event/purchase/").select(*graph.NODE)


@query(f"WITH {GRAPH_SQL} SELECT address, src, dst, timestamp_ms FROM solid WHERE starts_with(address, 'mentions/') AND starts_with(src, 'event/click/')")
def graph_edges_filtered(spark, sf):
    return graph.edges(event_graph(spark, sf), "mentions/", "event/click/", dangling=False)


@query(f"WITH {GRAPH_SQL} SELECT e.address, e.src, e.dst, e.timestamp_ms, s.address IS NULL OR d.address IS NULL AS dangling FROM edges e LEFT JOIN nodes s ON e.src = s.address LEFT JOIN nodes d ON e.dst = d.address")
def graph_dangling(spark, sf):
    return graph.with_dangling(event_graph(spark, sf))


@query(f"""WITH {GRAPH_SQL} SELECT dst AS neighbor, address AS edge FROM solid WHERE src = 'user/2/'
UNION ALL SELECT src, address FROM solid WHERE dst = 'user/2/' AND src <> 'user/2/'""")
def graph_neighbors(spark, sf):
    return graph.neighbors(event_graph(spark, sf), "user/2/")


@query(f"""WITH {GRAPH_SQL}, x AS (SELECT src AS address, 0 AS i, 1 AS o FROM solid UNION ALL SELECT dst, 1, 0 FROM solid)
SELECT address, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out FROM x GROUP BY address""")
def graph_degree(spark, sf):
    return graph.degree(event_graph(spark, sf))


@query(f"WITH {GRAPH_SQL} SELECT address, description, timestamp_ms FROM nodes")
def graph_merge(spark, sf):
    g = event_graph(spark, sf)
    a = Graph(g.nodes.where("description <> 'click'"), g.edges.where(F.startswith("address", F.lit("authors/"))))
    return graph.merge([a, Graph(g.nodes.where("description <> 'view'"), g.edges)]).nodes


@query(f"""WITH {GRAPH_SQL}, c AS (SELECT address AS old, 'team/' || (user_id % 3) || '/' AS new FROM (SELECT DISTINCT 'user/' || user_id || '/' AS address, user_id FROM ev) WHERE user_id % 3 < 2)
SELECT e.address, coalesce(s.new, src) AS src, coalesce(d.new, dst) AS dst, timestamp_ms FROM edges e LEFT JOIN c s ON src = s.old LEFT JOIN c d ON dst = d.old""")
def graph_contract(spark, sf):
    g = event_graph(spark, sf)
    team = F.split("address", "/")[1].cast("long") % 3
    olds = g.nodes.where(F.startswith("address", F.lit("user/")) & (team < 2))
    return graph.contract(g, olds.select(F.col("address").alias("old"), address("team", team).alias("address"), F.lit("team").alias("description"), F.lit(None).cast("long").alias("timestamp_ms"))).edges


@query(f"""WITH {GRAPH_SQL}, b AS (SELECT address, CASE WHEN description = 'click' THEN 'tap' ELSE description END AS description, timestamp_ms FROM nodes WHERE description <> 'view' UNION ALL SELECT 'new/1/', 'n', 1)
SELECT coalesce(a.address, b.address) AS address, CASE WHEN b.address IS NULL THEN 'removed' WHEN a.address IS NULL THEN 'added' ELSE 'changed' END AS change
FROM nodes a FULL JOIN b ON a.address = b.address WHERE a.address IS NULL OR b.address IS NULL OR a.description IS DISTINCT FROM b.description OR a.timestamp_ms IS DISTINCT FROM b.timestamp_ms""")
def graph_difference(spark, sf):
    a = event_graph(spark, sf).nodes
    b = a.where("description <> 'view'").withColumn("description", F.when(F.col("description") == "click", "tap").otherwise(F.col("description")))
    return graph.difference(a, b.unionByName(spark.createDataFrame([("new/1/", "n", 1)], "address string, description string, timestamp_ms long")), graph.NODE)


@query(f"WITH {GRAPH_SQL} SELECT e.address FROM edges e JOIN ev ON e.dst = 'event/' || event_type || '/' || event_id || '/' WHERE event_type <> 'error' UNION ALL SELECT e.address FROM edges e WHERE starts_with(e.address, 'mentions/') AND e.src NOT LIKE 'event/error/%' AND e.dst IN (SELECT address FROM nodes)")
def graph_without_nodes(spark, sf):
    g = event_graph(spark, sf)
    return graph.solid(graph.without(g, g.nodes.where("description = 'error'"))).select("address")


@query(f"WITH {WEIGHTS_SQL} SELECT address, round(weight, 9) AS weight FROM nw")
def weights_of_nodes(spark, sf):
    return node_weights(spark, event_graph(spark, sf)).select("address", F.round("weight", 9).alias("weight"))


@query(f"WITH {WEIGHTS_SQL} SELECT address, round(forwards, 9) AS forwards, round(backwards, 9) AS backwards FROM ew")
def weights_of_edges(spark, sf):
    return edge_weights(spark, event_graph(spark, sf)).select("address", F.round("forwards", 9).alias("forwards"), F.round("backwards", 9).alias("backwards"))


@query(f"WITH {WEIGHTS_SQL} SELECT n.address, max_by(w.weight, length(prefix)) AS weight FROM nodes n LEFT JOIN nwt w ON starts_with(n.address, prefix) GROUP BY n.address")
def weights_longest_prefix(spark, sf):
    own = spark.createDataFrame(domain.NODE_WEIGHTS, "prefix string, weight double")
    return weights.longest_prefix(event_graph(spark, sf).nodes.select("address"), own, "weight")


@query("SELECT p_brand AS prefix, CASE WHEN count(*) > 20 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM part GROUP BY p_brand")
def weights_override(spark, sf):
    brands = tables.table(spark, sf, "part").groupBy(F.col("p_brand").alias("prefix")).count()
    return weights.override([brands.select("prefix", F.lit(1.0).alias("weight")), brands.where("count > 20").select("prefix", F.lit(2.0).alias("weight"))])


_WEEKS = f"wk AS (SELECT unnest(range(a, b + 1, 604800000)) AS start_ms FROM (SELECT min({WEEK_SQL.format('timestamp_ms')}) AS a, max({WEEK_SQL.format('timestamp_ms')}) AS b FROM nodes))"


@query(f"""WITH {GRAPH_SQL}, {_WEEKS}, n AS (SELECT {WEEK_SQL.format('timestamp_ms')} AS s, count(*) AS n FROM nodes WHERE timestamp_ms IS NOT NULL GROUP BY 1),
e AS (SELECT {WEEK_SQL.format('timestamp_ms')} AS s, count(*) AS n FROM solid GROUP BY 1)
SELECT (row_number() OVER (ORDER BY start_ms) - 1)::INTEGER AS idx, start_ms, start_ms + 604800000 AS end_ms, coalesce(n.n, 0) AS n_nodes, coalesce(e.n, 0) AS n_edges FROM wk LEFT JOIN n ON n.s = start_ms LEFT JOIN e ON e.s = start_ms""")
def weekly_partition(spark, sf):
    return intervals.weekly_counts(event_graph(spark, sf))


_MINT = f"SELECT {WEEK_SQL.format('timestamp_ms')} AS start_ms, sum(weight) AS mint FROM nw WHERE timestamp_ms IS NOT NULL GROUP BY 1"


@query(f"WITH {WEIGHTS_SQL} SELECT start_ms, round(mint, 6) AS mint FROM ({_MINT})")
def weekly_mint(spark, sf):
    return intervals.weekly_mint(node_weights(spark, event_graph(spark, sf))).withColumn("mint", F.round("mint", 6))


_BUDGETS = [("event/purchase/", 0, 100.0), ("event/purchase/", 1705000000000, 50.0), ("event/click/", 1704500000000, 20.0)]


@query(f"""WITH {WEIGHTS_SQL}, bud(prefix, start_ms, budget) AS (VALUES {domain._values(_BUDGETS)}),
o AS (SELECT nw.*, p.prefix, {WEEK_SQL.format('timestamp_ms')} AS week FROM nw LEFT JOIN (SELECT DISTINCT prefix FROM bud) p ON starts_with(address, p.prefix)),
t AS (SELECT prefix, week, sum(weight) AS total FROM o WHERE prefix IS NOT NULL AND week IS NOT NULL GROUP BY 1, 2),
f AS (SELECT t.prefix, t.week, CASE WHEN budget IS NULL OR total <= budget THEN 1.0 ELSE budget / total END AS factor FROM t ASOF LEFT JOIN bud ON t.prefix = bud.prefix AND t.week >= bud.start_ms)
SELECT address, round(weight * coalesce(factor, 1.0), 9) AS weight FROM o LEFT JOIN f USING (prefix, week)""")
def budget_applied(spark, sf):
    own = spark.createDataFrame(_BUDGETS, "prefix string, start_ms long, budget double")
    return intervals.apply_budget(node_weights(spark, event_graph(spark, sf)), own).select("address", F.round("weight", 9).alias("weight"))


_POLICIES = [("lib-a", 1704000000000, 0.1), ("lib-a", 1705500000000, 0.0), ("lib-b", 1704800000000, 0.25)]


@query(f"""WITH {WEIGHTS_SQL}, pol(recipient, period_ms, share) AS (VALUES {domain._values(_POLICIES)}), m AS ({_MINT}),
e AS (SELECT start_ms, mint, recipient FROM m CROSS JOIN (SELECT DISTINCT recipient FROM pol))
SELECT e.recipient, start_ms, round(mint * share, 6) AS amount FROM e ASOF JOIN pol ON e.recipient = pol.recipient AND start_ms >= period_ms WHERE mint * share <> 0""")
def bonus_minting(spark, sf):
    own = spark.createDataFrame(_POLICIES, "recipient string, period_ms long, share double")
    return intervals.bonuses(intervals.weekly_mint(node_weights(spark, event_graph(spark, sf))), own).withColumn("amount", F.round("amount", 6))


_PERIODS = [(1704300000000, 1.5), (1705100000000, 2.5), (1706000000000, 0.5)]
_PERIODS_SQL = f"per(start_ms, weight) AS (VALUES {domain._values(_PERIODS)})"


@query(f"WITH {GRAPH_SQL}, {_PERIODS_SQL} SELECT event_id, weight FROM ev ASOF LEFT JOIN per ON ms >= start_ms")
def asof_inclusive(spark, sf):
    own = spark.createDataFrame(_PERIODS, "start_ms long, weight double")
    return asof_join(domain.events(spark, sf), own, "ms", "start_ms", "weight").select("event_id", "weight")


@query(f"WITH {GRAPH_SQL}, {_PERIODS_SQL} SELECT event_id, weight FROM ev ASOF JOIN per ON ms > start_ms")
def asof_strict(spark, sf):
    own = spark.createDataFrame(_PERIODS, "start_ms long, weight double")
    return asof_join(domain.events(spark, sf), own, "ms", "start_ms", "weight", strict=True).where("weight IS NOT NULL").select("event_id", "weight")


_CONNECTIONS = """con AS (SELECT src, dst, 'in' AS kind, address AS edge, forwards AS w FROM sw UNION ALL SELECT dst, src, 'out', address, backwards FROM sw UNION ALL SELECT address, address, 'loop', NULL, 0.001::DOUBLE FROM nodes),
pr AS (SELECT src, dst, kind, edge, w / sum(w) OVER (PARTITION BY src) AS pr FROM con)"""


@query(f"WITH {WEIGHTS_SQL}, {_CONNECTIONS} SELECT src, dst, kind, edge, round(pr, 9) AS pr FROM pr")
def markov_connections(spark, sf):
    g = kept_graph(spark, sf)
    return markov.connections(g, edge_weights(spark, g)).select("src", "dst", "kind", "edge", F.round("pr", 9).alias("pr"))


def _power_sql(n: int, alpha: float, seed: str, moves: str) -> str:
    out = [f"p0 AS (SELECT address, p FROM {seed})"]
    for k in range(1, n + 1):
        out.append(f"p{k} AS MATERIALIZED (SELECT address, sum(p) AS p FROM (SELECT dst AS address, {1 - alpha} * p * pr AS p FROM {moves} JOIN p{k - 1} ON src = address UNION ALL SELECT address, {alpha} * p FROM {seed}) GROUP BY address)")
    return ", ".join(out)


@query(f"""WITH {WEIGHTS_SQL}, {_CONNECTIONS}, tr AS MATERIALIZED (SELECT src, dst, sum(pr) AS pr FROM pr GROUP BY 1, 2), sd AS MATERIALIZED (SELECT address, weight / sum(weight) OVER () AS p FROM nw), {_power_sql(5, 0.15, "sd", "tr")}
SELECT address, round(p, 9) AS p FROM p5""")
def markov_actions(spark, sf):
    """Five actions from the distribution of node weights."""
    g = kept_graph(spark, sf)
    moves = markov.chain(markov.connections(g, edge_weights(spark, g)))
    seed = markov.checkpointed(markov.weighted(node_weights(spark, g), "weight"))
    return markov.steps(moves, seed, seed, 0.15, 5).select("address", F.round("p", 9).alias("p"))


_P = markov.Params(0.2, 0.2, 0.15, 0.1)
_W = WEEK_SQL.format("(timestamp_ms - 1)")
PROCESS_SQL = f"""{WEIGHTS_SQL}, {_WEEKS}, rg AS (SELECT min(start_ms) AS a, max(start_ms) AS b FROM wk),
par AS (SELECT address, split_part(address, '/', 2) AS id FROM nodes WHERE starts_with(address, 'user/')),
cb AS (SELECT address, weight AS mint FROM nw ANTI JOIN par ON nw.address = par.address),
gr AS (SELECT id, start_ms, 'epoch/' || start_ms || '/' || id || '/' AS node FROM par CROSS JOIN wk),
rw AS (SELECT CASE WHEN s.id IS NULL THEN src ELSE 'epoch/' || greatest({_W}, a) || '/' || s.id || '/' END AS src, CASE WHEN d.id IS NULL THEN dst ELSE 'epoch/' || greatest({_W}, a) || '/' || d.id || '/' END AS dst,
   s.id IS NOT NULL AS sp, d.id IS NOT NULL AS dp, forwards, backwards FROM sw CROSS JOIN rg LEFT JOIN par s ON src = s.address LEFT JOIN par d ON dst = d.address),
bo AS (SELECT src, dst, sp AS person, forwards AS w FROM rw WHERE forwards > 0 UNION ALL SELECT dst, src, dp, backwards FROM rw WHERE backwards > 0),
mv AS (SELECT src, dst, 'edge' AS kind, w / sum(w) OVER (PARTITION BY src) * CASE WHEN person THEN {_P.rest} ELSE {1 - _P.alpha} END AS pr FROM bo
  UNION ALL SELECT 'seed/', address, 'mint', mint / sum(mint) OVER () FROM cb WHERE mint > 0
  UNION ALL SELECT node, 'sum/' || start_ms || '/', 'payout', {_P.beta} FROM gr
  UNION ALL SELECT node, 'epoch/' || least(start_ms + 604800000, b) || '/' || id || '/', 'forward', {_P.gamma_forward} FROM gr CROSS JOIN rg
  UNION ALL SELECT node, 'epoch/' || greatest(start_ms - 604800000, a) || '/' || id || '/', 'backward', {_P.gamma_backward} FROM gr CROSS JOIN rg),
pn AS (SELECT address, mint FROM cb UNION ALL SELECT node, 0.0 FROM gr UNION ALL SELECT 'sum/' || start_ms || '/', 0.0 FROM wk),
al AS MATERIALIZED (SELECT * FROM mv UNION ALL SELECT address, 'seed/', 'radiation', 1 - coalesce(o, 0) FROM pn LEFT JOIN (SELECT src, sum(pr) AS o FROM mv GROUP BY src) ON src = address)"""


@query(f"WITH {PROCESS_SQL} SELECT src, dst, kind, count(*) AS n, round(sum(pr), 9) AS pr FROM al GROUP BY 1, 2, 3")
def markov_process(spark, sf):
    """All transitions of the time-expanded process."""
    g = kept_graph(spark, sf)
    _, moves = markov.compile_process(g, node_weights(spark, g), edge_weights(spark, g), participants(g), _P)
    return moves.groupBy("src", "dst", "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("pr"), 9).alias("pr"))


STEPS = 10
RANK_SQL = f"""{PROCESS_SQL}, tr AS MATERIALIZED (SELECT src, dst, sum(pr) AS pr FROM al GROUP BY 1, 2), sd AS MATERIALIZED (SELECT address, 1.0 / count(*) OVER () AS p FROM (SELECT address FROM pn UNION ALL SELECT 'seed/')), {_power_sql(STEPS, 0.0, "sd", "tr")},
sc AS (SELECT address, p / (SELECT sum(p) FROM p{STEPS} WHERE starts_with(address, 'sum/')) * (SELECT sum(mint) FROM pn) AS score FROM p{STEPS})"""


def _ranked(spark, sf, n_steps=STEPS):
    g = kept_graph(spark, sf)
    return markov.rank(g, node_weights(spark, g), edge_weights(spark, g), participants(g), _P, n_steps=n_steps)


@query(f"WITH {RANK_SQL} SELECT split_part(src, '/', 3) AS id, round(sum(score * pr), 6) AS score FROM al JOIN sc ON src = address WHERE kind = 'payout' GROUP BY 1 ORDER BY sum(score * pr) DESC, id LIMIT 10")
def rank_top_participants(spark, sf):
    """The ten participants with the highest scores, after a fixed number of actions."""
    return _top(*_ranked(spark, sf))


def _top(scored, moves):
    own = markov.participant_scores(scored, moves).groupBy("id").agg(F.sum("score").alias("s"))
    return own.orderBy(F.desc("s"), "id").limit(10).select("id", F.round("s", 6).alias("score"))


@query(f"WITH {RANK_SQL} SELECT split_part(src, '/', 3) AS id, split_part(src, '/', 2)::BIGINT AS start_ms, round(score * pr, 6) AS score FROM al JOIN sc ON src = address WHERE kind = 'payout'")
def rank_participant_weeks(spark, sf):
    return markov.participant_scores(*_ranked(spark, sf)).withColumn("score", F.round("score", 6))


@query(f"WITH {RANK_SQL} SELECT kind, count(*) AS n, round(sum(score * pr), 6) AS flow FROM al JOIN sc ON src = address GROUP BY kind")
def rank_flows(spark, sf):
    return _flow_sums(*_ranked(spark, sf))


def _flow_sums(scored, moves):
    return markov.flows(scored, moves).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("flow"), 6).alias("flow"))


@query()
def rank_top_participants_converged(spark, sf):
    return _top(*_ranked(spark, sf, None))


@query()
def rank_participant_weeks_converged(spark, sf):
    return markov.participant_scores(*_ranked(spark, sf, None)).withColumn("score", F.round("score", 6))


@query()
def rank_flows_converged(spark, sf):
    return _flow_sums(*_ranked(spark, sf, None))


@query()
def rank_converged(spark, sf):
    """Scores at convergence (no change of 1e-7 in any node)."""
    g = kept_graph(spark, sf)
    scored, moves = markov.rank(g, node_weights(spark, g), edge_weights(spark, g), participants(g), _P)
    return markov.participant_scores(scored, moves).groupBy("id").agg(F.sum("score").alias("score"))


def _weeks(spark, g):
    from meritgraph.functions.weeks import week_intervals

    return week_intervals(g.nodes, "timestamp_ms")


_DECAYED = f"dn AS (SELECT start_ms, address, weight * 0.5 * pow(0.5, (start_ms - {WEEK_SQL.format('timestamp_ms')}) / 604800000) AS weight FROM nw JOIN wk ON start_ms >= {WEEK_SQL.format('timestamp_ms')})"


@query(f"WITH {WEIGHTS_SQL}, {_WEEKS}, {_DECAYED} SELECT start_ms, count(*) AS n, round(sum(weight), 6) AS weight FROM dn GROUP BY 1")
def timeline_decay(spark, sf):
    g = event_graph(spark, sf)
    return timeline.decayed_nodes(node_weights(spark, g), _weeks(spark, g), 0.5).groupBy("start_ms").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


def _timeline_sql(n: int) -> str:
    out = ["q0 AS (SELECT * FROM ts)"]
    for k in range(1, n + 1):
        out.append(f"q{k} AS MATERIALIZED (SELECT start_ms, address, sum(p) AS p FROM (SELECT m.start_ms, dst AS address, 0.8 * p * pr AS p FROM tm m JOIN q{k - 1} q ON m.start_ms = q.start_ms AND src = address UNION ALL SELECT start_ms, address, 0.2 * p FROM ts) GROUP BY 1, 2)")
    return ", ".join(out)


_F = f"pow(0.5, (start_ms - {WEEK_SQL.format('timestamp_ms')}) / 604800000)"
TIMELINE_SQL = f"""{WEIGHTS_SQL}, {_WEEKS}, {_DECAYED},
ts AS MATERIALIZED (SELECT start_ms, address, CASE WHEN sum(w) OVER (PARTITION BY start_ms) > 0 THEN w / sum(w) OVER (PARTITION BY start_ms) ELSE 1.0 / count(*) OVER (PARTITION BY start_ms) END AS p
  FROM (SELECT wk.start_ms, nodes.address, coalesce(dn.weight, 0.0) AS w FROM nodes CROSS JOIN wk LEFT JOIN dn ON dn.start_ms = wk.start_ms AND dn.address = nodes.address)),
te AS (SELECT start_ms, src, dst, forwards * {_F} AS f, backwards * {_F} AS b FROM sw JOIN wk ON start_ms >= {WEEK_SQL.format('timestamp_ms')}),
tb AS (SELECT start_ms, src, dst, f AS w FROM te UNION ALL SELECT start_ms, dst, src, b FROM te UNION ALL SELECT start_ms, address, address, 0.001::DOUBLE FROM nodes CROSS JOIN wk),
tm AS MATERIALIZED (SELECT start_ms, src, dst, sum(w) / sum(sum(w)) OVER (PARTITION BY start_ms, src) AS pr FROM tb GROUP BY 1, 2, 3), {_timeline_sql(4)}"""


@query(f"WITH {TIMELINE_SQL} SELECT start_ms, address, round(p, 9) AS p FROM q4 WHERE starts_with(address, 'user/')")
def timeline_rank(spark, sf):
    return _timeline_ranks(spark, sf, 4)


@query()
def timeline_rank_converged(spark, sf):
    return _timeline_ranks(spark, sf, None)


def _timeline_ranks(spark, sf, n_steps):
    g = kept_graph(spark, sf)
    found = timeline.timeline(g, node_weights(spark, g), edge_weights(spark, g), _weeks(spark, g), n_steps=n_steps).ranks
    return found.where(F.startswith("address", F.lit("user/"))).select("start_ms", "address", F.round("p", 9).alias("p"))


@query(f"""WITH {TIMELINE_SQL}, m AS ({_MINT}), h AS (SELECT start_ms, sum(p) AS held FROM q4 WHERE starts_with(address, 'user/') GROUP BY 1)
SELECT start_ms, round(sum(p * CASE WHEN held > 0 THEN mint / held ELSE 0 END), 6) AS score FROM q4 JOIN m USING (start_ms) JOIN h USING (start_ms) WHERE starts_with(address, 'user/') GROUP BY 1""")
def timeline_scores(spark, sf):
    return _timeline_sums(spark, sf, 4)


@query()
def timeline_scores_converged(spark, sf):
    return _timeline_sums(spark, sf, None)


def _timeline_sums(spark, sf, n_steps):
    g = kept_graph(spark, sf)
    own = node_weights(spark, g)
    found = timeline.timeline(g, own, edge_weights(spark, g), _weeks(spark, g), n_steps=n_steps).ranks
    scored = timeline.to_scores(found, intervals.weekly_mint(own), "user/")
    return scored.where(F.startswith("address", F.lit("user/"))).groupBy("start_ms").agg(F.round(F.sum("score"), 6).alias("score"))


@query(f"WITH {GRAPH_SQL}, x AS (SELECT address FROM nodes UNION SELECT src FROM edges UNION SELECT dst FROM edges), i AS (SELECT address, row_number() OVER (ORDER BY address) - 1 AS index FROM x) SELECT e.address, s.index AS src_index, d.index AS dst_index, timestamp_ms FROM edges e JOIN i s ON src = s.address JOIN i d ON dst = d.address")
def graph_coded_edges(spark, sf):
    return exports.coded(event_graph(spark, sf))[2]


@query(f"""WITH {WEIGHTS_SQL} SELECT n.address AS "address:ID", split_part(n.address, '/', 1) || '/' || split_part(n.address, '/', 2) || '/' AS "nodeType:LABEL", split_part(n.address, '/', 1) || '/' AS "plugin:LABEL",
regexp_replace(description, '[^a-zA-Z0-9/:\\[\\]() \\-.#]', '', 'g') AS description, n.timestamp_ms, round(weight, 9) AS score FROM nodes n JOIN nw USING (address)""")
def export_nodes(spark, sf):
    g = event_graph(spark, sf)
    return exports.node_rows(g, node_weights(spark, g).select("address", F.round("weight", 9).alias("score")))


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS index FROM customer")
def order_index(spark, sf):
    return order.with_index(tables.table(spark, sf, "customer").select("c_custkey"), "c_custkey")


_PLAIN = r"regexp_replace(regexp_replace(text, '(?s)```.*?(```|\z)', ' ', 'g'), '`[^`\n]*`', ' ', 'g')"
_REFS = rf"""SELECT doc_id, 'number' AS kind, unnest(regexp_extract_all(t, '(?:^|[^\w&])#(\d+)', 1)) AS ref FROM t UNION ALL SELECT doc_id, 'person', unnest(regexp_extract_all(t, '(?:^|[^\w/])@([A-Za-z0-9][A-Za-z0-9-]*)', 1)) FROM t
UNION ALL SELECT doc_id, 'link', unnest(regexp_extract_all(t, 'https?://[^\s<>"'')\]]+')) FROM t"""


@query(f"WITH t AS (SELECT page_id AS doc_id, {_PLAIN} AS t FROM (SELECT page_id, url || ' by @' || split_part(url, '/', 3) || ' #' || page_id AS text FROM pages)) SELECT doc_id, kind, ref, count(*) AS n FROM ({_REFS}) GROUP BY ALL")
def references_in_texts(spark, sf):
    """Numbers, people and links in a line of text for each page."""
    text = F.concat("url", F.lit(" by @"), F.split_part("url", F.lit("/"), F.lit(3)), F.lit(" #"), F.col("page_id").cast("string"))
    return references.references(tables.table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), text.alias("text")), "doc_id", "text")


@query("""SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS href FROM pages) GROUP BY ALL""")
def links_in_pages(spark, sf):
    return references.links(tables.table(spark, sf, "pages"), "page_id", "html")


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href="/([^"]*)"', 1)) AS ref FROM pages), a AS (SELECT lower(p_type) AS ref, min('part/' || p_partkey || '/') AS address FROM part GROUP BY 1), b AS (SELECT DISTINCT ref, 'word/' || ref || '/' AS address FROM l WHERE length(ref) < 4)
SELECT DISTINCT l.ref, coalesce(a.address, b.address) AS address FROM l LEFT JOIN a USING (ref) LEFT JOIN b USING (ref)""")
def references_resolved(spark, sf):
    """Cascading dictionaries: parts first, then short words."""
    refs = references.links(tables.table(spark, sf, "pages"), "page_id", "html").select(F.substring(F.col("href"), F.lit(2), F.length("href")).alias("ref")).distinct()
    parts = tables.table(spark, sf, "part").groupBy(F.lower("p_type").alias("ref")).agg(F.min(address("part", F.col("p_partkey"))).alias("address"))
    short = refs.where(F.length("ref") < 4).select("ref", address("word", F.col("ref")).alias("address"))
    return references.resolve(refs, [parts, short])


@query("""WITH RECURSIVE e AS (SELECT DISTINCT user_id AS s, CAST(props->>'k' AS BIGINT) // 7 + 1 AS d FROM events WHERE event_type = 'error' AND value < 5),
r(node, distance) AS (SELECT 3::BIGINT, 0 UNION SELECT d, distance + 1 FROM r JOIN e ON s = node WHERE distance < 12) SELECT node, min(distance)::INTEGER AS distance FROM r GROUP BY node""")
def reachable_users(spark, sf):
    """Over the errors of low value, within 12 steps, as the SQL says; reachable_users_whole has the whole closure."""
    e = tables.table(spark, sf, "events").where("event_type = 'error' AND value < 5")
    return references.reachable(_user_edges(e), spark.createDataFrame([(3,)], "node long"), 12)


def _user_edges(events):
    return events.select(F.col("user_id").alias("src"), (F.floor(F.get_json_object("props", "$.k").cast("long") / 7) + 1).alias("dst")).distinct()


@query()
def reachable_users_whole(spark, sf):
    """Over all events, until no node is new."""
    e = _user_edges(tables.table(spark, sf, "events")).where("dst IS NOT NULL")
    return references.reachable(markov.checkpointed(e), spark.createDataFrame([(3,)], "node long"))
