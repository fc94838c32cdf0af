"""Markov chains over contribution graphs and their stationary distributions.

A chain is a table of transitions (src, dst, pr). An action joins the distribution with the transitions on ``src`` and
sums by ``dst``; the distribution stays dealt out and sorted as the next join needs it, so a step shuffles only what
flows from sources that aren't hot. The transitions are dealt by ``src`` and sorted once and kept, but for those of hot
sources (the seed has one to every minting node): these are dealt by ``dst`` and meet a broadcast of their sources' few
probabilities, so that what they bring is summed where it arrives. Each step's distribution is checkpointed, which ends
its lineage, and the one before is deleted with the shuffles, so the disk holds no more after many steps than after a
few. ``rank`` works on whole numbers in place of addresses, which the process has from its start."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meritgraph.functions.addresses import address
from meritgraph.functions.weeks import week_intervals, week_start
from meritgraph.operators.frames import AS_PLANNED, checkpointed, dealt, dropped, hot_keys, hot_of, join_skewed, settings
from meritgraph.operators.graph import Graph, solid

LOOP = 1e-3
STEPS_A_CHECKPOINT = 5
THRESHOLD = 1e-7


def connections(g: Graph, edge_weights: DataFrame, loop: float = LOOP) -> DataFrame:
    """(src, dst, kind, edge, pr): both directions of each edge and a loop at each node, by weight over the source's
    total. edge_weights: the graph's edges with forwards and backwards."""
    own = solid(Graph(g.nodes, edge_weights))
    both = own.select(F.inline(F.array(
        F.struct(F.col("src"), F.col("dst"), F.lit("in").alias("kind"), F.col("address").alias("edge"), F.col("forwards").alias("w")),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("out").alias("kind"), F.col("address").alias("edge"), F.col("backwards").alias("w")),
    )))
    loops = g.nodes.select(F.col("address").alias("src"), F.col("address").alias("dst"), F.lit("loop").alias("kind"), F.lit(None).cast("string").alias("edge"), F.lit(loop).alias("w"))
    return shares(both.unionByName(loops), "w")


def shares(rows: DataFrame, w: str) -> DataFrame:
    """``pr``: weight over the total of its ``src``. Totals are partial sums joined back, those of hot sources by
    broadcast. The rows are written once, and what is hot follows from the totals' own counts."""
    rows = checkpointed(rows)
    return _shared(rows, totals_of(rows, w, "src"), w, "src")


def totals_of(rows: DataFrame, w: str, key: str) -> DataFrame:
    return checkpointed(rows.groupBy(key).agg(F.sum(w).alias("_t"), F.count(F.lit(1)).alias("_n")))


def _shared(rows: DataFrame, totals: DataFrame, w: str, key: str) -> DataFrame:
    hot = hot_of(totals, key, "_n")
    return join_skewed(rows, totals.drop("_n"), key, hot).withColumn("pr", F.col(w) / F.col("_t")).drop("_t", w)


def chain(found: DataFrame) -> DataFrame:
    """Parallel connections as one transition."""
    return found.groupBy("src", "dst").agg(F.sum("pr").alias("pr"))


def chain_from_matrix(spark: SparkSession, matrix: list[list[float]]) -> DataFrame:
    """Transitions of a square matrix whose rows sum to one; zeros are dropped."""
    if any(len(r) != len(matrix) or abs(sum(r) - 1) > 1e-6 or min(r) < 0 for r in matrix):
        raise ValueError("not a transition matrix")
    return spark.createDataFrame([(str(i), str(j), float(x)) for i, r in enumerate(matrix) for j, x in enumerate(r) if x], "src string, dst string, pr double")


def check_stochastic(transitions: DataFrame, tolerance: float = 1e-3) -> None:
    wrong = transitions.groupBy("src").agg(F.sum("pr").alias("t")).where(F.abs(F.col("t") - 1) > tolerance).limit(5).collect()
    if wrong:
        raise ValueError(f"out-probabilities don't sum to one: {[(r.src, r.t) for r in wrong]}")


def uniform(nodes: DataFrame) -> DataFrame:
    n = nodes.count()
    return nodes.select("address", F.lit(1.0 / max(n, 1)).alias("p"))


def weighted(nodes: DataFrame, weight: str) -> DataFrame:
    """Distribution in proportion to a weight; uniform where all are zero. Negative, infinite and missing weights are
    errors."""
    w = F.col(weight)
    total, wrong = nodes.agg(F.sum(w), F.count_if(w.isNull() | F.isnan(w) | (w < 0) | (w == float("inf")))).first()
    if wrong:
        raise ValueError(f"weights have to be finite and not negative: {wrong} are not")
    return nodes.select("address", (w / total).alias("p")) if total and total > 0 else uniform(nodes)


@dataclass(frozen=True)
class Moves:
    """Transitions laid out for many steps; ``close`` when done."""

    cold: DataFrame
    hot: DataFrame | None  # of the sources that are hot, if any are
    sources: DataFrame

    @staticmethod
    def of(transitions: DataFrame) -> Moves:
        return Moves.laid(checkpointed(transitions))

    @staticmethod
    def laid(transitions: DataFrame, hot: DataFrame | None = None) -> Moves:
        """Of transitions that are materialised. hot (src): the sources that are hot, if known."""
        hot = hot_keys(transitions, "src") if hot is None else hot
        sources = checkpointed(hot.repartition(1))  # MAX_HOT at most; broadcast in each action
        if sources.isEmpty():
            return Moves(dealt(transitions, "src"), None, sources)
        cold = dealt(transitions.join(F.broadcast(sources), "src", "left_anti"), "src")
        return Moves(cold, dealt(transitions.join(F.broadcast(sources), "src", "left_semi"), "dst"), sources)

    def met(self, own: DataFrame) -> list[DataFrame]:
        """The transitions with what ``own`` has of their ``src``: dealt by ``src``, and those of hot sources, if there are
        any, dealt by ``dst``."""
        cold = self.cold.join(own, "src")
        if self.hot is None:
            return [cold]
        few = F.broadcast(own.join(F.broadcast(self.sources), "src", "left_semi"))
        return [cold, self.hot.join(few, "src")]

    def acted(self, pi: DataFrame, seed: DataFrame, alpha: float) -> DataFrame:
        """(address, p, q): alpha * seed + (1 - alpha) * what flows in, and what was before. ``pi`` has every node, dealt by
        address. What hot sources bring is dealt by address already; only the others' flow is shuffled."""
        out, p = pi.withColumnRenamed("p", "q"), F.lit(0.0)
        for k, met in enumerate(self.met(pi.withColumnRenamed("address", "src"))):
            brought = met.groupBy(F.col("dst").alias("address")).agg(F.sum(F.col("p") * F.col("pr")).alias(f"_f{k}"))
            out, p = out.join(brought, "address", "left"), p + F.coalesce(f"_f{k}", F.lit(0.0))
        if alpha:
            out, p = out.join(seed.select("address", F.col("p").alias("_s")), "address", "left"), (1 - alpha) * p + alpha * F.coalesce("_s", F.lit(0.0))
        return out.select("address", p.alias("p"), "q")

    def close(self) -> None:
        self.cold.unpersist()
        if self.hot is not None:
            self.hot.unpersist()


def _begun(pi: DataFrame, seed: DataFrame) -> DataFrame:
    """``pi`` with a row for each node of ``seed``, dealt by address."""
    return checkpointed(pi.select("address", "p").union(seed.select("address", F.lit(0.0))).groupBy("address").agg(F.sum("p").alias("p")))


def steps(transitions: DataFrame | Moves, pi: DataFrame, seed: DataFrame, alpha: float, n: int) -> DataFrame:
    """The distribution after ``n`` actions. ``seed`` has a row for every node."""
    own = transitions if isinstance(transitions, Moves) else Moves.of(transitions)
    try:
        with settings(pi.sparkSession, AS_PLANNED):
            last = _begun(pi, seed)
            for _ in range(n):
                both = checkpointed(own.acted(last.select("address", "p"), seed, alpha))
                dropped(last)
                last = both
        return last.select("address", "p")
    finally:
        own.close()


@dataclass(frozen=True)
class Stationary:
    pi: DataFrame
    delta: float
    actions: int


def stationary(transitions: DataFrame | Moves, pi: DataFrame, seed: DataFrame, alpha: float, threshold: float = THRESHOLD, most: int = 255) -> Stationary:
    """Acts until no node's change reaches the threshold; returns the distribution before the last action, and its
    greatest change. ``seed`` has a row for every node. The distribution before stays beside the one after, so looking at
    the change after every action costs no join of its own."""
    own = transitions if isinstance(transitions, Moves) else Moves.of(transitions)
    try:
        with settings(pi.sparkSession, AS_PLANNED):
            last = _begun(pi, seed)
            for k in range(most + 1):
                both = checkpointed(own.acted(last.select("address", "p"), seed, alpha))
                delta = both.agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] or 0.0
                if delta < threshold or k == most:
                    dropped(both)
                    return Stationary(pi if k == 0 else last.select("address", "p"), delta, k + 1)
                dropped(last)
                last = both
        raise AssertionError
    finally:
        own.close()


@dataclass(frozen=True)
class Params:
    alpha: float = 0.1
    beta: float = 0.4
    gamma_forward: float = 0.1
    gamma_backward: float = 0.1

    @property
    def rest(self) -> float:
        r = 1 - (self.alpha + self.beta + self.gamma_forward + self.gamma_backward)
        if min(self.alpha, self.beta, self.gamma_forward, self.gamma_backward) < 0 or r < -1e-12:
            raise ValueError("transition probabilities have to be in [0, 1] and sum to at most one")
        return max(r, 0.0)


SEED = "seed/"


def epoch_node(start: Column, who: Column) -> Column:
    return address("epoch", start, who)


def sum_node(start: Column) -> Column:
    return address("sum", start)


def compile_process(g: Graph, node_weights: DataFrame, edge_weights: DataFrame, participants: DataFrame, p: Params = Params(), attributions: DataFrame | None = None, weeks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The time-expanded process: (nodes (address, mint), transitions (src, dst, kind, pr)).

    node_weights: nodes with weight; edge_weights: edges with forwards and backwards; participants (address, id). Each
    participant has a node for every week; contributions flow to the participant's node of the week in which their
    edge lies (an edge at a week's very start counts to the week before, but not before the first). Those nodes pay a
    share to the week's sum, hand shares to their neighbours in time, and the rest along their edges; whatever isn't
    handed on returns to the seed, which gives it out by minted weight. attributions (from_id, to_id, start_ms,
    proportion): shares of the payment that go to another participant of the same week, from a time on. weeks (start_ms):
    the weeks to span, if not all of the graph's."""
    nodes, moves = _compiled(g, node_weights, edge_weights, participants, p, attributions, weeks)
    return nodes.drop("n"), moves.drop("s", "d")


def _compiled(g: Graph, node_weights: DataFrame, edge_weights: DataFrame, participants: DataFrame, p: Params, attributions: DataFrame | None, weeks: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The process with numbers beside addresses: nodes with n, transitions with s and d. Contributions count from 0, the
    seed is -1, and the weeks' sums and participants' weeks come below; null is no node of the process."""
    weeks = checkpointed(weeks if weeks is not None else week_intervals(g.nodes.select("timestamp_ms").union(g.edges.select("timestamp_ms")), "timestamp_ms"))
    ends = weeks.agg(F.min("start_ms").alias("a"), F.max("start_ms").alias("b")).first()
    if ends.a is None:
        raise ValueError("the graph needs at least one interval")
    step = 604_800_000
    n_weeks = (ends.b - ends.a) // step + 1
    at = lambda start: ((start - ends.a) / step).cast("long")
    sum_n = lambda start: -2 - at(start)
    epoch_n = lambda start, q: F.when(start.between(ends.a, ends.b), -(q * n_weeks + at(start)) - (n_weeks + 2))

    # ids are unique in a frame, and stay as they are once it is written
    people = checkpointed(participants.select(F.col("address").alias("who"), "id", F.monotonically_increasing_id().alias("q")))
    known = g.nodes.select("address").distinct().join(people, F.col("address") == F.col("who"), "left")
    known = checkpointed(known.select("address", "id", "q", F.monotonically_increasing_id().alias("n")))
    plain = known.where("id IS NULL").select("address", "n")
    contributions = checkpointed(node_weights.select("address", F.col("weight").alias("mint")).join(plain, "address"))
    total = contributions.where("mint > 0").agg(F.sum("mint")).first()[0]
    if not total:
        raise ValueError("no node mints")
    grid = people.select("id", "q").join(F.broadcast(weeks.select("start_ms")), F.lit(True))  # each participant has a node a week
    grid = grid.select("id", "q", "start_ms", epoch_node(F.col("start_ms"), F.col("id")).alias("node"), epoch_n(F.col("start_ms"), F.col("q")).alias("n"))

    # edges between contributions and the participants' weekly nodes, both ends among the nodes
    s, d = (known.select(F.col("address").alias(end), F.col("id").alias(f"{x}i"), F.col("q").alias(f"{x}q"), F.col("n").alias(x)) for end, x in (("src", "s"), ("dst", "d")))
    week = F.greatest(week_start(F.col("timestamp_ms") - 1), F.lit(ends.a))
    own = edge_weights.select("src", "dst", "timestamp_ms", "forwards", "backwards").join(s, "src").join(d, "dst")
    for end, x in (("src", "s"), ("dst", "d")):
        person = F.col(f"{x}i").isNotNull()
        own = own.withColumns({end: F.when(person, epoch_node(week, F.col(f"{x}i"))).otherwise(F.col(end)), x: F.when(person, epoch_n(week, F.col(f"{x}q"))).otherwise(F.col(x))})
    both = own.select(F.inline(F.array(
        F.struct(F.col("src"), F.col("dst"), F.col("s"), F.col("d"), F.col("si").isNotNull().alias("person"), F.col("forwards").alias("w")),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("d").alias("s"), F.col("s").alias("d"), F.col("di").isNotNull().alias("person"), F.col("backwards").alias("w")),
    ))).where("w > 0")
    both = checkpointed(both)
    totals = totals_of(both, "w", "s")
    base = _shared(both, totals, "w", "s").select("src", "dst", "s", "d", F.lit("edge").alias("kind"), (F.col("pr") * F.when(F.col("person"), p.rest).otherwise(1 - p.alpha)).alias("pr"))

    seed_n = F.lit(-1).cast("long")
    minted = contributions.where("mint > 0").select(F.lit(SEED).alias("src"), F.col("address").alias("dst"), seed_n.alias("s"), F.col("n").alias("d"), F.lit("mint").alias("kind"), (F.col("mint") / total).alias("pr"))
    paid = grid.withColumn("given", F.lit(0.0))
    given = None
    if attributions is not None:
        given = _attributed(grid, attributions)
        out = given.groupBy("node").agg(F.sum("proportion").alias("given"))
        paid = grid.join(out, "node", "left").withColumn("given", F.coalesce("given", F.lit(0.0)))
    start = F.col("start_ms")
    payout = paid.select(F.col("node").alias("src"), sum_node(start).alias("dst"), F.col("n").alias("s"), sum_n(start).alias("d"), F.lit("payout").alias("kind"), (p.beta * (1 - F.col("given"))).alias("pr"))
    ahead, back = F.least(start + step, F.lit(ends.b)), F.greatest(start - step, F.lit(ends.a))
    to = lambda when, kind, pr: F.struct(F.col("node").alias("src"), epoch_node(when, F.col("id")).alias("dst"), F.col("n").alias("s"), epoch_n(when, F.col("q")).alias("d"), F.lit(kind).alias("kind"), F.lit(pr).alias("pr"))
    web = grid.select(F.inline(F.array(to(ahead, "forward", p.gamma_forward), to(back, "backward", p.gamma_backward))))
    moves = base.unionByName(minted).unionByName(payout).unionByName(web)
    if given is not None:
        gets = given.where("proportion <> 0").join(people.select(F.col("id").alias("to_id"), F.col("q").alias("_q")), "to_id", "left")
        moves = moves.unionByName(gets.select(F.col("node").alias("src"), epoch_node(start, F.col("to_id")).alias("dst"), F.col("n").alias("s"), epoch_n(start, F.col("_q")).alias("d"), F.lit("attribution").alias("kind"), (p.beta * F.col("proportion")).alias("pr")))
    sums = weeks.select(sum_node(start).alias("address"), F.lit(0.0).alias("mint"), sum_n(start).alias("n"))
    # what a node hands on besides its edges is the same for all nodes of its sort, so no sum over all rows is needed
    kept = p.beta + p.gamma_forward + p.gamma_backward
    sorts = ((contributions, 0.0, 1 - p.alpha), (grid.select(F.col("node").alias("address"), F.lit(0.0).alias("mint"), "n"), kept, p.rest), (sums, 0.0, 0.0))
    some = reduce(DataFrame.unionByName, (x.withColumns({"_f": F.lit(fixed), "_e": F.lit(along)}) for x, fixed, along in sorts))
    met = some.join(totals.select(F.col("s").alias("n"), "_t"), "n", "left")
    left = 1 - (F.col("_f") + F.when(F.col("_t").isNotNull(), F.col("_e")).otherwise(0.0))
    radiated = met.select(F.col("address").alias("src"), F.lit(SEED).alias("dst"), F.col("n").alias("s"), seed_n.alias("d"), F.lit("radiation").alias("kind"), left.alias("pr"))
    seed = weeks.sparkSession.range(1).select(F.lit(SEED).alias("address"), F.lit(0.0).alias("mint"), seed_n.alias("n"))
    return some.select("address", "mint", "n").unionByName(seed), moves.unionByName(radiated)


def _attributed(grid: DataFrame, attributions: DataFrame) -> DataFrame:
    """(node, start_ms, to_id, proportion) in force in each week."""
    packed = attributions.groupBy(F.col("from_id").alias("id"), "to_id").agg(F.sort_array(F.collect_list(F.struct("start_ms", "proportion"))).alias("p"))
    met = grid.join(packed, "id")
    begun = F.filter("p", lambda x: x["start_ms"] <= F.col("start_ms"))
    found = met.select("node", "n", "start_ms", "to_id", F.when(F.size(begun) > 0, F.element_at(begun, -1)["proportion"]).otherwise(0.0).alias("proportion"))
    over = F.sum("proportion").over(Window.partitionBy("node")) > 1 + 1e-12
    bad = F.when(over | ~F.col("proportion").between(0, 1), F.raise_error(F.lit("attributions of one participant and week have to be in [0, 1] and sum to at most one")).cast("double"))
    return found.withColumn("proportion", F.coalesce(bad, "proportion"))


def scores(nodes: DataFrame, pi: DataFrame) -> DataFrame:
    """(address, score): the distribution, scaled so that the weekly sums together hold what was minted."""
    minted = nodes.agg(F.sum("mint").alias("minted"))
    held = pi.where(F.startswith("address", F.lit("sum/"))).agg(F.sum("p").alias("held"))
    return pi.join(F.broadcast(minted), F.lit(True)).join(F.broadcast(held), F.lit(True)).select("address", (F.col("p") / F.col("held") * F.col("minted")).alias("score"))


def participant_scores(scored: DataFrame, transitions: DataFrame) -> DataFrame:
    """(id, start_ms, score): what each participant's weekly node pays to the week's sum."""
    paid = transitions.where("kind = 'payout'").join(scored.withColumnRenamed("address", "src"), "src")
    part = F.split("src", "/")
    return paid.select(part[2].alias("id"), part[1].cast("long").alias("start_ms"), (F.col("score") * F.col("pr")).alias("score"))


def flows(scored: DataFrame, transitions: DataFrame) -> DataFrame:
    """Transitions with ``flow``: the score of the source times the probability."""
    return transitions.join(scored.withColumnRenamed("address", "src"), "src").withColumn("flow", F.col("score") * F.col("pr")).drop("score")


def rank(g: Graph, node_weights: DataFrame, edge_weights: DataFrame, participants: DataFrame, p: Params = Params(), attributions: DataFrame | None = None, n_steps: int | None = None, weeks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(scores, transitions) of a graph; to convergence (an error where it isn't reached), or after a fixed number of
    actions."""
    nodes, moves = _compiled(g, node_weights, edge_weights, participants, p, attributions, weeks)
    nodes = checkpointed(nodes)
    own = checkpointed(chain(moves.select(F.col("s").alias("src"), F.col("d").alias("dst"), "pr").where("dst IS NOT NULL")))
    check_stochastic(own)
    pi = uniform(nodes.select(F.col("n").alias("address")))
    named = lambda found: scores(nodes, found.withColumnRenamed("address", "n").join(nodes, "n").select("address", "p"))
    moves = moves.drop("s", "d")
    if n_steps is not None:
        return named(steps(Moves.laid(own), pi, pi, 0.0, n_steps)), moves
    found = stationary(Moves.laid(own), pi, pi, 0.0)
    if found.delta >= THRESHOLD:
        raise ValueError(f"the distribution still changes by {found.delta} after {found.actions} actions")
    return named(found.pi), moves


def in_neighbors(transitions: DataFrame, address_: str) -> DataFrame:
    """Transitions that end at a node."""
    return transitions.where(F.col("dst") == address_)
