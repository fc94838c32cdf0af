"""Weekly ranks with decaying weights."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritgraph.functions.weeks import WEEK, week_start
from meritgraph.operators.graph import Graph, solid
from meritgraph.operators.frames import AS_PLANNED, checkpointed, dealt, dropped, hot_of, parts_for, settings
from meritgraph.operators.markov import LOOP, STEPS_A_CHECKPOINT, Moves


def decayed_nodes(weighted: DataFrame, weeks: DataFrame, decay: float) -> DataFrame:
    """(start_ms, address, weight): w (1 - decay) decay^k in the k-th week from the node's own on."""
    own = weighted.where("timestamp_ms IS NOT NULL").withColumn("own", week_start(F.col("timestamp_ms")))
    later = own.join(F.broadcast(weeks.select("start_ms")), F.col("start_ms") >= F.col("own"))
    k = (F.col("start_ms") - F.col("own")) / WEEK
    return later.select("start_ms", "address", (F.col("weight") * (1 - decay) * F.pow(F.lit(decay), k)).alias("weight"))


def decayed_edges(g: Graph, edge_weights: DataFrame, weeks: DataFrame, decay: float) -> DataFrame:
    """(start_ms, src, dst, forwards, backwards): w decay^k."""
    own = solid(Graph(g.nodes, edge_weights)).withColumn("own", week_start(F.col("timestamp_ms")))
    later = own.join(F.broadcast(weeks.select("start_ms")), F.col("start_ms") >= F.col("own"))
    f = F.pow(F.lit(decay), (F.col("start_ms") - F.col("own")) / WEEK)
    return later.select("start_ms", "src", "dst", (F.col("forwards") * f).alias("forwards"), (F.col("backwards") * f).alias("backwards"))


#: Weeks that are worked on together; each such block starts from the last week before it.
WEEKS_AT_ONCE = 8


@dataclass(frozen=True)
class Timeline:
    """ranks (start_ms, address, p), and what they came from: moves (start_ms, src, dst, pr), seeds (start_ms, address,
    p)."""

    ranks: DataFrame
    moves: DataFrame
    seeds: DataFrame
    alpha: float

    def flows(self) -> DataFrame:
        """(start_ms, src, dst, kind, flow): what each node gets along each connection (``edge``), from itself (``loop``)
        and from the seed (``seed``); for a node of a week they add up to its rank where the ranks have converged."""
        met = self.moves.join(self.ranks.withColumnRenamed("address", "src"), ["start_ms", "src"])
        kind = F.when(F.col("src") == F.col("dst"), "loop").otherwise("edge")
        own = met.select("start_ms", "src", "dst", kind.alias("kind"), (F.col("p") * F.col("pr") * (1 - self.alpha)).alias("flow"))
        seed = self.seeds.where("p > 0").select("start_ms", F.lit(None).cast("string").alias("src"), F.col("address").alias("dst"), F.lit("seed").alias("kind"), (F.col("p") * self.alpha).alias("flow"))
        return own.unionByName(seed)


def timeline(g: Graph, weighted: DataFrame, edge_weights: DataFrame, weeks: DataFrame, decay: float = 0.5, alpha: float = 0.2, n_steps: int | None = None, threshold: float = 1e-7, most: int = 255, at_once: int = WEEKS_AT_ONCE) -> Timeline:
    """Each week's rank, seeded by the week's decayed node weights (uniform where a week has none); until an action
    changes no node of any week by ``threshold``, which is an error after ``most`` actions, or after a fixed number of
    actions from the seeds. ``at_once`` weeks are ranked together, from the last rank of the weeks before. The change is
    looked at every few actions. There, the last two distributions are averaged so that the next change is least, which
    ends the swing between participants and contributions that an action only damps by ``1 - alpha``; a mean of two
    distributions is one, so at worst it costs one action in as many as lie between two looks.

    A node is one row for all weeks of a block, a column a week, and so is what flows into it; an edge is held once with
    its weight, and its decay is worked out as it is met. Only flow along edges is shuffled: loops, seeds and what hot
    nodes bring are added where the node's row lies, and rows are dealt to as many parts as their number asks for."""
    all_weeks = sorted(r.start_ms for r in weeks.select("start_ms").collect())  # a number a week
    if not all_weeks:
        raise ValueError("no weeks")
    own = weighted.where("timestamp_ms IS NOT NULL").select(F.col("address").alias("a"), "weight", week_start(F.col("timestamp_ms")).alias("own"))
    nodes = checkpointed(g.nodes.select("address").join(own, F.col("address") == F.col("a"), "left").select("address", F.monotonically_increasing_id().alias("id"), "weight", "own"))
    ids = nodes.select("address", "id")
    end = lambda x: ids.select(F.col("address").alias(x), F.col("id").alias(f"{x}_id"))
    solid = edge_weights.where("timestamp_ms IS NOT NULL").join(end("src"), "src").join(end("dst"), "dst")
    both = checkpointed(solid.select(week_start(F.col("timestamp_ms")).alias("own"), F.inline(F.array(
        F.struct(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), F.col("forwards").alias("w")),
        F.struct(F.col("dst_id").alias("src"), F.col("src_id").alias("dst"), F.col("backwards").alias("w")),
    ))))
    parts, done, last = str(parts_for(both)), [], None
    for at in range(0, len(all_weeks), at_once):
        block = _Block(all_weeks[at : at + at_once], ids, nodes, both, decay, alpha)
        with settings(ids.sparkSession, AS_PLANNED | {"spark.sql.shuffle.partitions": parts}):
            last = block.ranked(n_steps, threshold, most, last)
        done.append(block.told(last))
        last = last.select("id", F.col(f"p{len(block.weeks) - 1}").alias("p"))
    of = lambda name: reduce(DataFrame.unionByName, (getattr(t, name) for t in done))
    return Timeline(of("ranks"), of("moves"), of("seeds"), alpha)


def _merged(a: DataFrame, b: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Joined as both lie, dealt and sorted: a broadcast of a side would be made anew in each action."""
    return a.join(b.hint("merge"), key, how)


@dataclass(frozen=True)
class _Block:
    """Weeks that are ranked together: nodes (id, weight, own) and both directions of edges (src, dst, w, own), ``own``
    their week."""

    weeks: list[int]
    ids: DataFrame
    nodes: DataFrame
    both: DataFrame
    decay: float
    alpha: float

    def _begun(self, rows: DataFrame, w: str) -> DataFrame:
        """``at``: the first week of the block that has the row (null: none), and ``w`` as it is then."""
        at = F.coalesce(*(F.when(F.col("own") <= s, k) for k, s in enumerate(self.weeks)))
        start = F.element_at(F.array(*(F.lit(s) for s in self.weeks)), at + 1)
        return rows.withColumn("at", at).withColumn(w, F.col(w) * F.pow(F.lit(self.decay), (start - F.col("own")) / WEEK)).drop("own")

    def _of(self, w: str, k: int) -> Column:
        """``w`` in the k-th week."""
        since = [self.decay ** ((self.weeks[k] - s) / WEEK) if s <= self.weeks[k] else 0.0 for s in self.weeks]
        return F.when(F.col("at") <= k, F.col(w) * F.array(*(F.lit(float(x)) for x in since))[F.col("at")]).otherwise(0.0)

    @property
    def _all(self) -> range:
        return range(len(self.weeks))

    def _named(self, letters: str) -> list[str]:
        return [f"{x}{k}" for x in letters for k in self._all]

    @cached_property
    def edges(self) -> DataFrame:
        return self._begun(self.both, "w").where("at IS NOT NULL")

    @cached_property
    def table(self) -> DataFrame:
        """(id, seed and total of outgoing weight in each week, number of outgoing edges)."""
        out = self.edges.groupBy("src").agg(*(F.sum(self._of("w", k)).alias(f"t{k}") for k in self._all), F.count(F.lit(1)).alias("n"))
        own = self._begun(self.nodes, "weight")
        seeds = own.select("id", *(F.coalesce(self._of("weight", k) * (1 - self.decay), F.lit(0.0)).alias(f"s{k}") for k in self._all))
        sums = seeds.agg(F.count(F.lit(1)), *(F.sum(f"s{k}") for k in self._all)).first()  # a number a week
        share = lambda k: F.col(f"s{k}") / F.lit(sums[k + 1]) if sums[k + 1] and sums[k + 1] > 0 else F.lit(1.0 / max(sums[0], 1))
        met = seeds.join(out, F.col("id") == F.col("src"), "left")
        return checkpointed(met.select("id", *(share(k).alias(f"s{k}") for k in self._all), *((F.coalesce(f"t{k}", F.lit(0.0)) + LOOP).alias(f"t{k}") for k in self._all), F.coalesce("n", F.lit(0)).alias("n")))

    def ranked(self, n_steps: int | None, threshold: float, most: int, last: DataFrame | None) -> DataFrame:
        """(id, p of each week). What an action hands to the next is ``q``, a node's probability over its total, which the
        weights of its edges and its loop are multiplied with. Where a change is looked at, ``h`` is the ``q`` before, and
        the next action starts from the mean of both that would change least, in the sum of squares (``n`` over ``d``)."""
        hot = hot_of(self.table.select(F.col("id").alias("src"), "n"), "src", "n")
        moves, nodes = Moves.laid(self.edges, hot), dealt(self.table.drop("n"), "id")
        anew = last is None or n_steps is not None
        begun = (nodes if anew else _merged(nodes, last, "id")).select("id", *(F.col(f"s{k}" if anew else "p").alias(f"p{k}") for k in self._all), *self._named("t"))
        over = [(F.col(f"p{k}") / F.col(f"t{k}")).alias(f"q{k}") for k in self._all]
        try:
            pi = checkpointed(begun.select("id", *(self._named("p") if n_steps == 0 else []), *over))
            own = pi.select("id", *self._named("q"))
            for step in range(1, (most if n_steps is None else n_steps) + 1):
                looked, next_is = (n_steps is None and (step + i) % STEPS_A_CHECKPOINT == 0 for i in (0, 1))
                now, flow = _merged(nodes, own, "id"), [LOOP * F.col(f"q{k}") for k in self._all]
                for i, met in enumerate(moves.met(own.select(F.col("id").alias("src"), *self._named("q")).hint("merge"))):
                    came = met.groupBy(F.col("dst").alias("id")).agg(*(F.sum(F.col(f"q{k}") * self._of("w", k)).alias(f"f{i}_{k}") for k in self._all))
                    now, flow = _merged(now, came, "id", "left"), [x + F.coalesce(f"f{i}_{k}", F.lit(0.0)) for k, x in enumerate(flow)]
                p = [(self.alpha * F.col(f"s{k}") + (1 - self.alpha) * x).alias(f"p{k}") for k, x in enumerate(flow)]
                acted = now.select("id", *p, *self._named("tqh" if looked else "tq"))
                before = [F.col(f"q{k}").alias(f"h{k}") for k in self._all] if looked or next_is else []
                if looked:
                    changes = [(F.col(f"p{k}") - F.col(f"q{k}") * F.col(f"t{k}")).alias(f"c{k}") for k in self._all]
                    turns = [(2 * F.col(f"q{k}") * F.col(f"t{k}") - F.col(f"p{k}") - F.col(f"h{k}") * F.col(f"t{k}")).alias(f"d{k}") for k in self._all]
                    acted = acted.select("id", *self._named("p"), *over, *before, *changes, *turns)
                    most_of = F.greatest(F.lit(0.0), *(F.abs(f"c{k}") for k in self._all)).alias("change")
                    acted = acted.select("id", *self._named("pqh"), most_of, *((-F.col(f"c{k}") * F.col(f"d{k}")).alias(f"n{k}") for k in self._all), *((F.col(f"d{k}") * F.col(f"d{k}")).alias(f"d{k}") for k in self._all))
                else:
                    acted = acted.select("id", *(self._named("p") if step == n_steps else []), *over, *before)
                done, pi = pi, checkpointed(acted)
                dropped(done)
                own = pi.select("id", *self._named("qh" if next_is else "q"))
                if looked:
                    change, *sums = pi.agg(F.max("change"), *(F.sum(x) for x in self._named("nd"))).first()  # two numbers a week
                    if (change or 0.0) < threshold:
                        return pi.select("id", *self._named("p"))
                    back = [min(1.0, max(0.0, n / d)) if d and d > 0 else 0.0 for n, d in zip(sums[: len(self.weeks)], sums[len(self.weeks) :])]
                    own = pi.select("id", *((F.col(f"q{k}") * (1 - x) + F.col(f"h{k}") * x).alias(f"q{k}") for k, x in enumerate(back)))
        finally:
            moves.close()
            nodes.unpersist()
        if n_steps is None:
            raise ValueError(f"the weeks' ranks still change by {threshold} or more after {most} actions")
        return pi.select("id", *self._named("p"))

    def told(self, pi: DataFrame) -> Timeline:
        """The ranks with what they came from, a row for each week."""
        long = lambda rows, x: rows.select("address", F.inline(F.array(*(F.struct(F.lit(s).alias("start_ms"), F.col(f"{x}{k}").alias("p")) for k, s in enumerate(self.weeks))))).select("start_ms", "address", "p")
        named = self.table.join(self.ids, "id")
        end = lambda x: self.ids.select(F.col("id").alias(x), F.col("address").alias(f"{x}_address"))
        pr = F.inline(F.filter(F.array(*(F.struct(F.lit(s).alias("start_ms"), F.lit(k).alias("k"), (self._of("w", k) / F.col(f"t{k}")).alias("pr")) for k, s in enumerate(self.weeks))), lambda x: x["k"] >= F.col("at")))
        loop = F.inline(F.array(*(F.struct(F.lit(s).alias("start_ms"), (LOOP / F.col(f"t{k}")).alias("pr")) for k, s in enumerate(self.weeks))))
        along = self.edges.join(self.table.withColumnRenamed("id", "src"), "src").select("src", "dst", pr).drop("k")
        moves = along.unionByName(self.table.select(F.col("id").alias("src"), F.col("id").alias("dst"), loop)).groupBy("start_ms", "src", "dst").agg(F.sum("pr").alias("pr"))
        moves = moves.join(end("src"), "src").join(end("dst"), "dst").select("start_ms", F.col("src_address").alias("src"), F.col("dst_address").alias("dst"), "pr")
        return Timeline(long(pi.join(self.ids, "id"), "p"), moves, long(named, "s"), self.alpha)


def to_scores(ranks: DataFrame, mint: DataFrame, scoring: str) -> DataFrame:
    """(start_ms, address, score): ranks scaled by the week's weight over what the scoring nodes hold; 0 where they
    hold nothing. mint (start_ms, mint)."""
    held = ranks.where(F.startswith("address", F.lit(scoring))).groupBy("start_ms").agg(F.sum("p").alias("held"))
    scale = mint.join(held, "start_ms", "left").select("start_ms", F.when(F.col("held") > 0, F.col("mint") / F.col("held")).otherwise(0.0).alias("scale"))
    return ranks.join(F.broadcast(scale), "start_ms", "left").select("start_ms", "address", (F.col("p") * F.coalesce("scale", F.lit(0.0))).alias("score"))  # a row a week
