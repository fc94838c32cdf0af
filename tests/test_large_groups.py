"""Steps whose memory or time grew faster than their input."""

import numpy as np
from pyspark.sql import functions as F

from meritgraph.functions.weeks import week_intervals
from meritgraph.operators import expressions, forge, frames, markov, mirror, timeline, weights
from meritgraph.operators.frames import AS_PLANNED, settings
from meritgraph.operators.graph import Graph
from meritgraph.plans import domain, registry, score_queries
from oracle import SF


def test_scoring_reads_weights_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(w):
        read.add(1)
        return w

    trees = spark.createDataFrame([(1, "0", "ADD"), (1, "0.0", "MULTIPLY"), (1, "0.1", "FIRST"), (1, "0.0.0", "MAX"), (2, "0", "AVERAGE")], "contribution long, path string, operator string")
    rows = [(1, "0.0", 0, 2.0, False), (1, "0.0", 1, 3.0, False), (1, "0.0.0", 0, 9.0, False), (1, "0.0.0", 1, 5.0, True), (1, "0.1", 0, 4.0, False), (1, "0.1", 1, 7.0, True), (2, "0", 0, 1.0, False), (2, "0", 1, 4.0, False)]
    operands = spark.createDataFrame(rows, "contribution long, path string, ord int, weight double, explicit boolean").withColumn("weight", F.udf(seen, "double").asNondeterministic()("weight"))
    found = {(r.contribution, r.path): r.score for r in expressions.score_trees(trees, operands, 3).collect()}
    assert found == {(1, "0"): 37.0, (1, "0.0"): 30.0, (1, "0.1"): 7.0, (1, "0.0.0"): 5.0, (2, "0"): 2.5}
    assert read.value == len(rows)


def test_events_of_one_split_are_parsed_by_many_tasks(spark):
    lines = score_queries._contribution_lines(spark, SF)
    assert lines.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_equal_edges_meet_without_a_sort_of_all(spark):
    entities = spark.createDataFrame([("repo", "o/r", None, None, "r", None, None, None), ("pull", "o/r/1", "repository/repo/o/r/", "a", "p", 5, None, None)], "kind string, key string, parent string, author string, description string, ms long, merged_as string, hash string")
    reactions = spark.createDataFrame([("repository/pull/o/r/1/", "HEART", "b", ms) for ms in (9, 7, 8)], "target string, kind string, author string, ms long")
    edges = forge.graph(entities, reactions, spark.createDataFrame([], "src string, dst string, ms long"))[0].edges
    assert sorted((r.address, r.timestamp_ms) for r in edges.collect()) == [
        ("repository/authors/repository/user/a/repository/pull/o/r/1/", 5), ("repository/hasParent/repository/pull/o/r/1/repository/repo/o/r/", 5), ("repository/heart/repository/user/b/repository/pull/o/r/1/", 7),
    ]
    assert "SortAggregate" not in edges._jdf.queryExecution().executedPlan().toString()


def test_few_weights_are_tested_without_lists_of_prefixes(spark):
    rows = spark.createDataFrame([("a/b/c/",), ("a/bc/",), ("b/",), ("",)], "address string")
    few = spark.createDataFrame([("", 3.0), ("a/", 0.5), ("a/b/", 7.0), ("a/b/c", 100.0)], "prefix string, weight double")
    found = weights.with_products(rows, few, ["weight"])
    assert {r.address: r.weight for r in found.collect()} == {"a/b/c/": 10.5, "a/bc/": 1.5, "b/": 3.0, "": 3.0}
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_events_of_one_split_become_a_graph_by_many_tasks(spark):
    g = domain.kept_graph(spark, SF)
    assert min(x.rdd.getNumPartitions() for x in (g.nodes, g.edges)) >= 4 * spark.sparkContext.defaultParallelism


def test_an_action_shuffles_only_what_flows_from_sources_that_are_not_hot(spark):
    pairs = [("seed", f"n{i:05}", 1 / 3_000) for i in range(3_000)] + [(f"n{i:05}", "seed", 1.0) for i in range(3_000)]
    transitions = spark.createDataFrame(pairs, "src string, dst string, pr double")
    own = markov.Moves.of(transitions)
    assert own.sources.count() == 1
    with settings(spark, AS_PLANNED):
        pi = markov._begun(transitions.select(F.col("src").alias("address")).distinct().withColumn("p", F.lit(1 / 3_001)), transitions.selectExpr("src AS address").distinct())
        both = own.acted(pi, pi, 0.0)
        assert {r.address: round(r.p, 9) for r in both.collect()} == {"seed": round(3_000 / 3_001, 9)} | {f"n{i:05}": round(1 / 3_000 / 3_001, 9) for i in range(3_000)}
        shuffles = [x for x in both._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines() if "Exchange hashpartitioning" in x and "ENSURE_REQUIREMENTS" in x]
    assert len(shuffles) == 1, shuffles
    own.close()


def test_a_timelines_action_has_no_more_tasks_than_its_rows_ask_for(spark, monkeypatch):
    g = domain.kept_graph(spark, SF)
    own, along = domain.node_weights(spark, g), domain.edge_weights(spark, g)
    weeks = markov.checkpointed(week_intervals(g.nodes, "timestamp_ms"))
    begun = lambda: spark.sparkContext._jsc.sc().taskScheduler().nextTaskId()

    def ranked(n):
        before = begun()
        found = timeline.timeline(g, own, along, weeks, n_steps=n).ranks
        return begun() - before, {(r.start_ms, r.address): r.p for r in found.collect()}

    with settings(spark, {"spark.sql.shuffle.partitions": "64"}):
        (few, _), (many, ranks) = ranked(2), ranked(6)
        assert many - few <= 4 * 16
        monkeypatch.setattr(frames, "LEAST_HOT", 5)  # what hot nodes bring is added apart
        hot = ranked(6)[1]
    assert hot.keys() == ranks.keys() and all(abs(hot[k] - ranks[k]) < 1e-12 for k in hot)


def test_a_timelines_swing_between_two_sides_ends_early(spark):
    week, at = 1_642_896_000_000, {"c/1/": 0, "c/2/": 1, "p/1/": 2, "p/2/": 3}
    weighted = spark.createDataFrame([("c/1/", week, 1.0), ("c/2/", week, 2.0), ("p/1/", None, 0.0), ("p/2/", None, 0.0)], "address string, timestamp_ms long, weight double")
    rows = [("e/1/", "c/1/", "p/1/", week, 1.0, 0.5), ("e/2/", "c/2/", "p/2/", week, 2.0, 1.0), ("e/3/", "p/2/", "c/1/", week, 0.5, 0.25)]
    along = spark.createDataFrame(rows, "address string, src string, dst string, timestamp_ms long, forwards double, backwards double")
    found = timeline.timeline(Graph(weighted, along), weighted, along, spark.createDataFrame([(week,)], "start_ms long"), most=30).ranks.collect()
    m = markov.LOOP * np.eye(4)
    for _, a, b, _, f, g in rows:
        m[at[a], at[b]] += f
        m[at[b], at[a]] += g
    seed = np.array([1 / 3, 2 / 3, 0, 0])
    want = np.linalg.solve(np.eye(4) - 0.8 * (m / m.sum(1, keepdims=True)).T, 0.2 * seed)
    assert len(found) == 4 and all(abs(r.p - want[at[r.address]]) < 5e-7 for r in found)
    assert abs(sum(r.p for r in found) - 1) < 1e-12


def test_a_mirror_folds_only_the_facts_that_are_asked_for(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(x):
        read.add(1)
        return x

    of = spark.createDataFrame
    links = of([("a", "author", "u", 1)], "id string, field string, child string, seq int").withColumn("child", F.udf(seen, "string").asNondeterministic()("child"))
    facts = of([("a", "X", 1), ("u", "U", 1)], "id string, typename string, seq int"), of([("u", "login", '"me"', 1)], "id string, field string, value string, seq int"), links, of([("a", "all", 0, "u", 1)], "id string, field string, ord long, child string, seq int")
    s = mirror.folded(mirror.Store(*facts), of([("x",)], "id string"), False)
    assert [tuple(r) for r in mirror.parents(s, "all").collect()] == [("u", "a")] and read.value == 0
    assert [r.child for r in s.links.collect()] == ["u"] and read.value == 1


def test_a_forums_lines_are_put_together_once(spark):
    assert not [x for x in registry.QUERIES["forum_edges"](spark, SF).inputFiles() if "lineitem" in x]
