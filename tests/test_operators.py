import inspect
import json
import math
import random
from decimal import Decimal

import numpy as np
import pytest
from oracle import SF
from pyspark.sql import functions as F

from meritgraph.functions.addresses import is_address, prefixes
from meritgraph.functions.money import plain, split_budget
from meritgraph.functions.weeks import WEEK, week_intervals, week_start
from meritgraph.operators import builders, expressions, frames, graph, intervals, ledger, ledger_state, markov, order, payouts, references, timeline, views, weights
from meritgraph.operators.asof import asof_join
from meritgraph.operators.graph import Graph
from meritgraph.plans import domain, graph_queries, registry
from meritgraph.sources import contributions, exports, ledger_log, tables
from meritgraph.streaming import weekly

NODE = "address string, description string, timestamp_ms long"
EDGE = "address string, src string, dst string, timestamp_ms long"
W1 = 1_642_896_000_000


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_addresses(spark):
    assert one(spark, prefixes(F.lit("a/b/"))) == ["", "a/", "a/b/"]
    assert one(spark, prefixes(F.lit(""))) == [""]
    assert [one(spark, is_address(F.lit(x))) for x in ("", "a/", "a", "/", "a//")] == [True, True, False, False, False]


def test_weeks_begin_on_sunday(spark):
    assert one(spark, week_start(F.lit(W1))) == W1
    assert one(spark, week_start(F.lit(W1 - 1))) == W1 - WEEK
    assert one(spark, week_start(F.lit(W1 + WEEK - 1))) == W1


def example(spark, edge_rows):
    nodes = spark.createDataFrame([("c/0/", "", W1, 1.0), ("c/1/", "", W1 + WEEK, 2.0), ("p/1/", "", None, 0.0), ("p/2/", "", None, 0.0)], NODE + ", weight double")
    edges = spark.createDataFrame(edge_rows, EDGE + ", forwards double, backwards double")
    people = spark.createDataFrame([("p/1/", "1"), ("p/2/", "2")], "address string, id string")
    weeks = spark.createDataFrame([(W1,), (W1 + WEEK,)], "start_ms long")
    return Graph(nodes.drop("weight"), edges.drop("forwards", "backwards")), nodes, edges, people, weeks


EDGES = [("e/0/", "c/0/", "p/1/", W1 + 1, 1.0, 0.0), ("e/1/", "c/1/", "p/1/", W1 + WEEK + 1, 2.0, 1.0), ("e/2/", "c/0/", "c/1/", W1 + 2 * WEEK, 1.0, 1.0), ("e/3/", "c/0/", "c/1/", W1 + 2 * WEEK, 0.0, 0.0)]


def test_rank_has_the_known_scores(spark):
    g, nodes, edges, people, weeks = example(spark, EDGES)
    scored, moves = markov.rank(g, nodes, edges, people, markov.Params(0.2, 0.2, 0.15, 0.1), weeks=weeks)
    got = {(r.id, r.start_ms): r.score for r in markov.participant_scores(scored, moves).collect()}
    assert got[("1", W1)] == pytest.approx(0.9479471812187605, abs=1e-9)
    assert got[("1", W1 + WEEK)] == pytest.approx(2.0520521567464285, abs=1e-9)
    assert got[("2", W1)] + got[("2", W1 + WEEK)] == pytest.approx(1.286615549244117e-19, abs=1e-9)
    markov.check_stochastic(moves)


def test_attributions_move_payments(spark):
    g, nodes, edges, people, weeks = example(spark, EDGES)
    given = spark.createDataFrame([("1", "2", 0, 0.5)], "from_id string, to_id string, start_ms long, proportion double")
    scored, moves = markov.rank(g, nodes, edges, people, markov.Params(0.2, 0.2, 0.15, 0.1), given, weeks=weeks)
    got = {r.id: r.s for r in markov.participant_scores(scored, moves).groupBy("id").agg(F.sum("score").alias("s")).collect()}
    assert got["2"] > 0.5 and sum(got.values()) == pytest.approx(3.0)
    markov.check_stochastic(moves)


def test_stationary_distribution_of_a_matrix(spark):
    moves = markov.chain_from_matrix(spark, [[1, 0, 0], [0.25, 0, 0.75], [0.25, 0.75, 0]])
    pi = spark.createDataFrame([("0", 1 / 3), ("1", 1 / 3), ("2", 1 / 3)], "address string, p double")
    found = markov.stationary(moves, pi, pi, 0.0)
    assert {r.address: round(r.p, 5) for r in found.pi.collect()} == {"0": 1.0, "1": 0.0, "2": 0.0}
    assert found.delta < 1e-7
    assert markov.stationary(moves, pi, pi, 0.0, most=0).pi is pi
    with pytest.raises(ValueError):
        markov.chain_from_matrix(spark, [[0.5, 0.6], [1, 0]])


def test_converged_timeline_is_each_weeks_own_rank(spark):
    g = domain.event_graph(spark, SF)
    nodes, edges = domain.node_weights(spark, g), domain.edge_weights(spark, g)
    weeks = week_intervals(g.nodes, "timestamp_ms")
    at = {r.address: i for i, r in enumerate(g.nodes.select("address").collect())}
    seeds, moves, want = {}, {}, {}
    for r in timeline.decayed_nodes(nodes, weeks, 0.5).collect():
        seeds.setdefault(r.start_ms, np.zeros(len(at)))[at[r.address]] = r.weight
    for r in timeline.decayed_edges(g, edges, weeks, 0.5).collect():
        m = moves.setdefault(r.start_ms, np.zeros((len(at), len(at))))
        m[at[r.src], at[r.dst]] += r.forwards
        m[at[r.dst], at[r.src]] += r.backwards
    for w in (r.start_ms for r in weeks.collect()):
        m = moves.get(w, np.zeros((len(at), len(at)))) + markov.LOOP * np.eye(len(at))
        seed = seeds.get(w, np.zeros(len(at)))
        seed = seed / seed.sum() if seed.sum() else np.full(len(at), 1 / len(at))
        want[w] = np.linalg.solve(np.eye(len(at)) - 0.8 * (m / m.sum(1, keepdims=True)).T, 0.2 * seed)
    got = registry.QUERIES["timeline_rank_converged"](spark, SF).collect()
    assert len(got) == len(want) * sum(a.startswith("user/") for a in at)
    assert all(abs(r.p - want[r.start_ms][at[r.address]]) < 1e-6 for r in got)
    scored = {r.start_ms: r.score for r in registry.QUERIES["timeline_scores_converged"](spark, SF).collect()}
    assert set(scored) <= set(want)
    with pytest.raises(ValueError):
        timeline.timeline(g, nodes, edges, weeks, most=5)
    both = [timeline.timeline(g, nodes, edges, weeks, threshold=1e-10, at_once=n) for n in (1, 8)]
    by_week, at_once = ({(r.start_ms, r.address): r.p for r in t.ranks.collect()} for t in both)
    assert by_week.keys() == at_once.keys() and all(abs(by_week[k] - at_once[k]) < 1e-7 for k in by_week)
    got = {(r.start_ms, r.dst): r.x for r in both[0].flows().groupBy("start_ms", "dst").agg(F.sum("flow").alias("x")).collect()}
    assert all(abs(got[k] - by_week[k]) < 1e-7 for k in by_week)
    assert {r.kind for r in both[0].flows().select("kind").distinct().collect()} == {"edge", "loop", "seed"}


def test_steps_leave_no_more_on_disk(spark):
    """Checkpoints of earlier steps are deleted, and none holds a node once a week."""
    g = domain.kept_graph(spark, SF)
    nodes, edges = domain.node_weights(spark, g), domain.edge_weights(spark, g)
    weeks = markov.checkpointed(week_intervals(g.nodes, "timestamp_ms"))
    moves = markov.checkpointed(markov.chain(markov.connections(g, edges)))
    seed = markov.checkpointed(markov.weighted(nodes, "weight"))
    held = lambda: len(spark.sparkContext._jvm.java.io.File(frames.shared_folder(spark).removeprefix("file:")).list())

    def left(work):
        before = held()
        work()
        return held() - before

    assert left(lambda: timeline.timeline(g, nodes, edges, weeks, n_steps=10)) <= left(lambda: timeline.timeline(g, nodes, edges, weeks, n_steps=2))
    assert left(lambda: markov.steps(moves, seed, seed, 0.15, 15)) <= left(lambda: markov.steps(moves, seed, seed, 0.15, 2))
    few, many = (left(lambda: markov.stationary(moves, seed, seed, 0.15, 0.0, n)) for n in (2, 8))
    assert many <= few


def test_converged_ranks_are_stationary(spark):
    g = domain.event_graph(spark, SF)
    nodes, moves = markov.compile_process(g, domain.node_weights(spark, g), domain.edge_weights(spark, g), domain.participants(g), graph_queries._P)
    nodes, moves = nodes.collect(), moves.collect()
    at = {r.address: i for i, r in enumerate(nodes)}
    src, dst, pr = np.array([at[r.src] for r in moves]), np.array([at[r.dst] for r in moves]), np.array([r.pr for r in moves])
    pi = np.full(len(at), 1 / len(at))
    for _ in range(3_000):
        pi = np.bincount(dst, weights=pi[src] * pr, minlength=len(at))
    score = pi / sum(pi[i] for a, i in at.items() if a.startswith("sum/")) * sum(r.mint for r in nodes)
    weekly, flow = {}, {}
    for r, x in zip(moves, score[src] * pr, strict=True):
        flow[r.kind] = flow.get(r.kind, 0) + x
        if r.kind == "payout":
            _, start, who, _ = r.src.split("/")
            weekly[who, int(start)] = x
    got = {(r.id, r.start_ms): r.score for r in registry.QUERIES["rank_participant_weeks_converged"](spark, SF).collect()}
    assert got.keys() == weekly.keys() and all(math.isclose(got[k], weekly[k], rel_tol=1e-2, abs_tol=1e-2) for k in got)
    got = {r.kind: r.flow for r in registry.QUERIES["rank_flows_converged"](spark, SF).collect()}
    assert got.keys() == flow.keys() and all(math.isclose(got[k], flow[k], rel_tol=1e-3) for k in got)
    total = {}
    for (who, _), x in weekly.items():
        total[who] = total.get(who, 0) + x
    got = registry.QUERIES["rank_top_participants_converged"](spark, SF).collect()
    assert [r.score for r in got] == pytest.approx(sorted(total.values(), reverse=True)[:10], rel=1e-3)


def test_merge_rejects_conflicts(spark):
    a = Graph(spark.createDataFrame([("a/", "x", None)], NODE), spark.createDataFrame([], EDGE))
    b = Graph(spark.createDataFrame([("a/", "y", None)], NODE), spark.createDataFrame([], EDGE))
    assert graph.merge([a, a]).nodes.count() == 1
    with pytest.raises(Exception, match="conflicting nodes"):
        graph.merge([a, b]).nodes.collect()
    assert graph.equals(a, a) and not graph.equals(a, b)


def test_loops_are_one_neighbor(spark):
    g = Graph(spark.createDataFrame([("a/", "", None), ("b/", "", None)], NODE), spark.createDataFrame([("l/", "a/", "a/", 0), ("e/", "a/", "b/", 0), ("d/", "a/", "no/", 0)], EDGE))
    assert sorted(tuple(r) for r in graph.neighbors(g, "a/").collect()) == [("a/", "l/"), ("b/", "e/")]
    assert sorted(tuple(r) for r in graph.neighbors(g, "a/", "IN").collect()) == [("a/", "l/")]
    with pytest.raises(ValueError):
        graph.neighbors(g, "no/")


def test_long_weight_tables_are_joined(spark, monkeypatch):
    rows = spark.createDataFrame([("a/b/",), ("c/",)], "address string")
    own = spark.createDataFrame([("", 2.0), ("a/", 3.0), ("a/b/", 0.5)], "prefix string, weight double")
    short = sorted(map(tuple, weights.with_products(rows, own, ["weight"]).collect()))
    monkeypatch.setattr(weights, "LITERALS", 1)
    assert sorted(map(tuple, weights.with_products(rows, own, ["weight"]).collect())) == short == [("a/b/", 3.0), ("c/", 2.0)]
    assert {r.address: r.weight for r in weights.longest_prefix(rows, own, "weight").collect()} == {"a/b/": 0.5, "c/": 2.0}
    with pytest.raises(Exception, match="duplicate weight"):
        weights.merge([own, own]).collect()


@pytest.mark.parametrize(("strict", "want"), [(False, [None, 1.0, 1.0, 2.0]), (True, [None, None, 1.0, 1.0])])
def test_asof_at_the_boundary(spark, strict, want):
    rows = spark.createDataFrame([(9,), (10,), (11,), (20,)], "t long")
    periods = spark.createDataFrame([(20, 2.0), (10, 1.0)], "s long, v double")
    assert [r.v for r in asof_join(rows, periods, "t", "s", "v", strict=strict).orderBy("t").collect()] == want


def test_budget_prefixes_may_not_overlap():
    intervals.check_disjoint(["a/", "b/"])
    with pytest.raises(ValueError):
        intervals.check_disjoint(["a/b/", "a/"])


def test_split_is_exact():
    rng = random.Random(1)
    cases = [[1.0] * 997, [1.0, 1e100], [float(i * i) for i in range(100)], [2.0**i for i in range(100)], [rng.random() for _ in range(50)], [0.0, 1.0, 0.0]]
    for scores in cases + [c[::-1] for c in cases]:
        budget = 10**18
        got = split_budget(budget, scores)
        assert sum(got) == budget and min(got) >= 0
        total = math.fsum(scores)
        assert all(abs(g / budget - s / total) < 1e-9 for g, s in zip(got, scores, strict=True))
    for bad in ((-1, [1.0]), (1, [0.0]), (1, [-1.0, 2.0]), (1, [math.inf])):
        with pytest.raises(ValueError):
            split_budget(*bad)


def test_split_in_ranges_is_exact(spark, monkeypatch):
    rng = random.Random(1)
    cases = [[1.0] * 97, [1.0, 1e100], [float(i * i) for i in range(60)], [2.0**i for i in range(90)], [10.0**i for i in range(90)], [0.0, 1.0, 0.0], [rng.random() for _ in range(50)], [3.0]]
    cases += [c[::-1] for c in cases[1:5]]
    rows = [(f"a{k:02}", Decimal(10**18 + k), f"{i:03}", x) for k, c in enumerate(cases) for i, x in enumerate(c)]
    frame = spark.createDataFrame(rows, "allocation string, budget decimal(38,0), id string, score double")
    monkeypatch.setattr(payouts, "BROADCAST_ROWS", 0)
    got = {}
    for r in payouts.split(frame.repartition(5)).collect():
        got.setdefault(r.allocation, {})[r.id] = int(r.amount)
    for k, c in enumerate(cases):
        own = [got[f"a{k:02}"][f"{i:03}"] for i in range(len(c))]
        assert sum(own) == 10**18 + k and min(own) >= 0 and all(x == 0 for x, y in zip(own, c, strict=True) if y == 0)
        assert all(abs(x / (10**18 + k) - y / math.fsum(c)) < 1e-9 for x, y in zip(own, c, strict=True))
    for budget, scores in ((-1, [1.0]), (1, [0.0]), (1, [-1.0, 2.0]), (1, [math.inf]), (1, [None, 1.0])):
        with pytest.raises(ValueError):
            payouts.split(spark.createDataFrame([("a", Decimal(budget), str(i), x) for i, x in enumerate(scores)], frame.schema))


def test_distributions(spark):
    v = spark.createDataFrame([("a", 0, WEEK, 3.0, Decimal(0)), ("b", 0, WEEK, 1.0, Decimal(0)), ("b", WEEK, 2 * WEEK, 4.0, Decimal(0)), ("c", WEEK, 2 * WEEK, 8.0, Decimal(0))], "id string, start_ms long, end_ms long, score double, earned decimal(38,0)")
    weeks = v.select("end_ms").distinct()
    assert payouts.due(weeks, None, 2 * WEEK, 5) == [WEEK, 2 * WEEK] and payouts.due(weeks, None, 2 * WEEK, 1) == [2 * WEEK] and payouts.due(weeks, WEEK, 2 * WEEK - 1, 5) == []
    assert payouts.due(weeks, 2 * WEEK, 3 * WEEK, 5) == [] and payouts.due(weeks, 2 * WEEK, 3 * WEEK, 5, again=True) == [2 * WEEK]
    accounts = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "id string, active boolean")
    found = payouts.apply_distributions([payouts.Policy("BALANCED", 80), payouts.Policy("SPECIAL", 5, recipient="a"), payouts.Policy("RECENT", 0)], v, [WEEK, 2 * WEEK], accounts)
    got = {(r.ts_ms // WEEK, r.allocation, r.id): int(r.amount) for r in found.collect()}
    assert got == {(1, "0-BALANCED", "a"): 60, (1, "0-BALANCED", "b"): 20, (1, "1-SPECIAL", "a"): 5, (2, "0-BALANCED", "a"): 0, (2, "0-BALANCED", "b"): 80, (2, "1-SPECIAL", "a"): 5}
    totals = {r.id: (int(r.amount), r.percent) for r in payouts.distribution_totals(found).collect()}
    assert totals["a"][0] == 70 and totals["b"] == (100, pytest.approx(100 * 100 / 170))
    events = payouts.as_events(found, 10).orderBy("seq").collect()
    assert [e.seq for e in events] == list(range(10, 16)) and [e.ts_ms for e in events] == sorted(e.ts_ms for e in events)
    for wrong in (dict(kind="OTHER", budget=1), dict(kind="IMMEDIATE", budget=1), dict(kind="RECENT", budget=1, discount=2.0), dict(kind="SPECIAL", budget=1), dict(kind="BALANCED", budget=-1)):
        with pytest.raises(ValueError):
            payouts.Policy(**wrong)


def test_payout_queries(spark):
    assert registry.QUERIES["payout_split"](spark, SF).agg(F.sum("amount")).first()[0] == Decimal(1_000 * 10**18)
    lines = [r.line for r in registry.QUERIES["payout_lines"](spark, SF).collect()]
    assert lines and all(x.startswith("erc20,0xt,0x") for x in lines)
    accounts = spark.createDataFrame([("a", True), ("b", False)], "id string, active boolean")
    assert payouts.special(accounts, "a").count() == 1
    with pytest.raises(ValueError):
        payouts.special(accounts, "b")


@pytest.mark.parametrize(("units", "text"), [(0, "0"), (15 * 10**17, "1.5"), (-(10**18), "-1"), (1, "0." + "0" * 17 + "1"), (10**21, "1000")])
def test_plain_amounts(spark, units, text):
    assert one(spark, plain(F.lit(Decimal(units)).cast("decimal(38,0)"))) == text


@pytest.mark.parametrize(("op", "want"), [("ADD", 6.0), ("MULTIPLY", 6.0), ("MAX", 3.0), ("FIRST", 2.0), ("AVERAGE", 2.0)])
def test_operators_over_weights(spark, op, want):
    trees = spark.createDataFrame([(1, "0", op), (2, "0", op)], "contribution long, path string, operator string")
    leaves = spark.createDataFrame([(1, "0", 0, 1.0, False), (1, "0", 1, 2.0, True), (1, "0", 2, 3.0, True)], "contribution long, path string, ord int, weight double, explicit boolean")
    got = {r.contribution: r.score for r in expressions.score_trees(trees, leaves, 1).collect()}
    assert got == {1: want, 2: 0.0}  # without operands: 0


def test_unknown_keys_are_errors(spark):
    configs = spark.createDataFrame([(0, "k", None, 1.0)], "start_ms long, key string, subkey string, weight double")
    operands = spark.createDataFrame([(1, 0, "other", "x")], "contribution long, config_ms long, key string, subkey string")
    with pytest.raises(Exception, match="no weights for key"):
        expressions.weigh(operands, configs).collect()


def slow_ledger(events):
    """What a ledger that goes from event to event refuses; it goes on as if it had taken it."""
    born, gone, names, aliases, on, accounting, out = set(), set(), {}, set(), {}, True, set()
    for seq, kind, i, other, name, place, amount in events:
        used = {i} | ({other} if kind in ("TRANSFER", "MERGE") else set()) if kind not in ("CREATE", "ACCOUNTING_ON", "ACCOUNTING_OFF") else set()
        out |= {(seq, k, "id") for k in used if k not in born or k in gone}
        if kind in ("CREATE", "RENAME"):
            if any(n == name.lower() and k != i for k, n in names.items()):
                out.add((seq, i, "name"))
            names[i] = name.lower()
        born |= {i} if kind == "CREATE" else set()
        if kind == "ALIAS":
            out |= {(seq, i, "alias")} if place in aliases else set()
            aliases.add(place)
        if kind == "MERGE":
            gone.add(other)
            names.pop(other, None)
        if kind == "TOGGLE":
            on[i] = not on.get(i, False)
        if kind in ("DISTRIBUTE", "TRANSFER"):
            out |= {(seq, i, "amount")} if amount < 0 else set()
            out |= {(seq, k, "inactive") for k in ({i, other} if kind == "TRANSFER" else {i}) if not on.get(k, False)}
        out |= {(seq, i, "accounting")} if kind == "TRANSFER" and not accounting else set()
        accounting = {"ACCOUNTING_ON": True, "ACCOUNTING_OFF": False}.get(kind, accounting)
    return out


STATE = "seq long, type string, id string, other string, name string, address string, amount decimal(38,0)"


def test_rules_of_the_ledger(spark):
    rng, rows, created, merged = random.Random(4), [], [], set()
    for seq in range(1, 260):
        kind = rng.choice(["CREATE", "RENAME", "ALIAS", "TOGGLE", "TOGGLE", "DISTRIBUTE", "TRANSFER", "MERGE", "ACCOUNTING_ON", "ACCOUNTING_OFF"])
        free = [c for c in created if c not in merged]
        who = lambda: rng.choice(created + ["never"] if created else ["never"])  # noqa: B023, E731
        if kind == "CREATE":
            created.append(f"u{seq}")
            rows.append((seq, kind, f"u{seq}", None, f"Name{rng.randrange(30)}", None, None))
        elif kind == "MERGE" and len(free) > 3 and rng.random() < 0.5:
            a, b = rng.sample(free, 2)
            merged.add(b)
            rows.append((seq, kind, a, b, None, None, None))
        elif kind == "RENAME" and free:
            rows.append((seq, kind, rng.choice(free), None, f"nAME{rng.randrange(30)}", None, None))
        elif kind in ("ALIAS", "TOGGLE"):
            rows.append((seq, kind, who(), None, None, f"a{rng.randrange(40)}" if kind == "ALIAS" else None, None))
        elif kind in ("DISTRIBUTE", "TRANSFER"):
            rows.append((seq, kind, who(), who() if kind == "TRANSFER" else None, None, None, Decimal(rng.randrange(-2, 9))))
        elif kind.startswith("ACC"):
            rows.append((seq, kind, None, None, None, None, None))
    got = [tuple(r) for r in ledger_state.violations(spark.createDataFrame(rows, STATE).repartition(3)).collect()]
    assert len(got) == len(set(got)) and set(got) == slow_ledger(rows) and {r for _, _, r in got} == {"id", "name", "alias", "amount", "inactive", "accounting"}
    with pytest.raises(ValueError):
        ledger_state.refuse(spark.createDataFrame(rows, STATE))
    ledger_state.refuse(spark.createDataFrame([], STATE))


def slow_balances(events):
    """What a ledger that goes from event to event ends with: id: (balance, paid, active)."""
    own, gone, accounting = {}, set(), True
    for _, kind, i, other, *_, amount in events:
        if kind == "CREATE":
            own[i] = [0, 0, False]
        elif kind == "TOGGLE":
            own[i][2] = not own[i][2]
        elif kind == "DISTRIBUTE":
            own[i][1] += amount
            own[i][0] += amount if accounting else 0
        elif kind == "TRANSFER":
            own[i][0] -= amount
            own[other][0] += amount
        elif kind == "MERGE":
            own[i][0], own[i][1] = own[i][0] + own[other][0], own[i][1] + own[other][1]
            gone.add(other)
            own[other] = [0, 0, False]
        elif kind == "ACCOUNTING_ON":
            accounting = True
        elif kind == "ACCOUNTING_OFF" or (kind == "CURRENCY" and not accounting):
            accounting = False
            for x in own.values():
                x[0] = 0
    return {i: tuple(x) for i, x in own.items() if i not in gone}


@pytest.mark.parametrize("seed", range(4))
def test_balances_are_those_of_a_fold(spark, seed):
    """Switches, toggles, receipts and merges in any order, with distributions while accounting is off."""
    rng, rows, free, accounting = random.Random(seed), [], [], True
    for seq in range(1, 120):
        kind = rng.choice(["CREATE", "TOGGLE", "DISTRIBUTE", "DISTRIBUTE", "TRANSFER", "MERGE", "CURRENCY"] + ["ACCOUNTING_ON", "ACCOUNTING_OFF"] * (rng.random() < 0.3 and seq < 100 + 10 * seed))
        if kind == "CREATE" or len(free) < 3:
            free.append(f"u{seq}")
            rows.append((seq, "CREATE", f"u{seq}", None, f"n{seq}", None, None))
        elif kind == "MERGE" and rng.random() < 0.3:
            a, b = rng.sample(free, 2)
            free.remove(b)
            rows.append((seq, kind, a, b, None, None, None))
        elif kind == "TRANSFER" and accounting:
            rows.append((seq, kind, *rng.sample(free, 2), None, None, Decimal(rng.randrange(9))))
        elif kind in ("TOGGLE", "DISTRIBUTE"):
            rows.append((seq, kind, rng.choice(free), None, None, None, Decimal(rng.randrange(99)) if kind == "DISTRIBUTE" else None))
        elif kind.startswith("ACC") or kind == "CURRENCY":
            accounting = {"ACCOUNTING_ON": True, "ACCOUNTING_OFF": False}.get(kind, accounting)
            rows.append((seq, kind, None, None, None, None, None))
    got = {r.id: (r.balance, r.paid, r.active) for r in ledger_state.balances(spark.createDataFrame(rows, STATE).repartition(3)).collect()}
    assert got == slow_balances(rows)


def test_accounts_beside_scores(spark):
    accounts = spark.createDataFrame([("1", "x/"), ("2", "y/")], "id string, address string")
    aliases = spark.createDataFrame([("1", "z/")], "id string, address string")
    scores = lambda *a: spark.createDataFrame([(x, float(i)) for i, x in enumerate(a)], "address string, score double")
    met, free = ledger_state.accounts_with_scores(accounts, aliases, scores("x/", "y/", "w/"))
    assert {r.id: r.score for r in met.collect()} == {"1": 0.0, "2": 1.0} and [r.address for r in free.collect()] == ["w/"]
    assert sorted(r.address for r in ledger_state.by_address(accounts, aliases).collect()) == ["x/", "y/", "z/"]
    for wrong in (("x/",), ("x/", "y/", "z/")):
        with pytest.raises(ValueError):
            ledger_state.accounts_with_scores(accounts, aliases, scores(*wrong))


def test_ledger_logs(spark, tmp_path):
    lines = [
        {"action": {"identity": {"address": "n1", "aliases": [], "id": "a", "name": "Ann é"}, "type": "CREATE_IDENTITY"}}, {"action": {"identity": {"address": "n2", "aliases": [], "id": "b", "name": "bo"}, "type": "CREATE_IDENTITY"}},
        {"action": {"identityId": "a", "newName": "an", "type": "RENAME_IDENTITY"}}, {"action": {"identityId": "a", "newType": "BOT", "type": "CHANGE_IDENTITY_TYPE"}}, {"action": {"alias": {"address": "n3"}, "identityId": "a", "type": "ADD_ALIAS"}},
        {"action": {"identityId": "a", "type": "TOGGLE_ACTIVATION"}}, {"action": {"currency": {"chainId": "1", "tokenAddress": "0x/1"}, "type": "SET_EXTERNAL_CURRENCY"}}, {"action": {"type": "ENABLE_GRAIN_INTEGRATION"}},
        {"action": {"id": "a", "payoutAddress": "0xa", "type": "SET_PAYOUT_ADDRESS"}}, {"action": {"amount": "12345678901234567890123", "from": "a", "to": "b", "type": "TRANSFER_GRAIN"}}, {"action": {"id": "d1", "type": "MARK_DISTRIBUTION_EXECUTED"}},
        {"action": {"distribution": {"allocations": [{"id": "x", "receipts": [{"amount": "5", "id": "a"}, {"amount": "6", "id": "b"}]}, {"id": "y", "receipts": [{"amount": "7", "id": "a"}]}], "credTimestamp": 9, "id": "d1"}, "type": "DISTRIBUTE_GRAIN"}},
        {"action": {"base": "a", "target": "b", "type": "MERGE_IDENTITIES"}}, {"action": {"type": "REMOVE_EXTERNAL_CURRENCY"}}, {"action": {"type": "DISABLE_ACCOUNTING"}}, {"action": {"type": "ENABLE_ACCOUNTING"}}, {"action": {"type": "DISABLE_GRAIN_INTEGRATION"}},
    ]
    lines = [x | {"ledgerTimestamp": 9, "uuid": f"u{i}", "version": "1"} for i, x in enumerate(lines)]
    (tmp_path / "log.json").write_text("\n".join(json.dumps(x) for x in lines) + "\n")
    events = ledger_log.read_log(spark, str(tmp_path / "log.json"))
    rows = events.orderBy("seq").collect()
    assert len(rows) == len(lines) + 2 and [r.type for r in rows][:4] == ["CREATE", "CREATE", "RENAME", "TYPE"]
    assert sorted((r.id, r.name, r.address, int(r.amount)) for r in rows if r.type == "DISTRIBUTE") == [("a", "d1", "x", 5), ("a", "d1", "y", 7), ("b", "d1", "x", 6)]
    written = [r.value for r in ledger_log.written_lines(events).orderBy("seq").collect()]
    assert [json.loads(x) for x in written] == lines and all(json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == y for x, y in zip(lines, written, strict=True))
    assert ledger_state.settings(events).first() == (True, False, None)
    assert {r.id: r.kind for r in ledger_state.kinds(events).collect()} == {"a": "BOT", "b": "USER"}
    assert [tuple(r) for r in ledger_state.executed(events).collect()] == [("d1", Decimal(18), False)]  # marks went with the integration
    assert {r.id: [int(x.amount) for x in r.receipts] for r in ledger_state.history(events).collect()} == {"a": [5, 6, 7]}
    for bad in ('{"action": {"type": "NOTHING"}, "version": "1"}', '{"action": {"type": "ENABLE_ACCOUNTING"}, "version": "2"}', "no json"):
        with pytest.raises(Exception):
            ledger_log.parsed(spark.createDataFrame([(1, bad)], "seq long, value string")).collect()


def test_logs_lose_nothing(spark):
    """Every action with every optional member: text in equals text out."""
    currency = {"chainId": "1", "tokenAddress": "0x1", "type": "EVM"}
    actions = [
        {"type": "CREATE_IDENTITY", "identity": {"id": "a", "name": "ann", "address": "n1", "subtype": "BOT", "aliases": [{"address": "x1", "description": "d"}, {"address": "x2"}]}}, {"type": "RENAME_IDENTITY", "identityId": "a", "newName": "an"},
        {"type": "CHANGE_IDENTITY_TYPE", "identityId": "a", "newType": "USER"}, {"type": "ADD_ALIAS", "identityId": "a", "alias": {"address": "x3", "description": "é"}}, {"type": "MERGE_IDENTITIES", "base": "a", "target": "b"}, {"type": "TOGGLE_ACTIVATION", "identityId": "a"},
        {"type": "DISTRIBUTE_GRAIN", "distribution": {"id": "d", "credTimestamp": 3, "allocations": [{"id": "x", "policy": {"policyType": "RECENT", "budget": "9", "discount": 0.25}, "receipts": [{"id": "a", "amount": "5"}]}]}}, {"type": "DISTRIBUTE_GRAIN", "distribution": {"id": "e", "credTimestamp": 4, "allocations": []}},
        {"type": "TRANSFER_GRAIN", "from": "a", "to": "b", "amount": "7", "memo": "thanks \"x\""}, {"type": "TRANSFER_GRAIN", "from": "a", "to": "b", "amount": "8", "memo": None}, {"type": "SET_PAYOUT_ADDRESS", "id": "a", "currency": currency, "payoutAddress": "0xa"},
        {"type": "SET_PAYOUT_ADDRESS", "id": "a", "currency": {"chainId": "2"}, "payoutAddress": None}, {"type": "ENABLE_GRAIN_INTEGRATION"}, {"type": "DISABLE_GRAIN_INTEGRATION"}, {"type": "MARK_DISTRIBUTION_EXECUTED", "id": "d"}, {"type": "ENABLE_ACCOUNTING"}, {"type": "DISABLE_ACCOUNTING"},
        {"type": "SET_EXTERNAL_CURRENCY", "currency": currency}, {"type": "REMOVE_EXTERNAL_CURRENCY"},
    ]
    assert {x["type"] for x in actions} == set(ledger_log.ACTIONS)
    text = [json.dumps({"action": a, "ledgerTimestamp": 100 + i, "uuid": f"u{i}", "version": "1"}, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for i, a in enumerate(actions)]
    events = ledger_log.parsed(spark.createDataFrame(list(enumerate(text)), "seq long, value string")).cache()
    assert [r.value for r in ledger_log.written_lines(events).orderBy("seq").collect()] == text
    rows = events.orderBy("seq", "part").collect()
    assert [(r.type, r.id, r.name, r.address, r.memo) for r in rows[:4]] == [("CREATE", "a", "ann", "n1", None), ("TYPE", "a", "BOT", None, None), ("ALIAS", "a", None, "x1", "d"), ("ALIAS", "a", None, "x2", None)]
    assert {r.id: r.kind for r in ledger_state.kinds(events.where("seq = 0")).collect()} == {"a": "BOT"}
    assert [(r.name, r.address) for r in rows if r.type == "PAYOUT_ADDRESS"] == [("1/0x1", "0xa"), ("2", None)] and [(r.ts_ms, r.ledger_ms) for r in rows if r.name == "d"] == [(3, 106)]
    ledger.check_order(events)
    # one event changed: its line is made of its columns, the others stay as they were
    changed = events.withColumn("line", F.when(F.col("seq") != 1, F.col("line"))).withColumn("name", F.when(F.col("seq") == 1, F.lit("anna")).otherwise(F.col("name")))
    assert [r.value for r in ledger_log.written_lines(changed.where("seq <> 1 OR part = 0")).orderBy("seq").collect()] == [x.replace('"an"', '"anna"') if i == 1 else x for i, x in enumerate(text)]


@pytest.mark.parametrize("action,path", [
    ('{"type": "TRANSFER_GRAIN", "from": "a", "to": "b", "amount": 5}', r"\$.action.amount: expected a string, got BIGINT"), ('{"type": "ENABLE_ACCOUNTING", "x": 1}', r"\$.action.x: unknown member"), ('{"type": "RENAME_IDENTITY", "identityId": "a"}', r"\$.action.newName: expected a string, got nothing"),
    ('{"type": "DISTRIBUTE_GRAIN", "distribution": {"id": "d", "credTimestamp": 1, "allocations": [{"id": "x", "receipts": [{"id": "a", "amount": "1"}, {"id": "a", "amount": "1.5"}]}]}}', r"allocations\[0\].receipts\[1\].amount: expected an amount"),
])
def test_logs_name_the_place_of_an_error(spark, action, path):
    lines = spark.createDataFrame([(4, '{"action": %s, "ledgerTimestamp": 1, "uuid": "u", "version": "1"}' % action)], "seq long, value string")
    with pytest.raises(Exception, match=f"line 4, .*{path}"):
        ledger_log.parsed(lines).collect()


def slow_tree(contribution, e, path="0"):
    """(contribution, path, operator) and (contribution, path, ord, key, subkey) of a tree, by recursion."""
    nodes, weights = [(contribution, path, e["operator"])], [(contribution, path, k, w["key"], w.get("subkey")) for k, w in enumerate(e["weightOperands"])]
    for k, child in enumerate(e["expressionOperands"]):
        a, b = slow_tree(contribution, child, f"{path}.{k}")
        nodes, weights = nodes + a, weights + b
    return nodes, weights


def test_contributions_of_any_depth(spark):
    rng = random.Random(6)

    def tree(depth):
        w = [{"key": f"k{rng.randrange(3)}"} | ({"subkey": "s"} if rng.random() < 0.5 else {}) for _ in range(rng.randrange(3))]
        return {"operator": rng.choice(["ADD", "MAX", "key:own"]), "description": "é", "weightOperands": w, "expressionOperands": [tree(depth - 1) for _ in range(rng.choice([0, 1, 1, 3]))] if depth else []}

    deep = {"operator": "FIRST", "description": "", "weightOperands": [], "expressionOperands": []}
    for _ in range(12):
        deep = deep | {"expressionOperands": [deep]}
    made = [{"id": f"c{i}", "plugin": "p", "type": "t", "timestampMs": i, "expression": tree(i % 4), "participants": [{"id": "u", "shares": [{"key": "a"}, {"key": "b", "subkey": "x"}]}] * (i % 3)} for i in range(15)]
    made.append({"id": "deep", "plugin": "p", "type": "t", "timestampMs": 99, "expression": deep, "participants": []})
    lines = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(made)] + [(99, "  ")], "seq long, value string").repartition(3)
    got = contributions.opened(lines)
    found = [slow_tree(c["id"], c["expression"]) for c in made]
    assert sorted(tuple(r)[:3] for r in got.expressions.collect()) == sorted(x for a, _ in found for x in a)
    assert sorted(map(str, (tuple(r) for r in got.operands.collect()))) == sorted(map(str, (x for _, b in found for x in b)))
    assert got.shares.count() == sum(2 * len(c["participants"]) for c in made) and {r.contribution for r in got.contributions.collect()} == {c["id"] for c in made}
    both = contributions.by_target(spark.createDataFrame([(1, json.dumps({"x": made[:2], "y": made[2:3]}))], "seq long, value string"))
    assert sorted((r.target, json.loads(r.value)["id"]) for r in both.collect()) == [("x", "c0"), ("x", "c1"), ("y", "c2")]
    for change, path in (({"operator": "POWER"}, "operator: expected one of ADD"), ({"more": 1}, "more: unknown member"), ({"weightOperands": [{"key": 1}]}, r"weightOperands\[0\].key: expected a string")):
        wrong = made[-1] | {"expression": deep | {"expressionOperands": [deep["expressionOperands"][0], deep["expressionOperands"][0] | change]}}
        with pytest.raises(Exception, match=rf"line 7, \$.expression.expressionOperands\[1\].{path}"):
            contributions.opened(spark.createDataFrame([(7, json.dumps(wrong))], "seq long, value string"))
    assert contributions.opened(spark.createDataFrame([], "seq long, value string")).expressions.count() == 0
    lax = made[0] | {"more": 1}
    assert contributions.opened(spark.createDataFrame([(1, json.dumps(lax))], "seq long, value string"), strict=False).contributions.count() == 1


LOG = "seq long, type string, id string, other string, amount decimal(38,0)"


def test_overdrawn_looks_before_it_gives(spark):
    rows = [(1, "DISTRIBUTE", "a", None, 5), (2, "TRANSFER", "a", "a", 6), (3, "TRANSFER", "a", "a", 5), (4, "TRANSFER", "a", "b", 4), (5, "TRANSFER", "b", "b", 4), (6, "TRANSFER", "b", "a", 9)]
    rows = [(*r[:4], Decimal(r[4])) for r in rows]
    for k in range(5):
        random.Random(k).shuffle(rows)
        got = ledger.overdrawn(spark.createDataFrame(rows, LOG).repartition(k + 1)).collect()
        assert sorted((r.id, r.seq) for r in got) == [("a", 2), ("b", 6)]


def test_merges(spark):
    made = lambda pairs: spark.createDataFrame([(i, "MERGE", a, b, None) for i, (a, b) in enumerate(pairs)], LOG)
    long = [(f"{i:03}", f"{i + 1:03}") for i in range(37)]
    assert {r.id: r.target for r in ledger.survivors(made(long)).collect()} == {b: "000" for _, b in long}
    assert ledger.survivors(made([])).count() == 0
    for wrong in ([("a", "b"), ("b", "c"), ("c", "a")], [("a", "b"), ("b", "a"), ("x", "y")], [("a", "b"), ("c", "b")], [("a", "a")]):
        with pytest.raises(ValueError):
            ledger.survivors(made(wrong))


def test_ledger_order(spark):
    rows = spark.createDataFrame([(i, i) for i in range(50)], "seq long, ts_ms long")
    ledger.check_order(rows)
    with pytest.raises(ValueError):
        ledger.check_order(rows.union(spark.createDataFrame([(99, 3)], "seq long, ts_ms long")))


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src long, dst long")
    got = {r.node: r.distance for r in references.reachable(edges, spark.createDataFrame([(1,)], "node long")).collect()}
    assert got == {1: 0, 2: 1, 3: 2}


def test_closure_has_no_bound_on_steps(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(14)], "src long, dst long")
    roots = spark.createDataFrame([(0,)], "node long")
    assert {r.node: r.distance for r in references.reachable(edges, roots).collect()} == {i: i for i in range(15)}
    assert references.reachable(edges, roots, 3).count() == 4
    assert inspect.signature(references.reachable).parameters["most"].default is None


def test_closure_over_all_events(spark):
    onward = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").select("user_id", "props").collect():
        k = json.loads(r.props or "{}").get("k")
        if k is not None:
            onward.setdefault(r.user_id, set()).add(int(k) // 7 + 1)
    want, frontier = {3: 0}, [3]
    while frontier:
        new = {d for s in frontier for d in onward.get(s, ())} - want.keys()
        want |= dict.fromkeys(new, want[frontier[0]] + 1)
        frontier = list(new)
    got = {r.node: r.distance for r in registry.QUERIES["reachable_users_whole"](spark, SF).collect()}
    assert got == want and len(got) > 10


def test_references_skip_code(spark):
    rows = spark.createDataFrame([(1, "see #12 and `#13`, by @ann-b\n```\n#14\n``` a&#15; https://x.org/y?z")], "k long, t string")
    got = {(r.kind, r.ref) for r in references.references(rows, "k", "t").collect()}
    assert got == {("number", "12"), ("person", "ann-b"), ("link", "https://x.org/y?z")}


def test_index_and_codec(spark):
    assert [r["index"] for r in order.with_index(spark.range(100).select((99 - F.col("id")).alias("k")), "k").orderBy("k").collect()] == list(range(100))
    g = Graph(spark.createDataFrame([("a/", "x", 1), ("b/", "y", None)], NODE), spark.createDataFrame([("e/", "a/", "gone/", 5)], EDGE))
    assert graph.equals(exports.decoded(*exports.coded(g)), g)


def test_readers(spark, tmp_path):
    (tmp_path / "log").write_text('[{"a":1}\n,{"a":2}\n]\n'.replace("\n,", ",\n"))
    assert [r.a for r in tables.json_lines(spark, str(tmp_path / "log"), "a long").collect()] == [1, 2]
    assert tables.read_or_default(spark, str(tmp_path / "none"), "a long").count() == 0
    with pytest.raises(ValueError):
        tables.inside("/base", "../x")
    (tmp_path / "git").write_text("h1 s1 10 |first\nh2 s2 20 h1 h0|a|b\n")
    found = tables.commits(spark, str(tmp_path / "git"))
    assert [tuple(r) for r in found.orderBy("hash").collect()] == [("h1", "s1", 10000, "first", []), ("h2", "s2", 20000, "a|b", ["h1", "h0"])]
    assert builders.commit_graph(found).edges.count() == 2


def test_forum_graph(spark):
    topics = spark.createDataFrame([(1, "ann", "t", 5)], "topic_id long, author string, title string, ms long")
    posts = spark.createDataFrame([(1, 1, "ann", None, 5), (2, 1, "bob", 1, 6)], "post_id long, topic_id long, author string, reply_to long, ms long")
    likes = spark.createDataFrame([(2, "ann", 7)], "post_id long, author string, ms long")
    g = builders.forum(topics, posts, likes)
    assert g.nodes.count() == 6 and g.edges.count() == 8
    assert graph.solid(g).count() == 8


def test_weekly_stream(spark, tmp_path):
    source = tmp_path / "in"
    tables.table(spark, SF, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", "event_id").write.parquet(str(source))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double, event_id long").parquet(str(source))
    q = weekly.weekly_sums(weekly.once(stream, "event_id"), delay=None).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = spark.read.parquet(str(source)).groupBy(F.window("ts", "7 days", "7 days", "3 days").start.alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    got, want = {(r.start, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}, {(r.start, r.event_type): r.n for r in batch.collect()}
    assert got and all(want[k] == n for k, n in got.items())


def slow_accounts(events):
    """id: (name, active, paid, balance, payout addresses) by going from event to event; merged identities go on into others."""
    own, into, accounting = {}, {}, True
    for r in sorted(events):
        _, _, kind, i, other, name, place, amount = r
        while i in into:
            i = into[i]
        while other in into:
            other = into[other]
        if kind == "CREATE":
            own[i] = [name, False, 0, 0, {}]
        elif kind == "RENAME":
            own[i][0] = name
        elif kind == "TOGGLE":
            own[i][1] = not own[i][1]
        elif kind == "DISTRIBUTE":
            own[i][2], own[i][3] = own[i][2] + amount, own[i][3] + (amount if accounting else 0)
        elif kind == "TRANSFER":
            own[i][3] -= amount
            own[other][3] += amount
        elif kind == "PAYOUT_ADDRESS":
            own[i][4] = {k: v for k, v in (own[i][4] | {name: place}).items() if v}
        elif kind == "MERGE":
            own[i][2], own[i][3] = own[i][2] + own[other][2], own[i][3] + own[other][3]
            into[other] = i
            del own[other]
        elif kind in ("ACCOUNTING_ON", "ACCOUNTING_OFF"):
            accounting = kind == "ACCOUNTING_ON"
            for x in own.values():
                x[3] = x[3] if accounting else 0
    return {i: (x[0], x[1], x[2], x[3], x[4]) for i, x in own.items()}


def test_stream_of_ledger_events(spark, tmp_path):
    """Accounts equal the fold after every trigger and after a restart; an event out of order stops the query."""
    from meritgraph.streaming import accounts

    rng, rows, free, accounting = random.Random(5), [], [], True
    for seq in range(1, 160):
        kind = rng.choice(["CREATE", "RENAME", "TOGGLE", "DISTRIBUTE", "DISTRIBUTE", "TRANSFER", "PAYOUT_ADDRESS", "MERGE", "ACCOUNTING_ON", "ACCOUNTING_OFF"])
        two = lambda: rng.sample(free, 2)  # noqa: B023, E731
        if kind == "CREATE" or len(free) < 3:
            free.append(f"u{seq}")
            rows.append((seq, seq, "CREATE", f"u{seq}", None, f"n{seq}", None, None))
        elif kind == "MERGE" and rng.random() < 0.4:
            a, b = two()
            free.remove(b)
            rows.append((seq, seq, kind, a, b, None, None, None))
        elif kind == "TRANSFER" and accounting:
            rows.append((seq, seq, kind, *two(), None, None, Decimal(rng.randrange(9))))
        elif kind in ("RENAME", "TOGGLE", "DISTRIBUTE", "PAYOUT_ADDRESS"):
            rows.append((seq, seq, kind, rng.choice(free), None, {"RENAME": f"m{seq}", "PAYOUT_ADDRESS": rng.choice("xy")}.get(kind), rng.choice(["0x1", None]) if kind == "PAYOUT_ADDRESS" else None, Decimal(rng.randrange(99)) if kind == "DISTRIBUTE" else None))
        elif kind.startswith("ACC") and rng.random() < 0.4:
            accounting = kind == "ACCOUNTING_ON"
            rows.append((seq, seq, kind, None, None, None, None, None))
    schema = "seq long, ts_ms long, type string, id string, other string, name string, address string, amount decimal(38,0)"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    held, source = {}, str(tmp_path / "events")
    frame = lambda part: spark.createDataFrame(part, schema)
    cuts, done = [0, 40, 90, len(rows)], 0

    def keep(batch, _):
        held.update({r.id: r for r in batch.collect()})

    def run():
        stream = accounts.accounts(spark.readStream.schema(schema).parquet(source), accounts.flips(frame(rows)))
        stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    for a, b in zip(cuts, cuts[1:]):  # each a run of its own, from the state of the one before
        frame(rows[a:b]).repartition(2).write.mode("append").parquet(source)
        run()
        seen = frame(rows[:b])
        table = spark.createDataFrame(list(held.values()), accounts.STATE)
        got = {r.id: (r.name, r.active, int(r.paid), int(r.balance), r.payout) for r in accounts.current(table, seen).collect()}
        assert got == {i: (x[0], x[1], int(x[2]), int(x[3]), x[4]) for i, x in slow_accounts(rows[:b]).items() if i in got} and got.keys() == slow_accounts(rows[:b]).keys()
        done += 1
    assert done == 3
    late = next(r for r in rows if r[2] == "CREATE" and r[3] in free)
    frame([(2, 2, "TOGGLE", late[3], None, None, None, None)]).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="out of order"):
        run()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_upserts_keep_the_newest(spark, tmp_path):
    write = weekly.upsert_to(str(tmp_path / "t"), "k", "v")
    write(spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k long, v long, x string"), 0)
    write(spark.createDataFrame([(1, 2, "c")], "k long, v long, x string"), 1)
    write(spark.createDataFrame([(1, 9, "again")], "k long, v long, x string"), 1)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t" / "v000000000001")).collect()) == [(1, 2, "c"), (2, 1, "b")]


def test_asof_by_ranges_is_the_same(spark, monkeypatch):
    from meritgraph.operators import asof

    rng = random.Random(3)
    periods = spark.createDataFrame([(rng.randrange(3), rng.randrange(60), rng.choice([None, rng.random()])) for _ in range(90)], "k int, s long, v double").groupBy("k", "s").agg(F.max("v").alias("v"))
    left = spark.createDataFrame([(i, rng.choice([0, 1, 2, 5, None]), rng.randrange(-5, 70)) for i in range(200)], "id int, k int, t long")
    for by in (["k"], None):
        for strict in (False, True):
            p = periods if by else periods.groupBy("s").agg(F.max("v").alias("v"))
            monkeypatch.setattr(asof, "MAX_PERIODS", 1_000)
            want = sorted(map(repr, asof_join(left, p, "t", "s", "v", by, strict).select("id", "k", "t", "v").collect()))
            monkeypatch.setattr(asof, "MAX_PERIODS", 0)
            assert sorted(map(repr, asof_join(left, p, "t", "s", "v", by, strict).select("id", "k", "t", "v").collect())) == want


def test_weights_meet_the_same_rules_at_any_size(spark, monkeypatch):
    rows = spark.createDataFrame([("a/b/",), ("a/b/",), ("a/",), ("c/",)], "address string")
    table = [("", 2.0), ("a/", 3.0), ("a/b/", 5.0)]
    make = lambda t: spark.createDataFrame(t, "prefix string, weight double")
    for bound in (1_000, 1):
        monkeypatch.setattr(weights, "LITERALS", bound)
        got = sorted((r.address, r.weight) for r in weights.with_products(rows, make(table), ["weight"]).collect())
        assert got == [("a/", 6.0), ("a/b/", 30.0), ("a/b/", 30.0), ("c/", 2.0)]
        with pytest.raises(Exception):
            weights.with_products(rows, make(table + [("a/", 7.0)]), ["weight"]).collect()
    third = make([("a/", 10.0), ("z/", 1.0)])
    found = weights.merge([make(table), make([("a/", 4.0)]), third], lambda a, b: 2 * a + b)
    assert {r.prefix: r.weight for r in found.collect()} == {"": 2.0, "a/": 30.0, "a/b/": 5.0, "z/": 1.0}


def test_contradicting_contractions(spark):
    g = Graph(spark.createDataFrame([("a/", "", 1), ("b/", "", 1)], NODE), spark.createDataFrame([("e/", "a/", "b/", 1)], EDGE))
    for rows in ([("a/", "x/", "", 1), ("x/", "y/", "", 1)], [("a/", "x/", "", 1), ("a/", "y/", "", 1)]):
        with pytest.raises(ValueError):
            graph.contract(g, spark.createDataFrame(rows, "old string, " + NODE))


def test_initiative_files(spark, tmp_path):
    from meritgraph.operators import initiatives

    one = {"title": "First", "timestampIso": "2020-01-01T00:00:00Z", "weight": {"incomplete": 1, "complete": 5}, "completed": True, "champions": ["u1"], "dependencies": {"urls": ["first-too"], "entries": []}, "references": {"urls": [], "entries": []},
           "contributions": {"urls": [], "entries": [{"title": "Some Thing!", "weight": 2, "contributors": ["u1", "u2"]}]}}
    for name, x in (("a", one), ("b", {"title": "Second", "timestampIso": "2020-01-02T00:00:00Z"})):
        (tmp_path / f"{name}.json").write_text(json.dumps(x, indent=1))
    known = spark.createDataFrame([("u1", "user/1/"), ("first-too", "initiatives/initiative/b/")], "url string, address string")
    g, w = initiatives.graph(*initiatives.tables(initiatives.read(spark, str(tmp_path))), known)
    entry = "initiatives/entry/CONTRIBUTION/a/some-thing/"
    assert {r.address for r in g.nodes.collect()} == {"initiatives/initiative/a/", "initiatives/initiative/b/", entry}
    assert {(r.address.split("/")[1], r.src, r.dst) for r in g.edges.collect()} == {("champions", "user/1/", "initiatives/initiative/a/"), ("dependsOn", "initiatives/initiative/a/", "initiatives/initiative/b/"), ("contributesTo", entry, "initiatives/initiative/a/"), ("contributesToEntry", "user/1/", entry)}
    assert {r.prefix: r.weight for r in w.collect()} == {"initiatives/initiative/a/": 5.0, entry: 2.0}
    twice = spark.createDataFrame([("a", "REFERENCE", "k", "t", None, None)] * 2, "id string, field string, key string, title string, ms long, weight double")
    with pytest.raises(Exception):
        initiatives.normalised(twice, initiatives.tables(initiatives.read(spark, str(tmp_path)))[0]).collect()


def test_operators_by_key(spark):
    trees = lambda op: spark.createDataFrame([("c", "0", op, 1)], "contribution string, path string, operator string, config_ms long")
    configured = spark.createDataFrame([(1, "good", "MAX"), (1, "bad", "MIN")], "start_ms long, key string, operator string")
    assert expressions.with_operators(trees("key:good"), configured).first().operator == "MAX" and expressions.with_operators(trees("ADD"), configured).first().operator == "ADD"
    for op in ("key:bad", "key:unset", "MIN"):
        with pytest.raises(Exception):
            expressions.with_operators(trees(op), configured).collect()
    operands, shares = (spark.createDataFrame(rows, "contribution string, key string, subkey string") for rows in ([("a", "k", "x"), ("a", "k", "x"), ("b", "k", "y")], [("a", "k", "x"), ("b", "k", "x"), ("b", "k", "x")]))
    assert {r.contribution: r.n for r in expressions.with_subkey(operands, shares, "k", "x").collect()} == {"a": 1, "b": 2}


def test_time_frames_and_pages(spark):
    weeks = spark.createDataFrame([(i * WEEK, (i + 1) * WEEK) for i in range(7)], "start_ms long, end_ms long")
    of = lambda w: sorted(r.start_ms // WEEK for r in views.frame_of(weeks, w).collect())
    assert of("this") == [6] and of("last") == [5] and of("month") == [2, 3, 4, 5] and of("all") == list(range(7))
    page = spark.createDataFrame([("a", 1.0, Decimal(4)), ("b", 3.0, Decimal(5))], "id string, score double, earned decimal(38,0)")
    assert views.averages(page).first() == (4.0, 2.0, Decimal(9), 4.5) and views.duplicates(page.union(page.limit(1)), ["id"]).collect()[0].n == 2


def test_a_broken_upsert_comes_again(spark, tmp_path):
    import os

    path, make = str(tmp_path / "t"), lambda *rows: spark.createDataFrame(rows, "k int, v int")
    write = weekly.upsert_to(path, "k", "v")
    write(make((1, 1), (2, 1)), 0)
    write(make((2, 5)), 1)
    os.remove(f"{path}/v{1:012d}/_SUCCESS")
    write(make((2, 5)), 1)
    assert sorted(tuple(r) for r in spark.read.parquet(f"{path}/v{1:012d}").collect()) == [(1, 1), (2, 5)]


def test_forum_links(spark):
    from meritgraph.operators import forum

    html = "".join(f'<a class="x" href="{u}">y</a>' for u in ("https://F.org/t/some-title/12/3", "https://f.org/t/other/12", "http://f.org/t/x/12", "https://f.org/u/Jos%C3%A9", "https://f.org/c/1", "https://f.org/t/x/99/1?u=1", "https://f.org/t/x/13/#top"))
    found = forum.links(spark.createDataFrame([(1, html), (2, None)], "id int, html string"), "id", "html", "https://f.org")
    posts = spark.createDataFrame([("p", 12, 3)], "post string, topic int, index int")
    users = spark.createDataFrame([("josé",)], "author string")
    got = sorted((r.kind, r.a, r.b, r.address) for r in forum.existing(found, posts, users).collect())
    assert got == sorted([("post", "12", "3", "forum/post/p/"), ("topic", "12", None, "forum/topic/12/"), ("user", "José", None, "forum/user/josé/"), ("post", "99", "1", None), ("topic", "13", None, None)])


def test_changes_need_the_same_people(spark):
    make = lambda *rows: spark.createDataFrame(rows, "id string, score double")
    assert views.changes(make(("a", 1.0)), make(("a", 3.0))).first() == ("a", 1.0, 3.0, 2.0)
    with pytest.raises(Exception):
        views.changes(make(("a", 1.0)), make(("b", 3.0))).collect()


def mirrored(spark, objects=(), primitives=(), links=(), entries=()):
    from meritgraph.operators import mirror

    kinds = ("id string, typename string, seq int", "id string, field string, value string, seq int", "id string, field string, child string, seq int", "id string, field string, ord long, child string, seq int")
    return mirror.Store(*(spark.createDataFrame(list(x), k) for x, k in zip((objects, primitives, links, entries), kinds, strict=True)))


def test_mirrored_objects(spark):
    from meritgraph.operators import forge, mirror

    objects = [("r", "Repository", 1), ("i", None, 1), ("i", "Issue", 2), ("p", "PullRequest", 2), ("p", "PullRequest", 3), ("c", "Commit", 2), ("u", "User", 2), ("k", "IssueComment", 2), ("v", None, 1)]
    primitives = [("r", "key", '"o/r"', 1), ("i", "key", '"1"', 2), ("i", "title", '"old"', 2), ("i", "title", '"new"', 3), ("p", "key", '"2"', 2), ("p", "createdAt", "7", 2), ("c", "key", '"h"', 2), ("c", "oid", '"h"', 2), ("u", "login", '"ann"', 2), ("k", "key", '"3"', 2)]
    links = [("i", "author", "u", 2), ("p", "author", "gone", 2), ("p", "mergeCommit", "c", 2), ("k", "author", "u", 1), ("k", "author", None, 2), ("u", "self", "u", 1)]
    entries = [("r", "issues", 1, "i", 2), ("r", "pullRequests", 1, "p", 2), ("i", "comments", 2, "k", 2), ("i", "comments", 1, "v", 2), ("i", "comments", 0, "k", 1), ("i", "comments", 0, None, 3)]
    s = mirror.folded(mirrored(spark, objects, primitives, links, entries), spark.createDataFrame([("gone",)], "id string"))
    assert {r.id: r.typename for r in s.objects.collect()} == {"r": "Repository", "i": "Issue", "p": "PullRequest", "c": "Commit", "u": "User", "k": "IssueComment", "v": None}
    assert [r.id for r in mirror.unknown(s).collect()] == ["v"] and {r.id for r in mirror.reached(s, spark.createDataFrame([("i",)], "id string")).collect()} == {"i", "u", "k", "v"}
    (issue,) = mirror.assemble(s, {"title": "string", "nothing": "bigint", "author": mirror.Node({"login": "string", "self": mirror.Node({})}), "comments": mirror.Many({"key": "string", "author": mirror.Node({})})}, "Issue").collect()
    assert (issue.title, issue.nothing, issue.author.login, issue.author.self.id) == ("new", None, "ann", "u") and [(x.id, x.typename, x.key, x.author) for x in issue.comments] == [("k", "IssueComment", "3", None)]
    found = {(r.kind, r.key): (r.parent, r.author, r.description, r.ms, r.merged_as, r.hash) for r in mirror.forge_entities(s).collect()}
    assert found == {
        ("repo", "o/r"): (None, None, None, None, None, None), ("issue", "1"): ("repository/repo/o/r/", "ann", "new", None, None, None), ("pull", "2"): ("repository/repo/o/r/", None, None, 7, "repository/commit/h/", None),
        ("commit", "h"): (None, None, None, None, None, "h"), ("comment", "3"): ("repository/issue/1/", None, None, None, None, None),
    }
    none = spark.createDataFrame([], "target string, kind string, author string, ms long"), spark.createDataFrame([], "src string, dst string, ms long")
    kinds = sorted(r.address.split("/")[1] for r in forge.graph(mirror.forge_entities(s), *none)[0].edges.collect())
    assert kinds == ["authors", "correspondsToCommit", "hasParent", "hasParent", "hasParent", "mergedAs"]
    with pytest.raises(ValueError, match="two types"):
        mirror.folded(mirrored(spark, [("a", "X", 1), ("a", None, 2), ("a", "Y", 3)]))
    with pytest.raises(Exception):
        mirror.assemble(mirror.folded(mirrored(spark, [("a", "X", 1)], [("a", "n", '"text"', 1)])), {"n": "bigint"}, "X").collect()
    empty = mirror.folded(mirrored(spark))
    assert mirror.assemble(empty, {"x": "string", "m": mirror.Many({})}).count() == 0 == mirror.forge_entities(empty).count()


def slow_names(proposals, taken, known):
    used, seen, out = {t.lower() for t in taken}, set(known), {}
    for k, name, plugin, place in sorted(proposals):
        if place in seen:
            continue
        seen.add(place)
        for x in [name, f"{name}-{plugin}", *(f"{name}-{plugin}-{i}" for i in range(1, 100))]:
            if x.lower() not in used:
                used.add(x.lower())
                out[k] = x
                break
    return out


@pytest.mark.parametrize("n,pool", [(2_000, 60), (200, 3)])
def test_names_are_those_of_a_loop(spark, n, pool):
    """Names that clash with each other, with other proposals' forms and in case; addresses that come again."""
    from meritgraph.operators import names

    rng = random.Random(n)
    stem = lambda: rng.choice(["ann", "Ann", "bo", "b", "cy"]) + rng.choice(["", *(f"-{x}" for x in ("a", "b", "a-1", "b-2", "1"))]) + (f"-{rng.randrange(pool)}" if rng.random() < 0.9 else "")
    rows = [(k, stem(), rng.choice("abAB"), f"n{k if rng.random() < 0.9 else rng.randrange(n)}") for k in range(n)]
    taken, known = [stem().upper() for _ in range(20)], [f"n{k}" for k in range(0, n, 50)]
    frame = spark.createDataFrame(rows, "ord long, name string, plugin string, address string").repartition(3)
    got = names.new_names(frame, spark.createDataFrame([(x,) for x in taken], "name string"), spark.createDataFrame([(x,) for x in known], "address string"))
    assert {r.ord: r.name for r in got.collect()} == slow_names(rows, taken, known)


def test_names_that_cannot_be(spark):
    from meritgraph.operators import names

    none = spark.createDataFrame([], "name string")
    made = lambda rows: spark.createDataFrame([(k, a, b, f"n{k}") for k, (a, b) in enumerate(rows)], "ord long, name string, plugin string, address string")
    assert names.new_names(made([]), none).count() == 0 and names.new_names(made([("x", "p")] * 101), none).count() == 101
    for wrong in ([("x", "p")] * 102, [("x y", "p")], [(None, "p")], [("x" * 40, "plugin")] * 2, [("x" * 43, "p")]):
        with pytest.raises(Exception, match="not names|more proposals|no name is left"):
            names.new_names(made(wrong), none)


def test_channels_and_mentions(spark):
    from meritgraph.operators import chat

    channels = spark.createDataFrame([("a", None, "GUILD_TEXT", False), ("b", "p", "GUILD_TEXT", False), ("c", None, "GUILD_VOICE", False), ("d", None, "GUILD_TEXT", True), ("e", "p", "GUILD_TEXT", False)], "channel string, parent string, type string, nsfw boolean")
    weights = chat.Weights(channels={"p": 0.0, "e": 2.0})
    assert [sorted(r.channel for r in chat.loadable(channels, weights, nsfw).collect()) for nsfw in (False, True)] == [["a", "e"], ["a", "d", "e"]]
    texts = spark.createDataFrame([(1, "hi <@12> and <@!12>, <@3> <@x>"), (2, None), (3, "")], "k int, t string")
    assert sorted(map(tuple, chat.mention_counts(texts, "k", "t").collect())) == [(1, "12", 2), (1, "3", 1)]


def test_payable_views_and_neighbors(spark):
    view = lambda *s: spark.createDataFrame([(float(x),) for x in s], "score double")
    accounts = lambda *a: spark.createDataFrame([(x,) for x in a], "active boolean")
    ledger_state.check_payable_view(view(0.5, 0.5), accounts(False, True))
    for wrong in ((view(0.5), accounts(True)), (view(3), accounts(False)), (view(), accounts(True)), (view(3), accounts())):
        with pytest.raises(ValueError):
            ledger_state.check_payable_view(*wrong)
    moves = markov.chain_from_matrix(spark, [[0.5, 0.5], [0, 1]])
    assert sorted((r.src, r.pr) for r in markov.in_neighbors(moves, "1").collect()) == [("0", 0.5), ("1", 1.0)]
