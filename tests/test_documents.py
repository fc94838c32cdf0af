import json
import os

import pytest
from oracle import SF

from meritgraph.operators.graph import Graph
from meritgraph.operators.markov import epoch_node, sum_node
from meritgraph.plans.domain import event_graph
from meritgraph.sources import documents

NODE = "address string, description string, timestamp_ms long"
EDGE = "address string, src string, dst string, timestamp_ms long"
HEAD = {"type": "tool/graph", "version": "0.8.0"}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def text_of(folder):
    (name,) = [x for x in os.listdir(folder) if x.startswith("part-")]
    return json.loads(open(f"{folder}/{name}").read())


def put(tmp_path, value, name="x.json"):
    (tmp_path / name).write_text(json.dumps(value))
    return str(tmp_path / name)


def small(spark):
    nodes = spark.createDataFrame([("a/", 'says "},{"', None), ("a/b/", None, 5), ("a/http:\0\0h/", "é\n", -1)], NODE)
    edges = spark.createDataFrame([("e/1/", "a/", "gone/", 7), ("e/", "a/b/", "a/", 8)], EDGE)
    return Graph(nodes, edges)


def test_graph_documents(spark, tmp_path):
    g = small(spark)
    documents.write(documents.graph_lines(g, "tool"), f"{tmp_path}/g")
    head, body = text_of(f"{tmp_path}/g")
    assert head == HEAD
    assert body["sortedNodeAddresses"] == [["a"], ["a", "b"], ["a", "http://h"], ["gone"]]
    assert body["nodes"] == [{"description": 'says "},{"', "index": 0, "timestampMs": None}, {"description": None, "index": 1, "timestampMs": 5}, {"description": "é\n", "index": 2, "timestampMs": -1}]
    assert body["edges"] == [{"address": ["e"], "dstIndex": 0, "srcIndex": 1, "timestampMs": 8}, {"address": ["e", "1"], "dstIndex": 3, "srcIndex": 0, "timestampMs": 7}]
    back = documents.read_graph(spark, f"{tmp_path}/g", "tool")
    assert rows(back.nodes) == rows(g.nodes) and rows(back.edges) == rows(g.edges)


def test_whole_graph_comes_back(spark, tmp_path):
    g = event_graph(spark, SF)
    documents.write(documents.graph_lines(g, "tool"), f"{tmp_path}/g")
    back = documents.read_graph(spark, f"{tmp_path}/g", "tool")
    assert rows(back.nodes) == rows(g.nodes) and rows(back.edges) == rows(g.edges)


def test_empty_graph(spark, tmp_path):
    g = Graph(spark.createDataFrame([], NODE), spark.createDataFrame([], EDGE))
    documents.write(documents.graph_lines(g, "tool"), f"{tmp_path}/g")
    assert text_of(f"{tmp_path}/g") == [HEAD, {"edges": [], "nodes": [], "sortedNodeAddresses": []}]
    assert documents.read_graph(spark, f"{tmp_path}/g", "tool").nodes.isEmpty()


def test_documents_that_are_refused(spark, tmp_path):
    body = {"edges": [], "nodes": [{"index": 3, "description": "", "timestampMs": None}], "sortedNodeAddresses": [["a"]]}
    for head, error in (({"type": "other/graph", "version": "0.8.0"}, "expected tool/graph"), ({"type": "tool/graph", "version": "0.7.0"}, "isn't supported")):
        with pytest.raises(ValueError, match=error):
            documents.read_graph(spark, put(tmp_path, [head, body]), "tool")
    with pytest.raises(ValueError, match="doesn't say"):
        documents.read_graph(spark, put(tmp_path, body), "tool")
    with pytest.raises(Exception, match="no node has position 3"):
        documents.read_graph(spark, put(tmp_path, [HEAD, body]), "tool").nodes.collect()


def test_weight_documents(spark, tmp_path):
    n = spark.createDataFrame([("", 0.5), ("a/b/", 2.0)], "prefix string, weight double")
    e = spark.createDataFrame([("x/", 1.0, 0.25)], "prefix string, forwards double, backwards double")
    documents.write(documents.weight_lines(n, e, "tool"), f"{tmp_path}/w")
    assert text_of(f"{tmp_path}/w") == [{"type": "tool/weights", "version": "0.2.0"}, {"edgeWeights": {"E\0x\0": {"backwards": 0.25, "forwards": 1.0}}, "nodeWeights": {"N\0": 0.5, "N\0a\0b\0": 2.0}}]
    back = documents.read_weights(spark, f"{tmp_path}/w", "tool")
    assert (rows(back[0]), rows(back[1])) == (rows(n), rows(e))
    documents.write(documents.weighted_graph_lines(small(spark), n, e, "tool"), f"{tmp_path}/b")
    g, n2, e2 = documents.read_weighted_graph(spark, f"{tmp_path}/b", "tool")
    assert rows(g.nodes) == rows(small(spark).nodes) and (rows(n2), rows(e2)) == (rows(n), rows(e))


def test_scored_processes(spark, tmp_path):
    at = lambda c: spark.range(1).select(c).first()[0]
    from pyspark.sql import functions as F

    nodes = spark.createDataFrame([("c/2/", "two", 1.0, None), ("c/10/", "ten", 0.0, 9)], "address string, description string, mint double, timestamp_ms long")
    people = spark.createDataFrame([("u/q/", "Q", "q"), ("u/p/", "P", "p")], "address string, description string, id string")
    epochs = spark.createDataFrame([(200,), (100,)], "start_ms long")
    own = at(epoch_node(F.lit(200), F.lit("q")))
    edges = spark.createDataFrame([("e/", False, "c/2/", own, 0.5), ("e/", True, own, "c/2/", 0.25)], "address string, reversed boolean, src string, dst string, pr double")
    mints = spark.createDataFrame([("c/2/", 1.0)], "address string, pr double")
    scores = spark.createDataFrame([(own, 0.75), (at(sum_node(F.lit(100))), 0.25)], "address string, score double")
    x = documents.Process(nodes, edges, people, epochs, mints, scores)
    documents.write(documents.scored_lines(x, '{"alpha":0.1}', 300), f"{tmp_path}/p")
    found = text_of(f"{tmp_path}/p")
    assert [n["address"] for n in found["mpg"]["nodes"]] == ["N\0c\x0010\0", "N\0c\x002\0"]
    # c/10, c/2, seed, sum 100, p 100, q 100, sum 200, p 200, q 200
    assert found["scores"] == [0, 0, 0, 0.25, 0, 0, 0, 0, 0.75]
    assert [(e["src"], e["dst"], e["reversed"]) for e in found["mpg"]["indexedEdges"]] == [(1, 8, False), (8, 1, True)]
    assert found["mpg"]["indexedMints"] == [[1, 1.0]] and found["mpg"]["epochStarts"] == [100, 200]
    back = documents.read_scored(spark, f"{tmp_path}/p")
    for name in ("nodes", "edges", "participants", "epochs", "mints"):
        assert rows(getattr(back, name)) == rows(getattr(x, name)), name
    assert rows(back.scores.where("score > 0")) == rows(scores) and back.scores.count() == 9
    assert rows(documents.read_process(spark, put(tmp_path, found["mpg"])).edges) == rows(edges)


def test_view_documents(spark, tmp_path):
    who = lambda i, cred: {"active": True, "identity": {"id": i, "name": i, "subtype": "USER"}, "cred": 3, "credPerInterval": cred, "grainEarned": "5", "grainEarnedPerInterval": ["0", "5"]}
    weeks = [{"startTimeMs": 1, "endTimeMs": 2}, {"startTimeMs": 2, "endTimeMs": 3}]
    view, people = documents.read_view(spark, put(tmp_path, {"participants": [who("a", [1.5, 0])], "intervals": weeks}))
    assert rows(view) == [("a", 1, 2, 1.5, 0), ("a", 2, 3, 0.0, 5)] and rows(people) == [("a", "a", "USER", True)]
    with pytest.raises(Exception, match="another length"):
        documents.read_view(spark, put(tmp_path, {"participants": [who("a", [1.5])], "intervals": weeks}, "y.json"))[0].collect()
