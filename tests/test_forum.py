from meritgraph.operators import forum


def test_whole_graph(spark):
    of = spark.createDataFrame
    posts = of([("p1", "t", 1, None, "ann", 5), ("p2", "t", 2, None, "bob", 6)], "post string, topic string, index int, reply_to_index int, author string, ms long")
    likes = of([("p1", "bob", 7), ("p2", "new", 8)], "post string, author string, ms long")
    users = of([("ann", 3), ("bob", 4)], "author string, trust int")
    topics = of([("t", "ann", "Title", 5, "c")], "topic string, author string, title string, ms long, category string")
    found = of([("p2", "forum/user/ann/"), ("p2", "forum/user/ann/"), ("p2", None)], "post string, address string")
    g, weights = forum.graph(posts, likes, users, topics, of([], "topic string, tag string"), {"c": 2.0}, {}, found)
    edges = {r.address: (r.src, r.dst, r.timestamp_ms) for r in g.edges.collect()}
    assert len(edges) == g.edges.count() == 12  # 1 + 2 + 2 + 1 + 2 + 2 + 1 + 1
    assert edges["forum/replyTo/forum/post/p2/"] == ("forum/post/p2/", "forum/post/p1/", 6)
    assert edges["forum/topicHasLikedPost/forum/topic/t/forum/post/p1/"] == ("forum/topic/t/", "forum/post/p1/", 5)
    assert edges["forum/references/forum/post/p2/forum/user/ann/"] == ("forum/post/p2/", "forum/user/ann/", 6)
    assert {r.address: r.weight for r in weights.collect()} == {"forum/like/bob/p1/": 3.0, "forum/like/new/p2/": 0.0, "forum/topicHasLikedPost/forum/topic/t/forum/post/p1/": 3.0}
    assert g.nodes.count() == 1 + 2 + 2 + 3
