from lexigraph.operators import expand as X


def test_concepts(spark):
    pairs = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(12)] + [("xs", "x"), ("x", "xs")], "plural string, singular string")
    nodes = spark.createDataFrame([(f"w{k}", k + 1) for k in range(13)] + [("x", 3), ("xs", 1), ("lone", 5)], "text string, text_cnt long")
    words = spark.createDataFrame([("w0",), ("x",), ("x",), ("lone",), ("none",), (None,)], "word string")
    rows = X.concepts(words, pairs, nodes).collect()
    got = {}
    for r in rows:
        got.setdefault(r.word, {})[r.id] = (r.weight, round(r.prob, 6))
    assert set(got) == {"w0", "x", "lone"} and set(got["w0"]) == {f"w{k}" for k in range(7)}  # six hops
    assert got["x"] == {"x": (3, 0.75), "xs": (1, 0.25)} and got["lone"] == {"lone": (5, 1.0)}
    assert max(round(r.cumul, 6) for r in rows) == 1.0
    assert X.concepts(words.where("false"), pairs, nodes).count() == 0


def test_a_round_without_news_ends_the_loop(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(X, "cut", lambda rows, name: seen.append(name) or rows)
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "i string, j string")
    assert X.reached(spark.createDataFrame([("a",)], "word string"), edges, 50).count() == 2
    assert len(seen) == 3  # the start, one hop, and one that adds nothing
