import numpy as np
from pyspark.sql import functions as F

from lexigraph.functions import hashing
from lexigraph.operators import build, nodeset
from lexigraph.operators import phrases as P
from lexigraph.plans.flow import Flow, Graph


def unsigned(x):
    return int(x) & ((1 << 64) - 1)


def test_hashes_match_known_values():
    assert unsigned(hashing.hash_texts(["FeSe is a material."])[0]) == 3797235776056707210
    assert unsigned(hashing.hash_texts(["Nature"])[0]) == 16381206556987855680
    text = int(hashing.hash_texts(["FeSe is a material."]).view(np.int64)[0])
    assert unsigned(hashing.hash_paths([[-1, text]])[0]) == 253473544312511038


def test_small_graph(spark):
    d = spark.createDataFrame([(1, "a b a c"), (2, None), (3, "")], "doc_id long, text string")
    edges = {(r.i, r.j): r["count"] for r in build.neighbour_edges(d).collect()}
    assert edges == {(build.BEGIN, "a"): 1, ("a", "▁b"): 1, ("▁b", "▁a"): 1, ("▁a", "▁c"): 1, ("▁c", build.END): 1}
    g = Graph(build.word_nodes(d), {"next": build.with_prob(build.neighbour_edges(d))})
    out = Flow(g).select(["a"]).traverse("next").result().collect()
    assert abs(sum(r.prob for r in out) - 1) < 1e-9 and {r.id for r in out} == {"▁b", "▁c"}


def test_set_operators(spark):
    a, b = nodeset.select_weighted(spark, {"x": 3, "y": 1}), nodeset.select_weighted(spark, {"y": 1, "z": 1})
    assert {r.id for r in nodeset.intersect([a, b]).collect()} == {"y"}
    assert {r.id for r in nodeset.join([a, b]).collect()} == {"x", "y", "z"}
    assert {r.id for r in nodeset.without(a, b).collect()} == {"x"}
    s = nodeset.statistics(nodeset.uniform(a)).first()
    assert s.n == 2 and abs(s.std) < 1e-9 and abs(s.ent - np.log(2)) < 1e-9


def test_unknown_edge_is_an_error(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    try:
        Flow(Graph(build.word_nodes(d), {})).select(["a"]).traverse("next")
    except ValueError:
        return
    raise AssertionError


def test_streamed_counts_equal_batch_counts(spark, tmp_path):
    from lexigraph.streaming.ingest import ingest, totals

    d = spark.createDataFrame([(1, "a b a"), (2, "b a")], "doc_id long, text string")
    d.write.parquet(f"{tmp_path}/in")
    ingest(spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/c", once=True).awaitTermination()
    got = {(r.i, r.j, r["count"]) for r in totals(spark, f"{tmp_path}/out").collect()}
    assert got == {(r.i, r.j, r["count"]) for r in build.neighbour_edges(d).collect()}


def test_registered_queries_match_sql(spark):
    import duckdb

    from lexigraph import queries

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "pages", "nation", "orders", "lineitem", "customer", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    empty = []
    for name, sql in queries.SQL.items():
        rows = queries.QUERIES[name](spark, sf)
        cols = sorted(rows.columns)
        got = sorted(tuple(str(r[c]) for c in cols) for r in rows.collect())
        want = sorted(tuple(str(x) for x in r) for r in con.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall())
        assert got == want, name
        empty += [name] * (not got)
    assert not empty


def test_terms_and_taxonomy(spark):
    texts = [(1, "big old dog of old dog and dog", "en"), (2, None, "en"), (None, "", None), (3, "old dog. the old dog is big", "en"), (3, "word " * 30_000, "en")]
    rows = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    terms = P.term_nodes(rows)
    got = {r.text: (r.word_cnt, r.text_cnt) for r in terms.collect()}
    long = " ".join(["word"] * 30_000)
    assert got == {"big old dog": (1, 1), "old dog": (3, 2), "dog": (1, 1), "big": (1, 1), long: (1, 1)}
    short = terms.where("length(text) < 100")
    assert {(r.i, r.j, r["count"]) for r in P.root_edges(short).collect()} == {("big old dog", "dog", 1), ("old dog", "dog", 3)}
    assert {(r.i, r.j, r["count"]) for r in P.taxonomy_edges(short).collect()} == {("big old dog", "old dog", 1), ("old dog", "dog", 3)}
    none = rows.where("false")
    assert P.term_nodes(none).count() == P.sentence_nodes(none).count() == P.taxonomy_edges(P.term_nodes(none)).count() == 0


def test_document_edges(spark):
    rows = spark.createDataFrame([(1, "a b a"), (1, "a"), (2, None), (None, "a")], "doc_id long, text string")
    assert {(r.i, r.j, r["count"]) for r in build.document_edges(rows).collect()} == {("a", "1", 2), ("▁b", "1", 1), ("▁a", "1", 1)}


def test_annotations():
    """Every model has a hit, earlier patterns win, and places are bytes."""
    from lexigraph.operators import annotate as A

    found = lambda text, kind: [(sub, text[s:e]) for _, sub, s, e in A.annotations(text, [kind])]
    assert found("the 3rd in 1987 at 3.5e4, 7 - 9 or 10^3 of 2.5", "numval") == [("enum", "3"), ("year", "1987"), ("fsci", "3.5e4"), ("irng", "7 - 9"), ("fexp", "10^3"), ("fval", "2.5")]
    assert found("3.5 +- 0.2 kg", "numval") == [("fval", "3.5"), ("fval", "- 0.2")]  # the sign is the second number's
    assert found("see https://a.b/c) or doi:10.1/x. a@b.de", "link") == [("url", "https://a.b/c"), ("doi", "doi:10.1/x"), ("email", "a@b.de")]
    assert found("as in ~\\cite{a,b} and [[1,2-3]]", "cite") == [("latex-cite", "~\\cite{a,b}"), ("wiki-cite", "[[1,2-3]]")]
    assert found("Institute of Applied Science met Ada B. Lovelace et al.", "name")[0] == ("specialised-name", "Institute of Applied Science")
    assert found('so "Order of day" it is', "quote") == [("quote", '"Order of day"')]
    assert found("a (3) b [1-2] c (see d) e [f]", "parenthesis") == [("reference", "(3)"), ("reference", "[1-2]"), ("round brackets", "(see d)"), ("square brackets", "[f]")]
    assert ("latex", "$x_1$") in found("where $x_1$ is--not well-known here", "expression") and ("repetition", "--") in found("is--not", "expression")
    assert found("It is so. no end", "sentence") == [("proper", "It is so."), ("improper", "no end")]
    assert found("It is Mr. Big. no end", "sentence")[0][0] == "improper"  # a name hides its points
    assert A.closure(["quote"]) == ["numval", "quote"]


def test_two_numbers_are_one_at_most():
    from lexigraph.operators import annotate as A

    found = lambda text: [(sub, text[s:e]) for _, sub, s, e in A.annotations(text, ["numval"])]
    assert found("1 2 3 4 5") == [("fsci", "1 2"), ("fsci", "3 4"), ("ival", "5")]
    assert found("10.1/77 and 8 / $9") == [("fsci", "10.1/77"), ("fsci", "8 / $9")]
    assert found("3 x 4 times 5, 6 \\pm 7 $ 8") == [("fsci", "3 x 4"), ("ival", "5"), ("fsci", "6 \\pm 7"), ("ival", "8")]
    assert found("1 + 2") == [("ival", "1"), ("ival", "2")] and found("1         2") == [("fsci", "1         2")] and found("1          2") == [("ival", "1"), ("ival", "2")]
    assert len(found("12 " * 40_000)) == 20_000


def test_annotation_takes_time_in_proportion_to_length():
    """Ordinary dirt by the megabyte; going back through a run would take hours."""
    import time

    from lexigraph.operators import annotate as A

    dirt = ["A" * 1_000_000, "Aa " * 300_000, "Aa" + " -" * 400 + " x", "1" * 1_000_000, "1." + "2" * 1_000_000, "12 " * 100_000, "A. " * 200_000, "{\\a" * 200_000, "\\cite{" * 100_000, "x" * 1_000_000, "''a" * 200_000, "é1 " * 200_000, "(" * 500_000, "\\begin{a} " * 50_000]
    for text in dirt:
        for kind in A.PATTERNS:
            start, own = time.time(), text
            for _, pattern in A._COMPILED[kind]:
                sum(1 for _ in pattern.finditer(own))
            assert time.time() - start < 20, (kind, text[:20])
    start = time.time()
    assert len(A.annotations("12 " * 100_000, ["sentence"])) == 0 and len(A.annotations("Aa " * 50_000, ["sentence"])) == 1
    assert time.time() - start < 20


def test_linear_patterns_equal_plain_ones():
    import random
    import re

    from lexigraph.operators import annotate as A

    r = random.Random(4)
    pieces = ["Aa", "Bb", "Ccc", " ", " ", " ", "  ", "of", "for", "and", "A.", "B.", "A", "-", "--", "1", "23", "4.5", "6,7", "e", "E", "18", "1999", "20", "'s", "th", "10^", "(", ")", "[", "]", "{", "}", "\\", "\\cite{", "\\begin{", "\\end{", "a", ".", "?", '"', "''", "'", "@", "$", "$$", "\n", ",", "et al.", "https", "doi:", "_", "^"]
    for _ in range(3000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(1, 26)))
        for kind, patterns in A.PATTERNS.items():
            for (_, plain), (_, own) in zip(patterns, A._COMPILED[kind], strict=True):
                group = lambda p: "x" if "x" in p.groupindex else 0
                plain = re.compile(plain)
                assert [m.span(group(plain)) for m in plain.finditer(text)] == [m.span(group(own)) for m in own.finditer(text) if m.span(group(own))[0] >= 0], (own.pattern, text)


def test_annotation_rows(spark):
    from lexigraph.operators import annotate as A

    rows = spark.createDataFrame([(1, "é 12 x", 5), (2, None, 5), (None, "", 5), (3, "7", 5), (3, "7", 5)], "doc_id long, text string, kind int")
    got = sorted((r.doc_id, r.kind, r.i, r.j, r.ci, r.cj, r.name) for r in A.annotate(rows, ["numval"]).collect())
    assert got == [(1, "numval", 3, 5, 2, 4, "12"), (3, "numval", 0, 1, 0, 1, "7"), (3, "numval", 0, 1, 0, 1, "7")]
    own = A.annotate(rows, custom={"letters": [("x", "x"), ("any", "[a-z]")]}).collect()
    assert [(r.kind, r.subtype, r.original) for r in own] == [("letters", "x", "x")]
    assert A.annotate(rows.where("false")).count() == 0
    spans = spark.createDataFrame([(1, "term", "t", 0, 10), (1, "term", "t", 20, 30), (1, "term", "t", 40, 50), (2, "term", "t", 0, 1)], "doc_id long, kind string, subtype string, i long, j long")
    other = spark.createDataFrame([(1, "link", "url", 8, 12), (1, "name", "person-name", 18, 32), (1, "name", "person-name", 45, 60)], spans.schema)
    assert [(r.doc_id, r.i) for r in A.accepted(spans, other).collect()] == [(1, 40)]


def test_flow_configuration(spark):
    d = spark.createDataFrame([(1, "big old dog of old dog and dog"), (2, "old dog")], "doc_id long, text string")
    terms = P.term_nodes(d)
    from pyspark.sql import functions as F

    nodes = build.word_nodes(d).unionByName(terms.select(F.lit("term").alias("name"), "text", "word_cnt", "text_cnt"))
    g = Graph(nodes, {"tax-up": lambda: build.with_prob(P.taxonomy_edges(terms)), "next": build.with_prob(build.neighbour_edges(d))}, P.parts(terms))
    flow = Flow(g).select([["big", "old", "dog"]]).traverse("tax-up").select(["old"]).filter_contains(2, 1).subgraph(["tax-up"], [0])
    again = Flow.from_config(g, flow.to_config())
    for k in range(5):
        assert {r.id for r in flow.result(k).collect()} == {r.id for r in again.result(k).collect()}
    assert {r.id for r in flow.result(0).collect()} == {"big old dog"} and {r.id for r in flow.result(3).collect()} == {"old dog"} == {r.id for r in flow.result(1).collect()}
    assert {r.id for r in flow.result(4).collect()} == {"big old dog", "old dog"} and [(r.i, r.j) for r in flow.links[4].collect()] == [("big old dog", "old dog")]
    assert [r.flop for r in flow.overview().orderBy("flid").collect()] == ["SELECT", "TRAVERSE", "SELECT", "FILTER", "SUBGRAPH"]
    h = nodeset.node_hash(nodes).where("text = 'old dog'").first().hash
    assert {r.id for r in Flow(g).select_hashes([(h, 1.0), (h, 2.0)]).result().collect()} == {"old dog"}
    for bad in ([{"flop": "UNIFORM", "flid": 1, "deps": [7]}], [{"flop": "UNIFORM", "flid": 1, "deps": [2]}, {"flop": "UNIFORM", "flid": 2, "deps": [1]}], [{"flop": "DANCE", "flid": 1}]):
        try:
            Flow.from_config(g, {"flow": bad})
        except ValueError:
            continue
        raise AssertionError(bad)


def test_plans_grow_with_steps_alone(spark):
    d = spark.createDataFrame([(1, "a b a c a b")], "doc_id long, text string")
    flow = Flow(Graph(build.word_nodes(d), {"next": build.with_prob(build.neighbour_edges(d))})).select(["a"])
    for _ in range(8):
        flow.traverse("next").uniform()
    assert flow.result()._jdf.queryExecution().optimizedPlan().toString().count("parquet") <= 4


def test_saved_graph(spark, tmp_path):
    from lexigraph.sources import graph_io

    d = spark.createDataFrame([(1, "a b a c"), (2, "b")], "doc_id long, text string")
    nodes, edges = build.word_nodes(d), build.with_prob(build.neighbour_edges(d))
    for kind in ("parquet", "json", "csv"):
        graph_io.save(nodes, {"next": edges}, f"{tmp_path}/{kind}", kind)
        got_nodes, got = graph_io.load(spark, f"{tmp_path}/{kind}", ["next"], kind)
        assert sorted(map(tuple, got_nodes.collect())) == sorted(map(tuple, nodes.select(got_nodes.columns).collect()))
        assert sorted((r.i, r.j, r["count"], round(r.prob, 9)) for r in got["next"].collect()) == sorted((r.i, r.j, r["count"], round(r.prob, 9)) for r in edges.collect())


def test_phrases_inside_rows_equal_those_by_windows(spark):
    from collections import Counter

    from lexigraph.operators import hierarchy as H

    texts = [(1, "The big old house of the city must have been seen. It is going to the big old house! no"), (2, None), (3, ""), (4, "by the of a to an and"), (5, "Dogs ran quickly. Dogs would bark"), (6, "house " * 5000 + ".")]
    rows = spark.createDataFrame(texts, "doc_id long, text string").withColumn("name", F.lit("x"))
    tagged = H.tagged(rows)
    for kind, by in (("term", H.terms), ("verb", H.verbs), ("conn", H.connectors)):
        want = Counter((r.doc_id, r.sent, r.lo, r.hi, r.text) for r in by(tagged).collect())
        assert Counter((r.doc_id, r.sent, r.lo, r.hi, r.text) for r in H.phrases_in(rows, kind).collect()) == want and want
        counts = {(r.text, r.word_cnt, r.sent_cnt, r.text_cnt) for r in H.phrase_nodes(by(tagged)).collect()}
        assert {(r.text, r.word_cnt, r.sent_cnt, r.text_cnt) for r in H.phrase_counters(rows, kind).collect()} == counts
    assert H.phrase_counters(rows.where("false"), "term").count() == 0
