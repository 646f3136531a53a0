import random
from collections import Counter

from lexigraph.operators import annotate as A
from lexigraph.operators import retrieval as D


def test_best_documents_equal_brute_force(spark):
    """Whatever counts as rare; ties, hot words, nulls, empty and repeated rows."""
    r = random.Random(4)
    docs = [(k, " ".join(["the", "of"] * (k % 3 > 0) + [f"w{r.randint(0, 30)}" for _ in range(r.randint(0, 8))])) for k in range(60)]
    docs += [(70, None), (71, ""), (None, "the w1"), (5, "w1 w2"), (5, "w1 w2")]
    asked = [(k, " ".join(r.choice(["the", "of", "zzz", *(f"W{n}" for n in range(31))]) for _ in range(6))) for k in range(12)] + [(20, None), (21, "the"), (None, "the")]
    own, questions = {}, {}
    for table, rows in ((own, docs), (questions, asked)):
        for k, t in rows:
            if k is not None and t:
                table.setdefault(k, set()).update(t.lower().split())
    # the tokeniser parts letters from digits
    split = lambda ws: {p for w in ws for p in ([w[0], w[1:]] if w[:1] == "w" else [w])}
    own, questions = {k: split(v) for k, v in own.items()}, {k: split(v) for k, v in questions.items()}
    df = Counter(w for ws in own.values() for w in ws)
    want = set()
    for i, ws in questions.items():
        scores = {d: round(sum(1 / df[w] for w in ws & ds), 6) for d, ds in own.items() if ws & ds}
        want |= {(i, d, k + 1) for k, (_, d) in enumerate(sorted((-s, d) for d, s in scores.items())[:5])}
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, text string")
    for rare in (0, 2, 6, 1000):
        assert {(x.item_id, x.doc_id, x.rank) for x in D.best_documents(d, q, 5, rare).collect()} == want, rare
    found = D.best_documents(d, q, 5)
    truth = spark.createDataFrame([(0, next(x[1] for x in sorted(want, key=lambda x: (x[0], x[2])) if x[0] == 0)), (1, 999)], "item_id long, doc_id long")
    assert {(x.k, x.n, x.hits, x.recall) for x in D.recall(found, truth, (1, 3)).collect()} == {(1, 2, 1, 0.5), (3, 2, 1, 0.5)}
    assert D.best_documents(d.where("false"), q).count() == D.best_documents(d, q.where("false")).count() == 0


def test_spans_meet_by_bins(spark):
    r = random.Random(7)
    spans = lambda n, most: [(r.choice([1, 1, 1, 2, None]), i := r.randint(0, 3000), i + r.randint(0, most)) for _ in range(n)]
    inner, outer = spans(150, 60), list(set(spans(60, 900)))
    schema = "doc_id long, i long, j long"
    got = Counter((x.doc_id, x.outer_i, x.outer_j, x.n) for x in A.contained(spark.createDataFrame(inner, schema), spark.createDataFrame(outer, schema)).collect())
    want = Counter()
    for d, i, j in inner:
        holds = [(d, a, b) for e, a, b in outer if d is not None and e == d and a <= i and j <= b] or [(d, None, None)]
        want.update(holds)
    assert got == Counter((*k, n) for k, n in want.items())
    kinds = [("link", "url"), ("parenthesis", "reference"), ("parenthesis", "round brackets"), ("name", "person-name"), ("numval", "ival"), ("term", "t")]
    others = [(*x, *r.choice(kinds)) for x in spans(60, 300)]
    rows = [(*x, n) for n, x in enumerate(inner)]
    kept = {x.n for x in A.accepted(spark.createDataFrame(rows, schema + ", n int"), spark.createDataFrame(others, schema + ", kind string, subtype string")).collect()}
    bad = lambda d, i, j: any(d is not None and e == d and ((k == "link" or s == "reference") and i < b and a < j or k in ("name", "numval") and a <= i and j <= b) for e, a, b, k, s in others)
    assert kept == {n for d, i, j, n in rows if j - i > 1 and not bad(d, i, j)} and len(kept) < len(rows)


def test_dictionary_hits(spark):
    texts = spark.createDataFrame([(1, "New York and new york, Paris"), (2, None), (None, "paris"), (3, "")], "doc_id long, text string")
    names = spark.createDataFrame([("New York",), ("Paris",), ("Paris",), (None,), ("",), ("Rio de Janeiro",)], "name string")
    assert {tuple(x) for x in A.dictionary_hits(texts, names).collect()} == {(1, "New York", 2), (1, "Paris", 1), (None, "Paris", 1)}
    assert A.dictionary_hits(texts, names.where("false")).count() == 0


def test_only_words_of_questions_are_kept(spark, monkeypatch):
    kept, own = {}, D.cut
    monkeypatch.setattr(D, "cut", lambda df, name: kept.setdefault(name, own(df, name)))
    documents = spark.createDataFrame([(1, "a b c"), (2, "b d"), (2, "b d"), (None, "a")], "doc_id long, text string")
    found = D.best_documents(documents, spark.createDataFrame([(7, "B a x")], "item_id long, text string")).collect()
    assert [(r.doc_id, r.rank) for r in found] == [(1, 1), (2, 2)]
    assert {(r.doc_id, r.w) for r in kept["document-words"].collect()} == {(1, "a"), (1, "b"), (2, "b")}


def test_no_text_is_copied_for_each_of_its_words(spark, monkeypatch):
    from lexigraph import queries

    plans, own = [], queries.cut
    monkeypatch.setattr(queries, "cut", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or own(df, name))
    assert {r.k for r in queries.QUERIES["question_recall"](spark, "/root/testdata/sf0.001").collect()} == {1, 3, 9}
    assert len(plans) == 1 and "Generate explode" in plans[0]
    generate = next(line for line in plans[0].split("\n") if "Generate explode" in line)
    assert "text#" not in generate[generate.rindex("[") :]
    above = plans[0][: plans[0].index("Generate explode")].split("\n")
    assert not any("Project" in line and ", text#" in line for line in above)
