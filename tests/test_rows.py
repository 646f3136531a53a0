"""What is found inside a text's row equals what columns and windows find."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexigraph.functions import rows as W
from lexigraph.functions import text as T
from lexigraph.operators import annotate as A
from lexigraph.operators import hierarchy as H
from lexigraph.operators import phrases as P
from lexigraph.operators import relations as R

ODD = [None, "", " ", "▁", "▁a b", " a b\t\n12x. İs Ωσ ΣΑΣ ß ǅ? Cafés", "9 9a a9 ..!", "a  ▁ b ▁", "x y \x0bz_1-2", "The UC (Uc) of (a) (B) to the(C)"]


def texts(spark, n=60):
    r = random.Random(5)
    words = ["the", "to", "of", "may", "is", "going", "big", "famous", "House", "Unit", "Cost", "quickly", "(", "(UC)", ")", ".", "?", ",", "12", "UC"]
    made = [" ".join(r.choice(words) for _ in range(r.randint(1, 40))) for _ in range(n)]
    return spark.createDataFrame(list(enumerate([*ODD, *made])), "doc_id long, text string")


def test_tokens_and_tags_equal_the_columns(spark):
    rows = texts(spark)
    tag = T.part_of_speech_sql("x")
    got = rows.select("text", T.words().alias("w")).select("text", "w", F.transform("w", T.unmarked).alias("p")).select("text", "w", "p", F.expr(f"transform(p, x -> {tag})").alias("t")).collect()
    for r in got:
        found = W.pieces(r.text)
        assert ([W.marked(x) for x in found], [W.plain(x) for x in found], [W.part_of_speech(W.plain(x)) for x in found]) == (r.w, r.p, r.t)
    assert any("NNP" in r.t for r in got)


def edges(table):
    return Counter({(r.i, r.j): r["count"] for r in table.collect()})


def no_windows(table):
    """No token leaves its row: a table of tokens is neither sorted nor joined."""
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_edges_inside_rows_equal_those_by_windows(spark):
    rows = texts(spark)
    tagged = H.tagged(rows).cache()
    got = H.neighbours_in(rows, "conn", "term", "verb")
    assert edges(got) == edges(H.phrase_neighbours(tagged, H.connectors(tagged), H.terms(tagged), H.verbs(tagged)))
    no_windows(got)
    got = H.labels_in(rows)
    assert edges(got) == edges(H.label_edges(tagged, H.terms(tagged)))
    no_windows(got)
    got, want = H.short_forms_in(rows), H.abbreviations(H.bracketed(tagged), H.terms(tagged)).collect()
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want)) and len(want) > 3
    no_windows(got)
    twice = rows.where("doc_id > 12").selectExpr("CAST(null AS long) AS doc_id", "text")
    assert edges(H.labels_in(twice.unionByName(twice))) == {k: 2 * n for k, n in edges(H.labels_in(twice)).items()}
    assert H.short_forms_in(twice).count() == 0 == H.neighbours_in(rows.where("false"), "term").count()


def test_relation_edges_inside_rows_equal_those_by_joins(spark):
    made = ["See the Unit Cost (UAC) of it.", "See the big Unit Cost (UBC) of it.", "big old house (UCC) and big old house (UCC)", "house (house)", "Unit Cost (12)", "Ada Byron (ABC) of Ada Byron (abc)", "(UC)"]
    rows = texts(spark).unionByName(spark.createDataFrame([*enumerate(made, 1000), (None, made[0])], "doc_id long, text string"))
    terms = H.phrases_in(rows, "term")
    found = R.abbreviations(R.mentions(rows), terms)
    want = Counter({(r.name, r.i, r.j): r["count"] for r in R.relation_edges(found, terms).collect()})
    got = R.edges_in(rows)
    assert Counter({(r.name, r.i, r.j): r["count"] for r in got.where("i is not null").collect()}) == want and len(want) > 4
    assert got.agg(F.sum("count")).first()[0] == found.count() > sum(want.values())
    no_windows(got)


@pytest.mark.parametrize("query", ["phrase_edges", "begin_end_edges", "abbreviation_links", "relation_edges"])
def test_queries_stay_inside_rows(spark, query):
    import __spark_entry__ as entry

    plan = entry.queries()[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [" not in plan.replace("Window [row_number() windowspecdefinition(name", "") and plan.count("Join") <= (query == "relation_edges")


ATOMS = ["1", "7", "10", "1995", "80", "st", "rd", "ies", "'s", "s", "'", "-", "- ", "--", " ", "  ", "\n", ".", ",", "^", "10^", "(", ")", "{", "}", "[", "]", "e", "E", "et", "et al", "of ", "and ", "for ", "Ab", "Hans", "Maier", "A.", "B", "A. ", "Von", "x", "word", "\\", "\\cite{x}", "$", "$$", "/", "@", "''", "'''", '"', "=", "etc.", "...", "no.", "i.e.", "e.g. ", "<a>", "é", "٣", "\0", "(UC)x", "\\begin{a}", "\\end{a}"]


def plain_cascade(kind, text):
    """The patterns as they are written, each over the whole text."""
    found = []
    for sub, p in A.PATTERNS[kind]:
        pattern = re.compile(p)
        hits = [m.span("x" if "x" in pattern.groupindex else 0) for m in pattern.finditer(text)]
        found += [(sub, s, e) for s, e in hits]
        for s, e in hits if kind not in A.PLAIN else ():
            text = text[:s] + " " * (e - s) + text[e:]
    return found


def test_patterns_find_the_same_in_short_forms():
    r = random.Random(11)
    hits = Counter()
    for _ in range(4000):
        text = "".join(r.choice(ATOMS) for _ in range(r.randint(1, 40)))
        known = {k: plain_cascade(k, text) for k in A.PATTERNS if k not in ("quote", "sentence")}
        for kind, want in known.items():
            assert A.cascade(kind, text) == want, (kind, text)
            hits[kind] += len(want)
        numbers = A._values(text, known["numval"])
        quotes = sorted(plain_cascade("quote", A._masked(text, [(s, e) for _, s, e in numbers])), key=lambda x: x[1:])
        assert A.annotations(text, ["quote"]) == [("quote", *x) for x in quotes], text
        hits["quote"] += len(quotes)
    assert len(hits) == 7 and min(hits.values()) > 20, hits


def test_expressions_and_quotes_run_no_other_model(monkeypatch):
    """They took most of the time of annotate_expressions, and nothing read them."""
    ran, own = [], A.cascade
    monkeypatch.setattr(A, "cascade", lambda kind, *a: ran.append(kind) or own(kind, *a))
    text = 'On 5 May "Order of the day" by Hans Maier [1] rose--again.'
    assert [x[:2] for x in A.annotations(text, ["quote", "expression"])][0] == ("quote", "quote") and ran == ["quote", "expression"]
    ran.clear()
    A.annotations('the "order 5 of the day"', ["quote"])
    assert ran == ["numval", "quote"]


def test_counts_equal_rows(spark):
    rows = spark.createDataFrame([(1, "3.5 or 1995 and 7"), (1, "8"), (None, "4 - 5"), (2, None), (3, ""), (4, "none")], "doc_id long, text string")
    want = Counter((r.doc_id, r.kind, r.subtype) for r in A.annotate(rows, ["numval"], compound=False).collect())
    assert {tuple(r)[:3]: r.n for r in A.counts(rows, ["numval"], compound=False).collect()} == want and sum(want.values()) == 5
    assert {r.subtype for r in A.annotate(rows, ["numval"], subtypes=("year",)).collect()} == {"year"}


def test_term_nodes_equal_the_columns(spark):
    rows = texts(spark)
    got = P.term_nodes(rows.unionByName(rows))
    want = P.counted(P.term_runs(rows.unionByName(rows)), "terms")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.select("text", "word_cnt", "text_cnt").collect()))
    assert "MapInArrow" in got._jdf.queryExecution().optimizedPlan().toString()  # no tagger for each token by columns


def test_phrases_leave_python_in_parts(spark):
    """Rows of some texts at a time, not arrays of a whole batch; the tagger isn't run for each token by columns."""
    rows = texts(spark)
    plan = H.phrases_in(rows, "term")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan and "CASE" not in plan
    shown = lambda table: Counter(map(tuple, table.select("doc_id", "name", "sent", "lo", "hi", "text").collect()))
    assert shown(H.phrases_in(rows)) == shown(H.phrases_of(rows).select("doc_id", F.inline("phrases")))
