"""References, metadata, characters that look alike, abbreviations, edges of relations and enumerations."""

import time
import unicodedata

import pytest

from lexigraph.functions import confusables as K
from lexigraph.operators import annotate as A
from lexigraph.operators import bibliography as Y
from lexigraph.operators import hierarchy as H
from lexigraph.operators import relations as R

GOLDEN = "[1] J. Nagamatsu, N. Nakagawa, T. Muranaka, Y. Zenitani, and J. Akimitsu, Superconductivity at 39K in magnesium diboride, Nature 410, 63 (2001)."


def named(text):
    return [(label, Y.field_name(label, text[s:e])) for label, s, e in Y.fields(text)]


def test_reference_of_known_places():
    got = {label: (s, e) for label, s, e in Y.fields(GOLDEN)}
    assert got == {"reference-number": (0, 3), "authors": (4, 73), "title": (74, 121), "journal": (122, 128), "volume": (129, 136), "date": (137, 144)}
    assert dict(named(GOLDEN))["date"] == "2001" and dict(named(GOLDEN))["volume"] == "410, 63"


def test_fields():
    assert named("[1900] Smith, J. and Meyer-Lang, K. \"A 7 b\", North Press, Zurich, ISBN 978-3-16-148410-0, 1999. https://a.example/7 x") == [("reference-number", "1900"), ("authors", "Smith, J. and Meyer-Lang, K"), ("title", '"A 7 b"'), ("publisher", "North Press"), ("date", "1999"), ("url", "https://a.example/7"), ("isbn", "ISBN 978-3-16-148410-0"), ("note", "Zurich"), ("note", "x")]
    assert Y.field_name("doi", "doi: 10.1 /x.") == "10.1/x" and Y.field_name("note", "[(arXiv preprint a).],") == "a"
    assert named("") == named(".,.") == named(" ") == [] and named("é Ünder, b") == [("title", "é Ünder"), ("journal", "b")]


def test_dirt_is_read_once():
    start = time.time()
    for dirt in ("A. ", "Aa Bb ", "[1] ", "10.1", "van ", '("', "Aa-", "1. ", "Aa, B. ", ", ", "Mar 19"):
        Y.fields(dirt * 50_000)
    assert time.time() - start < 60


def test_references_rows(spark):
    texts = [(1, "A. Öe, a b, C 3", "reference"), (2, None, "reference"), (3, "", "reference"), (None, "x y", "reference"), (4, "x y", "text"), (5, "x y", None), (6, "x y", "reference"), (6, "x y", "reference")]
    rows = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, label string, name int")
    found = Y.references(rows)
    got = sorted((str(r.doc_id), r.label, r.i, r.j, r.ci, r.cj, r.name) for r in found.collect())
    assert [x for x in got if x[0] == "1"] == [("1", "authors", 0, 7, 0, 6, "A. Öe"), ("1", "journal", 13, 14, 12, 13, "C"), ("1", "title", 8, 12, 7, 11, "a b"), ("1", "volume", 15, 16, 14, 15, "3")]
    assert [x for x in got if x[0] == "6"] == [("6", "title", 0, 3, 0, 3, "x y")] * 2 and [x for x in got if x[0] == "None"] == [("None", "title", 0, 3, 0, 3, "x y")]
    assert {x[0] for x in got} == {"1", "6", "None"}
    whole = A.annotate(rows.selectExpr("doc_id", "'7 x' AS text"), ["numval"])
    assert sorted(r.doc_id for r in Y.kept_instances(whole, rows).collect()) == [4, 5]
    assert Y.references(rows.where("false")).count() == 0


def by_hand(texts, names):
    """Metadata of one document as loops."""
    texts, heads, out = sorted(texts), {}, []
    for at, page, text, _ in texts:
        if page is not None and page >= 2:
            break
        plain = (text or "").replace(" ", "").lower()
        heads |= {w: at for w in ("abstract", "introduction") if text is not None and (plain.startswith(w) or plain.endswith(w))}
    if not heads:
        return []
    ab, intro = heads.get("abstract"), heads.get("introduction")
    last = intro if ab is None else ab
    title = next((at - 1 for at, _, _, label in texts if 1 <= at < last and label == "meta-data"), -1)
    known = {at: text for at, _, text, _ in texts}
    out += [("title", title, known[title])] if title >= 0 else []
    kinds = {"person-name": "author", "specialised-name": "affiliation"}
    out += [(kinds[k], at, n) for at, k, n in names if title < at < last and k in kinds]
    if ab is not None and intro is not None:
        out += [("abstract", at, known[at]) for at in known if ab <= at < intro]
    elif ab is not None:
        out.append(("abstract", ab, known[ab]))
        if known[ab].lower().strip().endswith("abstract") and ab + 1 in known:
            out.append(("abstract", ab + 1, known[ab + 1]))
    return out


def test_metadata_by_hand(spark):
    import random

    rng, texts, names, want = random.Random(4), [], [], []
    pool = ["Abstract", " a b s tract", "Abstract: we", "Introduction", "1 INTRO duction", "x", "", None, "y z"]
    for doc in [*range(120), None]:
        own = [(at, rng.choice([None, 1]) if at < 6 else rng.choice([1, 2]), rng.choice(pool), rng.choice(["meta-data", "text", None])) for at in range(rng.randint(1, 9))]
        found = [(at, rng.choice(["person-name", "specialised-name", "person-group"]), f"N{at}") for at, *_ in own if rng.random() < 0.6]
        texts += [(doc, *t, "x") for t in own]
        names += [(doc, *n) for n in found]
        want += [(str(doc), f, at, str(n)) for f, at, n in by_hand(own, found)]
    rows = spark.createDataFrame(texts, "doc_id long, at long, page int, text string, label string, name string")
    people = spark.createDataFrame(names, "doc_id long, at long, subtype string, name string")
    got = [(str(r.doc_id), r.field, r.at, str(r.name)) for r in Y.metadata(rows, people).collect()]
    assert sorted(got) == sorted(want) and {f for _, f, _, _ in got} == {"title", "author", "affiliation", "abstract"}
    assert Y.metadata(rows.where("false"), people).count() == 0
    twice = Y.metadata(rows.unionByName(rows), people)
    assert twice.where("field = 'title'").count() == sum(f == "title" for _, f, _, _ in want)


def test_confusables(spark):
    table = K.whole()
    rule = K.by_rule()
    assert rule[" "] == " " and rule["ａ"] == "a" and rule["—"] == "-" and rule["а"] == "a" and rule["’"] == "'"
    assert all(unicodedata.normalize("NFKC", k) == v for k, v in rule.items() if 0xFF01 <= ord(k) <= 0xFF5E)
    texts = [(1, "ａбс\tх 😀—é"), (2, None), (3, ""), (None, "а"), (4, "plain"), (5, "а" * 100_000), (5, "а")]
    rows = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, normal string")
    got = [tuple(r) for r in K.changed(rows).collect()]
    want = []
    for doc, text in texts:
        plain = "".join(table.get(c, c) for c in text or "")
        for ci, c in enumerate(text or ""):
            if c in table:
                i, n = len(text[:ci].encode()) if ci < 50 else 2 * ci, len(plain[:ci].encode()) if ci < 50 else ci
                want.append((doc, c, table[c], ci, i, i + len(c.encode()), n, n + len(table[c].encode())))
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert [r[0] for r in rows.where("doc_id = 1").select(K.normalised()).collect()] == ["aбс x 😀-é".replace("с", "c")]
    assert rows.where("doc_id = 2").select(K.normalised()).first()[0] is None and K.changed(rows.where("false")).count() == 0
    with pytest.raises(ValueError):
        K.whole({"ab": "c"})


def test_confusables_of_a_file():
    lines = ["# head", "", "# spaces", "\t( )\t0020\t SPACE", "←\t( )\t00A0\t NO-BREAK SPACE", "", "# two", "\t(!!)\t0021 0021\t TWO", "←\t(x)\t203C\t DOUBLE", "←\t(y)\t2049\t Y", "# b", "\t(b)\t0062\t B", "←\t(v)\t0432\t VE\t# x"]
    assert K.parsed(lines) == {" ": " ", "⁉": "‼", "в": "b"}


def test_abbreviations_and_relation_edges(spark):
    texts = [(1, "See the big Unit Cost (UC) of it."), (2, "See the Unit Cost (UC) of it."), (3, "the big old house (HS) and the big old house (house) or (12) or ( HS )"), (4, None), (5, ""), (None, "the Unit Cost (UC) of"), (6, "(UC)"), (6, "(UC)"), (7, "the Unit Cost (UC) " * 3_000)]
    rows = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, lo int")
    terms = H.phrases_in(rows, "term")
    found = R.abbreviations(R.mentions(rows), terms)
    got = {(r.doc_id, r.i_text, r.j_text) for r in found.where("name = 'to-abbreviation' AND doc_id < 7").collect()}
    assert got == {(1, "Unit Cost", "UC"), (2, "Unit Cost", "UC"), (3, "big old house", "HS")}
    assert found.where("doc_id = 7").count() == 6_000 and found.where("doc_id is null").count() == 0
    edges = {(r.name, r.i, r.j): r["count"] for r in R.relation_edges(found.where("doc_id < 7"), terms).collect()}
    assert edges == {("to-abbreviation", "Unit Cost", "UC"): 1, ("to-abbreviation", "big old house", "HS"): 1, ("from-abbreviation", "UC", "Unit Cost"): 1, ("from-abbreviation", "HS", "big old house"): 1}
    assert {(r.name, r.flavour) for r in R.flavours(found).collect()} == {("from-abbreviation", 256), ("to-abbreviation", 257)}
    assert R.relation_edges(found.where("false"), terms).count() == R.mentions(rows.where("false")).count() == R.flavours(found.where("false")).count() == 0


def test_enumerations_by_plain_patterns():
    """The patterns that skip lists find what plain ones find, in time in proportion to the text."""
    import random
    import re

    plain = {"enum-term-mark-1": "(?:J+,)*J+,?C,?J+[NS]"} | {f"enum-term-mark-{k}": f"(?:{x}+,)*{x}+,?C,?{x}+" for k, x in enumerate("NSP", 2)}
    rng = random.Random(7)
    for _ in range(3_000):
        t = "".join(rng.choices("JNSPC,EO", (6, 6, 3, 3, 5, 5, 1, 1), k=rng.randint(0, 60)))
        for kind, own in H.ENUMERATIONS.items():
            assert [m.span("x") for m in own.finditer(t) if m.group("x")] == [m.span() for m in re.finditer(plain[kind], t)], (kind, t)
    start = time.time()
    for t in ("J" * 300_000, "J," * 150_000, "JC" * 150_000, "N,NC," * 60_000):
        assert all(sum(1 for _ in p.finditer(t)) < 200_000 for p in H.ENUMERATIONS.values())
    assert time.time() - start < 20


def test_enumerations_rows(spark):
    texts = [(1, "The thermal, active or famous house. See Ada, Hans and Eva"), (2, None), (3, ""), (None, "house and garden"), (4, "house and garden"), (4, "house and garden"), (5, "house, garden"), (6, "house, " * 20_000 + "and garden")]
    rows = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, name string")
    found = H.enumerations(rows)
    got = sorted((str(r.doc_id), r.name, r.sent, r.lo, r.hi, r.text) for r in found.where("doc_id is null or doc_id < 6").collect())
    assert got == [("1", "enum-term-mark-1", 0, 2, 7, "thermal , active or famous house"), ("1", "enum-term-mark-4", 1, 9, 14, "See Ada , Hans and Eva"), *[("4", "enum-term-mark-2", 0, 1, 3, "house and garden")] * 2, ("None", "enum-term-mark-2", 0, 1, 3, "house and garden")]
    assert [(r.lo, r.hi) for r in found.where("doc_id = 6").collect()] == [(1, 40_002)]
    assert H.enumerations(rows.where("false")).count() == 0
