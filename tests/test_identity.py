import numpy as np
from pyspark.sql import functions as F

from lexigraph.functions import hashing
from lexigraph.operators import build as B
from lexigraph.operators import identity as I
from lexigraph.plans.flow import Flow, Graph


def plain_hash(numbers):
    """The hash of a path by its definition, in whole numbers."""
    mask = (1 << 64) - 1
    h = len(numbers)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = ((h ^ (h >> 33)) * factor) & mask
    h ^= h >> 33
    for v in numbers:
        h ^= (v + 0x9E3779B9 + (h << 6) + (h >> 2)) & mask
    return h


def test_path_hashes_by_definition():
    big, small = (1 << 64) - 5, 7
    signed = lambda x: int(np.array(x, np.uint64).view(np.int64))
    path = [signed(big), small, signed(big - 1)]
    got = lambda name, p=path: int(I.path_hashes([p], name)[0])
    assert got("sentence") == plain_hash([big, small, big - 1, 16])
    assert got("term") == plain_hash([small, big, big - 1, 10]) == got("term", [small, signed(big), signed(big - 1)])  # unsigned order, the head stays
    assert got("cont") == plain_hash([small, big - 1, big, 8])
    assert got("verb") == plain_hash([big, small, big - 1, 11])
    assert int(hashing.hash_texts(["__word_token_a__"])[0]) == plain_hash([ord(c) for c in "__word_token_a__"])


def test_homonyms_stay_apart(spark):
    d = spark.createDataFrame([(1, "big old dog. dog is old"), (2, "old big dog"), (3, None), (None, "dog"), (2, "old big dog"), (4, "")], "doc_id long, text string")
    tokens, terms = I.token_nodes(d), I.term_nodes(d)
    nodes = I.resolved(tokens.unionByName(terms))
    got = sorted((r.text, r.word_cnt, r.text_cnt) for r in nodes.where("name = 'term'").collect())
    # modifiers are in no order; a word with white space before it is another token than one without
    assert got == [("big old dog", 1, 1), ("dog", 1, 1), ("dog", 1, 1), ("old", 1, 1), ("old big dog", 2, 2)]
    dog = nodes.where("text = 'dog'").collect()
    assert {r.name for r in dog} == {"word_token", "term"} and len({r.hash for r in dog}) == len(dog)
    flow_nodes = I.keyed(nodes)
    edges = B.with_prob(I.token_edges(terms))
    word = next(r.hash for r in dog if r.name == "word_token")
    term = next(r.hash for r in dog if r.name == "term")
    g = Graph(flow_nodes, {"to-token": edges})
    flow = Flow(g).select_hashes([(word, 1.0), (term, 1.0)]).filter_flavours(["term"])
    assert {r.id for r in flow.result().collect()} == {str(term)}
    assert {r.id for r in Flow(g).select_hashes([(term, 1.0)]).traverse("to-token").result().collect()} <= {str(h) for h in (r.hash for r in tokens.collect())}


def test_texts_are_resolved_level_by_level(spark):
    d = spark.createDataFrame([(1, "A cat sat. A dog? no"), (2, "A cat sat."), (3, None), (4, ""), (2, "A cat sat.")], "doc_id long, text string")
    tokens, made = I.token_nodes(d), I.sentence_nodes(d)
    nodes = I.resolved(tokens.unionByName(made))
    got = {(r.name, r.text, r.word_cnt, r.text_cnt) for r in nodes.where("path is not null").collect()}
    assert got == {("sentence", "A cat sat.", 3, 3), ("sentence", "A dog?", 1, 1), ("sentence", "no", 1, 1), ("text", "A cat sat. A dog? no", 1, 1), ("text", "A cat sat.", 2, 2)}
    paths = {r.hash: r.tokens for r in I.token_paths(tokens.unionByName(made)).collect()}
    words = {r.hash: r.text for r in tokens.collect()}
    sizes = {r.text: len(paths[r.hash]) for r in nodes.where("name = 'text'").collect()}
    assert sizes == {"A cat sat. A dog? no": 8, "A cat sat.": 4} and all(h in words for p in paths.values() for h in p)
    lost = tokens.where("text != 'A'").unionByName(made)
    assert any(I.UNKNOWN in r.text for r in I.resolved(lost).where("name = 'sentence'").collect())
    loop = made.limit(1).withColumn("path", F.array("hash"))
    assert I.resolved(tokens.unionByName(loop)).where("path is not null").first().text is None
    assert I.sentence_nodes(d.where("false")).count() == I.term_nodes(d.where("false")).count() == 0


def test_identity_queries_equal_brute_force(spark):
    """Over whole documents; words with one hash are one node there too."""
    import re
    from collections import Counter, defaultdict

    from lexigraph import queries
    from lexigraph.functions import text as T

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select(T.words().alias("w"), F.transform(T.words(), T.unmarked).alias("p")).selectExpr("w", "p", f"transform(transform(p, x -> {T.part_of_speech_sql('x')}), tag -> {T.LETTER}) AS t").where("size(w) > 0").collect()
    words = sorted({x for r in rows for x in r.w})
    of = dict(zip(words, hashing.hash_texts([f"__word_token_{x}__" for x in words]).view(np.int64).tolist(), strict=True))
    first = {}
    for x in words:
        first.setdefault(of[x], x)

    def nodes(name, found):
        """found: (text's number, path, what it reads)."""
        n, texts, best = Counter(), defaultdict(set), {}
        for (doc, path, shown), h in zip(found, I.path_hashes([p for _, p, _ in found], name).tolist(), strict=True):
            n[h] += 1
            texts[h].add(doc)
            best[h] = min(best.get(h, (shown, path)), (shown, path))
        return {h: (n[h], len(texts[h]), best[h][1]) for h in n}

    read = lambda path: "".join(first[h] for h in path)
    plain = lambda raw: raw.replace("▁", " ").strip(" ")
    terms = nodes("term", [(k, [of[x] for x in r.w[m.start() : m.end()]], "".join(r.w[m.start() : m.end()])) for k, r in enumerate(rows) for m in re.finditer("[JN]*N", "".join(r.t))])
    got = Counter(map(tuple, queries.QUERIES["identity_terms"](spark, sf).select("text", "word_cnt", "text_cnt").collect()))
    assert got == Counter((plain(read(p)), a, b) for a, b, p in terms.values())
    found, whole = [], []
    for k, r in enumerate(rows):
        start, own = 0, []
        for at, x in enumerate(r.p):
            if x in I.ENDS or at == len(r.p) - 1:
                own.append((k, [of[y] for y in r.w[start : at + 1]], "".join(r.w[start : at + 1])))
                start = at + 1
        found += own
        whole.append((k, [int(h) for h in I.path_hashes([p for _, p, _ in own], "sentence").view(np.int64)], ""))
    sentences, texts = nodes("sentence", found), nodes("text", whole)
    signed = {int(np.array(h, np.uint64).view(np.int64)): p for h, (_, _, p) in sentences.items()}
    want = Counter(("sentence", plain(read(p)), a, b) for a, b, p in sentences.values()) + Counter(("text", plain("".join(read(signed[h]) for h in p)), a, b) for a, b, p in texts.values())
    assert Counter(map(tuple, queries.QUERIES["identity_texts"](spark, sf).select("name", "text", "word_cnt", "text_cnt").collect())) == want


def test_texts_inside_rows_equal_those_level_by_level(spark, monkeypatch):
    """Words of one hash read as the first of them, modifiers are in no order, and a node's text is that of its first path."""
    made = ["A eauê house. A eash house. No", "A eash house. A eauê house", "big old eash house", "old big eauê house", "old big eash house of", "▁ ▁▁a ▁b", "", None, "big old dog? old big dog", "Xeauê eauê"]
    d = spark.createDataFrame([(k, t) for k, t in enumerate([*made, *made[:4]])], "doc_id long, text string")
    assert {r.text for r in I.alike(d).collect()} == {"▁eash"}
    rows = lambda table, *c: sorted(tuple(r[x] for x in c) for r in table.collect())
    terms = rows(I.resolved(I.token_nodes(d).unionByName(I.term_nodes(d))).where("name = 'term'"), "text", "word_cnt", "text_cnt")
    texts = rows(I.resolved(I.token_nodes(d).unionByName(I.sentence_nodes(d))).where("path is not null"), "name", "text", "word_cnt", "text_cnt")
    for most in (100_000, 0):
        monkeypatch.setattr(I, "ALIKE", most)
        assert rows(I.shown_terms(d), "text", "word_cnt", "text_cnt") == terms and rows(I.shown_texts(d), "name", "text", "word_cnt", "text_cnt") == texts
    monkeypatch.undo()
    assert all("Join" not in f(d)._jdf.queryExecution().optimizedPlan().toString() for f in (I.shown_terms, I.shown_texts))
    assert I.shown_terms(d.where("false")).count() == 0 == I.shown_texts(d.where("text is null")).count()
