"""Spelling variants, packing and the Merkle manifest against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigraph.llm import merkle, packing, queries, spelling

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, lang string, n_chars int, word string, at int"


@pytest.fixture
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    long = "".join(random.Random(3).choice(["receive ", "recieve ", "straßen ", "  \n", "naïveté", "12"]) for _ in range(60_000))
    rows = [(k, f"Document number {k} about receiving recieving documents", f"s{k % 2}", "en", 5, "x", 1) for k in range(40)]
    rows += [(100, None, "s1", None, None, "x", 1), (101, "", None, "en", 0, "x", 1), (None, "No id here, NOBODY", "s1", "en", 1, "x", 1), (102, long, "s2", "de", 9, None, None)]
    rows += [(103, "same same", "s1", "en", 2, "x", 1)] * 3 + [(103, "Other", "s1", "en", 2, "x", 1), (104, "é x <|endoftext|> a\n b  c \t d", None, "fr", 2, "x", 1)]
    return spark.createDataFrame(rows, DOCS)


def vocabulary_of(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def one_error(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants_of(words):
    by = {}
    for w in words:
        for key in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            by.setdefault(key, []).append(w)
    near = {w: set() for w in words}
    for group in by.values():
        for a in group:
            near[a].update(b for b in group if one_error(a, b))
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


def got_variants(rows):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows.collect()}


def test_spelling_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = got_variants(queries.op11_spelling(spark, SF))
    assert got == variants_of(vocabulary_of(rows)) and len(got) > 1000 and any(f for _, f, *_ in got)


def test_spelling_in_small_shards_and_blocks(spark):
    """A hot half, runs of one letter, chains of forms, ties; shards and blocks change nothing."""
    r = random.Random(5)
    words = {"common" + "".join(r.choice("abé") for _ in range(4)): r.randint(2, 3000) for _ in range(400)}
    words |= {"".join(r.choice("ab") for _ in range(r.randint(7, 9))): r.randint(2, 3000) for _ in range(400)}
    words |= {"aaaaaaa": 5, "aaaaaaaa": 60, "aaaaaaaaa": 700, "×aaaaaaa": 60, "zzzzzzzz": 2}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    want = variants_of(words)
    assert got_variants(spelling.variants(table)) == want
    assert got_variants(spelling.variants(table, shard=37, block=11)) == want
    pairs = [(p.word, p.near) for p in spelling.near_words(table, shard=50).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(b, a) for a, b in pairs}


def test_spelling_of_very_long_words(spark):
    """One letter over and over, and a word of junk, each with a near one."""
    junk = "".join(random.Random(9).choice("abcdefgh") for _ in range(20_000))
    words = {"a" * 30_000: 3, "a" * 30_001: 40, junk: 2, junk[:7] + "x" + junk[7:]: 30, junk[:-1]: 2}
    got = {(r.word[:20], len(r.word), None if r.form is None else len(r.form), r.n_near) for r in spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert got == {("a" * 20, 30_000, 30_001, 1), ("a" * 20, 30_001, None, 1), (junk[:20], 20_000, 20_001, 2), ((junk[:7] + "x" + junk[7:])[:20], 20_001, None, 1), (junk[:20], 19_999, None, 1)}


def test_spelling_edge_cases(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got_variants(spelling.variants(spelling.vocabulary(odd))) == variants_of(vocabulary_of(rows))
    assert spelling.variants(spelling.vocabulary(odd.where("false"))).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))


def check_packed(pieces, ids, length):
    """Pieces cover each document's ids once, fill windows without gaps, and say what they hold."""
    total = sum(len(i) for i in ids)
    line = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
    at = 0
    for p in line:
        assert (p.sequence_id, p.offset) == divmod(at, length) and 0 < p.length <= length - p.offset
        full = min(length, total - p.sequence_id * length)
        assert p.sequence_tokens == full and p.padded_length == (full if full & (full - 1) == 0 else length)
        at += p.length
    assert at == total
    # documents follow each other in the line, each from its first id to its last
    docs, now = [], []
    for p in line:
        assert p.start == sum(x.length for x in now)
        now.append(p)
        if p.start + p.length == p.doc_tokens:
            docs.append(now)
            now = []
    assert not now
    rest = {}
    for doc, i in ids_by_doc:
        rest.setdefault(doc, []).append(i)
    for ps in docs:
        for k, i in enumerate(rest[ps[0].doc_id]):
            if len(i) == ps[0].doc_tokens and all(zlib.crc32(np.array(i[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for p in ps):
                rest[ps[0].doc_id].pop(k)
                break
        else:
            raise AssertionError(ps[0].doc_id)
    assert not any(rest.values()) and len(docs) == len(ids)


ids_by_doc: list = []


def held(rows, tokenizer):
    ids_by_doc[:] = [(doc, [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]) for doc, text in rows]
    return [i for _, i in ids_by_doc]


def test_packing_on_documents(spark, tokenizer):
    for sf in (SF, "/root/testdata/sf0.01"):
        rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
        check_packed(queries.op12_packing(spark, sf).collect(), held(rows, tokenizer), 2048)


def test_packing_edge_cases(spark, odd, tokenizer):
    ids = held([(r.doc_id, r.text) for r in odd.collect()], tokenizer)
    path = queries.tokenizer_path("byte_bpe_50k.json")
    for parts, length in ((1, 2048), (7, 64)):
        check_packed(packing.pack(odd.repartition(parts), path, length, ranks=queries.byte_ranks() if parts == 7 else None).collect(), ids, length)
    assert packing.pack(odd.where("false"), path).count() == 0
    # a last window whose length is a power of two isn't padded
    few = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "doc_id long, text string")
    assert {(p.sequence_tokens, p.padded_length) for p in packing.pack(few, path).collect()} == {(4, 4)}


def test_packed_sequences_hold_the_ids(spark, odd, tokenizer):
    ids = held([(r.doc_id, r.text) for r in odd.collect()], tokenizer)
    pieces = packing.pack(odd.repartition(3), queries.tokenizer_path("byte_bpe_50k.json"), 256, with_ids=True)
    made = packing.sequences(pieces).orderBy("sequence_id").collect()
    line = [i for s in made for i in s.ids[: s.n_tokens]]
    assert Counter(line) == Counter(x for i in ids for x in i) and all(len(s.ids) == 256 for s in made[:-1])
    text = [line[a:b] for a, b in zip([0, *(k + 1 for k, x in enumerate(line) if x == 1)], [k + 1 for k, x in enumerate(line) if x == 1], strict=False)]
    assert sum(len(t) for t in text) == len(line) and made[0].boundaries[0].offset == 0
    assert all([b.offset for b in s.boundaries] == sorted({b.offset for b in s.boundaries}) for s in made)


def test_ranks_give_the_same_ids(tokenizer):
    """Random texts, and every plain character next to letters, digits, blanks, marks and itself."""
    r = random.Random(1)
    encoder = packing.Encoder(queries.tokenizer_path("byte_bpe_50k.json"), queries.byte_ranks())
    parts = [" ", " ", "  ", "\n", "\t", "\u00a0", "\u2003", "\x1c", "a", "B's", "'ll", "12", "é", "漢", "!?", "<|endoftext|>", "_", "\u0301"]
    texts = [None, "", *("".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(3000))]
    texts += [f"a{c}b {c}1{c}{c} {c}{c}x  {c} \n{c}'s!{c}?" for c in map(chr, range(0x2100)) if packing.PLAIN.fullmatch(c)]
    for text, got in zip(texts, encoder.ids(texts, 1), strict=True):
        assert np.frombuffer(got, "<u2").tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], repr(text)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def tree_of(nodes):
    """Levels of a tree, from the leaves up."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def way(tree, k):
    """(left, right) siblings of node k, level by level."""
    for level in tree[:-1]:
        at = k // 16 * 16
        yield level[at:k], level[k + 1 : at + 16]
        k //= 16


def manifest_of(rows):
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda x: x[:3])
    trees = {s: tree_of([x[2] for x in by[s]]) for s in order}
    over = tree_of([trees[s][-1][0] for s in order])
    out = []
    for p, s in enumerate(order):
        for k, (_, _, leaf, r) in enumerate(by[s]):
            steps = [*way(trees[s], k), *way(over, p)]
            low = None if r.text is None else re.sub("[A-Z]", lambda m: m[0].lower(), r.text)
            value = leaf_of(r, low) if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 else leaf
            for left, right in steps:
                value = H(*left, value, *right)
            out.append((str(r.doc_id), leaf, trees[s][-1][0], over[-1][0], H(*(x for left, right in steps for x in left + right)), value, value == over[-1][0]))
    return sorted(out)


def got_manifest(rows):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in rows.collect())


def test_manifest_on_documents(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        got = got_manifest(queries.op13_manifest(spark, sf))
        assert got == manifest_of(spark.read.parquet(f"{sf}/documents.parquet").collect())
        assert 0 < sum(not x[-1] for x in got) < len(got) / 3


def test_manifest_of_deep_trees_and_one_row(spark):
    rows = spark.range(1200).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text "), "id").alias("text"), F.when(F.col("id") < 700, "hot").when(F.col("id") == 700, None).otherwise(F.concat(F.lit("é"), (F.col("id") % 40).cast("string"))).alias("source"), F.lit("en").alias("lang"), F.lit(3).alias("n_chars"))
    assert got_manifest(merkle.manifest(merkle.tampered(rows))) == manifest_of(rows.collect())
    one = rows.where("doc_id = 700")
    got = got_manifest(merkle.manifest(merkle.tampered(one)))
    assert got == manifest_of(one.collect()) and got[0][1] == got[0][2] == got[0][3]


def test_manifest_edge_cases(spark, odd):
    got = got_manifest(merkle.manifest(merkle.tampered(odd.repartition(5))))
    assert got == manifest_of(odd.collect())
    assert merkle.manifest(merkle.tampered(odd.where("false"))).count() == 0


def test_states_resume(spark):
    children = [H(str(k)) for k in range(16)]
    parent = merkle.Parent(children)
    assert parent.digest == H(*children) and len(parent.states) == 16
    for k in range(16):
        assert parent.step(k).fold("x" * 64) == H(*children[:k], "x" * 64, *children[k + 1 :])
        assert merkle.Step(parent.nodes, k).fold(children[k]) == parent.digest
