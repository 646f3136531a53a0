"""The operators against brute force on small tables with odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lexigraph.llm import chat, itq, lm, mixing, neardup, passages, pieces, pii, quality, repeats, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long, position int, row int"


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 7)))
    base = " ".join(word() for _ in range(200))
    near = base.split()
    near[100] = "changed"
    texts = [None, "", " \n ", "one two", base, base, " ".join(near), "x" * 5000, base[:700] + " tail " + " ".join(word() for _ in range(60)), "mail a.b@c.de or 10.0.0.1 +1 (555) 123-4567"]
    texts += [" ".join(word() for _ in range(120)) for _ in range(12)]
    rows = [(i, t, None, [None, "b", "a"][i % 3], None, i, i) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[9], (None, "null id", None, None, None, 0, 0)], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_quality_and_empty(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(3, None)], "doc_id long, quality int")
    net = quality.train(docs, labels, sample=50)
    rows = quality.score_quality(docs, net).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert quality.score_quality(empty(spark), net).count() == 0
    one = net.logits([b"abc", b"defg" * 300])
    assert np.allclose(one, [net.logits([b"abc"])[0], net.logits([b"defg" * 300])[0]], atol=1e-5)


def test_quality_on_held_out_rows(spark):
    """Labels that the text alone tells are learned: held-out accuracy, on 1 of 5 rows that no training has seen."""
    rng = np.random.default_rng(3)
    good = lambda: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(60)).capitalize() + "."
    bad = lambda: " ".join("".join(rng.choice(list("!#$%&XYZ"), rng.integers(2, 7))) for _ in range(60))
    rows = [(i, good() if i % 2 else bad(), None, None, None, 0, 0) for i in range(400)]
    table = spark.createDataFrame(rows, DOCS)
    net = quality.train(table, spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int"))
    found = quality.score_quality(table, net).collect()
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == r.doc_id % 2 for r in held) >= 0.95 * len(held)
    assert {r.doc_id for r in quality.keep_good(table, net).collect()} == {r.doc_id for r in found if r.predicted}


def brute_passes(kind, text):
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        total = 0
        for i, d in enumerate(reversed(digits)):
            total += d if i % 2 == 0 else sum(map(int, str(2 * d)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute_spans(text):
    found = []
    for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        found += [(m.start(), k, m.end()) for m in re.finditer(p, text) if brute_passes(pii.KINDS[k], m.group())]
    return [(s, e, pii.KINDS[k]) for s, k, e in sorted(found)]


def test_base_spans_match_brute_force(spark, docs):
    rng = np.random.default_rng(1)
    parts = ["a", "@", ".", "-", "_", "1", "23", "256", "+", "(", ")", " ", "4111111111111111", "é", "😀"]
    for _ in range(5000):
        text = "".join(rng.choice(parts, rng.integers(0, 20)))
        assert pii.base_spans(text) == brute_spans(text)
    rows = pii.find_personal_data(docs, pii.train(docs)).collect()
    assert len(rows) == docs.count() and sum(r.n_email for r in rows) == 2
    assert pii.find_personal_data(empty(spark), pii.train(empty(spark))).count() == 0
    for r in rows:
        own = [(int(s), int(e), k) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)]
        text = next(d.text for d in docs.collect() if d.doc_id == r.doc_id) or ""
        base = brute_spans(text)
        assert set(base) <= set(own) and r.n_spans == len(own) == len(base) + r.n_added
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()


def private(rng):
    """A span of each kind, plain and in a form that the patterns miss."""
    n = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    ip = lambda: ".".join(map(str, rng.integers(10, 250, 4)))
    mail, phone, token = f"{word()}@{word()}.example.com", f"+1 ({n(3)}) {n(3)}-{n(4)}", "".join(rng.choice(list("0123456789abcdef"), 40))
    hidden = [(mail.replace("@", "[at]"), ""), (ip().replace(".", "[.]"), ""), (phone, " " + ip()), (token, "")]
    return [mail, ip(), phone], hidden


def test_network_finds_what_patterns_miss(spark):
    """Recall and precision on texts of which the patterns see nothing, or not where a phone number ends."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("klmnopqrstu"), rng.integers(2, 8)))
    rows, unseen = [], []
    for i in range(600):
        plain, hidden = private(rng)
        some = [plain[i % 3]] if i % 4 else [f'token = "{hidden[3][0]}"']
        rows.append((i, " ".join([word() for _ in range(20)] + some + [word() for _ in range(20)]) + f" {i}", None, None, None, 0, 0))
    net = pii.train(spark.createDataFrame(rows, DOCS))
    found = right = wanted = 0
    for i in range(200):
        span, behind = private(rng)[1][i % 4]
        before = " ".join(word() for _ in range(20)) + (' token = "' if i % 4 == 3 else " ")
        text = before + span + behind + ('" ' if i % 4 == 3 else " ") + " ".join(word() for _ in range(20))
        unseen.append(text)
        (base, every), = pii.search([text], net)
        own = {(s, e) for s, e, _ in every} - {(s, e) for s, e, _ in base}
        wanted, found, right = wanted + 1, found + len(own), right + ((len(before), len(before) + len(span)) in own)
    assert right >= 0.7 * wanted and right >= 0.9 * found, (wanted, found, right)
    clean = [" ".join(word() for _ in range(50)) + f" {i} {2 * i}" for i in range(200)]
    assert sum(len(a) for _, a in pii.search(clean, net)) <= 2


def test_parts_cut_off_by_windows_are_joined():
    text = "x" * 30 + "0" * 15 + "a1b2" * 25 + " tail"
    s, e = 30, 145
    decoded = [((lo, min(len(text), lo + 96)), [(max(s, lo) - lo, min(e, lo + 96) - lo, "secret", 0.9)]) for lo in range(0, 144, 48)]
    assert pii.reconcile(text, [], decoded, 0.5) == [(s, e, "secret")]
    assert pii.reconcile(text, [(40, 50, "card")], decoded, 0.5) == [(40, 50, "card")]


def targets_by_brute_force(sizes):
    """Weights 5, 2, 1 repeating over sources by code point, null last; excess over 3 times a size is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    while free:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
        free -= set(over)
    return target


def test_mixing(spark, docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(r.taken <= 3 * r["size"] for r in rows)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, per = {}, {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
    want = targets_by_brute_force(sizes)
    for r in rows:
        assert abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source]) and r.source_size == sizes[r.source]
        per[r.source] = per.get(r.source, 0) + r.taken
    assert all(abs(want[s] - n) <= 1 for s, n in per.items())
    assert sorted(r["size"] for r in rows) == sorted(words(r.text) for r in docs.collect())
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed_documents(empty(spark)).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    first = [(r.doc_id, r.text) for r in mixed.collect()]
    assert sum(words(t) for _, t in first) == sum(r.taken for r in rows)
    assert first == [(r.doc_id, r.text) for r in mixing.mixed_documents(docs.repartition(5)).collect()]


def test_mixing_keeps_rows_of_two_sources_apart(spark):
    rows = [(i, f"word{i} " * (i + 1), None, s, None, i, k) for k, s in enumerate(("a", "b")) for i in range(50)]
    table = spark.createDataFrame(rows, DOCS)
    plan, got = {}, {}
    for r in mixing.mix(table).collect():
        plan[r.source] = plan.get(r.source, 0) + r.taken
    for r in mixing.mixed_documents(table).collect():
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
    assert got == plan and all(plan.values())


def test_mixing_targets_stop_at_three_times_a_source(spark):
    rows = [(i, "w " * n, None, s, None, 0, 0) for i, (s, n) in enumerate([("a", 3), ("b", 200), ("c", 40), ("d", 1), ("e", 500), (None, 10), ("f", 0)])]
    table = spark.createDataFrame(rows, DOCS)
    want = targets_by_brute_force({r[3]: len(r[1].split()) for r in rows})
    got = {r.source: (r.target, r.taken) for r in mixing.mix(table).collect()}
    assert all(abs(got[s][0] - t) < 1e-6 and abs(got[s][1] - t) <= 1 for s, t in want.items())


def test_language_model(spark, docs):
    rows = lm.score_documents(docs, chunk=50, shard_tokens=100).collect()
    assert len(rows) == docs.count() and all(r.score < 0 and r.n_tokens >= 1 for r in rows)
    whole = {(r.doc_id, r.n_tokens, r.n_known): (r.base_score, r.score) for r in lm.score_documents(docs).collect()}
    assert all(np.allclose(whole[r.doc_id, r.n_tokens, r.n_known], (r.base_score, r.score), rtol=1e-9) for r in rows)
    assert lm.score_documents(empty(spark)).count() == 0
    none = spark.createDataFrame([(2, "a b"), (9, None)], "doc_id long, text string").where("crc32(cast(cast(doc_id as string) as binary)) % 7 = 2")
    assert all(r.n_known == 0 and math.isfinite(r.score) for r in lm.score_documents(none).collect())


def test_packed_numbers():
    for x in ([], [0], [5, 255, 256, 1 << 40], [(1 << 64) - 1]):
        assert lm.unpack(lm.pack(np.array(x, np.uint64))).tolist() == x


def test_language_model_by_brute_force(spark):
    """All counts and scores, in a vocabulary where pairs of rare words tell."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"c{k}" for k in rng.integers(0, 1500, 60)) + (" Zebra quokka" if i % 20 == 0 else "") for i in range(1000)]
    texts[700:702] = ["zebra quokka", "quokka zebra never"]
    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 == 2]
    texts[held[0]], texts[held[1]] = "c1 zebra quokka c2", "c1 quokka zebra c2"
    tokens = [[*t.lower().split(), None] for t in texts]
    train = [t for i, t in enumerate(tokens) if i not in held]
    fit = [t for i, t in enumerate(tokens) if i not in held and zlib.crc32(str(i).encode()) % 3]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)

    def counts(docs):
        return Counter(w for t in docs for w in t), Counter(p for t in docs for p in zip([None, *t[:-1]], t, strict=True))

    (words, pairs), (fit_words, fit_pairs) = counts(train), counts(fit)
    total, n_fit, even = sum(words.values()), sum(fit_words.values()), 1 / (len(words) + 1)
    bucket = lambda c: math.ceil(math.log2(c + 1))
    step = lambda p: math.floor(4 * math.log2(p)) if p else -1000
    events = {}
    for (h, w), n in pairs.items():
        if more := n - fit_pairs[h, w]:
            two, one = fit_pairs[h, w] / max(fit_words[h], 1), fit_words[w] / n_fit
            e = events.setdefault((bucket(fit_words[h]), step(two), step(one)), np.zeros(3))
            e += np.array([two, one, 1]) * more
    rows = [(b, e[0] / e[2], e[1] / e[2], e[2]) for (b, *_), e in sorted(events.items())]
    weights = lm.interpolate(np.array([[r[1], r[2], even] for r in rows]), np.array([r[3] for r in rows]), np.array([r[0] for r in rows]))
    weights[0] = [0, *(weights[0, 1:] / weights[0, 1:].sum())]

    got = {r.doc_id: r for r in lm.score_documents(table, chunk=5000, shard_tokens=9000).collect()}
    assert len(got) == 1000
    for i, own in enumerate(tokens):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in held, len(own), sum(w in words for w in own), total)
        assert abs(r.base_score - sum(math.log10((words[w] + 1) / (total + len(words) + 1)) for w in own)) < 1e-6
        want = sum(math.log10(weights[bucket(words[h])] @ [pairs[h, w] / max(words[h], 1), words[w] / total, even]) for h, w in zip([None, *own[:-1]], own, strict=True))
        assert abs(r.score - want) < 1e-6 * abs(want)
    assert got[held[0]].score > got[held[1]].score + 1


@pytest.mark.parametrize("shard", [1500, 2])
def test_repeats_match_brute_force(spark, docs, shard):
    data = [(r.text or "").encode() for r in docs.collect()]
    seen = {}
    for x in data:
        for p in range(len(x) - 399):
            seen[x[p : p + 400]] = seen.get(x[p : p + 400], 0) + 1
    want = []
    for x in data:
        gone = np.zeros(len(x), bool)
        for p in range(len(x) - 399):
            if seen[x[p : p + 400]] > 1:
                gone[p : p + 400] = True
        want.append((len(x), int(gone.sum()), hashlib.sha256(bytes(np.frombuffer(x, np.uint8)[~gone])).hexdigest()))
    got = [(r.n_bytes, r.n_removed, r.kept_sha256) for r in repeats.remove_repeats(docs, shard_contexts=shard).collect()]
    assert sorted(got) == sorted(want)


def test_shared_passages(spark):
    """Passages of over 50 words and under 400 bytes, which no 400-byte string shows, by brute force over all runs of 51 words."""
    rng = np.random.default_rng(23)
    some = lambda n: [f"w{k}" for k in rng.integers(0, 10**6, n)]
    short = ["ab", "cd", "e"] * 9 + [f"x{k}" for k in range(28)]
    assert len(short) == 55 and len(" ".join(short)) < 400
    base, twice = some(300), some(60)
    texts = [None, "", "one", " ".join(base), " ".join(base), " ".join([*base[:140], "changed", *base[141:]]), " ".join(twice + some(9) + twice), " ".join(base[100:150]), " ".join(some(60) + base[30:81])]
    texts += [" ".join(some(40) + short[k:] + some(40)) for k in (0, 0, 3, 4, 5)] + ["\n".join(some(20) + short) + "\t ", " ".join(some(5) + short + some(60) + base[:70]), "y " * 200, "y " * 90]
    rows = [*enumerate(texts), (9, texts[9]), (None, texts[10]), (100, "z" * 400000 + " " + " ".join(short))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    split = [(t or "").encode().split() for _, t in rows]
    owners = {}
    for r, w in zip(rows, split, strict=True):
        for p in range(len(w) - 50):
            owners.setdefault(tuple(w[p : p + 51]), set()).add(r)
    want = []
    for (d, _), w in zip(rows, split, strict=True):
        hit = np.zeros(len(w), bool)
        for p in range(len(w) - 50):
            if len(owners[tuple(w[p : p + 51])]) > 1:
                hit[p : p + 51] = True
        want.append((str(d), int(np.diff(hit.astype(int), prepend=0).clip(0).sum()), int(hit.sum())))
    found = repeats.remove_repeats(table, beside=passages.shared_passages(table)).collect()
    assert sorted((str(r.doc_id), r.n_passages, r.passage_words) for r in found) == sorted(want)
    got = {r.doc_id: (r.n_removed, r.passage_words) for r in found}
    assert got[11] == (0, 52) and got[14] == (0, 55) and got[6][0] > 0 == got[6][1] and got[7] == (0, 0) and got[12] == (0, 51) and got[13] == (0, 0)
    plain = repeats.remove_repeats(table)
    assert sorted(map(str, plain.collect())) == sorted(map(str, spark.createDataFrame(found).select(plain.columns).collect()))


def test_near_documents(spark, docs):
    rows = {r.doc_id: r for r in neardup.near_documents(docs).collect()}
    assert rows[5].component_id == rows[6].component_id == 4 and rows[4].kept and not rows[6].kept
    assert rows[0].n_shingles == rows[1].n_shingles == 0 and rows[3].n_shingles == 1 and rows[0].kept
    small = {r.doc_id: r.component_id for r in neardup.near_documents(docs, leaf=2).collect()}
    assert small[6] == 4
    assert neardup.near_documents(empty(spark)).count() == 0


def test_near_documents_in_large_nodes(spark):
    """A star (copies near their base alone) and a chain, each in nodes far above a leaf."""
    rng = np.random.default_rng(7)
    words = np.array([f"w{i}" for i in range(2200)])
    base = words[:400]
    texts = [" ".join(base)]
    for i in range(150):
        copy = base.copy()
        copy[np.arange(8) * 50 + rng.integers(5, 45, 8)] = [f"e{i}-{k}" for k in range(8)]
        texts.append(" ".join(copy))
    texts += [" ".join(words[400 + 35 * i : 800 + 35 * i]) for i in range(40)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    near = np.array([[100 * len(a & b) >= 80 * len(a | b) for b in sets] for a in sets])
    assert near[1:151, 1:151].sum() == 150 and near[0, :151].all() and not near[151:, 151:].all()
    want = np.arange(len(texts))
    for _ in texts:
        want = np.where(near, want[None, :], len(texts)).min(1)
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_documents(table, leaf=2, leaders=1, block=16).collect()}
    assert got == dict(enumerate(want.tolist())) and set(got.values()) == {0, 151}


def test_near_documents_of_one_large_group(spark, monkeypatch):
    """Near copies share nearly all nodes; what is joined and compared grows with them, not with the nodes they share."""
    rng = np.random.default_rng(17)
    texts = []
    for i in range(300):
        words = [f"w{k}" for k in range(200)]
        words[rng.integers(0, 200)] = f"e{i}"
        texts.append((i, " ".join(words)))
    joined, compared = [], []
    table = spark.createDataFrame(texts, "doc_id long, text string")
    join, links_of = type(table).join, neardup.links_of

    def counted(self, other, on=None, how=None):
        if isinstance(on, str) and (on, how) == ("rep", "left"):
            joined.append(self.count())
        return join(self, other, on, how)

    def recorded(documents, sets, groups_to_compare, *more):
        compared.append(groups_to_compare.selectExpr("sum(size(members))").first()[0] or 0)
        return links_of(documents, sets, groups_to_compare, *more)

    monkeypatch.setattr(type(table), "join", counted)
    monkeypatch.setattr(neardup, "links_of", recorded)
    assert neardup.near_documents(table, leaf=16).where("component_id = 0").count() == 300
    assert joined and max(joined) <= 300 and sum(compared) <= 8 * 300


def test_near_documents_send_texts_only_where_they_can_link(spark, monkeypatch):
    """Unlike documents that share some words meet in nodes, but their texts aren't compared; near ones are, where sizes and sketches allow it."""
    rng = np.random.default_rng(23)
    common = [f"c{k}" for k in range(30)]
    texts = [common + [f"u{i}x{k}" for k in range(170)] for i in range(240)]
    for i in range(0, 240, 12):  # near copies, and one that is too long to be near
        texts[i + 1] = [*texts[i][:199], f"e{i}"]
        texts[i + 2] = texts[i] + [f"l{i}x{k}" for k in range(80)]
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    compared, links_of = [], neardup.links_of

    def recorded(documents, sets, groups_to_compare, *more):
        compared.append(groups_to_compare.selectExpr("sum(size(members))").first()[0] or 0)
        return links_of(documents, sets, groups_to_compare, *more)

    monkeypatch.setattr(neardup, "links_of", recorded)
    got = {r.doc_id: r.component_id for r in neardup.near_documents(table, words=4).collect()}
    assert got == {i: i - 1 if i % 12 == 1 else i for i in range(240)}
    assert compared and sum(compared) <= 120
    assert neardup.agreeing(80) == 8 and neardup.agreeing(100) == neardup.COORDINATES
    # parts of a group by all its pairs
    sizes, marks = rng.integers(70, 130, 40), rng.integers(0, 3, (40, neardup.COORDINATES))
    near = [{j for j in range(40) if 100 * min(sizes[i], sizes[j]) >= 80 * max(sizes[i], sizes[j]) and (marks[i] == marks[j]).sum() >= 8} for i in range(40)]
    for part in (parts := neardup.likely_parts(sizes, marks, 80)):
        assert set().union(*(near[i] for i in part)) == set(part.tolist())
    assert sorted(np.concatenate(parts).tolist()) == [i for i in range(40) if near[i] - {i}]


def test_dedup_stage_keeps_texts_that_share_an_id(spark):
    rng = np.random.default_rng(4)
    a, b, c = (" ".join(f"{k}{x}" for x in rng.integers(0, 10_000, 100)) for k in "abc")
    rows = [(1, a), (1, b), (2, b + " x"), (2, b + " x"), (3, c), (4, ""), (4, None), (5, a.upper()), (None, a)]
    table = spark.createDataFrame([(i, t, None, None, None, 0, 0) for i, t in rows], DOCS)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, table, "").collect())
    assert got == Counter([(1, a), (1, b), (3, c), (4, ""), (4, None), (None, a)])


@pytest.mark.parametrize("cells", [dict(shard_rows=64, query_block=2, centre_block=3), {}])
def test_top_k(spark, cells):
    """Brute force over two lengths, ties, one vector many times, and rows that take no part."""
    rng = np.random.default_rng(2)
    vectors = [*rng.normal(size=(400, 8)), *np.round(rng.normal(size=(100, 8))), *[np.ones(8)] * 150, *rng.normal(size=(30, 5))]
    rows = [(i, [float(np.float32(x)) for x in v], i, 1) for i, v in enumerate(vectors)]
    odd = [(1000, None, 0, 0), (1100, [float("nan")] * 8, 0, 0), (1200, [1.0, None], 0, 0), (None, [1.0] * 8, 0, 0), (1300, [float("inf")] * 8, 0, 0), (1400, [1.0, 2.0], 0, 0)]
    again = [rows[7], rows[100], (100, rows[3][1], 0, 0), (200, rows[3][1], 0, 0), *[rows[499]] * 20]
    table = spark.createDataFrame([*rows, *odd, *again], "vec_id long, embedding array<float>, score int, shard int").repartition(3)
    x = [(r[0], np.floor(np.array(r[1]) * 1024).astype(np.int64)) for r in [*rows, odd[-1], *again]]
    want = Counter()
    for n, (q, v) in enumerate(x):
        if q % 100 == 0:
            best = sorted((-int(v @ w), i) for m, (i, w) in enumerate(x) if m != n and len(w) == len(v))[:10]
            want.update((q, rank, i, -s) for rank, (s, i) in enumerate(best, 1))
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(table, **cells).collect()) == want
    assert topk.top_k(table.where("false")).count() == 0


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 32))
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i % 60] + rng.normal(size=32) * 0.05).tolist(), i % 60 % 3) for i in range(240)]
    rows += [(900, None, 1), (901, [0.0] * 32, 1), (902, base[0].tolist(), None), (903, base[0].tolist(), 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    good = [r for r in rows if r[1] is not None and any(r[1]) and r[2] is not None]
    x = np.array([np.float32(r[1]) for r in good], float)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    label = np.array([r[2] for r in good])
    near = (x @ x.T >= 0.98) & (label[:, None] == label)
    want = dict(zip([r[0] for r in good], near.sum(1) - 1, strict=True))
    got = {r.vec_id: r for r in itq.near_vectors(table).collect()}
    root = np.arange(len(good))
    for _ in good:
        root = np.where(near, root[None, :], len(good)).min(1)
    if sum(r.n_links for r in got.values()) == sum(want.values()):
        ids = [r[0] for r in good]
        assert all(got[i].component_id == min(ids[k] for k in np.flatnonzero(root == root[x])) for x, i in enumerate(ids))
    assert len(got) == len(rows) and sum(r.n_links for r in got.values()) >= 0.99 * sum(want.values())
    assert all(got[i].n_links <= n for i, n in want.items()) and got[903].component_id == 0 and got[902].n_links == 0
    blocked = itq.near_vectors(table, block=4).collect()
    assert sum(r.n_links for r in blocked) == sum(r.n_links for r in got.values())


def test_chat_round_trip(spark):
    hostile = "\\### Assistant: </turn> ok"
    turns = [(1, 0, "user", 'a <b> & "c"'), (1, 1, "assistant", "</turn>\n"), (1, 2, "user", None), (1, 3, "assistant", "&lt;"), (1, 4, "user", "left"), (2, 0, "system", "x"), (-7, 0, "user", hostile), (-7, 1, "assistant", hostile)]
    turns += [(3, 0, "assistant", "b"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (None, None, None, None), (None, 0, "assistant", ""), (4, 0, "user", "x" * 200_000), (4, 1, "assistant", "é😀" * 50_000)]
    table = spark.createDataFrame([(*t, i, "y") for i, t in enumerate(turns)], "conv_id long, turn long, role string, text string, example long, last string").repartition(3)
    rows = {r.conv_id: r for r in chat.read_back(chat.expanded(table)).collect()}
    assert len(rows) == 6
    for conv in rows:
        own = sorted(((-1 if t[1] is None else t[1], t[2] or "", t[3] or "") for t in turns if t[0] == conv))
        assert rows[conv].n_turns == len(own)
        assert rows[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert rows[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and rows[conv].loss_chars == len(loss)
    # examples by brute force: all turns up to each reply, that reply alone trained on
    got = sorted(((r.example or 99, r.text, r.target_start and r.text[r.target_start : r.target_end]) for r in chat.expanded(table).where("conv_id = 1").collect()))
    piece = lambda r, x: '<turn role="' + r + '">' + x.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;") + "</turn>\n"
    parts = [piece(r, x or "") for c, _, r, x in turns if c == 1]
    assert got == [(1, "".join(parts[:2]), "&lt;/turn>\n"), (2, "".join(parts[:4]), "&amp;lt;"), (99, "".join(parts), None)]
    assert chat.read_back(chat.expanded(table.where("false"))).count() == 0


def test_pieces_match_library(spark, docs):
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece

    model = public.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = ["", "a  b ", "▁x", "<s>\n\t日😀", " ", "the the"]
    for (n, ids, text), t in zip(pieces.ChunkTable(sp, 2).texts(texts), texts, strict=True):
        assert ids == ",".join(map(str, sp.encode(t))) and text == sp.decode(sp.encode(t)) and n == len(sp.encode(t))
    assert pieces.encode_documents(docs, model).count() == docs.count()


def test_queries_with_sql(spark):
    import duckdb

    from lexigraph.llm import queries

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for name in ("embeddings", "conversations", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    for name, sql in queries.oracle_sql().items():
        rows = queries.queries()[name](spark, sf)
        cols = sorted(rows.columns)
        want = con.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()
        assert sorted(map(str, (tuple(r[c] for c in cols) for r in rows.collect()))) == sorted(map(str, want)), name


def test_repeats_of_one_row_many_times(spark):
    rng = np.random.default_rng(8)
    text = " ".join(f"w{x}" for x in rng.integers(0, 5000, 500))
    rows = spark.range(2000).selectExpr("7L as doc_id").crossJoin(spark.createDataFrame([(text,)], "text string"))
    assert repeats.remove_repeats(rows).where(f"n_removed = {len(text)} and n_spans = 1 and repeats").count() == 2000
    assert neardup.near_documents(rows).where("component_id = 7").count() == 2000
    assert repeats.remove_repeats(empty(spark)).count() == 0


def test_near_documents_by_brute_force(spark):
    """Recall where many texts share a template of which pairs differ in a few words."""
    rng = np.random.default_rng(12)
    template = [f"t{i}" for i in range(200)]
    texts = []
    for p in range(150):
        own = [f"p{p}-{k}" for k in range(220)]
        other = own.copy()
        other[50], other[150] = "x", "y"
        texts += [" ".join(template + own), " ".join(template + other)]
    words = [t.split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words]
    near = {(a, b) for a in range(300) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert len(near) == 150
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_documents(table).collect()}
    assert all(got[a] == got[b] == b for a, b in near) and len(set(got.values())) == 150


def test_pipeline_stages(spark, tmp_path):
    """Each stage on its own input: what it keeps, and what run() returns."""
    pytest.importorskip("public_tokenizers")
    rng = np.random.default_rng(13)
    good = lambda: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(40)) + "."
    bad = lambda: " ".join("".join(rng.choice(list("!#$%&XYZ"), rng.integers(2, 7))) for _ in range(40))
    rows = [(i, good() if i % 4 else bad(), "en", f"s{i % 2}", 0) for i in range(200)]
    rows += [(1000 + i, rows[i][1] + " more", "en", "s0", 0) for i in range(1, 4)]
    rows += [(2000 + i, good() + f" write to a{i}@b.example.com now " + good(), "en", "s1", 0) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality classifier"](spark, docs, str(tmp_path)).cache()
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows if r[0] >= 1000 or r[0] % 4}
    single = stages["MinHash near-dedup"](spark, kept, str(tmp_path)).cache()
    assert {r.doc_id for r in single.collect()} == {r[0] for r in rows if r[0] >= 2000 or (r[0] < 200 and r[0] % 4)}
    masked = stages["PII"](spark, single, str(tmp_path)).cache()
    texts = {r.doc_id: r for r in masked.collect()}
    assert all("@" not in r.text and r.n_chars == len(r.text) for r in texts.values()) and "[email]" in texts[2003].text
    assert all(texts[i].text == rows[i][1] for i in texts if i < 200)
    out = corpus_pipeline.run(spark, str(tmp_path))
    mixed = stages["mixing sources to target weights"](spark, masked, str(tmp_path))
    want = Counter((r.doc_id, r.text) for r in mixed.collect())
    assert out.count() == sum(want.values()) and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = {k: ",".join(map(str, sp.encode(k[1]))) for k in want}
    assert Counter((r.doc_id, r.ids_sha256) for r in out.collect()) == Counter({(k[0], hashlib.sha256(ids[k].encode()).hexdigest()): n for k, n in want.items()})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name
