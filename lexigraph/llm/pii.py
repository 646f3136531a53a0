"""Personal data: exact patterns, and a character-level bidirectional LSTM with CRF transitions.

The patterns give the base spans (email, ip, card, phone).  The network adds what
they miss: secrets (access tokens, passwords), numbers that a greedy match has run
together with their neighbours, and addresses and numbers in disguise (`[at]`,
`[.]`, no plus sign).  It is trained in numpy from labelled spans: windows of a
bounded sample with the spans that `labelled` finds, and copies of them in which
spans are disguised or stand side by side.

Texts are cut into overlapping windows; each that holds a digit, an at sign or a
bracketed `at` is decoded, since a span of any kind holds one of these.  The spans of
all windows of a text are reconciled globally: parts that windows' edges have cut off
are joined where they overlap, equal spans count once, overlaps go to the surer,
base spans always stay.  An added span must be sure (its least tag posterior at least
`sure`) and look like its kind (`plausible`).

Offsets are code points, ends exclusive.  Cases: null and empty texts have no
spans; null doc_id stays null; repeated rows are searched each; an empty table
gives no rows, and an untrained network adds nothing; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: Tags: 0 outside, then beginning and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
WINDOW, STRIDE = 96, 48
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TRIGGER_PATTERN = r"[0-9@]|[(\[]at[)\]]"
TRIGGER = re.compile(TRIGGER_PATTERN)
SECRET = re.compile(r"""(?i)\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)["']?\s*[:=]\s*["']?([a-z0-9+/_=-]{16,})""")


def luhn(digits: str) -> bool:
    back = [int(d) for d in reversed(digits)]
    return sum(back[::2] + [x * 2 - 9 * (x > 4) for x in back[1::2]]) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def passes(kind: str, text: str) -> bool:
    """A kind's own test."""
    d = _digits(text)
    if kind == "email":
        return "@" in text[1:-1]
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed: leftmost matches, failing ones dropped."""
    found = []
    if "@" in text:
        free, at = 0, text.find("@")
        while at >= 0:
            start = free + len(text[free:at].rstrip(LOCAL))
            m = DOMAIN.match(text, at + 1) if start < at else None
            if m:
                found.append((start, m.end(), 0))
                free = m.end()
            else:
                free = at + 1
            at = text.find("@", free)
    if TRIGGER.search(text):
        found += [(*m.span(), 1) for m in IP.finditer(text) if passes("ip", m.group())]
        found += [(*m.span(), 2) for m in CARD.finditer(text) if passes("card", m.group())]
        found += [(*m.span(), 3) for m in PHONE.finditer(text) if passes("phone", m.group())]
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2], x[1]))]


def labelled(text: str) -> list[tuple[int, int, str]]:
    """Spans to learn from: the base spans, secrets behind their names, and numbers inside failing matches."""
    found = base_spans(text)
    found += [(*m.span(1), "secret") for m in SECRET.finditer(text)]
    for m in PHONE.finditer(text):
        if len(_digits(m.group())) > 15:
            ends = [k.start() for k in re.finditer(" ", m.group()) if 9 <= len(_digits(m.group()[: k.start()])) <= 15]
            found += [(m.start(), m.start() + ends[-1], "phone")] if ends else []
    for m in CARD.finditer(text):
        if len(_digits(m.group())) > 19:
            found += [(m.start() + k.start(), m.start() + k.end(), "card") for k in re.finditer("[0-9]{12,19}", m.group()) if luhn(k.group())]
    return sorted(found)


def plausible(kind: str, text: str) -> bool:
    """Whether a span that the network has found looks like its kind."""
    d = _digits(text)
    if kind == "email":
        return bool(re.fullmatch(r"[^\s@]+ ?(?:@|[(\[]at[)\]]) ?[^\s@]+", text)) and bool(re.search(r"\.|dot", text.rpartition("at" if "@" not in text else "@")[2]))
    if kind == "secret":
        return bool(re.fullmatch(r"[A-Za-z0-9+/_=-]{16,}", text)) and len(d) > 2 and sum(c.isalpha() for c in text) > 2
    if kind == "phone":
        return 9 <= len(d) <= 15 and bool(re.fullmatch(r"\+?[0-9 ().-]+", text))
    return passes(kind, text)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def windows(text: str) -> list[tuple[int, int]]:
    """The overlapping windows of a text that hold a trigger."""
    picked = {i for m in TRIGGER.finditer(text) for i in ((m.start() // STRIDE), (m.start() // STRIDE) - 1) if i >= 0}
    return [(i * STRIDE, min(len(text), i * STRIDE + WINDOW)) for i in sorted(picked)]


def classes(text: str) -> np.ndarray:
    """Characters as 0..97: ASCII signs as themselves, letters and digits by class, 96 other letters, 97 padding."""
    out = np.full(WINDOW, 97, np.int64)
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    c = np.where((code >= 32) & (code < 127), code - 32, np.where(code < 32, 0, 96))
    c[(code >= 97) & (code <= 122)] = 65
    c[(code >= 65) & (code <= 90)] = 33
    c[(code >= 48) & (code <= 57)] = 16
    out[: len(c)] = c
    return out


def tags(length: int, spans: list[tuple[int, int, str]]) -> np.ndarray:
    out = np.zeros(WINDOW, np.int64)
    for s, e, kind in sorted(spans, key=lambda x: -KINDS.index(x[2])):
        s, e, k = max(s, 0), min(e, length), KINDS.index(kind)
        if s < e:
            out[s:e] = 2 + 2 * k
            out[s] = 1 + 2 * k
    return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Bidirectional LSTM over character classes, linear emissions, CRF transitions."""

    def __init__(self, hidden: int = 16, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.h, self.trained = hidden, False
        self.w = {f"{n}{d}": v for d in "fb" for n, v in (("x", rng.normal(0, 0.3, (98, 4 * hidden))), ("r", rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))), ("c", np.repeat([0.0, 1.0, 0.0, 0.0], hidden)))}
        self.w |= {"out": rng.normal(0, 0.2, (2 * hidden, TAGS)), "bias": np.array([2.0] + [0.0] * (TAGS - 1)), "move": np.zeros((TAGS, TAGS))}
        #: An inside tag follows only its own kind.
        self.barred = np.zeros((TAGS, TAGS))
        self.first = np.zeros(TAGS)
        for k in range(len(KINDS)):
            inside = 2 + 2 * k
            self.barred[[i for i in range(TAGS) if i not in (inside, inside - 1)], inside] = -1e4

    def lstm(self, x: np.ndarray, d: str, keep: bool):
        """Hidden states [T, B, h] of class rows x [B, T], read forwards (f) or backwards (b)."""
        n, h = x.shape[1], self.h
        wx, wr, wc = self.w["x" + d], self.w["r" + d], self.w["c" + d]
        state, cell = np.zeros((len(x), h)), np.zeros((len(x), h))
        out, saved = np.zeros((n, len(x), h)), []
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            z = wx[x[:, t]] + state @ wr + wc
            z[:, : 3 * h] = 1 / (1 + np.exp(-z[:, : 3 * h]))
            z[:, 3 * h :] = np.tanh(z[:, 3 * h :])
            new = z[:, h : 2 * h] * cell + z[:, :h] * z[:, 3 * h :]
            squash = np.tanh(new)
            if keep:
                saved.append((t, z, cell, state, squash))
            cell, state = new, z[:, 2 * h : 3 * h] * squash
            out[t] = state
        return out, saved

    def emissions(self, x: np.ndarray, keep: bool = False):
        f, saved_f = self.lstm(x, "f", keep)
        b, saved_b = self.lstm(x, "b", keep)
        both = np.concatenate([f, b], 2)
        return both @ self.w["out"] + self.w["bias"], both, saved_f, saved_b

    def posteriors(self, e: np.ndarray):
        """Tag posteriors [T, B, K], expected transitions [K, K], log partition [B]."""
        move, n = self.w["move"] + self.barred, len(e)
        a, b = np.empty_like(e), np.zeros_like(e)
        a[0] = e[0] + self.first + np.where(np.arange(TAGS) % 2, 0, np.where(np.arange(TAGS) == 0, 0, -1e4))
        for t in range(1, n):
            a[t] = e[t] + _lse(a[t - 1][:, :, None] + move, 1)
        for t in range(n - 2, -1, -1):
            b[t] = _lse(move + (e[t + 1] + b[t + 1])[:, None, :], 2)
        z = _lse(a[-1], 1)
        pairs = np.zeros((TAGS, TAGS))
        for t in range(1, n):
            pairs += np.exp(a[t - 1][:, :, None] + move + (e[t] + b[t])[:, None, :] - z[:, None, None]).sum(0)
        return np.exp(a + b - z[None, :, None]), pairs, z

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        move = self.w["move"] + self.barred
        best = e[0] + np.where(np.arange(TAGS) % 2, 0, np.where(np.arange(TAGS) == 0, 0, -1e4))
        back = []
        for t in range(1, len(e)):
            s = best[:, :, None] + move
            back.append(s.argmax(1))
            best = s.max(1) + e[t]
        path = [best.argmax(1)]
        for p in reversed(back):
            path.append(np.take_along_axis(p, path[-1][:, None], 1)[:, 0])
        return np.stack(path[::-1], 1)

    def gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        e, both, saved_f, saved_b = self.emissions(x, keep=True)
        post, pairs, _ = self.posteriors(e)
        n = len(x)
        gold = np.zeros_like(post)
        np.put_along_axis(gold, y.T[:, :, None], 1.0, 2)
        de = (post - gold) / n
        seen = np.zeros((TAGS, TAGS))
        np.add.at(seen, (y[:, :-1], y[:, 1:]), 1)
        g = {"move": (pairs - seen) / n, "bias": de.sum((0, 1)), "out": np.einsum("tbh,tbk->hk", both, de)}
        dh = de @ self.w["out"].T
        for d, saved, part in (("f", saved_f, dh[:, :, : self.h]), ("b", saved_b, dh[:, :, self.h :])):
            g |= self.back(x, d, saved, part)
        return g

    def back(self, x: np.ndarray, d: str, saved: list, dh: np.ndarray) -> dict[str, np.ndarray]:
        h, wr = self.h, self.w["r" + d]
        gx, gr, gc = np.zeros_like(self.w["x" + d]), np.zeros_like(wr), np.zeros(4 * h)
        ds, dc = np.zeros((len(x), h)), np.zeros((len(x), h))
        for t, z, cell, state, squash in reversed(saved):
            i, f, o, c = z[:, :h], z[:, h : 2 * h], z[:, 2 * h : 3 * h], z[:, 3 * h :]
            ds = ds + dh[t]
            dc = dc + ds * o * (1 - squash * squash)
            dz = np.concatenate([dc * c * i * (1 - i), dc * cell * f * (1 - f), ds * squash * o * (1 - o), dc * i * (1 - c * c)], 1)
            np.add.at(gx, x[:, t], dz)
            gr += state.T @ dz
            gc += dz.sum(0)
            ds, dc = dz @ wr.T, dc * f
        return {"x" + d: gx, "r" + d: gr, "c" + d: gc}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 9, batch: int = 64, rate: float = 0.02, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), batch):
                pick = order[lo : lo + batch]
                step += 1
                for k, g in self.gradient(x[pick], y[pick]).items():
                    np.clip(g, -1, 1, out=g)
                    m, v = moment[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    self.w[k] -= rate * (0.3 if epoch >= epochs - 2 else 1) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.trained = True

    def decode(self, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
        """(start, end, kind, least posterior) of each window's spans."""
        out: list[list[tuple[int, int, str, float]]] = []
        for lo in range(0, len(texts), 256):
            part = texts[lo : lo + 256]
            e = self.emissions(np.stack([classes(t) for t in part]))[0]
            path, post = self.viterbi(e), self.posteriors(e)[0]
            for w, text in enumerate(part):
                spans, i = [], 0
                while i < len(text):
                    tag = path[w, i]
                    if tag % 2:
                        j = i + 1
                        while j < len(text) and path[w, j] == tag + 1:
                            j += 1
                        spans.append((i, j, KINDS[tag // 2], float(post[np.arange(i, j), w, path[w, i:j]].min())))
                        i = j
                    else:
                        i += 1
                out.append(spans)
        return out


def reconcile(text: str, base: list[tuple[int, int, str]], decoded: list[tuple[tuple[int, int], list]], sure: float) -> list[tuple[int, int, str]]:
    """Base spans, and those added by the windows of a whole text."""
    every = []
    for (lo, hi), spans in decoded:
        every += [(kind, lo + s, lo + e, p, s == 0 and lo > 0, lo + e == hi and hi < len(text)) for s, e, kind, p in spans]
    added: dict[tuple[int, int, str], float] = {}
    now: tuple | None = None
    for part in [*sorted(every), None]:
        if now and part and part[0] == now[0] and part[1] < now[2] and (now[5] or part[4]):
            # one span, of which a window's edge has cut off a part
            now = (now[0], now[1], max(now[2], part[2]), min(now[3], part[3]), now[4] and (part[4] or part[1] > now[1]), part[5] if part[2] >= now[2] else now[5])
            continue
        if now and now[3] >= sure and not now[4] and not now[5] and plausible(now[0], text[now[1] : now[2]]):
            key = (now[1], now[2], now[0])
            added[key] = max(added.get(key, 0.0), now[3])
        now = part
    taken = list(base)
    for s, e, kind in sorted(added, key=lambda k: (-added[k], k)):
        if all(e <= a or b <= s for a, b, _ in taken):
            taken.append((s, e, kind))
    return sorted(taken, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def disguised(windows_: list[tuple[str, list[tuple[int, int, str]]]], seed: int = 9) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Copies of labelled windows in which a span is disguised, or is followed by another."""
    rng = np.random.default_rng(seed)
    spans = [text[s:e] for text, own in windows_ for s, e, k in own if k != "secret" and e - s < 30 and 0 < s and e < len(text)]
    out = []
    for text, own in windows_:
        whole = [x for x in own if 0 < x[0] and x[1] < len(text)]
        if not whole:
            continue
        s, e, kind = whole[rng.integers(len(whole))]
        old, new = text[s:e], ""
        if kind == "secret":
            signs = "0123456789abcdef" if rng.integers(2) else LOCAL[:62]
            new = "".join(signs[i] for i in rng.integers(0, len(signs), rng.integers(16, 45)))
            new = new.upper() if old.isupper() else new
        elif kind == "email":
            user, _, host = old.partition("@")
            new = user + ("[at]", "(at)", " @ ")[rng.integers(3)] + (host.replace(".", "[dot]") if rng.integers(2) else host)
        elif kind == "ip":
            new = old.replace(".", "[.]") if rng.integers(2) else ""
        elif kind == "phone":
            new = old.lstrip("+0123456789").lstrip() if rng.integers(2) else ""
            new = new if passes("phone", new) else ""
        if new:
            made, marks = text[:s] + new, [x for x in own if x[1] <= s] + [(s, s + len(new), kind)]
        else:
            more = spans[rng.integers(len(spans))] if spans else old
            made, marks = text[:e] + " " + more, [x for x in own if x[1] <= e]
            other = labelled(more)
            marks += [(e + 1 + a, e + 1 + b, k) for a, b, k in other]
        made = (made + text[e:])[:WINDOW]
        marks += [x for x in labelled(made) if x[0] >= len(made) - len(text[e:]) and all(x[1] <= a or b <= x[0] for a, b, _ in marks)]
        out.append((made, [(a, min(b, len(made)), k) for a, b, k in marks if a < len(made)]))
    return out


def train(documents: DataFrame, sample: int = 1500, copies: int = 1000) -> Tagger:
    """Fit on at most `sample` distinct windows, chosen by hash, half of them with a span if there are as many, and on `copies` disguised ones (or half as many as windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {"text": [], "spans": [], "some": []}
            for text in batch.column("text").to_pylist():
                if not text or not TRIGGER.search(text):
                    continue
                every = labelled(text)
                for lo, hi in windows(text):
                    own = [(max(s, lo) - lo, min(e, hi) - lo, k) for s, e, k in every if s < hi and e > lo]
                    rows["text"].append(text[lo:hi])
                    rows["spans"].append(joined(own))
                    rows["some"].append(bool(own))
            if rows["text"]:
                yield pa.RecordBatch.from_arrays([pa.array(rows["text"], pa.string()), pa.array(rows["spans"], pa.string()), pa.array(rows["some"], pa.bool_())], ["text", "spans", "some"])

    found = documents.select("text").where(F.col("text").rlike(TRIGGER_PATTERN)).mapInArrow(run, "text string, spans string, some boolean")
    key = F.xxhash64("text", "spans")
    found = cut(found.distinct(), "pii-windows")
    rows = found.where("some").orderBy(key, "text").limit(sample // 2).unionByName(found.where("not some").orderBy(key, "text").limit(sample - sample // 2)).collect()
    net = Tagger()
    known = sorted((r["text"], r["spans"]) for r in rows)
    if any(s for _, s in known):
        pairs = [(t, [(int(s), int(e), k) for k, s, e in (x.split(":") for x in own.split(",") if x)]) for t, own in known]
        goal, seed = len(pairs) + max(copies, len(pairs) // 2), 9
        while len(pairs) < goal:
            more = disguised(pairs[: len(known)], seed)[: goal - len(pairs)]
            if not more:
                break
            pairs, seed = pairs + more, seed + 1
        net.fit(np.stack([classes(t) for t, _ in pairs]), np.stack([tags(len(t), s) for t, s in pairs]))
    return net


def search(texts: list[str | None], net: Tagger, sure: float = 0.5) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text; the windows of all texts are decoded together."""
    texts = [t or "" for t in texts]
    base = [base_spans(t) for t in texts]
    cuts = [(i, w) for i, t in enumerate(texts) for w in (windows(t) if net.trained else [])]
    decoded = net.decode([texts[i][lo:hi] for i, (lo, hi) in cuts]) if cuts else []
    per: dict[int, list] = {}
    for (i, w), spans in zip(cuts, decoded, strict=True):
        if spans:
            per.setdefault(i, []).append((w, spans))
    return [(b, reconcile(t, b, per[i], sure) if i in per else b) for i, (t, b) in enumerate(zip(texts, base, strict=True))]


def find_personal_data(documents: DataFrame, net: Tagger, sure: float = 0.5) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added, n_spans (all)."""
    shared = documents.sparkSession.sparkContext.broadcast(net)
    names = ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_added", "n_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 500):
                batch = whole.slice(at, 500)
                found = search(batch.column("text").to_pylist(), shared.value, sure)
                counts = [pa.array([sum(k == kind for *_, k in b) for b, _ in found], pa.int64()) for kind in BASE_KINDS]
                digest = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *counts, digest, pa.array([joined(a) for _, a in found], pa.string()), pa.array([len(a) - len(b) for b, a in found], pa.int64()), pa.array([len(a) for _, a in found], pa.int64())], names)

    schema = ", ".join(f"{n} {'string' if n in ('base_sha256', 'spans') else 'long'}" for n in names)
    return documents.select("doc_id", "text").mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each stretch covered by spans replaced by the name of its first span's kind in brackets."""
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def mask_documents(documents: DataFrame, net: Tagger, sure: float = 0.5) -> DataFrame:
    """The documents with personal data masked; n_chars, where there, follows the text."""
    shared = documents.sparkSession.sparkContext.broadcast(net)
    place = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 500):
                batch = whole.slice(at, 500)
                texts = batch.column(place).to_pylist()
                new = [masked(t, a) if a else t for t, (_, a) in zip(texts, search(texts, shared.value, sure), strict=True)]
                yield batch.set_column(place, batch.schema.field(place), pa.array(new, pa.string()))

    out = documents.mapInArrow(run, documents.schema)
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return out
