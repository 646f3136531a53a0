"""Annotation: rows of what is found in texts, with places.

Each model is a list of patterns.  A masking model blanks what a pattern has found
before the next one looks, so earlier patterns win.  `annotate` gives one row for each
hit; sentences look at a text in which the hits of other models are masked.

The patterns are compiled into equal ones that take time in proportion to a text's length: numbers
and runs of names are taken whole, and where a pattern fails at the head of a run, the run is skipped.
A pattern isn't tried on a text that lacks a sign each of its hits holds.  Numbers and names are looked for in
a short form of the text: the stretches that can hold a hit, each with what stands right beside it, and a sign of no pattern between.

Places: i, j are bytes of the text in UTF-8, ci, cj code points; ends are exclusive.
Cases: null and empty texts have no rows; a null doc_id stays null; repeated rows are
annotated each; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraph.functions import rows as W
from lexigraph.functions import text as T

# The patterns of the models, in their order; the hit is the group `x`, or else the whole match.
_CAP = r"[A-Z][a-z]+"
PATTERNS: dict[str, list[tuple[str, str]]] = {
    "numval": [
        ("enum", r"(?P<x>\d+)(?:st|rd|th)"),
        ("year", r"(?:^|[^\d])(?P<x>(?:18|19|20)\d{2}(?:ies|'?s)?)(?:$|[^\d])"),
        ("year", r"\d0(?:ies|'?s)"),
        ("fexp", r"10\^\(-?\d+\)"),
        ("fexp", r"10\^\{-?\d+\}"),
        ("fexp", r"10-\^\{\d+\}"),
        ("fexp", r"10\^-?\d+"),
        ("fsci", r"-?\d+(?:[.,]\d+)?\s*[eE]\s*-?\d+(?:[.,]\d+)?"),
        ("fval", r"-?\d+[.,]\d+\s*(?:-+)?\s*-?\d+[.,]\d+"),
        ("fval", r"-?\d+[.,]\d+\s*(?:-+)?\s*-?\d+"),
        ("fval", r"(?:-\s*)?\d+[.,]\d+"),
        ("irng", r"\d+\s*-+\s*\d+"),
        ("ival", r"(?:-\s*)?\d+"),
    ],
    "link": [
        ("url", r"https?(?:[^\s()\[\]]|\s\.\s)+"),
        ("url", r"www\.?[^\s()\[\]]+"),
        ("doi", r"(?:doi|DOI):?\.?\s?[^\s()\[\]]+"),
        ("email", r"[^\s()\[\]]+@[^\s()\[\]]+"),
        ("arxiv", r"arXiv:\d+.\d+(?:v\d*)? \[.+\] \d+ [A-Za-z]+ \d+"),
    ],
    "cite": [
        ("latex-cite", r"~?\\(?:cite|ref)\{[^}]+\}"),
        ("latex-cite", r"~?\\(?:cite|ref)\[[^\]]+\]"),
        ("wiki-cite", r"\[\[\d+(?:-\d+)?(?:,\d+(?:-\d+)?)*\]\]"),
    ],
    "name": [
        ("specialised-name", rf"(?:{_CAP}\s+)+of\s+(?:{_CAP}\s+)+and\s+(?:{_CAP}\s+)*{_CAP}"),
        ("specialised-name", rf"(?:{_CAP}\s+)+of\s+(?:{_CAP}\s+)*{_CAP}"),
        ("specialised-name", rf"(?:{_CAP}\s+)+for\s+(?:{_CAP}\s+)*{_CAP}"),
        ("person-name", rf"(?P<x>{_CAP},\s+(?:[A-Z]\.\s?)+)(?:,|$)"),
        ("person-name", rf"(?:{_CAP}\s+)+(?:[A-Z]\.\s+)+(?:{_CAP})+"),
        ("person-name", rf"(?:{_CAP}\s+)*(?:[A-Z]\.\s+)+(?:{_CAP}\s+)*{_CAP}"),
        ("abbreviation-name", r"(?:[A-Z][a-z]{0,3}\.\s+){1,2}[A-Z][a-z]{0,3}\."),
        ("person-group", rf"{_CAP}\s+et\.?\s+al\.?"),
        ("name-concatenation", rf"(?:{_CAP}(?:\s*-)+\s*)+{_CAP}"),
        ("abbreviation-name", r"(?:[A-Z]\.\s*){2,}"),
        ("person-name", rf"(?:{_CAP}\s+)+(?:[A-Z]\s+)+(?:{_CAP})+"),
        ("person-name", rf"(?:{_CAP}\s+)+(?:{_CAP})+"),
    ],
    "quote": [
        ("quote", r'"[A-Za-z][^".]*[^\\][.?!]?"'),
        ("quote", r"'{3}[A-Za-z][^'.]*[^\\][.?!]?'{3}"),
        ("quote", r"'{2}[A-Za-z][^\".]*[^\\](?:\.|\?!)?\""),
        ("quote", r"'{2}[A-Za-z][^'.]*[^\\][.?!]?'{2}"),
        ("quote", r"[^A-Za-z](?P<x>'[A-Za-z][A-Za-z\-\s]+[.?!]?')"),
    ],
    "parenthesis": [
        ("reference", r"\(\d+\)"),
        ("reference", r"\[\d+\]"),
        ("reference", r"\(\d+-\d+\)"),
        ("reference", r"\[\d+-\d+\]"),
        ("reference", r"\((?:\d+,\s*)*\d+-\d+\)"),
        ("reference", r"\[(?:\d+,\s*)*\d+-\d+\]"),
        ("round brackets", r"\([^()]+\)"),
        ("square brackets", r"\[[^\[\]]+\]"),
    ],
    "expression": [
        ("latex-concatenation", r"(?:\s|^)(?P<x>\${2}[^$]+\${2}\s*-\s*[a-z]+)[\s.,?]"),
        ("latex-concatenation", r"(?:\s|^)(?P<x>\$[^$]+\$\s*-\s*[a-z]+)[\s.,?]"),
        ("latex-concatenation", r"(?:\s|^)(?P<x>[A-Za-z]+\s*-\s*\${2}[^$]+\${2})[\s.,?]"),
        ("latex-concatenation", r"(?:\s|^)(?P<x>[A-Za-z]+\s*-\s*\$[^$]+\$)[\s.,?]"),
        ("word-concatenation", r"(?:\s|^)(?P<x>[A-Za-z]+\s*(?:-\s*)+[A-Za-z]+(?:\s*(?:-\s*)+[A-Za-z]+)*)[\s.,?]"),
        ("word-concatenation", r"(?:\s|^)(?P<x>[A-Za-z]+\s*(?:/\s*)+[A-Za-z]+(?:\s*(?:/\s*)+[A-Za-z]+)*)[\s.,?]"),
        ("word-concatenation", r"(?:\s|^)(?P<x>\([A-Za-z]+\)[A-Za-z\-]+)[\s.,?]"),
        ("latex", r"\${2}[^$]+\${2}"),
        ("latex", r"\$[^$]+\$"),
        ("latex", r"\\[a-z]+(?:[_^]?\{[^}$]+\})+"),
        ("latex", r"\\?\{\s*\\[^}]+\s*\\?\}"),
        ("latex", r"\\\[\s*\\[^\]]+\\\]"),
        ("latex", r"\\begin\{[^}]+\}.*\\end\{[^}]+\}"),
        ("html", r"<[a-z][^<>]*>[^<>]+<\\[a-z]>"),
        ("repetition", r"-{2,}"),
        ("repetition", r"'{2,}"),
        ("repetition", r'"{2,}'),
        ("repetition", r"={2,}"),
        ("common", r"(?P<x>i\.?\s?e\.)[\s,]"),
        ("common", r"(?P<x>e[.\s]*g\.)[\s,]"),
        ("common", r"et\.?\s+al\.?"),
        ("common", r"\.{3,}|etc\."),
        ("common", r"(?:\.\s*){2,}\."),
        ("common", r"[Nn]o\."),
        ("common-abbreviation", r"\s(?P<x>(?:viz|no|pp|vol|ser)\.)\s"),
        ("apostrophe", r"(?:\s|^)(?P<x>[A-Za-z]+'[a-z])\s"),
        ("apostrophe", r"(?:\s|^)(?P<x>[A-Za-z]+')\s"),
    ],
    "sentence": [("proper", r"[A-Z][^.?!]+[.?!]")],
}
#: Models whose patterns don't mask, and what a model needs first.
PLAIN = ("link", "cite")
NEEDS = {"quote": ("numval",), "expression": ("name", "link", "cite", "numval", "quote", "parenthesis"), "sentence": ("name", "link", "numval", "cite", "quote", "expression", "parenthesis")}

# Where a pattern would begin again at each place of a run, or go back through it: an equal pattern, and what may be
# skipped if it fails.  A skipped run holds no hit from a later place either.
_NUMBER, _NAMES = r"\d++", rf"{_CAP}(?:\s++{_CAP})*+"
#: Signs at which no hit begins that is skipped by a run.
_RUNS = {_NUMBER: r"[^\d\-]", _NAMES: "[^A-Z]"}
_APART = r"\d++(?=[\s-])\s*+-*+\s*+-?"
_LINEAR: dict[str, tuple[str, str]] = {
    r"(?P<x>\d+)(?:st|rd|th)": (r"\d++(?=st|rd|th)", _NUMBER),
    r"-?\d+(?:[.,]\d+)?\s*[eE]\s*-?\d+(?:[.,]\d+)?": (r"-?\d++(?:[.,]\d++)?+\s*+[eE]\s*+-?\d++(?:[.,]\d+)?", _NUMBER),
    r"-?\d+[.,]\d+\s*(?:-+)?\s*-?\d+[.,]\d+": (rf"-?\d++[.,](?:{_APART}\d++|\d+\d)[.,]\d+", _NUMBER),
    r"-?\d+[.,]\d+\s*(?:-+)?\s*-?\d+": (rf"-?\d++[.,](?:{_APART}\d+|\d\d+)", _NUMBER),
    r"(?:-\s*)?\d+[.,]\d+": (r"(?:-\s*+)?\d++[.,]\d+", _NUMBER),
    r"\d+\s*-+\s*\d+": (r"\d++\s*+-++\s*+\d+", _NUMBER),
    r"[^\s()\[\]]+@[^\s()\[\]]+": (r"[^\s()\[\]]+@[^\s()\[\]]+", r"[^\s()\[\]]++"),
    r"[A-Z][^.?!]+[.?!]": (r"[A-Z][^.?!]++[.?!]", r"[A-Z][^.?!]++\Z"),
    rf"(?:{_CAP}\s+)*(?:[A-Z]\.\s+)+(?:{_CAP}\s+)*{_CAP}": (rf"(?:{_CAP}\s++)*+(?:[A-Z]\.\s++)++(?:{_CAP}\s+)*{_CAP}", rf"(?:{_CAP}\s++)*+(?:[A-Z]\.\s++)++|{_NAMES}"),
    r"'{2}[A-Za-z][^\".]*[^\\](?:\.|\?!)?\"": (r"'{2}[A-Za-z][^\".]*[^\\](?:\.|\?!)?\"", r"'{2}[A-Za-z][^\".]*+(?=\Z|\.(?!\"))"),
    r"\\begin\{[^}]+\}.*\\end\{[^}]+\}": (r"\\begin\{[^}]+\}.*\\end\{[^}]+\}", r"\\begin\{[^}]++\}(?!.*\\end\{).*+"),
}
# patterns that a closing mark ends: without one, none is behind either
for _open, _inner in ((r"~?\\(?:cite|ref)\{", r"[^}]"), (r"~?\\(?:cite|ref)\[", r"[^\]]"), (r"\\[a-z]+[_^]?\{", r"[^}$]"), (r"\\?\{\s*\\", r"[^}]"), (r"\\\[\s*\\", r"[^\]]"), (r"\\begin\{", r"[^}]")):
    for _p in {p for ps in PATTERNS.values() for _, p in ps if p.startswith(_open.replace(r"[_^]?\{", ""))}:
        _own, _skip = _LINEAR.get(_p, (_p, ""))
        _LINEAR[_p] = _own, "|".join(x for x in (_skip, rf"{_open}{_inner}*+\Z") if x)
for _p in {p for _, p in PATTERNS["name"] if p.startswith(rf"(?:{_CAP}\s+)+") and not p.endswith(rf"+(?:{_CAP})+") or "[A-Z]" in p and p.startswith(rf"(?:{_CAP}\s+)+")}:
    _LINEAR.setdefault(_p, (_p, _NAMES))


def _compiled(pattern: str) -> re.Pattern:
    own, skip = _LINEAR.get(pattern, (pattern, ""))
    if skip in _RUNS:
        # runs one behind the other at which a hit doesn't begin are skipped at once: between them none begins either
        skip = rf"(?:(?!{own.replace('(?P<x>', '(?:')}){skip}{_RUNS[skip]}*+)++"
    return re.compile(rf"(?P<x>{own})|{skip}") if skip else re.compile(pattern)


_COMPILED = {kind: [(sub, _compiled(p)) for sub, p in patterns] for kind, patterns in PATTERNS.items()}

# What every hit of a pattern holds: one of some signs, or a match of a short pattern that is found fast.
_HOLDS: dict[str, tuple[str, ...] | str] = {
    r"(?P<x>\d+)(?:st|rd|th)": ("st", "rd", "th"),
    r"\d0(?:ies|'?s)": ("0s", "0'", "0i"),
    r"-?\d+(?:[.,]\d+)?\s*[eE]\s*-?\d+(?:[.,]\d+)?": ("e", "E"),
    r"\d+\s*-+\s*\d+": ("-",),
    r"[^\s()\[\]]+@[^\s()\[\]]+": ("@",),
    rf"{_CAP}\s+et\.?\s+al\.?": ("et",),
    rf"(?:{_CAP}(?:\s*-)+\s*)+{_CAP}": ("-",),
    r"'{3}[A-Za-z][^'.]*[^\\][.?!]?'{3}": ("'''",),
    r"[^A-Za-z](?P<x>'[A-Za-z][A-Za-z\-\s]+[.?!]?')": ("'",),
    r"(?:\s|^)(?P<x>[A-Za-z]+\s*-\s*\$[^$]+\$)[\s.,?]": r"-\s*\$",
    r"(?:\s|^)(?P<x>\$[^$]+\$\s*-\s*[a-z]+)[\s.,?]": r"\$\s*-",
    r"(?:\s|^)(?P<x>[A-Za-z]+\s*(?:-\s*)+[A-Za-z]+(?:\s*(?:-\s*)+[A-Za-z]+)*)[\s.,?]": ("-",),
    r"(?:\s|^)(?P<x>[A-Za-z]+\s*(?:/\s*)+[A-Za-z]+(?:\s*(?:/\s*)+[A-Za-z]+)*)[\s.,?]": r"/[/\s]*[A-Za-z]",
    r"(?:\s|^)(?P<x>\([A-Za-z]+\)[A-Za-z\-]+)[\s.,?]": r"\)[A-Za-z\-]",
    r"\\?\{\s*\\[^}]+\s*\\?\}": r"\{\s*\\",
    r"\\\[\s*\\[^\]]+\\\]": ("\\[",),
    r"\\begin\{[^}]+\}.*\\end\{[^}]+\}": ("\\begin{",),
    r"\\[a-z]+(?:[_^]?\{[^}$]+\})+": ("\\",),
    r"\.{3,}|etc\.": ("...", "etc."),
    r"(?:\.\s*){2,}\.": r"\.\s*\.",
    r"[Nn]o\.": ("o.",),
    r"\s(?P<x>(?:viz|no|pp|vol|ser)\.)\s": ("viz.", "no.", "pp.", "vol.", "ser."),
    r"(?:\s|^)(?P<x>[A-Za-z]+'[a-z])\s": ("'",),
    r"(?:\s|^)(?P<x>[A-Za-z]+')\s": ("'",),
}
for _p in {p for ps in PATTERNS.values() for _, p in ps}:
    _own: tuple[str, ...] | str | None = None
    if _p.startswith("10"):
        _own = ("^",)
    elif _p in [p for sub, p in PATTERNS["numval"] if sub == "fval"]:
        _own = (".", ",")
    elif r"\${2}" in _p:
        _own = ("$$",)
    elif _p.startswith("'{2}"):
        _own = ("''",)
    elif re.fullmatch(r"(.)\{2,\}", _p):
        _own = (_p[0] * 2,)
    elif rf"\s+)+of\s+" in _p:
        _own = ("of",)
    elif rf"\s+)+for\s+" in _p:
        _own = ("for",)
    elif _p in [p for _, p in PATTERNS["name"]] and r"[A-Z]\." in _p or r"{0,3}\." in _p:
        _own = (".",)
    elif _p.startswith(r"~?\\"):
        _own = ("\\",)
    elif "@" not in _p and _p.startswith((r"\$", r"<", r"arXiv", r"www", r"http")):
        _own = (re.match(r"\\?([$<]|\w+)", _p)[1].removesuffix("s"),)
    if _own:
        _HOLDS.setdefault(_p, _own)


def _guard(pattern: str) -> Callable[[str], bool] | None:
    """Whether a text may have a hit of a pattern."""
    own = _HOLDS.get(pattern)
    if own is None or isinstance(own, str):
        return own and re.compile(own).search
    one = own[0]
    return (lambda text: one in text) if len(own) == 1 else (lambda text: any(x in text for x in own))


_GUARDS = {kind: [_guard(p) for _, p in patterns] for kind, patterns in PATTERNS.items()}

# Stretches that hold the hits of numbers and of names, also those that reach over blanked hits: from the first to the last
# digit of a hit, and from its first capital on, there are only these signs.  What stands before and behind that a pattern reads: code points.
_STRETCHES = {
    "numval": (re.compile(r"(?:-\s*+)?+\d[\d.,\s\-eE^(){}'is]*+"), 1, 2),
    "name": (re.compile(r"[A-Z][a-z]*+(?:[\s.,\-]++|of|for|and|et|al|[A-Z][a-z]*+)*+"), 0, 0),
}
#: A sign that is in no pattern and no class of signs of one.
_APART_SIGN = "\0"


def _short(kind: str, text: str) -> tuple[str, list[int], list[int]]:
    """The stretches of a text; where each begins there and in the text."""
    pattern, before, behind = _STRETCHES[kind]
    out, length, starts, places_, lo, hi, size = [], 0, [], [], -1, 0, len(text)
    for m in pattern.finditer(text):
        s, e = m.span()
        s, e = s - before if s > before else 0, e + behind
        # what two stretches would share stays between them
        if lo >= 0 and s > hi:
            out += (text[lo:hi], _APART_SIGN)
            starts.append(length)
            places_.append(lo)
            length += hi - lo + 1
            lo = s
        elif lo < 0:
            lo = s
        hi = e
    if lo >= 0:
        starts.append(length)
        places_.append(lo)
        out.append(text[lo:hi] if hi >= size else text[lo:hi] + _APART_SIGN)
    return "".join(out), starts, places_
COLUMNS = "doc_id long, kind string, subtype string, i long, j long, ci long, cj long, name string, original string"


def closure(kinds: list[str]) -> list[str]:
    """The models wanted and those they need, each behind its needs."""
    out: list[str] = []
    for kind in kinds:
        if kind not in PATTERNS:
            raise ValueError(f"there is no model {kind}")
        out += [k for k in [*closure(list(NEEDS.get(kind, ()))), kind] if k not in out]
    return out


def _masked(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with spans blanked that don't overlap and stand in order."""
    out, at = [], 0
    for s, e in spans:
        out += [text[at:s], " " * (e - s)]
        at = e
    return "".join([*out, text[at:]])


def cascade(kind: str, text: str, patterns=None) -> list[tuple[str, int, int]]:
    """(subtype, start, end) of a model's hits in a text."""
    if patterns is None and kind in _STRETCHES:
        short, starts, at = _short(kind, text)
        if len(short) < len(text):
            own = []
            for sub, s, e in _cascade(kind, short):
                k = bisect_right(starts, s) - 1
                shift = at[k] - starts[k]
                own.append((sub, s + shift, e + shift))
            return own
    return _cascade(kind, text, patterns)


def _cascade(kind: str, text: str, patterns=None) -> list[tuple[str, int, int]]:
    found, masks = [], kind not in PLAIN
    for (sub, pattern), guard in zip(patterns, [None] * len(patterns), strict=True) if patterns is not None else zip(_COMPILED[kind], _GUARDS[kind], strict=True):
        if guard and not guard(text):
            continue
        group = "x" if "x" in pattern.groupindex else 0
        hits = [span for m in pattern.finditer(text) if (span := m.span(group))[0] >= 0]
        if hits:
            found += [(sub, s, e) for s, e in hits]
            if masks:
                text = _masked(text, hits)
    return found


def _sentences(text: str, known: dict[str, list]) -> list[tuple[str, int, int]]:
    """Sentences of a text in which other hits are masked, and what lies between, as improper ones."""
    letters = list(text)
    for kind in NEEDS["sentence"]:
        for _, s, e in known[kind]:
            letters[s:e] = "A" + "a" * (e - s - 1) if kind in ("name", "expression", "quote") else " " * (e - s)
    text = "".join(letters)
    proper = [(s, e) for _, s, e in cascade("sentence", text)]
    out, at = [("proper", s, e) for s, e in proper], 0
    for s, e in [*proper, (len(text), len(text))]:
        gap = text[at:s]
        if gap.strip():
            out.append(("improper", at + len(gap) - len(gap.lstrip()), at + len(gap.rstrip())))
        at = max(at, e)
    return sorted(out, key=lambda x: x[1])


# What may stand between the two numbers of a compound one, signs that don't count aside.
SILENT, BETWEEN, APART = " \\/$", ("", "+-", "pm", "x", "times"), 10


def _values(text: str, hits: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Two numbers with nothing, or a sign of multiplication or of an error, between them are one; each number is in one pair at most."""
    out: list[tuple[str, int, int]] = []
    rest = sorted(hits, key=lambda x: x[1])
    silent, k = str.maketrans("", "", SILENT), 0
    while k < len(rest):
        if k + 1 < len(rest):
            between = text[rest[k][2] : min(rest[k + 1][1], rest[k][2] + APART)]
            if len(between.encode()) < APART and between.translate(silent) in BETWEEN:
                out.append(("fsci", rest[k][1], rest[k + 1][2]))
                k += 2
                continue
        out.append(rest[k])
        k += 1
    return out


# From the first to the last sign of quotes.  Numbers reach into it only with a digit there or up to four signs before.
_QUOTES, _DIGIT = re.compile(r"""['"](?:[\s\S]*['"])?"""), re.compile(r"\d")


def _numbers(text: str, compound: bool) -> list[tuple[str, int, int]]:
    found = cascade("numval", text)
    return _values(text, found) if compound else sorted(found, key=lambda x: x[1])


@cache
def _read(kinds: tuple[str, ...]) -> list[str]:
    """The models of a closure whose hits are wanted or looked at: expressions are looked for in the whole text, so the models before them aren't run for them, and quotes seldom look at numbers."""
    needed = {*kinds, *(NEEDS["sentence"] if "sentence" in kinds else ())}
    return [k for k in closure(list(kinds)) if k in needed]


def annotations(text: str, kinds: list[str], compound: bool = True) -> list[tuple[str, str, int, int]]:
    """(kind, subtype, start, end) of the models' hits, in their order and that of places."""
    known: dict[str, list] = {}
    for kind in _read(tuple(kinds)):
        if kind == "sentence":
            known[kind] = _sentences(text, known)
            continue
        seen = text
        if kind == "quote" and (signs := _QUOTES.search(text)) and _DIGIT.search(text, max(signs.start() - 4, 0), signs.end()):
            numbers = known["numval"] if "numval" in known else _numbers(text, compound)
            seen = _masked(text, [(s, e) for _, s, e in numbers])
        known[kind] = cascade(kind, seen) if kind != "numval" else _numbers(text, compound)
        if kind == "link":
            known[kind] = [(sub, s, s + len(text[s:e].rstrip(".)"))) for sub, s, e in known[kind]]
        elif kind == "expression":
            known[kind] = [x for x in known[kind] if x[0] == "common" or _balanced(text[x[1] : x[2]])]
    return [(k, sub, s, e) for k in kinds for sub, s, e in sorted(known[k], key=lambda x: (x[1], x[2]))]


def _balanced(text: str) -> bool:
    return all(text.count(a) == text.count(b) for a, b in ("()", "[]", "{}")) and text.count("$") % 2 == 0


def places(text: str) -> np.ndarray:
    """The byte at which each code point of a text begins, and its end."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.r_[0, np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))]


def annotate(texts: DataFrame, kinds: list[str] | None = None, custom: dict[str, list[tuple[str, str]]] | None = None, compound: bool = True, subtypes: tuple[str, ...] = ()) -> DataFrame:
    """One row for each hit of the models in texts (doc_id, text); `custom` models are masking cascades of (subtype, pattern); `compound`: whether two numbers may be one; `subtypes`: rows of these alone."""
    wanted, own = kinds or ([] if custom else list(PATTERNS)), {k: [(s, re.compile(p)) for s, p in ps] for k, ps in (custom or {}).items()}
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    closure(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                rows = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if not text:
                        continue
                    hits = annotations(text, wanted, compound) + [(k, *h) for k, ps in own.items() for h in cascade(k, text, ps)]
                    at = range(len(text) + 1) if text.isascii() else places(text).tolist()
                    for kind, sub, s, e in hits:
                        if subtypes and sub not in subtypes:
                            continue
                        found = text[s:e]
                        name = found.replace(" ", "") if kind == "link" else " ".join(found.split())
                        rows.append((doc, kind, sub, at[s], at[e], s, e, name, found))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("kind", "subtype", "name", "original") else pa.int64()) for n, c in zip(names, zip(*rows), strict=True)], names)

    return texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, COLUMNS)


def counts(texts: DataFrame, kinds: list[str], compound: bool = True) -> DataFrame:
    """doc_id, kind, subtype, n: how many hits of each subtype `annotate` has in the texts of a doc_id, counted inside a text's row."""
    closure(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.parts(batches):
            rows = []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                if text:
                    rows += [(doc, *k, n) for k, n in Counter([h[:2] for h in annotations(text, kinds, compound)]).items()]
            if rows:
                types = (pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "kind", "subtype", "n"])

    found = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, kind string, subtype string, n long")
    return found.groupBy("doc_id", "kind", "subtype").agg(F.sum("n").alias("n"))


#: Bytes of a bin, in which spans of a text meet: a text's pairs are those of its bins, so a long text is many small groups.
BIN = 256


def _bins(rows: DataFrame, i: str, j: str) -> DataFrame:
    """A row for each bin that a span touches."""
    last = F.greatest(F.col(i), F.col(j) - 1)
    return rows.withColumn("bin", F.explode(F.sequence(F.floor(F.col(i) / BIN), F.floor(last / BIN))))


def accepted(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Rows that overlap no reference or link, lie in no name or number, and are longer than a byte.  Repeated rows stay, spans of a null doc_id too."""
    o = _bins(others, "i", "j").select(F.col("doc_id").alias("d"), F.col("kind").alias("k"), F.col("subtype").alias("s"), F.col("i").alias("a"), F.col("j").alias("b"), F.col("bin").alias("n"))
    overlap = ((F.col("k") == "link") | ((F.col("k") == "parenthesis") & (F.col("s") == "reference"))) & (F.col("i") < F.col("b")) & (F.col("a") < F.col("j"))
    inside = F.col("k").isin("name", "numval") & (F.col("a") <= F.col("i")) & (F.col("j") <= F.col("b"))
    kept = rows.where("j - i > 1")
    spans = _bins(kept.select("doc_id", "i", "j").distinct(), "i", "j")
    hit = spans.join(o, (F.col("doc_id") == F.col("d")) & (F.col("bin") == F.col("n")) & (overlap | inside), "left_semi").select("doc_id", "i", "j").distinct()
    return kept.join(hit, ["doc_id", "i", "j"], "left_anti")


def within(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Each inner row with the outer spans (outer_i, outer_j) of its text that it lies in; without any, once with nulls."""
    o = _bins(outer.select("doc_id", F.col("i").alias("outer_i"), F.col("j").alias("outer_j")), "outer_i", "outer_j").select(F.col("doc_id").alias("d"), "outer_i", "outer_j", F.col("bin").alias("n"))
    met = inner.withColumn("bin", F.floor(F.col("i") / BIN)).join(o, (F.col("doc_id") == F.col("d")) & (F.col("bin") == F.col("n")) & (F.col("outer_i") <= F.col("i")) & (F.col("j") <= F.col("outer_j")), "left")
    return met.select(*inner.columns, "outer_i", "outer_j")


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """i, j of each outer row with the number of inner rows that lie in it, and those of a text that lie in none (outer_i null)."""
    return within(inner, outer).groupBy("doc_id", "outer_i", "outer_j").agg(F.count("*").alias("n"))


def merged(rows: DataFrame) -> DataFrame:
    """Annotations of several runs as one: distinct, in their order of places."""
    return rows.distinct().sortWithinPartitions("doc_id", "i", "j", "kind", "subtype")


def dictionary_hits(texts: DataFrame, names: DataFrame) -> DataFrame:
    """doc_id, name, n: how often names (of any number of tokens, whatever their case) stand in texts; only lengths that names have are read."""
    low = lambda c: F.transform(T.words(c), lambda x: F.lower(T.unmarked(x)))
    known = names.where(F.col("name").isNotNull()).select("name", low("name").alias("w")).where(F.size("w") > 0).select("name", F.size("w").alias("size"), F.array_join("w", " ").alias("key")).distinct()
    sizes = sorted(r[0] for r in known.select("size").distinct().collect())
    rows = texts.select("doc_id", low("text").alias("w"))

    def grams_of(n: int):
        own = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda k: F.struct(F.lit(n).alias("size"), F.array_join(F.slice("w", k, n), " ").alias("key")))
        return F.when(F.size("w") >= n, own)

    grams = [grams_of(n) for n in sizes]
    each = rows.select("doc_id", F.explode(F.flatten(F.filter(F.array(*grams), lambda g: g.isNotNull()))).alias("g")) if grams else rows.select("doc_id", F.struct(F.lit(0).alias("size"), F.lit("").alias("key")).alias("g")).limit(0)
    return each.select("doc_id", "g.*").join(known, ["size", "key"]).groupBy("doc_id", "name").agg(F.count("*").alias("n"))


def is_numeric_cell(text: str = "text"):
    """Whether a table cell holds nothing but numbers and signs."""
    plain = F.col(text)
    for _, p in PATTERNS["numval"]:
        plain = F.regexp_replace(plain, p.replace("(?P<x>", "("), "")
    return F.coalesce(F.regexp_replace(plain, r"[-+*:/(){}\[\]_^$%.,; ]", "") == "", F.lit(True))


def scores(pairs: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """label, tp, fp, fn, precision, recall, f1 of labelled rows (smoothed by 1e-12)."""
    one = pairs.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(truth) == F.col(predicted)).alias("ok")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(False).alias("ok")))).alias("x")).select("x.*")
    sums = one.groupBy("label").agg(F.sum(F.col("ok").cast("long")).alias("tp"), F.sum("t").alias("t"), F.sum("p").alias("p"))
    tp, tiny = F.col("tp"), F.lit(1e-12)
    out = sums.select("label", "tp", (F.col("p") - tp).alias("fp"), (F.col("t") - tp).alias("fn"), (tp / (F.col("p") + tiny)).alias("precision"), (tp / (F.col("t") + tiny)).alias("recall"))
    return out.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + tiny))
