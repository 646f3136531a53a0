"""Fields of references, and what documents say of themselves.

`references` reads texts that are references: each token gets the label of the field it is in, and
runs of one label, at most a byte apart, are one row.  Fields are found in order: the
reference's own number; links, numbers of books, pages and dates by their signs; authors from the beginning on, as
long as names with initials follow; a title in quotes, or else the next part; parts with the words of
conferences and publishers; then the journal with its volume; what else has letters is a note.
Marks behind a field are in its place, not in its name.

`metadata` reads documents as texts in order (doc_id, at, page, text, label), all by sums and joins by
document: only texts before the first one of page 2 may be the heading of the abstract or the introduction; the
title stands before the first text labelled meta-data, authors and affiliations between it and the abstract.

Cases: null and empty texts have no rows, and head nothing; a null doc_id stays null in references, and is a document in
metadata; repeated rows have rows each in references, and are texts at one place in metadata (of two titles or heads of a place the lesser is taken);
a null page is before page 2; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigraph.functions import text as T
from lexigraph.operators import annotate as A

#: The labels of fields.
LABELS = ("reference-number", "authors", "title", "publisher", "journal", "conference", "date", "volume", "pages", "url", "doi", "isbn", "note")
_MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?"
_SIGNED = [
    ("url", re.compile(r"https?://\S+|www\.\S+")),
    ("doi", re.compile(r"(?:doi|DOI)[:.]?\s?10\.\S+|\b10\.\d{4,9}/\S+")),
    ("isbn", re.compile(r"(?:ISBN|isbn)[:\s]?\s?[\d-]{9,16}[\dXx]?")),
    ("pages", re.compile(r"\b(?:pp?\.|pages)\s?\d+(?:\s?[-–]{1,2}\s?\d+)?")),
    ("date", re.compile(rf"\((?:{_MONTH}\s)?(?:18|19|20)\d\d\)|\b(?:\d{{1,2}}\s)?(?:{_MONTH}\s)?(?:18|19|20)\d\d\b(?!\s?[-–]\s?\d)")),
]
_NUMBER = re.compile(r"\s*(?:\[\d+\]|\(\d+\)|\d+\.(?=\s))")
_FAMILY = r"(?:(?:van|von|de|der|den|di|la)\s)*[A-ZÀ-ÖØ-Þ][^\W\d_]+(?:[-'][A-ZÀ-ÖØ-Þ][^\W\d_]+)*"
_AUTHOR = re.compile(rf"(?:[A-ZÀ-ÖØ-Þ]\.[\s-]?)+{_FAMILY}|{_FAMILY},?\s(?:[A-ZÀ-ÖØ-Þ]\.[\s-]?)+(?<!\s)|et\sal\.?")
_BETWEEN = re.compile(r"\s?(?:[,;]\s?(?:and\s|&\s?)?|and\s|&\s?)|\s")
_QUOTED = re.compile(r"\"[^\"]+\"|“[^”]+”")
_CONFERENCE = re.compile(r"\b(?:Proc\.|Proceedings|Conference|Conf\.|Symposium|Workshop)")
_PUBLISHER = re.compile(r"\b(?:Press|Publish\w+|Verlag|Springer|Elsevier|Wiley)\b")
_WORD, _DIGIT = re.compile(r"[^\W\d_]"), re.compile(r"\d")
_TOKEN = re.compile(T.TOKEN)
# What is taken off a field's name at its beginning and its end.
BEFORE, AFTER = ("(", "[", "doi:", "DOI:", "isbn:", "ISBN:", "arXiv preprint", " "), ")]., "
_BEFORE = re.compile(f"(?:{'|'.join(map(re.escape, BEFORE))})*")
COLUMNS = "doc_id long, label string, i long, j long, ci long, cj long, name string, original string"


def field_name(label: str, original: str) -> str:
    plain = original.rstrip(AFTER)
    plain = plain[_BEFORE.match(plain).end() :]
    return plain.replace(" ", "") if label in ("doi", "url") else plain


def token_labels(text: str) -> list[tuple[int, int, str | None]]:
    """(start, end, label) of each token of a reference."""
    spans = [(m.end() - len(m.group().lstrip(T.SPACES)), m.end()) for m in _TOKEN.finditer(text)]
    starts, labels = [s for s, _ in spans], [None] * len(spans)

    def put(s: int, e: int, label: str) -> None:
        for k in range(bisect_left(starts, s), bisect_left(starts, e)):
            labels[k] = labels[k] or label

    at = m.end() if (m := _NUMBER.match(text)) else 0
    put(0, at, "reference-number")
    for label, pattern in _SIGNED:
        for m in pattern.finditer(text):
            put(*m.span(), label)
    at = end = at + len(text[at:]) - len(text[at:].lstrip())
    while m := _AUTHOR.match(text, at):
        end = m.end()
        between = _BETWEEN.match(text, end)
        at = end = between.end() if between else end
        if not between:
            break
    first = bisect_left(starts, end)
    put(starts[0] if spans and first else 0, end, "authors")
    titled = False
    if m := _QUOTED.search(text, end):
        put(*m.span(), "title")
        titled = True
    k, journal = first, False
    while k < len(spans):
        if labels[k]:
            k += 1
            continue
        last = k  # a part ends at a mark with white space behind it, or where another field begins
        while last + 1 < len(spans) and not labels[last + 1] and not (text[starts[last]] in ".,;" and (spans[last][1] < starts[last + 1])):
            last += 1
        part = text[starts[k] : spans[last][1]]
        if not _WORD.search(part):
            label = "volume" if _DIGIT.search(part) else labels[k - 1] if k else None
            labels[k : last + 1] = [label] * (last + 1 - k)
        elif titled and not journal and not _CONFERENCE.search(part) and not _PUBLISHER.search(part):
            journal = True
            digit = next((x for x in range(k, last + 1) if text[starts[x]].isdigit()), last + 1)
            labels[k : last + 1] = ["journal" if x < digit else "volume" for x in range(k, last + 1)]
        else:
            label = "title" if not titled else "conference" if _CONFERENCE.search(part) else "publisher" if _PUBLISHER.search(part) else "note"
            titled, journal = True, journal or label in ("conference", "publisher")
            labels[k : last + 1] = [label] * (last + 1 - k)
        k = last + 1
    return [(s, e, label) for (s, e), label in zip(spans, labels, strict=True)]


def fields(text: str) -> list[tuple[str, int, int]]:
    """(label, start, end): tokens of one label, at most a byte apart, are one."""
    runs: dict[str, list[list[int]]] = {}
    for s, e, label in token_labels(text):
        if not label:
            continue
        own = runs.setdefault(label, [])
        if own and (s == own[-1][1] or s == own[-1][1] + 1 and text[s - 1].isascii()):
            own[-1][1] = e
        else:
            own.append([s, e])
    return [(label, s, e) for label in LABELS for s, e in runs.get(label, ())]


def references(texts: DataFrame) -> DataFrame:
    """A row for each field of texts (doc_id, text, label) labelled reference."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = fields(text) if text else []
                if not found:
                    continue
                at = range(len(text) + 1) if text.isascii() else A.places(text).tolist()
                rows += [(doc, label, at[s], at[e], s, e, field_name(label, text[s:e]), text[s:e]) for label, s, e in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("label", "name", "original") else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)

    return texts.where("label = 'reference'").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, COLUMNS)


def kept_instances(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Annotations of texts that aren't labelled reference: a reference keeps its fields alone."""
    own = texts.where("label = 'reference'").select(F.col("doc_id").alias("d")).distinct()
    return found.join(own, F.col("doc_id").eqNullSafe(F.col("d")), "left_anti")


def _heads(word: str) -> Column:
    plain = F.lower(F.replace(F.col("text"), F.lit(" "), F.lit("")))
    return plain.startswith(word) | plain.endswith(word)


def bounds(texts: DataFrame) -> DataFrame:
    """doc_id, abstract, introduction (places of the headings), last (before the first of them) and title (-1: none) of documents with either heading."""
    far = texts.groupBy("doc_id").agg(F.min(F.when(F.col("page") >= 2, F.col("at"))).alias("far")).withColumnRenamed("doc_id", "d")
    same = F.col("doc_id").eqNullSafe(F.col("d"))
    near = texts.join(far, same).where(F.col("far").isNull() | (F.col("at") < F.col("far")))
    heads = near.groupBy("doc_id").agg(*(F.max(F.when(_heads(w), F.col("at"))).alias(w) for w in ("abstract", "introduction")))
    heads = heads.withColumn("last", F.coalesce("abstract", "introduction")).where("last is not null").withColumnRenamed("doc_id", "d")
    meta = F.min(F.when((F.col("label") == "meta-data") & (F.col("at") >= 1) & (F.col("at") < F.col("last")), F.col("at")))
    return texts.join(heads, same).groupBy("doc_id", "abstract", "introduction", "last").agg((F.coalesce(meta, F.lit(0)) - 1).alias("title"))


def metadata(texts: DataFrame, names: DataFrame) -> DataFrame:
    """doc_id, field (title, author, affiliation, abstract), at, name.

    texts: doc_id, at (from 0), page, text, label; names: doc_id, at, subtype, name of the names found in texts.
    """
    known = bounds(texts).withColumnRenamed("doc_id", "d")
    same = F.col("doc_id").eqNullSafe(F.col("d"))
    rows = texts.select("doc_id", "at", "text").join(known, same)
    titles = rows.where("at = title").groupBy("doc_id", "at").agg(F.min("text").alias("name")).select("doc_id", F.lit("title").alias("field"), "at", "name")
    people = names.join(known, same).where("at > title AND at < last").withColumn("field", F.expr("CASE subtype WHEN 'person-name' THEN 'author' WHEN 'specialised-name' THEN 'affiliation' END"))
    people = people.where("field is not null").select("doc_id", "field", "at", "name")
    # with an introduction the abstract is all before it; without, the heading's text, and the next one if the heading stands alone behind it
    both = rows.where("introduction is not null AND at >= abstract AND at < introduction")
    alone = rows.where("introduction is null AND at = abstract")
    # by a join, as sums by document can't keep texts of any length apart
    after = alone.where(F.trim(F.lower("text")).endswith("abstract")).select(F.col("d").alias("e"), (F.col("at") + 1).alias("next")).distinct()
    after = rows.join(after, F.col("d").eqNullSafe(F.col("e")) & (F.col("at") == F.col("next"))).select(rows.columns)
    abstracts = both.unionByName(alone).unionByName(after).select("doc_id", F.lit("abstract").alias("field"), "at", F.col("text").alias("name"))
    return titles.unionByName(people).unionByName(abstracts)
