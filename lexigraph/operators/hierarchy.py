"""Phrases with places, and the edges between phrases, sentences, texts and labels.

All start from `tagged`, one row for each token with its sentence.  A phrase is a run of
tokens of one sentence: terms are adjectives and nouns up to the last noun; verbs start
with a verb form (or the modal before it) and take verbs, adverbs and `to`; connectors are
a preposition or `to` with the articles around it.

`phrases_of`, the functions on `documents` and what is built on them match phrases inside a text's row; those that count
edges or pairs send sums of many rows, so no table of tokens is written, sorted or shuffled.

Cases: null and empty texts have no tokens; a null doc_id is a text of its own; repeated
rows of one doc_id are texts each to functions on `documents`, but one text to the window functions, so give each row its own id there.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lexigraph.functions import rows as W
from lexigraph.functions import text as T
from lexigraph.operators import build as B


def _text() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("pos")


ENDS = (".", "?", "!")
# Labels where terms, sentences and texts begin and end.
LABELS = {kind: (f"__beg_{kind}__", f"__end_{kind}__") for kind in ("term", "sent", "text")}


def tagged(documents: DataFrame) -> DataFrame:
    """doc_id, pos, word, plain, tag, sent (number of the sentence)."""
    rows = B.tokens(documents).withColumn("tag", F.expr(T.part_of_speech_sql()))
    closed = F.coalesce(F.lag("plain").over(_text()).isin(*ENDS).cast("int"), F.lit(0))
    return rows.withColumn("closed", closed).withColumn("sent", F.sum("closed").over(_text().rowsBetween(Window.unboundedPreceding, 0))).drop("closed")


def _grouped(rows: DataFrame, kind: str, first, last) -> DataFrame:
    """Phrases of runs: those tokens of a run from `first` to `last` (conditions that mark where they may begin and end)."""
    run = Window.partitionBy("doc_id", "sent", "run")
    kept = rows.withColumn("lo", F.min(F.when(first, F.col("pos"))).over(run)).withColumn("hi", F.max(F.when(last, F.col("pos"))).over(run)).where("pos between lo and hi")
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "plain"))), lambda x: x["plain"]), " ")
    return kept.groupBy("doc_id", "sent", "lo", "hi").agg(words.alias("text")).select("doc_id", "sent", "lo", "hi", F.lit(kind).alias("name"), "text")


def terms(rows: DataFrame) -> DataFrame:
    """doc_id, sent, lo, hi (first and last token), name, text."""
    part = Window.partitionBy("doc_id", "sent").orderBy("pos")
    noun = F.col("tag").isin("NN", "NNS", "NNP")
    own = rows.withColumn("n", F.row_number().over(part)).where(noun | (F.col("tag") == "JJ"))
    return _grouped(own.withColumn("run", F.col("n") - F.row_number().over(part)), "term", F.lit(True), noun)


def verbs(rows: DataFrame) -> DataFrame:
    part = Window.partitionBy("doc_id", "sent").orderBy("pos")
    verb, modal = F.col("tag").isin("VB", "VBD", "VBG"), F.col("tag") == "MD"
    own = rows.withColumn("n", F.row_number().over(part)).withColumn("ahead", F.lead("tag").over(part)).where(verb | F.col("tag").isin("MD", "TO", "RB"))
    own = own.withColumn("run", F.concat_ws("-", F.col("n") - F.row_number().over(part), F.sum(modal.cast("int")).over(part.rowsBetween(Window.unboundedPreceding, 0))))
    return _grouped(own, "verb", verb | (modal & F.col("ahead").isin("VB", "VBD", "VBG")), ~modal)


def connectors(rows: DataFrame) -> DataFrame:
    part = Window.partitionBy("doc_id", "sent").orderBy("pos")
    core = F.col("tag").isin("IN", "TO")
    own = rows.withColumn("n", F.row_number().over(part)).where(core | (F.col("tag") == "DT"))
    own = own.withColumn("island", F.col("n") - F.row_number().over(part))
    met = F.sum(core.cast("int")).over(Window.partitionBy("doc_id", "sent", "island").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    own = own.withColumn("run", F.concat_ws("-", "island", F.greatest(met, F.lit(1))))
    has = F.max(core.cast("int")).over(Window.partitionBy("doc_id", "sent", "run"))
    return _grouped(own.withColumn("has", has).where("has = 1"), "conn", F.lit(True), F.lit(True))


# Kinds of phrases as patterns over a text's tags, a letter each: J adjective, N noun, V verb, M modal, I preposition or `to`, R adverb, D article, E the end of a sentence, O other.
PHRASES = {"term": "[JN]*N", "verb": "M?V(?:[VRT])*", "conn": "D*[IT]D*"}
TAG_LETTER = """CASE WHEN tag = 'JJ' THEN 'J' WHEN tag IN ('NN', 'NNS', 'NNP') THEN 'N' WHEN tag IN ('VB', 'VBD', 'VBG') THEN 'V' WHEN tag = 'MD' THEN 'M'
  WHEN tag = 'IN' THEN 'I' WHEN tag = 'TO' THEN 'T' WHEN tag = 'RB' THEN 'R' WHEN tag = 'DT' THEN 'D' ELSE 'O' END"""
_RUNS = ArrayType(StructType([StructField("name", StringType()), *(StructField(c, IntegerType()) for c in ("sent", "lo", "hi")), StructField("text", StringType())]))


def phrases_of(documents: DataFrame, *kinds: str) -> DataFrame:
    """doc_id and phrases (array of name, sent, lo, hi, text) of each text: its tags are one string in which phrases are matched, and no token leaves its row."""
    wanted = [(k, re.compile(PHRASES[k])) for k in kinds or PHRASES]

    @F.pandas_udf(_RUNS)
    def runs(letters: pd.Series, lines: pd.Series) -> pd.Series:
        def of(t: str, line: str) -> list[dict]:
            ends, words = [k for k, c in enumerate(t) if c == "E"], line.split("\n")
            return [{"name": k, "sent": bisect_left(ends, m.start()), "lo": m.start() + 1, "hi": m.end(), "text": " ".join(words[m.start() : m.end()])} for k, p in wanted for m in p.finditer(t)]

        return pd.Series([of(t, line) for t, line in zip(letters, lines, strict=True)], dtype=object)

    rows = documents.select("doc_id", F.transform(T.words(), T.unmarked).alias("w"))
    letters = F.expr(f"transform(w, x -> CASE WHEN x IN ('.', '?', '!') THEN 'E' ELSE {TAG_LETTER.replace('tag', '(' + T.part_of_speech_sql('x') + ')')} END)")
    # no token holds a line feed
    return rows.select("doc_id", runs(F.array_join(letters, ""), F.array_join("w", "\n")).alias("phrases"))


# Enumerations as patterns over letters: J adjective, N, S, P noun (singular, plural, proper), C conjunction, a comma, E the end of a sentence, O other.
# A list is taken whole, and skipped whole where it doesn't go on: what begins later in it wouldn't either.
def _listed(x: str, last: str) -> re.Pattern:
    many = f"{x}++(?:,{x}++)*+"
    return re.compile(f"(?P<x>{many},?C,?{last})|{many}")


ENUMERATIONS = {"enum-term-mark-1": _listed("J", "J++[NS]"), **{f"enum-term-mark-{k}": _listed(x, f"{x}++") for k, x in enumerate("NSP", 2)}}
ENUM_LETTER = """CASE WHEN tag = 'JJ' THEN 'J' WHEN tag = 'NN' THEN 'N' WHEN tag = 'NNS' THEN 'S' WHEN tag = 'NNP' THEN 'P' WHEN tag = 'CC' THEN 'C' ELSE 'O' END"""


def enumerations(documents: DataFrame) -> DataFrame:
    """doc_id, name, sent, lo, hi, text, tags: listed adjectives before a noun, and listed nouns of one kind, joined by commas and a conjunction.

    Each kind looks at the whole text, so kinds may overlap.  Each row of documents is a text of its own; null and empty texts have no rows.
    """

    @F.pandas_udf(ArrayType(StructType([*_RUNS.elementType.fields, StructField("tags", StringType())])))
    def runs(letters: pd.Series, lines: pd.Series) -> pd.Series:
        def of(t: str, line: str) -> list[dict]:
            ends, words = [k for k, c in enumerate(t) if c == "E"], line.split("\n")
            hits = ((k, *m.span("x")) for k, p in ENUMERATIONS.items() for m in p.finditer(t) if m.group("x"))
            return [{"name": k, "sent": bisect_left(ends, s), "lo": s + 1, "hi": e, "text": " ".join(words[s:e]), "tags": t[s:e]} for k, s, e in hits]

        return pd.Series([of(t, line) for t, line in zip(letters, lines, strict=True)], dtype=object)

    rows = documents.select("doc_id", F.transform(T.words(), T.unmarked).alias("w"))
    letters = F.expr(f"transform(w, x -> CASE WHEN x IN ('.', '?', '!') THEN 'E' WHEN x = ',' THEN ',' ELSE {ENUM_LETTER.replace('tag', '(' + T.part_of_speech_sql('x') + ')')} END)")
    return rows.select("doc_id", F.inline(runs(F.array_join(letters, ""), F.array_join("w", "\n"))))


_LETTERS = {"JJ": "J", "NN": "N", "NNS": "N", "NNP": "N", "VB": "V", "VBD": "V", "VBG": "V", "MD": "M", "IN": "I", "TO": "T", "RB": "R", "DT": "D"}
_letters = W.Letters(_LETTERS, ENDS)


def places_in(letters: str, patterns: list[tuple[str, re.Pattern]]) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the phrases of a text's letters, kind by kind."""
    for kind, pattern in patterns:
        for m in pattern.finditer(letters):
            yield kind, m.start(), m.end()


def _matched(kinds: tuple[str, ...]) -> list[tuple[str, re.Pattern]]:
    return [(k, re.compile(PHRASES[k])) for k in kinds or PHRASES]


def phrases_in(documents: DataFrame, *kinds: str) -> DataFrame:
    """doc_id, name, sent, lo, hi, text: a row for each phrase; each row of documents is a text of its own."""
    wanted, key = _matched(kinds), documents.schema["doc_id"]
    schema = StructType([StructField("doc_id", key.dataType), *_RUNS.elementType.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.parts(batches):
            at, rows = [], []
            for k, text in enumerate(part.column("text").to_pylist()):
                words = [*map(W.plain, W.pieces(text))]
                letters = _letters.of(words)
                ends = [x for x, c in enumerate(letters) if c == "E"]
                found = [(kind, bisect_left(ends, s), s + 1, e, " ".join(words[s:e])) for kind, s, e in places_in(letters, wanted)]
                rows += found
                at += [k] * len(found)
            if rows:
                types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(at)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], schema.names)

    return documents.select("doc_id", "text").mapInArrow(run, schema)


def _pairs(documents: DataFrame, of: Callable[[list[str], list[str], str], Iterator[tuple[str, str]]], most: int = 100_000) -> DataFrame:
    """i, j, count of the pairs that `of` finds in each text (its words, plain words and letters); tasks add up about `most` pairs before they send them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        for part in W.parts(batches, 20):
            for text in part.column("text").to_pylist():
                if found := W.pieces(text):
                    plain = [*map(W.plain, found)]
                    sums.update(of([*map(W.marked, found)], plain, _letters.of(plain)))
            if len(sums) >= most:
                yield _summed(sums)
                sums.clear()
        if sums:
            yield _summed(sums)

    return documents.select("text").mapInArrow(run, "i string, j string, count long").groupBy("i", "j").agg(F.sum("count").alias("count"))


def _summed(sums: Counter) -> pa.RecordBatch:
    i, j = zip(*sums, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(i, pa.string()), pa.array(j, pa.string()), pa.array(list(sums.values()), pa.int64())], ["i", "j", "count"])


def neighbours_in(documents: DataFrame, *kinds: str) -> DataFrame:
    """i, j, count: neighbours when phrases stand for their words; kinds given later win where phrases overlap."""
    wanted = _matched(kinds)

    def of(words: list[str], plain: list[str], letters: str) -> Iterator[tuple[str, str]]:
        ids, starts = words, [*range(len(words))]
        for _, s, e in places_in(letters, wanted):
            ids[s:e] = [" ".join(plain[s:e])] * (e - s)
            starts[s:e] = [s] * (e - s)
        # tokens side by side that stand for one phrase are one node
        kept = [ids[0], *(b for a, b, s, t in zip(ids, ids[1:], starts, starts[1:]) if a != b or s != t)]
        return zip(kept, kept[1:])

    return _pairs(documents, of)


def labels_in(documents: DataFrame) -> DataFrame:
    """i, j, count: labels to the first word of terms, sentences and texts, and from their last word to labels."""
    wanted = _matched(("term",))

    def of(words: list[str], plain: list[str], letters: str) -> Iterator[tuple[str, str]]:
        last = len(letters) - 1
        stops = [k for k, c in enumerate(letters) if c == "E" or k == last]
        spans = {"term": [(s, e - 1) for _, s, e in places_in(letters, wanted)], "sent": zip([0, *(k + 1 for k in stops)], stops), "text": [(0, last)]}
        for kind, own in spans.items():
            begin, end = LABELS[kind]
            for s, e in own:
                yield begin, words[s]
                yield words[e], end

    return _pairs(documents, of)


def short_forms_in(documents: DataFrame) -> DataFrame:
    """doc_id, short, long: a token in round brackets that isn't all lower-case, and the term that ends right before the bracket."""
    wanted, key = _matched(("term",)), documents.schema["doc_id"]
    schema = StructType([StructField("doc_id", key.dataType), StructField("short", StringType()), StructField("long", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.parts(batches):
            at, rows = [], []
            for k, text in enumerate(part.column("text").to_pylist()):
                if not text or "(" not in text:
                    continue
                words = [*map(W.plain, W.pieces(text))]
                short = {x - 1: w for x, w in enumerate(words[1:-1], 1) if words[x - 1] == "(" and words[x + 1] == ")" and w != w.lower()}
                if short:
                    for _, s, e in places_in(_letters.of(words), wanted):
                        if e in short:
                            at.append(k)
                            rows.append((short[e], " ".join(words[s:e])))
            if rows:
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(at)), *(pa.array(c, pa.string()) for c in zip(*rows, strict=True))], schema.names)

    # without an id there is nothing that the two have in common
    return documents.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, schema)


def phrase_counters(documents: DataFrame, kind: str) -> DataFrame:
    """text, word_cnt, sent_cnt, text_cnt of one kind: distinct phrases are found inside a text, so that all three are plain sums."""
    p = phrases_of(documents, kind).select("phrases")
    part = lambda n, s, t, texts: F.struct(F.lit(n).alias("n"), F.lit(s).alias("s"), F.lit(t).alias("t"), texts.alias("texts"))
    by_sentence = F.transform(F.array_distinct(F.transform("phrases", lambda r: F.struct(r["sent"].alias("sent"), r["text"].alias("text")))), lambda x: x["text"])
    texts = F.transform("phrases", lambda r: r["text"])
    each = p.select(F.inline(F.array(part(1, 0, 0, texts), part(0, 1, 0, by_sentence), part(0, 0, 1, F.array_distinct(texts))))).select("n", "s", "t", F.explode("texts").alias("text"))
    return each.groupBy("text").agg(F.sum("n").alias("word_cnt"), F.sum("s").alias("sent_cnt"), F.sum("t").alias("text_cnt"))


def phrase_nodes(phrases: DataFrame) -> DataFrame:
    """name, text, word_cnt, sent_cnt, text_cnt; distinct counts are sums over distinct rows made first, so that a frequent phrase isn't one task's."""
    each = phrases.groupBy("name", "text", "doc_id", "sent").agg(F.count("*").alias("n"))
    text = each.groupBy("name", "text", "doc_id").agg(F.sum("n").alias("n"), F.count("*").alias("sents"))
    return text.groupBy("name", "text").agg(F.sum("n").alias("word_cnt"), F.sum("sents").alias("sent_cnt"), F.count("*").alias("text_cnt"))


def to_text_edges(phrases: DataFrame) -> DataFrame:
    """i (phrase), j (doc_id as text), count."""
    return phrases.where("doc_id is not null").groupBy(F.col("text").alias("i"), F.col("doc_id").cast("string").alias("j")).agg(F.count("*").alias("count"))


def to_sentence_edges(phrases: DataFrame) -> DataFrame:
    """i (phrase), j (doc_id and number of the sentence), count."""
    return phrases.where("doc_id is not null").groupBy(F.col("text").alias("i"), F.concat_ws("#", F.col("doc_id").cast("string"), F.col("sent").cast("string")).alias("j")).agg(F.count("*").alias("count"))


def label_edges(rows: DataFrame, phrases: DataFrame) -> DataFrame:
    """name, i, j, count: labels to the first word of terms, sentences and texts, and from their last word to labels."""
    word = rows.select(F.col("doc_id").alias("d"), F.col("pos").alias("p"), "word")
    ends = phrases.where("name = 'term'").select("doc_id", "lo", "hi", F.lit("term").alias("kind"))
    sents = rows.groupBy("doc_id", "sent").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    texts = rows.groupBy("doc_id").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    ends = ends.unionByName(sents.select("doc_id", "lo", "hi", F.lit("sent").alias("kind"))).unionByName(texts.select("doc_id", "lo", "hi", F.lit("text").alias("kind")))
    both = ends.select("doc_id", "kind", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("lo").alias("p")), F.struct(F.lit(1).alias("side"), F.col("hi").alias("p")))).alias("x")).select("doc_id", "kind", "x.*")
    met = both.join(word, F.col("doc_id").eqNullSafe(F.col("d")) & (both["p"] == word["p"]))
    begin, end = (F.concat(F.lit(f"__{x}_"), "kind", F.lit("__")) for x in ("beg", "end"))
    return met.groupBy(F.when(F.col("side") == 0, begin).otherwise(F.col("word")).alias("i"), F.when(F.col("side") == 0, F.col("word")).otherwise(end).alias("j")).agg(F.count("*").alias("count"))


def phrase_neighbours(rows: DataFrame, *phrases: DataFrame) -> DataFrame:
    """i, j, count: neighbours when phrases stand for their words; phrases given later win where they overlap."""
    now = rows.select("doc_id", "pos", F.col("word").alias("id"), F.col("pos").alias("start"))
    for p in phrases:
        at = p.select(F.col("doc_id").alias("d"), F.explode(F.sequence("lo", "hi")).alias("p"), F.col("text").alias("phrase"), F.col("lo").alias("s"))
        now = now.join(at, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("pos") == F.col("p")), "left").select("doc_id", "pos", F.coalesce("phrase", "id").alias("id"), F.coalesce("s", "start").alias("start"))
    same = (F.lag("id").over(_text()) == F.col("id")) & (F.lag("start").over(_text()) == F.col("start"))
    kept = now.withColumn("same", F.coalesce(same, F.lit(False))).where("not same")
    return kept.select(F.col("id").alias("i"), F.lead("id").over(_text()).alias("j")).where("j is not null").groupBy("i", "j").agg(F.count("*").alias("count"))


def tag_neighbours(rows: DataFrame, distance: int = 1) -> DataFrame:
    """i, j, count of tags `distance` apart."""
    return rows.select(F.col("tag").alias("i"), F.lead("tag", distance).over(_text()).alias("j")).where("j is not null").groupBy("i", "j").agg(F.count("*").alias("count"))


CONT = r"[A-Za-z]+(?:-[A-Za-z]+)+"


def concatenations(documents: DataFrame) -> DataFrame:
    """text, word_cnt, text_cnt of words joined by hyphens."""
    from lexigraph.operators.phrases import counted

    return counted(documents.select(T.matches(CONT).alias("c")), "c")


def concatenation_edges(conts: DataFrame) -> DataFrame:
    """i (joined word), j (its part), count."""
    return conts.select(F.col("text").alias("i"), F.explode(F.split("text", "-")).alias("j"), "word_cnt").groupBy("i", "j").agg(F.sum("word_cnt").alias("count"))


def instance_nodes(found: DataFrame) -> DataFrame:
    """name, label, text, count: what annotation has found, by kind and subtype: the instance nodes and their edges to labels."""
    return found.groupBy(F.col("kind").alias("label"), F.col("subtype").alias("sublabel"), F.col("name").alias("text")).agg(F.count("*").alias("count"))


def abbreviations(found: DataFrame, phrases: DataFrame) -> DataFrame:
    """doc_id, short, long: a phrase in round brackets, not all lower-case and without blanks, and the phrase that ends right before the bracket.

    found: annotations of parentheses with token places lo, hi (of what is inside); phrases: doc_id, lo, hi, text.
    """
    short = found.where((F.col("text") != F.lower("text")) & ~F.contains("text", F.lit(" "))).select("doc_id", F.col("text").alias("short"), (F.col("lo") - 2).alias("hi"))
    return short.join(phrases.select("doc_id", "hi", F.col("text").alias("long")), ["doc_id", "hi"]).select("doc_id", "short", "long")


def bracketed(rows: DataFrame) -> DataFrame:
    """doc_id, lo, hi, text of single tokens in round brackets."""
    before, after = F.lag("plain").over(_text()), F.lead("plain").over(_text())
    return rows.withColumn("b", before).withColumn("a", after).where("b = '(' and a = ')'").select("doc_id", F.col("pos").alias("lo"), F.col("pos").alias("hi"), F.col("plain").alias("text"))
