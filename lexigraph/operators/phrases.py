"""Nodes made of several words, and the taxonomy of terms.

A term is a run of adjectives and nouns that ends in a noun.  A text's tagged
words stay in one string, a line each; the runs are what is left between other
lines, so no row leaves its place before the grouped sum.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraph.functions import rows as W
from lexigraph.functions import text as T


def term_runs(documents: DataFrame) -> DataFrame:
    """terms: the terms of each text, in order, with repeats."""
    w = documents.select(F.transform(T.words(), T.unmarked).alias("w"))
    tagged = w.select(F.expr(f"transform(w, plain -> named_struct('plain', plain, 'tag', {T.part_of_speech_sql()}))").alias("l"))
    lines = tagged.select(F.array_join(F.expr(f"transform(transform(l, x -> named_struct('p', x.plain, 'k', {T.LETTER.replace('tag', 'x.tag')})), y -> concat('\\n', y.k, y.p))"), "").alias("l"))
    # no repeated groups in these patterns: Java would recurse once a word
    runs = F.transform(F.split("l", "\n[^JN\n][^\n]*"), lambda r: F.regexp_extract(r, r"(?s)^.*\nN[^\n]*", 0))
    return lines.select(F.transform(F.filter(runs, lambda r: r != ""), lambda r: F.trim(F.regexp_replace(r, r"\n[JN]", " "))).alias("terms"))


def counted(rows: DataFrame, column: str) -> DataFrame:
    """text, word_cnt, text_cnt of an array column, a row a text; both are plain sums."""
    both = F.array(F.struct(F.lit(1).alias("n"), F.lit(0).alias("texts"), F.col(column).alias("w")), F.struct(F.lit(0).alias("n"), F.lit(1).alias("texts"), F.array_distinct(column).alias("w")))
    each = rows.select(F.inline(both)).select("n", "texts", F.explode("w").alias("text"))
    return each.groupBy("text").agg(F.sum("n").alias("word_cnt"), F.sum("texts").alias("text_cnt"))


_TERM = re.compile("[JN]*N")
_letters = W.Letters({"JJ": "J", "NN": "N", "NNS": "N", "NNP": "N"})


def term_nodes(documents: DataFrame) -> DataFrame:
    """text, word_cnt, text_cnt of terms, as `counted` has them of `term_runs`; both are added up over some texts before they are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.parts(batches):
            n: Counter = Counter()
            texts: Counter = Counter()
            for text in part.column("text").to_pylist():
                words = [*map(W.plain, W.pieces(text))]
                own = [" ".join(words[m.start() : m.end()]).strip(" ") for m in _TERM.finditer(_letters.of(words))]
                n.update(own)
                texts.update(set(own))
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([*n], pa.string()), pa.array([*n.values()], pa.int64()), pa.array([texts[t] for t in n], pa.int64())], ["text", "n", "texts"])

    return documents.select("text").mapInArrow(run, "text string, n long, texts long").groupBy("text").agg(F.sum("n").alias("word_cnt"), F.sum("texts").alias("text_cnt"))


def sentence_nodes(documents: DataFrame) -> DataFrame:
    return counted(documents.select(T.matches(T.SENTENCE).alias("s")), "s")


def parts(terms: DataFrame) -> DataFrame:
    """id, part: each term's words, in both of their spellings as nodes."""
    word = terms.select(F.col("text").alias("id"), F.explode(F.array_distinct(F.split("text", " "))).alias("part"))
    return word.select("id", F.explode(F.array("part", F.concat(F.lit("▁"), "part"))).alias("part"))


def root_edges(terms: DataFrame) -> DataFrame:
    """i, j, count: from a term of several words to its last one."""
    return terms.where(F.contains("text", F.lit(" "))).select(F.col("text").alias("i"), F.substring_index("text", " ", -1).alias("j"), F.col("word_cnt").alias("count"))


def taxonomy_edges(terms: DataFrame) -> DataFrame:
    """i, j, count: from a term to the longest other term that it ends in.

    A term's ends are compared by hashes chained from its last word on, so a term
    of n words sends n numbers; the texts are compared once a hash is equal.
    """
    step = lambda acc, x: F.concat(acc, F.array(F.xxhash64(F.get(acc, F.size(acc) - 1), x)))
    hashes = F.aggregate(F.reverse(F.split("text", " ")), F.array(F.lit(0).cast("long")), step)
    keyed = terms.select("text", "word_cnt", hashes.alias("h"))
    ends = keyed.where(F.size("h") > 2).select("text", "word_cnt", F.explode(F.slice("h", 2, F.size("h") - 2)).alias("end"))
    whole = keyed.select(F.element_at("h", -1).alias("end"), F.col("text").alias("j"))
    met = ends.select(F.col("text").alias("i"), "word_cnt", "end").join(whole, "end").where(F.endswith("i", F.concat(F.lit(" "), "j")))
    return met.groupBy("i").agg(F.max_by("j", F.length("j")).alias("j"), F.first("word_cnt").alias("count"))
