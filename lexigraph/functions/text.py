"""Tokens and text predicates as column expressions; every pattern is valid in Java and in RE2."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space, brackets and punctuation of the tokeniser, and the link, citation and year patterns.
SPACES = " \n\r\t "
BRACKETS = "()[]{}"
PUNCTUATION = ".,:;?!~=<>$%\"'/+-_^‹›«»#"
LINKS = {
    "url": r"https?[^\s()\[\]]+|www\.?[^\s()\[\]]+",
    "doi": r"(?:doi|DOI):?\.?\s?[^\s()\[\]]+",
    "email": r"[^\s()\[\]]+@[^\s()\[\]]+",
}
CITATIONS = {
    "latex-cite": r"~?\\(?:cite|ref)\{[^}]+\}|~?\\(?:cite|ref)\[[^\]]+\]",
    "wiki-cite": r"\[\[\d+(?:-\d+)?(?:,\d+(?:-\d+)?)*\]\]",
}
YEAR = r"(?:^|[^0-9])(?:18|19|20)[0-9][0-9](?:ies|'?s)?(?:$|[^0-9])"
ENUM = r"[0-9]+(?:st|rd|th)"
SENTENCE = r"[A-Z][^.?!]+[.?!]"
ROUND, SQUARE = r"\([^()]+\)", r"\[[^\[\]]+\]"
REFERENCE = r"\[[0-9]+(?:[,-] ?[0-9]+)*\]"

_MARKS = "".join("\\" + c if c in "[]^-\\" else c for c in BRACKETS + PUNCTUATION)
#: A token, with the white space before it: digits, one mark, or a run of anything else.
TOKEN = f"[{SPACES}]*(?:[0-9]+|[{_MARKS}]|[^0-9{_MARKS}{SPACES}]+)"
LEADING = f"^[{SPACES}]+"


def words(text: str = "text") -> Column:
    """Graph words: tokens, marked where white space stands before them, the first one never; null text has none.

    All steps take the whole text at once: white space becomes one blank each,
    line feeds (no longer in use) are put around tokens, blanks become marks, and
    the text is split.
    """
    plain = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"[{SPACES}]+", " "))
    apart = F.regexp_replace(plain, f"( ?[0-9]+| ?[{_MARKS}]|(?= ))", "\n$1\n")
    parts = F.split(F.btrim(F.replace(apart, F.lit(" "), F.lit("▁")), F.lit("\n")), "\n+")
    return F.when(plain != "", parts).otherwise(F.array().cast("array<string>"))


def unmarked(word: Column) -> Column:
    """A word without its mark."""
    return F.when(word.startswith("▁"), F.substr(word, F.lit(2))).otherwise(word)


def spread(documents: DataFrame) -> DataFrame:
    """Documents in as many partitions as the cluster has cores, if their files can't be split so far (few row groups); a larger corpus stays as it is."""
    cores = documents.sparkSession.sparkContext.defaultParallelism
    return documents.repartition(cores) if documents.rdd.getNumPartitions() < cores else documents


def matches(pattern: str, text: str = "text") -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), F.lit(0))


# A small closed-class lexicon and suffix rules that stand in for a trained tagger.
LEXICON = {
    "DT": ["the", "a", "an", "this", "that", "these", "those"],
    "IN": ["of", "in", "on", "at", "by", "for", "with", "from", "as"],
    "TO": ["to"],
    "CC": ["and", "or", "but"],
    "MD": ["can", "could", "may", "might", "must", "shall", "should", "will", "would"],
    "PRP": ["he", "she", "it", "they", "we", "i", "you"],
    "VB": ["is", "are", "was", "were", "be", "been", "has", "have", "had", "do", "does", "did"],
}
SUFFIXES = [("ing", "VBG"), ("ed", "VBD"), ("ly", "RB"), ("ous", "JJ"), ("al", "JJ"), ("ive", "JJ")]


def part_of_speech_sql(plain: str = "plain") -> str:
    """The tagger as one CASE expression, for Spark and for other engines."""
    low = f"lower({plain})"
    cases = [f"WHEN {low} IN ({', '.join(repr(w) for w in ws)}) THEN '{tag}'" for tag, ws in LEXICON.items()]
    first = f"substr({plain}, 1, 1)"
    cases += [f"WHEN {first} >= '0' AND {first} <= '9' THEN 'CD'", f"WHEN length({plain}) = 1 AND lower({plain}) = upper({plain}) THEN ':'"]
    cases += [f"WHEN {low} LIKE '%{s}' THEN '{tag}'" for s, tag in SUFFIXES]
    cases += [f"WHEN {first} <> lower({first}) THEN 'NNP'", f"WHEN {low} LIKE '%s' THEN 'NNS'"]
    return f"CASE {' '.join(cases)} ELSE 'NN' END"


# A document's tags as letters: J adjective, N noun, V verb, M modal, T to or adverb, O other.
LETTER = f"""CASE WHEN tag = 'JJ' THEN 'J' WHEN tag IN ('NN', 'NNS', 'NNP') THEN 'N' WHEN tag IN ('VB', 'VBD', 'VBG') THEN 'V'
  WHEN tag = 'MD' THEN 'M' WHEN tag IN ('TO', 'RB') THEN 'T' ELSE 'O' END"""


def round_confidence(value: Column) -> Column:
    return F.least(F.round(value, 2), F.lit(1.0))


def bracket_imbalance(text: Column, left: str, right: str) -> Column:
    """Open minus closed brackets, cut off at the first negative prefix."""
    signs = F.transform(F.split(text, ""), lambda c: F.when(c == left, 1).when(c == right, -1).otherwise(0))
    return F.aggregate(signs, F.lit(0), lambda acc, x: F.when(acc < 0, acc).otherwise(acc + x))


def fixed_size(text: Column, size: int, by: str = " ") -> Column:
    """The text cut or filled up to a size."""
    return F.rpad(text, size, by)


def mask(text: Column, start: int, end: int, by: str = " ") -> Column:
    """The text with its characters from start (from 0) to end blanked."""
    return F.overlay(text, F.repeat(F.lit(by), F.lit(end - start)), start + 1, end - start)


def count_char(text: Column, char: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))).cast("long")


def is_alphabetic(text: Column) -> Column:
    return text.rlike("^[A-Za-z]+$")


def is_numeric(text: Column) -> Column:
    return text.rlike("^[0-9]+$")


def is_greek(text: Column) -> Column:
    return text.rlike("^\\p{IsGreek}+$")


def is_valid(data: Column) -> Column:
    """Whether bytes are UTF-8."""
    return F.is_valid_utf8(data)


def create_path(*parts: str | Column) -> Column:
    """#/texts/3"""
    return F.concat_ws("/", F.lit("#"), *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def path_order(path: Column) -> Column:
    """A key that orders paths part by part, numbers by value."""
    return F.transform(F.split(path, "/"), lambda p: F.coalesce(F.lpad(F.when(p.rlike("^[0-9]+$"), p), 20, "0"), p))


# Letters with a diaeresis, an acute and a grave accent.
ACCENTS = {"¨": ("aeiouyAEIOUY", "äëïöüÿÄËÏÖÜŸ"), '"': ("aeiouyAEIOUY", "äëïöüÿÄËÏÖÜŸ"), "'": ("aeiouyAEIOUY", "áéíóúýÁÉÍÓÚÝ"), "`": ("aeiouAEIOU", "àèìòùÀÈÌÒÙ")}


def normalised(text: Column) -> Column:
    """Accents that are written apart or in LaTeX become letters, and LaTeX commands leave what they hold."""
    for sign, (plain, accented) in ACCENTS.items():
        for a, b in zip(plain, accented, strict=True):
            forms = [f"¨{a}", f"¨ {a}"] if sign == "¨" else [f"\\{sign}{{{a}}}", f"\\{sign}{a}"]
            for form in forms:
                text = F.replace(text, F.lit(form), F.lit(b))
    text = F.regexp_replace(text, r"\{\\[A-Za-z]+\s([^{}]+)\}", "$1")
    return F.regexp_replace(text, r"\\[A-Za-z]+\{([^{}]+)\}", "$1")
