"""Words of a text index: letters without diacritics, and English stems."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

V, C = "[aeiouy]", "[^aeiouy]"
#: What the rules of the Porter stemmer ask of the part before a suffix. A consonant y is written Y.
SOME, MORE, ONE = f"^{C}*{V}+{C}", f"^{C}*{V}+{C}+{V}+{C}", f"^{C}*{V}+{C}+{V}*$"
VOWEL, SHORT = V, f"{C}{V}[^aeiouywxY]$"
#: The steps of the Porter stemmer as (suffix, replacement, condition). The first suffix of a step that fits
#: decides; | marks words that lost -ed or -ing for the steps behind.
DOUBLED = "bcdfghjkmnpqrtvwx"
STEPS = (
    (("sses", "ss", ()), ("ies", "i", ()), ("ss", "ss", ()), ("s", "", ())),
    (("eed", "ee", SOME), ("ed", "|", VOWEL), ("ing", "|", VOWEL)),
    (("at|", "ate", ()), ("bl|", "ble", ()), ("iz|", "ize", ()), *((f"{c}{c}|", c, ()) for c in DOUBLED), ("|", "e", ("and", ONE, SHORT))),
    (("|", "", ()),),
    (("y", "i", VOWEL), ("Y", "i", VOWEL)),
    (("ational", "ate", SOME), ("tional", "tion", SOME), ("enci", "ence", SOME), ("anci", "ance", SOME), ("izer", "ize", SOME), ("logi", "log", SOME), ("bli", "ble", SOME),
     ("alli", "al", SOME), ("entli", "ent", SOME), ("eli", "e", SOME), ("ousli", "ous", SOME), ("ization", "ize", SOME), ("ation", "ate", SOME), ("ator", "ate", SOME), ("alism", "al", SOME),
     ("iveness", "ive", SOME), ("fulness", "ful", SOME), ("ousness", "ous", SOME), ("aliti", "al", SOME), ("iviti", "ive", SOME), ("biliti", "ble", SOME)),
    (("icate", "ic", SOME), ("ative", "", SOME), ("alize", "al", SOME), ("iciti", "ic", SOME), ("ical", "ic", SOME), ("ful", "", SOME), ("ness", "", SOME)),
    (("al", "", MORE), ("ance", "", MORE), ("ence", "", MORE), ("er", "", MORE), ("ic", "", MORE), ("able", "", MORE), ("ible", "", MORE), ("ant", "", MORE), ("ement", "", MORE),
     ("ment", "", MORE), ("ent", "", MORE), ("ion", "", ("and", MORE, "[st]$")), ("ou", "", MORE), ("ism", "", MORE), ("ate", "", MORE), ("iti", "", MORE), ("ous", "", MORE), ("ive", "", MORE), ("ize", "", MORE)),
    (("e", "", ("or", MORE, ("and", ONE, ("not", SHORT)))),),
    (("ll", "l", f"^{C}*{V}+{C}+{V}"),),
)
SHORTEST, LONGEST = 3, 64
#: Words of at most LONGEST letters whose stems a worker remembers.
REMEMBERED = 1 << 16
#: Letters of text whose terms are held at once.
TOGETHER = 1 << 20
WORD = regex.compile(r"[\p{L}\p{N}\p{Mn}]+")


def _marks() -> tuple[str, str]:
    """Letters that are a letter and one diacritic, and those letters."""
    found = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x2000)]
    pairs = [(c, d[0]) for c, d in found if len(d) == 2 and unicodedata.combining(d[1]) and d[0].isalpha()]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


MARKED, PLAIN = _marks()


TABLE = str.maketrans(MARKED, PLAIN)


def fold(word: str) -> str:
    """A word without diacritics: letters with one mark become plain ones, and marks of their own go."""
    if word.isascii():
        return word
    return "".join(c for c in word.translate(TABLE) if unicodedata.category(c) != "Mn")


def _compiled(rule):
    """A condition as a function of the part before the suffix."""
    if isinstance(rule, str):
        return re.compile(rule).search
    if rule[0] == "not":
        one = _compiled(rule[1])
        return lambda part: not one(part)
    left, right = _compiled(rule[1]), _compiled(rule[2])
    return (lambda part: left(part) and right(part)) if rule[0] == "and" else (lambda part: left(part) or right(part))


@lru_cache(1)
def _compiled_steps():
    return [[(suffix, put, _compiled(rule) if rule else None) for suffix, put, rule in rules] for rules in STEPS]


@lru_cache(REMEMBERED)
def stem(word: str) -> str:
    """The stem of a lower-case word without its diacritics; words under SHORTEST or over LONGEST letters are only folded."""
    word = fold(word)
    if not SHORTEST <= len(word) <= LONGEST:
        return word
    word = re.sub("([aeiouy])y", r"\1Y", re.sub("^y", "Y", word))
    for rules in _compiled_steps():
        for suffix, put, holds in rules:
            if word.endswith(suffix):
                part = word[: len(word) - len(suffix)]
                if holds is None or holds(part):
                    word = part + put
                break
    return word.lower()


def terms(text: str | None) -> list[str]:
    """The terms of a text in order: runs of letters and digits in lower case, without diacritics, as stems."""
    return [s for w in WORD.findall(text.lower()) if (s := stem(w))] if text else []


def with_terms(df: DataFrame, text: str) -> DataFrame:
    """df with the terms of its column `text` in that one's place, in an array `terms`."""
    others = [f for f in df.schema.fields if f.name != text]
    schema = StructType([*others, StructField("terms", ArrayType(StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column(len(others)), 0
            while at < batch.num_rows:
                found, size, to = [], 0, at
                # some texts at a time, or one that is longer
                while to < batch.num_rows and (size < TOGETHER or to == at):
                    t = texts[to].as_py()
                    found.append(terms(t))
                    size += len(t or "")
                    to += 1
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, to - at) for i in range(len(others))), pa.array(found, pa.list_(pa.string()))], names=[f.name for f in schema.fields])
                at = to

    return df.select(*[f.name for f in others], text).mapInArrow(run, schema)


def stems_sql(words: str) -> str:
    """stem() of each word of a list of folded ones, in DuckDB's SQL."""
    def holds(rule, stem: str) -> str:
        if isinstance(rule, str):
            return f"regexp_matches({stem}, '{rule}')"
        if rule[0] == "not":
            return f"NOT {holds(rule[1], stem)}"
        return f"({holds(rule[1], stem)} {rule[0].upper()} {holds(rule[2], stem)})"

    out = f"list_transform({words}, lambda w: CASE WHEN length(w) BETWEEN {SHORTEST} AND {LONGEST} THEN regexp_replace(regexp_replace(w, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') ELSE '=' || w END)"
    for rules in STEPS:
        cases = " ".join(f"WHEN suffix(w, '{s}') THEN " + (f"CASE WHEN {holds(rule, f'left(w, length(w) - {len(s)})')} THEN left(w, length(w) - {len(s)}) || '{put}' ELSE w END" if rule
                                                           else f"left(w, length(w) - {len(s)}) || '{put}'") for s, put, rule in rules)
        out = f"list_transform({out}, lambda w: CASE WHEN w[1] = '=' THEN w {cases} ELSE w END)"
    return f"list_transform({out}, lambda w: CASE WHEN w[1] = '=' THEN w[2:] ELSE lower(w) END)"
