"""Scalar functions as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shapes of personal data with their tags, in the order in which they are replaced.
PII = (
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "<EMAIL>"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "<SSN>"),
    (r"\b(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2,4})\b", "<CC>"),
    (r"(?:\+?1[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}", "<PHONE>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<IP>"),
)
#: The shapes of the form without tags.
PII_UNTYPED = (
    r"[\w.+-]+@[\w-]+\.[A-Za-z]{2,}",
    r"\b\d{3}-\d{2}-\d{4}\b",
    r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b",
    r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b",
    r"\b\d{10,19}\b",
)


def snippet(text: Column) -> Column:
    """the first 200 characters on one line, with dots when there is more."""
    head = F.regexp_replace(F.substring(text, 1, 200), r"\s+", " ")
    return F.concat(F.regexp_replace(head, r"^ +| +$", ""), F.when(F.char_length(text) > 200, "...").otherwise(""))


def l2_to_cosine(distance: Column) -> Column:
    """similarity of unit vectors at a distance."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - distance * distance / 2))


def rounded(x: Column, places: int) -> Column:
    """A double rounded to `places`, halves away from zero, as SQL engines that scale, round and scale back do; no decimal is made of it."""
    scaled = x * 10.0 ** places
    size = F.abs(scaled)
    up = F.floor(size) + (size - F.floor(size) >= 0.5).cast("int")
    return F.when(scaled < 0, -up).otherwise(up) / 10.0 ** places


def valid_iso_date(col: Column) -> Column:
    """YYYY-MM-DD and a real day."""
    return col.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(col, F.lit("yyyy-MM-dd")).isNotNull()


def project_key(cwd: Column) -> Column:
    """every character that is no ASCII letter or digit becomes a dash."""
    return F.regexp_replace(cwd, "[^A-Za-z0-9]", "-")


def session_id_from_path(path: Column) -> Column:
    """The last UUID of the file name, else the name without `.jsonl`."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    found = F.regexp_extract_all(name, F.lit("(?i)([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"), 1)
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.regexp_replace(name, r"\.jsonl$", ""))


def ascii_borders(pattern: str) -> str:
    r"""A pattern whose `\b` is the border of an ASCII word, as Java's own also knows letters beyond ASCII."""
    return pattern.replace(r"\b", "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")


def core(pattern: str) -> str:
    r"""A pattern without its `\b`: it finds whatever the pattern does, and more, and is far cheaper where there is nothing."""
    return pattern.replace(r"\b", "")


def arrow_shape(pattern: str) -> str:
    r"""A pattern of Java's as Arrow's matcher reads it: its `\b` is the border of an ASCII word, and its `\s` has the vertical tab."""
    pieces, inside = [], False
    for piece in re.findall(r"\\u[0-9a-f]{4}|\\.|.", pattern, re.DOTALL):
        if piece in ("[", "]"):
            inside = piece == "["
        space = r"\s\x0b" if inside else r"[\s\x0b]"
        pieces.append(space if piece == r"\s" else rf"\x{{{piece[2:]}}}" if piece.startswith(r"\u") else piece)
    return "".join(pieces)


def any_of(shapes: Iterable[str]) -> str:
    return "|".join(f"(?:{s})" for s in shapes)


@lru_cache
def _core_finder(shapes: tuple[str, ...]):
    def run(text: pa.Array) -> pa.Array:
        return pc.match_substring_regex(text, any_of(arrow_shape(core(s)) for s in shapes))

    # so that no filter is put before it, for which it would run once more
    return F.arrow_udf(run, "boolean").asNondeterministic()


def holds_core(text: Column, shapes: Iterable[str]) -> Column:
    """Whether a text has the core of some shape; Arrow's matcher looks for all of them in one pass. Not for lambdas."""
    return _core_finder(tuple(shapes))(text)


def replaced(text: Column, shapes: Iterable[tuple[str, str]]) -> Column:
    """The text with what each (shape, tag) matches as the tag, in order; texts without a shape's core are only searched once for it."""
    def take(shape: str, tag: str):
        return lambda t: F.when(t.rlike(core(shape)), F.regexp_replace(t, ascii_borders(shape), tag)).otherwise(t)

    one = F.array(text)
    for shape, tag in shapes:
        # an array's element is made once, however often its name stands there
        one = F.transform(one, take(shape, tag))
    return F.get(one, F.lit(0))


def redact_pii(text: Column) -> Column:
    """E-mail addresses, social security numbers, cards, phones and IPv4 addresses by their tags."""
    return replaced(text, PII)


def redact_pii_untyped(text: Column) -> Column:
    """X2, second form: the shapes of PII_UNTYPED become [redacted]."""
    return replaced(text, [(shape, "[redacted]") for shape in PII_UNTYPED])


#: Words of four characters or more that say nothing of a text's matter.
STOP_WORDS = (
    "about after again against also because been before being between both could does doing during each from further have having here into itself just more most much must only other over same "
    "should some such than that their them then there these they this those through under until very were what when where which while will with would your").split()


def content_tokens(text: Column, stop_words: Iterable[str] = ()) -> Column:
    """The set of lower-case ASCII words of four characters or more, without stop words (STOP_WORDS, or one's own)."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]{4,})"), 1))
    return F.array_except(found, F.array(*map(F.lit, stop_words))) if stop_words else found


def slug(text: Column) -> Column:
    """Lower case, other characters as dashes, at most 48 (ASCII input; NFKC is the caller's)."""
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, 48)


#: Names that are no folders on some systems.
RESERVED = ("con", "prn", "aux", "nul", *(f"{device}{i}" for device in ("com", "lpt") for i in range(1, 10)))


def is_valid_slug(slug: Column) -> Column:
    """Whether a slug is a folder's name everywhere: 1 to 64 lower-case letters, digits and dashes, no dash first, no reserved name."""
    return slug.rlike(r"^[a-z0-9][a-z0-9-]{0,63}\z") & ~slug.isin(*RESERVED)


def extract_summary(text: Column) -> Column:
    """What the first summary tags hold, else the whole text, trimmed."""
    found = F.regexp_extract(text, r"(?s)<summary>(.*?)</summary>", 1)
    return F.regexp_replace(F.when(found != "", found).otherwise(text), r"^\s+|\s+$", "")


def day_of(time: Column) -> Column:
    """The UTC day of a time with a zone (sessions run in UTC), `YYYY-MM-DD`; of what is no time, its first ten characters."""
    return F.coalesce(F.date_format(F.try_to_timestamp(time), "yyyy-MM-dd"), F.substring(time, 1, 10))


def week_start(day: Column) -> Column:
    """The Monday of a day's week."""
    return F.to_date(F.date_trunc("WEEK", day))


def start_of(time: Column) -> Column:
    """First day of `YYYY`, `YYYY-MM` or a day."""
    return F.when(F.char_length(time) == 4, F.concat(time, F.lit("-01-01"))).when(F.char_length(time) == 7, F.concat(time, F.lit("-01"))).otherwise(time)


def end_of(time: Column) -> Column:
    """Last day; a month ends with the literal -31, for string comparison."""
    return F.when(F.char_length(time) == 4, F.concat(time, F.lit("-12-31"))).when(F.char_length(time) == 7, F.concat(time, F.lit("-31"))).otherwise(time)


def is_valid_time(time: Column) -> Column:
    """Whether a text is a year, a month or a day that the calendar has."""
    day = F.when(F.char_length(time) == 10, time).when(F.char_length(time) == 7, F.concat(time, F.lit("-01"))).otherwise(F.concat(time, F.lit("-01-01")))
    # the calendar of try_to_timestamp has no year 0, which has leap days like the year 4
    known = F.concat(F.regexp_replace(F.substring(day, 1, 4), "^0000$", "0004"), F.substring(day, 5, 6))
    return time.rlike(r"^\d{4}(-\d{2}(-\d{2})?)?\z") & F.try_to_timestamp(known, F.lit("yyyy-MM-dd")).isNotNull()


def overlaps(time: Column, first: Column, last: Column) -> Column:
    """Whether a time meets a range of times; an end that is null is open."""
    return (first.isNull() | (end_of(time) >= start_of(first))) & (last.isNull() | (start_of(time) <= end_of(last)))


def cited_ids(line: Column) -> Column:
    """Ids of every bracket group: its comma-separated parts that begin with #."""
    groups = F.regexp_extract_all(line, F.lit(r"\[([^\[\]]*)\]"), 1)
    parts = F.flatten(F.transform(groups, lambda g: F.split(g, ",")))
    trimmed = F.transform(parts, lambda p: F.trim(p))
    return F.transform(F.filter(trimmed, lambda p: p.startswith("#")), lambda p: F.substring(p, 2, 1_000_000))


def hide_cited_lines(text: Column, ids: Column) -> Column:
    """The text without the lines that cite one of `ids`."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda l: ~F.arrays_overlap(cited_ids(l), ids)), "\n")
