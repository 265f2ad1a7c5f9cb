"""Screens of learned text and readings of a solver's answer."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from turnlake.functions.text import any_of, arrow_shape, slug
from turnlake.operators.learning import SECRETS

#: Rules of the screen, in order; the first that a text trips is its reason.
RULES = (
    ("override-instructions", r"(?i)\b(?:ignore|disregard|forget|override|replace)\b[^.]{0,40}?\b(?:instructions?|directions?|rules?)\b"),
    ("new-instructions", r"(?i)\bnew\s+(?:instructions?|rules?|system\s+prompt)\b"),
    ("system-prompt", r"(?i)\bsystem[\s_-]+prompt\b"),
    ("you-are-now", r"(?i)\byou[\s_-]+are[\s_-]+now\b"),
    ("authority-framing", r"(?i)\b(?:standing|permanent|binding)[\s_-]+(?:rule|instruction|order)\b|\balways\s+(?:do|run|call|use|execute|check)\b[^.]{0,40}\bbefore\b|\bfrom\s+now\s+on\b"),
    ("user-authority", r"(?i)\bthe\s+user\s+(?:wants|requires|insists|demands|expects)\b"),
    ("shell-command", r"(?i)\brun\b|\bexecutes?\b|\bexec\b"),
    ("shell-command", r"(?i)\bcurl\b|\bwget\b|\bbash\b|\bsh\s+-c\b|powershell|\bcmd\.exe\b"),
    ("shell-command", r"\brm\s+-rf\b|\bBash\(|\bWrite\(|\bEdit\(|`"),
    ("file-write", r"(?i)\b(?:write|writes|save|saves|create|creates|append|overwrite)\s+(?:to|into|it|a\s+file|the\s+file)\b"),
    ("file-write", r"(?i)\bcreate\s+file\b"),
    ("file-write", r"(?i)(?:\/[A-Za-z0-9_.-]+){2,}[^.]{0,60}?\b(?:write|save|create|append|overwrite|delete|remove)\b"),
    ("url", r"(?i)https?:\/\/|\bwww\.|\bhxxps?|\b\w+\s+dot\s+(?:com|net|org|io|dev|ai|co)\b"),
    ("email", r"[\w.+-]+@[\w-]+\.[A-Za-z]{2,}"),
    ("base64-blob", r"[A-Za-z0-9+/]{40,}={0,2}"),
    ("credential-request", r"(?i)\b(?:ask|asks|request|requests|send|sends|paste|pastes|provide|provides|enter|type)\b[^.]{0,40}?\b(?:token|password|passphrase|api[- ]?key|credentials?|secret)\b"),
    ("credential-request", r"(?i)\b(?:token|password|passphrase|api[- ]?key|credentials?)\b[^.]{0,40}?\b(?:ask|send|paste|provide|enter)\b"),
    ("tool-invocation", r"(?i)\b(?:call|calls|invoke|invokes|use|uses)\s+the\s+(?:\S+\s+){1,4}?tool\b"),
    ("foreign-mcp-name", r"(?i)\bmcp__\s+\S+"),
)
#: The forms of an instruction's lines, before their marks.
TEMPLATES = (
    r"^project\s+[A-Za-z0-9._-]+:\s*\S",
    r"^mode\s+(?:vector|text|both)\s+for\s+\S",
    r"^terms\s+for\s+.+:\s*\S",
    r"^period\s+\d{4}-\d{2}\.\.\d{4}-\d{2}:\s*\S",
    r"^absent:\s*\S",
)
#: Characters that hide others, and the marks at the end of a line.
HIDDEN = r"[\u200b-\u200f\u2060\ufeff\u180e\u202a-\u202e\u2066-\u2069\u061c]"
CONTROL = r"[\u0000-\u0008\u000b-\u001f\u007f-\u009f]"
TRAILING_MARKS = r"\[(?:#|@)[^\]]*\]\s*$"


@F.pandas_udf(StringType())
def compatible(text: pd.Series) -> pd.Series:
    """The compatibility form (NFKC), for which Spark has no function; null stays null."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def _plain(text: pa.Array) -> pa.Array:
    """The compatibility form without hidden and control characters, lines ended by line feeds."""
    out = pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in text.to_pylist()], pa.string())
    for shape, put in ((HIDDEN, ""), (r"\r\n?", "\n"), (CONTROL, "")):
        out = pc.replace_substring_regex(out, arrow_shape(shape), put)
    return out


def _tripped(text: pa.Array, shape: str) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(text, shape), False).to_numpy(zero_copy_only=False)


def _reasons(plain: pa.Array, allowed: tuple[str, ...], own_prefix: str) -> pa.Array:
    """The first rule that each plain text trips, else whether it holds a secret's shape.

    The matcher takes a text in one pass a rule, whatever the rule, and texts without any rule's shape in one pass for all.
    It folds the case of more letters than ASCII's, but none of those is left in a compatibility form.
    """
    ruled = plain
    for phrase in allowed:
        ruled = pc.replace_substring_regex(ruled, "".join(f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() else re.escape(c) for c in phrase), " ")
    # a name that is not one's own takes a look ahead, which the matcher lacks: it finds the names, and few are looked at
    rules = [*RULES, ("foreign-mcp-name", r"(?i)\bmcp__[a-z0-9_-]")]
    foreign = re.compile(rf"(?i)\bmcp__(?!{own_prefix})[a-z0-9_-]+", re.ASCII)
    out = np.full(len(plain), None, object)
    left = np.flatnonzero(_tripped(ruled, any_of(arrow_shape(shape) for _, shape in rules)))
    some = ruled.take(pa.array(left))
    for k, (name, shape) in enumerate(rules):
        hit = _tripped(some, arrow_shape(shape))
        if k == len(RULES):
            hit[hit] = [bool(foreign.search(t)) for t in some.filter(pa.array(hit)).to_pylist()]
        if hit.any():
            out[left[hit]] = name
            left, some = left[~hit], some.filter(pa.array(~hit))
    secret = _tripped(plain, any_of(arrow_shape(s) for s in SECRETS))
    out[secret & (out == None)] = "secret-like-text"  # noqa: E711
    return pa.array(out, pa.string())


@lru_cache
def _screen(allowed: tuple[str, ...], own_prefix: str, formed: bool):
    """The screen as a function of whole batches: the reason, with `formed` behind the plain text."""
    def told(text: pa.Array) -> pa.Array:
        return _reasons(_plain(text), allowed, own_prefix)

    def with_plain(text: pa.Array) -> pa.Array:
        plain = _plain(text)
        return pa.StructArray.from_arrays([plain, _reasons(plain, allowed, own_prefix)], ["plain", "reason"])

    return F.arrow_udf(with_plain, "plain string, reason string") if formed else F.arrow_udf(told, "string")


def reflection_slug(text: Column) -> Column:
    """The compatibility form in lower case, other characters as dashes, at most 48."""
    return slug(compatible(text))


def screen_text(text: Column, instruction_body: bool = False, allowed: tuple[str, ...] = ("skills tool", "digest tool", "search tool", "read tool"), own_prefix: str = "own-") -> Column:
    """The reason why a text must not be learned, null for good, blank and null ones.

    `allowed` phrases are taken out before the rules; tools named `mcp__` and `own_prefix` are one's own.
    With `instruction_body` every line must have the form of an instruction and end in marks.
    """
    told = _screen(tuple(allowed), own_prefix, instruction_body)(text)
    if not instruction_body:
        return told
    lines = F.filter(F.transform(F.split(told["plain"], "\n"), lambda l: F.regexp_replace(l, r"^\s+|\s+$", "")), lambda l: l != "")

    def formed(line: Column) -> Column:
        body, out = F.regexp_replace(F.regexp_replace(line, TRAILING_MARKS, ""), r"\s+$", ""), F.lit(False)
        for t in TEMPLATES:
            out = out | body.rlike(t)
        return line.rlike(TRAILING_MARKS) & out

    return F.coalesce(told["reason"], F.when(~F.forall(lines, formed), "instruction-template"))


#: What may stand before and behind a label.
LABELLED = r"(?im)^[\s>*+\-|]*(?:\d{1,3}[.)]\s+)?(?:\*\*|__)?(?:NAMES)(?:\*\*|__)?\s*[:=]\s*(.*)$"


def _labelled(text: Column, names: str) -> Column:
    shape = LABELLED.replace("NAMES", names)
    clean = lambda v: F.regexp_replace(F.regexp_replace(v, r"^[*_`\s]+|[*_`\s]+$", ""), r"""^[`"']+|[`"']+$""", "")
    return F.transform(F.regexp_extract_all(text, F.lit(shape), 1), lambda v: F.regexp_replace(clean(v), r"^\s+|\s+$", ""))


def parse_answer(text: Column) -> Column:
    """Locations (path, line_start, line_end), project, day and outcome of an answer's labelled lines; the i-th range goes with the i-th path."""
    ranges = _labelled(text, "lines")

    def location(path: Column, i: Column) -> Column:
        found = F.regexp_extract_all(F.get(ranges, i), F.lit(r"(\d+)"), 1)
        first, second = (F.get(found, F.lit(k)).try_cast("long") for k in (0, 1))
        return F.struct(path.alias("path"), first.alias("line_start"), F.coalesce(second, first).alias("line_end"))

    value = lambda name: F.nullif(F.get(_labelled(text, name), F.lit(0)), F.lit(""))
    date = value("date")
    iso = F.nullif(F.regexp_extract(date, r"\d{4}-\d{2}-\d{2}", 0), F.lit(""))
    return F.struct(F.transform(_labelled(text, "path|file"), location).alias("locations"), value("project").alias("project"),
                    F.coalesce(iso, date).alias("day"), value("outcome").alias("outcome"))


def _folded(path: Column) -> Column:
    """The segments of a path without empty ones and `.`, and with `..` undone."""
    def step(done: Column, s: Column) -> Column:
        return F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.filter(F.split(path, "/"), lambda s: ~s.isin("", ".")), F.array().cast("array<string>"), step)


def same_path(a: Column, b: Column, cwd: str = "/") -> Column:
    """X11: whether two paths name one file: those with a drive or a share without regard to case and separators, others as seen from `cwd`."""
    shaped = lambda p: p.rlike(r"^[A-Za-z]:[\\/]|^\\\\")
    windows = lambda p: _folded(F.lower(F.translate(p, "\\", "/")))
    posix = lambda p: _folded(F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(f"{cwd}/"), p)))
    there = F.coalesce((a != "") & (b != ""), F.lit(False))
    return there & F.when(shaped(a) | shaped(b), windows(a) == windows(b)).otherwise(posix(a) == posix(b))
