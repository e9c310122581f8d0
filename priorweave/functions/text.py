"""Text expressions. Word characters are Unicode letters, digits and _, written out because the engine's \\w is ASCII."""

from __future__ import annotations

import html
import html.entities
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD = r"[\p{L}\p{N}_]+"


def norm(t: Column) -> Column:
    """Lower case, without punctuation, single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def key_of(utterance: Column, acts: Column) -> Column:
    """Memory key: normalised utterance and the acts before it."""
    return F.concat_ws("##", norm(utterance), F.array_join(acts, "|"))


def first_words(t: Column, k: int) -> Column:
    """The first k white-space separated words."""
    return F.array_join(F.slice(F.split(F.trim(F.regexp_replace(t, r"\s+", " ")), " "), 1, k), " ")


def strip_tags(t: Column) -> Column:
    return F.regexp_replace(t, r"<[^>]*>", " ")


@F.pandas_udf(StringType())
def _unescaped(t: pd.Series) -> pd.Series:
    return t.map(lambda x: x if x is None else html.unescape(x))


_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


@F.pandas_udf(StringType())
def _unescaped_closed(t: pd.Series) -> pd.Series:
    one = lambda m: html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html.entities.html5 else m[0]
    return t.map(lambda x: x if x is None else _CLOSED.sub(one, x))


def unescape(t: Column, closed: bool = False) -> Column:
    """Character references decoded as HTML5 defines them, all names and numbers, in Arrow batches: no built-in knows them. HTML5 also
    decodes old names that no ; ends (&amp as &amp;); closed leaves these as they are."""
    return _unescaped_closed(t) if closed else _unescaped(t)


def short(t: Column) -> Column:
    """A code block in brief: no tags, no ` and ~, 30 words, a space at either end."""
    return F.concat(F.lit(" "), first_words(F.regexp_replace(strip_tags(t), "[`~]", " "), 30), F.lit(" "))


def clean_html(title: Column, body: Column, k: int = 200, closed: bool = False) -> Column:
    """Title and body without scripts, styles and tags; code blocks are shortened; k words, lower case."""
    pre = F.regexp_replace(body, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    parts = F.split(pre, r"(?i)</?pre[^>]*>")
    pre = F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, short(x)).otherwise(x)), "")
    text = unescape(strip_tags(pre), closed)
    return first_words(F.lower(F.concat_ws(" . ", unescape(title, closed), text)), k)


def clean_markdown(body: Column, k: int = 200) -> Column:
    """Markdown as plain text: fences and indented code are shortened to 30 words, images keep their
    alternative text, links keep their text, references and
    tags go, and so do the marks of emphasis, headings and quotes. The case stays."""
    t = F.regexp_replace(body, r"\r\n?", "\n")
    parts = F.split(t, r"(?m)^(?:```|~~~).*$")
    t = F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, short(x)).otherwise(x)), "\n")
    parts = F.split(t, r"(?i)</?pre[^>]*>")
    t = F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, short(x)).otherwise(x)), "\n")
    # a run of lines indented by four spaces or a tab becomes one marked run, which is then shortened
    t = F.regexp_replace(t, r"(?m)((?:^(?:    |\t).*(?:\n|\z))+)", "\u0001$1\u0001")
    parts = F.split(t, "\u0001")
    t = F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, short(x)).otherwise(x)), "\n")
    t = F.regexp_replace(t, r"!\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"\[([^\]]*)\]\[[^\]]*\]", "$1")
    t = F.regexp_replace(t, r"(?m)^\s*\[[^\]]+\]:.*$", " ")
    t = F.regexp_replace(strip_tags(t), r"[`*#>]", " ")
    return first_words(unescape(t), k)


def final_text(title: Column, body: Column, k: int = 200) -> Column:
    """Title and body, which is clean already, in lower case; either may be null."""
    return first_words(F.lower(F.concat(F.coalesce(unescape(title), F.lit("")), F.lit(" . "), F.coalesce(body, F.lit("")))), k)


def html_text(body: Column, k: int) -> Column:
    """The first k words of a body without its tags, in their case."""
    return first_words(unescape(strip_tags(F.coalesce(body, F.lit("")))), k)


def tokens(t: Column) -> Column:
    """Words and single marks, in order."""
    return F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), 0)


def words(t: Column) -> Column:
    return F.regexp_extract_all(F.lower(t), F.lit(WORD), 0)


def token_offsets(t: Column) -> Column:
    """(token, start, end) of each token: starts follow from the length of what was read before."""
    pieces = F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]|\s+"), 0)
    zero = F.struct(F.array().cast("array<struct<token:string,start:int,end:int>>").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, p: F.struct(
        F.when(F.trim(F.regexp_replace(p, r"\s", "")) == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(p.alias("token"), acc["at"].alias("start"), (acc["at"] + F.length(p)).alias("end"))))).alias("out"),
        (acc["at"] + F.length(p)).alias("at"),
    )
    return F.aggregate(pieces, zero, step, lambda acc: acc["out"])


def shape(t: Column) -> Column:
    """Capitals X, small letters x, digits d, runs squeezed."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\p{Nd}", "\u0001"), "[a-z]", "x"), "[A-Z]", "X")
    return F.regexp_replace(F.regexp_replace(t, "\u0001", "d"), r"(.)\1+", "$1")


def yes_no(t: Column) -> Column:
    """True or False by the first YES or NO in a reply; null if there is none."""
    found = F.regexp_extract(F.upper(t), r"\b(YES|NO)\b", 1)
    return F.when(found == "YES", F.lit(True)).when(found == "NO", F.lit(False))


def fingerprint(*parts: Column, length: int = 64) -> Column:
    """SHA-256 of the parts, each ended by a NUL."""
    return F.substring(F.sha2(F.concat(*(x for p in parts for x in (p, F.lit("\0")))), 256), 1, length)
