"""What a reader page shows of texts: inline markup, coloured source lines, decision sketches and first sentences."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions import text as X

_SPAN = re.compile(r"`(?P<code>[^`\n]+)`|\*\*(?P<strong>[^*\n]+)\*\*")
# Words that are coloured, and the longest label and branch of a sketch and first sentence.
KEYWORDS = "async await def class return from import as if elif else for in not and or is None True False with raise try except finally pass lambda yield while break continue assert"
MOST_LABEL, MOST_BRANCH, MOST_SENTENCE = 36, 120, 150

_TOKEN = re.compile(
    r"(?P<string>\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|(?P<comment>\#[^\n]*)|\b(?P<keyword>" + "|".join(KEYWORDS.split()) + r")\b|\b(?P<number>\d+(?:\.\d+)?)\b",
)


def _escape(text: str) -> str:
    return html.escape(text, quote=True)


def inline_html(text: str, terms: re.Pattern[str] | None = None) -> str:
    """Text as HTML in which code spans, emphasis and the given terms are marked; all else is escaped, so no markup of its own comes through."""

    def plain(part: str) -> str:
        if terms is None:
            return _escape(part)
        at, out = 0, []
        for m in terms.finditer(part):
            out += [_escape(part[at : m.start()]), f"<code>{_escape(m[0])}</code>"]
            at = m.end()
        return "".join([*out, _escape(part[at:])])

    at, out = 0, []
    for m in _SPAN.finditer(text):
        out.append(plain(text[at : m.start()]))
        out.append(f"<code>{_escape(m['code'])}</code>" if m["code"] is not None else f"<strong>{inline_html(m['strong'], terms)}</strong>")
        at = m.end()
    return "".join([*out, plain(text[at:])])


def highlighted(line: str) -> str:
    """A source line as HTML whose strings, comments, keywords and numbers have their class; colours aid reading and classify nothing."""
    at, out = 0, []
    for m in _TOKEN.finditer(line):
        out += [_escape(line[at : m.start()]), f'<span class="token-{m.lastgroup}">{_escape(m[0])}</span>']
        at = m.end()
    return "".join([*out, _escape(line[at:])])


def inline(text: Column, pattern: str | None = None) -> Column:
    """``inline_html`` of a column; ``pattern`` is that of ``code_terms``, whose terms stand alone. Null counts as empty."""
    terms = re.compile(rf"(?<!\w)(?:{pattern})(?!\w)") if pattern else None

    def each(texts: pd.Series) -> pd.Series:
        return pd.Series([inline_html(t or "", terms) for t in texts], dtype="object")

    return F.pandas_udf(each, "string")(text)


def highlight(line: Column) -> Column:
    """``highlighted`` of a column; null counts as empty."""

    def each(lines: pd.Series) -> pd.Series:
        return pd.Series([highlighted(t or "") for t in lines], dtype="object")

    return F.pandas_udf(each, "string")(line)


def flowchart(sketch: Column) -> Column:
    """struct<label, paths> of a sketch that is a decision: a label and exactly two branches ``condition → outcome``; null for any other."""
    lines = F.split(F.trim(F.regexp_replace(sketch, r"^\s+|\s+$", "")), "\n")
    label = F.trim(F.get(lines, F.lit(0)))

    def branch(place: int, mark: str) -> Column:
        rule = rf"^\s*{mark}─\s+([^→]+)→(.+)$"
        line = F.get(lines, F.lit(place))
        return F.struct(*[F.trim(F.regexp_extract(line, rule, k)).alias(name) for k, name in ((1, "condition"), (2, "outcome"))])

    paths = F.array(branch(1, "├"), branch(2, "└"))
    good = F.forall(paths, lambda p: F.length(p["condition"]).between(1, MOST_BRANCH) & F.length(p["outcome"]).between(1, MOST_BRANCH))
    return F.when((F.size(lines) == 3) & F.length(label).between(1, MOST_LABEL) & good, F.struct(label.alias("label"), paths.alias("paths")))


def first_sentence(text: Column, most: int = MOST_SENTENCE) -> Column:
    """The first sentence of a text, cut with an ellipsis where it has more than ``most`` characters; null without one."""
    first = F.get(X.sentences(text), F.lit(0))
    return F.when(F.length(first) > most, F.concat(F.rtrim(F.substring(first, 1, most - 3)), F.lit("…"))).otherwise(first)
