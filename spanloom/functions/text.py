"""Column expressions over exact text: lines, identifiers, digests, paths and links.

Lines end with LF or CRLF only; every other character, a bare CR included, stays inside its line. Empty text has no
line, and a final line end adds none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest source, in bytes, that is parsed or taken in.
MAX_SOURCE_BYTES = 8_000_000


def lines(text: Column) -> Column:
    """The lines of a text without their ends."""
    parts = F.split(text, r"\r\n|\n", -1)
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(kept)


def lines_with_ends(text: Column) -> Column:
    """The lines of a text with their ends; joined they give the text."""
    return F.regexp_extract_all(text, F.lit(r"(?s)[^\n]*\n|[^\n]+"), F.lit(0))


def line_count(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.regexp_count(text, F.lit("\n")) + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1))


def stable_id(*parts: Column) -> Column:
    """16 hex digits of the SHA-256 of the parts joined by NUL; a missing part reads None."""
    return F.substring(F.sha2(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]), 256), 1, 16)


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def module_name(path: Column) -> Column:
    """The dotted module of a Python path."""
    return F.regexp_replace(F.replace(F.regexp_replace(path, r"\.py$", ""), F.lit("/"), F.lit(".")), r"\.__init__$", "")


def is_test_path(path: Column) -> Column:
    """Whether a path lies in a test folder or is named as a test."""
    return path.rlike(r"(^|/)(test|tests|__tests__)/|(^|/)conftest\.py$|(^|/)test_[^/]*$|(^|/)[^/]*(_test|_spec|\.test|\.spec)(\.[^./]*)?$")


def is_safe_path(path: Column) -> Column:
    """Whether a path is relative and stays below its root."""
    bad = path.isNull() | (path == "") | path.contains("\0") | path.rlike(r"^[/\\]|^[A-Za-z]:|(^|[/\\])\.{1,2}([/\\]|$)")
    return ~bad


def quoted_path(path: Column) -> Column:
    """A path percent-encoded, its slashes kept."""
    out = F.url_encode(path)
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def permalink(repository: Column, revision: Column, path: Column, start: Column, end: Column, host: str = "https://github.com") -> Column:
    """A link to lines of a file at a revision, or null unless both are well formed."""
    good = repository.rlike(r"(?U)^[\w.-]+/[\w.-]+$") & revision.rlike("^[0-9a-f]{7,64}$")
    link = F.concat(F.lit(host + "/"), repository, F.lit("/blob/"), revision, F.lit("/"), quoted_path(path), F.lit("#L"), start.cast("string"), F.lit("-L"), end.cast("string"))
    return F.when(good, link)


def sentences(text: Column) -> Column:
    """Sentences: runs up to . ! or ? before a space or the end, white space being one space."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.regexp_extract_all(flat, F.lit(r"(?s) *(.*?[.!?]+(?= |$)|.+$)"), F.lit(1)))


def fenced_blocks(text: Column) -> Column:
    """The complete fenced text blocks of a text, fences included."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^```[^\n]*\n(?:(?!```)[^\n]*\n)*```[ \t]*$"), F.lit(0))


def prose_length(text: Column) -> Column:
    """Characters outside complete fenced blocks."""
    return F.length(text) - F.aggregate(fenced_blocks(text), F.lit(0), lambda a, x: a + F.length(x))


def pull_reference(text: Column) -> Column:
    """(repository, number) of ``owner/name#n`` or of a pull request's address, else nulls."""
    rule = r"^(?:https?://[^/\s]+/)?([\w.-]+/[\w.-]+)(?:#|/pull/)([0-9]+)/?$"
    repository = F.nullif(F.regexp_extract(text, rule, 1), F.lit(""))
    number = F.nullif(F.regexp_extract(text, rule, 2), F.lit(""))
    return F.struct(repository.alias("repository"), number.cast("long").alias("number"))


def script_safe(json: Column) -> Column:
    """JSON text that may stand inside an HTML script element."""
    out = json
    for a, b in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def html_escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def is_text(content: Column) -> Column:
    """Whether bytes are UTF-8 text without NUL."""
    return F.is_valid_utf8(content.cast("string")) & (F.position(F.lit(b"\x00"), content) == 0)


def same_line(row: Column, source: Column) -> Column:
    """Whether a patch row equals a source line with its end: exactly, or but for one CR before the LF."""
    body = F.regexp_replace(source, r"\n$", "")
    return (row == body) | (F.endswith(source, F.lit("\r\n")) & (row == F.regexp_replace(body, r"\r$", "")))


def excerpt(text: Column, needle: str, width: int = 240) -> Column:
    """At most ``width`` characters around the first place of ``needle``, widened to whole words; letter case does not matter."""
    at = F.instr(F.lower(text), F.lit(needle.lower()))
    begin = F.greatest(F.lit(1), at - F.lit((width - len(needle)) // 2))
    cut = F.substring(text, begin, F.lit(width))
    whole = F.when(begin > 1, F.regexp_replace(cut, r"^\S*\s+", "")).otherwise(cut)
    return F.when(at > 0, F.when(begin + width <= F.length(text), F.regexp_replace(whole, r"\s+\S*$", "")).otherwise(whole))
