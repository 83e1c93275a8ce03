"""Telling hand-written source from generated, minified, vendored and data files (problem 1).

The method is threshold layout statistics per language family, computed over whole Arrow batches in one
narrow pass without a shuffle: line lengths, white space and alphanumeric shares, density of numeric
literals, long encoded runs and the share of distinct line shapes. Statistics cannot see a statement of
origin, so the leading comment block and the path are read as well; a mere mention of such a statement
further down, or of one inside a string, is not one.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.session import spread

#: Thresholds by language family. max_line and mean_line count characters; the rest are shares of the text or counts.
#: A file is minified from max_line, mean_line and alnum on, up to white, or from four times mean_line on up to twice
#: white, which prose in strings is above; a dump of numbers from digits and
#: numbers on; a dump of bytes from encoded and dense (also of letters and digits) on; generated from numbered on, up to shapes.
THRESHOLDS = {
    "script": {"max_line": 180, "mean_line": 90, "white": 0.08, "alnum": 0.30, "digits": 0.30, "numbers": 60, "encoded": 0.50, "dense": 0.60, "shapes": 0.30, "numbered": 0.20},
    "style": {"max_line": 180, "mean_line": 90, "white": 0.06, "alnum": 0.30, "encoded": 0.50, "dense": 0.60},
    "typed": {"max_line": 180, "mean_line": 90, "white": 0.08, "alnum": 0.30, "digits": 0.30, "numbers": 60, "encoded": 0.50, "dense": 0.60, "shapes": 0.30, "numbered": 0.20},
    "indented": {"digits": 0.30, "numbers": 60, "encoded": 0.50, "dense": 0.60, "shapes": 0.30, "numbered": 0.36},
    "config": {"digits": 0.45, "numbers": 200, "encoded": 0.70, "dense": 0.75},
    "other": {"max_line": 500, "mean_line": 250, "white": 0.06, "alnum": 0.30, "digits": 0.45, "numbers": 100, "encoded": 0.70, "dense": 0.75},
}
#: Family of each extension; any other extension, and none, is ``other``. Armoured keys have no thresholds.
FAMILIES = {
    "js": "script", "mjs": "script", "cjs": "script", "jsx": "script", "ts": "script", "tsx": "script", "php": "script", "vue": "script", "svelte": "script",
    "css": "style", "scss": "style", "less": "style", "sass": "style",
    "go": "typed", "java": "typed", "c": "typed", "h": "typed", "cc": "typed", "cpp": "typed", "hpp": "typed", "rs": "typed", "kt": "typed", "kts": "typed", "cs": "typed", "swift": "typed", "scala": "typed", "dart": "typed", "m": "typed",
    "py": "indented", "rb": "indented", "pl": "indented", "lua": "indented", "sh": "indented", "bash": "indented", "r": "indented", "jl": "indented", "ex": "indented", "hs": "indented",
    "json": "config", "yaml": "config", "yml": "config", "toml": "config", "lock": "config", "ini": "config", "xml": "config",
    "pem": "armour", "crt": "armour", "cer": "armour", "key": "armour", "pub": "armour", "asc": "armour",
}
#: Data files need this many characters of encoded runs and generated ones this many lines.
MIN_ENCODED, MIN_LINES = 600, 10
#: Entries with a digest or an address that a lock file under another name has at least.
MIN_INTEGRITY = 2

#: A line of the leading comment block, which is as long as it is; block comments go on until they are closed.
_COMMENT = re.compile(r"[ \t]*(?P<mark>//|#|/\*|\*|<!--|--|;|%)?(?P<rest>[^\n]*)(?:\n|\Z)")
_MARKS = re.compile(r"[/*!#\s;%<-]*")
#: A comment line whose text begins with a statement that a tool wrote the file.
GENERATED = re.compile(
    r"code generated\b|@generated\b|<?auto-?generated\b(?!\s*(?:or|and|files? are)\b)|generated (?:by|from|with|automatically|code|file)\b"
    r"|this (?:file|code|module) (?:was|is|has been) (?:auto-?matically |auto-?|machine[- ])?(?:created|generated|produced|written|built) (?:automatically|by)\b"
    r"|machine[- ](?:made|generated|written|produced)\b|do not edit\b",
    re.I,
)
#: One that states another party's origin: where a copy is from, an upstream, a bundled release or its authors.
VENDORED = re.compile(
    r"(?:this (?:file|code|module) (?:was|is|has been) )?(?:copied|imported|vendored|taken|borrowed|extracted|mirrored)(?: verbatim| unchanged| as is)? from\b"
    r"|licen[cs]e: [^\n]*\bupstream\b|upstream (?:revision|commit|version|source|release|tag)\b|(?:bundled|third[- ]party|vendored) (?:copy|code|source|release|version|library)\b"
    r"|[\w.@/-]+ v?\d+\.\d+(?:\.\d+)?\b[^\n]*\b(?:bundled|third-party|vendored)\b|\(c\) [\w-]+ authors\b",
    re.I,
)
VENDOR_PATH = (
    r"(?i)(?:^|/)(?:_?vendor|_?vendored|node_modules|bower_components|third[_-]?party|3rdparty|site-packages|godeps|external)/[^/]+/"
    r"|(?:^|/)(?:_?vendor|node_modules|third[_-]?party)/|(?:^|/)[^/]+@v?\d+\.\d+(?:\.\d+)?/"
)
LOCK_NAME = r"(?i)(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|pipfile\.lock|cargo\.lock|composer\.lock|gemfile\.lock|go\.sum|uv\.lock|[^/]+\.lock\.json)$"


def extension(path: Column) -> Column:
    """The lower-case extension of ``path``, or an empty string."""
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


#: Byte classes: 1 white, 2 letter, 4 digit, 8 part of an encoded run, 16 line feed.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] |= 1
_CLASS[[*range(65, 91), *range(97, 123)]] |= 2 | 8
_CLASS[[*range(48, 58)]] |= 4 | 8
_CLASS[[ord(c) for c in "+/=_-"]] |= 8
_CLASS[10] |= 16
_CLASS[128:] |= 2
_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
#: An encoded run needs this many characters.
_RUN = 48

MEASURES = "struct<chars long, lines long, max_line long, mean_line double, white double, alnum double, digits double, numbers long, encoded long, shapes double, numbered double, stated int, marks int>"


#: Bytes measured at a time, unless one text has more; intermediate arrays take some hundred bytes for each.
PORTION = 1 << 20


def stated(text: str | None) -> int:
    """What the leading comment block says of the file's origin: 1 that a tool wrote it, 2 that it is another party's, 3 both, 0 nothing."""
    if not text:
        return 0
    at, out, until = text.startswith("\ufeff") * 1, 0, None
    while at < len(text):
        m = _COMMENT.match(text, at)
        rest = m["rest"]
        if until is None and m["mark"] is None and rest.strip():
            break
        body = rest[_MARKS.match(rest).end() :]
        out |= bool(GENERATED.match(body)) + 2 * bool(VENDORED.match(body))
        close = {"/*": "*/", "<!--": "-->"}.get(m["mark"]) if until is None else until
        if close:
            end = text.find(close, m.end("mark") if m["mark"] and until is None else at)
            until = close if end < 0 or end >= m.end("rest") else None
            after = text[end + len(close) : m.end("rest")].strip() if until is None else ""
            if after and not _COMMENT.match(after)["mark"]:
                break
        at = m.end()
    return out


def measure(texts: pd.Series) -> pd.DataFrame:
    """Layout statistics of each text, some MB at a time; null counts as empty. See ``_portion`` for their meaning."""
    parts, held, size = [], [], 0
    for t in texts:
        held.append(t)
        size += len(t) if isinstance(t, str) else 1
        if size >= PORTION:
            parts.append(_portion(held))
            held, size = [], 0
    if held or not parts:
        parts.append(_portion(held))
    return pd.concat(parts, ignore_index=True)


def _portion(texts: list[str | None]) -> pd.DataFrame:
    """Layout statistics of each text, computed over all bytes at once; null counts as empty.

    chars and line lengths are UTF-8 bytes. lines counts lines that are not blank, shapes is the share of
    distinct lines among them once every run of letters, digits, underscores and spaces is one symbol, numbered
    the share of lines holding a word that ends in digits, encoded the bytes in long base64 or hex runs and
    in series of byte escapes; stated is what ``stated`` reads.
    """
    raw = [t.encode("utf-8", "replace") + b"\n" if isinstance(t, str) else b"\n" for t in texts]
    if not raw:
        return pd.DataFrame({k.split()[0]: [] for k in MEASURES[7:-1].split(", ")})
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    buf = np.frombuffer(b"".join(raw), np.uint8)
    kind = _CLASS[buf]

    def total(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags, starts, dtype=np.int64)

    def where(mask: np.ndarray) -> np.ndarray:
        """Number of marked positions of each text."""
        return np.diff(np.searchsorted(np.flatnonzero(mask), np.append(starts, len(buf))))

    white, digit, letter = (kind & 1) > 0, (kind & 4) > 0, (kind & 2) > 0
    before = np.concatenate([[0], kind[:-1]])
    word_before = ((before & 6) > 0) | (np.concatenate([[0], buf[:-1]]) == 95)
    numbers = where(digit & ~word_before & (np.concatenate([[0], buf[:-1]]) != 46))
    ends = np.flatnonzero(buf == 10)
    begins = np.concatenate([[0], ends[:-1] + 1])
    length = ends - begins - ((ends > begins) & (buf[np.maximum(ends - 1, 0)] == 13))
    owner = np.searchsorted(starts, begins, side="right") - 1
    first = np.searchsorted(begins, starts)
    solid = np.add.reduceat(~white, begins, dtype=np.int64) > 0
    max_line = np.maximum.reduceat(length, first)
    lines = np.add.reduceat(solid, first, dtype=np.int64)
    tail = digit & np.concatenate([digit[1:], [False]]) & (((before & 2) > 0) | (np.concatenate([[0], buf[:-1]]) == 95))
    with_number = np.add.reduceat(np.add.reduceat(tail, begins, dtype=np.int64) > 0, first, dtype=np.int64)
    # Encoded runs: maximal stretches of encoding characters, then series of byte escapes.
    run = np.concatenate([[0], ((kind & 8) > 0).astype(np.int8), [0]])
    edge = np.flatnonzero(np.diff(run))
    a, b = edge[::2], edge[1::2]
    long = (b - a) >= _RUN
    mixed = np.zeros(len(a), bool)
    if long.any():
        digits_to = np.concatenate([[0], np.cumsum(digit)])
        mixed = long & ((digits_to[b] - digits_to[a]) * 40 >= (b - a))
    encoded = np.zeros(len(raw), np.int64)
    np.add.at(encoded, np.searchsorted(starts, a[mixed], side="right") - 1, (b - a)[mixed])
    pair = (buf[:-1] == 92) & (buf[1:] == 120)
    zero = (buf[:-1] == 48) & (buf[1:] == 120)
    encoded += 4 * where(np.append(pair, False)) + 6 * where(np.append(zero, False))
    # Line shapes: word runs collapse to one symbol, then a positional hash of what remains of each line.
    wordy = (letter | digit | (buf == 95) | (buf == 32) | (buf == 9)) & (buf != 10)
    keep = np.flatnonzero(~(wordy & np.concatenate([[False], wordy[:-1]])) & (buf != 13))
    symbol = np.where(wordy[keep], 1, buf[keep].astype(np.uint64) + 2).astype(np.uint64)
    line_of = np.searchsorted(ends, keep)
    line_start = np.searchsorted(keep, begins)
    place = np.arange(len(keep)) - line_start[line_of]
    value = np.add.reduceat(symbol * _POWERS[place % 4096], line_start)
    table = pd.DataFrame({"owner": owner[solid], "value": value[solid]})
    distinct = np.bincount(table.drop_duplicates()["owner"], minlength=len(raw)) if len(table) else np.zeros(len(raw), np.int64)
    n, m = np.maximum(sizes - 1, 1), np.maximum(lines, 1)
    return pd.DataFrame({
        "chars": sizes - 1, "lines": lines, "max_line": max_line, "mean_line": (sizes - 1) / m, "white": (total(white) - 1) / n, "alnum": total(letter | digit) / n,
        "digits": total(digit) / n, "numbers": numbers, "encoded": encoded, "shapes": np.where(lines > 0, distinct / m, 1.0), "numbered": with_number / m, "stated": [stated(t) for t in texts],
    })


#: What layout tells of a file, as bits of ``marks``.
MINIFIED, DATA, REPEATED = 1, 2, 4


def marks(m: pd.DataFrame, families: pd.Series) -> np.ndarray:
    """The MINIFIED, DATA and REPEATED bits of measured texts under the thresholds of their families; one that is not set holds for none."""

    def limit(name: str) -> np.ndarray:
        return families.map({family: values.get(name, np.nan) for family, values in THRESHOLDS.items()}).to_numpy(np.float64)

    tight = (m["white"] <= limit("white")) | (m["mean_line"] >= 4 * limit("mean_line")) & (m["white"] <= np.minimum(2 * limit("white"), 0.12))
    long_lines = (m["max_line"] >= limit("max_line")) & (m["mean_line"] >= limit("mean_line")) & tight & (m["alnum"] >= limit("alnum"))
    numeric = (m["digits"] >= limit("digits")) & (m["numbers"] >= limit("numbers"))
    encoded = (m["encoded"] >= limit("encoded") * np.maximum(m["chars"], 1)) & (m["encoded"] >= MIN_ENCODED) & (m["alnum"] >= limit("dense"))
    data = numeric | encoded
    minified = long_lines & ~data
    repeated = (m["lines"] >= MIN_LINES) & (m["shapes"] <= limit("shapes")) & (m["numbered"] >= limit("numbered")) & ~data & ~minified
    return (MINIFIED * minified + DATA * data + REPEATED * repeated).to_numpy(np.int32)


def layout(df: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Add the layout statistics of each text, what they tell, and its language family, as struct column ``layout``."""
    family = F.lit("other")
    ext = extension(F.coalesce(F.col(path), F.lit("")))
    for name in dict.fromkeys(FAMILIES.values()):
        family = F.when(ext.isin([e for e, f in FAMILIES.items() if f == name]), F.lit(name)).otherwise(family)
    def each(texts: pd.Series, families: pd.Series) -> pd.DataFrame:
        m = measure(texts)
        return m.assign(marks=marks(m, families))

    measured = F.pandas_udf(each, MEASURES)
    return spread(df).withColumn("layout", measured(F.col(text), family)).withColumn("layout", F.col("layout").withField("family", family))


def classify(df: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Add array column ``origins`` with every reason why a file is not hand-written; empty for hand-written ones.

    Reasons: generated, lock, minified, vendored, data. Null paths match no path rule, null or empty texts no
    text rule. Rows are neither dropped nor merged; repeated rows get equal answers. Existing columns named
    ``layout`` or ``origins`` are replaced.
    """
    t, p = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(path), F.lit(""))
    s = F.col("layout")

    def told(bits: int) -> Column:
        return s["marks"].bitwiseAND(bits) > 0

    reasons = {
        "generated": (s["stated"].bitwiseAND(1) > 0) | told(REPEATED),
        "lock": p.rlike(LOCK_NAME) | ((s["family"] == "config") & t.contains('"lockfileVersion"') & (F.regexp_count(t, F.lit(r'"integrity"|"resolved"')) >= MIN_INTEGRITY)),
        "minified": told(MINIFIED),
        "vendored": p.rlike(VENDOR_PATH) | (s["stated"].bitwiseAND(2) > 0),
        "data": told(DATA),
    }
    marks = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in reasons.items()]), lambda x: x.isNotNull())
    return layout(df, path, text).withColumn("origins", marks)


def not_handwritten(df: DataFrame, key: str = "fragment_id") -> DataFrame:
    """Distinct ``key`` of the rows that are not hand-written, with their origins."""
    return classify(df).where(F.size("origins") > 0).select(key, "origins").dropDuplicates([key])


def handwritten(df: DataFrame, key: str = "fragment_id") -> DataFrame:
    """The rows of ``df`` that remain, each delivery once a key, unchanged."""
    return classify(df).where(F.size("origins") == 0).drop("layout", "origins").dropDuplicates([key])
