"""Cutting oversized texts into overlapping pieces at natural boundaries (problem 5).

A text is read as a tree of its own structure: sections by headings, then paragraphs and items in markup; blocks by
indentation and blank lines elsewhere, a declaration together with the comments and decorators above it. A node that
fits is never cut. The parts of a node that does not fit are packed first, then siblings are merged from the front up
to the limit, level by level from the leaves to the root.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT, OVERLAP_LINES = 6144, 3
#: Indentations that are told apart; deeper ones are one level.
LEVELS = 64

_MARKUP = re.compile(r"\.(?:md|markdown|mdx|rst|txt|adoc)$", re.I)
_HEADING = re.compile(r"(#{1,6})\s|<h([1-6])\b", re.I)
_ITEM = re.compile(r"\s*(?:[-*+]|\d+[.)])\s")
#: Lines that belong to what follows them: decorators and comments.
_LEADS = re.compile(r"@\w|//|/\*|\*|#|--")
_CLOSES = re.compile(r"\s*(?:[)\]}]|else\b|elif\b|except\b|finally\b|catch\b|</|end\b|\"\"\"|''')")
#: Inside a line the later of these is preferred: ends of statements, then of items, then of words.
_INSIDE = (re.compile(r"[;}\]>]|[.!?。](?=\s)"), re.compile(r"[,:|&)]"), re.compile(r"\s"))

PIECES = T.StructType([
    T.StructField("piece", T.IntegerType()), T.StructField("start_line", T.IntegerType()), T.StructField("overlap_lines", T.IntegerType()), T.StructField("overlap_chars", T.IntegerType()),
    T.StructField("n_bytes", T.IntegerType()), T.StructField("piece_text", T.StringType()),
])


def ranks(lines: list[str], path: str | None) -> list[int]:
    """Rank of the boundary before each line; a node's children lie between its inner boundaries of highest rank."""
    markup, fence, blank, lead, out = bool(path and _MARKUP.search(path)), False, True, False, []
    widths = sorted({len(x) - len(x.lstrip(" \t")) for x in lines if x.strip()})
    level = {w: min(i, LEVELS) for i, w in enumerate(widths)}
    for x in lines:
        body = x.lstrip(" \t")
        if not body.strip():
            # A blank line belongs to what is before it.
            out.append(0)
            blank = True
            continue
        if markup:
            fenced = body.startswith(("```", "~~~"))
            if fence:
                rank = 0
            elif heading := _HEADING.match(body):
                rank = 10 - (len(heading[1]) if heading[1] else int(heading[2]))
            else:
                rank = 3 if blank else 2 if _ITEM.match(x) else 1
            fence ^= fenced
        elif _CLOSES.match(x) or lead and not blank:
            rank = 0
        else:
            rank = 1 + 2 * (LEVELS - level[len(x) - len(body)]) + blank
        out.append(rank)
        blank, lead = False, not markup and bool(_LEADS.match(body))
    return out


def _bytes(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


def _inside(line: str, room: int) -> int:
    """Characters of ``line`` to take into ``room`` bytes, cut at a natural place in the last quarter if there is one."""
    most = len(line.encode("utf-8", "surrogatepass")[:room].decode("utf-8", "ignore"))
    if most >= len(line):
        return len(line)
    for rule in _INSIDE:
        last = max((m.end() for m in rule.finditer(line, most - most // 4, most)), default=0)
        if last:
            return last
    return max(1, most - (line[most - 1 : most + 1] == "\r\n"))


def children(rank: list[int], first: int, end: int) -> list[tuple[int, int]]:
    """The parts of the node of rows ``first`` to ``end`` between its strongest inner boundaries."""
    strongest = max(rank[first + 1 : end])
    cuts = [first, *(k for k in range(first + 1, end) if rank[k] == strongest), end]
    return list(zip(cuts, cuts[1:]))


def pack(rank: list[int], upto: list[int], reserve: list[int], limit: int) -> list[tuple[int, int]]:
    """Runs of rows, none beyond the limit but single rows: fitting nodes whole, siblings merged where the rows before them fit as well."""

    def merged(units: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for a, b in units:
            if out and upto[b] - upto[out[-1][0]] + reserve[out[-1][0]] <= limit:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
        return out

    # Nodes wait on a list with what their parts have given so far, so that depth is no matter of calls.
    done: list[list[tuple[int, int]]] = [[]]
    waiting: list[tuple[int, int] | None] = [(0, len(rank))]
    while waiting:
        node = waiting.pop()
        if node is None:
            units = merged(done.pop())
            done[-1] += units
        elif upto[node[1]] - upto[node[0]] <= limit or node[1] - node[0] == 1:
            done[-1].append(node)
        else:
            waiting += [None, *reversed(children(rank, *node))]
            done.append([])
    return done[0]


def split_text(text: str, path: str | None = None, limit: int = LIMIT, overlap: int = OVERLAP_LINES) -> list[tuple[int, int, str, str]]:
    """Pieces of ``text`` as (line offset of the first line, repeated lines, repeated text, new text).

    No piece has more than ``limit`` UTF-8 bytes. The new texts joined give the text. Each piece after the first begins
    with the last ``overlap`` lines of the one before, or with as many of them as leave room for a node that is kept
    whole. A line longer than the limit is cut inside, and its parts count as lines.
    """
    if _bytes(text) <= limit:
        return [(0, 0, "", text)]
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    rows: list[tuple[int, str]] = []
    rank: list[int] = []
    for number, (line, r) in enumerate(zip(lines, ranks(lines, path))):
        at = 0
        while at < len(line):
            # No more than ``limit`` characters can fit.
            n = _inside(line[at : at + limit + 1], limit)
            rows.append((number, line[at : at + n]))
            rank.append(0 if at else r)
            at += n
    upto = [0]
    for _, x in rows:
        upto.append(upto[-1] + _bytes(x))
    # Room that is kept for repeated lines while siblings are merged.
    reserve = [max((upto[a] - upto[k] for k in range(max(0, a - overlap), a) if upto[a] - upto[k] <= limit // 2), default=0) for a in range(len(rows))]
    out = []
    for a, b in pack(rank, upto, reserve, limit):
        before = next(k for k in range(max(0, a - overlap), a + 1) if upto[b] - upto[k] <= limit) if a else a
        out.append((rows[before][0], a - before, "".join(x for _, x in rows[before:a]), "".join(x for _, x in rows[a:b])))
    return out


def split(df: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP_LINES, key: str = "fragment_id", path: str = "path", text: str = "text", start: str = "start_line") -> DataFrame:
    """The pieces of every text larger than ``limit`` bytes, one row a piece: key, piece (from 1), start_line,
    overlap_lines and overlap_chars (what it repeats), n_bytes, piece_text.

    Texts within the limit, null and empty ones give no row. Repeated deliveries of a key count once. A null path
    is read as source, a null start line as 1. Columns besides the four named are not carried.
    """
    large = df.where(F.octet_length(F.col(text)) > limit).select(
        F.col(key).alias("_key"), F.col(path).cast("string").alias("_path"), F.col(text).alias("_text"), F.coalesce(F.col(start).cast("int"), F.lit(1)).alias("_start")
    )

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, p, t, s in batch.itertuples(index=False):
                for i, (line, n, before, new) in enumerate(split_text(t, p, limit, overlap), 1):
                    rows.append((k, i, s + line, n, len(before), len((before + new).encode("utf-8", "replace")), before + new))
            yield pd.DataFrame(rows, columns=[key, *PIECES.names])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *PIECES.fields])
    return large.dropDuplicates(["_key"]).mapInPandas(pieces, schema)


def oversized(df: DataFrame, limit: int = LIMIT, key: str = "fragment_id") -> DataFrame:
    """Distinct keys of the texts that come out in more than one piece."""
    return split(df, limit, key=key).where(F.col("piece") == 2).select(key).distinct()
