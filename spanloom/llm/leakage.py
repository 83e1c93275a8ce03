"""Evaluation passages inside training documents (problem 7).

Every run of ``min_words`` words of an item contains several n-grams of ``seed_words`` words. For exact runs
(``leaked``) the rarest of them in the whole corpus becomes a seed, so that any run of that length in a document
holds at least one seed and common phrases seed as little as possible. Edited copies (``leaks``) break an n-gram
in every such run, so there each n-gram of an item is a seed, and so are short n-grams where a document shares as
many different ones with an item as a run of ``min_words`` words has. Pairs with a seed are aligned by
Smith-Waterman over words.

Words are maximal runs of letters or digits, compared in lower case.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.session import materialize, spread

MIN_WORDS, SEED_WORDS, SHORT_WORDS = 13, 8, 4
#: Characters of items whose n-grams are held by one pass over the documents, unless one item has more; more items take
#: more passes. This bounds what the driver holds at a time and what each task is sent.
BLOCK = 4_000_000
#: Of an item's short n-grams one in so many, and so many at least, must be in a document to have it aligned.
SHORT_PART, LEAST_SHORT = 5, 4
MATCH, MISMATCH, GAP = 2, -1, -1
#: Columns of the alignments that are scored at once.
CELLS = 1 << 16
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """The lower-case words of a text."""
    return _WORD.findall(text.lower()) if text else []


def _hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of ``n`` word numbers."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        out = (out ^ ids[k : k + len(out)].astype(np.uint64)) * _MIX
        out ^= out >> np.uint64(29)
    return out


class SeedIndex:
    """The n-grams of a bounded block of items."""

    def __init__(self, items: list[tuple[int, str]], seed_words: int = SEED_WORDS, min_words: int = MIN_WORDS):
        self.n, self.min_words = seed_words, min_words
        self.items = {i: w for i, t in items if len(w := words(t)) >= min_words}
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for x in self.items.values() for w in x}), 1)}
        grams = {i: _hashes(self.numbers(w), self.n) for i, w in self.items.items()}
        self.grams = np.unique(np.concatenate([np.zeros(0, np.uint64), *grams.values()]))
        self.of_item = {i: np.searchsorted(self.grams, g) for i, g in grams.items()}
        self.order = list(self.items)
        held = [np.unique(g) for g in self.of_item.values()]
        owner = np.repeat(np.arange(len(held)), [len(g) for g in held])
        held = np.concatenate([np.zeros(0, np.int64), *held])
        #: The items with the n-gram k, as places in ``order``, are holders[first[k] : first[k + 1]].
        self.holders = owner[np.argsort(held, kind="stable")]
        self.first = np.searchsorted(np.sort(held), np.arange(len(self.grams) + 1))

    def numbers(self, ws: list[str]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, 0) for w in ws), np.int64, len(ws))

    def hits(self, ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Positions in a document of the n-grams that some item has, and their numbers."""
        return self.hits_of(self.numbers(ws))

    def hits_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same from the numbers of the document's words."""
        known = np.concatenate([[0], np.cumsum(ids == 0)])
        if len(ids) < self.n or not len(self.grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(known[self.n :] == known[: -self.n])
        if not len(at):
            return at, at
        value = _hashes(ids, self.n)[at]
        k = np.minimum(np.searchsorted(self.grams, value), len(self.grams) - 1)
        good = self.grams[k] == value
        return at[good], k[good]

    def shared(self, grams: np.ndarray) -> np.ndarray:
        """How many different ones of a document's n-grams each item of ``order`` has."""
        held = [self.holders[self.first[g] : self.first[g + 1]] for g in np.unique(grams).tolist()]
        return np.bincount(np.concatenate([np.zeros(0, np.int64), *held]), minlength=len(self.order))

    def seeds(self, documents_with: np.ndarray) -> dict[int, list[int]]:
        """Of each window of an item the rarest n-gram, as {n-gram: items}."""
        out: dict[int, set[int]] = {}
        width = self.min_words - self.n + 1
        for item, grams in self.of_item.items():
            rare = documents_with[grams]
            for k in range(len(grams) - width + 1):
                best = k + int(np.argmin(rare[k : k + width]))
                out.setdefault(int(grams[best]), set()).add(item)
        return {g: sorted(i) for g, i in out.items()}


def align_pairs(items: list[np.ndarray], docs: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
    """Local alignment of each item with the document beside it, all sequences of word numbers: (score, longest run of equal words, first and last document word of the best alignment).

    Pairs of like lengths are scored together, CELLS columns at a time.
    """
    out: list[tuple[int, int, int, int]] = [(0, 0, 0, 0)] * len(items)
    order = sorted((k for k in range(len(items)) if len(docs[k]) and len(items[k])), key=lambda k: (len(docs[k]), len(items[k])))
    while order:
        # The last has the longest document.
        width = len(docs[order[-1]]) + 1
        part, order = order[-max(1, CELLS // width) :], order[: -max(1, CELLS // width)]
        for k, r in zip(part, _aligned([items[k] for k in part], [docs[k] for k in part])):
            out[k] = r
    return out


def _aligned(items: list[np.ndarray], docs: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
    m, n = len(items), max(map(len, docs))
    # The fillings are no words, and what follows an end never scores more than the best before it.
    table, doc = np.full((m, max(map(len, items))), -1, np.int32), np.full((m, n), -2, np.int32)
    for k, (item, d) in enumerate(zip(items, docs)):
        table[k, : len(item)] = item
        doc[k, : len(d)] = d
    # A cell is its score and, below it, the place where its alignment begins, so that one maximum moves both; of equal
    # scores the later begin stands.
    shift = n + 1
    kind = np.int32 if shift * (shift + MATCH * table.shape[1] + 2) < 2**31 else np.int64
    places = np.arange(shift, dtype=kind)
    slope = places * kind(-GAP * shift)
    match, mismatch, gap = kind(MATCH * shift), kind(MISMATCH * shift), kind(GAP * shift)
    above, cell = np.tile(places, (m, 1)), np.empty((m, shift), kind)
    runs, run = np.zeros((m, shift), np.int32), np.zeros((m, shift), np.int32)
    best, last, longest = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int32)
    rows = np.arange(m)
    for word in table.T:
        equal = doc == word[:, None]
        cell[:, 0] = 0
        np.add(above[:, :-1], np.where(equal, match, mismatch), out=cell[:, 1:])
        above += gap
        np.maximum(cell[:, 1:], above[:, 1:], out=cell[:, 1:])
        np.maximum(cell, places, out=cell)
        cell += slope
        np.maximum.accumulate(cell, axis=1, out=cell)
        cell -= slope
        np.maximum(cell, places, out=cell)
        run[:, 1:] = (runs[:, :-1] + 1) * equal
        runs, run = run, runs
        above, cell = cell, above
        top = above.max(axis=1) // shift
        better = top > best // shift
        if better.any():
            # Of equal scores the first place stands.
            at = rows[better]
            k = (above[at] // shift).argmax(axis=1)
            best[at], last[at] = above[at, k], k - 1
        np.maximum(longest, runs.max(axis=1), out=longest)
    score = best // shift
    return list(zip(score.tolist(), longest.tolist(), np.where(score > 0, best % shift, 0).tolist(), last.tolist()))


def align_many(items: list[np.ndarray], doc: np.ndarray) -> list[tuple[int, int, int, int]]:
    """``align_pairs`` of several items with one document."""
    return align_pairs(items, [doc] * len(items))


def align(item: np.ndarray, doc: np.ndarray) -> tuple[int, int, int, int]:
    """``align_many`` of one item."""
    return align_many([item], doc)[0]


def _windows(places: list[int], reach: int, end: int) -> list[tuple[int, int]]:
    """Stretches of a document around its seeds; seeds that lie within ``reach`` of a stretch share it."""
    out: list[list[int]] = []
    for p in sorted(places):
        if out and p - reach <= out[-1][1]:
            out[-1][1] = min(end, p + reach)
        else:
            out.append([max(0, p - reach), min(end, p + reach)])
    return [(a, b) for a, b in out]


def _rows(index: SeedIndex, found: Iterator[tuple[object, np.ndarray, dict[int, list[int]]]]) -> Iterator[list[tuple]]:
    """The rows of documents (key, word numbers, places of each item's seeds), some documents at a time, so that their pairs are aligned together."""
    own: dict[int, np.ndarray] = {}
    waiting: list[tuple[object, int, int, int, np.ndarray]] = []
    cells = 0

    def aligned() -> list[tuple]:
        best: dict[tuple, list[tuple]] = {}
        for (key, item, seeds, a, _), r in zip(waiting, align_pairs([own[w[1]] for w in waiting], [w[4] for w in waiting])):
            best.setdefault((key, item, seeds), []).append((*r, a))
        out = []
        for (key, item, seeds), results in best.items():
            top = max(results)
            out.append((key, item, max(r[1] for r in results), top[0], top[0] / (MATCH * len(own[item])), top[4] + top[2], top[4] + top[3], seeds))
        return out

    for key, ids, places in found:
        for item, ps in places.items():
            if item not in own:
                own[item] = index.numbers(index.items[item])
            for a, b in _windows(ps, 2 * len(own[item]), len(ids)):
                waiting.append((key, item, len(ps), a, ids[a:b]))
                cells += b - a
        if cells > 8 * CELLS:
            yield aligned()
            waiting, cells = [], 0
    yield aligned()


COLUMNS = ["doc_id", "item_id", "longest_run", "score", "similarity", "first_word", "last_word", "seeds"]


def _schema(kind: str, item_type: str) -> str:
    return f"doc_id {kind}, item_id {item_type}, longest_run int, score int, similarity double, first_word int, last_word int, seeds int"


def _block(documents: DataFrame, index: SeedIndex, doc_id: str, text: str, item_type: str) -> DataFrame:
    kind = documents.schema[doc_id].dataType.simpleString()

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, t in batch.itertuples(index=False):
                _, grams = index.hits(words(t))
                if len(grams):
                    rows.append((key, t, np.unique(grams).tolist()))
            yield pd.DataFrame(rows, columns=["doc", "text", "grams"])

    found = materialize(spread(documents).select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).mapInPandas(find, f"doc {kind}, text string, grams array<int>"), "leak-hits")
    # At most one row an n-gram of the block comes to the driver, whatever the corpus.
    rarity = np.zeros(max(1, len(index.grams)), np.int64)
    for row in found.select(F.explode("grams").alias("gram")).groupBy("gram").count().collect():
        rarity[row["gram"]] = row["count"]
    seeds = index.seeds(rarity)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:

            def found() -> Iterator[tuple[object, np.ndarray, dict[int, list[int]]]]:
                for key, t, _ in batch.itertuples(index=False):
                    ids = index.numbers(words(t))
                    places: dict[int, list[int]] = {}
                    for p, g in zip(*(x.tolist() for x in index.hits_of(ids))):
                        for item in seeds.get(g, ()):
                            places.setdefault(item, []).append(p)
                    yield key, ids, places

            for rows in _rows(index, found()):
                yield pd.DataFrame(rows, columns=COLUMNS)

    return found.mapInPandas(score, _schema(kind, item_type))


def _edited_block(documents: DataFrame, index: SeedIndex, short: SeedIndex, doc_id: str, text: str, item_type: str) -> DataFrame:
    """Pairs with a common n-gram of ``index``, or with enough different ones of ``short``: a part of the item's, or as many as a run of min_words words has."""
    kind = documents.schema[doc_id].dataType.simpleString()
    lengths = np.array([len(short.items[i]) for i in short.order], np.int64)
    most = index.min_words - short.n + 1
    enough = np.minimum(most, np.maximum(min(LEAST_SHORT, most), -(-(lengths - short.n + 1) // SHORT_PART)))
    least = int(enough.min()) if len(enough) else 0

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:

            def found() -> Iterator[tuple[object, np.ndarray, dict[int, list[int]]]]:
                for key, t in batch.itertuples(index=False):
                    ids = index.numbers(words(t))
                    _, grams = index.hits_of(ids)
                    at, shorts = short.hits_of(ids)
                    if len(grams) or len(shorts) and len(shorts) >= least:
                        chosen = np.flatnonzero((index.shared(grams) > 0) | (short.shared(shorts) >= enough))
                        # A common n-gram holds short ones, so these are all the places that count.
                        yield key, ids, {i: at[np.isin(shorts, short.of_item[i])].tolist() for i in (index.order[k] for k in chosen.tolist())}

            for rows in _rows(index, found()):
                yield pd.DataFrame(rows, columns=COLUMNS)

    return spread(documents).select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).mapInPandas(score, _schema(kind, item_type))


def _blocks(items: DataFrame, item_id: str, item_text: str, block: int) -> Iterator[list[tuple]]:
    """The items, each once, about ``block`` characters at a time; the driver holds one block and a part of the table."""
    rows = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where(F.col("i").isNotNull() & F.col("t").isNotNull())
    held: list[tuple] = []
    size = 0
    for r in rows.groupBy("i").agg(F.min("t").alias("t")).orderBy("i").toLocalIterator():
        if held and size + len(r["t"]) > block:
            yield held
            held, size = [], 0
        held.append((r["i"], r["t"]))
        size += len(r["t"])
    yield held


def _passes(items: DataFrame, item_id: str, item_text: str, block: int, one_pass: Callable[[list[tuple]], DataFrame]) -> DataFrame:
    """The rows of a pass over the documents for each block of items; all but the last are written before the next is read."""
    out: list[DataFrame] = []
    for held in _blocks(items, item_id, item_text, block):
        if out:
            out[-1] = materialize(out[-1], "leak-pass")
        out.append(one_pass(held))
    return reduce(DataFrame.unionByName, out)


def leaks(
    documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, seed_words: int = SEED_WORDS, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK, short_words: int = SHORT_WORDS
) -> DataFrame:
    """Document and item pairs that share a seed, aligned: doc_id, item_id, longest_run, score, similarity, first_word, last_word, seeds.

    Every pair with ``seed_words`` consecutive words in common is among them, and every pair with a fifth of the item's
    different runs of ``short_words`` words in common (but no fewer than 4, and never more than the ``min_words -
    short_words + 1`` that an exact run of ``min_words`` has). An item of n words that was copied with e words changed,
    added or left out keeps n + 1 - short_words * (e + 1) of its runs or more. What other
    documents hold has no part in it. ``longest_run`` tells the exact number of consecutive words, ``similarity``
    the alignment's score against that of a full copy and ``seeds`` the document's places with a common short run.
    Items with fewer than ``min_words`` words, and null or blank texts, give no row. Repeated deliveries of a
    document or an item count once; extra columns are not carried. Items are taken ``block`` characters at a time, so
    that what the driver and the workers hold is bounded.
    """
    assert short_words <= seed_words <= min_words
    kind = items.schema[item_id].dataType.simpleString()
    rows = _passes(items, item_id, item_text, block, lambda held: _edited_block(documents, SeedIndex(held, seed_words, min_words), SeedIndex(held, short_words, min_words), doc_id, text, kind))
    return rows.dropDuplicates(["doc_id", "item_id"])


def leaked(
    documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, seed_words: int = SEED_WORDS, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK
) -> DataFrame:
    """The pairs that share at least ``min_words`` consecutive words: doc_id, item_id."""
    assert seed_words <= min_words
    kind = items.schema[item_id].dataType.simpleString()
    rows = _passes(items, item_id, item_text, block, lambda held: _block(documents, SeedIndex(held, seed_words, min_words), doc_id, text, kind))
    return rows.dropDuplicates(["doc_id", "item_id"]).where(F.col("longest_run") >= min_words).select("doc_id", "item_id")
