"""Keyword-stuffed pages and link lists (problem 9).

Texts become sequences of function words by their role and of other words, numbers and marks by their form. A
trigram model of these classes, trained on all sentences of the corpus, gives each stretch between two sentence
ends its perplexity. The model is class based: a content word costs the bits of its class, which come from prose,
and the bits of the word within its class, which come from the rest of the page. Three readings are no sentences:
class bits abnormally high (marks and names in no order of prose), class bits abnormally low (names upon names
without a function word, the likeliest step of all), and word bits abnormally low (the page says the same words
again). Words of links and tags are counted as they are. A page is a case if these words are more than half of all.

Each text is read once: the word classes and the moments of each page are written, the model is summed up from
them, and the pages are scored from what was written by array arithmetic.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.session import materialize, spread

# Function words by role, in English, German, French and Spanish.
DETERMINERS = "the a an this that these those my your his her its our their no some any each every all both such der die das den dem des ein eine einen einem einer eines dieser diese dieses kein keine alle le la les l un une des du ce cette ces cet mon ton son sa ses leur leurs nos vos el lo los las una unos unas este esta estos estas ese esa esos su sus todo toda todos todas"
PREPOSITIONS = "of in to for with on at by from into onto over under about after before between through during against within without toward towards upon beside besides around above below near per via than as von zu zum zur mit nach bei aus auf in im an am für über unter vor hinter zwischen durch ohne gegen um seit bis de à au aux en dans par pour sur sous avec sans chez entre vers avant après depuis pendant del al con por para sin sobre hasta desde según tras contra durante"
PRONOUNS = "i you he she it we they me him us them who whom which what whose one nobody everyone someone nothing anything something everything there here mine yours ich du er sie es wir ihr mich mir dich dir ihm ihn uns euch ihnen man wer was je tu il elle nous vous ils elles on me te se y qui que quoi dont où lui eux yo tú él ella nosotros ustedes ellos ellas nos le les quien cual eso esto"
CONJUNCTIONS = "and or but nor so yet if because while when where whereas although though unless until since once that whether hence then else how why und oder aber denn weil wenn als dass ob damit sondern obwohl während et ou mais car donc ni si comme lorsque quand puisque parce tant même y o pero porque cuando como aunque sino mientras pues"
VERBS = "is are was were be been being am do does did done doing have has had having will would shall should can could may might must let need needs ist sind war waren sein wird werden wurde wurden hat haben hatte hatten kann können muss müssen soll sollen gibt bleibt est sont était étaient être a ont avait avoir sera doit peut faut fait es son era eran ser está están estar ha han hay fue puede deben debe"
PARTICLES = "not only also still never always ever just very more most less least much many too again now later longer same other another own even already nicht nur auch noch schon sehr mehr erst jetzt hier dort danach immer wieder klar früher ne pas plus moins très aussi encore toujours déjà désormais bien no más menos muy también ya aún todavía ahora antes después siempre tan"

_ROLES = {w: k for k, group in enumerate((DETERMINERS, PREPOSITIONS, PRONOUNS, CONJUNCTIONS, VERBS, PARTICLES)) for w in reversed(group.split())}
#: Classes after the six roles: plain word, capitalised word, name or path, number, inner mark, sentence end, separator, other mark, edge.
_PLAIN, _CAPITAL, _MIXED, _NUMBER, _COMMA, _END, _SEPARATOR, _MARK, _EDGE = range(6, 15)
N_CLASSES = 15
_ANCHOR = re.compile(r"<a\s[^<>]*+>(?:(?!</?a\b).)*+</a>|\[[^\[\]\n]*+\]\((?:https?://|/|#)[^)\s]*+\)", re.I)
_TAG = re.compile(r"(?<![\w#])#[^\W\d_]\w*")
_URL = re.compile(r"(?:https?://|www\.)[^\s)\"'<>\]]+", re.I)
_WORD = re.compile(r"[^\W_]+")
#: Parts of what stands between two spaces: a word with what joins it to others, a number, or a mark.
_PART = re.compile(r"[^\W_]+(?:[^\w\s,;:!?()\[\]{}\"<>|*]*_*[^\W_]+)*|[.!?…]+$|[^\w\s]|_")
_NUMERIC = re.compile(r"\d[\d.,:%-]*$")
_JOINED = re.compile(r"[\w][/\\_.@=+&#][\w]|\d")
#: Lines of programs, traces, patches and change statistics; they are neither sentences nor keywords.
_CODE = re.compile(
    r"^\s*(?:@@ |diff --git|[+-]{3} |Traceback \(|File \"|at \S+\(|raise |return\b|import \w|from [\w.]+ import|def |class \w|func |package \w|var \w|const \w|let \w|type \w+ |export |async |await |case |default:|switch |if \(|for \(|while |throw |else\b|\}|\{|\)|//|/\*|\*/|#include)"
    r"|^\s*\S+\s+\|\s+(?:\d+\s*[+-]*|Bin\b)|^\s*\d+ files? changed|[{};]\s*$|\)\s*:\s*$|^\s*[\w.]+\(.*\)\s*;?\s*$|\s(?::=|==|=>|\+=|-=|!=|=)\s|^\s*[\"'][\w.\s-]+[\"']\s*:|^\s*[A-Za-z_]\w*\s*=\s|^\s*\w+[?]?:\s+[\w.]+(?:<[^>]*>|\[\])*;|`json:\"|^[+-]\s{2,}\S|^[+-]\t"
)
#: From this share of its words on, the words of links make a line a list entry as a whole.
LINK_LINE = 0.4
#: A letter of two bytes that was decoded as two letters.
_MISREAD = re.compile("[ÃÂ][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]")
_FENCE = re.compile(r"\s*(?:```|~~~)")
_CLOSERS, _BULLETS = "\"')]*_»”’`", " \t*#>-+|•·"

#: Bytes of text read at a time, and pieces between spaces that are remembered; both only bound memory.
PORTION, REMEMBERED = 1 << 20, 300_000


def _word_class(word: str) -> int:
    role = _ROLES.get(word.lower())
    if role is None and ("'" in word or "’" in word):
        low = re.split("['’]", word.lower())
        role = _ROLES.get(low[0], 2 if low[0] in ("l", "d", "n", "qu", "s", "c", "j", "m", "t") else None)
    if role is not None:
        return role
    if _JOINED.search(word):
        return _MIXED
    return _PLAIN if word.islower() else _CAPITAL if word[1:].islower() or len(word) == 1 else _MIXED


class Reader:
    """Word classes of texts. What stands between two spaces is taken apart once and remembered by its number."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.names: dict[str, int] = {}
        self.kinds, self.words, self.sizes, self.counts, self.ends = bytearray(), [], [], [], []

    def number(self, chunk: str) -> int:
        """The number of a chunk that is not known yet."""
        text = chunk
        if "Ã" in text or "Â" in text:
            text = _MISREAD.sub("ü", text)
        if "&" in text:
            text = html.unescape(text)
        bare = text.rstrip(_CLOSERS)
        n = 0
        kind = _MARK
        for part in _PART.findall(bare.lstrip("*_`") or text):
            c, size, name = part[0], 0, -1
            if c.isalnum():
                size = len(_WORD.findall(part))
                kind = _NUMBER if _NUMERIC.match(part) else _word_class(part)
                if _PLAIN <= kind <= _MIXED:
                    name = self.names.setdefault(part.lower(), len(self.names))
            else:
                kind = _END if c in ".!?…" else _COMMA if c in ",:;()\"'’“”" else _SEPARATOR if c in "|-–—•·*»>/\\#~=+<&_" else _MARK
            self.kinds.append(kind)
            self.words.append(name)
            self.counts.append(size)
            n += 1
        self.sizes.append(n)
        self.ends.append(n > 0 and kind == _END)
        self.known[chunk] = out = len(self.sizes) - 1
        return out

    def numbers(self, chunks: list[str]) -> list[int]:
        get, number = self.known.get, self.number
        return [k if (k := get(c)) is not None else number(c) for c in chunks]


def stretches(text: str) -> tuple[str, int, int]:
    """(lines outside code and link lists, words of links and tags that are taken out of them, words of code)."""
    code = linked = 0
    fence = False
    block: list[str] = []
    for line in text.split("\n"):
        if "`" in line or "~" in line:
            if _FENCE.match(line):
                fence = not fence
                code += len(_WORD.findall(line))
                continue
        has_link = "http" in line or "www." in line or "](" in line or "#" in line or "<" in line and "<a " in line.lower()
        if fence or not has_link and _CODE.search(line):
            code += len(_WORD.findall(line))
            continue
        if has_link:
            # A line of anchors and little else is a list entry: its words are the link's.
            rest = _ANCHOR.sub(" ", line)
            if rest != line and len(_WORD.findall(rest)) <= 3:
                linked += len(_WORD.findall(line))
                continue
            stripped = _TAG.sub(" ", _URL.sub(" ", line))
            here = len(_WORD.findall(line))
            inside = here - len(_WORD.findall(stripped))
            if inside and inside >= LINK_LINE * here:
                linked += here
                continue
            linked += inside
            line = stripped
        block.append(line.lstrip(_BULLETS))
    return "\n".join(block), linked, code


#: What a page predicts of its own words: the weight of all its words beside those after the same word, the bits of a
#: word that the page does not predict, and how far a word may stand behind the one before.
UNIGRAMS, NOVEL_BITS, REACH = 1.0, 6, 2


def word_bits(page: np.ndarray, place: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Bits of each content word given the rest of its page: a bigram model of the page without the word itself.

    ``page`` is ascending, ``place`` the place of a word among all tokens, ``word`` its number.
    """
    if not len(word):
        return np.zeros(0)
    _, own = np.unique(page.astype(np.int64) << 32 | word, return_inverse=True)
    n = np.bincount(own)[own] - 1
    total = np.bincount(page)[page] - 1
    before = np.concatenate([[-1], own[:-1]])
    tied = np.concatenate([[False], (page[1:] == page[:-1]) & (place[1:] - place[:-1] <= REACH)])
    alone = 0.5 * n / np.maximum(total, 1) + 0.5 * 2.0**-NOVEL_BITS
    _, pair = np.unique(before * (len(own) + 1) + own, return_inverse=True)
    seen = np.bincount(pair, weights=tied)[pair] - 1
    # A word before is as often followed as it has tied words after it.
    followed = np.bincount(before[tied], minlength=len(own) + 1)[np.maximum(before, 0)] - 1
    p = np.where(tied, (np.maximum(seen, 0) + UNIGRAMS * alone) / (np.maximum(followed, 0) + UNIGRAMS), alone)
    return -np.log2(p)


#: A stretch is no sentence if its class bits lie Z_HIGH deviations and SURPLUS bits a class above those of sentences, and
#: no more than ROLES of its words are function words, since prose that lost its marks or its order keeps them; beyond
#: Z_SURE deviations and SURE bits these do not save it. Nor is it one if around it, over WINDOW content words of the
#: page, class bits lie Z_LOW deviations and DEFICIT bits below and no more than FEW_ROLES of the words are function
#: words, or if at least LEAST content words have at most WORD_BITS bits each there.
Z_HIGH, SURPLUS, ROLES, Z_SURE, SURE = 3.5, 0.55, 0.26, 25.0, 3.0
WINDOW, Z_LOW, DEFICIT, FEW_ROLES, LEAST, WORD_BITS = 80, 2.0, 0.3, 0.12, 24, 3.6

_POWERS = np.cumprod(np.full(1024, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
FIELDS = "n_words int, link_words int, code_words int, kinds binary, lengths array<int>, words array<int>, content array<int>, word_bits array<float>"


def read(texts: list[str | None], reader: Reader) -> pd.DataFrame:
    """The fields of each text: its words, those of links and of code, its word classes, and of each stretch its length in classes, its words, content words and their bits."""
    if len(reader.sizes) > REMEMBERED:
        reader.forget()
    blocks = [stretches(t) if t else ("", 0, 0) for t in texts]
    numbers = [reader.numbers(b[0].split()) for b in blocks]
    chunk = np.fromiter((k for x in numbers for k in x), np.int64, sum(map(len, numbers)))
    of = np.repeat(np.arange(len(texts)), [len(x) for x in numbers])
    sizes, first = np.array(reader.sizes, np.int64), np.concatenate([[0], np.cumsum(reader.sizes, dtype=np.int64)])
    n = sizes[chunk] if len(chunk) else np.zeros(0, np.int64)
    # The tokens of every chunk, one after the other.
    begin = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(first[chunk] - begin[:-1], n) + np.arange(begin[-1])
    kinds = np.frombuffer(bytes(reader.kinds), np.uint8)[at]
    word, count = np.array(reader.words, np.int64)[at], np.array(reader.counts, np.int64)[at]
    page = np.repeat(of, n)
    ends = np.zeros(len(at) + 1, bool)
    ends[begin[1:][np.array(reader.ends, bool)[chunk]] if len(chunk) else []] = True
    starts = ends[:-1] | np.concatenate([[True], page[1:] != page[:-1]])[: len(at)]
    head = np.flatnonzero(starts)

    def by_stretch(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, head) if len(head) else np.zeros(0, values.dtype)

    owner = page[head]
    split = np.searchsorted(owner, np.arange(1, len(texts)))
    tokens = np.searchsorted(page, np.arange(len(texts) + 1))
    lengths, words = np.diff(np.append(head, len(at))), by_stretch(count)
    inside = by_stretch((word >= 0).astype(np.int64))
    # A sentence that the page repeats as a whole says nothing of its keywords: it counts once, and its copies are like it.
    stretch = np.repeat(np.arange(len(head)), lengths)
    form = by_stretch((word + 2).astype(np.uint64) * _POWERS[(np.arange(len(at)) - head[stretch]) % len(_POWERS)] + kinds)
    spoken = by_stretch((kinds < _PLAIN).astype(np.int64)) > ROLES * by_stretch((kinds <= _NUMBER).astype(np.int64))
    form = np.where(spoken, form, np.arange(len(head), dtype=np.uint64))
    _, original, copy = np.unique(np.stack([owner.astype(np.uint64), form]), axis=1, return_index=True, return_inverse=True) if len(head) else (None, head, head)
    fresh = np.zeros(len(head), bool)
    fresh[original] = True
    content = np.flatnonzero((word >= 0) & fresh[stretch])
    bits = np.zeros(len(at))
    bits[content] = word_bits(page[content], content, word[content])
    own_bits = by_stretch(bits)[original[copy]] if len(head) else np.zeros(0)
    total = np.bincount(page, weights=count, minlength=len(texts)).astype(np.int64) if len(at) else np.zeros(len(texts), np.int64)
    raw = kinds.tobytes()

    def lists(values: np.ndarray, kind: type) -> list[np.ndarray]:
        return np.split(values.astype(kind), split)

    return pd.DataFrame({
        "n_words": [int(t) + b[1] + b[2] for t, b in zip(total, blocks)], "link_words": [b[1] for b in blocks], "code_words": [b[2] for b in blocks],
        "kinds": [raw[a:b] for a, b in zip(tokens[:-1], tokens[1:])], "lengths": lists(lengths, np.int32), "words": lists(words, np.int32), "content": lists(inside, np.int32), "word_bits": lists(own_bits, np.float32),
    })


def portions(batch: pd.DataFrame, text: str) -> Iterator[pd.DataFrame]:
    """A batch in parts of about PORTION characters."""
    sizes = batch[text].str.len().fillna(0).to_numpy(np.int64) + 1
    part = np.cumsum(sizes) // PORTION
    for _, rows in batch.groupby(part, sort=False):
        yield rows


def sequences(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and FIELDS of each row; the only pass over the texts."""
    kind = documents.schema[doc_id].dataType.simpleString()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader()
        for batch in batches:
            for rows in portions(batch, "text"):
                out = read(rows["text"].tolist(), reader)
                out.insert(0, "doc_id", rows["doc_id"].to_numpy())
                yield out

    return spread(documents).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(each, f"doc_id {kind}, {FIELDS}")


class Pages:
    """Arrays of a batch of pages: class codes, the stretch of each, and the page of each stretch."""

    def __init__(self, batch: pd.DataFrame):
        def flat(name: str, kind: type) -> np.ndarray:
            return np.concatenate([np.zeros(0, kind), *batch[name]]).astype(kind)

        self.kinds = np.frombuffer(b"".join(batch["kinds"]), np.uint8).astype(np.int64)
        self.lengths, self.words, self.content, self.bits = flat("lengths", np.int64), flat("words", np.int64), flat("content", np.int64), flat("word_bits", np.float64)
        self.page = np.repeat(np.arange(len(batch)), [len(x) for x in batch["lengths"]])
        self.stretch = np.repeat(np.arange(len(self.lengths)), self.lengths)
        starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]) if len(self.lengths) else np.zeros(0, np.int64)
        one, two = np.concatenate([[_EDGE], self.kinds[:-1]])[: len(self.kinds)], np.concatenate([[_EDGE, _EDGE], self.kinds[:-2]])[: len(self.kinds)]
        one[starts] = two[starts] = _EDGE
        two[(starts + 1)[self.lengths > 1]] = _EDGE
        self.grams = (two * N_CLASSES + one) * N_CLASSES + self.kinds
        self.last = self.kinds[starts + self.lengths - 1] if len(starts) else starts
        self.roles, self.spoken = self.total(self.kinds < _PLAIN), self.total(self.kinds <= _NUMBER)

    def total(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.stretch, weights=values, minlength=len(self.lengths))

    def sentences(self) -> np.ndarray:
        """What the model is trained on: stretches that end as a sentence does and have function words."""
        n = self.lengths
        return (n >= 6) & (n <= 60) & (self.last == _END) & (self.roles >= np.maximum(2, 0.2 * n))


def train(pages: DataFrame) -> np.ndarray:
    """Trigram counts of the classes in all sentences of ``sequences``; the driver receives at most 15^3 of them."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros(N_CLASSES**3, np.int64)
        for batch in batches:
            p = Pages(batch)
            found += np.bincount(p.grams[p.sentences()[p.stretch]], minlength=N_CLASSES**3)
        at = np.flatnonzero(found)
        yield pd.DataFrame({"gram": at, "n": found[at]})

    counts = np.zeros(N_CLASSES**3, np.int64)
    for row in pages.select("kinds", "lengths", "words", "content", "word_bits").mapInPandas(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        counts[row["gram"]] = row["n"]
    return counts.reshape((N_CLASSES,) * 3)


class Model:
    """Interpolated trigram model with the mean and deviation of its own surprise on sentences, in bits a class."""

    def __init__(self, counts: np.ndarray):
        c = counts.astype(np.float64)
        two, one = c.sum(0), c.sum((0, 1))
        unigram = (one + 0.5) / (one.sum() + 0.5 * N_CLASSES)
        bigram = (two + 8 * unigram) / (two.sum(1, keepdims=True) + 8)
        trigram = (c + 16 * bigram[None]) / (c.sum(2, keepdims=True) + 16)
        self.bits = -np.log2(trigram).ravel()
        flat, total = c.ravel(), max(1.0, c.sum())
        self.mean = float((flat * self.bits).sum() / total)
        self.deviation = math.sqrt(max(1e-9, float((flat * (self.bits - self.mean) ** 2).sum() / total)))


def _around(pages: Pages, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 stretch of the same page whose middle lies within half of ``window`` content words of each one's."""
    upto = np.concatenate([[0], np.cumsum(pages.content)])
    middle = (upto[:-1] + upto[1:]) / 2
    first, last = (np.searchsorted(pages.page, pages.page, side=x) for x in ("left", "right"))
    near = [np.searchsorted(middle, middle + d, side=x) for d, x in ((-window / 2, "left"), (window / 2, "right"))]
    return np.maximum(first, near[0]), np.minimum(last, near[1])


def judge(batch: pd.DataFrame, model: Model) -> pd.DataFrame:
    """stuffed_words (of stretches that are no sentences) and bits (mean class bits) of each page of ``sequences``."""
    p = Pages(batch)
    own = p.total(model.bits[p.grams])
    n = p.lengths
    high, limit = own - n * model.mean, model.deviation * np.sqrt(n)
    odd = (p.roles <= ROLES * p.spoken) & (high > Z_HIGH * limit) & (high > SURPLUS * n) | (high > Z_SURE * limit) & (high > SURE * n)
    first, last = _around(p, WINDOW)

    def near(values: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0.0], np.cumsum(values)])
        return upto[last] - upto[first]

    classes, low = near(n), near(-high)
    odd |= (near(p.roles) <= FEW_ROLES * near(p.spoken)) & (low > Z_LOW * model.deviation * np.sqrt(classes)) & (low > DEFICIT * classes)
    odd |= (p.content > 1) & (near(p.content) >= LEAST) & (near(p.bits) <= WORD_BITS * near(p.content))
    size = len(batch)
    stuffed = np.bincount(p.page, weights=p.words * odd, minlength=size).astype(np.int32)
    return pd.DataFrame({"stuffed_words": stuffed, "bits": np.bincount(p.page, weights=own, minlength=size) / np.maximum(np.bincount(p.page, weights=n, minlength=size), 1)})


def score(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", counts: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_words, link_words, stuffed_words, code_words, bits: one row a document, words being runs of letters or digits.

    Null, blank and wordless texts have 0 of everything. Repeated deliveries of an id count once; equal texts get
    equal rows. ``counts`` are those of ``train``, by default over ``documents``. Other columns are not carried.
    """
    pages = materialize(sequences(documents, doc_id, text), "stuffing-pages")
    counts = train(pages) if counts is None else counts
    kind = documents.schema[doc_id].dataType.simpleString()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(counts)
        for batch in batches:
            yield pd.concat([batch[["doc_id", "n_words", "link_words", "code_words"]], judge(batch, model)], axis=1)

    schema = f"doc_id {kind}, n_words int, link_words int, code_words int, stuffed_words int, bits double"
    rows = pages.mapInPandas(each, schema).select("doc_id", "n_words", "link_words", "stuffed_words", "code_words", "bits")
    return rows.dropDuplicates(["doc_id"])


def stuffed(documents: DataFrame, **names: str) -> DataFrame:
    """doc_id of the documents of which more than half of the words are keywords, links, navigation or tags."""
    return score(documents, **names).where(2 * (F.col("link_words") + F.col("stuffed_words")) > F.col("n_words")).select("doc_id")
