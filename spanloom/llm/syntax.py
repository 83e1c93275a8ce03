"""Lexical state of source chunks, and the local grammars of balanced statements.

A chunk of lines is a map from the lexical state before it to the state after it, with a summary of its
brackets: what it closes of what came before and what it leaves open. Both compose associatively, so chunks of
one file may be read anywhere and in any order, and a file is balanced if the composition of all is neutral.
Between neutral points lie whole statements, which the grammar of the language decides one by one.
"""

from __future__ import annotations

import ast
import json
import re
import sys
import tomllib
import warnings
from dataclasses import dataclass
from functools import reduce

from spanloom.llm.grammar_brace import GoParser, ScriptParser
from spanloom.llm.grammar_yaml import yaml_error

#: Language of each extension.
LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "go": "go", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml"}

#: Lexical states at the start of a line, by language; ``code`` is where a file begins and must end.
STATES = {
    "python": ("code", "'''", '"""'),
    "toml": ("code", "'''", '"""'),
    "javascript": ("code", "*/", "`"),
    "typescript": ("code", "*/", "`"),
    "go": ("code", "*/", "`"),
    "json": ("code",),
}
_SHORT = r"\"(?:[^\"\\\n]|\\(?:\r\n|[\s\S]))*+\"|'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*+'"
_SCAN = {
    "python": re.compile(r"\"\"\"|'''|#[^\n]*|" + _SHORT + r"|[()\[\]{}\"']"),
    "toml": re.compile(r"\"\"\"|'''|#[^\n]*|\"(?:[^\"\\\n]|\\.)*+\"|'[^'\n]*+'|[\[\]{}\"']"),
    "javascript": re.compile(
        r"//[^\n]*|/\*|`|" + _SHORT + r"|(?:(?<=[=(,:\[!&|?{};+>])|(?<=return))[ \t]*/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/\w*|[()\[\]{}\"']"
    ),
    "go": re.compile(r"//[^\n]*|/\*|`|\"(?:[^\"\\\n]|\\.)*+\"|'(?:\\.[0-9a-fA-F]*|[^'\\\n])'|[()\[\]{}\"']"),
    "json": re.compile(r"\"(?:[^\"\\\n]|\\.)*+\"|[\[\]{}\"]"),
}
_SCAN["typescript"] = _SCAN["javascript"]
#: Where a regular expression may stand is the grammar's matter, so an unbalanced scan of these languages is confirmed by it;
#: JSON and TOML are decided by their readers alone, at every size.
CONFIRMED = ("javascript", "typescript", "json", "toml")
_PAIR = {")": "(", "]": "[", "}": "{"}
_LONG = {"python": ('"""', "'''"), "toml": ('"""', "'''"), "javascript": ("/*", "`"), "typescript": ("/*", "`"), "go": ("/*", "`"), "json": ()}


@dataclass(frozen=True)
class Summary:
    """State after a chunk, the brackets it closes of what came before, those it leaves open, and whether it is broken within."""

    state: str
    closes: str = ""
    opens: str = ""
    broken: bool = False


def _end_of_long(text: str, at: int, mark: str, language: str) -> int:
    """End of a long literal or comment that is open at ``at``; -1 if it goes on."""
    if mark == "*/" or language == "go":
        end = text.find(mark, at)
        return end + len(mark) if end >= 0 else -1
    if language == "toml" and mark == "'''":
        end = text.find(mark, at)
        return end + 3 if end >= 0 else -1
    while True:
        end = text.find(mark, at)
        if end < 0:
            return -1
        slashes = 0
        while end - slashes > at and text[end - slashes - 1] == "\\":
            slashes += 1
        if slashes % 2 == 0:
            return end + len(mark)
        at = end + 1


def summarise(chunk: str, language: str, state: str = "code") -> Summary:
    """Read a chunk from one state."""
    closes, opens, broken, at = "", [], False, 0
    scan = _SCAN[language]
    while True:
        if state != "code":
            end = _end_of_long(chunk, at, state, language)
            if end < 0:
                return Summary(state, closes, "".join(opens), broken)
            at, state = end, "code"
        m = scan.search(chunk, at)
        if not m:
            return Summary("code", closes, "".join(opens), broken)
        t, at = m[0], m.end()
        if t in _LONG[language]:
            state = "*/" if t == "/*" else t
        elif t in ("(", "[", "{"):
            opens.append(t)
        elif t in _PAIR:
            if not opens:
                closes += t
            elif opens.pop() != _PAIR[t]:
                broken = True
        elif t in ('"', "'"):
            broken = True


def state_map(chunk: str, language: str) -> dict[str, Summary]:
    """Read a chunk from every state."""
    return {s: summarise(chunk, language, s) for s in STATES[language]}


def join(a: Summary, b: Summary) -> Summary:
    """The summary of two chunks, the second of which was read from the first one's state."""
    opens, closes, broken = a.opens, b.closes, a.broken or b.broken
    while closes and opens:
        broken |= opens[-1] != _PAIR[closes[0]]
        opens, closes = opens[:-1], closes[1:]
    return Summary(b.state, a.closes + closes, opens + b.opens, broken)


def compose(a: dict[str, Summary], b: dict[str, Summary]) -> dict[str, Summary]:
    """The map of two neighbouring chunks; associative."""
    return {s: join(x, b[x.state]) for s, x in a.items()}


def chunks(text: str, size: int) -> list[str]:
    """Parts of whole lines, each as long as it must be to reach ``size`` characters."""
    out, at = [], 0
    while at < len(text):
        end = text.find("\n", min(len(text), at + size) - 1)
        end = len(text) if end < 0 else end + 1
        out.append(text[at:end])
        at = end
    return out


def balanced(text: str, language: str, size: int = 1 << 16) -> bool:
    """Whether the composition of all chunks of a text is neutral."""
    if language not in STATES or not text:
        return True
    whole = reduce(compose, (state_map(c, language) for c in chunks(text, size))) if len(text) > size else {"code": summarise(text, language)}
    s = whole["code"]
    return s.state == "code" and not s.closes and not s.opens and not s.broken


# Reserved words that a name cannot stand for.
_PYTHON_WORDS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type print exec _"
_SCRIPT_WORDS = (
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield let static async await of get set"
    " implements interface package private protected public readonly abstract declare namespace module type as from is keyof infer asserts satisfies unique any unknown never string number boolean object symbol bigint constructor require override target meta"
)
_GO_WORDS = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"


def _names(words: str, letters: str) -> re.Pattern[str]:
    # A dollar sign before a brace opens a hole of a template and is no part of a name.
    return re.compile(rf"(?<![\w$])(?!(?:{'|'.join(words.split())})(?![\w$])|\$\{{)[{letters}](?:\w|\$(?!\{{))*+")


_NAMES = {"python": _names(_PYTHON_WORDS, "A-Za-z_"), "javascript": _names(_SCRIPT_WORDS, "A-Za-z_$"), "go": _names(_GO_WORDS, "A-Za-z_")}
_NAMES["typescript"] = _NAMES["javascript"]
_COUNTS = re.compile(r"(?<![\w.])[1-9]\d*+(?![\w.])")
_PLAIN_STRING = {
    "python": re.compile(r"(?<![\"'\\\w])(?:\"\"\"[^\"\\]*+\"\"\"|'''[^'\\]*+'''|\"[^\"\\\n]++\"(?!\")|'[^'\\\n]++'(?!'))"),
    "javascript": re.compile(r"(?<![\\\w])\"[^\"\\\n]*+\"|(?<![\\\w])'[^'\\\n`]*+'"),
    "go": re.compile(r"(?<![\\'\w])\"[^\"\\\n]*+\""),
}
_PLAIN_STRING["typescript"] = _PLAIN_STRING["javascript"]
#: Comments, once plain strings are gone; where one stands in another literal, the form is not accepted and the text is read as a whole.
_NOTE = {"python": re.compile(r"[ \t]*#[^\n]*"), "javascript": re.compile(r"[ \t]*(?://[^\n]*|/\*(?:(?!\*/)[^\n])*+\*/)"), "go": re.compile(r"[ \t]*//[^\n]*")}
_NOTE["typescript"] = _NOTE["javascript"]
_BLANK = re.compile(r"\n\s*\n")
_TOP = {
    "python": re.compile(r"\n(?=[^\s)\]}#@'\"])(?!(?:else|elif|except|finally)\b)"),
    "javascript": re.compile(r"\n(?=[^\s)\]}/`*.?:|&+-])"),
    "go": re.compile(r"\n(?=(?:func|type|var|const)\b)"),
}
_TOP["typescript"] = _TOP["javascript"]

#: Verdicts of statements by their form; emptied when full, which only costs time.
_SEEN: dict[tuple[str, str], bool] = {}
_SEEN_LIMIT = 100_000


#: Calls that a grammar may be deep in a nested text; the interpreter's own limit is for other programs.
DEEPEST = 1_000_000


def _deep(rule, *args) -> object:
    """The rule's result, with room for nested texts if the usual depth of calls does not do."""
    try:
        return rule(*args)
    except RecursionError:
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(DEEPEST)
        try:
            return rule(*args)
        finally:
            sys.setrecursionlimit(limit)


def _grammar(text: str, language: str) -> bool:
    """Whether the local grammar accepts a text as a list of statements."""
    try:
        if language == "python":
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text)
        elif language == "go":
            _deep(lambda: GoParser(text).parse_part())
        else:
            _deep(lambda: ScriptParser(text, typed=language == "typescript").parse())
    except (SyntaxError, ValueError, RecursionError, MemoryError, IndexError):
        return False
    return True


def _symbols_ok(text: str) -> bool:
    """Whether a Python text whose statements are accepted also keeps the rules of names and of where a statement may stand."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(text, "text", "exec", dont_inherit=True)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


_JSON_TOKEN = re.compile(r"[ \t\r\n]*(?:(?P<mark>[\[\]{},:])|(?P<string>\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*+\")|(?P<plain>true|false|null|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?))")


def _deep_json(text: str) -> bool:
    """Whether a text that is nested beyond the reader's depth is JSON: one pass with a stack."""
    stack: list[str] = []
    # What may come next: a value, a value or the end of an array, a key, a key or the end of an object, or what follows a value.
    state, at = "value", 0
    while m := _JSON_TOKEN.match(text, at):
        at, mark = m.end(), m["mark"]
        if mark is None or mark in "[{":
            if state in ("key", "first key"):
                if m["string"] is None or not (colon := re.compile(r"[ \t\r\n]*:").match(text, at)):
                    return False
                at, state = colon.end(), "value"
                continue
            if state == "after":
                return False
            if mark is None:
                state = "after"
            else:
                stack.append(mark)
                state = "first value" if mark == "[" else "first key"
        elif mark in "]}":
            if not stack or (stack.pop() == "[") != (mark == "]") or state not in ("after", "first value" if mark == "]" else "first key"):
                return False
            state = "after"
        elif mark == ",":
            if state != "after" or not stack:
                return False
            state = "value" if stack[-1] == "[" else "key"
        else:
            return False
    return state == "after" and not stack and not text[at:].strip(" \t\r\n")


def _form(part: str, language: str) -> str:
    """A statement with names, plain strings and counts made alike, which no grammar tells apart."""
    part = _NOTE[language].sub("", _PLAIN_STRING[language].sub('"s"', part))
    return _COUNTS.sub("1", _NAMES[language].sub("a", _BLANK.sub("\n", part).strip("\n")))


def _accepted(form: str, language: str) -> bool:
    key = (language, form)
    known = _SEEN.get(key)
    if known is None:
        if len(_SEEN) >= _SEEN_LIMIT:
            _SEEN.clear()
        known = _SEEN[key] = _grammar(form, language)
    return known


def _statements(text: str, language: str) -> bool:
    """Whether all top statements of a text are accepted one by one."""
    parts = _TOP[language].split(text)
    if language == "go":
        # The head has the package clause and the imports.
        return GoParser.head_ok(parts[0]) and all(_accepted(_form(p, language), language) for p in parts[1:])
    held = ""
    for p in parts:
        p = f"{held}\n{p}" if held else p
        # A decorator belongs to what follows it.
        held = p if p.rstrip().rpartition("\n")[2].startswith("@") else ""
        if not held and not _accepted(_form(p, language), language):
            return False
    return not held or _accepted(_form(held, language), language)


def _no_constant(name: str) -> None:
    raise ValueError(name)


def is_valid(text: str, language: str) -> bool:
    """Whether a whole text is valid in a language."""
    if language == "json":
        if text.startswith("\ufeff"):
            return False
        try:
            json.loads(text, parse_constant=_no_constant)
        except RecursionError:
            return _deep_json(text)
        except ValueError:
            return False
        return True
    if language == "toml":
        try:
            _deep(tomllib.loads, text)
        except (ValueError, RecursionError):
            return False
        return True
    if language == "yaml":
        return _deep(yaml_error, text) is None
    if "\0" in text:
        return False
    # The summaries of the chunks come first; balanced texts are then decided statement by statement, by its form,
    # once for all texts that hold the like; what does not stand alone is read as a whole.
    if not balanced(text, language):
        return language in CONFIRMED and _grammar(text, language)
    if language == "python":
        # Names and places are the whole text's matter, so accepted statements are only half of it.
        return (_statements(text, language) or _grammar(text, language)) and _symbols_ok(text)
    if _statements(text, language):
        return True
    if language != "go":
        return _grammar(text, language)
    try:
        _deep(lambda: GoParser(text).parse())
    except (SyntaxError, RecursionError, IndexError):
        return False
    return True
