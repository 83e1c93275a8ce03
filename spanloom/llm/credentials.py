"""Finding and redacting usable credentials in source, configuration and notes (problem 2).

A text is read for names that hold secrets and the literals given to them, for literals that carry their own
mark, and for key armour. Literals that are base64, hex, percent or backslash encoded are decoded and read
again, layer by layer, and binary layers are parsed as key containers by their grammar. A finding in a layer
is redacted as the whole literal that encloses it, and nothing else of the text changes.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Generator, Iterator
from typing import NamedTuple
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.session import spread

MARK = "REDACTED"

# Words of names that hold secrets, words that make a name hold something about one, and literals that stand for none.
SECRET_WORDS = frozenset("password passwd passphrase pwd pass secret secrets token tokens credential credentials apikey authtoken".split())
KEY_OWNERS = frozenset("api access signing secret private auth encryption client webhook deploy ssh account master shared service".split())
ABOUT_WORDS = frozenset(
    "env var variable file filename path dir name names id ids url uri endpoint type kind count size length len min max policy rule rules field column header prefix suffix hash digest checksum fingerprint regex"
    " pattern format ttl expiry expires expiration lifetime age limit index hint label title error errors message manager provider store storage factory class reset required optional enabled strength validator version ref".split()
)
PLACEHOLDERS = frozenset(
    "changeme change_me change-me replaceme replace_me replace-me redacted placeholder none null nil true false undefined password passwd secret token string str bytes required optional todo tbd fixme dummy default unset empty".split()
)
#: Names of query parameters whose value is a credential.
QUERY_NAMES = r"(?:[\w-]*(?:token|api_?-?key|access_?-?key|secret|passwd|password|signature)|sig|key|auth)"

#: Parts of the names and words that a finding by name begins with; a short one must not have letters around it.
_TRIGGERS = ("passw", "passphrase", "secret", "token", "credential", "authorization", "login", "bearer")
_SHORT_TRIGGERS = ("pass", "pwd", "key")
_LITERAL = r"(?P<q>\"\"\"|'''|[\"'`])(?P<v>(?:\\.|(?!(?P=q))[^\\])*?)(?P=q)"
_ASSIGNED = re.compile(
    r"[\"'`]?\]?[ \t]*(?:\??[ \t]*:[ \t]*(?:[Ss]tring|str|bytes|any|Optional\[str\]|Final(?:\[str\])?|SecretStr|const char ?\*)[ \t]*=|:=|=>|={1,3}|:|,)[ \t]*(?:[({][ \t]*)?(?:\r?\n[ \t]*)?(?:[rbfuRBFU]{1,2}(?=[\"']))?" + _LITERAL,
    re.S,
)
_FALLBACK = re.compile(r"[\"'`]?\]?\)?[ \t]*(?:\|\||\?\?|\bor\b)[ \t]*(?:\r?\n[ \t]*)?" + _LITERAL)
_BARE = re.compile(r"(?P<s>=|[ \t]*:[ \t]+|[ \t]*=[ \t]*)(?P<v>[^\s\"'`,;(){}\[\]#|>&*!][^\s\"'`,;(){}\[\]]*)[ \t]*(?:#[^\n]*)?(?:\r?$)", re.M)
_BARE_LEAD = re.compile(r"[ \t]*(?:-[ \t]+)?(?:export[ \t]+|set[ \t]+)?[\w.-]*$")
_SCHEME = re.compile(r"(?i)bearer|basic|token")
_BEARER = re.compile(r"(?i)(?:bearer|basic|token)[ \t]+(?P<v>[^\s\"'`<>]+)")
_SPOKEN = re.compile(r"(?:[ \t]+(?:is|was|=))?[ \t]*[:=]?[ \t]*(?P<o>[`\"'(]?)(?P<v>[^\s`\"'(),]+)")
_LOGIN = re.compile(r"\([ \t]*([\"'])[^\"'\n]*\1[ \t]*,[ \t]*(?P<q>[\"'])(?P<v>[^\"'\n]+)(?P=q)")
_COMMENT = re.compile(r"(?:^|[\s;,)\]}\"'])(?://|#|--|/\*|<!--)|^\s*[*>]")
_PROSE_PATH = re.compile(r"\.(?:md|markdown|rst|txt|adoc|html?)$", re.I)
_URL_USER = re.compile(r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]*+://[^\s:/@\"'`<>]*:(?P<v>[^\s/@\"'`<>]+)@")
_DSN = re.compile(r"(?<![\w:/.-])[\w.-]++:(?P<v>[^\s:@/\"'`(){}<>]+)@(?:tcp|udp|unix)?\(")
_QUERY = re.compile(r"[?&]" + QUERY_NAMES + r"=(?P<v>[^&\s\"'`<>)#\\]+)", re.I)
_CURL = re.compile(r"\bcurl\b")
_CURL_USER = re.compile(r"\s(?:-u|--user)[ \t]+[\"']?[\w.@-]+:(?P<v>[^\s\"']+)")
_JWT = re.compile(r"(?<![\w.-])eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{16,}")
_PREFIXED = re.compile(r"(?<![\w./+=-])(?!(?:sha|md)\d)[a-z]{2,8}(?:[_-](?:[a-z]{2,8}[_-])?|\.)(?P<r>[A-Za-z0-9][A-Za-z0-9_-]{15,})(?![\w/+=])")
_KNOWN = re.compile(r"(?<![\w])(?:AKIA|ASIA)[A-Z0-9]{16}(?![\w])|(?<![\w])gh[pousr]_[A-Za-z0-9]{30,}|(?<![\w])xox[abprs]-[\w-]{10,}|(?<![\w])sk-[A-Za-z0-9_-]{20,}|(?<![\w])AIza[\w-]{35}")
_ARMOUR = re.compile(r"-----BEGIN (?P<k>(?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----(?P<b>(?:(?!-----BEGIN).)*?)(?:-----END (?P=k)-----|\Z)", re.S)
_RUN = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{24,}+={0,2}(?![A-Za-z0-9+/=_-])")
_SHORT_RUN = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{12,23}+={0,2}(?![A-Za-z0-9+/=_-])")
_ESCAPES = re.compile(r"(?:\\x[0-9A-Fa-f]{2}){8,}+|(?:\\u[0-9A-Fa-f]{4}){8,}+")
_PERCENT = re.compile(r"(?<![\w.~/:@!*()+&-])(?:[\w.~/:@!*()+&=-]*+%[0-9A-Fa-f]{2}){3,}[\w.~/:@!*()+&=-]*")
#: Text inside of a binary layer.
_INNER_TEXT = re.compile(rb"[\t\r\n\x20-\x7e]{8,}+")
_PUTTY = re.compile(r"PuTTY-User-Key-File-\d:[^\n]*\n(?:(?!Private-Lines:)[^\n]*\n)*?Private-Lines:[ \t]*\d+\r?\n(?P<v>(?:[A-Za-z0-9+/=]+\r?(?:\n|\Z))+)")
#: Percent signs that were encoded so often that a layer would take off only one step of many; 16 of them are kept.
_CHAIN = re.compile(r"%(?:25){17,}+")
#: Bytes that an encoded run may hold stay, all others become spaces.
_RUN_BYTES = bytes(b if chr(b).isalnum() and b < 128 or chr(b) in "+/_-" else 32 for b in range(256))
def _base64_cores(words: tuple[str, ...]) -> tuple[str, ...]:
    """What base64 makes of words wherever they stand, without the letters that depend on what is around them."""
    out = set()
    for word in {f(w) for w in words for f in (str.lower, str.upper, str.capitalize)}:
        for ahead in range(3):
            coded = base64.b64encode(b"\0" * ahead + word.encode()).decode().rstrip("=")
            whole = len(word) + ahead
            out.add(coded[-(-ahead * 8 // 6) : whole * 8 // 6])
    return tuple(sorted(out))


#: Short runs are decoded where they can hold one of these words.
_CORES = _base64_cores(("passw", "secret", "token", "api_key", "apikey", "pwd="))
_KNOWN_MARKS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk-", "AIza")
_STRINGS = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`\n]*`")
_JOINED_WORDS = re.compile(r"[A-Z]{0,5}[a-z]+(?:[A-Z]{1,5}[a-z]{3,})*[A-Z]{0,5}")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_SAID_SECRET = re.compile(r"(?i)\b(?:password|passwd|passphrase|secret|token|credential|(?:api|access|signing|private)[ _-]?key)\b(?!\s+(?:comes?|is read|is kept|lives?|stays?|from|is in|not)\b)")


class Finding(NamedTuple):
    """A value at text[start:end]; ``kind`` names how it was told, ``layers`` the encodings around it, outermost first."""

    start: int
    end: int
    kind: str
    layers: tuple[str, ...] = ()


def holds_secret(name: str) -> bool:
    """Whether a name is that of a variable, key or field that holds a secret itself."""
    words = [w.lower() for w in _WORDS.findall(name)]
    while words and words[-1].isdigit():
        words.pop()
    if not words or words[-1] in ABOUT_WORDS:
        return False
    if any(w in SECRET_WORDS for w in words):
        return not (words[0] in ("no", "has", "is", "needs", "reset", "max", "min", "num") and len(words) > 1)
    return words[-1] in ("key", "auth") and (len(words) > 1 and words[-2] in KEY_OWNERS or words == ["auth"])


def _classes(v: str) -> tuple[int, int, int]:
    """(kinds of characters, changes between kinds, groups of digits)."""
    kinds = v.translate({ord(c): "d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in set(v)})
    # Counted by pairs, as values may be long.
    changes = {a + b: kinds.count(a + b) for a in "duls" for b in "duls" if a != b}
    return len(set(kinds)), sum(changes.values()), kinds.startswith("d") + changes["ud"] + changes["ld"] + changes["sd"]


def is_random(v: str) -> bool:
    """Whether a literal looks drawn rather than named."""
    if len(v) < 12:
        return False
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", v):
        return len(v) >= 24 and not v.isdigit()
    kinds, changes, digits = _classes(v)
    return digits >= 2 and kinds >= 2 and changes >= 0.3 * len(v)


def is_placeholder(v: str) -> bool:
    """Whether a literal stands for a value that is elsewhere: a reference, a template, a mask or a word to be replaced."""
    low = v.lower()
    if len(v) < 6 or low in PLACEHOLDERS or len(set(low)) <= 2:
        return True
    if re.search(r"\$\{|\{\{|\$\(|%\(|<[^<>]*>|%[A-Z_]+%|\{[A-Za-z_][\w.]*\}|\.\.\.", v) or v[0] == "$":
        return True
    if re.fullmatch(r"[xX*.•_#?-]+", v) or re.match(r"(?i)(?:your|my|some|insert|enter|replace|change|put|add)[-_ ]", v) or re.search(r"(?i)placeholder|changeme|replace[-_ ]?me|redacted|not[-_ ]?a[-_ ]?real", v):
        return True
    return bool(re.fullmatch(r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+", v)) or " " in v.strip() and not re.search(r"\d", v)


def is_usable(v: str) -> bool:
    """Whether a literal given to a secret's name can be used as it stands."""
    if is_placeholder(v) or re.match(r"(?i)(?:sha\d+|md5)[:-]", v) or re.match(r"[a-z][a-z0-9+.-]*://", v) or re.match(r"\.{0,2}/[\w./-]+$", v):
        return False
    if re.search(r"\s", v) and len(v.split()) > 3:
        return False
    kinds, changes, digits = _classes(v)
    if is_random(v):
        return True
    if re.fullmatch(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+(?:\(\))?", v) and digits < 2:
        return False
    if v.isascii() and v.isalpha():
        # Letters alone are drawn if they change case where no name of joined words does.
        return len(v) >= 10 and changes >= 4 and not _JOINED_WORDS.fullmatch(v)
    if re.fullmatch(r"[a-z]+(?:[-_. ][a-z]+)*", v):
        return False
    return digits >= 1 and kinds >= 2 or kinds >= 3 and changes >= 3


def _der(data: bytes, at: int = 0) -> tuple[int, int, int] | None:
    """(tag, start, end) of the value of the DER element at ``at``."""
    if at + 2 > len(data):
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > len(data):
            return None
        n, at = int.from_bytes(data[at : at + k], "big"), at + k
    return (tag, at, at + n) if at + n <= len(data) else None


def _elements(data: bytes, start: int, end: int) -> list[tuple[int, int, int]]:
    out = []
    while start < end and (e := _der(data, start)) and e[2] <= end:
        out.append(e)
        start = e[2]
    return out if start == end else []


def _key_store(data: bytes) -> str | None:
    """Whether a Java key store holds a private or secret key: its entries are walked to the first one."""
    if len(data) < 12 or int.from_bytes(data[4:8], "big") not in (1, 2):
        return None
    version, entries, at = data[7], int.from_bytes(data[8:12], "big"), 12

    def skip(at: int, width: int) -> int:
        return at + width + int.from_bytes(data[at : at + width], "big")

    for _ in range(entries):
        tag, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        at = skip(at, 2) + 8
        if at >= len(data):
            return None
        if tag in (1, 3):
            return "jks"
        if tag != 2:
            return None
        at = skip(skip(at, 2) if version == 2 else at, 4)
    return None


def _secret_packet(data: bytes) -> bool:
    """Whether ``data`` begins with an OpenPGP secret key or subkey packet of a known version and algorithm."""
    if data[0] & 0x40:
        tag = data[0] & 0x3F
        if len(data) < 3:
            return False
        n = data[1]
        length, at = (n, 2) if n < 192 else ((n - 192 << 8) + data[2] + 192, 3) if n < 224 else (int.from_bytes(data[2:6], "big"), 6) if n == 255 else (1 << n - 224, 2)
    else:
        tag, width = data[0] >> 2 & 0x0F, (1, 2, 4, 0)[data[0] & 3]
        length, at = (int.from_bytes(data[1 : 1 + width], "big"), 1 + width) if width else (len(data) - 1, 1)
    return tag in (5, 7) and 20 <= length <= len(data) - at and data[at] in (3, 4, 5, 6) and data[at + 5] in (1, 2, 3, 16, 17, 18, 19, 22, 25, 26, 27, 28)


def container(data: bytes) -> str | None:
    """The kind of private key container that ``data`` is, by its grammar: PKCS#1, PKCS#8 plain or encrypted, SEC1, PKCS#12, OpenSSH, Java key store or OpenPGP."""
    if data.startswith(b"openssh-key-v1\0"):
        at = 15
        for _ in range(3):
            if at + 4 > len(data):
                return None
            at += 4 + int.from_bytes(data[at : at + 4], "big")
        return "openssh" if at + 4 <= len(data) else None
    if data[:4] in (bytes.fromhex("feedfeed"), bytes.fromhex("cececece")):
        return _key_store(data)
    if data and data[0] & 0x80 and _secret_packet(data):
        return "pgp"
    outer = _der(data)
    if not outer or outer[0] != 0x30 or outer[2] != len(data):
        return None
    parts = _elements(data, outer[1], outer[2])
    tags = [t for t, _, _ in parts]
    whole = [data[a:b] for _, a, b in parts]
    if tags[:1] == [0x02] and len(tags) >= 9 and set(tags[:9]) == {0x02}:
        return "pkcs1"
    if tags[:3] == [0x02, 0x30, 0x04] and whole[0] in (b"\0", b"\1"):
        return "pkcs8"
    if tags[:2] == [0x02, 0x04] and whole[0] == b"\1":
        return "sec1"
    if tags[:2] == [0x02, 0x30] and whole[0] == b"\3":
        return "pkcs12"
    if tags == [0x30, 0x04]:
        algorithm = _elements(data, parts[0][1], parts[0][2])
        if algorithm and algorithm[0][0] == 0x06 and data[algorithm[0][1] : algorithm[0][2]].startswith(bytes.fromhex("2a864886f70d0105")):
            return "pkcs8-encrypted"
    return None


def decodings(literal: str) -> Iterator[tuple[str, bytes]]:
    """Every reading of a literal as an encoding, with its bytes."""
    if literal.startswith("\\x"):
        yield "escape", bytes.fromhex(literal.replace("\\x", ""))
    elif literal.startswith("\\u"):
        yield "escape", "".join(chr(int(x, 16)) for x in literal.split("\\u")[1:]).encode("utf-8", "replace")
    elif "%" in literal:
        yield "percent", unquote_to_bytes(_CHAIN.sub("%" + "25" * 16, literal))
    else:
        if len(literal) % 2 == 0 and re.fullmatch(r"[0-9a-fA-F]+", literal):
            yield "hex", bytes.fromhex(literal)
        body = literal.rstrip("=")
        if len(body) % 4 != 1:
            try:
                yield "base64", base64.b64decode(body + "=" * (-len(body) % 4), altchars=b"-_" if "-" in body or "_" in body else None, validate=True)
            except (binascii.Error, ValueError):
                pass


def _encoded(text: str) -> Iterator[re.Match]:
    """The runs of ``text`` that may be encoded."""
    data = text.encode("utf-8", "replace")
    if any(len(w) >= 24 for w in data.translate(_RUN_BYTES).split()):
        yield from _RUN.finditer(text)
    if any(core in text for core in _CORES):
        yield from (m for m in _SHORT_RUN.finditer(text) if any(core in m[0] for core in _CORES))
    if "\\x" in text or "\\u" in text:
        yield from _ESCAPES.finditer(text)
    if "%" in text:
        yield from _PERCENT.finditer(text)


def _readable(data: bytes) -> str | None:
    """``data`` as text if it is text, else the runs of text in it, a line each."""
    try:
        text = data.decode("utf-8")
        if sum(c.isprintable() or c in "\r\n\t" for c in text) >= 0.97 * len(text):
            return text
    except UnicodeDecodeError:
        pass
    return "\n".join(m[0].decode("ascii") for m in _INNER_TEXT.finditer(data)) or None


def _armour_body(body: str) -> str:
    return re.sub(r"\\[rn]|[\s\"'+\\]", "", re.sub(r"^[A-Za-z-]+:[^\n]*$", "", body, flags=re.M))


def _trailing(text: str, line_start: int, at: int) -> list[tuple[int, int]]:
    """The literals of the statement that ends before a trailing comment at ``at``, as spans of their contents."""
    code = text[line_start:at]
    strings = [(line_start + m.start() + 1, line_start + m.end() - 1) for m in _STRINGS.finditer(code)]
    rest = _STRINGS.sub("", code)
    if strings and not re.fullmatch(r"[\s\w.:=+(),;\[\]{}>$-]*", rest):
        return []
    if not strings and not re.fullmatch(r"[\s)\];,}]*", rest):
        return []
    # Lines above that hold nothing but literals belong to the same value.
    if not re.search(r"=|:|\breturn\b", rest):
        end = line_start - 1
        while end > 0:
            begin = text.rfind("\n", 0, end) + 1
            line = text[begin:end]
            found = list(_STRINGS.finditer(line))
            if not found or _STRINGS.sub("", line).strip(" \t\r+\\,()"):
                break
            strings = [(begin + m.start() + 1, begin + m.end() - 1) for m in found] + strings
            end = begin - 1
    return strings


def _join_following(text: str, end: int) -> list[tuple[int, int]]:
    """Spans of further literals that a literal ending at ``end`` is joined with."""
    out = []
    more = re.compile(r"[ \t]*(?:\+[ \t]*(?:\r?\n[ \t]*)?|\\?\r?\n[ \t]*(?:\+[ \t]*)?)(?:[rbfu]{1,2}(?=[\"']))?(?P<s>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')")
    while m := more.match(text, end):
        after = re.match(r"[ \t]*:", text[m.end() : m.end() + 4])
        if after:
            break
        out.append((m.start("s") + 1, m.end("s") - 1))
        end = m.end()
    return out


def _curl_users(text: str) -> Iterator[re.Match]:
    """The users with passwords that are given to a curl before them on their line; each stretch of a line is searched once."""
    at = 0
    for m in _CURL_USER.finditer(text):
        at = max(at, text.rfind("\n", at, m.start()) + 1)
        if _CURL.search(text, at, m.start()):
            yield m
            at = m.end()
        else:
            at = m.start()


def scan(text: str, path: str | None = None) -> list[Finding]:
    """Every credential in ``text`` and its layers, however deep, without overlaps, in order."""
    # The layers wait on a list, as they may be deeper than calls can.
    waiting, result = [_scan(text, path)], None
    while waiting:
        try:
            inner = waiting[-1].send(result)
        except StopIteration as done:
            waiting.pop()
            result = done.value
        else:
            waiting.append(_scan(inner, None))
            result = None
    return result


def _scan(text: str, path: str | None) -> Generator[str, list[Finding], list[Finding]]:
    """The findings of ``text``; each readable layer is yielded, and its findings are sent back."""
    found: list[Finding] = []
    add = found.append
    if "-----BEGIN " in text:
        for m in _ARMOUR.finditer(text):
            body = _armour_body(m["b"])
            if len(body) >= 40 and re.match(r"[A-Za-z0-9+/=]{40}", body):
                add(Finding(m.start(), m.end(), "private key"))
    if "PuTTY-User-Key-File" in text:
        for m in _PUTTY.finditer(text):
            if len(m["v"]) >= 32:
                add(Finding(m.start("v"), m.end("v"), "private key"))
    if "@" in text:
        for rule in (_URL_USER, _DSN):
            for m in rule.finditer(text):
                v = m["v"]
                if not is_placeholder(v) and re.search(r"\d|[A-Z]", v):
                    add(Finding(m.start("v"), m.end("v"), "url"))
    if "?" in text or "&" in text:
        for m in _QUERY.finditer(text):
            if is_usable(m["v"]) and (len(m["v"]) >= 12):
                add(Finding(m.start("v"), m.end("v"), "url"))
    if "eyJ" in text:
        for m in _JWT.finditer(text):
            add(Finding(m.start(), m.end(), "token"))
    if any(k in text for k in _KNOWN_MARKS):
        for m in _KNOWN.finditer(text):
            if not is_placeholder(m[0]):
                add(Finding(m.start(), m.end(), "token"))
    for m in _PREFIXED.finditer(text):
        r = m["r"]
        kinds, changes, digits = _classes(r.replace("_", "").replace("-", ""))
        if kinds >= 3 and digits >= 2 and changes >= 0.35 * len(r) and not is_placeholder(m[0]):
            add(Finding(m.start(), m.end(), "token"))
    if "curl" in text:
        for m in _curl_users(text):
            if is_usable(m["v"]):
                add(Finding(m.start("v"), m.end("v"), "password"))
    _named(text, path, found)
    for m in _encoded(text):
        if any(f.start < m.end() and m.start() < f.end for f in found):
            continue
        for how, data in decodings(m[0]):
            kind = container(data)
            if kind:
                add(Finding(m.start(), m.end(), f"private key ({kind})", (how,)))
                break
            inner = _readable(data)
            if inner and (below := (yield inner)):
                add(Finding(m.start(), m.end(), below[0].kind, (how, *below[0].layers)))
                break
    found.sort(key=lambda f: (f.start, -f.end))
    out: list[Finding] = []
    for f in found:
        if out and f.start < out[-1].end:
            continue
        out.append(f)
    return out


def _triggers(text: str, lower: str) -> Iterator[tuple[int, int]]:
    """Where a name or word that may hold a secret begins and ends, at least in part."""
    for word in _TRIGGERS:
        at = lower.find(word)
        while at >= 0:
            yield at, at + len(word)
            at = lower.find(word, at + len(word))
    for word in _SHORT_TRIGGERS:
        at = lower.find(word)
        while at >= 0:
            end = at + len(word)
            left = at == 0 or not text[at - 1].isalpha() or text[at].isupper() and text[at - 1].islower()
            right = end == len(text) or not text[end].isalpha() or text[end].isupper() and text[end - 1].islower()
            if left and right:
                yield at, end
            at = lower.find(word, end)


def _named(text: str, path: str | None, found: list[Finding]) -> None:
    """Findings by the name or the words beside a literal."""
    prose = bool(path and _PROSE_PATH.search(path))
    seen: set[int] = set()
    lower = text.lower()
    if len(lower) != len(text):
        lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    for a, b in _triggers(text, lower):
        while a and (text[a - 1].isalnum() or text[a - 1] in "_$-"):
            a -= 1
        while b < len(text) and (text[b].isalnum() or text[b] in "_$-"):
            b += 1
        if a in seen:
            continue
        seen.add(a)
        name = text[a:b]
        low = name.lower()
        if low in ("authorization", "bearer", "proxy-authorization"):
            # Only the scheme must be near; the value has no greatest length.
            k = next((k for w in _SCHEME.finditer(text, a, b + 17) if w.start() - b < 12 and (k := _BEARER.match(text, w.start()))), None)
            if k and "\n" not in text[b : k.start()]:
                v = k["v"]
                if text[k.start() : k.start() + 5].lower() == "basic":
                    pair = next((_readable(d) for _, d in decodings(v)), None)
                    if pair and ":" in pair and not is_placeholder(pair.split(":", 1)[1]):
                        found.append(Finding(k.start("v"), k.end("v"), "password", ("base64",)))
                elif is_usable(v):
                    found.append(Finding(k.start("v"), k.end("v"), "token"))
            continue
        if low == "login":
            k = _LOGIN.match(text, b)
            if k and is_usable(k["v"]):
                found.append(Finding(k.start("v"), k.end("v"), "password"))
                continue
        line_start = text.rfind("\n", 0, a) + 1
        secret = holds_secret(name)
        if secret:
            k = _ASSIGNED.match(text, b) or _FALLBACK.match(text, b)
            if k:
                spans = [(k.start("v"), k.end("v")), *_join_following(text, k.end())]
                v = "".join(text[s:e] for s, e in spans)
                lead = re.match(r"(?:Bearer|Basic|Token)[ \t]+", v)
                if is_usable(v[lead.end() :] if lead else v):
                    for i, (s, e) in enumerate(spans):
                        found.append(Finding(s + (lead.end() if lead and not i else 0), e, "literal" if not i else "joined"))
                continue
            k = _BARE.match(text, b)
            if k and _BARE_LEAD.match(text, line_start, a) and _BARE_LEAD.match(text[line_start:a]) and is_usable(k["v"]):
                strict = k["s"] == "=" or ":" in k["s"] or path and re.search(r"\.(?:env|ini|cfg|conf|properties)\b", path)
                if strict and not re.search(r"[(){};]", k["v"]):
                    found.append(Finding(k.start("v"), k.end("v"), "literal"))
                    continue
        comment = _COMMENT.search(text[line_start:a])
        if comment and comment.end() < a - line_start or prose or comment:
            end = text.find("\n", b)
            end = len(text) if end < 0 else end
            k = _SPOKEN.match(text, b, end)
            if k and (secret or low in ("login", "key", "password", "pass")):
                v = k["v"].rstrip(".;:!?") if not k["o"] else k["v"]
                if is_usable(v) and (is_random(v) or re.search(r"\d", v) and re.search(r"[A-Za-z]", v) and len(v) >= 8) and not re.search(r"[/\\]\w+\.\w+$|^[\w-]+/[\w-]+$", v):
                    found.append(Finding(k.start("v"), k.start("v") + len(v), "spoken"))
                    continue
            if comment and text[line_start : line_start + comment.start()].strip() and _SAID_SECRET.search(text[line_start:end], comment.start()):
                spans = _trailing(text, line_start, line_start + comment.start())
                if spans and is_usable("".join(text[s:e] for s, e in spans)):
                    for i, (s, e) in enumerate(spans):
                        found.append(Finding(s, e, "literal" if not i else "joined"))


def redact(text: str, findings: list[Finding]) -> str:
    """``text`` with every finding replaced by MARK and the line ends that it held."""
    out, at = [], 0
    for f in findings:
        out += [text[at : f.start], MARK, "".join(re.findall(r"\r?\n", text[f.start : f.end]))]
        at = f.end
    return "".join([*out, text[at:]])


def _schema(df: DataFrame, key: str) -> str:
    return df.schema[key].dataType.simpleString()


def find(df: DataFrame, key: str = "fragment_id", text: str = "text", path: str = "path", start: str = "start_line") -> DataFrame:
    """One row a credential: key, line_no (original line on which its value begins), kind, layers (joined by >), value_start, value_end.

    Offsets are in code points of the text. Null and empty texts give no row, a null start line counts as 1.
    Repeated deliveries of a key, and equal rows, give their rows once. Other columns are not carried.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t, p, s in batch.itertuples(index=False):
                for f in scan(t, p):
                    if f.kind != "joined":
                        rows.append((k, s + t.count("\n", 0, f.start), f.kind, ">".join(f.layers), f.start, f.end))
            yield pd.DataFrame(rows, columns=[key, "line_no", "kind", "layers", "value_start", "value_end"])

    rows = spread(df).where(F.length(F.col(text)) > 0).select(F.col(key), F.col(text).alias("_t"), F.col(path).cast("string").alias("_p"), F.coalesce(F.col(start).cast("int"), F.lit(1)).alias("_s"))
    return rows.mapInPandas(each, f"{key} {_schema(df, key)}, line_no int, kind string, layers string, value_start int, value_end int").dropDuplicates([key, "value_start"])


def redacted(df: DataFrame, key: str = "fragment_id", text: str = "text", path: str = "path") -> DataFrame:
    """The records that hold credentials, each once: key, n_values, redacted_text. All others stay as they are and give no row."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t, p in batch.itertuples(index=False):
                findings = scan(t, p)
                if findings:
                    rows.append((k, sum(f.kind != "joined" for f in findings), redact(t, findings)))
            yield pd.DataFrame(rows, columns=[key, "n_values", "redacted_text"])

    rows = spread(df).where(F.length(F.col(text)) > 0).select(F.col(key), F.col(text).alias("_t"), F.col(path).cast("string").alias("_p"))
    return rows.mapInPandas(each, f"{key} {_schema(df, key)}, n_values int, redacted_text string").dropDuplicates([key])
