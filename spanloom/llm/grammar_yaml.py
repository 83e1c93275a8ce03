"""A line grammar of YAML block and flow structure, which decides whether a text is accepted."""

from __future__ import annotations

import re

_DOCUMENT = re.compile(r"(?:---|\.\.\.)(?=[ \t]|$)")
_BLOCK_SCALAR = re.compile(r"[|>](?:[+-]?[1-9]?|[1-9][+-])[ \t]*(?:(?<=[ \t])#.*)?$")
_PROPERTY = re.compile(r"(?:&[^\s,\[\]{}]+|![^\s,\[\]{}]*(?:<[^>\s]*>)?)(?:[ \t]+|$)")
_ALIAS = re.compile(r"\*[^\s,\[\]{}]+")
_DOUBLE = re.compile(r'"(?:[^"\\]|\\.)*+"', re.S)
_SINGLE = re.compile(r"'(?:[^']|'')*+'(?!')", re.S)
_ESCAPE = re.compile(r"\\(?:[0abt\tnvfre \"/\\N_LP\n]|\r\n|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|(.))", re.S)
_COLON = re.compile(r":(?=[ \t]|$)")
_REMARK = re.compile(r"[ \t]#")
_REST = re.compile(r"[ \t]*(?:$|(?<=[ \t])#.*$)")
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\ud800-\udfff\ufffe\uffff]")


class _Error(Exception):
    pass


class _Reader:
    def __init__(self, lines: list[str]):
        self.lines = lines
        self.indent: list[int] = []
        self.text: list[str] = []
        for x in lines:
            body = x.lstrip(" ")
            self.indent.append(len(x) - len(body))
            self.text.append(body.rstrip("\r"))

    def next(self, i: int) -> int:
        """Index of the next line with content."""
        while i < len(self.text):
            t = self.text[i]
            s = t.lstrip(" \t")
            if s and s[0] != "#":
                if t[0] == "\t":
                    raise _Error("tab in indentation")
                return i
            i += 1
        return i

    def document(self) -> None:
        i = self.next(0)
        if i >= len(self.text):
            return
        i = self.next(self.node(i, -1))
        if i < len(self.text):
            raise _Error("content after the document's node")

    def node(self, i: int, parent: int) -> int:
        """Read the node whose first line is ``i``; the line after it."""
        n, t = self.indent[i], self.text[i]
        if t == "-" or t.startswith(("- ", "-\t")):
            return self.sequence(i, n)
        if t == "?" or t.startswith("? ") or self.key(t) is not None:
            return self.mapping(i, n)
        return self.value(i, t, n, parent)

    def sequence(self, i: int, n: int) -> int:
        while i < len(self.text) and self.indent[i] == n and (self.text[i] == "-" or self.text[i].startswith(("- ", "-\t"))):
            rest = self.text[i][1:]
            body = rest.lstrip(" \t")
            if not body or body[0] == "#":
                j = self.next(i + 1)
                i = self.node(j, n) if j < len(self.text) and self.indent[j] > n else j
            else:
                if "\t" in rest[: len(rest) - len(body)] and (body.startswith("- ") or self.key(body) is not None):
                    raise _Error("tab before a nested block")
                self.indent[i], self.text[i] = n + 1 + len(rest) - len(body), body
                i = self.node(i, n)
            i = self.next(i)
        if i < len(self.text) and self.indent[i] > n:
            raise _Error("indentation")
        return i

    def mapping(self, i: int, n: int) -> int:
        while i < len(self.text) and self.indent[i] == n:
            t = self.text[i]
            if t == "?" or t.startswith("? "):
                body = t[1:].lstrip(" ")
                if body:
                    self.indent[i], self.text[i] = n + len(t) - len(body), body
                    i = self.next(self.node(i, n))
                else:
                    j = self.next(i + 1)
                    i = self.node(j, n) if j < len(self.text) and self.indent[j] > n else j
                    i = self.next(i)
                if i < len(self.text) and self.indent[i] == n and (self.text[i] == ":" or self.text[i].startswith(": ")):
                    body = self.text[i][1:].lstrip(" ")
                    i = self.after_key(i, body, n, n + len(self.text[i]) - len(body))
                i = self.next(i)
                continue
            if t == "-" or t.startswith("- "):
                raise _Error("entry in a mapping")
            k = self.key(t)
            if k is None:
                raise _Error("no colon after a key")
            i = self.next(self.after_key(i, t[k:].lstrip(" \t"), n, n + k))
        if i < len(self.text) and self.indent[i] > n:
            raise _Error("indentation")
        return i

    def after_key(self, i: int, rest: str, n: int, column: int) -> int:
        m = _PROPERTY.match(rest)
        while m:
            rest = rest[m.end() :]
            m = _PROPERTY.match(rest)
        if not rest or rest[0] == "#":
            j = self.next(i + 1)
            if j < len(self.text) and (self.indent[j] > n or self.indent[j] == n and (self.text[j] == "-" or self.text[j].startswith("- "))):
                if self.indent[j] == n:
                    return self.sequence(j, n)
                return self.node(j, n)
            return j
        if rest == "-" or rest.startswith("- "):
            raise _Error("entry on the line of a key")
        return self.value(i, rest, column, n, True)

    def key(self, t: str) -> int | None:
        """End of the colon of a key that begins ``t``."""
        at = 0
        m = _PROPERTY.match(t)
        while m:
            at = m.end()
            m = _PROPERTY.match(t, at)
        body = t[at:]
        if not body:
            return None
        c = body[0]
        if c in "\"'":
            m = (_DOUBLE if c == '"' else _SINGLE).match(t, at)
            if not m or "\n" in m[0]:
                return None
            m = re.compile(r"[ \t]*:(?=[ \t]|$)").match(t, m.end())
            return m.end() if m else None
        if c in "[{":
            level = 0
            for k in range(at, len(t)):
                level += (t[k] in "[{") - (t[k] in "]}")
                if not level:
                    m = re.compile(r"[ \t]*:(?=[ \t]|$)").match(t, k + 1)
                    return m.end() if m else None
            return None
        if c == "*":
            m = _ALIAS.match(t, at)
            m = m and re.compile(r"[ \t]+:(?=[ \t]|$)").match(t, m.end())
            return m.end() if m else None
        if c in ",]}#|>%@`" or c in "-?" and (len(body) == 1 or body[1] in " \t"):
            return None
        m = _COLON.search(t, at)
        remark = _REMARK.search(t, at)
        if not m or remark and remark.start() < m.start():
            return None
        if len(t[:m.start()]) > 1024:
            return None
        return m.end()

    def value(self, i: int, t: str, column: int, parent: int, inline: bool = False) -> int:
        """Read a scalar, flow collection or alias that begins with ``t`` on line ``i``; the line after it."""
        m = _PROPERTY.match(t)
        while m:
            t = t[m.end() :]
            m = _PROPERTY.match(t)
        if not t or t[0] == "#":
            j = self.next(i + 1)
            return self.node(j, parent) if j < len(self.text) and self.indent[j] > parent else j
        c = t[0]
        if c in "|>":
            if not _BLOCK_SCALAR.match(t):
                raise _Error("block scalar header")
            return self.block_scalar(i + 1, parent)
        if c in "\"'":
            return self.rest_of_line(*self.quoted(i, t))
        if c in "[{":
            return self.rest_of_line(*self.flow(i, t))
        if c == "*":
            m = _ALIAS.match(t)
            if not m or not _REST.match(t, m.end()):
                raise _Error("alias")
            return i + 1
        if c in ",]}#%@`&!" or c in "-?:" and (len(t) == 1 or t[1] in " \t"):
            raise _Error("character that begins no token")
        return self.plain(i, t, parent)

    def plain(self, i: int, t: str, parent: int) -> int:
        first = True
        while True:
            remark = _REMARK.search(t)
            said = t[: remark.start()] if remark else t
            if _COLON.search(said):
                raise _Error("mapping values are not allowed here" if first else "key inside a scalar")
            i += 1
            if remark:
                return i
            j = i
            while j < len(self.text) and not self.text[j].strip(" \t"):
                j += 1
            if j >= len(self.text) or self.indent[j] <= parent or self.text[j].lstrip("\t")[0] == "#":
                return j
            i, t, first = j, self.text[j], False

    def block_scalar(self, i: int, parent: int) -> int:
        least = None
        while i < len(self.text):
            if not self.text[i].strip(" "):
                i += 1
                continue
            if self.indent[i] <= parent:
                return i
            if least is None:
                least = self.indent[i]
            if self.indent[i] < least:
                return i
            i += 1
        return i

    def rest_of_line(self, i: int, t: str) -> int:
        if not _REST.match(t):
            raise _Error("text after a value")
        return i + 1

    def quoted(self, i: int, t: str) -> tuple[int, str]:
        """Line and rest of it after the quoted scalar that ``t`` begins with."""
        rule = _DOUBLE if t[0] == '"' else _SINGLE
        m = rule.match(t)
        if not m:
            # The scalar goes on; look for the first line that has its end.
            whole, j = [t], i
            while not m:
                j += 1
                if j >= len(self.text):
                    raise _Error("end of a quoted scalar")
                whole.append(self.text[j])
                if t[0] in self.text[j]:
                    m = rule.match("\n".join(whole))
            i, t = j, "\n".join(whole)
        if t[0] == '"' and any(x for x in _ESCAPE.findall(m[0])):
            raise _Error("escape")
        return i, t[m.end() :].rsplit("\n", 1)[-1] if "\n" in t[m.end() :] else t[m.end() :]

    def flow(self, i: int, t: str) -> tuple[int, str]:
        """Line and rest of it after the flow collection that ``t`` begins with."""
        stack: list[str] = []
        # What may come: v a value, o after a value, s after the start or a comma.
        want = "s"
        while True:
            t = t.lstrip(" \t")
            if not t or t[0] == "#":
                i += 1
                if i >= len(self.text):
                    raise _Error("end of a flow collection")
                t = self.text[i]
                continue
            c = t[0]
            if c in "[{":
                if want == "o":
                    raise _Error("comma expected")
                stack.append(c)
                want, t = "s", t[1:]
            elif c in "]}":
                if not stack or stack.pop() != {"]": "[", "}": "{"}[c]:
                    raise _Error("bracket")
                want, t = "o", t[1:]
                if not stack:
                    return i, t
            elif c == ",":
                if want == "s":
                    raise _Error("empty entry")
                want, t = "s", t[1:]
            elif c == ":" and (len(t) == 1 or t[1] in " \t,]}" or want == "o"):
                want, t = "v", t[1:]
            elif c == "?" and (len(t) == 1 or t[1] in " \t"):
                t = t[1:]
            elif want == "o":
                raise _Error("comma expected")
            elif c in "\"'":
                i, t = self.quoted(i, t)
                want = "o"
            elif c in "&!":
                m = _PROPERTY.match(t)
                t = t[m.end() :] if m else t[1:]
                want = "v" if want == "s" else want
            elif c == "*":
                m = _ALIAS.match(t)
                if not m:
                    raise _Error("alias")
                want, t = "o", t[m.end() :]
            elif c in "|>%@`" or c == "-" and (len(t) == 1 or t[1] in " \t"):
                raise _Error("character that begins no token")
            else:
                m = re.compile(r"(?:[^,\[\]{}:#]|:(?![ \t,\[\]{}]|$)|(?<![ \t])#)+").match(t)
                if not m:
                    raise _Error("plain scalar")
                t = t[m.end() :]
                want = "o"
                # A plain scalar may go on in the next lines.
                while not t.strip(" \t") and i + 1 < len(self.text):
                    k = i + 1
                    body = self.text[k].lstrip(" \t")
                    m = re.compile(r"(?:[^,\[\]{}:#]|:(?![ \t,\[\]{}]|$)|(?<![ \t])#)+").match(body) if body and body[0] not in "\"'#&*!|>%@`?" else None
                    if not m:
                        break
                    i, t = k, body[m.end() :]


def yaml_error(text: str) -> str | None:
    """Why a text is not accepted, or None."""
    bad = _CONTROL.search(text)
    if bad:
        return "control character"
    documents: list[list[str]] = [[]]
    for line in text.removeprefix("\ufeff").replace("\r\n", "\n").split("\n"):
        m = _DOCUMENT.match(line)
        if m:
            rest = line[m.end() :]
            documents.append([" " * m.end() + rest] if rest.strip() and not rest.strip().startswith("#") else [])
        elif line.startswith("%") and not any(x.strip() for x in documents[-1]):
            continue
        else:
            documents[-1].append(line)
    try:
        for lines in documents:
            _Reader(lines).document()
    except _Error as e:
        return str(e)
    return None
