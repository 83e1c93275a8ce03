"""Recursive-descent grammars of ECMAScript with its typed extension, and of Go.

They decide whether a text is accepted and build nothing. Precedence does not matter for that, so binary
operators are read as a flat series of operands.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    """kind: name, word, number, string, template, regex, mark or end; nl tells of a line end before it."""

    kind: str
    text: str
    nl: bool
    holes: tuple[str, ...] = ()


_ID = r"[^\W\d][\w$\u200c\u200d]*|[$][\w$\u200c\u200d]*"
_SPACE = re.compile(r"(?:[ \t\r\n\v\f\u00a0\ufeff\u2028\u2029]+|//[^\n]*|/\*.*?\*/)+", re.S)
_SCRIPT_TOKEN = re.compile(
    r"(?P<name>#?(?:[^\W\d]|[$]|\\u[0-9a-fA-F]{4})(?:[\w$\u200c\u200d]|\\u[0-9a-fA-F]{4})*)"
    r"|(?P<number>0[xX][0-9a-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?)"
    r"|(?P<string>\"(?:[^\"\\\n]|\\(?:\r\n|.))*\"|'(?:[^'\\\n]|\\(?:\r\n|.))*')"
    r"|(?P<mark>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@])",
    re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
)
_OPERAND_WORDS = frozenset("return typeof case in of delete void throw new instanceof else do await yield extends".split())
_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_BINARY = frozenset("+ - * / % ** << >> >>> < > <= >= == != === !== & | ^ && || ??".split())


def script_tokens(text: str) -> list[Token]:
    out: list[Token] = []
    at, nl, n = 0, False, len(text)
    if text.startswith("#!"):
        at = text.find("\n")
        at = n if at < 0 else at
    last = None
    # Of each open parenthesis whether it is the head of a statement, behind which an operand may start.
    depth: list[bool] = []
    head = False
    while True:
        m = _SPACE.match(text, at)
        if m:
            nl |= "\n" in m[0] or "\u2028" in m[0]
            at = m.end()
        if at >= n:
            out.append(Token("end", "", nl))
            return out
        c = text[at]
        if c == "`":
            end, holes = _template(text, at)
            out.append(last := Token("template", "", nl, holes))
            at, nl = end, False
            continue
        if c == "/" and (last is None or (last.kind == "mark" and last.text not in (")", "]", "}", "++", "--")) or (last.kind == "word" and last.text in _OPERAND_WORDS) or last.text == "}" or (head and last.kind == "mark" and last.text == ")")):
            m = _REGEX.match(text, at)
            if m:
                out.append(last := Token("regex", m[0], nl))
                at, nl = m.end(), False
                continue
        m = _SCRIPT_TOKEN.match(text, at)
        if not m:
            raise SyntaxError(f"character at {at}")
        kind = m.lastgroup
        t = m[0]
        if kind == "number" and (m.end() < n and (text[m.end()].isalnum() or text[m.end()] in "_$") or re.fullmatch(r"0\d+[.eE].*|.*_", t)):
            raise SyntaxError(f"number at {at}")
        if kind == "name" and (t in RESERVED or t in ("await", "yield", "of", "let", "async")):
            kind = "word"
        if t == "(":
            k = -2 if out and out[-1].text == "await" else -1
            depth.append(len(out) >= -k and out[k].kind == "word" and out[k].text in (("for",) if k == -2 else ("if", "while", "for", "with")) and not (len(out) > -k and out[k - 1].text in (".", "?.")))
        elif t == ")":
            head = bool(depth) and depth.pop()
        out.append(last := Token(kind, t, nl))
        at, nl = m.end(), False


def _template(text: str, at: int) -> tuple[int, tuple[str, ...]]:
    """End of the template that begins at ``at`` and the texts of its holes."""
    holes, i, n = [], at + 1, len(text)
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
        elif c == "`":
            return i + 1, tuple(holes)
        elif c == "$" and text.startswith("${", i):
            begin, level = i + 2, 1
            i += 2
            while i < n and level:
                c = text[i]
                if c == "`":
                    i, _ = _template(text, i)
                    continue
                if c in "\"'":
                    m = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'").match(text, i)
                    if not m:
                        raise SyntaxError("string in template")
                    i = m.end()
                    continue
                level += (c == "{") - (c == "}")
                i += 1
            if level:
                raise SyntaxError("template")
            holes.append(text[begin : i - 1])
        else:
            i += 1
    raise SyntaxError("template")


class Place(NamedTuple):
    """Whether a statement lies in a function, in a loop and in a switch of it, and below which labels."""

    function: bool = False
    loop: bool = False
    switch: bool = False
    labels: tuple[str, ...] = ()


class ScriptParser:
    """Accepts a program, or raises SyntaxError."""

    def __init__(self, text: str, typed: bool = False):
        self.t = script_tokens(text)
        self.i = 0
        self.typed = typed
        self.no_in = False
        self.place = Place()
        #: Marks that were taken apart, to be put together again where an attempt fails.
        self.cut: list[tuple[int, Token]] = []

    # -- tokens -----------------------------------------------------------------------------------
    def fail(self) -> None:
        raise SyntaxError(f"{self.t[self.i].text!r} at token {self.i}")

    def at(self, *texts: str) -> bool:
        t = self.t[self.i]
        return t.text in texts and t.kind in ("mark", "word", "name")

    def look(self, k: int = 1) -> Token:
        return self.t[min(self.i + k, len(self.t) - 1)]

    def take(self, *texts: str) -> bool:
        if self.at(*texts):
            self.i += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            self.fail()

    def close_angle(self) -> None:
        """Take one > of a mark that begins with it."""
        t = self.t[self.i]
        if t.kind != "mark" or t.text[:1] != ">":
            self.fail()
        if len(t.text) == 1:
            self.i += 1
        else:
            self.cut.append((self.i, t))
            self.t[self.i] = Token("mark", t.text[1:], False)

    def name(self) -> None:
        t = self.t[self.i]
        if t.kind == "name" and t.text[0] != "#" or t.kind == "word" and t.text not in RESERVED:
            self.i += 1
        else:
            self.fail()

    def any_name(self) -> None:
        if self.t[self.i].kind in ("name", "word"):
            self.i += 1
        else:
            self.fail()

    def semicolon(self) -> None:
        if self.take(";") or self.at("}") or self.t[self.i].kind == "end" or self.t[self.i].nl:
            return
        self.fail()

    def attempt(self, rule) -> bool:
        i, n, no_in, place = self.i, len(self.cut), self.no_in, self.place
        try:
            rule()
            return True
        except (SyntaxError, IndexError):
            self.i, self.no_in, self.place = i, no_in, place
            while len(self.cut) > n:
                at, token = self.cut.pop()
                self.t[at] = token
            return False

    def within(self, place: Place, rule) -> None:
        """Read a rule at another place; a failed attempt puts the place back itself."""
        saved, self.place = self.place, place
        rule()
        self.place = saved

    # -- statements -------------------------------------------------------------------------------
    def parse(self) -> None:
        while self.t[self.i].kind != "end":
            self.statement()

    def block(self) -> None:
        self.need("{")
        while not self.take("}"):
            if self.t[self.i].kind == "end":
                self.fail()
            self.statement()

    def statement(self) -> None:
        t = self.t[self.i]
        x = t.text
        if t.kind == "mark":
            if x == "{":
                return self.block()
            if x == ";":
                self.i += 1
                return None
            if x == "@":
                self.decorators()
                self.take("export")
                self.take("default")
                self.take("abstract")
                if not self.at("class"):
                    self.fail()
                return self.statement()
        if t.kind in ("word", "name"):
            rule = getattr(self, f"_{x}", None) if x.isalpha() and x in _STATEMENTS else None
            if rule:
                return rule()
            if x == "let" and (self.look().kind == "name" or self.look().text in ("[", "{", "await", "yield", "of", "async", "as", "type")):
                return self._let()
            if x == "async" and self.look().text == "function" and not self.look().nl:
                self.i += 1
                return self._function()
            if self.typed:
                n = self.look()
                if x in ("interface", "type", "enum", "namespace", "module", "declare", "abstract", "global") and not n.nl and self.typed_statement(x, n):
                    return None
            if self.look().text == ":" and self.look().kind == "mark" and (t.kind == "name" or x not in RESERVED):
                self.i += 2
                return self.within(self.place._replace(labels=(*self.place.labels, x)), self.statement)
        self.expression()
        self.semicolon()
        return None

    def decorators(self) -> None:
        while self.take("@"):
            if self.take("("):
                self.expression()
                self.need(")")
                continue
            self.name()
            while self.take("."):
                self.any_name()
            if self.at("("):
                self.arguments()

    def variables(self) -> None:
        while True:
            self.binding()
            if self.typed and self.take("!"):
                pass
            if self.typed and self.take(":"):
                self.type()
            if self.take("="):
                self.assignment()
            if not self.take(","):
                return

    def binding(self) -> None:
        if self.take("["):
            while not self.take("]"):
                if self.take(","):
                    continue
                self.take("...")
                self.binding()
                if self.take("="):
                    self.assignment()
                if not self.at("]"):
                    self.need(",")
        elif self.take("{"):
            while not self.take("}"):
                if self.take("..."):
                    self.binding()
                else:
                    simple = self.t[self.i].kind in ("name", "word")
                    self.property_name()
                    if self.take(":"):
                        self.binding()
                    elif not simple:
                        self.fail()
                    if self.take("="):
                        self.assignment()
                if not self.at("}"):
                    self.need(",")
        else:
            self.name()

    def _var(self) -> None:
        self.i += 1
        self.variables()
        self.semicolon()

    _let = _var

    def _const(self) -> None:
        self.i += 1
        if self.typed and self.at("enum"):
            self.i += 1
            return self.enum()
        self.variables()
        self.semicolon()
        return None

    def _function(self) -> None:
        self.need("function")
        self.take("*")
        self.name()
        self.signature_and_body()

    def signature_and_body(self) -> None:
        if self.typed and self.at("<"):
            self.type_parameters()
        self.parameters()
        if self.typed and self.take(":"):
            self.type(predicate=True)
        if self.typed and not self.at("{"):
            return self.semicolon()
        return self.within(Place(function=True), self.block)

    def parameters(self) -> None:
        self.need("(")
        while not self.take(")"):
            if self.at("@"):
                self.decorators()
            if self.typed:
                while self.at("public", "private", "protected", "readonly", "override") and (self.look().kind in ("name", "word") or self.look().text in ("{", "[")):
                    self.i += 1
            rest = self.take("...")
            if self.typed and self.at("this"):
                self.i += 1
            else:
                self.binding()
            if self.typed and self.take("?"):
                pass
            if self.typed and self.take(":"):
                self.type()
            if self.take("="):
                self.assignment()
            if not self.at(")"):
                self.need(",")
                if rest:
                    self.fail()

    def _class(self) -> None:
        self.need("class")
        if not self.at("{", "extends", "implements"):
            self.name()
        self.class_tail()

    def class_tail(self) -> None:
        if self.typed and self.at("<"):
            self.type_parameters()
        if self.take("extends"):
            self.left_hand()
            if self.typed and self.at("<"):
                self.type_arguments()
        if self.typed and self.take("implements"):
            self.type()
            while self.take(","):
                self.type()
        self.need("{")
        while not self.take("}"):
            if self.take(";"):
                continue
            if self.t[self.i].kind == "end":
                self.fail()
            self.member()

    def member(self) -> None:
        if self.at("@"):
            self.decorators()
        if self.at("static") and self.look().text == "{":
            self.i += 1
            return self.within(Place(), self.block)
        modifiers = {"static", "async", "get", "set", "accessor"} | ({"public", "private", "protected", "readonly", "abstract", "override", "declare"} if self.typed else set())
        while self.t[self.i].text in modifiers and self.t[self.i].kind in ("name", "word") and (self.look().kind in ("name", "word", "string", "number") or self.look().text in ("[", "*", "{") and self.look().text != "{") and not (self.look().nl and self.t[self.i].text not in ("public", "private", "protected", "readonly", "static", "abstract")):
            self.i += 1
        self.take("*")
        if self.typed and self.at("[") and self.look().kind == "name" and self.look(2).text == ":":
            self.index_signature()
            return self.semicolon()
        self.property_name()
        if self.typed and (self.take("?") or self.take("!")):
            pass
        if self.at("(") or self.typed and self.at("<"):
            return self.signature_and_body()
        if self.typed and self.take(":"):
            self.type()
        if self.take("="):
            self.assignment()
        return self.semicolon()

    def property_name(self) -> None:
        t = self.t[self.i]
        if self.take("["):
            self.assignment_in()
            self.need("]")
        elif t.kind in ("name", "word", "string", "number"):
            self.i += 1
        else:
            self.fail()

    def condition(self) -> None:
        self.need("(")
        self.expression_in()
        self.need(")")

    def _if(self) -> None:
        self.i += 1
        self.condition()
        self.statement()
        if self.take("else"):
            self.statement()

    def loop(self) -> None:
        self.within(self.place._replace(loop=True), self.statement)

    def _while(self) -> None:
        self.i += 1
        self.condition()
        self.loop()

    def _with(self) -> None:
        self.i += 1
        self.condition()
        self.statement()

    def _do(self) -> None:
        self.i += 1
        self.loop()
        self.need("while")
        self.condition()
        self.take(";")

    def _for(self) -> None:
        self.i += 1
        self.take("await")
        self.need("(")
        self.no_in = True
        try:
            if self.at("var", "const") or self.at("let") and (self.look().kind == "name" or self.look().text in ("[", "{", "of", "async")):
                self.i += 1
                self.variables()
            elif not self.at(";"):
                self.expression()
        finally:
            self.no_in = False
        if self.take("of"):
            self.assignment()
        elif self.take("in"):
            self.expression()
        else:
            self.need(";")
            if not self.at(";"):
                self.expression()
            self.need(";")
            if not self.at(")"):
                self.expression()
        self.need(")")
        self.loop()

    def _switch(self) -> None:
        self.i += 1
        self.condition()
        self.within(self.place._replace(switch=True), self.cases)

    def cases(self) -> None:
        self.need("{")
        while not self.take("}"):
            if self.take("case"):
                self.expression()
            else:
                self.need("default")
            self.need(":")
            while not self.at("case", "default", "}"):
                if self.t[self.i].kind == "end":
                    self.fail()
                self.statement()

    def _try(self) -> None:
        self.i += 1
        self.block()
        handled = False
        if self.take("catch"):
            handled = True
            if self.take("("):
                self.binding()
                if self.typed and self.take(":"):
                    self.type()
                self.need(")")
            self.block()
        if self.take("finally"):
            handled = True
            self.block()
        if not handled:
            self.fail()

    def _throw(self) -> None:
        self.i += 1
        if self.t[self.i].nl:
            self.fail()
        self.expression()
        self.semicolon()

    def _return(self) -> None:
        if not self.place.function:
            self.fail()
        self.i += 1
        if not (self.at(";", "}") or self.t[self.i].nl or self.t[self.i].kind == "end"):
            self.expression()
        self.semicolon()

    def leave(self, allowed: bool) -> None:
        self.i += 1
        t = self.t[self.i]
        if t.kind == "name" and not t.nl:
            allowed = t.text in self.place.labels
            self.i += 1
        if not allowed:
            self.fail()
        self.semicolon()

    def _break(self) -> None:
        self.leave(self.place.loop or self.place.switch)

    def _continue(self) -> None:
        self.leave(self.place.loop)

    def _debugger(self) -> None:
        self.i += 1
        self.semicolon()

    def _import(self) -> None:
        if self.look().text in ("(", "."):
            self.expression()
            return self.semicolon()
        self.i += 1
        if self.t[self.i].kind == "string":
            self.i += 1
        else:
            if self.typed and self.at("type") and (self.look().kind == "name" and self.look().text != "from" or self.look().text in ("{", "*")):
                self.i += 1
            if self.t[self.i].kind in ("name", "word"):
                self.name()
                if self.typed and self.take("="):
                    self.left_hand()
                    return self.semicolon()
                if not self.at("from"):
                    self.need(",")
            if self.take("*"):
                self.need("as")
                self.name()
            elif self.at("{"):
                self.specifiers()
            self.need("from")
            if self.t[self.i].kind != "string":
                self.fail()
            self.i += 1
        if self.take("with", "assert"):
            self.object()
        return self.semicolon()

    def specifiers(self) -> None:
        self.need("{")
        while not self.take("}"):
            if self.typed and self.at("type") and (self.look().kind in ("name", "word") and self.look().text != "as"):
                self.i += 1
            if self.t[self.i].kind == "string":
                self.i += 1
            else:
                self.any_name()
            if self.take("as"):
                if self.t[self.i].kind == "string":
                    self.i += 1
                else:
                    self.any_name()
            if not self.at("}"):
                self.need(",")

    def _export(self) -> None:
        self.i += 1
        if self.take("default"):
            if self.at("function") or self.at("async") and self.look().text == "function":
                self.take("async")
                self.i += 1
                self.take("*")
                if not self.at("(", "<"):
                    self.name()
                return self.signature_and_body()
            if self.at("class") or self.typed and self.at("abstract") and self.look().text == "class":
                self.take("abstract")
                return self._class()
            if self.typed and self.at("interface"):
                return self.statement()
            self.assignment()
            return self.semicolon()
        if self.typed and self.take("="):
            self.expression()
            return self.semicolon()
        if self.typed and self.at("type") and self.look().text in ("{", "*"):
            self.i += 1
        if self.take("*"):
            if self.take("as"):
                self.any_name()
            self.need("from")
            if self.t[self.i].kind != "string":
                self.fail()
            self.i += 1
            return self.semicolon()
        if self.at("{"):
            self.specifiers()
            if self.take("from"):
                if self.t[self.i].kind != "string":
                    self.fail()
                self.i += 1
            return self.semicolon()
        if self.at("var", "let", "const", "function", "async", "class", "@") or self.typed and self.at("interface", "type", "enum", "namespace", "module", "declare", "abstract", "import"):
            return self.statement()
        return self.fail()

    # -- typed statements -------------------------------------------------------------------------
    def typed_statement(self, x: str, n: Token) -> bool:
        if x == "declare" and n.kind in ("name", "word"):
            self.i += 1
            self.statement()
        elif x == "abstract" and n.text == "class":
            self.i += 1
            self._class()
        elif x == "interface" and n.kind == "name":
            self.i += 1
            self.name()
            if self.at("<"):
                self.type_parameters()
            if self.take("extends"):
                self.type()
                while self.take(","):
                    self.type()
            self.object_type()
        elif x == "type" and n.kind == "name":
            self.i += 1
            self.name()
            if self.at("<"):
                self.type_parameters()
            self.need("=")
            self.type()
            self.semicolon()
        elif x == "enum" and n.kind == "name":
            self.i += 1
            self.enum()
        elif x in ("namespace", "module") and n.kind in ("name", "string") or x == "global" and n.text == "{":
            self.i += 1
            if x != "global":
                self.i += 1
                while self.take("."):
                    self.name()
            if self.at("{"):
                self.block()
            else:
                self.semicolon()
        else:
            return False
        return True

    def enum(self) -> None:
        self.name()
        self.need("{")
        while not self.take("}"):
            self.property_name()
            if self.take("="):
                self.assignment()
            if not self.at("}"):
                self.need(",")

    # -- types ------------------------------------------------------------------------------------
    def type_parameters(self) -> None:
        self.need("<")
        while True:
            while self.at("const", "in", "out") and self.look().kind in ("name", "word"):
                self.i += 1
            self.name()
            if self.take("extends"):
                self.type()
            if self.take("="):
                self.type()
            if not self.take(",") or self.t[self.i].text[:1] == ">":
                break
        self.close_angle()

    def type_arguments(self) -> None:
        self.need("<")
        while True:
            self.type()
            if not self.take(",") or self.t[self.i].text[:1] == ">":
                break
        self.close_angle()

    def type(self, predicate: bool = False) -> None:
        if predicate and self.at("asserts") and self.look().kind in ("name", "word") and not self.look().nl:
            self.i += 1
        if predicate and (self.t[self.i].kind == "name" or self.at("this")) and self.look().text == "is" and not self.look().nl:
            self.i += 2
        self.union_type()
        if self.at("extends") and not self.t[self.i].nl and not self.no_conditional():
            self.i += 1
            self.union_type()
            self.need("?")
            self.type()
            self.need(":")
            self.type()

    def no_conditional(self) -> bool:
        return False

    def union_type(self) -> None:
        self.take("|", "&")
        self.postfix_type()
        while self.take("|", "&"):
            self.postfix_type()

    def postfix_type(self) -> None:
        inferred = False
        while self.at("keyof", "readonly", "unique", "infer") and (self.look().kind in ("name", "word", "string", "template") or self.look().text in ("(", "[", "{")) and not self.look().nl:
            inferred = self.at("infer")
            self.i += 1
        self.primary_type()
        if inferred and self.at("extends"):
            self.attempt(self.bound)
        while self.at("[") and not self.t[self.i].nl:
            self.i += 1
            if not self.take("]"):
                self.type()
                self.need("]")

    def bound(self) -> None:
        """The bound of an inferred name; before a question mark ``extends`` begins a condition instead."""
        self.i += 1
        self.union_type()
        if self.at("?"):
            self.fail()

    def primary_type(self) -> None:
        t = self.t[self.i]
        if self.at("new", "abstract") and self.look().text in ("(", "<", "new"):
            self.i += 1
            return self.primary_type()
        if self.at("<"):
            self.type_parameters()
            self.parameters()
            self.need("=>")
            return self.type(predicate=True)
        if self.at("("):

            def function() -> None:
                self.parameters()
                self.need("=>")
                self.type(predicate=True)

            if self.attempt(function):
                return None
            self.i += 1
            self.type()
            return self.need(")")
        if self.at("{"):
            return self.object_type()
        if self.take("["):
            while not self.take("]"):
                self.take("...")
                if self.t[self.i].kind == "name" and (self.look().text == ":" or self.look().text == "?" and self.look(2).text == ":"):
                    self.i += 1
                    self.take("?")
                    self.need(":")
                self.type()
                self.take("?")
                if not self.at("]"):
                    self.need(",")
            return None
        if self.take("-"):
            if self.t[self.i].kind != "number":
                self.fail()
            self.i += 1
            return None
        if t.kind in ("string", "number"):
            self.i += 1
            return None
        if t.kind == "template":
            self.i += 1
            for hole in t.holes:
                inner = ScriptParser(hole, True)
                inner.type()
                if inner.t[inner.i].kind != "end":
                    self.fail()
            return None
        if self.take("typeof"):
            if self.take("import"):
                self.arguments()
            else:
                self.any_name()
        elif self.take("import"):
            self.arguments()
        elif self.take("this", "void", "null", "true", "false"):
            pass
        else:
            self.name()
        while self.at(".") and self.look().kind in ("name", "word"):
            self.i += 2
        if self.at("<") and not self.t[self.i].nl:
            self.type_arguments()
        return None

    def index_signature(self) -> None:
        self.need("[")
        self.name()
        if self.take("in"):
            self.type()
            if self.take("as"):
                self.type()
        else:
            self.need(":")
            self.type()
        self.need("]")
        self.take("-", "+")
        self.take("?")
        if self.take(":"):
            self.type()

    def object_type(self) -> None:
        self.need("{")
        while not self.take("}"):
            if self.t[self.i].kind == "end":
                self.fail()
            if self.at("+", "-") and self.look().text == "readonly":
                self.i += 1
            if self.at("readonly", "get", "set") and (self.look().kind in ("name", "word", "string", "number") or self.look().text == "["):
                self.i += 1
            if self.at("new") and self.look().text in ("(", "<"):
                self.i += 1
            if self.at("(", "<"):
                self.method_type()
            elif self.at("[") and self.look().kind == "name" and self.look(2).text in (":", "in"):
                self.index_signature()
            else:
                self.property_name()
                self.take("?")
                if self.at("(", "<"):
                    self.method_type()
                elif self.take(":"):
                    self.type()
            if not self.take(";", ",") and not self.at("}") and not self.t[self.i].nl:
                self.fail()

    def method_type(self) -> None:
        if self.at("<"):
            self.type_parameters()
        self.parameters()
        if self.take(":"):
            self.type(predicate=True)

    # -- expressions ------------------------------------------------------------------------------
    def expression_in(self) -> None:
        saved, self.no_in = self.no_in, False
        self.expression()
        self.no_in = saved

    def assignment_in(self) -> None:
        saved, self.no_in = self.no_in, False
        self.assignment()
        self.no_in = saved

    def expression(self) -> None:
        self.assignment()
        while self.take(","):
            self.assignment()

    def arrow(self) -> bool:
        """Read an arrow function if one begins here."""
        i = self.i
        if self.at("async") and not self.look().nl and (self.look().text in ("(", "<") or self.look().kind == "name" and self.look(2).text == "=>"):
            i += 1
        t = self.t[i]
        if (t.kind == "name" or t.kind == "word" and t.text not in RESERVED) and self.t[min(i + 1, len(self.t) - 1)].text == "=>":
            self.i = i + 2
            self.arrow_body()
            return True
        if t.text != "(" and not (self.typed and t.text == "<") or t.kind != "mark":
            return False
        if t.text == "(":
            # Only what is followed by an arrow, or by a type before one, can be parameters.
            level, k = 0, i
            while k < len(self.t):
                x = self.t[k]
                if x.kind == "mark":
                    level += (x.text in ("(", "[", "{")) - (x.text in (")", "]", "}"))
                    if not level:
                        break
                k += 1
            after = self.t[min(k + 1, len(self.t) - 1)].text
            if after != "=>" and not (self.typed and after == ":"):
                return False

        def head() -> None:
            self.i = i
            if self.at("<"):
                self.type_parameters()
            self.parameters()
            if self.typed and self.take(":"):
                self.type(predicate=True)
            if not self.at("=>") or self.t[self.i].nl:
                self.fail()
            self.i += 1

        if not self.attempt(head):
            return False
        self.arrow_body()
        return True

    def arrow_body(self) -> None:
        if self.at("{"):
            saved, self.no_in = self.no_in, False
            self.within(Place(function=True), self.block)
            self.no_in = saved
        else:
            self.assignment()

    def assignment(self) -> None:
        if self.take("yield"):
            if not (self.at(")", "]", "}", ",", ";", ":", "in") or self.t[self.i].nl or self.t[self.i].kind == "end"):
                self.take("*")
                self.assignment()
            return
        if self.arrow():
            return
        begin = self.i
        target = self.binary()
        if self.at("?") and self.t[self.i].kind == "mark":
            self.i += 1
            self.assignment_in()
            self.need(":")
            self.assignment()
            return
        t = self.t[self.i]
        if t.kind == "mark" and t.text in _ASSIGN:
            if not target and not (t.text == "=" and self.t[begin].text in ("{", "[")):
                self.fail()
            self.i += 1
            self.assignment()

    def binary(self) -> bool:
        """Read operands and operators; whether it was a single target of assignments."""
        target = self.unary()
        while True:
            t = self.t[self.i]
            if t.kind == "mark" and t.text in _BINARY or t.text == "instanceof" or t.text == "in" and not self.no_in and t.kind == "word":
                self.i += 1
                self.unary()
                target = False
            elif self.typed and t.text in ("as", "satisfies") and t.kind == "name" and not t.nl:
                self.i += 1
                if not self.take("const"):
                    self.type()
            else:
                return target

    def unary(self) -> bool:
        t = self.t[self.i]
        if t.kind == "mark" and t.text in ("+", "-", "!", "~") or t.text in ("typeof", "void", "delete") and t.kind == "word":
            self.i += 1
            self.unary()
            return False
        if t.text == "await" and t.kind == "word" and not (self.look().kind == "mark" and self.look().text not in ("(", "[", "{", "!", "+", "-", "~", "`") or self.look().kind == "end"):
            self.i += 1
            self.unary()
            return False
        if t.kind == "mark" and t.text in ("++", "--"):
            self.i += 1
            if not self.unary():
                self.fail()
            return False
        if self.typed and t.text == "<" and t.kind == "mark":
            self.type_arguments()
            return self.unary()
        target = self.left_hand()
        if self.at("++", "--") and not self.t[self.i].nl:
            if not target:
                self.fail()
            self.i += 1
            return False
        return target

    def arguments(self) -> None:
        self.need("(")
        while not self.take(")"):
            self.take("...")
            self.assignment_in()
            if not self.at(")"):
                self.need(",")

    def holes(self, t: Token) -> None:
        for hole in t.holes:
            inner = ScriptParser(hole, self.typed)
            inner.expression()
            if inner.t[inner.i].kind != "end":
                self.fail()

    def left_hand(self) -> bool:
        if self.at("new"):
            self.i += 1
            if self.take("."):
                self.any_name()
            else:
                if self.at("new"):
                    self.left_hand()
                else:
                    self.primary()
                while True:
                    if self.take("."):
                        self.any_name()
                    elif self.take("["):
                        self.expression_in()
                        self.need("]")
                    else:
                        break
                if self.typed and self.at("<"):
                    self.attempt(self.type_arguments)
                if self.at("("):
                    self.arguments()
            target = False
        else:
            target = self.primary()
        while True:
            t = self.t[self.i]
            if t.kind == "template":
                self.i += 1
                self.holes(t)
                target = False
            elif t.kind != "mark":
                return target
            elif t.text == ".":
                self.i += 1
                self.any_name()
                target = True
            elif t.text == "?.":
                self.i += 1
                if self.take("["):
                    self.expression_in()
                    self.need("]")
                elif self.at("("):
                    self.arguments()
                elif self.t[self.i].kind == "template":
                    self.fail()
                else:
                    self.any_name()
                target = False
            elif t.text == "[":
                self.i += 1
                self.expression_in()
                self.need("]")
                target = True
            elif t.text == "(":
                self.arguments()
                target = False
            elif self.typed and t.text == "!" and not t.nl:
                self.i += 1
            elif self.typed and t.text == "<" and self.generic_call():
                target = False
            else:
                return target

    def generic_call(self) -> bool:
        def rule() -> None:
            self.type_arguments()
            if not self.at("(") and self.t[self.i].kind != "template":
                self.fail()

        return self.attempt(rule)

    def primary(self) -> bool:
        t = self.t[self.i]
        if t.kind in ("number", "string", "regex"):
            self.i += 1
            return False
        if t.kind == "template":
            self.i += 1
            self.holes(t)
            return False
        if t.kind == "mark":
            if t.text == "(":
                self.i += 1
                self.expression_in()
                self.need(")")
                return self.t[self.i - 2].kind in ("name", "word") or self.t[self.i - 2].text in ("]", ")")
            if t.text == "[":
                self.i += 1
                while not self.take("]"):
                    if self.take(","):
                        continue
                    self.take("...")
                    self.assignment_in()
                    if not self.at("]"):
                        self.need(",")
                return False
            if t.text == "{":
                self.object()
                return False
            if t.text == "@":
                self.decorators()
                self._expression_class()
                return False
            self.fail()
        if t.kind in ("name", "word"):
            x = t.text
            if x == "function" or x == "async" and self.look().text == "function" and not self.look().nl:
                self.take("async")
                self.i += 1
                self.take("*")
                if not self.at("(", "<"):
                    self.name()
                self.signature_and_body()
                return False
            if x == "class":
                self._expression_class()
                return False
            if x == "import":
                self.i += 1
                if self.take("."):
                    self.any_name()
                else:
                    self.arguments()
                return False
            if x in ("this", "null", "true", "false", "super"):
                self.i += 1
                return False
            if x[0] == "#":
                self.i += 1
                if not self.at("in"):
                    self.fail()
                return False
            self.name()
            return True
        self.fail()
        return False

    def _expression_class(self) -> None:
        self.need("class")
        if not self.at("{", "extends", "implements", "<"):
            self.name()
        self.class_tail()

    def object(self) -> None:
        self.need("{")
        while not self.take("}"):
            if self.take("..."):
                self.assignment_in()
            else:
                while self.at("async", "get", "set") and (self.look().kind in ("name", "word", "string", "number") or self.look().text in ("[", "*")):
                    self.i += 1
                star = self.take("*")
                simple = self.t[self.i].kind in ("name", "word") and not star
                plain = self.t[self.i].text not in RESERVED
                self.property_name()
                if self.at("(") or self.typed and self.at("<"):
                    self.signature_and_body()
                elif self.take(":"):
                    self.assignment_in()
                elif not simple or not plain:
                    self.fail()
                elif self.take("="):
                    self.assignment_in()
            if not self.at("}"):
                self.need(",")


_STATEMENTS = frozenset("var const function class if while with do for switch try throw return break continue debugger import export".split())


_GO_TOKEN = re.compile(
    r"(?P<space>[ \t\r\ufeff]+|/\*(?:(?!\*/)[^\n])*\*/)|(?P<line>\n|//[^\n]*|/\*.*?\*/)|(?P<name>[^\W\d]\w*)"
    r"|(?P<number>(?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)i?)"
    r"|(?P<string>\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|[abfnrtv\\'\"])|[^'\\\n])')"
    r"|(?P<mark><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[+\-*/%&|^<>=!()\[\]{},;.:~])",
    re.S,
)
GO_WORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_GO_ENDS = frozenset("break continue fallthrough return ++ -- ) ] }".split())
_GO_ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())
_GO_BINARY = frozenset("+ - * / % & | ^ << >> &^ && || == != < <= > >=".split())
_GO_HEAD = re.compile(r"(?:\s|//[^\n]*|/\*.*?\*/)*package[ \t]+[A-Za-z_]\w*[ \t]*(?://[^\n]*)?(?:;|\r?\n|\Z)(?P<rest>.*)\Z", re.S)
_GO_IMPORTS = re.compile(r"(?:\s|;|//[^\n]*|/\*.*?\*/|import\s*(?:\((?:\s|;|//[^\n]*|(?:[\w.]+[ \t]+)?(?:\"[^\"\s]+\"|`[^`\s]+`))*\)|(?:[\w.]+[ \t]+)?(?:\"[^\"\s]+\"|`[^`\s]+`)))*\Z", re.S)


class GoParser:
    """Accepts a source file, or raises SyntaxError."""

    def __init__(self, text: str):
        self.t: list[tuple[str, str]] = []
        self.i = 0
        #: Whether a brace after an operand begins a composite literal; not so in the heads of statements.
        self.literal = True
        at, n, out = 0, len(text), self.t
        while at < n:
            m = _GO_TOKEN.match(text, at)
            if not m:
                raise SyntaxError(f"character at {at}")
            at = m.end()
            kind, t = m.lastgroup, m[0]
            if kind == "space":
                continue
            if kind == "line":
                if ("\n" in t or t[:2] == "//") and self.ends():
                    out.append(("mark", ";"))
                continue
            if kind == "number" and at < n and (text[at].isalnum() or text[at] == "_"):
                raise SyntaxError(f"number at {at}")
            if kind == "number" and re.fullmatch(r"0\d+", t) and re.search("[89]", t):
                raise SyntaxError(f"number at {at}")
            if kind == "name" and t in GO_WORDS:
                kind = "word"
            out.append((kind, t))
        if self.ends():
            out.append(("mark", ";"))
        out.append(("end", ""))

    @staticmethod
    def head_ok(text: str) -> bool:
        """Whether a text is a package clause with imports and nothing else."""
        m = _GO_HEAD.match(text)
        return bool(m and _GO_IMPORTS.match(m["rest"]))

    def ends(self) -> bool:
        return bool(self.t) and (self.t[-1][0] in ("name", "number", "string") or self.t[-1][1] in _GO_ENDS)

    def fail(self) -> None:
        raise SyntaxError(f"{self.t[self.i]} at token {self.i}")

    def at(self, *texts: str) -> bool:
        return self.t[self.i][1] in texts and self.t[self.i][0] in ("mark", "word")

    def look(self, k: int = 1) -> tuple[str, str]:
        return self.t[min(self.i + k, len(self.t) - 1)]

    def take(self, *texts: str) -> bool:
        if self.at(*texts):
            self.i += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            self.fail()

    def name(self) -> None:
        if self.t[self.i][0] != "name":
            self.fail()
        self.i += 1

    def end_of_statement(self) -> None:
        if not self.take(";") and not self.at("}", ")"):
            self.fail()

    def parse(self) -> None:
        self.need("package")
        self.name()
        self.need(";")
        while self.at("import"):
            self.group(self.import_spec)
            self.need(";")
        self.declarations()

    def parse_part(self) -> None:
        """Accept top declarations without a package clause."""
        self.declarations()

    def declarations(self) -> None:
        while self.t[self.i][0] != "end":
            if self.take(";"):
                continue
            if self.at("func"):
                self.i += 1
                if self.at("("):
                    self.parameters()
                self.name()
                if self.at("["):
                    self.type_parameters()
                self.signature()
                if self.at("{"):
                    self.block()
            else:
                self.declaration()
            if self.t[self.i][0] != "end":
                self.need(";")

    def declaration(self) -> None:
        if self.at("const"):
            self.group(self.const_spec)
        elif self.at("var"):
            self.group(self.var_spec)
        elif self.at("type"):
            self.group(self.type_spec)
        else:
            self.fail()

    def group(self, spec) -> None:
        self.i += 1
        if self.take("("):
            while not self.take(")"):
                spec()
                if not self.at(")"):
                    self.need(";")
        else:
            spec()

    def import_spec(self) -> None:
        if self.t[self.i][0] == "name" or self.at("."):
            self.i += 1
        if self.t[self.i][0] != "string":
            self.fail()
        self.i += 1

    def names(self) -> None:
        self.name()
        while self.take(","):
            self.name()

    def const_spec(self) -> None:
        self.names()
        if not self.at("=", ";", ")"):
            self.type()
        if self.take("="):
            self.expressions()

    def var_spec(self) -> None:
        self.names()
        if not self.at("="):
            self.type()
        if self.take("="):
            self.expressions()

    def type_spec(self) -> None:
        self.name()
        if self.at("[") and self.look()[0] == "name" and self.look(2)[1] not in ("]",):
            i = self.i
            try:
                self.type_parameters()
                self.take("=")
                return self.type()
            except SyntaxError:
                self.i = i
        self.take("=")
        return self.type()

    def type_parameters(self) -> None:
        self.need("[")
        while not self.take("]"):
            self.names()
            self.constraint()
            if not self.at("]"):
                self.need(",")

    def constraint(self) -> None:
        self.take("~")
        self.type()
        while self.take("|"):
            self.take("~")
            self.type()

    def type(self) -> None:
        kind, x = self.t[self.i]
        if kind == "name":
            self.i += 1
            if self.at(".") and self.look()[0] == "name":
                self.i += 2
            if self.at("[") and self.look()[1] != "]":
                i = self.i
                try:
                    self.i += 1
                    self.type()
                    while self.take(","):
                        self.type()
                    self.need("]")
                except SyntaxError:
                    self.i = i
            return
        self.i += 1
        if x == "*":
            self.type()
        elif x == "(":
            self.type()
            self.need(")")
        elif x == "[":
            if not self.take("]"):
                if not self.take("..."):
                    self.nested(self.expression)
                self.need("]")
            self.type()
        elif x == "map":
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif x == "chan":
            self.take("<-")
            self.type()
        elif x == "<-":
            self.need("chan")
            self.type()
        elif x == "func":
            self.signature()
        elif x == "struct":
            self.need("{")
            while not self.take("}"):
                self.field()
                if not self.at("}"):
                    self.need(";")
        elif x == "interface":
            self.need("{")
            while not self.take("}"):
                if self.t[self.i][0] == "name" and self.look()[1] == "(":
                    self.i += 1
                    self.signature()
                else:
                    self.constraint()
                if not self.at("}"):
                    self.need(";")
        else:
            self.i -= 1
            self.fail()

    def field(self) -> None:
        if self.at("*") or self.t[self.i][0] == "name" and (self.look()[1] in (";", "}", ".") or self.look()[0] == "string"):
            self.take("*")
            self.type()
        else:
            self.names()
            self.type()
        if self.t[self.i][0] == "string":
            self.i += 1

    def signature(self) -> None:
        self.parameters()
        if self.at("("):
            self.parameters()
        elif not self.at("{", ";", ",", ")", "]", "}", "=", ":=", ":", ".") and self.t[self.i][0] not in ("string", "end"):
            self.type()

    def parameters(self) -> None:
        self.need("(")
        while not self.take(")"):
            if self.t[self.i][0] == "name" and self.look()[1] not in (",", ")", ".", "[") or self.t[self.i][0] == "name" and self.look()[1] == "[":
                i = self.i
                try:
                    self.i += 1
                    self.take("...")
                    self.type()
                except SyntaxError:
                    self.i = i
                    self.type()
            else:
                self.take("...")
                self.type()
            if not self.at(")"):
                self.need(",")

    def block(self) -> None:
        self.need("{")
        saved, self.literal = self.literal, True
        self.statements()
        self.literal = saved
        self.need("}")

    def statements(self) -> None:
        while not self.at("}", "case", "default"):
            if self.t[self.i][0] == "end":
                self.fail()
            if self.take(";"):
                continue
            self.statement()
            if not self.at("}"):
                self.need(";")

    def nested(self, rule) -> None:
        saved, self.literal = self.literal, True
        rule()
        self.literal = saved

    def header(self, rule) -> None:
        saved, self.literal = self.literal, False
        rule()
        self.literal = saved

    def statement(self) -> None:
        kind, x = self.t[self.i]
        if kind == "word":
            if x in ("const", "var", "type"):
                return self.declaration()
            if x == "return":
                self.i += 1
                if not self.at(";", "}"):
                    self.expressions()
                return None
            if x == "if":
                return self.if_()
            if x == "for":
                return self.for_()
            if x == "switch":
                return self.switch()
            if x == "select":
                return self.cases()
            if x in ("go", "defer"):
                self.i += 1
                return self.expression()
            if x in ("break", "continue", "goto", "fallthrough"):
                self.i += 1
                if self.t[self.i][0] == "name":
                    self.i += 1
                return None
        if x == "{" and kind == "mark":
            return self.block()
        if kind == "name" and self.look()[1] == ":" and self.look()[0] == "mark":
            self.i += 2
            if not self.at("}", ";"):
                return self.statement()
            return None
        return self.simple()

    def simple(self) -> None:
        self.expressions()
        if self.t[self.i][0] == "mark":
            x = self.t[self.i][1]
            if x in _GO_ASSIGN:
                self.i += 1
                if self.take("range"):
                    self.expression()
                else:
                    self.expressions()
            elif x in ("++", "--"):
                self.i += 1
            elif x == "<-":
                self.i += 1
                self.expression()

    def if_(self) -> None:
        self.need("if")

        def head() -> None:
            if not self.at(";"):
                self.simple()
            if self.take(";"):
                self.simple()

        self.header(head)
        self.block()
        if self.take("else"):
            if self.at("if"):
                self.if_()
            else:
                self.block()

    def for_(self) -> None:
        self.need("for")

        def head() -> None:
            if self.at("{"):
                return
            if self.take("range"):
                return self.expression()
            if not self.at(";"):
                self.simple()
            if self.take(";"):
                if not self.at(";"):
                    self.simple()
                self.need(";")
                if not self.at("{"):
                    self.simple()
            return None

        self.header(head)
        self.block()

    def switch(self) -> None:
        self.need("switch")

        def head() -> None:
            if not self.at("{", ";"):
                self.simple()
            if self.take(";") and not self.at("{"):
                self.simple()

        self.header(head)
        self.i -= 1
        self.cases()

    def cases(self) -> None:
        self.i += 1
        self.need("{")
        while not self.take("}"):
            if self.take("case"):
                saved, self.literal = self.literal, True
                self.case_item()
                while self.take(","):
                    self.case_item()
                if self.take("=", ":="):
                    self.expression()
                elif self.take("<-"):
                    self.expression()
                self.literal = saved
            else:
                self.need("default")
            self.need(":")
            saved, self.literal = self.literal, True
            self.statements()
            self.literal = saved

    def case_item(self) -> None:
        i = self.i
        try:
            self.expression()
            if self.at(",", ":", "=", ":=", "<-"):
                return
        except SyntaxError:
            pass
        self.i = i
        self.type()

    def expressions(self) -> None:
        self.expression()
        while self.take(","):
            self.expression()

    def expression(self) -> None:
        self.unary()
        while self.t[self.i][0] == "mark" and self.t[self.i][1] in _GO_BINARY:
            self.i += 1
            self.unary()

    def unary(self) -> None:
        while self.at("+", "-", "!", "^", "*", "&", "<-", "~"):
            self.i += 1
        self.primary()

    def primary(self) -> None:
        kind, x = self.t[self.i]
        literal = False
        if kind in ("number", "string"):
            self.i += 1
        elif kind == "name":
            self.i += 1
            literal = True
        elif x == "(" and kind == "mark":
            self.i += 1

            def inner() -> None:
                i = self.i
                try:
                    self.expression()
                    self.need(")")
                except SyntaxError:
                    self.i = i
                    self.type()
                    self.need(")")

            self.nested(inner)
        elif x == "func" and kind == "word":
            self.i += 1
            self.signature()
            if self.at("{"):
                self.nested(self.block)
        elif x in ("[", "struct", "map", "chan", "interface"):
            self.type()
            if self.at("{"):
                self.composite()
            elif not self.at("(", ",", ")"):
                self.fail()
        else:
            self.fail()
        while True:
            if self.take("."):
                if self.take("("):
                    if not self.take("type"):
                        self.type()
                    self.need(")")
                else:
                    self.name()
            elif self.at("["):
                self.i += 1
                self.nested(self.index)
                literal = literal and True
            elif self.at("("):
                self.i += 1
                self.nested(self.call)
                literal = False
            elif self.at("{") and literal and self.literal:
                self.composite()
                literal = False
            else:
                return

    def index(self) -> None:
        while not self.take("]"):
            if self.take(":", ","):
                continue
            i = self.i
            try:
                self.expression()
            except SyntaxError:
                self.i = i
                self.type()
            if not self.at("]", ":", ","):
                self.fail()

    def call(self) -> None:
        while not self.take(")"):
            i = self.i
            try:
                self.expression()
                if not self.at(",", ")", "..."):
                    self.fail()
            except SyntaxError:
                self.i = i
                self.type()
            self.take("...")
            if not self.at(")"):
                self.need(",")

    def composite(self) -> None:
        self.need("{")
        saved, self.literal = self.literal, True
        while not self.take("}"):
            self.element()
            if self.take(":"):
                self.element()
            if not self.at("}"):
                self.need(",")
        self.literal = saved

    def element(self) -> None:
        if self.at("{"):
            self.composite()
        else:
            self.expression()
