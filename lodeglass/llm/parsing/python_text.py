"""Python 3."""

from __future__ import annotations

import re
import unicodedata

from lodeglass.llm.parsing.base import Bad, Parser, line_ends

_P = r"(?:[rR][bBfF]?|[bBfF][rR]?|[uU]|[tT][rR]?)?"
_STRING = rf"""{_P}(?:\"{{3}}(?:[^"\\]|\\[\s\S]|"(?!""))*\"{{3}}|'{{3}}(?:[^'\\]|\\[\s\S]|'(?!''))*'{{3}}|"(?!"")(?:[^"\\\n]|\\[\s\S])*"|'(?!'')(?:[^'\\\n]|\\[\s\S])*')"""
_NUM = r"0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*\.?(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?"
_OP = r"\*\*=|//=|>>=|<<=|\.\.\.|:=|->|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|==|!=|<=|>=|\*\*|//|<<|>>|[{}()\[\]:,;.=+\-*/%@&|^~<>]"
TOKENS = re.compile(rf"""(?:[ \t\f]|\\\r?\n|\ufeff)+|((?:(?:[ \t\f]*(?:\#[^\n]*)?\r?\n)+)[ \t\f]*)|\#[^\n]*|({_STRING})|([^\W\d]\w*)|((?:{_NUM})(?!\w))|({_OP})|([\s\S])""")

KEYWORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
SOFT = frozenset(("match", "case", "type", "_"))
_KINDS = {w: w for w in KEYWORDS | SOFT}
_NAMES = SOFT | {"name"}
_AUGMENTED = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())
_COMPARE = frozenset("< > <= >= == != in is not".split())
_BINARY = {"|": 1, "^": 2, "&": 3, "<<": 4, ">>": 4, "+": 5, "-": 5, "*": 6, "/": 6, "//": 6, "%": 6, "@": 6}
_STOPS = frozenset(") ] } , : ; = nl eof for if else async in".split())


#: Decimal numbers with a leading zero, unless they are nought or no whole numbers.
_OCTAL = re.compile(r"0[\d_]*[1-9][\d_]*")
_ESCAPE = re.compile(r"\\(?:N\{([^{}]*)\}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U(?:000[0-9a-fA-F]|0010)[0-9a-fA-F]{4}|([NxuU])|[\s\S])")
_PREFIX = re.compile(r"[a-zA-Z]*")


def _good_string(string: str) -> bool:
    """Whether the escapes and fields of a string literal are right."""
    prefix = _PREFIX.match(string).group().lower()
    body = string[len(prefix) :]
    quote = 3 if body[:3] in ('"' * 3, "'" * 3) else 1
    body = body[quote:-quote]
    if "b" in prefix and not body.isascii():
        return False
    if "r" not in prefix and "\\" in body:
        for m in _ESCAPE.finditer(body):
            if "b" in prefix:
                if m.group(2) == "x":
                    return False
            elif m.group(2):
                return False
            elif m.group(1) is not None:
                try:
                    unicodedata.lookup(m.group(1))
                except KeyError:
                    return False
    return ("f" not in prefix and "t" not in prefix) or _good_fields(body, 0)


def _good_fields(body: str, nested: int) -> bool:
    """Whether the fields of an f-string hold expressions. Nested fields stand in formats, two deep at most."""
    if nested > 2:
        return False
    at, n = 0, len(body)
    while at < n:
        c = body[at]
        if c == "}":
            if nested or body[at : at + 2] != "}}":
                return False
            at += 2
        elif c != "{":
            at += 1
        elif body[at : at + 2] == "{{" and not nested:
            at += 2
        else:
            depth, start, stop, form = 0, at + 1, -1, -1
            at += 1
            while at < n and stop < 0:
                c = body[at]
                if c in "\"'":
                    end = body.find(c * 3, at + 3) + 2 if body.startswith(c * 3, at) else body.find(c, at + 1)
                    if end < at + 1:
                        return False
                    at = end
                elif c in "([{":
                    depth += 1
                elif c in ")]}" and depth:
                    depth -= 1
                elif c == "}":
                    stop = at
                elif not depth and (c == ":" or c == "!" and body[at + 1 : at + 2] != "="):
                    form = at
                    break
                at += 1
            code = body[start : stop if stop >= 0 else form if form >= 0 else n]
            if stop < 0:
                if form < 0:
                    return False
                if body[form] == "!":
                    conversion = re.compile(r"![rsa]\s*(?=[:}])").match(body, form)
                    if not conversion:
                        return False
                    form = conversion.end()
                depth, stop = 0, form
                while stop < n and (depth or body[stop] != "}"):
                    depth += (body[stop] == "{") - (body[stop] == "}")
                    stop += 1
                if stop == n or body[form] == ":" and not _good_fields(body[form + 1 : stop], nested + 1):
                    return False
            code = re.sub(r"(?<![=!<>])=\s*$", "", code)
            if not code.strip() or not _is_expression(code):
                return False
            at = stop + 1
    return True


def _is_expression(code: str) -> bool:
    if re.fullmatch(r"\s*[^\W\d]\w*(?:\.[^\W\d]\w*)*(?:\(\)|\[\w+\])?\s*", code) and not any(w in KEYWORDS for w in re.findall(r"\w+", code)):
        return True
    k, ends, names = kinds(f"({code})")
    p = Python(k, ends, names)
    p.function = p.asynchronous = True
    try:
        p.expression_statement()
    except Bad:
        return False
    return p.k[p.i] == "nl"


def kinds(text: str) -> tuple[list[str], list[int], dict[int, str]]:
    """Kinds with nl, indent and dedent, and the names by their index; what can't be right gets 'bad': a line whose
    indentation fits none before, whatever a tab is worth, numbers with leading zeros, strings with wrong escapes or
    fields."""
    out: list[str] = []
    names: dict[int, str] = {}
    breaks: list[int] = []
    depth, levels, narrow = 0, [0], [0]
    add, known = out.append, _KINDS.get
    first = True
    text = text.removeprefix("\ufeff")
    lead = re.match(r"[ \t\f]*", text).group()
    if lead and not re.match(r"[ \t\f]*(?:#|\r?\n|\Z)", text):
        add("indent")
        levels.append(len(lead.expandtabs(8)))
        narrow.append(len(lead))
    for gap, string, word, num, op, bad in TOKENS.findall(text):
        if op:
            if op in ("(", "[", "{"):
                depth += 1
            elif op in (")", "]", "}"):
                depth = max(0, depth - 1)
            add(op)
        elif word:
            kind = known(word, "name")
            if kind == "name":
                names[len(out)] = word
            add(kind)
        elif gap:
            breaks.append(len(out))
            if depth or not out and first:
                if not out and not depth:
                    pass
                else:
                    continue
            if out and out[-1] not in ("nl", "indent", "dedent"):
                add("nl")
                breaks[-1] = len(out)
            tail = gap[gap.rfind("\n") + 1 :]
            tail = tail[tail.rfind("\f") + 1 :]
            width, least = len(tail.expandtabs(8)) if "\t" in tail else len(tail), len(tail)
            if width > levels[-1]:
                if least <= narrow[-1]:
                    add("bad")
                levels.append(width)
                narrow.append(least)
                add("indent")
            else:
                while width < levels[-1]:
                    levels.pop()
                    narrow.pop()
                    add("dedent")
                if width != levels[-1] or least != narrow[-1]:
                    add("bad")
        elif string:
            add("str" if string[0] in "\"'" and "\\" not in string or _good_string(string) else "bad")
        elif num:
            add("bad" if num[0] == "0" and _OCTAL.fullmatch(num) else "num")
        elif bad:
            add("bad")
        first = False
    # what stands behind the last line break may be nothing
    while out and out[-1] == "indent":
        out.pop()
        levels.pop()
        narrow.pop()
    if out and out[-1] not in ("nl", "dedent"):
        add("nl")
    out += ["dedent"] * (len(levels) - 1)
    add("eof")
    return out, line_ends(breaks, len(out)), names


class Python(Parser):
    memo: set = set()

    def __init__(self, k, ends, names):
        super().__init__(k, ends)
        self.names = names
        self.function = self.loop = self.asynchronous = False

    def parse(self) -> None:
        while self.k[self.i] != "eof":
            self.guarded()

    def guarded(self) -> None:
        start = self.i
        try:
            self.statement()
        except Bad as bad:
            self.note(bad)
            self.i = max(self.i, start)
            k = self.k
            if k[self.i] in ("dedent", "indent") and self.i == start:
                self.i += 1
                return
            while k[self.i] not in ("nl", "eof"):
                self.i += 1
            self.take("nl")
            if k[self.i] == "indent":  # the block under a bad head is read for itself
                self.i += 1
                while k[self.i] not in ("dedent", "eof"):
                    self.guarded()
                self.take("dedent")

    def statement(self) -> None:
        method = _STATEMENTS.get(self.k[self.i])
        if method:
            method(self)
            return
        t = self.k[self.i]
        if t == "match" and self.match():
            return
        start = self.i
        context = (self.function, self.loop, self.asynchronous)
        if self.known(context):
            return
        self.simple_line()
        if "lambda" not in self.k[start : self.i]:  # whose parameters' names count
            self.remember(start, context)

    def simple_line(self) -> None:
        while True:
            self.simple()
            if not self.take(";"):
                break
            if self.k[self.i] == "nl":
                break
        if not self.take("nl") and self.k[self.i] != "eof":
            self.fail(f"expected the end of the line, found {self.k[self.i]}")

    def simple(self) -> None:
        k = self.k
        t = k[self.i]
        if t == "return":
            if not self.function:
                self.fail("return outside a function")
            self.i += 1
            if k[self.i] not in ("nl", ";", "eof"):
                self.star_expressions()
        elif t == "raise":
            self.i += 1
            if k[self.i] not in ("nl", ";", "eof"):
                self.test()
                if self.take("from"):
                    self.test()
        elif t in ("pass", "break", "continue"):
            if t != "pass" and not self.loop:
                self.fail(f"{t} outside a loop")
            self.i += 1
        elif t == "del":
            self.i += 1
            self.star_expressions()
        elif t in ("global", "nonlocal"):
            if t == "nonlocal" and not self.function:
                self.fail("nonlocal outside a function")
            self.i += 1
            self.name()
            while self.take(","):
                self.name()
        elif t == "assert":
            self.i += 1
            self.test()
            if self.take(","):
                self.test()
        elif t == "import":
            self.i += 1
            self.dotted_as()
            while self.take(","):
                self.dotted_as()
        elif t == "from":
            self.i += 1
            dots = False
            while k[self.i] in (".", "..."):
                self.i += 1
                dots = True
            if k[self.i] != "import" or not dots:
                self.dotted()
            self.expect("import")
            if self.take("*"):
                return
            paren = self.take("(")
            self.name_as()
            while self.take(","):
                if paren and k[self.i] == ")":
                    break
                self.name_as()
            if paren:
                self.expect(")")
        elif t == "type" and k[self.i + 1] in _NAMES and k[self.i + 2] in ("=", "["):
            self.i += 2
            self.type_parameters()
            self.expect("=")
            self.test()
        else:
            self.expression_statement()

    def expression_statement(self) -> None:
        k = self.k
        start = self.i
        target = self.star_expressions()
        if self.take(":"):
            if not target or "," in k[start : self.i - 1] and k[start] not in ("(",) and self._top_comma(start, self.i - 1):
                self.fail("can't be annotated")
            self.test()
            if self.take("="):
                self.value()
        elif k[self.i] in _AUGMENTED:
            if not target:
                self.fail("can't be assigned to")
            self.i += 1
            self.value()
        else:
            while k[self.i] == "=":
                if not target:
                    self.fail("can't be assigned to")
                self.i += 1
                target = self.value()

    def _top_comma(self, a: int, b: int) -> bool:
        depth = 0
        for t in self.k[a:b]:
            depth += (t in ("(", "[", "{")) - (t in (")", "]", "}"))
            if t == "," and depth == 0:
                return True
        return False

    def value(self) -> bool:
        if self.k[self.i] == "yield":
            self.yield_()
            return False
        return self.star_expressions()

    def name(self) -> None:
        if self.k[self.i] not in _NAMES:
            self.fail(f"expected a name, found {self.k[self.i]}")
        self.i += 1

    def dotted(self) -> None:
        self.name()
        while self.take("."):
            self.name()

    def dotted_as(self) -> None:
        self.dotted()
        if self.take("as"):
            self.name()

    def name_as(self) -> None:
        self.name()
        if self.take("as"):
            self.name()

    # -- compound statements

    def block(self) -> None:
        self.expect(":")
        if not self.take("nl"):
            if self.k[self.i] in _STATEMENTS and self.k[self.i] not in ("nl",):
                self.fail("a compound statement needs a line of its own")
            self.simple_line()
            return
        if not self.take("indent"):
            self.fail("expected an indented block")
        while self.k[self.i] not in ("dedent", "eof"):
            self.guarded()
        self.take("dedent")

    def if_(self) -> None:
        self.i += 1
        self.named_test()
        self.block()
        while self.take("elif"):
            self.named_test()
            self.block()
        if self.take("else"):
            self.block()

    def looped(self) -> None:
        kept, self.loop = self.loop, True
        try:
            self.block()
        finally:
            self.loop = kept
        if self.take("else"):
            self.block()

    def while_(self) -> None:
        self.i += 1
        self.named_test()
        self.looped()

    def for_(self) -> None:
        self.i += 1
        self.targets()
        self.expect("in")
        self.star_expressions()
        self.looped()

    def targets(self) -> None:
        while True:
            self.take("*")
            if not self.operators(0):
                self.fail("can't be assigned to")
            if not self.take(",") or self.k[self.i] in ("in", "="):
                break

    def try_(self) -> None:
        self.i += 1
        self.block()
        caught = False
        while self.take("except"):
            caught = True
            self.take("*")
            if self.k[self.i] != ":":
                self.test()
                if self.take("as"):
                    self.name()
            self.block()
        if caught and self.take("else"):
            self.block()
        if self.take("finally"):
            self.block()
        elif not caught:
            self.fail("try without except or finally")

    def with_(self) -> None:
        self.i += 1
        kept = self.i
        if self.take("("):
            try:
                while self.k[self.i] != ")":
                    self.with_item()
                    if not self.take(","):
                        break
                self.expect(")")
                if self.k[self.i] != ":":
                    self.fail("not the bracketed form")
            except Bad:
                self.i = kept
        if self.i == kept:
            self.with_item()
            while self.take(","):
                self.with_item()
        self.block()

    def with_item(self) -> None:
        self.test()
        if self.take("as"):
            if not self.operators(0):
                self.fail("can't be assigned to")

    def async_(self) -> None:
        self.i += 1
        t = self.k[self.i]
        if t == "def":
            self.def_(True)
        elif t in ("for", "with") and not self.asynchronous:
            self.fail(f"async {t} outside an async function")
        elif t == "for":
            self.for_()
        elif t == "with":
            self.with_()
        else:
            self.fail("async before nothing asynchronous")

    def type_parameters(self) -> None:
        if self.take("["):
            while self.k[self.i] != "]":
                if not self.take("*"):
                    self.take("**")
                self.name()
                if self.take(":"):
                    self.test()
                if self.take("="):
                    self.test()
                if not self.take(","):
                    break
            self.expect("]")

    def def_(self, asynchronous: bool = False) -> None:
        self.i += 1
        self.name()
        self.type_parameters()
        self.expect("(")
        self.parameters(")", True)
        self.expect(")")
        if self.take("->"):
            self.test()
        kept = self.function, self.loop, self.asynchronous
        self.function, self.loop, self.asynchronous = True, False, asynchronous
        try:
            self.block()
        finally:
            self.function, self.loop, self.asynchronous = kept

    def parameter(self, known: set) -> None:
        name = self.names.get(self.i, self.k[self.i])
        if name in known:
            self.fail(f"a second parameter {name}")
        known.add(name)
        self.name()

    def parameters(self, close: str, annotated: bool) -> None:
        k = self.k
        known: set = set()
        defaulted = star = False
        while k[self.i] != close:
            if self.take("/"):
                pass
            elif self.take("**"):
                self.parameter(known)
                if annotated and self.take(":"):
                    self.test()
                self.take(",")
                return
            elif self.take("*"):
                star = True
                if k[self.i] in _NAMES:
                    self.parameter(known)
                    if annotated and self.take(":"):
                        self.take("*")
                        self.test()
                elif k[self.i] != ",":
                    self.fail("expected a parameter")
            else:
                self.parameter(known)
                if annotated and self.take(":"):
                    self.test()
                if self.take("="):
                    self.test()
                    defaulted = True
                elif defaulted and not star:
                    self.fail("a parameter without default behind one with")
            if not self.take(","):
                return

    def class_(self) -> None:
        self.i += 1
        self.name()
        self.type_parameters()
        if self.k[self.i] == "(":
            self.call()
        kept = self.function, self.loop, self.asynchronous
        self.function = self.loop = self.asynchronous = False
        try:
            self.block()
        finally:
            self.function, self.loop, self.asynchronous = kept

    def decorated(self) -> None:
        while self.take("@"):
            self.named_test()
            self.expect("nl")
        if self.k[self.i] not in ("def", "class", "async"):
            self.fail("a decorator before nothing")
        self.statement()

    def match(self) -> bool:
        """A match statement, if it is one and not a name."""
        kept = self.i
        self.i += 1
        try:
            if self.k[self.i] in ("=", ".", ",", ")", ":", "nl"):
                raise Bad(self.i, "a name")
            self.star_expressions()
            self.expect(":")
            self.expect("nl")
            self.expect("indent")
            if self.k[self.i] != "case":
                self.fail("expected case")
        except Bad:
            self.i = kept
            return False
        while self.take("case"):
            self.pattern()
            while self.take(","):
                if self.k[self.i] in (":", "if"):
                    break
                self.pattern()
            if self.take("if"):
                self.named_test()
            self.block()
        self.expect("dedent")
        return True

    def pattern(self) -> None:
        self.take("*")
        self.closed_pattern()
        while self.take("|"):
            self.closed_pattern()
        if self.take("as"):
            self.name()

    def closed_pattern(self) -> None:
        k = self.k
        t = k[self.i]
        if t in ("(", "["):
            close = ")" if t == "(" else "]"
            self.i += 1
            while k[self.i] != close:
                self.pattern()
                if not self.take(","):
                    break
            self.expect(close)
        elif t == "{":
            self.i += 1
            while k[self.i] != "}":
                if self.take("**"):
                    self.name()
                else:
                    self.closed_pattern()
                    self.expect(":")
                    self.pattern()
                if not self.take(","):
                    break
            self.expect("}")
        elif t in ("num", "str", "-", "None", "True", "False"):
            self.take("-")
            self.i += 1
            while k[self.i] in ("+", "-", "num", "str"):
                self.i += 1
        else:
            self.dotted()
            if self.take("("):
                while k[self.i] != ")":
                    if k[self.i] in _NAMES and k[self.i + 1] == "=":
                        self.i += 2
                    self.pattern()
                    if not self.take(","):
                        break
                self.expect(")")

    def misplaced(self) -> None:
        self.fail(f"{self.k[self.i]} isn't expected here")

    # -- expressions; each says whether it can be assigned to

    def star_expressions(self) -> bool:
        good = self.star_or_named()
        while self.take(","):
            if self.k[self.i] in _STOPS or self.k[self.i] in _AUGMENTED:
                break
            good = self.star_or_named() and good
        return good

    def star_or_named(self) -> bool:
        if self.take("*"):
            return self.operators(0)
        return self.named_test()

    def named_test(self) -> bool:
        k = self.k
        if k[self.i] in _NAMES and k[self.i + 1] == ":=":
            self.i += 2
            self.test()
            return False
        return self.test()

    def test(self) -> bool:
        k = self.k
        t = k[self.i]
        if t == "lambda":
            self.i += 1
            self.parameters(":", False)
            self.expect(":")
            kept = self.function, self.asynchronous
            self.function, self.asynchronous = True, False
            try:
                self.test()
            finally:
                self.function, self.asynchronous = kept
            return False
        if t == "yield":
            self.yield_()
            return False
        good = self.or_test()
        if k[self.i] == "if":
            self.i += 1
            self.or_test()
            self.expect("else")
            self.test()
            return False
        return good

    def yield_(self) -> None:
        if not self.function:
            self.fail("yield outside a function")
        self.i += 1
        if self.take("from"):
            self.test()
        elif self.k[self.i] not in _STOPS:
            self.star_expressions()

    def or_test(self) -> bool:
        k = self.k
        good = self.not_test()
        while k[self.i] in ("or", "and"):
            self.i += 1
            self.not_test()
            good = False
        return good

    def not_test(self) -> bool:
        k = self.k
        if k[self.i] == "not":
            while self.take("not"):
                pass
            self.comparison()
            return False
        return self.comparison()

    def comparison(self) -> bool:
        k = self.k
        good = self.operators(0)
        while k[self.i] in _COMPARE:
            t = k[self.i]
            if t == "not":
                if k[self.i + 1] != "in":
                    break
                self.i += 1
            self.i += 1
            if t == "is":
                self.take("not")
            self.operators(0)
            good = False
        return good

    def operators(self, least: int) -> bool:
        k = self.k
        good = self.factor()
        while True:
            p = _BINARY.get(k[self.i], 0)
            if p <= least:
                return good
            self.i += 1
            self.operators(p)
            good = False

    def factor(self) -> bool:
        k = self.k
        if k[self.i] in ("+", "-", "~"):
            while k[self.i] in ("+", "-", "~"):
                self.i += 1
            self.factor()
            return False
        awaited = self.k[self.i] == "await"
        if awaited:
            if not self.asynchronous:
                self.fail("await outside an async function")
            self.i += 1
        good = self.trailed()
        if k[self.i] == "**":
            self.i += 1
            self.factor()
            return False
        return good and not awaited

    def trailed(self) -> bool:
        k = self.k
        good = self.atom()
        while True:
            t = k[self.i]
            if t == "(":
                self.call()
                good = False
            elif t == ".":
                self.i += 1
                self.name()
                good = True
            elif t == "[":
                self.i += 1
                while True:
                    self.subscript()
                    if not self.take(",") or k[self.i] == "]":
                        break
                self.expect("]")
                good = True
            else:
                return good

    def subscript(self) -> None:
        k = self.k
        if k[self.i] == "*":
            self.star_or_named()
            return
        if k[self.i] != ":":
            self.named_test()
        if self.take(":"):
            if k[self.i] not in (":", ",", "]"):
                self.test()
            if self.take(":") and k[self.i] not in (",", "]"):
                self.test()

    def call(self) -> None:
        self.expect("(")
        k = self.k
        keyword = False
        while k[self.i] != ")":
            if self.take("**"):
                self.test()
                keyword = True
            elif self.take("*"):
                self.test()
            elif k[self.i] in _NAMES and k[self.i + 1] == "=":
                self.i += 2
                self.test()
                keyword = True
            else:
                if keyword:
                    self.fail("a positional argument behind a keyword one")
                self.named_test()
                if k[self.i] in ("for", "async"):
                    self.comprehension()
            if not self.take(","):
                break
        self.expect(")")

    def comprehension(self) -> None:
        k = self.k
        while k[self.i] in ("for", "async"):
            self.take("async")
            self.expect("for")
            self.targets()
            self.expect("in")
            self.or_test()
            if k[self.i] == "if" and False:
                pass
            while self.take("if"):
                if k[self.i] in _NAMES and k[self.i + 1] == ":=":
                    self.named_test()
                elif k[self.i] == "lambda":
                    self.test()
                else:
                    self.or_test()

    def atom(self) -> bool:
        k = self.k
        t = k[self.i]
        if t in _NAMES:
            self.i += 1
            return True
        if t == "str":
            while k[self.i] == "str":
                self.i += 1
            return False
        if t in ("num", "None", "True", "False", "..."):
            self.i += 1
            return False
        if t == "(":
            self.i += 1
            if self.take(")"):
                return True
            if k[self.i] == "yield":
                self.yield_()
                self.expect(")")
                return False
            good = self.star_or_named()
            if k[self.i] in ("for", "async"):
                self.comprehension()
                good = False
            while self.take(","):
                if k[self.i] == ")":
                    break
                good = self.star_or_named() and good
            self.expect(")")
            return good
        if t == "[":
            self.i += 1
            good = True
            while k[self.i] != "]":
                good = self.star_or_named() and good
                if k[self.i] in ("for", "async"):
                    self.comprehension()
                    good = False
                    break
                if not self.take(","):
                    break
            self.expect("]")
            return good
        if t == "{":
            self.i += 1
            while k[self.i] != "}":
                if self.take("**"):
                    self.operators(0)
                else:
                    self.star_or_named()
                    if self.take(":"):
                        self.test()
                    if k[self.i] in ("for", "async"):
                        self.comprehension()
                        break
                if not self.take(","):
                    break
            self.expect("}")
            return False
        self.fail(f"expected an expression, found {t}")


_STATEMENTS = {
    "if": Python.if_, "while": Python.while_, "for": Python.for_, "try": Python.try_, "with": Python.with_, "async": Python.async_, "def": Python.def_, "class": Python.class_, "@": Python.decorated,
    "elif": Python.misplaced, "else": Python.misplaced, "except": Python.misplaced, "finally": Python.misplaced, "indent": Python.misplaced, "dedent": Python.misplaced,
}
