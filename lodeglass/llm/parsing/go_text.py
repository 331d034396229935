"""Go."""

from __future__ import annotations

import re

from lodeglass.llm.parsing.base import Bad, Parser, line_ends

_OP = r"&\^=|<<=|>>=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[+\-*/%&|^<>=!()\[\]{},;.:~]"
TOKENS = re.compile(
    rf"""[ \t\r\ufeff]+|(\n|//[^\n]*|/\*[\s\S]*?\*/)|([^\W\d]\w*)|((?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO]?[0-7_]+|\d[\d_]*\.?[\d_]*(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)i?(?!\w))|("(?:[^"\\\n]|\\.)*"|`[^`]*`|'(?:[^'\\\n]|\\(?:[abfnrtv\\'"]|[0-7]{{3}}|x[0-9a-fA-F]{{2}}|u[0-9a-fA-F]{{4}}|U[0-9a-fA-F]{{8}}))')|({_OP})|([\s\S])"""
)
KEYWORDS = frozenset("break default func interface select case defer go map struct chan else goto package switch const fallthrough if range type continue for import return var".split())
_KINDS = {w: w for w in KEYWORDS}
_ENDS = frozenset("name num str break continue fallthrough return ++ -- ) ] }".split())
_BINARY = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "|": 4, "^": 4, "*": 5, "/": 5, "%": 5, "<<": 5, ">>": 5, "&": 5, "&^": 5}
_ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())


def kinds(text: str) -> tuple[list[str], list[int]]:
    """Kinds with the semicolons that line breaks stand for, as 'nl'."""
    out: list[str] = []
    breaks: list[int] = []
    add, known = out.append, _KINDS.get
    for gap, word, num, string, op, bad in TOKENS.findall(text):
        if op:
            add(op)
        elif word:
            add(known(word, "name"))
        elif gap:
            if "\n" in gap:
                if out and out[-1] in _ENDS:
                    add("nl")
                breaks.append(len(out))
        elif string:
            add("str")
        elif num:
            add("num")
        elif bad:
            add("bad")
    if out and out[-1] in _ENDS:
        add("nl")
    add("eof")
    return out, line_ends(breaks, len(out))


class Go(Parser):
    memo: set = set()

    def __init__(self, k, ends):
        super().__init__(k, ends)
        self.level = 0  # below 0: no composite literal of a plain name, as before a block
        self.nested = 0

    def parse(self) -> None:
        k = self.k
        try:
            self.expect("package")
            self.expect("name")
            self.semicolon()
        except Bad as bad:
            self.note(bad)
            self.skip(0)
        imports = True
        while k[self.i] != "eof":
            start = self.i
            try:
                t = k[self.i]
                if t in (";", "nl"):
                    self.i += 1
                elif t == "import":
                    if not imports:
                        self.fail("import behind declarations")
                    self.group(self.import_spec)
                    self.semicolon()
                elif t == "func":
                    imports = False
                    self.func_decl()
                    self.semicolon()
                elif t in ("const", "var", "type"):
                    imports = False
                    self.declaration()
                    self.semicolon()
                else:
                    self.fail(f"{t} isn't a declaration")
            except Bad as bad:
                self.note(bad)
                self.skip(start)

    def skip(self, start: int) -> None:
        k, depth = self.k, 0
        self.i = max(self.i, start + 1) if k[start] != "eof" else start
        while (t := k[self.i]) != "eof":
            if t in ("{", "("):
                depth += 1
            elif t in ("}", ")"):
                if depth == 0 and self.nested and t == "}":
                    return
                depth = max(0, depth - 1)
            elif t in ("nl", ";") and depth == 0:
                self.i += 1
                return
            elif t == "func" and self.nested == 0 and k[self.i - 1] == "nl":
                return
            self.i += 1

    def semicolon(self) -> None:
        t = self.k[self.i]
        if t in (";", "nl"):
            self.i += 1
        elif t not in (")", "}", "eof"):
            self.fail(f"expected the end of the statement, found {t}")

    def group(self, spec) -> None:
        self.i += 1
        if self.take("("):
            while self.k[self.i] != ")":
                if self.k[self.i] in (";", "nl"):
                    self.i += 1
                    continue
                spec()
                self.semicolon()
            self.i += 1
        else:
            spec()

    def import_spec(self) -> None:
        if self.k[self.i] in ("name", "."):
            self.i += 1
        self.expect("str")

    def declaration(self) -> None:
        self.group({"const": self.const_spec, "var": self.var_spec, "type": self.type_spec}[self.k[self.i]])

    def names(self) -> None:
        self.expect("name")
        while self.take(","):
            self.expect("name")

    def const_spec(self) -> None:
        self.names()
        if self.k[self.i] not in ("=", ";", "nl", ")"):
            self.type()
        if self.take("="):
            self.expressions()

    def var_spec(self) -> None:
        self.names()
        if self.k[self.i] != "=":
            self.type()
        if self.take("="):
            self.expressions()

    def type_spec(self) -> None:
        self.expect("name")
        if self.k[self.i] == "[" and self.k[self.i + 1] == "name" and self.k[self.i + 2] not in ("]", "."):
            kept = self.i
            try:
                self.type_parameters()
            except Bad:
                self.i = kept
        self.take("=")
        self.type()

    def type_parameters(self) -> None:
        self.expect("[")
        while self.k[self.i] != "]":
            self.names()
            self.constraint()
            if not self.take(","):
                break
        self.expect("]")

    def constraint(self) -> None:
        while True:
            self.take("~")
            self.type()
            if not self.take("|"):
                return

    def func_decl(self) -> None:
        self.i += 1
        if self.k[self.i] == "(":
            self.parameters()
        self.expect("name")
        if self.k[self.i] == "[":
            self.type_parameters()
        self.signature()
        if self.k[self.i] == "{":
            self.body()

    def signature(self) -> None:
        self.parameters()
        if self.k[self.i] == "(":
            self.parameters()
        elif self.starts_type():
            self.type()

    def starts_type(self) -> bool:
        return self.k[self.i] in ("name", "*", "[", "struct", "map", "chan", "<-", "func", "interface", "(")

    def parameters(self) -> None:
        self.expect("(")
        k = self.k
        while k[self.i] != ")":
            self.take("...")
            self.type()
            if k[self.i] not in (",", ")"):
                self.take("...")
                self.type()
            if not self.take(","):
                break
        self.expect(")")

    def type(self) -> None:
        k = self.k
        t = k[self.i]
        if t == "name":
            self.i += 1
            if self.take("."):
                self.expect("name")
            if k[self.i] == "[" and k[self.i + 1] != "]":
                kept = self.i
                try:
                    self.i += 1
                    while True:
                        self.type()
                        if not self.take(","):
                            break
                    self.expect("]")
                except Bad:
                    self.i = kept
        elif t == "*":
            self.i += 1
            self.type()
        elif t == "(":
            self.i += 1
            self.type()
            self.expect(")")
        elif t == "[":
            self.i += 1
            if not self.take("]"):
                if not self.take("..."):
                    kept, self.level = self.level, self.level + 1
                    self.expression()
                    self.level = kept
                self.expect("]")
            self.type()
        elif t == "map":
            self.i += 1
            self.expect("[")
            self.type()
            self.expect("]")
            self.type()
        elif t == "chan":
            self.i += 1
            self.take("<-")
            self.type()
        elif t == "<-":
            self.i += 1
            self.expect("chan")
            self.type()
        elif t == "func":
            self.i += 1
            self.signature()
        elif t == "struct":
            self.i += 1
            self.expect("{")
            while k[self.i] != "}":
                if k[self.i] in (";", "nl"):
                    self.i += 1
                    continue
                if k[self.i] == "*" or k[self.i] == "name" and k[self.i + 1] in (".", "nl", ";", "str", "}"):
                    self.type()
                elif k[self.i] == "name" and k[self.i + 1] == "[" and k[self.i + 2] == "name" and k[self.i + 3] in ("]", ",") and k[self.i + 4] in ("nl", ";", "str"):
                    self.type()
                else:
                    self.names()
                    self.type()
                self.take("str")
                self.semicolon()
            self.i += 1
        elif t == "interface":
            self.i += 1
            self.expect("{")
            while k[self.i] != "}":
                if k[self.i] in (";", "nl"):
                    self.i += 1
                    continue
                if k[self.i] == "name" and k[self.i + 1] == "(":
                    self.i += 1
                    self.signature()
                else:
                    self.constraint()
                self.semicolon()
            self.i += 1
        else:
            self.fail(f"expected a type, found {t}")

    def body(self) -> None:
        kept, self.level = self.level, 0
        try:
            self.block()
        finally:
            self.level = kept

    def block(self) -> None:
        self.expect("{")
        self.nested += 1
        try:
            self.statements()
        finally:
            self.nested -= 1
        self.expect("}")

    def statements(self) -> None:
        k = self.k
        while k[self.i] not in ("}", "case", "default", "eof"):
            start = self.i
            if self.level == 0 and k[self.ends[start] - 1] == "nl" and self.known(0):
                continue
            try:
                self.statement()
                self.semicolon()
                if self.level == 0 and k[self.i - 1] == "nl":
                    self.remember(start, 0)
            except Bad as bad:
                self.note(bad)
                self.skip(start)

    def statement(self) -> None:
        k = self.k
        t = k[self.i]
        if t in (";", "nl"):
            return
        if t in ("const", "var", "type"):
            self.declaration()
        elif t == "{":
            self.block()
        elif t == "if":
            self.if_()
        elif t == "for":
            self.for_()
        elif t == "switch":
            self.switch()
        elif t == "select":
            self.i += 1
            self.clauses()
        elif t == "return":
            self.i += 1
            if k[self.i] not in (";", "nl", "}"):
                self.expressions()
        elif t in ("break", "continue", "goto", "fallthrough"):
            self.i += 1
            if t != "fallthrough":
                self.take("name")
        elif t in ("go", "defer"):
            self.i += 1
            self.expression()
            if k[self.i - 1] != ")":
                self.fail(f"{t} needs a call")
        elif t == "name" and k[self.i + 1] == ":":
            self.i += 2
            if k[self.i] not in ("}", "nl"):
                self.statement()
        else:
            self.simple()

    def simple(self) -> None:
        k = self.k
        start = self.i
        self.expressions()
        t = k[self.i]
        if t in _ASSIGN:
            self.i += 1
            if t == ":=" and any(x != "name" for x in k[start : self.i - 1 : 2]):
                self.fail("only names can be declared")
            if k[self.i] == "range":
                self.i += 1
            self.expressions()
        elif t in ("++", "--"):
            self.i += 1
        elif t == "<-":
            self.i += 1
            self.expression()
        elif k[self.i - 1] not in (")", "}") and not (k[start] == "<-") and self.headless:
            self.fail("a value that isn't used")

    headless = True

    def head(self) -> bool:
        """The parts of a head before its block; whether the last is there."""
        k = self.k
        kept, self.level = self.level, -1
        self.headless = False
        try:
            if k[self.i] == "{":
                return False
            if k[self.i] not in (";",):
                self.simple()
            if self.take(";"):
                if k[self.i] == "{":
                    return False
                self.simple()
            return True
        finally:
            self.level, self.headless = kept, True

    def if_(self) -> None:
        self.i += 1
        if not self.head():
            self.fail("if without a condition")
        self.block()
        if self.take("else"):
            if self.k[self.i] == "if":
                self.if_()
            else:
                self.block()

    def for_(self) -> None:
        self.i += 1
        k = self.k
        kept, self.level = self.level, -1
        self.headless = False
        try:
            if k[self.i] == "range":
                self.i += 1
                self.expression()
            elif k[self.i] != "{":
                if k[self.i] != ";":
                    self.simple()
                if self.take(";"):
                    if k[self.i] != ";":
                        self.expression()
                    if k[self.i] == "nl":
                        self.fail("expected ;")
                    self.expect(";")
                    if k[self.i] != "{":
                        self.simple()
        finally:
            self.level, self.headless = kept, True
        self.block()

    def switch(self) -> None:
        self.i += 1
        self.head()
        self.clauses()

    def clauses(self) -> None:
        k = self.k
        self.expect("{")
        self.nested += 1
        try:
            while k[self.i] != "}":
                if k[self.i] in ("nl", ";"):
                    self.i += 1
                    continue
                if self.take("case"):
                    while True:
                        kept = self.i
                        try:
                            self.headless = False
                            self.simple()
                        except Bad:
                            self.i = kept
                            self.type()
                        finally:
                            self.headless = True
                        if not self.take(","):
                            break
                else:
                    self.expect("default")
                self.expect(":")
                self.statements()
        finally:
            self.nested -= 1
        self.i += 1

    # -- expressions

    def expressions(self) -> None:
        self.expression()
        while self.take(","):
            self.expression()

    def expression(self, least: int = 0) -> None:
        k = self.k
        self.unary()
        while True:
            p = _BINARY.get(k[self.i], 0)
            if p <= least:
                return
            self.i += 1
            self.expression(p)

    def unary(self) -> None:
        k = self.k
        while k[self.i] in ("+", "-", "!", "^", "*", "&", "<-"):
            if k[self.i] == "<-" and k[self.i + 1] == "chan":
                break
            self.i += 1
        self.primary()

    def primary(self) -> None:
        k = self.k
        t = k[self.i]
        literal = False  # whether a { may follow that begins a composite literal
        if t == "name":
            self.i += 1
            literal = self.level >= 0
        elif t in ("num", "str"):
            self.i += 1
        elif t == "(":
            self.i += 1
            kept, self.level = self.level, 1
            try:
                self.expression_or_type()
            finally:
                self.level = kept
            self.expect(")")
        elif t == "func":
            self.i += 1
            self.signature()
            if k[self.i] == "{":
                self.body()
        elif t in ("[", "map", "struct", "chan", "interface", "<-"):
            self.type()
            literal = True
        else:
            self.fail(f"expected an expression, found {t}")
        while True:
            t = k[self.i]
            if t == ".":
                self.i += 1
                if self.take("("):
                    if not self.take("type"):
                        self.type()
                    self.expect(")")
                else:
                    self.expect("name")
            elif t == "(":
                self.i += 1
                kept, self.level = self.level, 1
                try:
                    while k[self.i] != ")":
                        self.expression_or_type()
                        self.take("...")
                        if not self.take(","):
                            break
                finally:
                    self.level = kept
                self.expect(")")
                literal = False
            elif t == "[":
                self.i += 1
                kept, self.level = self.level, 1
                try:
                    if k[self.i] != ":":
                        self.expression_or_type()
                    while self.take(","):
                        if k[self.i] != "]":
                            self.type()
                    while self.take(":"):
                        if k[self.i] not in (":", "]"):
                            self.expression()
                finally:
                    self.level = kept
                self.expect("]")
            elif t == "{" and literal:
                self.literal_value()
                literal = False
            else:
                return

    def expression_or_type(self) -> None:
        kept = self.i
        try:
            self.expression()
        except Bad as bad:
            far = self.i
            if self.k[far] == "eof":  # a type would end there as well
                raise
            self.i = kept
            try:
                self.type()
            except Bad:
                self.i = far
                raise bad from None

    def literal_value(self) -> None:
        self.expect("{")
        k = self.k
        kept, self.level = self.level, 1
        try:
            while k[self.i] != "}":
                self.element()
                if self.take(":"):
                    self.element()
                if not self.take(","):
                    break
        finally:
            self.level = kept
        self.expect("}")

    def element(self) -> None:
        if self.k[self.i] == "{":
            self.literal_value()
        else:
            self.expression()
