"""Java."""

from __future__ import annotations

import re

from lodeglass.llm.parsing.base import Bad, Parser, line_ends

_OP = r">>>=|<<=|>>=|\.\.\.|->|::|&&|\|\||\+\+|--|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[+\-*/%&|^<>=!()\[\]{},;.:?~@]"
TOKENS = re.compile(
    rf"""[ \t\r\f\ufeff]+|(\n|//[^\n]*|/\*[\s\S]*?\*/)|([^\W\d][\w$]*|\$[\w$]*)|((?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|(?:\d[\d_]*\.?(?:\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)[lLfFdD]?(?![\w$]))|(\"{{3}}[ \t]*\n(?:[^"\\]|\\[\s\S]|"(?!""))*\"{{3}}|"(?:[^"\\\n]|\\(?:[btnfrs"'\\]|[0-7]{{1,3}}|u+[0-9a-fA-F]{{4}}))*"|'(?:[^'\\\n]|\\(?:[btnfrs"'\\]|[0-7]{{1,3}}|u+[0-9a-fA-F]{{4}}))')|({_OP})|([\s\S])"""
)
KEYWORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split()
)
_CONTEXT = frozenset("record sealed permits non var yield when module open exports requires opens uses provides to with transitive".split())
_KINDS = {w: w for w in KEYWORDS | _CONTEXT}
_NAMES = _CONTEXT | {"name"}
_PRIMITIVE = frozenset("boolean byte char short int long float double".split())
_MODIFIERS = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default sealed".split())
_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>=".split())
_BINARY = {"||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "instanceof": 7, "<<": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}


def kinds(text: str) -> tuple[list[str], list[int]]:
    out: list[str] = []
    breaks: list[int] = []
    add, known = out.append, _KINDS.get
    for gap, word, num, string, op, bad in TOKENS.findall(text):
        if op:
            add(op)
        elif word:
            add(known(word, "name"))
        elif gap:
            if gap == "\n":
                breaks.append(len(out))
        elif num:
            add("num")
        elif string:
            add("str")
        elif bad:
            add("bad")
    add("eof")
    return out, line_ends(breaks, len(out))


class Java(Parser):
    memo: set = set()

    def __init__(self, k, ends):
        super().__init__(k, ends)
        self.nested = 0
        self.closes: dict[int, int] | None = None
        self.loop = self.switch = 0

    def parse(self) -> None:
        k = self.k
        phase = 0
        while k[self.i] != "eof":
            start = self.i
            try:
                t = k[self.i]
                if t == ";":
                    self.i += 1
                elif t == "import":
                    if phase > 1:
                        self.fail("import behind declarations")
                    phase = 1
                    self.i += 1
                    self.take("static")
                    self.qualified(True)
                    self.expect(";")
                else:
                    kept = self.i
                    self.modifiers()
                    if k[self.i] == "package":
                        if phase:
                            self.fail("package behind declarations")
                        phase = 1
                        self.i += 1
                        self.qualified()
                        self.expect(";")
                    elif k[self.i] in ("module", "open") and k[self.i + 1] in _NAMES:
                        self.module()
                        phase = 2
                    else:
                        self.i = kept
                        self.type_declaration()
                        phase = 2
            except Bad as bad:
                self.note(bad)
                self.skip(start)

    def skip(self, start: int) -> None:
        k, depth = self.k, 0
        self.i = max(self.i, start + 1) if k[start] != "eof" else start
        while (t := k[self.i]) != "eof":
            if t == "{":
                depth += 1
            elif t == "}":
                if depth == 0:
                    if self.nested == 0:
                        self.i += 1
                    return
                depth -= 1
                if depth == 0:
                    self.i += 1
                    return
            elif t == ";" and depth == 0:
                self.i += 1
                return
            self.i += 1

    def name(self) -> None:
        if self.k[self.i] not in _NAMES:
            self.fail(f"expected a name, found {self.k[self.i]}")
        self.i += 1

    def qualified(self, star: bool = False) -> None:
        self.name()
        while self.take("."):
            if star and self.take("*"):
                return
            self.name()

    def module(self) -> None:
        self.take("open")
        self.i += 1
        self.qualified()
        self.expect("{")
        while self.k[self.i] not in ("}", "eof"):
            self.i += 1
        self.expect("}")

    def annotation(self) -> None:
        self.expect("@")
        self.qualified()
        if self.take("("):
            while self.k[self.i] != ")":
                if self.k[self.i] in _NAMES and self.k[self.i + 1] == "=":
                    self.i += 2
                self.element_value()
                if not self.take(","):
                    break
            self.expect(")")

    def element_value(self) -> None:
        if self.k[self.i] == "@":
            self.annotation()
        elif self.k[self.i] == "{":
            self.i += 1
            while self.k[self.i] != "}":
                self.element_value()
                if not self.take(","):
                    break
            self.expect("}")
        else:
            self.ternary()

    def modifiers(self) -> None:
        k = self.k
        while True:
            t = k[self.i]
            if t == "@" and k[self.i + 1] != "interface":
                self.annotation()
            elif t == "default" and k[self.i + 1] in (":", "->"):
                return
            elif t in _MODIFIERS and not (t == "sealed" and k[self.i + 1] not in _MODIFIERS | {"class", "interface", "@"}):
                self.i += 1
            elif t == "non" and k[self.i + 1] == "-":
                self.i += 3
            else:
                return

    def type_declaration(self) -> None:
        self.modifiers()
        k = self.k
        t = k[self.i]
        if t == "class":
            self.i += 1
            self.name()
            self.type_parameters()
            if self.take("extends"):
                self.type()
            self.clauses()
            self.class_body(self.member)
        elif t == "interface" or t == "@" and k[self.i + 1] == "interface":
            self.take("@")
            self.i += 1
            self.name()
            self.type_parameters()
            if self.take("extends"):
                self.types()
            self.clauses()
            self.class_body(self.member)
        elif t == "enum":
            self.i += 1
            self.name()
            self.clauses()
            self.class_body(self.member, self.constants)
        elif t == "record" and k[self.i + 1] in _NAMES:
            self.i += 1
            self.name()
            self.type_parameters()
            self.parameters()
            self.clauses()
            self.class_body(self.member)
        else:
            self.fail(f"expected a type declaration, found {t}")

    def types(self) -> None:
        self.type()
        while self.take(","):
            self.type()

    def clauses(self) -> None:
        while self.k[self.i] in ("implements", "permits"):
            self.i += 1
            self.types()

    def constants(self) -> None:
        k = self.k
        while k[self.i] in _NAMES or k[self.i] == "@":
            while k[self.i] == "@":
                self.annotation()
            self.name()
            if k[self.i] == "(":
                self.arguments()
            if k[self.i] == "{":
                self.class_body(self.member)
            if not self.take(","):
                break
        if k[self.i] != "}":
            self.expect(";")

    def class_body(self, member, first=None) -> None:
        self.expect("{")
        self.nested += 1
        kept = self.loop, self.switch
        self.loop = self.switch = 0
        try:
            if first:
                first()
            while self.k[self.i] != "}":
                if self.k[self.i] == "eof":
                    self.fail("the body isn't closed")
                start = self.i
                try:
                    member()
                except Bad as bad:
                    self.note(bad)
                    self.skip(start)
        finally:
            self.nested -= 1
            self.loop, self.switch = kept
        self.i += 1

    def member(self) -> None:
        k = self.k
        if self.take(";"):
            return
        if k[self.i] == "{" or k[self.i] == "static" and k[self.i + 1] == "{":
            self.take("static")
            self.block()
            return
        kept = self.i
        self.modifiers()
        t = k[self.i]
        if t in ("class", "interface", "enum", "@") or t == "record" and k[self.i + 1] in _NAMES and k[self.i + 2] in ("(", "<"):
            self.i = kept
            self.type_declaration()
            return
        self.type_parameters()
        while k[self.i] == "@":
            self.annotation()
        if k[self.i] in _NAMES and k[self.i + 1] == "(":  # constructor
            self.i += 1
            self.parameters()
            self.throws()
            self.block()
            return
        if k[self.i] in _NAMES and k[self.i + 1] == "{":  # compact constructor
            self.i += 1
            self.block()
            return
        if not self.take("void"):
            self.type()
        self.name()
        if k[self.i] == "(":
            self.parameters()
            self.dimensions()
            self.throws()
            if self.take("default"):
                self.element_value()
            if not self.take(";"):
                self.block()
            return
        self.declarators()
        self.expect(";")

    def throws(self) -> None:
        if self.take("throws"):
            self.types()

    def dimensions(self) -> None:
        while self.k[self.i] == "[" and self.k[self.i + 1] == "]":
            self.i += 2

    def declarators(self) -> None:
        """Behind the first name."""
        while True:
            self.dimensions()
            if self.take("="):
                self.initializer()
            if not self.take(","):
                return
            self.name()

    def initializer(self) -> None:
        if self.k[self.i] == "{":
            self.i += 1
            while self.k[self.i] != "}":
                self.initializer()
                if not self.take(","):
                    break
            self.expect("}")
        else:
            self.expression()

    def parameters(self) -> None:
        self.expect("(")
        while self.k[self.i] != ")":
            self.modifiers()
            self.type()
            while self.k[self.i] == "@":
                self.annotation()
            self.take("...")
            if self.k[self.i] in _NAMES and self.k[self.i + 1] == ".":
                self.name()
                self.i += 1
            if not self.take("this"):
                self.name()
            self.dimensions()
            if not self.take(","):
                break
        self.expect(")")

    # -- types

    def type_parameters(self) -> None:
        if self.take("<"):
            while True:
                while self.k[self.i] == "@":
                    self.annotation()
                self.name()
                if self.take("extends"):
                    self.type()
                    while self.take("&"):
                        self.type()
                if not self.take(","):
                    break
            self.expect(">")

    def type(self) -> None:
        k = self.k
        while k[self.i] == "@":
            self.annotation()
        if k[self.i] in _PRIMITIVE:
            self.i += 1
        else:
            while True:
                self.name()
                if k[self.i] == "<":
                    self.type_arguments()
                if k[self.i] != "." or k[self.i + 1] not in _NAMES and k[self.i + 1] != "@":
                    break
                self.i += 1
                while k[self.i] == "@":
                    self.annotation()
        while k[self.i] == "[" and k[self.i + 1] == "]" or k[self.i] == "@" and k[self.i + 1] != "interface":
            if k[self.i] == "@":
                self.annotation()
            else:
                self.i += 2

    def type_arguments(self) -> None:
        self.expect("<")
        if self.take(">"):
            return
        while True:
            while self.k[self.i] == "@":
                self.annotation()
            if self.take("?"):
                if self.k[self.i] in ("extends", "super"):
                    self.i += 1
                    self.type()
            else:
                self.type()
            if not self.take(","):
                break
        self.expect(">")

    # -- statements

    def block(self) -> None:
        self.expect("{")
        self.nested += 1
        try:
            while self.k[self.i] != "}":
                if self.k[self.i] == "eof":
                    self.fail("the block isn't closed")
                self.guarded()
        finally:
            self.nested -= 1
        self.i += 1

    def guarded(self) -> None:
        start = self.i
        try:
            self.statement()
        except Bad as bad:
            self.note(bad)
            self.skip(start)

    def statement(self) -> None:
        k, i = self.k, self.i
        single = k[self.ends[i] - 1] == ";" and k[i] != "for"
        if single:
            context = (self.loop > 0, self.switch > 0)
            if self.known(context):
                return
        self.any_statement()
        if single:
            self.remember(i, context)

    def parens(self) -> None:
        self.expect("(")
        self.expression()
        self.expect(")")

    def any_statement(self) -> None:
        k = self.k
        t = k[self.i]
        if t == "{":
            self.block()
        elif t == ";":
            self.i += 1
        elif t == "if":
            self.i += 1
            self.parens()
            self.sub()
            if self.take("else"):
                self.sub()
        elif t == "while":
            self.i += 1
            self.parens()
            self.looped()
        elif t == "do":
            self.i += 1
            self.looped()
            self.expect("while")
            self.parens()
            self.expect(";")
        elif t == "for":
            self.for_()
        elif t == "return":
            self.i += 1
            if k[self.i] != ";":
                self.expression()
            self.expect(";")
        elif t == "throw":
            self.i += 1
            self.expression()
            self.expect(";")
        elif t in ("break", "continue"):
            self.i += 1
            if k[self.i] in _NAMES:
                self.i += 1
            elif not self.loop and not (t == "break" and self.switch):
                self.fail(f"{t} outside a loop")
            self.expect(";")
        elif t == "yield" and k[self.i + 1] not in ("=", ".", "(", "[", "++", "--"):
            self.i += 1
            self.expression()
            self.expect(";")
        elif t == "try":
            self.try_()
        elif t == "switch":
            self.switch_()
            if k[self.i] in (".", ";") and k[self.i] == ";":
                self.i += 1
        elif t == "synchronized" and k[self.i + 1] == "(":
            self.i += 1
            self.parens()
            self.block()
        elif t == "assert":
            self.i += 1
            self.expression()
            if self.take(":"):
                self.expression()
            self.expect(";")
        elif t in _NAMES and k[self.i + 1] == ":":
            self.i += 2
            self.statement()
        elif t in ("class", "interface", "enum", "abstract", "static", "strictfp") or t == "record" and k[self.i + 1] in _NAMES and k[self.i + 2] in ("(", "<"):
            self.type_declaration()
        elif t in ("final", "@"):
            kept = self.i
            self.modifiers()
            if k[self.i] in ("class", "interface", "enum", "record") and k[self.i + 1] in _NAMES:
                self.i = kept
                self.type_declaration()
            else:
                self.local()
                self.expect(";")
        elif self.is_local():
            self.local()
            self.expect(";")
        else:
            start = self.i
            self.expression()
            if not (k[self.i - 1] in (")", "++", "--") or self.effect or k[start] in ("++", "--")):
                self.fail("not a statement")
            self.expect(";")

    effect = False

    def sub(self) -> None:
        if self.is_local() or self.k[self.i] in ("class", "final"):
            self.fail("declaration where a statement must stand")
        self.statement()

    def looped(self) -> None:
        self.loop += 1
        try:
            self.sub()
        finally:
            self.loop -= 1

    def is_local(self) -> bool:
        k = self.k
        t = k[self.i]
        if t in _PRIMITIVE:
            return k[self.i + 1] not in (".", "::") and not (k[self.i + 1] == "[" and k[self.i + 3] in (".", "::"))
        if t not in _NAMES:
            return False
        n = k[self.i + 1]
        if n in _NAMES:
            return True
        if n not in ("<", ".", "[", "@"):
            return False
        kept = self.i
        try:
            self.type()
            return k[self.i] in _NAMES and k[self.i + 1] in ("=", ";", ",", ":", "[")
        except Bad:
            return False
        finally:
            self.i = kept

    def local(self) -> None:
        self.type()
        self.name()
        self.declarators()

    def for_(self) -> None:
        k = self.k
        self.i += 1
        self.expect("(")
        kept = self.i
        self.modifiers()
        if self.i > kept or self.is_local():
            self.type()
            self.name()
            if self.take(":"):
                self.expression()
                self.expect(")")
                self.looped()
                return
            self.declarators()
        elif k[self.i] != ";":
            self.expressions()
        self.expect(";")
        if k[self.i] != ";":
            self.expression()
        self.expect(";")
        if k[self.i] != ")":
            self.expressions()
        self.expect(")")
        self.looped()

    def expressions(self) -> None:
        self.expression()
        while self.take(","):
            self.expression()

    def try_(self) -> None:
        k = self.k
        self.i += 1
        resources = self.take("(")
        if resources:
            while k[self.i] != ")":
                kept = self.i
                self.modifiers()
                if self.i > kept or self.is_local():
                    self.type()
                    self.name()
                    self.expect("=")
                self.expression()
                if not self.take(";"):
                    break
            self.expect(")")
        self.block()
        caught = False
        while self.take("catch"):
            caught = True
            self.expect("(")
            self.modifiers()
            self.type()
            while self.take("|"):
                self.type()
            self.name()
            self.expect(")")
            self.block()
        if self.take("finally"):
            self.block()
        elif not caught and not resources:
            self.fail("try without catch or finally")

    def switch_(self) -> None:
        k = self.k
        self.expect("switch")
        self.parens()
        self.expect("{")
        self.nested += 1
        self.switch += 1
        try:
            while k[self.i] != "}":
                if self.take("default"):
                    pass
                else:
                    self.expect("case")
                    while True:
                        if not self.take("default"):
                            self.case_label()
                        if not self.take(","):
                            break
                    if self.take("when"):
                        self.expression()
                if self.take("->"):
                    if k[self.i] in ("{", "throw"):
                        self.statement()
                    else:
                        self.expression()
                        self.expect(";")
                else:
                    self.expect(":")
                    while k[self.i] not in ("case", "default", "}", "eof"):
                        self.guarded()
        finally:
            self.nested -= 1
            self.switch -= 1
        self.i += 1

    def case_label(self) -> None:
        kept = self.i
        try:
            self.pattern()
            if self.k[self.i] not in ("->", ":", ",", "when"):
                raise Bad(self.i, "")
        except Bad:
            self.i = kept
            self.ternary()

    def pattern(self) -> None:
        self.modifiers()
        self.type()
        if self.take("("):
            while self.k[self.i] != ")":
                self.pattern()
                if not self.take(","):
                    break
            self.expect(")")
            if self.k[self.i] in _NAMES and self.k[self.i] != "when":
                self.i += 1
        else:
            self.name()

    # -- expressions

    def expression(self) -> None:
        self.effect = False
        if self.lambda_():
            return
        simple = self.ternary()
        if self.k[self.i] in _ASSIGN or self.k[self.i] == ">" and self.shift_assign():
            if not simple:
                self.fail("can't be assigned to")
            self.i += 1
            self.expression()
            self.effect = True

    def shift_assign(self) -> bool:
        k, i = self.k, self.i
        n = 1 if k[i + 1] == ">=" else 2 if k[i + 1] == ">" and k[i + 2] == ">=" else 0
        self.i += n
        return n > 0

    def closing(self, at: int) -> int:
        """The place of the parenthesis that closes the one at a place before any ; or {, or -1; all are paired once."""
        if self.closes is None:
            self.closes, opened = {}, []
            for j, t in enumerate(self.k):
                if t == "(":
                    opened.append(j)
                elif t == ")":
                    if opened:
                        self.closes[opened.pop()] = j
                elif t in (";", "{"):
                    opened.clear()
        return self.closes.get(at, -1)

    def lambda_(self) -> bool:
        k, i = self.k, self.i
        t = k[i]
        if t in _NAMES and k[i + 1] == "->":
            self.i += 2
        elif t == "(":
            j = self.closing(i)
            if j < 0 or k[j + 1] != "->":
                return False
            if k[i + 1] in _NAMES and k[i + 2] in (",", ")"):
                self.i += 1
                self.name()
                while self.take(","):
                    self.name()
                self.expect(")")
            else:
                self.parameters()
            self.expect("->")
        else:
            return False
        if k[self.i] == "{":
            kept = self.loop, self.switch
            self.loop = self.switch = 0
            self.block()
            self.loop, self.switch = kept
        else:
            self.expression()
        return True

    def ternary(self) -> bool:
        simple = self.binary(0)
        if self.take("?"):
            if not self.lambda_():
                self.ternary()
            self.expect(":")
            if not self.lambda_():
                self.ternary()
            return False
        return simple

    def binary(self, least: int) -> bool:
        k = self.k
        simple = self.unary()
        while True:
            t = k[self.i]
            p = _BINARY.get(t, 0)
            if t == ">" and k[self.i + 1] == ">":  # a shift
                n = 3 if k[self.i + 2] == ">" else 2
                if k[self.i + n] == ">=" or k[self.i + 1] == ">" and k[self.i + 2] == ">=":
                    return simple
                if least >= 8:
                    return simple
                self.i += n
                self.binary(8)
                simple = False
                continue
            if t == ">" and k[self.i + 1] == ">=":
                return simple
            if p <= least:
                return simple
            self.i += 1
            if t == "instanceof":
                self.take("final")
                kept = self.i
                try:
                    self.pattern()
                except Bad:
                    self.i = kept
                    self.type()
            else:
                self.binary(p)
            simple = False

    def unary(self) -> bool:
        k = self.k
        t = k[self.i]
        if t in ("+", "-", "!", "~", "++", "--"):
            self.i += 1
            self.unary()
            return False
        if t == "(" and self.cast():
            return False
        simple = self.primary()
        while k[self.i] in ("++", "--"):
            if not simple:
                self.fail("can't be changed")
            self.i += 1
            simple = False
        return simple

    def cast(self) -> bool:
        k = self.k
        kept = self.i
        self.i += 1
        try:
            primitive = k[self.i] in _PRIMITIVE
            self.type()
            primitive = primitive and k[self.i - 1] in _PRIMITIVE
            while self.take("&"):
                self.type()
            self.expect(")")
            t = k[self.i]
            if primitive or t in _NAMES or t in ("(", "!", "~", "str", "num", "this", "super", "new", "true", "false", "null", "switch") or t in _PRIMITIVE:
                if not self.lambda_():
                    self.unary()
                return True
        except Bad:
            pass
        self.i = kept
        return False

    def arguments(self) -> None:
        self.expect("(")
        while self.k[self.i] != ")":
            self.expression()
            if not self.take(","):
                break
        self.expect(")")

    def primary(self) -> bool:
        k = self.k
        t = k[self.i]
        simple = False
        if t in _NAMES:
            self.i += 1
            simple = True
            if k[self.i] in ("<", "[", "."):
                self.method_reference()
        elif t in ("num", "str", "true", "false", "null", "this"):
            self.i += 1
        elif t == "super":
            self.i += 1
            if k[self.i] not in (".", "(", "::"):
                self.fail("super stands alone")
        elif t == "(":
            self.i += 1
            self.expression()
            self.expect(")")
            simple = True
        elif t == "new":
            self.creator()
        elif t == "switch":
            self.switch_()
        elif t in _PRIMITIVE or t == "void":
            self.i += 1
            self.dimensions()
            if self.take("."):
                self.expect("class")
            elif k[self.i] != "::":
                self.fail("a type in an expression")
        else:
            self.fail(f"expected an expression, found {t}")
        while True:
            t = k[self.i]
            if t == "(":
                self.arguments()
                simple = False
            elif t == ".":
                self.i += 1
                if k[self.i] == "<":
                    self.type_arguments()
                if k[self.i] == "new":
                    self.creator()
                    simple = False
                elif k[self.i] in ("class", "this", "super"):
                    self.i += 1
                    simple = False
                else:
                    self.name()
                    simple = True
            elif t == "[":
                self.i += 1
                if self.take("]"):
                    self.dimensions()
                    if self.take("."):
                        self.expect("class")
                    elif k[self.i] != "::":
                        self.fail("an index is missing")
                    simple = False
                    continue
                self.expression()
                self.expect("]")
                simple = True
            elif t == "::":
                self.i += 1
                if k[self.i] == "<":
                    self.type_arguments()
                if not self.take("new"):
                    self.name()
                simple = False
            else:
                return simple

    def method_reference(self) -> None:
        """Skip the type arguments of a type before ::, if there is one."""
        kept = self.i
        if self.k[kept] == "<":
            try:
                self.i -= 1
                self.type()
                if self.k[self.i] == "::":
                    return
            except Bad:
                pass
            self.i = kept

    def creator(self) -> None:
        k = self.k
        self.expect("new")
        while k[self.i] == "@":
            self.annotation()
        if k[self.i] == "<":
            self.type_arguments()
        if k[self.i] in _PRIMITIVE:
            self.i += 1
        else:
            while True:
                self.name()
                if k[self.i] == "<":
                    self.type_arguments()
                if not self.take("."):
                    break
        if k[self.i] == "[":
            sized = False
            while k[self.i] == "[":
                self.i += 1
                if not self.take("]"):
                    self.expression()
                    self.expect("]")
                    sized = True
            if not sized:
                self.initializer()
        else:
            self.arguments()
            if k[self.i] == "{":
                self.class_body(self.member)
