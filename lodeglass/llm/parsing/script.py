"""ECMAScript modules and TypeScript."""

from __future__ import annotations

import re

from lodeglass.llm.parsing.base import Bad, Parser, line_ends

_WORD = r"(?:[A-Za-z_$\u00aa\u00b5\u00c0-\u1fff\u2c00-\ufdff]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$\u00aa-\u1fff\u200c\u200d\u2c00-\ufdff]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*"
_NUM = r"0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[bB][01](?:_?[01])*n?|0[oO][0-7](?:_?[0-7])*n?|(?:0(?![\d_])|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?(?:[eE][+-]?\d+)?n?|\.\d(?:_?\d)*(?:[eE][+-]?\d+)?"
_STR = r""""(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'"""
_TMPL = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{[^`{}]*\})*`"
_OP = r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@]"
TOKENS = re.compile(rf"[ \t\v\f\r\u00a0\ufeff]+|(\n|\u2028|\u2029|//[^\n]*|/\*[\s\S]*?\*/|\A#![^\n]*)|(#?{_WORD})|((?:{_NUM})(?![\w$]))|({_STR})|({_TMPL})|({_OP})|([\s\S])")
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_MAYBE_REGEX = re.compile(r"(?:[=(,:\[!&|?{};+\-~^<>%]|\b(?:return|typeof|case|do|else|in|of|void|delete|await|yield))\s*/(?![/*])")
_INNER = re.compile(r"\$\{([^`{}]*)\}")

RESERVED = frozenset("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum".split())
STRICT = frozenset("let static yield await implements interface package private protected public".split())
CONTEXT = frozenset("async of get set as from type interface namespace module declare abstract readonly keyof unique infer is asserts satisfies override require global accessor out static let yield await implements private protected public package".split())
_NAMES = CONTEXT | {"name"}
_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
_UNARY = frozenset("! ~ + - typeof void delete ++ --".split())
_BEFORE_REGEX = frozenset("( , = : [ ! & | ? { } ; + - * % ~ ^ < > => == != === !== <= >= && || ?? ++ -- += -= *= %= return typeof case do else in of void delete await yield instanceof new throw".split()) | {None}
_KINDS = {w: w for w in RESERVED | CONTEXT}


def kinds(text: str, ts: bool) -> tuple[list[str], list[int], list[bool]]:
    """Kinds of the tokens, ends of lines, and whether a line break stands before each token."""
    if _MAYBE_REGEX.search(text) or "`" in text and ("${" in text and re.search(r"\$\{[^`}]*[`{]", text)):
        found = _careful(text)
    else:
        found = TOKENS.findall(text)
    out: list[str] = []
    breaks: list[int] = []
    broken: set[int] = set()
    known = _KINDS.get
    add = out.append
    for gap, word, num, string, tmpl, op, bad in found:
        if op:
            add(op)
        elif word:
            add(known(word, "name") if word[0] != "#" else "#name")
        elif gap:
            if gap == "\n":
                if not breaks or breaks[-1] != len(out):
                    breaks.append(len(out))
                    broken.add(len(out))
            elif "\n" in gap:
                broken.add(len(out))
        elif num:
            add("num")
        elif string:
            add("str")
        elif tmpl:
            add("tmpl" if "${" not in tmpl or all(_expression_ok(x, ts) for x in _INNER.findall(tmpl)) or tmpl == "`n`" else "bad")
        elif bad:
            add("bad")
    add("eof")
    return out, line_ends(breaks, len(out)), broken


#: Declarations at the start of a line or behind a semicolon; only files with two of one name are looked at closely.
_DECLARED = re.compile(r"(?:^|;[ \t]*)(?:export[ \t]+)?(?:default[ \t]+)?(?:let|const|class|var|(?:async[ \t]+)?function[ \t]*\*?)[ \t]+([\w$]+)", re.M)


def redeclared(text: str) -> list[tuple[int, str]]:
    """(line, message) of the names that a valid module declares twice at its top level, other than by var alone."""
    names = _DECLARED.findall(text)
    if len(set(names)) == len(names):
        return []
    out, known = [], {}
    depth, line, waiting, last, fresh = 0, 1, None, None, True
    for token in _careful(text):
        gap, word, _, _, _, op, _ = token
        whole = "".join(token)
        if word:
            if waiting:
                if known.get(word, waiting) != waiting or word in known and waiting != "var":
                    out.append((line, f"{word} is declared twice"))
                known[word], waiting = waiting, None
            elif depth == 0 and word in ("let", "const", "class", "var", "function") and (fresh or last in (None, ";", "}", "export", "default", "async")):
                waiting = word
        elif op:
            if op != "*":
                waiting = None
            depth += (op in ("(", "[", "{")) - (op in (")", "]", "}"))
        if gap:
            fresh = fresh or "\n" in gap
        elif whole:
            last, fresh = word or op, False
        line += whole.count("\n")
    return out


def _careful(text: str) -> list[tuple]:
    """As TOKENS.findall, with regular expressions and nested templates told apart by what stands before."""
    out: list[tuple] = []
    at, last, n = 0, None, len(text)
    while at < n:
        c = text[at]
        if c == "/" and last in _BEFORE_REGEX and not text.startswith(("//", "/*"), at) and (m := _REGEX.match(text, at)):
            out.append(("", "", "", m.group(), "", "", ""))
            at, last = m.end(), "str"
            continue
        if c == "`":
            end, inner = _template(text, at)
            if end < 0:
                out.append(("", "", "", "", "", "", c))
                at += 1
                continue
            good = all(_expression_ok(x, True) for x in inner)
            out.append(("", "", "", "", "`n`" if good else "`${)}`", "", ""))
            at, last = end, "tmpl"
            continue
        m = TOKENS.match(text, at)
        g = tuple(x or "" for x in m.groups())
        if any(g):
            out.append(g)
            if not g[0]:
                last = g[5] or (g[1] if g[1] in RESERVED or g[1] in ("of", "await", "yield") else "x")
                if g[5] in (")", "]"):
                    last = "x"
        at = m.end()
    return out


def _template(text: str, at: int) -> tuple[int, list[str]]:
    """End of the template at a place, or -1, and the texts of its expressions."""
    inner, at, n = [], at + 1, len(text)
    while at < n:
        c = text[at]
        if c == "\\":
            at += 2
        elif c == "`":
            return at + 1, inner
        elif text.startswith("${", at):
            depth, start = 1, at + 2
            at = start
            while at < n and depth:
                c = text[at]
                if c == "`":
                    at = _template(text, at)[0]
                    if at < 0:
                        return -1, inner
                    continue
                if c in "\"'" and (m := re.compile(_STR).match(text, at)):
                    at = m.end()
                    continue
                depth += (c == "{") - (c == "}")
                at += 1
            inner.append(text[start : at - 1])
        else:
            at += 1
    return -1, inner


_inner_memo: dict[tuple, bool] = {}


def _expression_ok(text: str, ts: bool) -> bool:
    k, ends, broken = kinds(text, ts)
    key = (ts, *k)
    if key not in _inner_memo:
        p = Script(k, ends, broken, ts)
        try:
            p.expression()
            good = p.k[p.i] == "eof"
        except Bad:
            good = False
        if len(_inner_memo) > 100_000:
            _inner_memo.clear()
        _inner_memo[key] = good
    return _inner_memo[key]


class Script(Parser):
    memo: set = set()

    def __init__(self, k, ends, broken, ts: bool):
        super().__init__(k, ends)
        self.broken, self.ts = broken, ts
        self.function = self.loop = self.switch = False
        self.no_in = False
        self.closes: dict[int, int] | None = None
        self.untyped: set[int] = set()

    # -- statements

    def parse(self) -> None:
        while self.k[self.i] != "eof":
            self.guarded()

    def guarded(self) -> None:
        start = self.i
        try:
            self.statement()
        except Bad as bad:
            self.note(bad)
            self.recover(start)

    def recover(self, start: int) -> None:
        """Skip to behind the next ; or line, or before the brace that closes what is open."""
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
            elif t == ";" and depth == 0:
                self.i += 1
                return
            elif depth == 0 and self.i in self.broken and t in ("import", "export", "const", "let", "var", "function", "class", "if", "for", "while", "return", "try"):
                return
            self.i += 1

    nested = 0

    def block(self) -> None:
        self.expect("{")
        self.nested += 1
        try:
            while self.k[self.i] != "}":
                if self.k[self.i] == "eof":
                    self.fail("block isn't closed")
                self.guarded()
        finally:
            self.nested -= 1
        self.i += 1

    def end(self) -> None:
        """; or what stands for it."""
        t = self.k[self.i]
        if t == ";":
            self.i += 1
        elif t != "}" and t != "eof" and self.i not in self.broken:
            self.fail(f"expected ;, found {t}")

    def statement(self) -> None:
        k, i = self.k, self.i
        t = k[i]
        single = k[self.ends[i] - 1] == ";" and t != "for"
        if single:
            context = (self.ts, self.function, self.loop, self.switch)
            if self.known(context):
                return
        method = _STATEMENTS.get(t)
        if method:
            method(self)
        else:
            self.other(t)
        if single:
            self.remember(i, context)

    def other(self, t: str) -> None:
        k, i = self.k, self.i
        if t in _NAMES:
            n = k[i + 1]
            if n == ":":
                self.i += 2
                self.statement()
                return
            if t == "let" and (n in _NAMES or n in ("[", "{")):
                self.variables()
                return
            if t == "async" and n == "function" and i + 1 not in self.broken:
                self.i += 1
                self.function_statement()
                return
            if self.ts and i + 1 not in self.broken:
                if t == "type" and n in _NAMES:
                    self.i += 1
                    self.name()
                    self.type_parameters()
                    self.expect("=")
                    self.type()
                    self.end()
                    return
                if t == "interface" and n in _NAMES:
                    self.interface()
                    return
                if t == "abstract" and n == "class":
                    self.i += 1
                    self.class_()
                    return
                if t == "declare" and (n in _NAMES or n in ("function", "class", "const", "var", "enum", "export")):
                    self.i += 1
                    if k[self.i] == "global" and k[self.i + 1] == "{":
                        self.i += 1
                        self.block()
                    else:
                        self.statement()
                    return
                if t in ("namespace", "module") and (n in _NAMES or n == "str"):
                    self.i += 2
                    while self.take("."):
                        self.name()
                    if k[self.i] == "{":
                        self.block()
                    else:
                        self.end()
                    return
        self.expression()
        self.end()

    def variables(self) -> None:
        constant = self.k[self.i] == "const"
        self.i += 1
        while True:
            destructured = self.k[self.i] in ("[", "{")
            self.binding()
            if self.ts:
                self.take("!")
                self.annotation()
            if self.take("="):
                self.assignment()
            elif constant and not self.ts and not (self.no_in and self.k[self.i] in ("of", "in")):
                self.fail("a constant needs a value")
            elif destructured and not (self.no_in and self.k[self.i] in ("of", "in")):
                self.fail("a pattern needs a value")
            if not self.take(","):
                break
        if not self.no_in:
            self.end()

    def const(self) -> None:
        if self.ts and self.k[self.i + 1] == "enum":
            self.i += 1
            self.enum()
            return
        self.variables()

    def enum(self) -> None:
        if not self.ts:
            self.fail("enum is reserved")
        self.i += 1
        self.name()
        self.expect("{")
        while self.k[self.i] != "}":
            if self.k[self.i] in ("str", "["):
                if self.take("["):
                    self.expect("str")
                    self.expect("]")
                else:
                    self.i += 1
            else:
                self.property_word()
            if self.take("="):
                self.assignment()
            if not self.take(","):
                break
        self.expect("}")

    def interface(self) -> None:
        self.i += 1
        self.name()
        self.type_parameters()
        if self.take("extends"):
            self.type()
            while self.take(","):
                self.type()
        self.object_type()

    def empty(self) -> None:
        self.i += 1

    def if_(self) -> None:
        self.i += 1
        self.parens()
        self.statement_in()
        if self.take("else"):
            self.statement_in()

    def statement_in(self) -> None:
        """The statement under a head, of which a declaration is none."""
        t = self.k[self.i]
        if t in ("class", "const", "import", "export") or t == "let" and self.k[self.i + 1] in ("[",):
            self.fail("declaration where a statement must stand")
        self.statement()

    def parens(self) -> None:
        self.expect("(")
        kept, self.no_in = self.no_in, False
        self.expression()
        self.no_in = kept
        self.expect(")")

    def looped(self) -> None:
        kept, self.loop = self.loop, True
        try:
            self.statement_in()
        finally:
            self.loop = kept

    def while_(self) -> None:
        self.i += 1
        self.parens()
        self.looped()

    def do(self) -> None:
        self.i += 1
        self.looped()
        self.expect("while")
        self.parens()
        self.take(";")

    def for_(self) -> None:
        self.i += 1
        self.take("await")
        self.expect("(")
        k = self.k
        kept, self.no_in = self.no_in, True
        try:
            if k[self.i] != ";":
                if k[self.i] in ("var", "const") or k[self.i] == "let" and (k[self.i + 1] in _NAMES or k[self.i + 1] in ("[", "{")):
                    self.variables()
                else:
                    self.expression()
        finally:
            self.no_in = kept
        self.no_in = False
        try:
            if self.take("of"):
                self.assignment()
            elif self.take("in"):
                self.expression()
            else:
                self.expect(";")
                if k[self.i] != ";":
                    self.expression()
                self.expect(";")
                if k[self.i] != ")":
                    self.expression()
        finally:
            self.no_in = kept
        self.expect(")")
        self.looped()

    def switch_(self) -> None:
        self.i += 1
        self.parens()
        self.expect("{")
        kept, self.switch = self.switch, True
        self.nested += 1
        try:
            while not self.take("}"):
                if self.take("default"):
                    pass
                else:
                    self.expect("case")
                    self.expression()
                self.expect(":")
                while self.k[self.i] not in ("case", "default", "}", "eof"):
                    self.guarded()
        finally:
            self.switch = kept
            self.nested -= 1

    def try_(self) -> None:
        self.i += 1
        self.block()
        caught = self.take("catch")
        if caught:
            if self.take("("):
                self.binding()
                if self.ts:
                    self.annotation()
                self.expect(")")
            self.block()
        if self.take("finally"):
            self.block()
        elif not caught:
            self.fail("try without catch or finally")

    def throw(self) -> None:
        self.i += 1
        if self.i in self.broken:
            self.fail("nothing is thrown")
        self.expression()
        self.end()

    def return_(self) -> None:
        if not self.function:
            self.fail("return outside a function")
        self.i += 1
        if self.k[self.i] not in (";", "}", "eof") and self.i not in self.broken:
            self.expression()
        self.end()

    def jump(self) -> None:
        word = self.k[self.i]
        self.i += 1
        if self.k[self.i] in _NAMES and self.i not in self.broken:
            self.i += 1
        elif not self.loop and not (word == "break" and self.switch):
            self.fail(f"{word} outside a loop")
        self.end()

    def debugger(self) -> None:
        self.i += 1
        self.end()

    def import_(self) -> None:
        k = self.k
        if k[self.i + 1] in ("(", "."):
            self.expression()
            self.end()
            return
        if self.nested and not self.ts:
            self.fail("import inside a block")
        self.i += 1
        if not self.take("str"):
            if self.ts and k[self.i] == "type" and (k[self.i + 1] in ("{", "*") or k[self.i + 1] in _NAMES and k[self.i + 1] != "from"):
                self.i += 1
            more = True
            if k[self.i] in _NAMES:
                self.i += 1
                if self.ts and self.take("="):
                    if self.take("require"):
                        self.parens()
                    else:
                        self.name()
                        while self.take("."):
                            self.name()
                    self.end()
                    return
                more = self.take(",")
            if more:
                if self.take("*"):
                    self.expect("as")
                    self.name()
                else:
                    self.specifiers()
            self.expect("from")
            self.expect("str")
        self.attributes()
        self.end()

    def attributes(self) -> None:
        if self.k[self.i] == "with" and self.i not in self.broken:
            self.i += 1
            self.object_literal()

    def specifiers(self) -> None:
        self.expect("{")
        while self.k[self.i] != "}":
            if self.ts and self.k[self.i] == "type" and self.k[self.i + 1] not in (",", "}", "as"):
                self.i += 1
            self.module_name()
            if self.take("as"):
                self.module_name()
            if not self.take(","):
                break
        self.expect("}")

    def module_name(self) -> None:
        if not self.take("str"):
            self.property_word()

    def property_word(self) -> None:
        t = self.k[self.i]
        if t not in _NAMES and t not in RESERVED:
            self.fail(f"expected a name, found {t}")
        self.i += 1

    def export(self) -> None:
        if self.nested and not self.ts:
            self.fail("export inside a block")
        self.i += 1
        k = self.k
        t = k[self.i]
        if t == "default":
            self.i += 1
            t = k[self.i]
            if t == "function" or t == "async" and k[self.i + 1] == "function":
                self.take("async")
                self.function_(False)
            elif t == "class" or t == "@" or self.ts and t == "abstract":
                self.decorators()
                self.take("abstract")
                self.class_(False)
            elif self.ts and t == "interface":
                self.interface()
            else:
                self.assignment()
                self.end()
        elif t == "*":
            self.i += 1
            if self.take("as"):
                self.module_name()
            self.expect("from")
            self.expect("str")
            self.attributes()
            self.end()
        elif t == "{" or self.ts and t == "type" and k[self.i + 1] in ("{", "*"):
            self.take("type")
            if self.take("*"):
                if self.take("as"):
                    self.module_name()
                self.expect("from")
                self.expect("str")
            else:
                self.specifiers()
                if self.take("from"):
                    self.expect("str")
            self.attributes()
            self.end()
        elif self.ts and t == "=":
            self.i += 1
            self.expression()
            self.end()
        elif t in ("function", "class", "const", "let", "var", "@") or t == "async" and k[self.i + 1] == "function":
            self.statement()
        elif self.ts and t in ("type", "interface", "enum", "declare", "abstract", "namespace", "module", "import"):
            if t == "import":
                self.import_()
            else:
                self.statement()
        else:
            self.fail(f"{t} can't be exported")

    # -- functions and classes

    def function_statement(self) -> None:
        self.function_(True)

    def function_(self, named: bool) -> None:
        self.expect("function")
        self.take("*")
        if self.k[self.i] in _NAMES:
            self.i += 1
        elif named:
            self.fail("a function needs a name")
        self.rest_of_function(self.ts)

    def rest_of_function(self, may_lack_body: bool = False) -> None:
        if self.ts:
            self.type_parameters()
        self.parameters()
        if self.ts and self.take(":"):
            self.return_type()
        if may_lack_body and self.k[self.i] != "{":
            self.end()
        else:
            self.body()

    def body(self) -> None:
        kept = self.function, self.loop, self.switch, self.no_in
        self.function, self.loop, self.switch, self.no_in = True, False, False, False
        try:
            self.block()
        finally:
            self.function, self.loop, self.switch, self.no_in = kept

    def parameters(self) -> None:
        self.expect("(")
        k = self.k
        kept, self.no_in = self.no_in, False
        while k[self.i] != ")":
            self.decorators()
            if self.ts:
                while k[self.i] in ("public", "private", "protected", "readonly", "override") and (k[self.i + 1] in _NAMES or k[self.i + 1] in ("{", "[")):
                    self.i += 1
            rest = self.take("...")
            if self.ts and k[self.i] == "this":
                self.i += 1
            else:
                self.binding()
            if self.ts:
                self.take("?")
                self.annotation()
            if not rest and self.take("="):
                self.assignment()
            if rest and k[self.i] != ")" or not self.take(","):
                break
        self.no_in = kept
        self.expect(")")

    def binding(self) -> None:
        t = self.k[self.i]
        if t in _NAMES:
            self.i += 1
        elif t == "[":
            self.i += 1
            while self.k[self.i] != "]":
                if self.take(","):
                    continue
                self.take("...")
                self.binding()
                if self.take("="):
                    self.assignment()
                if not self.take(","):
                    break
            self.expect("]")
        elif t == "{":
            self.i += 1
            while self.k[self.i] != "}":
                if self.take("..."):
                    self.binding()
                else:
                    word = self.k[self.i] in _NAMES
                    self.property_name()
                    if self.take(":"):
                        self.binding()
                    elif not word:
                        self.fail("expected :")
                    if self.take("="):
                        self.assignment()
                if not self.take(","):
                    break
            self.expect("}")
        else:
            self.fail(f"expected a name, found {t}")

    def name(self) -> None:
        if self.k[self.i] not in _NAMES:
            self.fail(f"expected a name, found {self.k[self.i]}")
        self.i += 1

    def decorators(self) -> None:
        while self.take("@"):
            if self.k[self.i] == "(":
                self.parens()
                continue
            self.name()
            while self.take("."):
                self.property_word()
            if self.k[self.i] == "(":
                self.arguments()

    def decorated(self) -> None:
        self.decorators()
        if self.k[self.i] == "export":
            self.export()
        else:
            self.take("abstract")
            self.class_()

    def class_(self, named: bool = True) -> None:
        self.expect("class")
        if self.k[self.i] in _NAMES and not (self.k[self.i] == "implements" and not named):
            self.i += 1
        elif named:
            self.fail("a class needs a name")
        if self.ts:
            self.type_parameters()
        if self.take("extends"):
            self.subscripts(self.primary)
            if self.ts and self.k[self.i] == "<":
                self.type_arguments()
        if self.ts and self.take("implements"):
            self.type()
            while self.take(","):
                self.type()
        self.expect("{")
        self.nested += 1
        try:
            while self.k[self.i] != "}":
                if self.k[self.i] == "eof":
                    self.fail("class isn't closed")
                start = self.i
                try:
                    self.member()
                except Bad as bad:
                    self.note(bad)
                    self.recover(start)
        finally:
            self.nested -= 1
        self.i += 1

    _MODIFIERS = frozenset("static async get set accessor".split())
    _TS_MODIFIERS = frozenset("static async get set accessor public private protected readonly abstract override declare".split())

    def member(self) -> None:
        k = self.k
        if self.take(";"):
            return
        self.decorators()
        if k[self.i] == "static" and k[self.i + 1] == "{":
            self.i += 1
            self.body()
            return
        modifiers = self._TS_MODIFIERS if self.ts else self._MODIFIERS
        while k[self.i] in modifiers and k[self.i + 1] not in ("(", "=", ";", ":", "?", "!", "}", ",", "<") and self.i + 1 not in self.broken:
            self.i += 1
        self.take("*")
        if self.ts and k[self.i] == "[" and k[self.i + 1] in _NAMES and k[self.i + 2] == ":":
            self.index_signature()
            self.end()
            return
        if k[self.i] == "#name":
            self.i += 1
        else:
            self.property_name()
        if self.ts and k[self.i] in ("?", "!"):
            self.i += 1
        if k[self.i] in ("(", "<"):
            self.rest_of_function(self.ts)
            return
        if self.ts:
            self.annotation()
        if self.take("="):
            kept, self.function = self.function, True
            self.assignment()
            self.function = kept
        self.end()

    def property_name(self) -> None:
        t = self.k[self.i]
        if t == "str" or t == "num":
            self.i += 1
        elif t == "[":
            self.i += 1
            kept, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = kept
            self.expect("]")
        else:
            self.property_word()

    # -- expressions

    def expression(self) -> None:
        self.assignment()
        while self.take(","):
            self.assignment()

    def assignment(self) -> None:
        k, i = self.k, self.i
        t = k[i]
        if t in _NAMES:
            n = k[i + 1]
            if n == "=>":
                self.i += 2
                self.arrow_body()
                return
            if t == "async" and i + 1 not in self.broken:
                if n in _NAMES and k[i + 2] == "=>":
                    self.i += 3
                    self.arrow_body()
                    return
                if n == "(" and self.arrow(i + 1):
                    return
            if t == "yield" and self.function:
                self.i += 1
                self.take("*")
                if k[self.i] not in (")", "]", "}", ",", ";", ":", "eof") and self.i not in self.broken:
                    self.assignment()
                return
        elif t == "(" and self.arrow(i):
            return
        elif t == "<" and self.ts and self.generic_arrow():
            return
        simple = self.conditional()
        if k[self.i] in _ASSIGN:
            if not simple:
                self.fail("can't be assigned to")
            self.i += 1
            self.assignment()

    def closing(self, at: int) -> int:
        """The place of the bracket that closes the one at a place, or -1; all are paired once."""
        if self.closes is None:
            self.closes, opened = {}, []
            for j, t in enumerate(self.k):
                if t in ("(", "[", "{"):
                    opened.append(j)
                elif opened and t in (")", "]", "}"):
                    self.closes[opened.pop()] = j
        return self.closes.get(at, -1)

    def arrow(self, at: int) -> bool:
        """Parse an arrow function whose parameters begin at a place, if it is one."""
        k, j = self.k, self.closing(at)
        if j < 0 or k[j + 1] != "=>" and not (self.ts and k[j + 1] == ":"):
            return False
        kept = self.i
        self.i = at
        if k[j + 1] == "=>":
            self.parameters()
        else:
            try:
                self.parameters()
                self.expect(":")
                self.return_type()
                if k[self.i] != "=>":
                    self.i = kept
                    return False
            except Bad:
                self.i = kept
                return False
        self.expect("=>")
        self.arrow_body()
        return True

    def generic_arrow(self) -> bool:
        kept = self.i
        try:
            self.type_parameters()
            self.parameters()
            if self.take(":"):
                self.return_type()
            self.expect("=>")
        except Bad:
            self.i = kept
            return False
        self.arrow_body()
        return True

    def arrow_body(self) -> None:
        if self.k[self.i] == "{":
            self.body()
        else:
            self.assignment()

    def conditional(self) -> bool:
        simple = self.binary(0)
        if self.k[self.i] == "?":
            self.i += 1
            kept, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = kept
            self.expect(":")
            self.assignment()
            return False
        return simple

    def binary(self, least: int) -> bool:
        """Precedence climbing; whether it is something that can be assigned to."""
        k = self.k
        simple = self.unary()
        while True:
            t = k[self.i]
            p = _BINARY.get(t)
            if p is None:
                if self.ts and t in ("as", "satisfies") and self.i not in self.broken:
                    self.i += 1
                    if not self.take("const"):
                        self.type()
                    continue
                return simple
            if p <= least or t == "in" and self.no_in:
                return simple
            self.i += 1
            self.binary(p - 1 if t == "**" else p)
            simple = False

    def unary(self) -> bool:
        k = self.k
        t = k[self.i]
        if t in _UNARY or t == "await" and self.k[self.i + 1] not in (")", ",", ";", "=", ".", "=>", "eof", ":", "]", "}"):
            self.i += 1
            self.unary()
            return False
        if t == "<" and self.ts:
            self.i += 1
            self.type()
            self.close_angle()
            self.unary()
            return False
        simple = self.subscripts(self.primary)
        if k[self.i] in ("++", "--") and self.i not in self.broken:
            if not simple:
                self.fail("can't be changed")
            self.i += 1
            return False
        return simple

    def subscripts(self, first) -> bool:
        k = self.k
        simple = first()
        while True:
            t = k[self.i]
            if t == ".":
                self.i += 1
                if not self.take("#name"):
                    self.property_word()
                simple = True
            elif t == "(":
                self.arguments()
                simple = False
            elif t == "[":
                self.i += 1
                kept, self.no_in = self.no_in, False
                self.expression()
                self.no_in = kept
                self.expect("]")
                simple = True
            elif t == "?.":
                self.i += 1
                if k[self.i] == "(":
                    self.arguments()
                elif self.take("["):
                    self.expression()
                    self.expect("]")
                elif not self.take("#name"):
                    self.property_word()
                simple = False
            elif t == "tmpl":
                self.i += 1
                simple = False
            elif self.ts and t == "!" and self.i not in self.broken:
                self.i += 1
            elif self.ts and t in ("<", "<<") and self.call_types():
                simple = False
            else:
                return simple

    def call_types(self) -> bool:
        kept = self.i
        if kept in self.untyped:  # tried before
            return False
        try:
            self.type_arguments()
            if self.k[self.i] in ("(", ")", "]", ":", ";", ",", ".", "?.", "tmpl", "==", "===", "}", "eof"):
                return True
        except Bad:
            pass
        self.i = kept
        return False

    def arguments(self) -> None:
        self.expect("(")
        kept, self.no_in = self.no_in, False
        while self.k[self.i] != ")":
            self.take("...")
            self.assignment()
            if not self.take(","):
                break
        self.no_in = kept
        self.expect(")")

    def primary(self) -> bool:
        k = self.k
        t = k[self.i]
        if t in _NAMES:
            if t == "async" and k[self.i + 1] == "function" and self.i + 1 not in self.broken:
                self.i += 1
                self.function_(False)
                return False
            self.i += 1
            return True
        if t in ("num", "str", "tmpl", "this", "null", "true", "false"):
            self.i += 1
            return False
        if t == "(":
            self.i += 1
            kept, self.no_in = self.no_in, False
            self.expression()
            self.no_in = kept
            self.expect(")")
            return True
        if t == "[":
            self.i += 1
            kept, self.no_in = self.no_in, False
            while k[self.i] != "]":
                if self.take(","):
                    continue
                self.take("...")
                self.assignment()
                if not self.take(","):
                    break
            self.no_in = kept
            self.expect("]")
            return True
        if t == "{":
            self.object_literal()
            return True
        if t == "function":
            self.function_(False)
            return False
        if t == "class" or t == "@":
            self.decorators()
            self.class_(False)
            return False
        if t == "new":
            self.i += 1
            if self.take("."):
                self.expect("name")
                return False
            self.new_target()
            return False
        if t == "super":
            self.i += 1
            if k[self.i] not in ("(", ".", "["):
                self.fail("super stands alone")
            return False
        if t == "import":
            self.i += 1
            if self.take("."):
                self.property_word()
            elif k[self.i] != "(":
                self.fail("import inside an expression")
            return False
        if t == "#name" and k[self.i + 1] == "in":
            self.i += 1
            return False
        self.fail(f"expected an expression, found {t}")

    def new_target(self) -> None:
        k = self.k
        if k[self.i] == "new":
            self.i += 1
            self.new_target()
        else:
            self.primary()
        while True:
            if self.take("."):
                if not self.take("#name"):
                    self.property_word()
            elif k[self.i] == "[":
                self.i += 1
                self.expression()
                self.expect("]")
            elif self.ts and k[self.i] == "<" and self.call_types():
                pass
            else:
                break
        if k[self.i] == "(":
            self.arguments()

    def object_literal(self) -> None:
        self.expect("{")
        k = self.k
        kept, self.no_in = self.no_in, False
        while k[self.i] != "}":
            if self.take("..."):
                self.assignment()
            else:
                while k[self.i] in ("async", "get", "set") and k[self.i + 1] not in ("(", ",", ":", "}", "=", "<"):
                    self.i += 1
                self.take("*")
                word = k[self.i] in _NAMES
                self.property_name()
                if k[self.i] in ("(", "<"):
                    self.rest_of_function()
                elif self.take(":"):
                    self.assignment()
                elif word:
                    if self.take("="):
                        self.assignment()
                else:
                    self.fail(f"expected :, found {k[self.i]}")
            if not self.take(","):
                break
        self.no_in = kept
        self.expect("}")

    # -- types

    def annotation(self) -> None:
        if self.take(":"):
            self.type()

    def return_type(self) -> None:
        k = self.k
        if k[self.i] == "asserts" and (k[self.i + 1] in _NAMES or k[self.i + 1] == "this") and self.i + 1 not in self.broken:
            self.i += 1
        if (k[self.i] in _NAMES or k[self.i] == "this") and k[self.i + 1] == "is" and self.i + 1 not in self.broken:
            self.i += 2
        self.type()

    def close_angle(self) -> None:
        """One > of what may be several."""
        t = self.k[self.i]
        if t == ">":
            self.i += 1
        elif t in (">>", ">>>", ">=", ">>=", ">>>="):
            self.k[self.i] = t[1:]
        else:
            self.fail(f"expected >, found {t}")

    def type_parameters(self) -> None:
        if not self.ts or self.k[self.i] != "<":
            return
        self.i += 1
        while True:
            while self.k[self.i] in ("const", "in", "out") and (self.k[self.i + 1] in _NAMES):
                self.i += 1
            self.name()
            if self.take("extends"):
                self.type()
            if self.take("="):
                self.type()
            if not self.take(",") or self.k[self.i] == ">":
                break
        self.close_angle()

    def type_arguments(self) -> None:
        start = self.i
        self.expect("<")
        try:
            while True:
                self.type()
                if not self.take(","):
                    break
            self.close_angle()
        except Bad:
            self.untyped.add(start)
            raise

    def type(self) -> None:
        k = self.k
        self.union()
        if k[self.i] == "extends" and self.i not in self.broken:
            self.i += 1
            self.union()
            if self.take("?"):
                self.type()
                self.expect(":")
                self.type()

    def union(self) -> None:
        if not self.take("|"):
            self.take("&")
        self.operand()
        while self.k[self.i] in ("|", "&"):
            self.i += 1
            self.operand()

    def operand(self) -> None:
        k = self.k
        while k[self.i] in ("keyof", "unique", "readonly", "infer", "asserts") and (k[self.i + 1] in _NAMES or k[self.i + 1] in ("(", "[", "{", "typeof", "this", "str")):
            self.i += 1
        t = k[self.i]
        if t in ("(", "<", "new", "abstract") and self.function_type():
            return
        if t in _NAMES or t in ("this", "void", "null", "true", "false", "str", "num", "tmpl"):
            self.i += 1
            if t in _NAMES:
                while self.take("."):
                    self.property_word()
                if k[self.i] in ("<",) and self.i not in self.broken:
                    self.type_arguments()
        elif t == "-" and k[self.i + 1] == "num":
            self.i += 2
        elif t == "typeof":
            self.i += 1
            if self.take("import"):
                self.parens()
            else:
                self.property_word()
            while self.take("."):
                self.property_word()
            if k[self.i] == "<":
                self.type_arguments()
        elif t == "import":
            self.i += 1
            self.parens()
            while self.take("."):
                self.property_word()
            if k[self.i] == "<":
                self.type_arguments()
        elif t == "(":
            self.i += 1
            self.type()
            self.expect(")")
        elif t == "[":
            self.i += 1
            while k[self.i] != "]":
                self.take("...")
                if k[self.i] in _NAMES and (k[self.i + 1] == ":" or k[self.i + 1] == "?" and k[self.i + 2] == ":"):
                    self.i += 1
                    self.take("?")
                    self.i += 1
                self.type()
                self.take("?")
                if not self.take(","):
                    break
            self.expect("]")
        elif t == "{":
            self.object_type()
        else:
            self.fail(f"expected a type, found {t}")
        while k[self.i] == "[" and self.i not in self.broken:
            self.i += 1
            if not self.take("]"):
                self.type()
                self.expect("]")

    def function_type(self) -> bool:
        kept = self.i
        try:
            self.take("abstract")
            self.take("new")
            self.type_parameters()
            self.parameters()
            self.expect("=>")
        except Bad:
            self.i = kept
            return False
        self.return_type()
        return True

    def index_signature(self) -> None:
        self.expect("[")
        self.name()
        self.expect(":")
        self.type()
        self.expect("]")
        self.take("?")
        self.annotation()

    def object_type(self) -> None:
        self.expect("{")
        k = self.k
        while k[self.i] != "}":
            if k[self.i] in ("+", "-"):
                self.i += 1
            while k[self.i] in ("readonly", "get", "set", "static") and k[self.i + 1] not in (":", "?", "(", ";", ",", "}", "<"):
                self.i += 1
            if k[self.i] == "[" and k[self.i + 1] in _NAMES and k[self.i + 2] == ":":
                self.index_signature()
            elif k[self.i] == "[" and k[self.i + 1] in _NAMES and k[self.i + 2] == "in":
                self.i += 3
                self.type()
                if self.take("as"):
                    self.type()
                self.expect("]")
                if k[self.i] in ("+", "-"):
                    self.i += 1
                self.take("?")
                self.annotation()
            else:
                if k[self.i] == "new" and k[self.i + 1] in ("(", "<"):
                    self.i += 1
                elif k[self.i] not in ("(", "<"):
                    self.property_name()
                    self.take("?")
                if k[self.i] in ("(", "<"):
                    self.type_parameters()
                    self.parameters()
                    if self.take(":"):
                        self.return_type()
                else:
                    self.annotation()
            if not (self.take(";") or self.take(",")) and k[self.i] != "}" and self.i not in self.broken:
                self.fail(f"expected ;, found {k[self.i]}")
        self.i += 1


_STATEMENTS = {
    "{": Script.block, ";": Script.empty, "var": Script.variables, "const": Script.const, "enum": Script.enum, "function": Script.function_statement, "class": Script.class_, "if": Script.if_, "for": Script.for_,
    "while": Script.while_, "do": Script.do, "switch": Script.switch_, "try": Script.try_, "throw": Script.throw, "return": Script.return_, "break": Script.jump, "continue": Script.jump, "debugger": Script.debugger,
    "import": Script.import_, "export": Script.export, "@": Script.decorated,
}
