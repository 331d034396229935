"""Bash: words with their quotings and expansions are read to their ends, then commands by recursive descent."""

from __future__ import annotations

import re

from lodeglass.llm.parsing.base import Bad

_BLANK = re.compile(r"(?:[ \t\r]|\\\n)+")
_PLAIN = re.compile(r"[^\s\\'\"`$|&;()<>#]+|#")
_OPERATOR = re.compile(r"\n|&&|\|\||;;&|;;|;&|\|&|&>>|&>|<<<|<<-|<<|>>|<&|>&|<>|>\||[|&;()<>]")
_REDIRECT = frozenset("< > >> << <<- <<< <& >& <> >| &> &>>".split())
_CLOSERS = frozenset("then do done fi elif else esac }".split())
_NAME = re.compile(r"[A-Za-z_]\w*(?:\[[^\]]*\])?\+?=")
_ARITHMETIC = re.compile(r"\(\((?!\s*\()")


class Shell:
    def __init__(self, text: str):
        self.t, self.i, self.n = text.replace("\r\n", "\n"), 0, 0
        self.n = len(self.t)
        self.errors: list[tuple[int, str]] = []
        self.heredocs: list[tuple[str, bool]] = []
        self.op: str | None = None
        self.word: str | None = None
        self.at = 0

    def fail(self, message: str, at: int | None = None):
        raise Bad(self.at if at is None else at, message)

    # -- words

    def next(self) -> None:
        """Read an operator (op) or a word (word, its raw text); both None at the end."""
        t = self.t
        if m := _BLANK.match(t, self.i):
            self.i = m.end()
        if self.i < self.n and t[self.i] == "#":
            end = t.find("\n", self.i)
            self.i = self.n if end < 0 else end
        self.at = self.i
        self.op = self.word = None
        if self.i >= self.n:
            if self.heredocs:
                self.heredocs.clear()
            return
        if m := _OPERATOR.match(t, self.i):
            if m.group() in "<>" and t.startswith("(", m.end()):  # process substitution
                self.read_word()
                return
            self.op = m.group()
            self.i = m.end()
            if self.op == "\n":
                self.skip_heredocs()
            return
        self.read_word()

    def read_word(self) -> None:
        start = self.i
        self.i = self.word_end(self.i)
        self.word = self.t[start : self.i]

    def word_end(self, i: int) -> int:
        t = self.t
        start = i
        while i < self.n:
            if m := _PLAIN.match(t, i):
                i = m.end()
                continue
            c = t[i]
            if c == "\\":
                i += 2
            elif c == "'":
                i = self.find("'", i + 1, "quote isn't closed") + 1
            elif c == '"':
                i = self.double(i)
            elif c == "`":
                i = self.backtick(i)
            elif c == "$":
                i = self.dollar(i)
            elif c in "<>" and t.startswith("(", i + 1) and (i == start or t[i - 1] == "="):
                i = self.command(i + 2)
            elif c == "(" and i > start and (t[i - 1] == "=" and _NAME.fullmatch(t[start:i]) or t[i - 1] in "?*+@!"):
                i = self.command_list(i)
            else:
                break
        return min(i, self.n)

    def command_list(self, i: int) -> int:
        """An array or a pattern list in parentheses."""
        depth, i = 1, i + 1
        while depth:
            if i >= self.n:
                self.fail("parenthesis isn't closed", i)
            c = self.t[i]
            if c in "()":
                depth += 1 if c == "(" else -1
                i += 1
            elif c in " \t\n|&;<>#":
                i += 1
            else:
                i = self.word_end(i) if not (c == "(") else i + 1
        return i

    def find(self, what: str, i: int, message: str) -> int:
        k = self.t.find(what, i)
        if k < 0:
            raise Bad(i, message)
        return k

    def double(self, i: int) -> int:
        start, i = i, i + 1
        t = self.t
        while i < self.n:
            c = t[i]
            if c == '"':
                return i + 1
            if c == "\\":
                i += 2
            elif c == "`":
                i = self.backtick(i)
            elif c == "$":
                i = self.dollar(i, True)
            else:
                i += 1
        raise Bad(start, "quote isn't closed")

    def backtick(self, i: int) -> int:
        start, i = i, i + 1
        while i < self.n and self.t[i] != "`":
            i += 2 if self.t[i] == "\\" else 1
        if i >= self.n:
            raise Bad(start, "backtick isn't closed")
        inner = Shell(self.t[start + 1 : i].replace("\\`", "`"))
        inner.parse()
        if inner.errors:
            raise Bad(start, inner.errors[0][1])
        return i + 1

    def dollar(self, i: int, quoted: bool = False) -> int:
        t = self.t
        n = t[i + 1 : i + 2]
        if n == "(":
            if t.startswith("((", i + 1):
                kept = i
                end = self.arithmetic(i + 3)
                if end > 0:
                    return end
                i = kept
            return self.command(i + 2)
        if n == "{":
            return self.braces(i + 2)
        if n == "'" and not quoted:
            i += 2
            while i < self.n and t[i] != "'":
                i += 2 if t[i] == "\\" else 1
            if i >= self.n:
                raise Bad(i, "quote isn't closed")
            return i + 1
        if n == '"' and not quoted:
            return self.double(i + 1)
        return i + (2 if n and (n.isalnum() or n in "_@*#?$!-") else 1)

    def braces(self, i: int) -> int:
        t = self.t
        start = i
        if not re.match(r"[#!]?(?:[A-Za-z_]\w*|\d+|[@*#?$!\-])|!", t[i : i + 200]):
            raise Bad(start, "bad substitution")
        while i < self.n:
            c = t[i]
            if c == "}":
                return i + 1
            if c == "\\":
                i += 2
            elif c == "'":
                k = t.find("'", i + 1)
                i = k + 1 if k >= 0 else i + 1
            elif c == '"':
                i = self.double(i)
            elif c == "$":
                i = self.dollar(i)
            elif c == "`":
                i = self.backtick(i)
            else:
                i += 1
        raise Bad(start, "brace isn't closed")

    def arithmetic(self, i: int) -> int:
        """End of an arithmetic expansion behind its two parentheses, or 0 if it is none."""
        depth, t = 0, self.t
        while i < self.n:
            c = t[i]
            if c == "(":
                depth += 1
            elif c == ")":
                if depth == 0:
                    return i + 2 if t.startswith("))", i) else 0
                depth -= 1
            elif c == "$":
                i = self.dollar(i)
                continue
            i += 1
        raise Bad(i, "arithmetic isn't closed")

    def command(self, i: int) -> int:
        """End of a command substitution behind its parenthesis."""
        kept = self.i, self.op, self.word, self.at, self.heredocs
        self.i, self.heredocs = i, []
        self.next()
        self.list((")",))
        if self.op != ")":
            self.fail("substitution isn't closed")
        end = self.i
        self.i, self.op, self.word, self.at, self.heredocs = kept
        return end

    def skip_heredocs(self) -> None:
        docs, self.heredocs = self.heredocs, []
        for mark, tabs in docs:
            while True:
                if self.i >= self.n:
                    return
                end = self.t.find("\n", self.i)
                line = self.t[self.i : self.n if end < 0 else end]
                self.i = self.n if end < 0 else end + 1
                if (line.lstrip("\t") if tabs else line) == mark:
                    break

    # -- commands

    def parse(self) -> None:
        while True:
            try:
                self.next()
                self.list(())
                if self.op is None and self.word is None:
                    return
                self.fail(f"{self.op or self.word} isn't expected here")
            except Bad as bad:
                self.errors.append((bad.at, bad.message))
                end = self.t.find("\n", max(bad.at, self.i if self.i > bad.at else bad.at))
                if end < 0 or end + 1 >= self.n:
                    return
                self.i, self.heredocs = end + 1, []

    def newlines(self) -> None:
        while self.op == "\n":
            self.next()

    def ended(self, stops: tuple[str, ...]) -> bool:
        return self.op is None and self.word is None or self.op in stops or self.word in stops

    def list(self, stops: tuple[str, ...], needed: bool = False) -> None:
        some = False
        while True:
            while self.op == "\n":
                self.next()
            if self.ended(stops):
                break
            self.and_or()
            some = True
            if self.op in (";", "&", "\n"):
                self.next()
            else:
                break
        if needed and not some:
            self.fail("a command is missing")

    def and_or(self) -> None:
        self.pipeline()
        while self.op in ("&&", "||"):
            self.next()
            self.newlines()
            self.pipeline()

    def pipeline(self) -> None:
        while self.word in ("!", "time"):
            self.next()
        self.one()
        while self.op in ("|", "|&"):
            self.next()
            self.newlines()
            self.one()

    def redirect(self) -> bool:
        if self.op not in _REDIRECT:
            return False
        op = self.op
        self.next()
        if self.word is None:
            self.fail("a redirection leads nowhere")
        if op in ("<<", "<<-"):
            self.heredocs.append((re.sub(r"[\\'\"]", "", self.word), op == "<<-"))
        self.next()
        return True

    def one(self) -> None:
        w = self.word
        if w is None:
            if self.op == "(":
                if m := _ARITHMETIC.match(self.t, self.at):
                    end = self.arithmetic(m.end())
                    if end > 0:
                        self.i = end
                        self.next()
                        self.redirects()
                        return
                self.next()
                self.list((")",), True)
                self.close(")")
                self.redirects()
                return
            if self.op in _REDIRECT:
                self.simple()
                return
            self.fail(f"expected a command, found {self.op or 'the end'}")
        method = _COMPOUND.get(w)
        if method:
            method(self)
            self.redirects()
        elif w in _CLOSERS:
            self.fail(f"{w} isn't expected here")
        else:
            self.simple()

    def redirects(self) -> None:
        while self.redirect():
            pass

    def close(self, what: str) -> None:
        if self.op != what and self.word != what:
            self.fail(f"expected {what}, found {self.op or self.word or 'the end'}")
        self.next()

    def simple(self) -> None:
        first = self.word
        count = 0
        while True:
            if self.word is not None:
                count += 1
                self.next()
                if count == 1 and self.op == "(" and first is not None:
                    self.next()
                    if self.op != ")":
                        self.fail("( isn't expected here")
                    self.next()
                    self.newlines()
                    if self.word not in _COMPOUND and self.op != "(":
                        self.fail("a function needs a body")
                    self.one()
                    return
            elif not self.redirect():
                break
        if self.op == "(":
            self.fail("( isn't expected here")

    def group(self) -> None:
        self.next()
        self.list(("}",), True)
        self.close("}")

    def if_(self) -> None:
        self.next()
        self.list(("then",), True)
        self.close("then")
        self.list(("elif", "else", "fi"), True)
        while self.word == "elif":
            self.next()
            self.list(("then",), True)
            self.close("then")
            self.list(("elif", "else", "fi"), True)
        if self.word == "else":
            self.next()
            self.list(("fi",), True)
        self.close("fi")

    def while_(self) -> None:
        self.next()
        self.list(("do",), True)
        self.do()

    def do(self) -> None:
        self.close("do")
        self.list(("done",), True)
        self.close("done")

    def for_(self) -> None:
        word = self.word
        self.next()
        if self.op == "(" and self.t.startswith("((", self.at) and word == "for":
            end = self.arithmetic(self.at + 2)
            if end <= 0:
                self.fail("bad for")
            self.i = end
            self.next()
        else:
            if self.word is None or not re.fullmatch(r"[A-Za-z_]\w*", self.word):
                self.fail("for needs a name")
            self.next()
            self.newlines()
            if self.word == "in":
                self.next()
                while self.word is not None:
                    self.next()
        if self.op == ";":
            self.next()
        self.newlines()
        if self.word == "{":
            self.group()
        else:
            self.do()

    def case(self) -> None:
        self.next()
        if self.word is None:
            self.fail("case needs a word")
        self.next()
        self.newlines()
        self.close("in")
        self.newlines()
        while self.word != "esac":
            if self.op == "(":
                self.next()
            while True:
                if self.word is None:
                    self.fail("a pattern is missing")
                self.next()
                if self.op != "|":
                    break
                self.next()
            self.close(")")
            self.list((";;", ";&", ";;&", "esac"))
            if self.op in (";;", ";&", ";;&"):
                self.next()
                self.newlines()
            else:
                break
        self.close("esac")

    def function(self) -> None:
        self.next()
        if self.word is None:
            self.fail("a function needs a name")
        self.next()
        if self.op == "(":
            self.next()
            self.close(")")
        self.newlines()
        if self.word not in _COMPOUND and self.op != "(":
            self.fail("a function needs a body")
        self.one()

    def test(self) -> None:
        """[[ ... ]]"""
        depth = 0
        self.next()
        if self.word == "]]":
            self.fail("an empty test")
        while True:
            if self.word == "]]" and depth == 0:
                break
            if self.word is None and self.op is None:
                self.fail("test isn't closed")
            if self.op == "(":
                depth += 1
            elif self.op == ")":
                depth -= 1
            elif self.op in (";", "&", "|") and depth == 0 and self.op != "|":
                self.fail(f"{self.op} in a test")
            self.next()
        self.next()


_COMPOUND = {
    "{": Shell.group, "if": Shell.if_, "while": Shell.while_, "until": Shell.while_, "for": Shell.for_, "select": Shell.for_, "case": Shell.case, "function": Shell.function, "[[": Shell.test,
}
