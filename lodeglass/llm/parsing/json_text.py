"""JSON as standardised."""

from __future__ import annotations

import re

from lodeglass.llm.parsing.base import Bad, Parser

_TOKEN = re.compile(r"""[ \t\r\n]+|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|(true|false|null)\b|([{}\[\],:])|(.)""", re.S)
TOKENS = _TOKEN


def kinds(text: str) -> list[str]:
    out = []
    for s, n, w, p, bad in _TOKEN.findall(text):
        if s:
            out.append("str")
        elif p:
            out.append(p)
        elif n or w:
            out.append("num")
        elif bad:
            out.append("bad")
    out.append("eof")
    return out


class Json(Parser):
    def parse(self) -> None:
        try:
            self.value(0)
            if self.k[self.i] != "eof":
                self.fail("more than one value")
        except Bad as bad:
            self.note(bad)
            self.resume()

    def resume(self) -> None:
        """Behind an error, go on with what stands behind the next comma of any depth."""
        while self.k[self.i] != "eof":
            self.i += 1
            if self.k[self.i - 1] == "," and self.k[self.i] != "eof":
                start = self.i
                try:
                    self.member() if self.k[self.i] == "str" and self.k[self.i + 1] == ":" else self.value(0)
                except Bad as bad:
                    self.note(bad)
                if self.i == start:
                    self.i += 1

    def member(self) -> None:
        self.expect("str")
        self.expect(":")
        self.value(0)

    def value(self, depth: int) -> None:
        k, closes = self.k, []
        while True:  # one value, with open objects and arrays on a stack
            t = k[self.i]
            if t == "{":
                self.i += 1
                if self.take("}"):
                    pass
                else:
                    closes.append("}")
                    if k[self.i] != "str" or k[self.i + 1] != ":":
                        self.fail("expected a member")
                    self.i += 2
                    continue
            elif t == "[":
                self.i += 1
                if not self.take("]"):
                    closes.append("]")
                    continue
            elif t == "str" or t == "num":
                self.i += 1
            else:
                self.fail(f"expected a value, found {t}")
            while closes:
                if self.take(closes[-1]):
                    closes.pop()
                    continue
                self.expect(",")
                if closes[-1] == "}":
                    if k[self.i] != "str" or k[self.i + 1] != ":":
                        self.fail("expected a member")
                    self.i += 2
                break
            else:
                return
