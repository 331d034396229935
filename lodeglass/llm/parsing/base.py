"""What all parsers share: token kinds in a list, errors with recovery, remembered statements."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

#: Calls that a parser may have open at once. They are Python's own and take no room on the stack of the process.
DEEPEST = 1_000_000
#: Statements of one line that are known to be right, by context and token kinds; emptied when it has grown too large.
MEMO_LIMIT = 300_000


@contextmanager
def deep_calls() -> Iterator[None]:
    """Lets a parser go as deep as DEEPEST, and nothing else."""
    kept = sys.getrecursionlimit()
    sys.setrecursionlimit(max(kept, DEEPEST))
    try:
        yield
    finally:
        sys.setrecursionlimit(kept)


class Bad(Exception):
    """What a parser expects isn't there. at is the index of the token."""

    def __init__(self, at: int, message: str):
        self.at, self.message = at, message


class Parser:
    """k: kinds of the tokens, ended by 'eof'. A kind is the text of a word with a meaning or of a sign, else a class as
    'name', 'num' or 'str'. ends: for each token, the index behind the last token on its line."""

    memo: set = set()

    def __init__(self, k: list[str], ends: list[int] | None = None):
        self.k, self.i, self.errors, self.ends = k, 0, [], ends or []

    def fail(self, message: str):
        raise Bad(self.i, message)

    def expect(self, kind: str) -> None:
        if self.k[self.i] != kind:
            raise Bad(self.i, f"expected {kind}, found {self.k[self.i]}")
        self.i += 1

    def take(self, kind: str) -> bool:
        if self.k[self.i] == kind:
            self.i += 1
            return True
        return False

    def note(self, bad: Bad) -> None:
        self.errors.append((bad.at, bad.message))

    def remember(self, start: int, context) -> None:
        if self.ends[start] == self.i:
            if len(self.memo) > MEMO_LIMIT:
                self.memo.clear()
            self.memo.add((context, *self.k[start : self.i]))

    def known(self, context) -> bool:
        end = self.ends[self.i]
        if (context, *self.k[self.i : end]) in self.memo:
            self.i = end
            return True
        return False


def line_ends(breaks: list[int], n: int) -> list[int]:
    """For each of n tokens, the index of the first token of the next line; breaks are indices of lines' first tokens."""
    ends: list[int] = []
    for b in breaks:
        if b > len(ends):
            ends += [b] * (b - len(ends))
    ends += [n] * (n - len(ends))
    return ends
