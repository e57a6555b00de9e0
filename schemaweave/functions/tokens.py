"""Tokens of a SQL text, on which the small grammars of scanners.py are built."""

from __future__ import annotations

import re
from functools import cached_property
from itertools import islice

#: A literal, a dollar-quoted text, a quoted name, a word, or any other character.
_CLOSED = re.compile(r"'(?:[^']|'')*(?:'|\Z)|\$(?P<tag>(?:[^\W\d]\w*)?)\$(?s:.*?)(?:\$(?P=tag)\$|\Z)|`[^`]*`|\"[^\"]*\"|\[[^\]]*\]|\w+|[^\w\s]")
#: The same without literals: what they hold is read like the rest.
_OPEN = re.compile(r"`[^`]+`|\"[^\"]+\"|\[[^\]]+\]|[^\W\d][\w$]*|\w+|[^\w\s]")
_QUOTES = '`"['


def lazily(text: str, at: int):
    """The tokens from a place on, one by one."""
    return _CLOSED.finditer(text, at)


class Tokens:
    """Tokens by number: raw as written, word in upper case, start and end in the text.

    Numbers past the end have empty words, so a grammar can look ahead. past[i] is the number
    after the group that a parenthesis at i opens; around[i] that of the parenthesis around i.
    most: no more tokens than these are read; whole: whether that was the whole text.
    """

    def __init__(self, text: str, literals: bool = True, most: int | None = None) -> None:
        self._found = found = list(islice((_CLOSED if literals else _OPEN).finditer(text), most))
        self.text, self.n = text, len(found)
        self.whole = most is None or self.n < most
        self.raw = [m[0] for m in found] + [""] * 8
        self.word = [x.upper() for x in self.raw]
        self.past, self.around, open_ = {}, [], [-1]
        if "(" not in text:
            self.around = open_ * len(self.raw)
            return
        for i, x in enumerate(self.raw):
            if x == ")" and len(open_) > 1:
                self.past[open_.pop()] = i + 1
            self.around.append(open_[-1])
            if x == "(":
                open_.append(i)
        for i in open_[1:]:
            self.past[i] = self.n

    @cached_property
    def start(self) -> list[int]:
        return [m.start() for m in self._found] + [len(self.text)] * 8

    @cached_property
    def end(self) -> list[int]:
        return [m.end() for m in self._found] + [len(self.text)] * 8

    def slice(self, first: int, stop: int) -> str:
        """The text of the tokens from first to before stop."""
        return self.text[self.start[first] : self.end[stop - 1]] if first < stop else ""

    def says(self, i: int, *words: str) -> bool:
        """Whether these words follow each other from i on."""
        return self.word[i] == words[0] and tuple(self.word[i : i + len(words)]) == words

    def after(self, i: int, *words: str) -> int:
        """The number after these words if they stand at i, else i."""
        return i + len(words) if self.says(i, *words) else i

    def quoted(self, i: int) -> bool:
        return len(self.raw[i]) > 2 and self.raw[i][0] in _QUOTES

    def is_name(self, i: int) -> bool:
        return self.quoted(i) or self.raw[i][:1].isalpha() or self.raw[i][:1] == "_"

    def name(self, i: int) -> str:
        """A name in lower case, without quotes."""
        return (self.raw[i][1:-1] if self.quoted(i) else self.raw[i]).lower()

    def path(self, i: int) -> tuple[list[str], int]:
        """The parts of a dotted name at i, and the number after it."""
        if not self.is_name(i):
            return [], i
        parts = [self.name(i)]
        while self.raw[i + 1] == "." and self.is_name(i + 2):
            i += 2
            parts.append(self.name(i))
        return parts, i + 1

    def cut(self, first: int, stop: int) -> list[tuple[int, int]]:
        """The stretches between commas that stand in no deeper parentheses than `first`; empty ones are left out."""
        level, out, at = self.around[first], [], first
        for i in range(first, stop + 1):
            if i == stop or self.raw[i] == "," and self.around[i] == level:
                if at < i:
                    out.append((at, i))
                at = i + 1
        return out

    def names(self, i: int) -> list[str]:
        """The names in the list whose parenthesis is at i; none if there is no parenthesis."""
        return [self.name(a) for a, _ in self.cut(i + 1, self.past[i] - 1)] if self.raw[i] == "(" else []
