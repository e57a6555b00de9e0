"""Cutting a script into statements, whole or block by block.

A Cutter reads text and keeps what it needs to go on: where it stands (plain text, a literal, a dollar quote, a
comment), how deep in parentheses and blocks, and a tail of text whose meaning depends on what follows. So a
script can be cut in blocks anywhere, each read on its own from a given state, with the result of one pass.
"""

from __future__ import annotations

import json
import re
from dataclasses import astuple, dataclass, replace

from schemaweave.functions.tokens import lazily
from schemaweave.functions.words import DECLARATIONS, ROUTINE_OPTIONS

_STATEMENT_TOKEN = re.compile(r"'|\$|(?P<slash>(?m:^[ \t]*/[ \t]*$)\n?)|(?P<mark>[();])|(?P<word>\w+)")
#: The same when a statement has begun: words that open or close nothing are passed over; without blocks, all words.
_BLOCK_TOKEN = re.compile(r"['$]|(?P<slash>(?<=\n)[ \t]*/[ \t]*(?:\n|\Z))|(?P<mark>[();])|\b(?P<word>CASE|BEGIN|END)\b", re.I)
_PLAIN_TOKEN = re.compile(r"['$]|(?P<slash>(?<=\n)[ \t]*/[ \t]*(?:\n|\Z))|(?P<mark>[();])|(?P<word>(?!))")
_NO_BLOCK = re.compile(r"\s*(?:;|(?:TRANSACTION|TRAN|WORK|ISOLATION|DISTRIBUTED)\b)", re.I)
_NO_END = re.compile(r"\s+(?:IF|LOOP|WHILE|REPEAT|FOR)\b", re.I)
#: What may still grow into a word that matters, at the end of a text.
_UNDECIDED = re.compile(r"\s*\w*\Z")
_HALF_MARK = re.compile(r"[-/*]+\Z")
_BLANK_LINE = re.compile(r"(?:\A|\n)([ \t]*)\Z")
_QUOTE_AHEAD = re.compile(r"\s*['$]")
#: Begins what is no routine, whatever follows.
_OTHER = re.compile(r"CREATE\s+(?!(?:OR|EDITIONABLE|NONEDITIONABLE|PROCEDURE|FUNCTION)\b)[a-z_]+(?=[\s(])", re.A | re.I)
#: Words after which _may_be_routine() has nothing more to tell.
_HEAD_WORDS = 5


class More(Exception):
    """The text ends before a question is decided."""


def declared_body(text: str, at: int = 0, final: bool = True) -> int | None:
    """Where the declarations of an IS/AS routine begin, if the statement at `at` is one.

    Its head has a name, arguments, RETURN with a type, and options, and nothing else. Without
    `final` there may be more text, and More is raised if the answer depends on it.
    """
    if _OTHER.match(text, at):
        return None
    head: list[str] = []
    depth, tokens = 0, _decided(text, at, final)
    for m in tokens:
        word = m[0].upper()
        depth += (word == "(") - (word == ")")
        if depth or word == ")":
            if word == "(" and depth == 1:
                head.append("(")
        elif word in ("IS", "AS"):
            break
        elif word == ";" or word[0] in "'$":
            return None
        else:
            head.append(word)
        if len(head) <= _HEAD_WORDS and not _may_be_routine(head):
            return None
    else:
        return None
    i = _after_replace(head)
    if head[:1] != ["CREATE"] or head[i : i + 1] not in (["PROCEDURE"], ["FUNCTION"]):
        return None
    i += 2
    while head[i : i + 1] == ["."]:
        i += 2
    i += head[i : i + 1] == ["("]
    if head[i : i + 1] == ["RETURN"]:
        i += 2
        while head[i : i + 1] in (["."], ["%"]):
            i += 2
        i += head[i : i + 1] == ["("]
    while i < len(head) and head[i] in ROUTINE_OPTIONS:
        i += 1 + (head[i] == "AUTHID")
    if i != len(head) or _QUOTE_AHEAD.match(text, m.end()):
        return None
    follows = [x[0].upper() for x in [next(tokens, None)] if x]
    if not follows or follows[0] in ("LANGUAGE", "EXTERNAL"):
        return None
    return m.end() if word == "IS" or _declares(follows, tokens) else None


def _decided(text: str, at: int, final: bool):
    """The tokens from a place on that more text can't change."""
    for m in lazily(text, at):
        if not final and m.end() == len(text):
            raise More
        yield m
    if not final:
        raise More


def _after_replace(head: list[str]) -> int:
    i = 3 if head[1:3] == ["OR", "REPLACE"] else 1
    return i + (head[i : i + 1] in (["EDITIONABLE"], ["NONEDITIONABLE"]))


def _may_be_routine(head: list[str]) -> bool:
    """False if a head that begins so can't be a routine's."""
    if head[1:2] == ["OR"] and len(head) < 3:
        return True
    i = _after_replace(head)
    return head[:1] == ["CREATE"] and (i >= len(head) or head[i] in ("PROCEDURE", "FUNCTION"))


def _declares(words: list[str], tokens) -> bool:
    """Whether a declaration begins with these words and the tokens after them: a cursor, type, or variable."""
    if words[0] in DECLARATIONS:
        return True

    def word(i: int) -> str:
        while len(words) <= i:
            more = next(tokens, None)
            if more is None:
                return ""
            words.append(more[0].upper())
        return words[i]

    named = lambda x: x[:1].isalpha() or x[:1] == "_"
    if not named(words[0]):
        return False
    i = 2 if word(1) == "CONSTANT" else 1
    if not named(word(i)):
        return False
    i += 1
    while word(i) in (".", "%"):
        i += 2
    if word(i) == "(":
        while word(i) not in (")", ""):
            i += 1
        i += word(i) == ")"
    return word(i) in (";", "DEFAULT") or (word(i), word(i + 1)) in ((":", "="), ("NOT", "NULL"))


@dataclass(frozen=True)
class State:
    """Where a cut stands between two blocks.

    comment: 0 none, 1 in a line comment, 2 and 3 in a block comment in none and in a line comment. mode: n plain, l literal, d
    dollar quote, whose tag is `tag`. declared: characters to the declarations of a routine, or -1. begun: the first
    characters of the statement. line: whether `tail` begins a line. tail: text that is read again with what follows,
    raw: the same before comments are taken out.
    """

    comment: int = 0
    mode: str = "n"
    tag: str = ""
    depth: int = 0
    open: int = 0
    fresh: bool = True
    declared: int = -1
    begun: str = ""
    line: bool = True
    tail: str = ""
    raw: str = ""

    def packed(self) -> str:
        return json.dumps(astuple(self))

    @classmethod
    def unpacked(cls, text: str) -> State:
        return cls(*json.loads(text))


#: Characters of a statement that tell whether it can define something.
BEGUN = 6


def without_comments(text: str, comment: int, closed_later: bool) -> tuple[str, int]:
    """A block without comments, and how it ends. A block comment that nothing closes is none; closed_later: a later block has a `*/`."""
    out, at = [], 0
    while at < len(text):
        if comment >= 2:
            end = text.find("*/", at)
            if end < 0:
                return "".join(out), comment
            at, comment = end + 2, comment - 2
            continue
        star = text.find("/*", at)
        while star >= 0 and not closed_later and text.find("*/", star + 2) < 0:
            star = -1
        stop = text.find("\n", at) if comment else text.find("--", at)
        if 0 <= star and (stop < 0 or star < stop):
            if not comment:
                out.append(text[at:star] + " ")
            at, comment = star + 2, comment + 2
        elif stop < 0:
            out.append("" if comment else text[at:])
            break
        elif comment:
            at, comment = stop, 0
        else:
            out.append(text[at:stop] + " ")
            at, comment = stop + 2, 1
    return "".join(out), comment


def cut(block: str, state: State, final: bool, blocks: bool = True, dollar_later: bool = False) -> tuple[list[tuple[str, bool, str]], State]:
    """Pieces (text, whether the statement ends with it, what it began with) of a block without comments, and the state after it.

    A `;` ends a statement outside parentheses, literals, dollar quotes and, with `blocks`, BEGIN/CASE ... END.
    dollar_later: a later block has a `$`.
    """
    mark = "\n" if state.line else "."  # neither is a token; it tells whether a line begins here
    text = mark + state.tail + block
    at, first, pieces = 1, 1, []
    mode, tag, depth, open_, fresh, begun = state.mode, state.tag, state.depth, state.open, state.fresh, state.begun
    declared = state.declared + 1 if state.declared >= 0 else -1

    def flush(end: int, after: int) -> None:
        nonlocal first, depth, open_, fresh, declared, begun
        part = text[first:end]
        pieces.append((part, True, (begun + part).lstrip()[:BEGUN] if len(begun) < BEGUN else begun))
        first, depth, open_, fresh, declared, begun = after, 0, 0, True, -1, ""

    stop = len(text)  # what follows is read again
    while True:
        if mode == "l":
            end = text.find("'", at)
            if end < 0:
                at = len(text)
                break
            if text[end + 1 : end + 2] == "'":
                at = end + 2
                continue
            if end + 1 == len(text) and not final:
                stop = end
                break
            at, mode = end + 1, "n"
        elif mode == "d":
            end = text.find(tag, at)
            if end < 0:
                stop = len(text) if final else max(at, len(text) - len(tag) + 1)
                break
            at, mode, tag = end + len(tag), "n", ""
        pattern = _STATEMENT_TOKEN if fresh and blocks else _BLOCK_TOKEN if blocks else _PLAIN_TOKEN
        m = pattern.search(text, at)
        if not m:
            while not final and stop > at and (text[stop - 1].isalnum() or text[stop - 1] == "_"):
                stop -= 1  # the next block may go on with a word
            break
        if m.end() == len(text) and not final and (m["word"] or m["slash"] and m[0][-1] != "\n"):
            stop = m.start()
            break
        word = (m["word"] or "").upper()
        if blocks and word in ("BEGIN", "END") and not final and _UNDECIDED.match(text, m.end()):
            stop = m.start()
            break
        if fresh and blocks and word:
            try:
                body = declared_body(text, m.start(), final) if word == "CREATE" else None
            except More:
                stop = m.start()
                break
            fresh = False
            if body is not None:
                open_, declared = 1, body
        at = m.end()
        if m[0] == "'":
            mode = "l"
        elif m[0] == "$":
            close = text.find("$", at)
            if close >= 0:
                mode, tag, at = "d", text[m.start() : close + 1], close + 1
            elif dollar_later and not final:
                stop = m.start()
                break
        elif m["slash"] is not None:
            if blocks:
                flush(m.start(), at)
        elif m["mark"] == "(":
            depth += 1
        elif m["mark"] == ")":
            depth -= 1
        elif m["mark"] == ";":
            if depth == 0 and open_ == 0:
                flush(m.start(), at)
        elif blocks and (word == "CASE" or word == "BEGIN" and not _NO_BLOCK.match(text, at)):
            if word == "BEGIN" and 0 <= declared <= m.start():
                declared = -1  # the block of the declarations
            else:
                open_ += 1
        elif blocks and word == "END" and not _NO_END.match(text, at):
            open_ = max(0, open_ - 1)
    if final:
        flush(len(text), len(text))
        return pieces, State()
    if mode == "n" and stop == len(text) and (blank := _BLANK_LINE.search(text, max(first, at) - 1)):
        stop = blank.start(1)
    part = text[first:stop]
    begun = (begun + part).lstrip()[:BEGUN] if len(begun) < BEGUN else begun
    pieces.append((part, False, begun))
    left = max(0, declared - stop) if declared >= 0 else -1
    return pieces, State(state.comment, mode, tag, depth, open_, fresh, left, begun, text[stop - 1] == "\n", text[stop:])


def cut_block(block: str, state: State, final: bool, closed_later: bool, dollar_later: bool) -> tuple[list[tuple[str, bool, str]], State]:
    """cut() of a block with comments. What may be half a comment's mark at its end is read with the next block."""
    block, raw = state.raw + block, ""
    if not final and (half := _HALF_MARK.search(block)):
        block, raw = block[: half.start()], half[0]
    plain, comment = without_comments(block, state.comment, closed_later or "*/" in raw)
    pieces, after = cut(plain, state, final, True, dollar_later)
    return pieces, replace(after, comment=comment, raw=raw)


def cut_statements(text: str | None, blocks: bool = True) -> list[str]:
    """Statements of a script without comments."""
    return [part for piece, _, _ in cut(text or "", State(), True, blocks)[0] if (part := piece.strip())]
