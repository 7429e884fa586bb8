"""Patterns of rule packs that were written for JavaScript, for Java's engine.

A pack's pattern is one of three: it can be translated; it is no JavaScript pattern, and a rule goes on without it; or Java
can't express it, or it can match nothing at all, and the rule that holds it can't be decided.
"""

from __future__ import annotations

import re

from procurelake.functions.text import WS

#: What the shorthands stand for in JavaScript, inside a character class.
SPACE, DIGIT, WORD = WS[1:-1], "0-9", "A-Za-z0-9_"
NOT_END = r"\n\r\u2028\u2029"
BOUNDARY = f"(?:(?<![{WORD}])(?=[{WORD}])|(?<=[{WORD}])(?![{WORD}]))"
NO_BOUNDARY = f"(?:(?<![{WORD}])(?![{WORD}])|(?<=[{WORD}])(?=[{WORD}]))"
#: Escapes that mean the same in both.
SHARED = "tnrfv"


class Invalid(ValueError):
    """Not a pattern in JavaScript."""


class _Reader:
    """One pass over a pattern; ``out`` is the Java pattern so far."""

    def __init__(self, pattern: str):
        self.p, self.i, self.out = pattern, 0, []
        self.depth = 0
        self.groups = len(re.findall(r"(?<!\\)\((?!\?)|\(\?<[A-Za-z_$]", pattern))

    def more(self, n: int = 1) -> str:
        return self.p[self.i : self.i + n]

    def run(self) -> str:
        atom = False  # whether a quantifier may follow
        while self.i < len(self.p):
            c = self.more()
            if c == "(":
                atom = self.opened()
            elif c == ")":
                self.depth -= 1
                if self.depth < 0:
                    raise Invalid("unmatched )")
                self.take(")")
                atom = True
            elif c == "[":
                self.out.append(self.char_class())
                atom = True
            elif c == "\\":
                atom = self.escape()
            elif c in "*+?" or (c == "{" and re.match(r"\{\d+(?:,\d*)?\}", self.p[self.i :])):
                if not atom:
                    raise Invalid("nothing to repeat")
                self.quantifier()
                atom = False
            elif c == "|":
                self.take("|")
                atom = False
            elif c in "^$":
                self.take("^" if c == "^" else r"\z")
                atom = False
            else:
                self.take({".": f"[^{NOT_END}]", "{": r"\{", "}": r"\}", "]": r"\]"}.get(c, c))
                atom = True
        if self.depth:
            raise Invalid("unmatched (")
        return "".join(self.out)

    def take(self, java: str, n: int = 1) -> None:
        self.out.append(java)
        self.i += n

    def opened(self) -> bool:
        self.depth += 1
        head = re.match(r"\((?:\?(?::|=|!|<=|<!|<([A-Za-z][A-Za-z0-9]*)>))?", self.p[self.i :])[0]
        if self.more(2) == "(?" and head == "(":
            raise Invalid("unknown group")
        self.take(head, len(head))
        return False

    def quantifier(self) -> None:
        m = re.match(r"(?:[*+?]|\{(\d+)(?:,(\d*))?\})\??", self.p[self.i :])
        if m[1] and m[2] and int(m[1]) > int(m[2]):
            raise Invalid("numbers out of order")
        self.take(m[0], len(m[0]))

    def escape(self) -> bool:
        c = self.p[self.i + 1 : self.i + 2]
        if not c:
            raise Invalid("\\ at the end")
        if c in "bB":
            self.take(BOUNDARY if c == "b" else NO_BOUNDARY, 2)
            return False
        if c in "123456789":
            number = re.match(r"\d+", self.p[self.i + 1 :])[0]
            if int(number) <= self.groups:
                self.take(f"(?:\\{number})", 1 + len(number))
                return True
        if c == "k" and re.match(r"\\k<[A-Za-z][A-Za-z0-9]*>", self.p[self.i :]):
            m = re.match(r"\\k<[^>]*>", self.p[self.i :])[0]
            self.take(m, len(m))
            return True
        self.out.append(self.one_sign(False))
        return True

    def one_sign(self, inside: bool) -> str:
        """The escape at this place as a sign or, for a shorthand, as a class or what stands in one."""
        c = self.p[self.i + 1 : self.i + 2]
        if not c:
            raise Invalid("\\ at the end")
        sets = {"s": SPACE, "d": DIGIT, "w": WORD, "S": SPACE, "D": DIGIT, "W": WORD}
        if c in sets:
            self.i += 2
            if c.islower():
                return sets[c] if inside else f"[{sets[c]}]"
            return f"[^{sets[c]}]"
        for pattern in (r"\\x[0-9A-Fa-f]{2}", r"\\u[0-9A-Fa-f]{4}"):
            if m := re.match(pattern, self.p[self.i :]):
                self.i += len(m[0])
                return m[0]
        self.i += 2
        if c in SHARED:
            return r"\x0B" if c == "v" else "\\" + c
        if c == "0":
            return r"\x00"
        if c == "b" and inside:
            return r"\x08"
        return c if c.isalnum() else "\\" + c  # any other sign stands for itself

    def char_class(self) -> str:
        if self.more(3) == "[^]":
            self.i += 3
            return r"[\s\S]"
        if self.more(2) == "[]":
            self.i += 2
            return "(?!)"
        self.i += 1
        out = "["
        if self.more() == "^":
            out, self.i = "[^", self.i + 1
        while self.i < len(self.p) and self.more() != "]":
            c = self.more()
            if c == "\\":
                out += self.one_sign(True)
            else:
                out += "\\" + c if c in "[&~^" else c
                self.i += 1
        if self.i >= len(self.p):
            raise Invalid("unmatched [")
        self.i += 1
        for low, high in re.findall(r"([A-Za-z0-9])-([A-Za-z0-9])", out):
            if low > high:
                raise Invalid("range out of order")
        return out + "]"


def to_java(pattern: str) -> str:
    """The pattern for Java; ``Invalid`` if it is none in JavaScript."""
    return _Reader(pattern).run()


def usable(patterns: list[str], compiles, javascript: bool) -> tuple[list[str], str | None]:
    """The patterns for Java without the invalid ones, and why the rule can't be decided, if it can't.

    ``compiles`` says whether a pattern that Java takes matches signs only; None if Java doesn't take it.  One that can match
    nothing at all can't be decided, as places between signs are no findings.
    """
    good = []
    for p in patterns:
        try:
            java = to_java(p) if javascript else p
        except Invalid:
            continue
        told = compiles(java)
        if told is None and not javascript:
            continue
        if not told:
            return [], f"pattern can't be decided: {p}"
        good.append(java)
    return good, None
