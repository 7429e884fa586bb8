"""Boundaries of byte-level pre-tokens without running a regular expression.

Each code point has a class; each class is a transition function of an 11-state automaton.  Composition of
such functions is associative, so the states along a text come from a blocked scan: the functions that can
arise form a small monoid, whose elements and products are tabled once, and a scan step is one table look-up
for a whole column of blocks.  State and class then give the boundary before each code point.

The pre-tokens are those of the widespread byte-level pattern: English contractions, an optional space with
letters, with numbers or with other signs, and white space of which the last sign may go to the next token.
"""

from __future__ import annotations

import sys
from functools import cache

import numpy as np

# classes of code points
LETTER, STMD, R, V, L, E, NUMBER, QUOTE, OTHER, SPACE, WHITE = range(11)
# states: what the last code point belongs to
(S_START, S_LETTER, S_NUMBER, S_OTHER, S_QUOTE, S_R, S_V, S_L, S_DONE, S_SPACE, S_WHITE) = range(11)
STATES = 11
#: The code points with the Unicode property White_Space.
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
BLOCK = 64


def _with_property(pattern: str) -> list[int]:
    """Code points that the tokenizer library's own Unicode tables give a property; Python's are of another version."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    bytewise = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return [ord(c) for c in bytes(bytewise.encode_ordinary(every)).decode()]


@cache
def classes() -> np.ndarray:
    """Class of every code point."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    out[_with_property(r"\p{L}")] = LETTER
    out[_with_property(r"\p{N}")] = NUMBER
    out[WHITE_SPACE] = WHITE
    for chars, k in (("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E), ("'", QUOTE), (" ", SPACE)):
        out[[ord(c) for c in chars]] = k
    return out


def _next(state: int, kind: int) -> int:
    """The state after a code point of class ``kind``."""
    if kind in (LETTER, STMD, R, V, L, E):
        if state == S_QUOTE and kind == STMD:
            return S_DONE
        if state == S_QUOTE and kind in (R, V, L):
            return {R: S_R, V: S_V, L: S_L}[kind]
        if state in (S_R, S_V) and kind == E or state == S_L and kind == L:
            return S_DONE
        return S_LETTER
    if kind == QUOTE:  # starts a token unless a space or another sign before takes it in
        return S_OTHER if state in (S_OTHER, S_QUOTE, S_SPACE) else S_QUOTE
    return {NUMBER: S_NUMBER, OTHER: S_OTHER, SPACE: S_SPACE, WHITE: S_WHITE}[kind]


def _starts(state: int, kind: int) -> bool:
    """Whether a token starts before a code point, looking back only; white space after white space is apart."""
    group = {S_LETTER: "L", S_R: "L", S_V: "L", S_L: "L", S_NUMBER: "N", S_OTHER: "O", S_QUOTE: "O"}.get(state)
    mine = "L" if kind <= E else {NUMBER: "N", QUOTE: "O", OTHER: "O"}.get(kind, "W")
    if state == S_START or state == S_DONE:
        return True
    if state in (S_SPACE, S_WHITE):
        return mine != "W" and state == S_WHITE
    if state == S_QUOTE and kind == STMD:
        return False
    return group != mine


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Elements of classes, the same after a restart, products, results of elements by state, starts by state and class."""
    plain = [tuple(_next(s, k) for s in range(STATES)) for k in range(11)]
    again = [(f[S_START],) * STATES for f in plain]
    one = tuple(range(STATES))
    known = {one: 0}
    for f in plain + again:
        known.setdefault(f, len(known))
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in [*known]:
            for x, y in ((f, g), (g, f)):
                made = tuple(y[x[s]] for s in range(STATES))  # x first
                if made not in known:
                    known[made] = len(known)
                    todo.append(made)
    if len(known) > 256:
        raise AssertionError("the monoid outgrew a byte")
    fs = list(known)
    product = np.array([[known[tuple(g[f[s]] for s in range(STATES))] for g in fs] for f in fs], np.uint8)
    starts = np.array([[_starts(s, k) for k in range(11)] for s in range(STATES)])
    return np.array([known[f] for f in plain], np.uint8), np.array([known[f] for f in again], np.uint8), product, np.array(fs, np.uint8), starts


def _states(elements: np.ndarray) -> np.ndarray:
    """The state after each element, from the start state: blocks, then their totals, then inside the blocks."""
    _, _, product, results, _ = _tables()
    n = len(elements)
    if n <= BLOCK:
        out, state = np.empty(n, np.uint8), S_START
        for i, f in enumerate(elements.tolist()):
            state = results[f, state]
            out[i] = state
        return out
    m = -(-n // BLOCK)
    columns = np.zeros(m * BLOCK, np.uint8)  # 0 is the identity
    columns[:n] = elements
    columns = np.ascontiguousarray(columns.reshape(m, BLOCK).T)
    flat, size = product.ravel(), len(product)
    total = columns[0]
    for column in columns[1:]:
        total = flat[total.astype(np.intp) * size + column]
    entry = np.empty(m, np.uint8)
    entry[0] = S_START
    entry[1:] = _states(total[:-1])
    out, state, by_state = np.empty((BLOCK, m), np.uint8), entry, results.ravel()
    for j, column in enumerate(columns):
        state = by_state[column.astype(np.intp) * STATES + state]
        out[j] = state
    return out.T.ravel()[:n]


def boundaries(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in ``points``, code points of texts that begin at ``firsts`` (none empty)."""
    plain, again, _, _, starts = _tables()
    kinds = classes()[points]
    elements = plain[kinds]
    elements[firsts] = again[kinds[firsts]]
    after = _states(elements)
    before = np.empty_like(after)
    before[0], before[1:] = S_START, after[:-1]
    before[firsts] = S_START
    out = starts[before, kinds]
    # a contraction of two letters: its first letter had seemed to start a token
    ended = np.flatnonzero((after == S_DONE) & (before != S_QUOTE))
    out[ended - 1] = False
    # the last white space before another sign in the same text is apart from white space before it
    white = kinds >= SPACE
    follows = np.zeros(len(points), bool)
    follows[:-1] = ~white[1:]
    lasts = firsts[1:] - 1
    follows[lasts] = False
    out |= white & follows & ((before == S_SPACE) | (before == S_WHITE))
    return np.flatnonzero(out)
