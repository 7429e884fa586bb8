"""Column helpers for text: white space, sentences, match places, rounding."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of every alphabet, for Java patterns; ``\s`` there is ASCII only.
WS = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
#: The same signs, each once.
BLANKS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: ASCII word boundaries: Java's ``\b`` takes letters of other alphabets for word signs too.
LEFT, RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: Ends of sentences; the ASCII full stop is none.
SENTENCE_END = r"[。；;！？\n]+"
ELLIPSIS = "\n…[截断]"


def trim(c: Column) -> Column:
    """Without white space of any alphabet at the ends."""
    return F.btrim(c, F.lit(BLANKS))


def squeeze(c: Column) -> Column:
    """White space runs as one blank, trimmed."""
    return trim(F.regexp_replace(c, f"{WS}+", " "))


def bare(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(c, f"{WS}+", "")


def clip(c: Column, most: int = 120_000) -> Column:
    """The first ``most`` characters and a mark if there were more."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(ELLIPSIS))).otherwise(c)


def sentences(c: Column, min_len: int) -> Column:
    """Trimmed sentences of at least ``min_len`` characters; null text has none."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), SENTENCE_END, -1), trim)
    return F.filter(parts, lambda s: F.length(s) >= min_len)


def round2(c: Column) -> Column:
    """Two decimals, halves up as a double: floor(100 x + 1/2) / 100."""
    return F.floor(c * 100 + F.lit(0.5)) / F.lit(100.0)


#: Lengths that are summed one by one when a match is placed; whole blocks of them are summed once.
STRIDE = 64


def _bound(value: Column, fn) -> Column:
    """``fn`` of a value that is worked out once, however often ``fn`` names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _before(lengths: Column) -> Column:
    """The sums of all lengths before each block of STRIDE."""
    blocks = F.sequence(F.lit(0), F.floor(F.size(lengths) / STRIDE).cast("int"))
    total = lambda acc, k: F.element_at(acc, -1) + F.aggregate(F.slice(lengths, k * STRIDE + 1, STRIDE), F.lit(0), lambda s, n: s + n)
    return F.aggregate(blocks, F.array(F.lit(0)), lambda acc, k: F.concat(acc, F.array(total(acc, k))))


def matches(text: Column, pattern: str, most: int) -> Column:
    """ARRAY<STRUCT<off INT, match STRING>>: the first ``most`` matches with their places from 0.

    Built from what lies between the matches; the pattern must not match the empty string.  Places are sums over blocks
    and within one, so a text of very many matches takes time in proportion to them.  A null text gives null.
    """
    found = F.slice(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), 1, most)
    between = F.slice(F.split(text, pattern, -1), 1, most)
    pairs = F.filter(F.arrays_zip(between.alias("gap"), found.alias("match")), lambda p: p["match"].isNotNull())

    def placed(pairs: Column, lengths: Column, before: Column) -> Column:
        def place(p: Column, i: Column) -> Column:
            block = F.floor(i / STRIDE).cast("int")
            inside = F.aggregate(F.slice(lengths, block * STRIDE + 1, i % STRIDE), F.lit(0), lambda s, n: s + n)
            return F.struct((F.get(before, block) + inside + F.length(p["gap"])).alias("off"), p["match"].alias("match"))

        return F.transform(pairs, place)

    size = lambda p: F.length(p["gap"]) + F.length(p["match"])
    return _bound(pairs, lambda ps: _bound(F.transform(ps, size), lambda lengths: _bound(_before(lengths), lambda before: placed(ps, lengths, before))))


def around(text: Column, off: Column, length: Column, reach: int) -> Column:
    """The match with up to ``reach`` characters on either side."""
    return F.substring(text, F.greatest(off - reach, F.lit(0)) + 1, F.least(off, F.lit(reach)) + length + reach)


def surrounded(text: Column, pattern: str, reach: int) -> Column:
    """ARRAY<STRUCT<match STRING, context STRING>>: every match, and it with up to ``reach`` characters on either side.

    The pattern must not match the empty string, so a context lies in the ``reach`` pieces before and after its match, of
    which no more than ``reach`` characters are looked at: time is in proportion to text and matches.  A null text gives null.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.arrays_zip(gaps.alias("gap"), found.alias("match"))
    piece = lambda p: F.concat(p["gap"], F.coalesce(p["match"], F.lit("")))
    some = F.lit(reach)

    def put(pairs: Column, heads: Column, tails: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            before = F.array_join(F.slice(tails, F.greatest(i - reach, F.lit(0)) + 1, F.least(i, some)), "")
            after = F.array_join(F.slice(heads, i + 2, some), "")
            return F.struct(p["match"].alias("match"), F.concat(F.right(F.concat(before, F.right(p["gap"], some)), some), p["match"], F.left(after, some)).alias("context"))

        return F.transform(F.filter(pairs, lambda p: p["match"].isNotNull()), one)

    return _bound(pairs, lambda ps: _bound(F.transform(ps, lambda p: F.left(piece(p), some)), lambda heads: _bound(F.transform(ps, lambda p: F.right(piece(p), some)), lambda tails: put(ps, heads, tails))))


def strings(values) -> Column:
    """An array literal of strings."""
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def present(text: Column, words) -> Column:
    """The words, in their order, that the text contains."""
    return F.filter(strings(words), lambda w: F.contains(text, w))


_PLAIN = r"[^\\()\[\]{}?*+.^$|]+"
_HEAD = re.compile(rf"\(\?:({_PLAIN}(?:\|{_PLAIN})*)\)(?![?*{{])")


def heads(pattern: str) -> list[str] | None:
    """The words with one of which every match begins, if the pattern starts with ``(?:a|b)``; None if that isn't sure."""
    head = _HEAD.match(pattern)
    rest = pattern[head.end() :] if head else ""
    if not head or "\\Q" in rest or re.search(r"\(\?[A-Za-z-]", rest):
        return None
    rest = re.sub(r"\[[^\[\]]*\]", "", re.sub(r"\\.", "", rest, flags=re.DOTALL))
    while (inner := re.sub(r"\([^()]*\)", "", rest)) != rest:
        rest = inner
    return None if re.search(r"[()\[\]|]", rest) else head[1].split("|")


def may_hold(text: Column, words) -> Column | None:
    """False or null only for texts without any of the words, from few passes over a text; None if there is no such test.

    The words in ASCII must be few.  Any other word has a sign between the least and the greatest of the words' last signs
    by code point, and a text of ASCII signs alone has none of them.
    """
    ascii_words, last = [w for w in words if w.isascii()], sorted(max(w) for w in words if not w.isascii())
    if not last or 8 * len(ascii_words) > len(words):
        return None
    held = (F.octet_length(text) > F.length(text)) & text.rlike(rf"[\x{{{ord(last[0]):x}}}-\x{{{ord(last[-1]):x}}}]")
    for w in ascii_words:
        held = held | F.contains(text, F.lit(w))
    return held
