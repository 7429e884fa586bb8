"""Words of a pack in texts by one Aho-Corasick automaton: one pass over a text, however many words there are."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from procurelake.functions.text import may_hold, present

#: Words of a pack from which the automaton is used; below, one search a word within the JVM is quicker than Python.
AUTOMATON_FROM = 200
FOUND = "array<struct<no:int,words:array<string>>>"


class Automaton:
    """The words of numbered groups; a word may be in several, or be empty (then every text has it)."""

    def __init__(self, groups: Sequence[Sequence[str]]):
        import ahocorasick

        self.groups = groups
        places: dict[str, list[tuple[int, int]]] = {}
        for g, words in enumerate(groups):
            for k, word in enumerate(words):
                places.setdefault(word, []).append((g, k))
        self.always = places.pop("", [])
        self.machine = ahocorasick.Automaton()
        for word, at in places.items():
            self.machine.add_word(word, at)
        if places:
            self.machine.make_automaton()
        self.some = bool(places)

    def find(self, text: str | None) -> list[tuple[int, list[str]]]:
        """(group, its words that the text contains, in its order), by group; a null text has none."""
        if text is None:
            return []
        met = {place for _, at in self.machine.iter(text) for place in at} if self.some else set()
        out: dict[int, list[str]] = {}
        for g, k in sorted(met.union(self.always)):
            out.setdefault(g, []).append(self.groups[g][k])
        return list(out.items())


def found_words(text: Column, groups: Sequence[Sequence[str]], from_words: int | None = None) -> Column:
    """ARRAY<STRUCT<no, words>>: the groups, by number, of which the text contains a word, with those words in order.

    Small packs are searched word by word in the JVM, in texts that may hold one, those of ``from_words`` words or more by an automaton; the answer is the same.
    """
    if sum(map(len, groups)) < (AUTOMATON_FROM if from_words is None else from_words):
        none = F.array().cast(FOUND)
        every = F.array(*[F.struct(F.lit(i).alias("no"), present(text, words).alias("words")) for i, words in enumerate(groups)]) if groups else none
        found, may = F.filter(every, lambda f: F.size(f["words"]) > 0), may_hold(text, [w for words in groups for w in words])
        return found if may is None else F.when(may, found).otherwise(none)
    packed = [list(g) for g in groups]

    @F.pandas_udf(FOUND)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = Automaton(packed)  # once for each task
        for texts in batches:
            yield pd.Series([[{"no": g, "words": words} for g, words in automaton.find(t)] for t in texts], dtype=object)

    return search(text)


def words_of(found: Column, no: int) -> Column:
    """The words of one group in what ``found_words`` gives; an empty array without any."""
    return F.coalesce(F.get(F.filter(found, lambda f: f["no"] == no), F.lit(0))["words"], F.array().cast("array<string>"))
