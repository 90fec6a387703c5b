"""Large dictionaries: all words of a text in one pass over it.

A few words are searched one by one (``text.words_in``); that costs a pass a word.  An Aho-Corasick automaton
finds any number of them in a single pass, overlapping and nested ones included.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from usemeter.functions.text import blank_if_null, words_in

ONE_BY_ONE = 64


@lru_cache(maxsize=4)
def _automaton(words: tuple[str, ...]):
    """Of a worker: built once for each dictionary; a word that is repeated has its places together."""
    import ahocorasick

    places: dict[str, list[int]] = {}
    for place, word in enumerate(words):
        places.setdefault(word, []).append(place)
    everywhere = places.pop("", [])
    automaton = ahocorasick.Automaton()
    for word, at in places.items():
        automaton.add_word(word, at)
    automaton.make_automaton()
    return automaton, everywhere


def find_words(text: str, words: tuple[str, ...]) -> list[str]:
    """The dictionary words that occur in ``text``, in the order of the dictionary."""
    automaton, everywhere = _automaton(words)
    found = set(everywhere)
    for _, places in automaton.iter(text):
        found.update(places)
    return [words[place] for place in sorted(found)]


def words_of(c: Column, words: tuple[str, ...], one_by_one: int = ONE_BY_ONE) -> Column:
    """The dictionary words that occur in a text, in dictionary order; null texts hold none.

    Dictionaries of up to ``one_by_one`` words are searched word by word inside the JVM, larger ones by
    an automaton in Arrow batches; both find the same.  The empty word occurs in every text.
    """
    if len(words) <= one_by_one:
        return words_in(blank_if_null(c), words)

    def search(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: find_words(t, words))

    return F.pandas_udf(search, "array<string>")(blank_if_null(c))
