"""Which of many keywords stand in a text, found in one pass by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType


def automaton(words: list[str]):
    """The automaton of distinct words, none of them empty, with their places as values."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for i, w in enumerate(words):
        made.add_word(w, i)
    made.make_automaton()
    return made


def keyword_groups(text: Column, groups: list[list[str]]) -> Column:
    """Places (array<int>, ascending) of the groups of which any word lies anywhere in the text, case and all as given; none for a null text.

    The empty word lies in every text but null. Each text is read once, however many words there are: the groups travel with the
    function, and each task builds their automaton once.
    """
    of: dict[str, list[int]] = {}
    for i, words in enumerate(groups):
        for w in dict.fromkeys(words):
            of.setdefault(w, []).append(i)
    always = of.pop("", [])

    @F.pandas_udf(ArrayType(IntegerType()))
    def hits(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words, own = automaton(list(of)) if of else None, list(of.values())
        for s in texts:
            seen = ({k for _, k in words.iter(x)} if x and words else () for x in s)
            yield pd.Series([[] if x is None else sorted({*always, *(i for k in found for i in own[k])}) for x, found in zip(s, seen, strict=True)])

    return hits(text)


def keyword_hits(text: Column, words: list[str]) -> Column:
    """Places of the words that lie anywhere in the text."""
    return keyword_groups(text, [[w] for w in words])
