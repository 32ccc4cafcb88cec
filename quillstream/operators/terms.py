"""Many terms or patterns against whole texts in one pass.

Terms are data: an automaton over all of them reads a text once, whatever their number, and gives the numbers of
those that it holds; what follows decides on that small list inside the JVM.  A pattern names words of which its
matches hold at least one, and is tried only on texts where the automaton finds one of them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_one

WORD = re.compile(r"[a-z0-9][a-z0-9+.#/-]*")


@dataclass(frozen=True)
class Hits:
    """A text as the list of the terms that it holds: column has their numbers, terms says which they are."""

    column: Column
    terms: tuple[str, ...]

    def has(self, term: str) -> Column:
        return F.array_contains(self.column, self.terms.index(term))

    def any(self, terms) -> Column:
        return F.arrays_overlap(self.column, F.array(*[F.lit(self.terms.index(t)) for t in terms])) if terms else F.lit(False)


@lru_cache(16)
def _automaton(terms: tuple[str, ...], bordered: bool):
    import ahocorasick

    out = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        out.add_word(t, (i, len(t), bordered and bool(WORD.fullmatch(t))))
    out.make_automaton()
    return out


def _alnum(ch: str) -> bool:
    return "a" <= ch <= "z" or "0" <= ch <= "9"


def found(text: str, terms: tuple[str, ...], bordered: bool) -> list[int]:
    """The numbers of the terms in a text; with borders, terms of letters and digits count only between others."""
    seen: set[int] = set()
    last = len(text) - 1
    for end, (i, n, whole) in _automaton(terms, bordered).iter(text):
        if i in seen or whole and (end < last and _alnum(text[end + 1]) or end >= n and _alnum(text[end - n])):
            continue
        seen.add(i)
    return sorted(seen)


def term_hits(df: DataFrame, name: str, terms: list[str], *texts: Column, bordered: bool = True) -> tuple[DataFrame, Hits]:
    """df with the terms that the texts hold, normalised and joined by blanks, as a column of this name."""
    of = tuple(sorted(set(terms)))
    if not of:
        return df.withColumn(name, F.array().cast("array<int>")), Hits(F.col(name), of)

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([found(" ".join(map(normalize_one, row)), of, bordered) for row in zip(*columns)], dtype=object)

    one, two = lambda a: run(a), lambda a, b: run(a, b)  # noqa: E731  Spark counts a function's parameters
    column = F.pandas_udf(one if len(texts) == 1 else two, "array<int>", F.PandasUDFType.SCALAR)(*texts)
    return df.withColumn(name, column), Hits(F.col(name), of)


def pattern_hits(df: DataFrame, name: str, patterns: dict[str, tuple[str, tuple[str, ...]]], text: Column) -> tuple[DataFrame, Hits]:
    """df with the patterns that match the text as a column of this name.  patterns: name -> (pattern, words in lower case of
    which every match holds one)."""
    of = tuple(patterns)
    uses: dict[str, list[int]] = {}
    for i, key in enumerate(of):
        for word in patterns[key][1]:
            uses.setdefault(word, []).append(i)
    words = tuple(sorted(uses))
    sources = tuple(patterns[k][0].replace("(?iU)", "(?i)") for k in of)

    def run(column: pd.Series) -> pd.Series:
        import regex

        tests = [regex.compile(p) for p in sources]
        out = []
        for t in column:
            tried = {i for w in found(t.lower(), words, False) for i in uses[words[w]]} if t else ()
            out.append([i for i in sorted(tried) if tests[i].search(t)])
        return pd.Series(out, dtype=object)

    return df.withColumn(name, F.pandas_udf(run, "array<int>", F.PandasUDFType.SCALAR)(text)), Hits(F.col(name), of)


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as the session has cores, where its files are read by fewer."""
    most = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(most) if df.rdd.getNumPartitions() < most else df
