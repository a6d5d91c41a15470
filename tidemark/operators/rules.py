"""Ordered rule lists as CASE expressions: the first rule that matches decides."""

from functools import reduce
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import has_whole_word


def _cases(branches, default) -> Column:
    if not branches:
        return F.lit(default).cast("string")
    first, *rest = branches
    chain = reduce(lambda acc, b: acc.when(b[0], b[1]), rest, F.when(*first))
    return chain if default is None else chain.otherwise(F.lit(default))


def like_ladder(text: Column, rungs, default: str = "Other") -> Column:
    """``rungs``: (lower-case substring, label). Case-insensitive substring match."""
    low = F.lower(text)
    return _cases([(low.like(f"%{needle}%"), F.lit(label)) for needle, label in rungs], default)


def substring_label(text: Column, groups, default: str | None = None, fold_case: bool = False) -> Column:
    """``groups``: (label, [substring, ...]). First group with a contained substring."""
    source = F.lower(text) if fold_case else text
    branches = [
        (reduce(lambda a, b: a | b, [source.contains(n) for n in needles]), F.lit(label))
        for label, needles in groups
    ]
    return _cases(branches, default)


def word_label(text: Column, rules, default: str | None = None) -> Column:
    """``rules``: (phrase, label). First rule whose phrase stands alone, any case.

    Neighbouring rules with one label become one alternation: the order between
    labels is what decides, and the text is searched fewer times.
    """
    branches = []
    for label, run in groupby(rules, key=lambda r: r[1]):
        branches.append((has_whole_word(text, [phrase for phrase, _ in run]), F.lit(label)))
    return _cases(branches, default)
