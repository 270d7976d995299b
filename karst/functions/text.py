"""Tokens, scores and distances of texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that the index leaves out.
STOP_WORDS = (
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "was", "are", "were",
    "been", "be", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "can", "this",
    "that", "these", "those",
)


def _runs(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}]+")


def _kept(runs: Column, stop_words: tuple[str, ...], shortest: int) -> Column:
    return F.filter(runs, lambda t: (F.length(t) >= shortest) & ~t.isin(list(stop_words)))


def tokens(text: Column, stop_words: tuple[str, ...] = STOP_WORDS, shortest: int = 2) -> Column:
    """Lower-case runs of letters and digits, without stop words and short ones; null text has none."""
    return _kept(_runs(text), stop_words, shortest)


def token_set(text: Column, stop_words: tuple[str, ...] = STOP_WORDS, shortest: int = 2) -> Column:
    """The different ones of tokens."""
    return _kept(F.array_distinct(_runs(text)), stop_words, shortest)


def _equal_to(term: str):
    return lambda w: w == F.lit(term)


def score_parts(text: Column) -> Column:
    """A struct of the trimmed lower-case text and its words, from which ``score_of`` works."""
    low = F.trim(F.lower(F.coalesce(text, F.lit(""))))
    return F.struct(low.alias("low"), F.split(low, r"\s+").alias("words"))


def score_of(parts: Column, query: str) -> Column:
    """How well a text fits the white-space separated terms of query; 0 for an empty text.

    Each term that occurs as a substring gives 1, half a point for each word that equals
    it, 2 if the text begins with it, and 1 / words; the sum goes by 4.5 points a term.
    """
    low, words = parts["low"], parts["words"]
    terms = query.lower().split()
    if not terms:
        raise ValueError("the query has no term")
    total = F.lit(0.0)
    for t in terms:
        points = (
            F.lit(1.0)
            + F.lit(0.5) * F.size(F.filter(words, _equal_to(t)))
            + F.when(F.startswith(low, F.lit(t)), 2.0).otherwise(0.0)
            + F.lit(1.0) / F.size(words)
        )
        total = total + F.when(F.contains(low, F.lit(t)), points).otherwise(0.0)
    return F.when(low == "", 0.0).otherwise(total / (4.5 * len(terms)))


def score(text: Column, query: str) -> Column:
    return score_of(score_parts(text), query)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, in any letter case; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(F.lower(a), F.lower(b)) / longest)


def has_phrase(text_tokens: Column, phrase: list[str]) -> Column:
    """Whether the tokens hold the phrase's tokens in a row. No shuffle: the test is per row."""
    if not phrase:
        return F.lit(False)
    # tokens hold letters and digits only, so a space parts them
    return F.contains(F.concat(F.lit(" "), F.array_join(text_tokens, " "), F.lit(" ")), F.lit(f" {' '.join(phrase)} "))
