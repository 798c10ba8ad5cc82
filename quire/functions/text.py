"""Text cleaning, tokens, n-grams and token normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.constants import ENGLISH_STOP_WORDS
from quire.functions import patterns as P
from quire.functions.scalars import let

# Words that a treebank tokenizer cuts in two (first|second part).
TWO_PART_WORDS: list[tuple[str, str]] = [
    ('can', 'not'),
    ('gim', 'me'),
    ('gon', 'na'),
    ('got', 'ta'),
    ('lem', 'me'),
    ('wan', 'na'),
]


def clean_letters(text: Column) -> Column:
    """ASCII letters in lower case, everything else one blank."""
    return F.trim(F.lower(F.regexp_replace(text, P.NON_LETTERS, " ")))


def clean_alphanumerics(text: Column) -> Column:
    """ASCII letters and digits in lower case, everything else one blank."""
    return F.trim(F.lower(F.regexp_replace(text, P.NON_ALPHANUMERICS, " ")))


def long_word_text(text: Column, longer_than: int = 2) -> Column:
    """Letters-only text reduced to its tokens longer than ``longer_than``."""
    cuts = "|".join(rf"{head}(?={tail}\b)" for head, tail in TWO_PART_WORDS)
    spaced = F.regexp_replace(clean_letters(text), rf"\b(?:{cuts})", "$0 ")
    # A word is a maximal run of letters here, so the length test fits the pattern.
    kept = F.regexp_extract_all(spaced, F.lit(f"[a-z]{{{longer_than + 1},}}"), F.lit(0))
    return F.array_join(kept, " ")


def lower_tokens(text: Column) -> Column:
    """Runs of lower-case letters and apostrophes."""
    return F.regexp_extract_all(text, F.lit(P.LOWER_TOKENS), F.lit(0))


def alphanumeric_tokens(text: Column) -> Column:
    """Words of the alphanumeric cleaning."""
    return F.regexp_extract_all(clean_alphanumerics(text), F.lit("[a-z0-9]+"), F.lit(0))


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of at least two word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(P.WORDS_OF_TWO), F.lit(0))


def drop_stop_words(tokens: Column, stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> Column:
    """Tokens that are not listed. Spark's list is shorter than some libraries'
    English lists, so callers may pass their own."""
    listed = list(stop_words)
    return F.filter(tokens, lambda token: ~token.isin(listed))


def ngrams(tokens: Column, low: int = 1, high: int = 1) -> Column:
    """All n-grams with ``low`` to ``high`` tokens, joined by one blank."""
    if (low, high) == (1, 1):
        return tokens

    def grams(parts: Column, n: int) -> Column:
        heads = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - (n - 1), F.lit(0)))
        return F.transform(
            heads,
            lambda head, i: F.concat_ws(" ", head, *[F.get(parts, i + j) for j in range(1, n)]),
        )

    return let(
        tokens,
        lambda parts: F.concat(
            *[parts if n == 1 else grams(parts, n) for n in range(low, high + 1)]
        ),
    )
