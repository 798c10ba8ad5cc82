"""Scalar helpers on dates, identifiers, numbers, arrays and JSON."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import patterns as P


def general_category(categories: Column) -> Column:
    """Text before the first dot."""
    return F.split_part(categories, F.lit("."), F.lit(1))


def year_of(date: Column) -> Column:
    """Integer of the first four characters; null where they are no integer."""
    return F.substring(date, 1, 4).try_cast("int")


def year_matched(date: Column) -> Column:
    """Year from 1000 to 2999 at the start of the text, else null."""
    return F.regexp_extract(date, P.YEAR_START, 1).try_cast("int")


def doi_prefix(doi: Column) -> Column:
    """Shortest text up to and including the first slash; null without one."""
    return F.nullif(F.regexp_extract(doi, P.DOI_PREFIX, 0), F.lit(""))


def is_missing(value: Column, numeric: bool = False) -> Column:
    """Null test; for floating-point columns not-a-number counts as missing."""
    return value.isNull() | F.isnan(value) if numeric else value.isNull()


def word_count(text: Column, null_as_word: bool = False) -> Column:
    """Number of blank-separated words.

    ``null_as_word`` counts a null as one word, as a cast of a missing value to
    text would.
    """
    if null_as_word:
        text = F.coalesce(text, F.lit("nan"))
    return F.regexp_count(text, F.lit(P.NON_SPACES))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(P.NON_SPACES), F.lit(0))


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def round_even(value: Column, digits: int = 2) -> Column:
    return F.bround(value, digits)


def log2(value: Column) -> Column:
    return F.log2(value)


def argmax(scores: Column) -> Column:
    """Zero-based place of the largest score; the first one wins a tie."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def hms(seconds: Column) -> Column:
    """Seconds as ``h:mm:ss``, rounded half to even, with a day count in front
    once a day is full."""
    total = F.bround(seconds.cast("double"), 0).cast("bigint")
    days = F.floor(total / 86400)
    rest = F.pmod(total, F.lit(86400))
    clock = F.format_string(
        "%d:%02d:%02d",
        F.floor(rest / 3600),
        F.floor(F.pmod(rest, F.lit(3600)) / 60),
        F.pmod(rest, F.lit(60)),
    )
    unit = F.when(F.abs(days) == 1, F.lit(" day, ")).otherwise(F.lit(" days, "))
    return F.when(days == 0, clock).otherwise(F.concat(days.cast("string"), unit, clock))


def json_pairs(text: Column) -> Column:
    """Map of a JSON object's keys to their values as text."""
    return F.from_json(text, "map<string,string>")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a variable.

    An array used inside a lambda would otherwise be computed again for every
    element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
