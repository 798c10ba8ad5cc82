"""Author strings: from one free-text field to an array of clean names."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import patterns as P


def strip_nested_parens(text: Column) -> Column:
    """Remove balanced parentheses with their content, at any depth.

    Each pass removes all innermost pairs, so as many passes as there are
    opening signs always reach the outermost; unbalanced signs stay.
    """
    passes = F.sequence(F.lit(0), F.regexp_count(text, F.lit(r"\(")))
    return F.aggregate(
        passes, text, lambda left, _: F.regexp_replace(left, P.INNER_PARENS, "")
    )


def strip_flat_parens(text: Column) -> Column:
    """Remove everything from each opening sign to the next closing one."""
    return F.regexp_replace(text, P.FLAT_PARENS, "")


def and_to_comma(text: Column) -> Column:
    return F.regexp_replace(text, f"{P.SPACE}and{P.SPACE}", ",")


def drop_et_al(text: Column) -> Column:
    return F.replace(text, F.lit(", et al"), F.lit(""))


def collapse_commas(text: Column) -> Column:
    return F.regexp_replace(text, ",{2,}", ",")


def split_commas(text: Column) -> Column:
    return F.split(text, ",", -1)


def clean_name(name: Column) -> Column:
    """Keep word characters and blanks, lower the case, squeeze the blanks."""
    kept = F.lower(F.regexp_replace(name, P.NEITHER_WORD_NOR_SPACE, ""))
    return F.trim(F.regexp_replace(kept, P.SPACES, " "))


def clean_names(names: Column) -> Column:
    return F.filter(F.transform(names, clean_name), lambda name: name != "")


def ascii_names(names: Column) -> Column:
    """The older cleaning: other than ASCII letters become blanks, only the ends
    are trimmed, so blanks inside a name are kept."""
    lowered = F.transform(
        names, lambda name: F.trim(F.lower(F.regexp_replace(name, "[^a-zA-Z]", " ")))
    )
    return F.filter(lowered, lambda name: name != "")


def join_names(names: Column) -> Column:
    return F.array_join(names, ",")


def author_list(author: Column) -> Column:
    """The whole chain: free-text author field to an array of clean names."""
    text = strip_nested_parens(author)
    for step in (and_to_comma, drop_et_al, collapse_commas):
        text = step(text)
    return clean_names(split_commas(text))


def author_list_ascii(author: Column) -> Column:
    """The older chain: flat parentheses, ASCII letters."""
    return ascii_names(split_commas(and_to_comma(strip_flat_parens(author))))
