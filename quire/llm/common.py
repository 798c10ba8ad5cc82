"""What several operators of this folder share."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a set of characters and as a regular expression.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text, as an array; empty for null and for white space alone."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(bare) > 0, F.split(bare, SPACE_RUN)).otherwise(
        F.array().cast("array<string>")
    )


def characters_in(text: Column, characters: str) -> Column:
    """How many code points of ``text`` are among ``characters``."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


#: Up to so many document keys (id and text hash, 16 bytes) are sent to every task;
#: more are joined by a shuffle, with the same rows as a result.
SENT_KEYS = 1_000_000


def text_hash(text: Column) -> Column:
    """Tells texts of one id apart; a null text counts as an empty one."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def give_back() -> None:
    """Hand freed memory back to the system: Python workers live on between tasks and
    stages, and what they keep adds up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator], Iterator], keep_memos: bool = False) -> Callable[[Iterator], Iterator]:
    """The same task function, which gives freed memory back at its end. What an earlier
    stage left in the worker to be quick again (the codecs' memos) goes first, but for
    ``keep_memos``."""

    @wraps(run)
    def task(batches: Iterator) -> Iterator:
        codecs = sys.modules.get("quire.llm.bpe")
        if codecs is not None and not keep_memos:
            codecs.forget()
            give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def own_prefix(docs: DataFrame) -> str:
    """A prefix that no column of ``docs`` begins with, for helper columns beside them."""
    prefix = "__"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    return prefix


def without(
    docs: DataFrame,
    gone: DataFrame,
    id_col: str,
    text_col: str,
    how: str = "left_anti",
    mark: Column | None = None,
) -> DataFrame:
    """The rows of ``docs`` whose (id, text hash) is not in the written table ``gone``
    with the columns ``id`` and ``print`` (or is, with ``left_semi``); null-safe, all
    columns kept. ``mark`` replaces the text hash where more than the text tells rows apart."""
    p = own_prefix(docs)
    named = gone.select(F.col("id").alias(f"{p}id"), F.col("print").alias(f"{p}print"))
    if named.count() <= SENT_KEYS:
        named = F.broadcast(named)
    own = text_hash(docs[text_col]) if mark is None else mark
    same = (own == F.col(f"{p}print")) & docs[id_col].eqNullSafe(F.col(f"{p}id"))
    return docs.join(named, same, how)
