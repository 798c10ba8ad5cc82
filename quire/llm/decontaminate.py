"""Benchmark decontamination by windows of normalised words.

The windows of the test items (13 words; an item of fewer words is one window)
form a hash set that is broadcast. Every token window of the training texts is
looked up in it by a 64-bit hash, each hit is verified word by word, and the
words inside verified windows are counted, and lead to the whole document's removal
where they are enough; no spans are cut out of texts. Built-in functions only; texts are never shuffled, only hits are.

The set is broadcast while it has at most ``BROADCAST_WINDOWS`` rows (counted
before the join); beyond that the hashes of all windows are joined by a shuffle.

Defined cases: a null text has no words (and so is kept, n_words 0); a null id is
an id like any other; rows that repeat both id and text are one document in
``hits`` and in the report, rows sharing only the id give one row each; null or
empty texts of items have no window; an item without an id hits like any other but is
not among the items found; without items nothing is hit; an empty table gives an
empty one; other columns are not read, and ``clean`` keeps them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import text_hash, without
from quire.session import materialise

WINDOW = 13
#: A row of the set is a hash, a length, an id and 13 words: about 200 bytes.
BROADCAST_WINDOWS = 200_000
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normal_words(text: Column) -> Column:
    """Words of digits, letters and characters beyond ASCII, with A-Z in lower case."""
    parts = F.split(F.translate(text, _CAPITALS, _CAPITALS.lower()), _BETWEEN)
    return F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda w: w != "")


def _hash_of(hashes: Column | str, i: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(hashes, i + k) for k in range(length)], F.lit(length))


def _word_hashes(words: str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _windows(hashes: str, n: str, length: int) -> Column:
    return F.when(
        F.col(n) >= length,
        F.transform(F.sequence(F.lit(0), F.col(n) - length), lambda i: _hash_of(hashes, i, length)),
    ).otherwise(F.array().cast("array<bigint>"))


def windows_of_items(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(hash, length, window words, item ids) of every distinct window."""
    cut = (
        items.select(
            F.col(id_col).cast("string").alias("item"),
            normal_words(F.col(text_col).cast("string")).alias("w"),
        )
        .where(F.size("w") > 0)
        .withColumn("size", F.least(F.size("w"), F.lit(WINDOW)))
        .select(
            "item",
            "size",
            F.explode(
                F.transform(
                    F.sequence(F.lit(1), F.size("w") - F.col("size") + 1),
                    lambda i: F.slice("w", i, F.col("size")),
                )
            ).alias("window"),
        )
        .select("item", "size", "window", _word_hashes("window").alias("h"))
    )
    of_length = F.lit(None).cast("long")
    for length in range(1, WINDOW + 1):
        of_length = F.when(F.col("size") == length, _hash_of("h", F.lit(0), length)).otherwise(of_length)
    return cut.groupBy(of_length.alias("hash"), "size", "window").agg(
        F.sort_array(F.collect_set("item")).alias("item_list")
    )


def hits(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Per document (id, text hash): its number of words, the verified hit windows as
    (place, length) and the ids of the items found.

    One pass: a marker row per text goes along with the windows, so documents
    without a hit stay in the result and no second join brings them back.
    """
    wanted = windows_of_items(items, item_id, item_text)
    # The lengths that occur: 13, and one for each size of shorter items.
    sizes = {r["size"]: r["n"] for r in wanted.groupBy("size").agg(F.count("*").alias("n")).collect()}
    small = sum(sizes.values()) <= BROADCAST_WINDOWS
    hashed = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        .select("id", text_hash(F.col("text")).alias("print"), normal_words(F.col("text")).alias("w"))
        .select("*", F.size("w").alias("n"), _word_hashes("w").alias("wh"))
    )
    # Place -1 marks the document itself; no window has the length 0.
    marker = F.array(F.struct(F.lit(0).alias("size"), F.array(F.lit(0).cast("long")).alias("hashes")))
    lists = marker
    if sizes:
        lists = F.concat(
            marker,
            F.array(
                *[
                    F.struct(F.lit(size).alias("size"), _windows("wh", "n", size).alias("hashes"))
                    for size in sorted(sizes)
                ]
            ),
        )
    places = (
        hashed.select("id", "print", "n", "w", F.explode(lists).alias("x"))
        .select("id", "print", "n", "w", F.col("x.size").alias("len"), F.col("x.hashes").alias("hashes"))
        .select("id", "print", "n", "w", "len", F.posexplode("hashes").alias("at", "hash"))
    )
    side = wanted.select("hash", F.col("size").alias("len"), "window", "item_list")
    equal = F.slice("w", F.col("at") + 1, F.col("len")) == F.col("window")
    columns = ["id", "print", "n", "len", "at"]
    # The list of a window is never null, but empty if no item with it has an id.
    if small:
        kept = (
            places.join(F.broadcast(side), ["hash", "len"], "left")
            .select(*columns, F.when(equal, F.col("item_list")).alias("item_list"))
            .where((F.col("len") == 0) | F.col("item_list").isNotNull())
        )
    else:
        # Only hashes are shuffled; the words of documents with a match are joined again.
        matched = places.drop("w").join(side, ["hash", "len"])
        texts = hashed.select(F.col("id").alias("_id"), F.col("print").alias("_print"), "w").distinct()
        same = (F.col("print") == F.col("_print")) & F.col("id").eqNullSafe(F.col("_id"))
        found = matched.join(texts, same).where(equal).select(*columns, "item_list")
        kept = found.unionByName(places.where("len = 0").select(*columns), allowMissingColumns=True)
    return kept.groupBy("id", "print").agg(
        F.max("n").alias("n_words"),
        F.sort_array(
            F.collect_set(F.when(F.col("len") > 0, F.struct("at", "len")))
        ).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_list")))).alias("found_items"),
    )


def hit_words() -> Column:
    """How many words lie in ``spans``: each window adds what goes beyond those before."""
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
    return F.aggregate(
        "spans",
        start,
        lambda acc, x: F.struct(
            (
                acc["total"]
                + F.greatest(F.lit(0), x["at"] + x["len"] - F.greatest(x["at"], acc["end"]))
            ).alias("total"),
            F.greatest(acc["end"], x["at"] + x["len"]).alias("end"),
        ),
    )["total"].cast("long")


def report(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Per document: words, hit words, items found, and whether it is contaminated."""
    counted = hits(docs, items, id_col, text_col, item_id, item_text).withColumn("n_hit", hit_words())
    return counted.select(
        F.col("id").alias(id_col),
        F.col("n_words").cast("long").alias("n_words"),
        "n_hit",
        "found_items",
        "spans",
        "print",
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def clean(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The documents, all columns, without the contaminated ones.

    Only (id, text hash) of the contaminated documents is joined.
    """
    found = report(docs, items, id_col, text_col).where("contaminated")
    bad = materialise(found.select(F.col(id_col).alias("id"), "print"), "contaminated")
    return without(docs, bad, id_col, text_col)
