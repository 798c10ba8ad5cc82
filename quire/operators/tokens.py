"""Documents as tokens: stems, vocabularies, encodings and pooled vectors."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.constants import MAX_TOKENS
from quire.functions.stem import with_stem
from quire.operators.grams import cut
from quire.operators.lookup import at_most, fits_broadcast, lookup
from quire.operators.ordering import dense_position
from quire.operators.vectors import sum_vectors, vector_width
from quire.session import materialise

# The helpers below travel to the workers with the tasks that call them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Ids of the marker tokens; words follow from FIRST_WORD on.
PAD, UNKNOWN, START, END = 0, 1, 2, 3
FIRST_WORD = 4


def exploded(docs: DataFrame, tokens: Column | str, *keep: str, name: str = "term") -> DataFrame:
    """One row per token. The outer form with a filter behind it, because the
    plain one makes the planner test the array in front of the generator and
    tokenise every text again for that."""
    return docs.select(*keep, F.explode_outer(tokens).alias(name)).where(F.col(name).isNotNull())


def term_counts(docs: DataFrame, tokens: str = "tokens", id_col: str = "id") -> DataFrame:
    """(id, term, tf). A document's tokens lie in one task, so the partial
    aggregate already yields its counts and the shuffle moves one row per
    distinct term."""
    return (
        exploded(docs, tokens, id_col)
        .groupBy(id_col, "term")
        .agg(F.count("*").alias("tf"))
    )


def stem_table(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(token, stem) for every distinct token, written once."""
    distinct = exploded(docs, F.array_distinct(tokens), name="token").distinct()
    return materialise(with_stem(distinct), "stems")


def stem_documents(docs: DataFrame, tokens: str = "tokens", id_col: str = "id") -> DataFrame:
    """(id, tokens) with every token replaced by its stem, in place.

    The rules run once per distinct token. Documents are coded in batches: a batch has its
    distinct tokens once, so that only these are exploded, looked up and moved, and the
    documents come back from the codes. Documents without tokens stay; several rows of
    one id become one, in order of position and stem.
    """
    docs = docs.select(id_col, tokens)
    ids = docs.schema[id_col]
    coded_schema = T.StructType([T.StructField("b", T.LongType()), T.StructField("ids", T.ArrayType(ids.dataType)), *_CODED])
    coded = materialise(docs.mapInArrow(_coded, coded_schema), "coded")
    parts = coded.select(F.col("b").alias("of"), F.posexplode("words").alias("u", "token"))
    found = lookup(parts, stem_table(coded, "words"), "token", "of").select("of", "u", "stem")

    def back(batch: pa.Table, words: pa.Table) -> pa.Table:
        return _decoded(batch, words, [id_col, tokens])

    schema = T.StructType([ids, T.StructField(tokens, T.ArrayType(T.StringType()))])
    rebuilt = coded.drop("words").groupBy("b").cogroup(found.groupBy("of")).applyInArrow(back, schema)
    if not docs.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        return rebuilt
    placed = F.transform(tokens, lambda stem, pos: F.struct(pos.alias("pos"), stem.alias("stem")))
    merged = rebuilt.groupBy(id_col).agg(F.array_sort(F.flatten(F.collect_list(placed))).alias("parts"))
    return merged.select(id_col, F.col("parts.stem").alias(tokens))


#: A batch of documents: tokens per document, codes of the tokens one after the other
#: (-1: null), and the distinct tokens, by code.
_CODED = [
    T.StructField("sizes", T.ArrayType(T.IntegerType())),
    T.StructField("codes", T.BinaryType()),
    T.StructField("words", T.ArrayType(T.StringType())),
]
_BATCH_DOCS = 2_000


def _coded(batches: Iterator[pa.RecordBatch], most: int = _BATCH_DOCS) -> Iterator[pa.RecordBatch]:
    place, n = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            ids, lists = part.column(0), part.column(1)
            words = lists.flatten().dictionary_encode()
            codes = pc.fill_null(words.indices, -1).to_numpy(zero_copy_only=False).astype(np.int32)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).cast(pa.int32())
            # One list of everything per column.
            columns = [
                pa.array([place + n]),
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), sizes),
                pa.array([codes.tobytes()], pa.binary()),
                pa.ListArray.from_arrays(pa.array([0, len(words.dictionary)], pa.int32()), words.dictionary),
            ]
            n += 1
            yield pa.RecordBatch.from_arrays(columns, names=["b", "ids", "sizes", "codes", "words"])


def _decoded(batch: pa.Table, words: pa.Table, names: list[str]) -> pa.Table:
    """(id, texts) of a batch (b, ids, sizes, codes), with a text (of, u, text) per code."""
    one = batch.combine_chunks()
    ids, sizes = (one.column(k).chunk(0).flatten() for k in (1, 2))
    codes = np.frombuffer(one.column(3)[0].as_py(), np.int32)
    words = words.combine_chunks()
    place = np.full(words.num_rows + 1, words.num_rows, np.int64)  # the last is for null
    place[words.column(1).to_numpy()] = np.arange(words.num_rows)
    texts = pa.concat_arrays([*words.column(2).chunks, pa.nulls(1, words.schema.field(2).type)]).take(pa.array(place[codes]))
    offsets = np.append(0, np.cumsum(sizes.to_numpy())).astype(np.int32)
    return pa.table([ids, pa.ListArray.from_arrays(pa.array(offsets), texts)], names=names)


def vocabulary(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(term, idx): every distinct term and its place in sorted order, written."""
    terms = exploded(docs, F.array_distinct(tokens)).distinct()
    # Numbering reads its input several times, so the terms are written first.
    return materialise(dense_position(materialise(terms, "terms"), "term", "idx"), "vocabulary")


def encode_tokens(
    docs: DataFrame,
    vocab: DataFrame,
    tokens: str = "tokens",
    id_col: str = "id",
    length: int = MAX_TOKENS,
) -> DataFrame:
    """(id, input_ids, attention_mask), both of fixed ``length``.

    Ids come from a corpus word vocabulary, not from a word-piece file: start
    marker, at most ``length - 2`` words, end marker, then padding with mask 0.
    """
    room = length - 2
    placed = docs.select(
        id_col, F.posexplode_outer(F.slice(tokens, 1, room)).alias("pos", "term")
    )
    coded = lookup(placed, vocab, "term", id_col, how="left").select(
        id_col,
        F.when(
            F.col("pos").isNotNull(),
            F.struct("pos", F.coalesce(F.col("idx") + FIRST_WORD, F.lit(UNKNOWN)).alias("code")),
        ).alias("part"),
    )
    rows = coded.groupBy(id_col).agg(F.array_sort(F.collect_list("part")).alias("parts"))
    words = F.transform("parts", lambda part: part["code"].cast("int"))
    used = F.size("parts") + 2

    def filled(head: Column, fill: int) -> Column:
        return F.concat(head, F.array_repeat(F.lit(fill), length - used))

    return rows.select(
        id_col,
        filled(F.concat(F.array(F.lit(START)), words, F.array(F.lit(END))), PAD).alias("input_ids"),
        filled(F.array_repeat(F.lit(1), used), 0).alias("attention_mask"),
    )


#: Documents and tokens of a batch whose vectors are added up: more documents share a vector
#: that is moved, and a vector takes more than a code.
_POOL_DOCS, _POOL_TOKENS = 10_000, 4_000_000
#: Bytes of token vectors that are sent to every executor through the driver.
_JOINED = 64 << 20


def mean_pool(
    docs: DataFrame,
    vectors: DataFrame,
    tokens: str = "tokens",
    id_col: str = "id",
    vector: str = "vector",
    places: DataFrame | None = None,
) -> DataFrame:
    """(id, vector): mean of the vectors of a document's tokens.

    ``docs`` has (id, tokens), ``vectors`` has (term, vector) and should be a
    written table. If many terms share a vector, ``vectors`` has (place, vector) with whole
    numbers as places, and the written table ``places`` has (term, place).
    With a broadcast dictionary of vectors a document's tokens never leave
    their task, so its sums are complete before the one shuffle. Else documents are coded in
    batches, and a vector is moved once for all documents of a batch. Tokens without
    a vector are left out; a document with no other tokens gets a null vector.
    The token vectors are an input; no encoder runs here, and no marker tokens
    enter the mean.
    """
    width = vector_width(vectors.where(F.col(vector).isNotNull()), vector)
    row_bytes, limit = 64 + 8 * width, at_most(vectors, _JOINED)
    if places is None and fits_broadcast(vectors, row_bytes, limit):
        placed = docs.select(id_col, F.explode_outer(tokens).alias("term"))
        known = lookup(placed, vectors, "term", id_col, row_bytes=row_bytes, how="left", limit=limit)
        summed = sum_vectors(known, id_col, vector, None, width, total="_n")
        mean = F.transform(vector, lambda x: x / F.col("_n"))
        return summed.select(id_col, F.when(F.col("_n") > 0, mean).alias(vector))

    docs = docs.select(id_col, tokens)
    ids = docs.schema[id_col]
    coded_schema = T.StructType([T.StructField("b", T.LongType()), T.StructField("ids", T.ArrayType(ids.dataType)), *_CODED])

    def coded_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _coded(cut(batches, 1, _POOL_DOCS, _POOL_TOKENS), _POOL_DOCS)

    coded = materialise(docs.mapInArrow(coded_docs, coded_schema), "coded")
    parts = coded.select(F.col("b").alias("of"), F.posexplode("words").alias("u", "term")).where("term IS NOT NULL")
    given = vectors.where(F.col(vector).isNotNull()).withColumnRenamed(vector, "v")
    if places is None:
        found = lookup(parts, given, "term", "of", row_bytes, limit=limit).select("of", "u", F.col("u").cast("long").alias("place"), "v")
    else:
        at = F.col("place").cast("long").alias("place")
        own = materialise(lookup(parts, places.select("term", at), "term", "of").select("of", "u", "place"), "places")
        wanted = lookup(own.select("of", "place").distinct(), given.select(at, "v"), "place", "of", row_bytes)
        found = wanted.select("of", F.lit(-1).alias("u"), "place", "v").unionByName(own, allowMissingColumns=True)

    def pooled(batch: pa.Table, found: pa.Table) -> pa.Table:
        return _pooled(batch, found, width, [id_col, "sums"])

    schema = T.StructType([ids, T.StructField("sums", T.ArrayType(T.DoubleType()))])
    summed = coded.drop("words").groupBy("b").cogroup(found.groupBy("of")).applyInArrow(pooled, schema)
    if docs.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        summed = sum_vectors(summed, id_col, "sums", None, width + 1)
    n = F.get("sums", F.lit(width))
    mean = F.transform(F.slice("sums", 1, width), lambda x: x / n)
    return summed.select(id_col, F.when(n > 0, mean).alias(vector))


_SUM_ROWS = 65_536


def _pooled(batch: pa.Table, found: pa.Table, width: int, names: list[str]) -> pa.Table:
    """(id, sums) of a batch (b, ids, sizes, codes): the sums of the vectors, and their number
    behind them. ``found`` has (of, u, place, v): the place of a code, the vector of a place."""
    one, found = batch.combine_chunks(), found.combine_chunks()
    ids, sizes = (one.column(k).chunk(0).flatten() for k in (1, 2))
    codes = np.frombuffer(one.column(3)[0].as_py(), np.int32)
    u, place = (found.column(k).to_numpy() for k in (1, 2))
    held = found.filter(found.column(3).is_valid())
    # A row of the table for each place; the vectors of a repeated place are added up.
    known, row = np.unique(held.column(2).to_numpy(), return_inverse=True)
    table = np.zeros((len(known) + 1, width + 1))
    if len(known):
        lists = pa.concat_arrays(held.column(3).chunks)
        lengths = lists.value_lengths().to_numpy()
        values = pc.fill_null(lists.flatten(), 0).to_numpy(zero_copy_only=False).astype(np.float64)
        if (lengths == width).all():
            whole = values.reshape(-1, width)
        else:  # shorter ones end in zeros
            whole = np.zeros((len(lengths), width))
            column = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            whole[np.repeat(np.arange(len(lengths)), lengths)[column < width], column[column < width]] = values[column < width]
        if len(known) == len(row):
            table[row, :width], table[row, width] = whole, 1
        else:
            np.add.at(table, row, np.column_stack([whole, np.ones(len(row))]))
    # Codes to rows; the last row, of zeros, is for codes without a vector, null among them.
    rows = np.full(max(codes.max(initial=0), u.max(initial=0)) + 2, len(known), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, place[u >= 0]), len(known) - 1)
        rows[u[u >= 0]] = np.where(known[at] == place[u >= 0], at, len(known))
    sums = np.zeros((len(ids), width + 1))
    doc = np.repeat(np.arange(len(ids)), sizes.to_numpy())
    for at in range(0, len(codes), _SUM_ROWS):
        part = doc[at : at + _SUM_ROWS]
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        sums[part[starts]] += np.add.reduceat(table[rows[codes[at : at + _SUM_ROWS]]], starts)
    offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * (width + 1))
    return pa.table([ids, pa.ListArray.from_arrays(offsets, pa.array(sums.ravel()))], names=names)
