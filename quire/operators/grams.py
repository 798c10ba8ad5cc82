"""N-grams of batches of documents: counted, and found again, batch by batch.

A batch of documents has its distinct tokens once, as numbers, and n-grams are runs of
numbers. Only distinct n-grams of a batch become text and leave the task. Which of them are
worth that is told by a set of bits, which may say yes too often; terms themselves are
always joined and counted as texts.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.lookup import lookup
from quire.session import materialise

# The helpers below travel to the workers with the tasks that call them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bits per term, and bits at most (16 MB): beyond that more other terms pass, none is lost.
BITS_PER_TERM, MOST_BITS = 16, 1 << 27
#: A batch ends at so many documents or tokens (or has one document).
BATCH_DOCS, BATCH_TOKENS = 2_500, 750_000
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Bits:
    """A set of hashes, sent to every task."""

    held: Broadcast
    shift: int

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        """True for every hash of the set, and for few others."""
        place = _places(hashes, self.shift)
        return (self.held.value[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _places(hashes: np.ndarray, shift: int) -> np.ndarray:
    return ((hashes ^ (hashes >> np.uint64(32))) * _MIX) >> np.uint64(shift)


def bits_of(terms: DataFrame, column: str = "term") -> Bits:
    """The terms of a written table, by one hash each."""
    wanted = max(1024, terms.count() * BITS_PER_TERM)
    size = min(MOST_BITS, 1 << (wanted - 1).bit_length())
    shift = 64 - (size.bit_length() - 1)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.unique(_places(_hashed(batch.column(0))[0], shift)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place >> 6), pa.array((place & 63).astype(np.int32))], names=["w", "b"])

    bits = F.expr("bit_or(shiftleft(1L, b))").alias("bits")
    words = terms.select(column).mapInArrow(placed, "w long, b int").groupBy("w").agg(bits)
    held = np.zeros(size // 64, np.uint64)
    found = words.toArrow()  # at most MOST_BITS / 64 rows of two numbers
    held[found.column("w").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return Bits(terms.sparkSession.sparkContext.broadcast(held), shift)


def _hashed(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every text, and by what a hash is multiplied when the text follows: the
    hash of a text follows from those of its parts, however it is cut into them."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    lengths = np.diff(offsets)
    power = np.ones(int(lengths.max(initial=0)) + 1, np.uint64)
    np.multiply.accumulate(np.full(len(power) - 1, _BASE), out=power[1:])
    if not offsets[-1] - offsets[0]:
        return np.zeros(len(words), np.uint64), power[lengths]
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
    behind = np.repeat(offsets[1:] - offsets[0], lengths) - np.arange(len(data)) - 1
    total = np.append(np.uint64(0), np.cumsum(data * power[behind], dtype=np.uint64))
    offsets = offsets - offsets[0]
    return total[offsets[1:]] - total[offsets[:-1]], power[lengths]


class _Batch:
    """The tokens of some documents as numbers, one document after the other (-1: null)."""

    def __init__(self, lists: pa.ListArray):
        coded = lists.flatten().dictionary_encode()
        self.words = coded.dictionary
        self.codes = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        self.docs = np.repeat(np.arange(len(lists)), sizes)

    def runs(self, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, whether the n tokens from each place on are an n-gram, its hash) for n up to
        ``most``. Null tokens are in none."""
        if not len(self.words):
            none = np.zeros(0, np.uint64)
            yield from ((n, none == 1, none) for n in range(1, most + 1))
            return
        value, power = _hashed(self.words)
        inside, hashes = self.codes >= 0, value[self.codes]
        yield 1, inside, hashes
        for n in range(2, most + 1):
            last = self.codes[n - 1 :]
            inside = inside[:-1] & (last >= 0) & (self.docs[: len(last)] == self.docs[n - 1 :])
            hashes = (hashes[:-1] * _BASE + np.uint64(32)) * power[last] + value[last]
            yield n, inside, hashes

    def named(self, places: np.ndarray, n: int) -> tuple[np.ndarray, pa.Array]:
        """A number for each n-gram from ``places`` on, and the texts by number."""
        code = self.codes[places]
        for j in range(1, n):
            code = np.unique(code * len(self.words) + self.codes[places + j], return_inverse=True)[1]
        _, first, code = np.unique(code, return_index=True, return_inverse=True)
        parts = [self.words.take(pa.array(self.codes[places[first] + j])) for j in range(n)]
        return code, pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]


def _joined(parts: list[tuple[np.ndarray, np.ndarray, pa.Array]]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(document * number of texts + text, its occurrences, texts) of parts (document, number,
    texts), ascending; a document has a text once, also if its tokens hold blanks."""
    starts = np.cumsum([0, *[len(texts) for *_, texts in parts]])
    coded = pa.concat_arrays([texts for *_, texts in parts]).dictionary_encode()
    code = np.concatenate([c + s for (_, c, _), s in zip(parts, starts)])
    code = coded.indices.to_numpy()[code].astype(np.int64)
    many = max(1, len(coded.dictionary))
    pairs, times = np.unique(np.concatenate([d for d, *_ in parts]) * many + code, return_counts=True)
    return pairs, times, coded.dictionary


def _packed(values: np.ndarray) -> pa.Array:
    """Numbers below 2^63 as one value, all lowest bytes first and so on, which compresses well."""
    return pa.array([np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()], pa.binary())


def _unpacked(value: pa.Scalar) -> np.ndarray:
    planes = np.frombuffer(value.as_buffer(), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def cut(
    batches: Iterator[pa.RecordBatch], tokens: int, most_docs: int | None = None, most_tokens: int | None = None
) -> Iterator[pa.RecordBatch]:
    """The rows in batches of bounded size; ``tokens`` is the place of the lists."""
    most_docs, most_tokens = most_docs or BATCH_DOCS, most_tokens or BATCH_TOKENS
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(tokens)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            end = int(np.searchsorted(ends, before + most_tokens, "right"))
            end = min(max(end, at + 1), at + most_docs)
            yield batch.slice(at, end - at)
            at = end


def gram_frequencies(docs: DataFrame, tokens: str, n: int, shorter: Bits) -> DataFrame:
    """(term, df) of the n-grams whose first and last n - 1 tokens may be in ``shorter``."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in cut(batches, 0):
            batch = _Batch(part.column(0))
            for size, inside, hashes in batch.runs(n):
                if size == n - 1:
                    fits = inside & shorter.may_hold(hashes)
            places = np.flatnonzero(inside & fits[:-1][: len(inside)] & fits[1:])
            if len(places):
                pairs, _, texts = _joined([(batch.docs[places], *batch.named(places, n))])
                df = np.bincount(pairs % len(texts), minlength=len(texts))
                yield pa.RecordBatch.from_arrays([texts, pa.array(df.astype(np.int64))], names=["term", "df"])
                del pairs, texts, df
            del batch, fits, inside, hashes, places
            _give_back()

    return docs.select(tokens).mapInArrow(counted, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def weigh(docs: DataFrame, terms: DataFrame, tokens: str, id_col: str, sizes: tuple[int, int]) -> DataFrame:
    """(id, term, idx, tfidf) of the n-grams of ``docs`` that are in the written table
    ``terms`` (term, idx, idf), with length 1 per id.

    Batches are written with the numbers of their n-grams. Distinct n-grams of a batch are
    looked up and come back to it, and its rows are made where it is: a row for each
    document and term is neither moved nor sorted.
    """
    low, high = sizes
    docs = docs.select(id_col, tokens)
    ids = docs.schema[id_col]
    if docs.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        # The rows of an id are one document. Null stands between them, so that no n-gram is on both sides.
        parted = F.concat(F.coalesce(tokens, F.array().cast("array<string>")), F.array(F.lit(None).cast("string")))
        docs = docs.groupBy(id_col).agg(F.flatten(F.collect_list(parted)).alias(tokens))
    known = bits_of(terms)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, n_batch = TaskContext.get().partitionId() << 32, 0
        for part in cut(batches, 1):
            batch, found = _Batch(part.column(1)), []
            for n, inside, hashes in batch.runs(high):
                if n >= low:
                    places = np.flatnonzero(inside)
                    places = places[known.may_hold(hashes[places])]
                    found.append((batch.docs[places], *batch.named(places, n)))
            pairs, times, texts = _joined(found)
            columns = [
                pa.array([place + n_batch]),
                _one_list(part.column(0)),
                pa.array([len(texts)], pa.int64()),
                _packed(np.diff(pairs, prepend=0)),
                _packed(times),
                _one_list(texts),
            ]
            n_batch += 1
            yield pa.RecordBatch.from_arrays(columns, names=["b", "ids", "many", "steps", "times", "words"])
            del batch, found, pairs, times, texts, columns
            _give_back()

    schema = T.StructType(
        [
            T.StructField("b", T.LongType()),
            T.StructField("ids", T.ArrayType(ids.dataType)),
            T.StructField("many", T.LongType()),
            T.StructField("steps", T.BinaryType()),
            T.StructField("times", T.BinaryType()),
            T.StructField("words", T.ArrayType(T.StringType())),
        ]
    )
    written = materialise(docs.mapInArrow(coded, schema), "grams")
    parts = written.select(F.col("b").alias("of"), F.posexplode("words").alias("u", "term"))
    found = lookup(parts, terms.select("term", "idx", "idf"), "term", "of").select("of", "u", "term", "idx", "idf")

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for part in batches:
            ends = np.flatnonzero(part.column(1).is_valid().to_numpy(zero_copy_only=False))
            start = 0
            for end in ends.tolist():  # a batch of documents, behind its terms
                held.append(part.slice(start, end - start).select(_FOUND))
                one = part.slice(end, 1)
                yield from _weighed(one, pa.Table.from_batches(held), [id_col, "term", "idx", "tfidf"])
                held, start = [], end + 1
                _give_back()
            # A copy, or the few rows would keep the whole batch.
            held.append(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in part.slice(start).select(_FOUND).columns], names=_FOUND))

    result = T.StructType(
        [
            ids,
            T.StructField("term", T.StringType()),
            T.StructField("idx", terms.schema["idx"].dataType),
            T.StructField("tfidf", T.DoubleType()),
        ]
    )
    # A batch and its terms meet in one task, the terms first; its rows leave it in pieces.
    heads = written.select("b", "ids", "many", "steps", "times")
    dealt = heads.unionByName(found.withColumnRenamed("of", "b"), allowMissingColumns=True).repartition("b")
    placed = dealt.sortWithinPartitions("b", F.col("ids").isNotNull())
    return placed.select("b", "ids", "many", "steps", "times", *_FOUND).mapInArrow(weighed, result)


def _one_list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


#: Columns of a batch's terms; rows that are handed on at once.
_FOUND = ["u", "term", "idx", "idf"]
_ROWS = 65_536


def _give_back() -> None:
    """Hand freed memory back to the system: workers live on between batches and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _weighed(one: pa.RecordBatch, found: pa.Table, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of one batch (b, ids, many, steps, times), with its terms (u, term, idx, idf)."""
    found = found.combine_chunks()
    ids, many = one.column(1).flatten(), one.column(2)[0].as_py()
    pairs, times = np.cumsum(_unpacked(one.column(3)[0])), _unpacked(one.column(4)[0])
    if not len(pairs) or not found.num_rows:
        return
    place = np.full(many, -1, np.int32)
    place[found.column(0).to_numpy()] = np.arange(found.num_rows, dtype=np.int32)
    row = place[pairs % many]
    kept = row >= 0
    doc, row, raw = (pairs[kept] // many).astype(np.int32), row[kept], times[kept].astype(np.float64)
    del pairs, times, kept, place
    raw *= found.column(3).to_numpy()[row]
    length = np.sqrt(np.bincount(doc, raw * raw, len(ids)))
    term, idx = (found.column(k).combine_chunks() for k in (1, 2))
    for at in range(0, len(row), _ROWS):
        here, own = pa.array(row[at : at + _ROWS]), doc[at : at + _ROWS]
        columns = [ids.take(pa.array(own)), term.take(here), idx.take(here), pa.array(raw[at : at + _ROWS] / length[own])]
        yield pa.RecordBatch.from_arrays(columns, names=names)
