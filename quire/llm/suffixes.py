"""Suffix-array dedup: byte strings that start at two places anywhere.

Two places hold the same ``length`` bytes exactly if they are neighbours in the
sorted order of suffixes up to equal ones. The order is made without one machine
seeing all suffixes:

1. Texts are cut into content-defined blocks of consecutive suffixes
   (``blocks``). A block that occurs twice settles all its suffixes at once; a
   block whose anchor occurs once has no equal suffix. What is left are blocks
   that differ near a common anchor, one of each kind.
2. The suffixes of these go through a sort: sampled splitters range-partition
   them by their leading bytes (as one number, then by a digest of the whole
   ``length`` bytes, then by place, so that even a long run of equal suffixes is
   spread), each partition sorts its own in memory-bounded fashion, and neighbours
   are compared.
3. Runs of equal suffixes may cross partition borders: the first and last key of
   every partition are compared across them.

Every byte covered by such a string is removed; strings are judged on the input.

Defined cases: a null or empty text has no bytes; texts shorter than ``length``
keep all; rows that repeat both id and text are two places with the same bytes
(so they lose them) and give one row; a null id is an id like any other; an empty
table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import blocks
from quire.llm.blocks import KEY
from quire.session import materialise

LENGTH, GRAM = 400, 200
LEAD = 8
_BLOCK = ["d1", "d2"]
short_digest = xxhash.xxh3_64_intdigest


def _suffixes(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(lead, print, block, at): leading bytes and digest of every suffix of the blocks.

    ``wanted`` has one occurrence (id, print, first, n) of each block, and its number.
    """
    per_doc = materialise(
        wanted.groupBy(*KEY).agg(F.collect_list(F.struct("block", "first", "n")).alias("open")),
        "open-suffixes",
    )
    holding, _ = blocks.with_keys(docs, per_doc.select(*KEY))
    named = per_doc.withColumnsRenamed({"id": "_id", "print": "_print"})
    same = (F.col("print") == F.col("_print")) & F.col("id").eqNullSafe(F.col("_id"))
    rows = holding.join(named, same).select("text", "open")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, opened = batch.column(0)[i].as_py().encode(), batch.column(1)[i].as_py()
                sizes = [b["n"] for b in opened]
                at = np.concatenate([np.arange(n) for n in sizes])
                places = at + np.repeat([b["first"] for b in opened], sizes)
                view = memoryview(data)
                prints = [short_digest(view[p : p + length]) for p in places.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(blocks.leading(np.frombuffer(data, np.uint8), LEAD)[places]),
                        pa.array(np.array(prints, np.uint64).view(np.int64)),
                        pa.array(np.repeat(np.array([b["block"] for b in opened], np.int64), sizes)),
                        pa.array(at.astype(np.int32)),
                    ],
                    names=["lead", "w", "block", "at"],
                )

    return rows.mapInArrow(run, "lead long, w long, block long, at int")


def _equal_neighbours(suffixes: DataFrame, partitions: int) -> DataFrame:
    """(block, at) of the suffixes equal to another one."""
    order = ["lead", "w", "block", "at"]
    ranged = suffixes.repartitionByRange(partitions, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Suffixes equal to a neighbour; and the first and the last suffix of the
        partition (``edge``), which may equal those of the partitions beside it.
        The last row so far waits for the row after it."""

        def out(c: list[np.ndarray], edge: bool) -> pa.RecordBatch:
            flags = np.full(c[0].size, edge)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (*c, flags)], names=[*order, "edge"])

        waiting: list[np.ndarray] | None = None
        equals_before = False
        for batch in batches:
            c = [batch.column(k).to_numpy() for k in range(4)]
            if not c[0].size:
                continue
            if waiting is None:
                yield out([x[:1] for x in c], True)
            else:
                c = [np.concatenate(x) for x in zip(waiting, c, strict=True)]
            # The same place twice (a repeated row of the table) is no equal neighbour.
            equal = (c[0][1:] == c[0][:-1]) & (c[1][1:] == c[1][:-1])
            equal &= (c[2][1:] != c[2][:-1]) | (c[3][1:] != c[3][:-1])
            before = np.concatenate(([equals_before], equal))
            again = before[:-1] | equal
            yield out([x[:-1][again] for x in c], False)
            waiting, equals_before = [x[-1:] for x in c], bool(before[-1])
        if waiting is not None:
            if equals_before:
                yield out(waiting, False)
            yield out(waiting, True)

    found = materialise(
        ranged.mapInArrow(run, "lead long, w long, block long, at int, edge boolean"), "equal-suffixes"
    )
    edges = found.where("edge")
    crossing = (
        edges.groupBy("lead", "w")
        .agg(F.min("block").alias("b1"), F.max("block").alias("b2"), F.min("at").alias("a1"), F.max("at").alias("a2"))
        .where((F.col("b1") != F.col("b2")) | (F.col("a1") != F.col("a2")))
        .select("lead", "w")
    )
    return (
        found.where("not edge")
        .select("block", "at")
        .unionByName(edges.join(crossing, ["lead", "w"], "left_semi").select("block", "at"))
    )


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, print, spans): the stretches (first byte, bytes) that occur elsewhere too."""
    spark = docs.sparkSession
    live = materialise(blocks.found_again(blocks.occurrences(docs, length, gram, False)), "live-blocks")
    kinds = materialise(
        live.groupBy(*_BLOCK).agg(F.count("*").alias("c"), F.max("mixed").alias("mixed")), "block-kinds"
    )
    # One occurrence stands for all of a kind; its number is unique in the written table.
    one = materialise(
        live.where("mixed")
        .groupBy(*_BLOCK)
        .agg(F.min(F.struct("id", "print", "first", "n")).alias("o"))
        .select(*_BLOCK, "o.*"),
        "one-of-each",
    )
    numbered = materialise(one.withColumn("block", F.monotonically_increasing_id()), "numbered")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    suffixes = materialise(_suffixes(docs, numbered, length), "suffixes")
    equal = (
        _equal_neighbours(suffixes, partitions)
        .groupBy("block")
        .agg(F.sort_array(F.collect_set("at")).alias("parts"))
    )
    verdict = kinds.select(*_BLOCK, (F.col("c") > 1).alias("again")).join(
        numbered.select(*_BLOCK, "block").join(equal, "block").select(*_BLOCK, "parts"), _BLOCK, "left"
    )
    whole = F.array(F.struct("first", (F.col("n") + length - 1).alias("bytes")))
    parts = F.transform(
        F.coalesce("parts", F.array().cast("array<int>")),
        lambda at: F.struct((F.col("first") + at).alias("first"), F.lit(length).alias("bytes")),
    )
    return (
        live.select(*KEY, *_BLOCK, "first", "n")
        .join(verdict, _BLOCK)
        .select(*KEY, F.when(F.col("again"), whole).otherwise(parts).alias("found"))
        .where(F.size("found") > 0)
        .groupBy(*KEY)
        .agg(F.flatten(F.collect_list("found")).alias("spans"))
    )


def dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    keep_bytes: bool = True,
) -> DataFrame:
    """Per document: id, bytes, removed bytes, removed runs and their number, digest of
    the remaining bytes, and these bytes themselves if asked for."""
    own = blocks.documents(docs, id_col, text_col)
    found = materialise(spans(own, length, gram), "spans")
    touched, others = blocks.with_keys(own, found.select(*KEY))
    named = found.withColumnsRenamed({"id": "_id", "print": "_print"})
    same = (F.col("print") == F.col("_print")) & F.col("id").eqNullSafe(F.col("_id"))
    schema = (
        f"`{id_col}` {blocks.id_type(own)}, print long, n_bytes long, n_removed long, n_spans long, "
        "kept_sha256 string, runs array<struct<start:int,end:int>>" + (", kept binary" if keep_bytes else "")
    )

    pair = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, prints, cuts, left = [], [], [], [], []
            for text, found in zip(batch.column(2), batch.column(3), strict=True):
                data = (text.as_py() or "").encode()
                gone = blocks.stretches(len(data), found)
                kept, at = [], 0
                for start, end in [*gone, (len(data), len(data))]:
                    kept.append(data[at:start])
                    at = end
                rest = b"".join(kept)
                n_bytes.append(len(data))
                n_removed.append(len(data) - len(rest))
                prints.append(hashlib.sha256(rest).hexdigest())
                cuts.append([{"start": a, "end": b} for a, b in gone])
                if keep_bytes:
                    left.append(rest)
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array(n_bytes, pa.int64()),
                pa.array(n_removed, pa.int64()),
                pa.array(list(map(len, cuts)), pa.int64()),
                pa.array(prints, pa.string()),
                pa.array(cuts, pair),
            ]
            names = [id_col, "print", "n_bytes", "n_removed", "n_spans", "kept_sha256", "runs"]
            if keep_bytes:
                columns.append(pa.array(left, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    none = F.lit(None).cast(found.schema["spans"].dataType).alias("spans")
    cut_up = touched.join(named, same).select(*KEY, "text", "spans").mapInArrow(run, schema)
    as_is = others.select(*KEY, "text", none).mapInArrow(run, schema)
    return (
        cut_up.unionByName(as_is)
        .groupBy(id_col, "print")
        .agg(*[F.first(c).alias(c) for c in cut_up.columns if c not in (id_col, "print")])
        .drop("print")
    )
