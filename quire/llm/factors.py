"""Substring dedup by factoring documents against a reference of earlier documents.

This replaces a relative Lempel-Ziv parse: no document is read left to right and no
longest match is extended, since that would need the whole reference at hand in
every task. Every document is cut into content-defined blocks (``blocks``). Equal
blocks are joined by their digest; where blocks of one anchor differ, every window
of all blocks of that anchor is joined by its hash. A factor is just a stretch of
words that such windows cover, without a source.

Words inside a window that also starts in a document with a smaller id are
removed; windows are judged on the input. Blocks of equal content are worked on
once, and equal ones are reduced to a minimum before the shuffle, so a group of
copies with a third of all rows costs no more than other rows.

Defined cases: a null or empty text has no words; texts with fewer words than a
window keep all; a null id sorts after all others and is nobody's source; rows
that repeat both id and text are one document and give one row, and rows that
share an id are not each other's source; an empty table gives an empty one;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import blocks
from quire.llm.blocks import KEY
from quire.session import materialise

LENGTH, GRAM = 50, 8
_BLOCK = ["d1", "d2"]


def _earlier(source: str, own: str) -> F.Column:
    return F.col(source).isNotNull() & (F.col(own).isNull() | (F.col(source) < F.col(own)))


def _windows(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(w1, w2, d1, d2, source, at): every window of the wanted blocks.

    ``wanted`` has one occurrence (id, print, first, n) of each block to open.
    """
    per_doc = materialise(
        wanted.groupBy(*KEY).agg(F.collect_list(F.struct("d1", "d2", "first", "n")).alias("open")),
        "open-blocks",
    )
    holding, _ = blocks.with_keys(docs, per_doc.select(*KEY))
    named = per_doc.withColumnsRenamed({"id": "_id", "print": "_print"})
    same = (F.col("print") == F.col("_print")) & F.col("id").eqNullSafe(F.col("_id"))
    rows = holding.join(named, same).select("id", "text", "open")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = blocks.Words(batch.column(1)[i].as_py().encode())
                opened = batch.column(2)[i].as_py()
                sizes = [b["n"] for b in opened]
                at = np.concatenate([np.arange(n) for n in sizes])
                places = at + np.repeat([b["first"] for b in opened], sizes)
                w = blocks.digests(words.joined, words.starts[places], words.ends[places + length - 1])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, 1).take(pa.array(np.zeros(at.size, np.int64))),
                        pa.array(w[:, 0].copy()),
                        pa.array(w[:, 1].copy()),
                        pa.array(np.repeat(np.array([b["d1"] for b in opened], np.int64), sizes)),
                        pa.array(np.repeat(np.array([b["d2"] for b in opened], np.int64), sizes)),
                        pa.array(at.astype(np.int32)),
                    ],
                    names=["source", "w1", "w2", "d1", "d2", "at"],
                )

    schema = f"source {blocks.id_type(docs)}, w1 long, w2 long, d1 long, d2 long, at int"
    return rows.mapInArrow(run, schema)


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, print, spans): the stretches (first word, words, source id) of each document
    that earlier documents have; ``docs`` as ``blocks.documents`` gives them."""
    live = materialise(blocks.found_again(blocks.occurrences(docs, length, gram, True)), "live-blocks")
    reference = materialise(
        live.groupBy(*_BLOCK).agg(F.min("id").alias("source"), F.max("mixed").alias("mixed")), "reference"
    )
    # The earliest occurrence of each block whose anchor has other blocks as well.
    earliest = (
        live.where("mixed")
        .join(reference.select(*_BLOCK, "source"), _BLOCK)
        .where(F.col("id").eqNullSafe(F.col("source")))
        .groupBy(*_BLOCK)
        .agg(F.min(F.struct("id", "print", "first", "n")).alias("o"))
        .select(*_BLOCK, "o.*")
    )
    windows = _windows(docs, earliest, length)
    # Only windows of several blocks; written, so that a window which very many blocks
    # share can be split in the join that follows.
    first_seen = materialise(
        windows.groupBy("w1", "w2")
        .agg(F.min("source").alias("origin"), F.count("*").alias("c"))
        .where("c > 1")
        .select("w1", "w2", "origin"),
        "shared-windows",
    )
    borders = (
        windows.join(first_seen, ["w1", "w2"])
        .where(_earlier("origin", "source"))
        .groupBy(*_BLOCK)
        .agg(F.collect_list(F.struct("at", "origin")).alias("parts"))
    )
    verdict = reference.join(borders, _BLOCK, "left").select(*_BLOCK, "source", "parts")
    whole = F.array(F.struct(F.col("first"), (F.col("n") + length - 1).alias("words"), F.col("source")))
    parts = F.transform(
        F.coalesce("parts", F.expr("cast(array() as " + borders.schema["parts"].dataType.simpleString() + ")")),
        lambda x: F.struct(
            (F.col("first") + x["at"]).alias("first"), F.lit(length).alias("words"), x["origin"].alias("source")
        ),
    )
    return (
        live.select(*KEY, *_BLOCK, "first", "n")
        .join(verdict, _BLOCK)
        .select(
            *KEY,
            F.when(_earlier("source", "id"), whole).otherwise(parts).alias("found"),
        )
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
    keep_text: bool = True,
) -> DataFrame:
    """Per document: id, words, removed words, digest of what is kept, the factors as
    (first word, words), and the kept text itself if asked for."""
    own = blocks.documents(docs, id_col, text_col)
    found = materialise(spans(own, length, gram), "spans")
    touched, others = blocks.with_keys(own, found.select(*KEY))
    named = found.withColumnsRenamed({"id": "_id", "print": "_print"})
    same = (F.col("print") == F.col("_print")) & F.col("id").eqNullSafe(F.col("_id"))
    none = F.lit(None).cast(found.schema["spans"].dataType).alias("spans")
    keep = "string" if keep_text else None
    schema = (
        f"`{id_col}` {blocks.id_type(own)}, print long, n_words long, n_removed long, kept_sha256 string, "
        "factors array<struct<first:int,words:int>>" + (", kept_text string" if keep else "")
    )

    pair = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, prints, factors, texts = [], [], [], [], []
            for text, found in zip(batch.column(2), batch.column(3), strict=True):
                words = (text.as_py() or "").encode().split()
                gone = blocks.stretches(len(words), found)
                n_words.append(len(words))
                n_removed.append(sum(b - a for a, b in gone))
                for a, b in reversed(gone):
                    del words[a:b]
                kept = b" ".join(words)
                prints.append(hashlib.sha256(kept).hexdigest())
                factors.append([{"first": a, "words": b - a} for a, b in gone])
                if keep:
                    texts.append(kept.decode())
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array(n_words, pa.int64()),
                pa.array(n_removed, pa.int64()),
                pa.array(prints, pa.string()),
                pa.array(factors, pair),
            ]
            names = [id_col, "print", "n_words", "n_removed", "kept_sha256", "factors"]
            if keep:
                columns.append(pa.array(texts, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    cut_up = touched.join(named, same).select(*KEY, "text", "spans").mapInArrow(run, schema)
    as_is = others.select(*KEY, "text", none).mapInArrow(run, schema)
    # Rows that repeat id and text are one document.
    return (
        cut_up.unionByName(as_is)
        .groupBy(id_col, "print")
        .agg(*[F.first(c).alias(c) for c in cut_up.columns if c not in (id_col, "print")])
        .drop("print")
    )
