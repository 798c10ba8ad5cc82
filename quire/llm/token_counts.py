"""Token counts of texts without their ids.

A byte-level BPE works on each pre-token by itself, so its number of tokens is a
property of the pre-token. Every distinct pre-token of the corpus is given to the
library once; a document's count is the sum over its pre-token frequencies.

1. Count pre-tokens per task, add up per pre-token, ask the library for each one.
2. Per document, the most frequent pre-tokens are summed on the spot from a head
   of the dictionary, whose size has a fixed bound (``HEAD`` entries of at most
   ``HEAD_BYTES`` bytes) and which every task gets. All other pre-tokens of the
   document are joined to the dictionary by a shuffle, however many there are.

Defined cases: a null text is an empty one (0 bytes, 0 tokens); a null id is an id
like any other; rows that repeat both id and text are one document and give one
row, rows that share only the id give one each; an empty table gives an empty
one; other columns are not read.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
import tokenizers
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import materialise

#: Bound of the dictionary's head that is sent to every task.
HEAD, HEAD_BYTES = 1 << 18, 64
#: A task hands on its counts when it holds so many different pre-tokens.
FLUSH = 200_000
#: Up to here the library's splitting and ``regex`` know the same letters and digits
#: (tested); a text with other characters is split by the library.
_BEYOND = regex.compile("[^\x00-ӿ]")


class Splitter:
    """Pre-tokens of a text as the tokenizer file makes them."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        if self.tokenizer.normalizer is not None:
            raise ValueError("a tokenizer that rewrites its text is not counted by pre-tokens")
        self.find = regex.compile(pattern).findall
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len)
        self.special = regex.compile("|".join(map(regex.escape, reversed(added)))) if added else None

    def __call__(self, text: str) -> tuple[int, list[str]]:
        """How many special tokens stand in the text; the pre-tokens between them."""
        if self.special is None or not self.special.search(text):
            return 0, self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1, [piece for part in parts for piece in self._plain(part)]

    def _plain(self, text: str) -> list[str]:
        if _BEYOND.search(text):
            found = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
            return [text[a:b] for _, (a, b) in found]
        return self.find(text)

    def sizes(self, pieces: list[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]


_splitters: dict[tuple[str, str], Splitter] = {}


def _splitter(path: str, pattern: str) -> Splitter:
    """One per Python worker and tokenizer file."""
    if (path, pattern) not in _splitters:
        _splitters[path, pattern] = Splitter(path, pattern)
    return _splitters[path, pattern]


def _per_task(path: str, pattern: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = _splitter(path, pattern), Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
                names=["piece", "n"],
            )

        for batch in batches:
            for value in batch.column(0):
                seen.update(split(value.as_py() or "")[1])
                if len(seen) > FLUSH:
                    yield flush()
                    seen.clear()
        yield flush()

    return run


def dictionary(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Every distinct pre-token with its frequency and its number of tokens."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = _splitter(path, pattern)
        for batch in batches:
            sizes = split.sizes(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sizes, pa.int32())], names=["piece", "n", "tokens"]
            )

    return (
        docs.select(F.col(text_col).cast("string"))
        .mapInArrow(_per_task(path, pattern), "piece string, n long")
        .groupBy("piece")
        .agg(F.sum("n").alias("n"))
        .mapInArrow(ask, "piece string, n long, tokens int")
    )


def _cutoff(pieces: DataFrame) -> int:
    """The smallest frequency, to an eighth of a power of two, that at most HEAD pieces reach.

    Frequencies are counted by class first, so no task sees more than a row per class.
    """
    steps = F.floor(F.log2("n") * 8).cast("int")
    found = pieces.groupBy(steps.alias("step")).agg(F.count("*").alias("c"), F.min("n").alias("low")).collect()
    total, low = 0, 1 << 62
    for row in sorted(found, key=lambda r: -r.step):
        total += row.c
        if total > HEAD:
            break
        low = row.low
    return low


def count_tokens(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: id, bytes of the text, tokens of the text."""
    spark = docs.sparkSession
    known = materialise(dictionary(docs, path, pattern, text_col), "pieces")
    short = known.where(F.octet_length("piece") <= HEAD_BYTES)
    head = short.where(F.col("n") >= _cutoff(short)).select("piece", "tokens").toArrow()
    table = dict(zip(head["piece"].to_pylist(), head["tokens"].to_pylist(), strict=True))
    shared = spark.sparkContext.broadcast(table)

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = own.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, tokens_of = _splitter(path, pattern), shared.value.get
        for batch in batches:
            prints, sizes, sums, rest, counts = [], [], [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                data = text.encode()
                total, pieces = split(text)
                left = []
                for piece, n in Counter(pieces).items():
                    tokens = tokens_of(piece)
                    if tokens is None:
                        left.append((piece, n))
                    else:
                        total += n * tokens
                prints.append(xxhash.xxh3_64_intdigest(data) - (1 << 63))
                sizes.append(len(data))
                sums.append(total)
                rest.append([p for p, _ in left])
                counts.append([n for _, n in left])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(prints, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(sums, pa.int64()),
                    pa.array(rest, pa.list_(pa.string())),
                    pa.array(counts, pa.list_(pa.int32())),
                ],
                names=["id", "print", "n_bytes", "tokens", "rest", "counts"],
            )

    per_doc = materialise(
        own.mapInArrow(
            run,
            f"id {id_type}, print long, n_bytes long, tokens long, "
            "rest array<string>, counts array<int>",
        ),
        "frequencies",
    )
    rare = (
        per_doc.select("id", "print", F.explode(F.arrays_zip("rest", "counts")).alias("x"))
        .select("id", "print", F.col("x.rest").alias("piece"), F.col("x.counts").alias("k"))
        .join(known.select("piece", F.col("tokens").alias("each")), "piece")
        .groupBy("id", "print")
        .agg(F.sum(F.col("k") * F.col("each")).alias("tokens"))
    )
    # Rows that repeat a document add up to a multiple of its count.
    return (
        per_doc.select("id", "print", "n_bytes", "tokens", F.lit(1).alias("copies"))
        .unionByName(
            rare.select("id", "print", F.lit(0).cast("long").alias("n_bytes"), "tokens", F.lit(0).alias("copies"))
        )
        .groupBy("id", "print")
        .agg(
            F.max("n_bytes").alias("n_bytes"),
            F.sum("tokens").alias("tokens"),
            F.sum("copies").alias("copies"),
        )
        .select(
            F.col("id").alias(id_col),
            "n_bytes",
            F.expr("tokens div copies").cast("long").alias("n_tokens"),
        )
    )
