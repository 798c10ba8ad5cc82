"""Cutting sequences into blocks that equal passages share.

A window is ``length`` consecutive tokens. Each window is named by the smallest
hash among the ``gram``-token sequences in it, its anchor; a block is a run of
windows of the same anchor. Equal windows have the same anchor wherever they
stand, so it is enough to compare blocks of one anchor with each other. Inside a
passage that two texts share, their blocks are equal as a whole, and about
``(length - gram) / 2`` windows are then settled by one comparison.

Anchors only say what to compare. Blocks and windows are compared by 128-bit
digests of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STEP = np.uint64(0x9E3779B97F4A7C15)
_UNSTEP = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_BYTES = None


def _table(which: str, size: int) -> np.ndarray:
    """Powers of the step, or of its inverse, modulo 2^64."""
    have = _powers[which]
    if have.size < size:
        base = _STEP if which == "up" else _UNSTEP
        grown = np.empty(max(size, 2 * have.size), np.uint64)
        grown[0] = 1
        grown[1:] = base
        have = _powers[which] = np.cumprod(grown, dtype=np.uint64)
    return have[:size]


def scramble(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def running_hash(values: np.ndarray) -> np.ndarray:
    """Sums from which ``spans`` has the hash of any part."""
    out = np.zeros(values.size + 1, np.uint64)
    np.cumsum(values * _table("up", values.size), out=out[1:])
    return out


def spans(running: np.ndarray, starts, ends) -> np.ndarray:
    """Hashes of the parts [start, end); equal parts have equal hashes."""
    return scramble((running[ends] - running[starts]) * _table("down", running.size)[starts])


def byte_values(data: np.ndarray) -> np.ndarray:
    global _BYTES
    if _BYTES is None:
        _BYTES = scramble(np.arange(1, 257, dtype=np.uint64) * _STEP)
    return _BYTES[data]


def grams(values: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every run of ``gram`` values."""
    running = running_hash(values)
    down = _table("down", running.size)
    return scramble((running[gram:] - running[:-gram]) * down[: running.size - gram])


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        a = np.minimum(a[:-done], a[done:])
        done *= 2
    rest = width - done
    return np.minimum(a[: a.size - rest], a[rest:]) if rest else a


def cut(
    values: np.ndarray, length: int, gram: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, end of windows) of every block of a sequence of at least
    ``length`` values, and the hashes of its grams."""
    each = grams(values, gram)
    low = sliding_min(each, length - gram + 1)
    edges = np.flatnonzero(low[1:] != low[:-1]) + 1
    first = np.concatenate(([0], edges))
    return low[first], first, np.concatenate((edges, [low.size])), each


def anchored_twice(anchor, first, end, each: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Whether a block has its anchor at two places: only then can two of its own
    windows be equal."""
    stop = (end + length - gram).tolist()
    count = np.count_nonzero
    return np.array(
        [count(each[a:b] == x) > 1 for x, a, b in zip(anchor, first.tolist(), stop, strict=True)], bool
    )


def digest(data: bytes | memoryview) -> tuple[int, int]:
    """128-bit digest as two signed longs."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(data), ">i8").tolist())


def digests(data: bytes, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """128-bit digests of the parts [left, right) as rows of two signed longs."""
    view, take = memoryview(data), xxhash.xxh3_128_digest
    joined = b"".join([take(view[a:b]) for a, b in zip(left.tolist(), right.tolist(), strict=True)])
    return np.frombuffer(joined, ">i8").reshape(-1, 2).astype(np.int64)


class Words:
    """A text as words joined by one space, with the place of each."""

    def __init__(self, text: bytes):
        words = text.split()
        self.n = len(words)
        self.joined = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, self.n)
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes

    def values(self) -> np.ndarray:
        """One hash per word."""
        running = running_hash(byte_values(np.frombuffer(self.joined, np.uint8)))
        return spans(running, self.starts, self.ends)


# --- tables of blocks -------------------------------------------------------

#: Up to so many document keys are sent to every task to pick the documents that a
#: later step needs (16 bytes each); beyond that the texts are joined by a shuffle.
SENT_KEYS = 1_000_000
#: Rows that a task hands on together.
AT_ONCE = 100_000
KEY = ["id", "print"]


def documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, print, text): ``print`` tells texts of one id apart; a null text is empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("print"), text.alias("text"))


def id_type(docs: DataFrame) -> str:
    return docs.schema["id"].dataType.simpleString()


def occurrences(docs: DataFrame, length: int, gram: int, by_words: bool) -> DataFrame:
    """(id, print, anchor, d1, d2, first, n, twice) of every block of every document.

    ``first`` is the place of the first window, ``n`` the number of windows.
    ``twice`` (see ``anchored_twice``) is looked for in bytes only: no document is a
    source of its own words.
    """

    def cut_one(text: str):
        """(anchor, first, end, twice, digests) of the blocks of a text, or None."""
        if by_words:
            words = Words(text.encode())
            if words.n < length:
                return None
            anchor, first, end, _ = cut(words.values(), length, gram)
            twice = np.zeros(anchor.size, bool)
            data, left, right = words.joined, words.starts[first], words.ends[end + length - 2]
        else:
            data = text.encode()
            if len(data) < length:
                return None
            anchor, first, end, each = cut(byte_values(np.frombuffer(data, np.uint8)), length, gram)
            twice = anchored_twice(anchor, first, end, each, length, gram)
            left, right = first, end + length - 1
        return anchor, first, end, twice, digests(data, left, right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list = []
            rows: list[np.ndarray] = []
            size = 0
            for i, value in enumerate(batch.column(2)):
                found = cut_one(value.as_py())
                if found is not None:
                    held.append(found)
                    rows.append(np.full(found[0].size, i))
                    size += found[0].size
                if held and (size >= AT_ONCE or i == batch.num_rows - 1):
                    anchor, first, end, twice, prints = (np.concatenate(x) for x in zip(*held, strict=True))
                    place = pa.array(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(place),
                            batch.column(1).take(place),
                            pa.array(anchor.view(np.int64)),
                            pa.array(prints[:, 0].copy()),
                            pa.array(prints[:, 1].copy()),
                            pa.array(first.astype(np.int32)),
                            pa.array((end - first).astype(np.int32)),
                            pa.array(twice, pa.bool_()),
                        ],
                        names=["id", "print", "anchor", "d1", "d2", "first", "n", "twice"],
                    )
                    held, rows, size = [], [], 0

    schema = (
        f"id {id_type(docs)}, print long, anchor long, d1 long, d2 long, first int, n int, twice boolean"
    )
    return docs.mapInArrow(run, schema)


def found_again(occurring: DataFrame) -> DataFrame:
    """The occurrences whose anchor occurs more than once, and whether the windows of
    their blocks have to be compared one by one (``mixed``: blocks differ there).

    Anchors are counted before anything else is moved.
    """
    anchors = (
        occurring.groupBy("anchor")
        .agg(F.count("*").alias("c"), F.min("d1").alias("low"), F.max("d1").alias("high"), F.max("twice").alias("twice"))
        .where("c > 1 OR twice")
        .select("anchor", (F.col("twice") | (F.col("low") != F.col("high"))).alias("mixed"))
    )
    return occurring.drop("twice").join(anchors, "anchor")


def with_keys(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents whose (id, print) is in ``keys``, all others), null-safe.

    ``keys`` has distinct rows and is a written table, so counting it is cheap.
    """
    named = keys.select(F.col("id").alias("_id"), F.col("print").alias("_print"))
    if keys.count() <= SENT_KEYS:
        named = F.broadcast(named)
    same = (F.col("print") == F.col("_print")) & F.col("id").eqNullSafe(F.col("_id"))
    return docs.join(named, same, "left_semi"), docs.join(named, same, "left_anti")


def leading(data: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` (at most 8) bytes from each place on as one number that sorts as they do."""
    padded = np.concatenate((data, np.zeros(size, np.uint8))).astype(np.uint64)
    out = np.zeros(data.size, np.uint64)
    for k in range(size):
        out = (out << np.uint64(8)) | padded[k : k + data.size]
    return (out ^ np.uint64(1 << 63)).view(np.int64)


def stretches(size: int, found: pa.Scalar) -> list[tuple[int, int]]:
    """The maximal parts [start, end) of ``size`` places that the found (first, length)
    parts cover together; ``found`` is a list of such structs or null."""
    if not found.is_valid or not len(found.values):
        return []
    first, length = (found.values.field(k).to_numpy().astype(np.int64) for k in (0, 1))
    change = np.bincount(first, minlength=size + 1) - np.bincount(first + length, minlength=size + 1)
    covered = np.cumsum(change[:size]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
    return list(map(tuple, edges.reshape(-1, 2).tolist()))
