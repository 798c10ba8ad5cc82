"""MinHash near-dedup with min-max hashing.

Each permutation gives two values of a signature, the smallest and the largest
hash of the set, so 64 permutations give 128 values. Values of four permutations
form a band: 16 bands of minima, 16 of maxima. A pair of sets of similarity 0.8
shares no band with a probability under 1e-7. The retained values also estimate
the similarity without bias (``estimate``).

Links are confirmed on full sets. To find the groups that links form, not all
pairs of a band bucket have to be looked at:

1. Equal sets are one node. In each bucket the node that shares most buckets with
   others is the centre, and only pairs with the centre are candidates.
2. Every node is compared with its most central centre, then with its other
   centres where both sides are not linked yet.
3. In buckets that still hold several groups, pairs across groups are candidates
   that were none before; only these can link anything new. Small buckets give
   all such pairs. In large ones the full sets (all 64 bits of the hashes) are counted
   against each other inside the task, and only similar pairs that join groups leave
   it; buckets of more than ``PART`` hashes are cut into parts that meet two by two, so
   that a task's memory follows the lengths of the sets and not their number.

Defined cases: a null or wordless text has no shingle, is linked with nothing and
its own group; with fewer words than a shingle the whole text is one; a null id is
no smallest id and, alone in its group, stands for itself; rows that repeat both
id and text are one document and give one row; rows that share only an id are
documents of their own; an empty table gives an empty one; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import blocks
from quire.llm.blocks import KEY
from quire.llm.common import SPACES, lean, text_hash, without
from quire.llm.graph import components
from quire.session import materialise

PERMUTATIONS, BAND = 64, 4
#: Sets of a bucket that are simply paired; hashes of the sets of one part of a larger bucket.
#: A task compares two parts, with about 60 bytes a hash.
SMALL_BUCKET, PART = 32, 1 << 20
_CAPITALS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_AT_ONCE = 4096


def _factors(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed numbers that tell the permutations apart, made by a rule."""
    seeds = blocks.scramble(np.arange(1, 2 * count + 1, dtype=np.uint64))
    return seeds[:count], seeds[count:] | np.uint64(1)


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word sequences of a lower-cased text."""
    words = blocks.Words(text.encode().translate(_CAPITALS))
    if not words.n:
        return np.empty(0, np.uint64)
    return np.unique(blocks.grams(words.values(), min(size, words.n)))


def signature(hashes: np.ndarray, count: int = PERMUTATIONS) -> np.ndarray:
    """Minima, then maxima, of every permutation of a non-empty set."""
    shift, factor = _factors(count)
    low = np.full(count, 0xFFFFFFFFFFFFFFFF, np.uint64)
    high = np.zeros(count, np.uint64)
    for at in range(0, hashes.size, _AT_ONCE):
        part = (hashes[at : at + _AT_ONCE, None] ^ shift) * factor
        np.minimum(low, part.min(axis=0), out=low)
        np.maximum(high, part.max(axis=0), out=high)
    return np.concatenate((low, high))


def estimate(one: np.ndarray, other: np.ndarray) -> float:
    """Similarity estimated as the share of equal values of two signatures."""
    return float(np.mean(one == other))


def bands(values: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; equal values in different bands get different keys."""
    rows = values.reshape(-1, BAND)
    weights = blocks.scramble(np.arange(1, BAND + 1, dtype=np.uint64)) | np.uint64(1)
    number = np.arange(1, rows.shape[0] + 1, dtype=np.uint64)
    return blocks.scramble(blocks.scramble(rows * weights).sum(axis=1, dtype=np.uint64) ^ blocks.scramble(number))


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """(id, print, n, d1, d2, bands): shingles, digest of the set, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d1, d2, keys = [], [], [], []
            for value in batch.column(2):
                own = shingles(value.as_py(), size)
                n.append(own.size)
                a, b = blocks.digest(own.tobytes())
                d1.append(a)
                d2.append(b)
                keys.append(bands(signature(own)).view(np.int64) if own.size else [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(n, pa.int64()),
                    pa.array(d1, pa.int64()),
                    pa.array(d2, pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["id", "print", "n", "d1", "d2", "bands"],
            )

    return docs.mapInArrow(
        lean(run), f"id {blocks.id_type(docs)}, print long, n long, d1 long, d2 long, bands array<long>"
    )


def _sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, own): the full set of each wanted node, from the text that stands for it."""
    holding, _ = blocks.with_keys(docs, nodes.select(*KEY))
    named = nodes.select("node", F.col("id").alias("_id"), F.col("print").alias("_print"))
    same = (F.col("print") == F.col("_print")) & F.col("id").eqNullSafe(F.col("_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = shingles(batch.column(1)[i].as_py(), size).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), pa.array([own], pa.list_(pa.int64()))],
                    names=["node", "own"],
                )

    return (
        holding.join(named, same).select("node", "text").mapInArrow(lean(run), "node long, own array<long>")
    )


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("own").alias("sa")), "a")
    with_b = with_a.join(sets.select(F.col("node").alias("b"), F.col("own").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return with_b.where(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def _similar_size(a: str, b: str, percent: int) -> Column:
    """Sets of too different sizes can't reach the similarity."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


class _Index:
    """Which rows of a table of sets hold which hash."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([x.size for x in sets])
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        _, token = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(token, kind="stable")
        self.holders = owner[order]
        self.upto = np.concatenate(([0], np.cumsum(np.bincount(token))))
        self.tokens = np.split(token, np.cumsum(self.sizes)[:-1])

    def shared(self, i: int) -> np.ndarray:
        """How many hashes every row has in common with row i."""
        own = self.tokens[i]
        first, count = self.upto[own], self.upto[own + 1] - self.upto[own]
        skip = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count)
        return np.bincount(self.holders[np.arange(count.sum()) + skip], minlength=self.sizes.size)


def _joining_pairs(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Similar pairs (a, b), a < b, that join groups inside each bucket (key, node, root)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [x.values.to_numpy().tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["node", "packed"])

    wanted = buckets.select("node").distinct()
    whole = sets.join(wanted, "node", "left_semi").mapInArrow(lean(pack), "node long, packed binary")
    lengths = sets.select("node", F.size("own").alias("length"))
    sizes = (
        buckets.select("key", "node").join(lengths, "node")
        .groupBy("key").agg(F.ceil(F.sum("length") / PART).cast("int").alias("parts"))
    )
    parts = F.col("parts")
    part = F.pmod(F.xxhash64("node"), parts).cast("int")
    other = F.explode(F.sequence(F.lit(0), parts - 1))
    rows = (
        buckets.join(sizes, "key")
        .join(whole, "node")
        .select("key", "node", "root", "packed", part.alias("part"), other.alias("other"))
        .withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
        .drop("other")
    )

    def compare(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("node").reset_index(drop=True)
        node, part = df["node"].to_numpy(), df["part"].to_numpy()
        _, group = np.unique(df["root"].to_numpy(), return_inverse=True)
        index = _Index([np.frombuffer(x, np.int64) for x in df["packed"]])
        largest = np.bincount(group).argmax()
        a, b = [], []
        # Two of the largest group need no look, so only rows of others are counted out.
        for i in np.flatnonzero(group != largest):
            both = index.shared(i)
            fits = (100 * both >= percent * (index.sizes[i] + index.sizes - both)) & (group != group[i])
            if df["low"][0] != df["high"][0]:
                fits &= part != part[i]
            while fits.any():
                j = int(fits.argmax())
                a.append(min(node[i], node[j]))
                b.append(max(node[i], node[j]))
                group[group == group[j]] = group[i]
                fits &= group != group[i]
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return rows.groupBy("key", "low", "high").applyInPandas(compare, "a long, b long")


def _roots(nodes: DataFrame, links: DataFrame) -> DataFrame:
    return nodes.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))


def groups(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(documents with their node, nodes with the root of their group)."""
    base = materialise(_signed(docs, size).dropDuplicates(KEY), "signed")
    # A null id is never the smallest of a group.
    own = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("print").alias("print"))
    nodes = materialise(
        base.where("n > 0")
        .groupBy("d1", "d2")
        .agg(F.min(own).alias("first"), F.max("n").alias("n"), F.any_value("bands").alias("bands"))
        .select("d1", "d2", "first", "n", "bands"),
        "sets",
    )
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    keyed = nodes.select("node", "n", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    buckets = materialise(keyed.join(shared, "key"), "buckets")
    known = buckets.groupBy("node").agg(F.sum("c").alias("weight"))
    weighed = buckets.join(known, "node")
    centre = weighed.groupBy("key").agg(
        F.max(F.struct(F.col("weight"), (-F.col("node")).alias("minus"), F.col("n").alias("centre_n"))).alias("x")
    )
    stars = materialise(
        weighed.join(centre.select("key", "x.*").withColumnRenamed("weight", "centre_weight"), "key")
        .withColumn("b", -F.col("minus"))
        .where(F.col("node") != F.col("b"))
        .where(_similar_size("n", "centre_n", percent))
        .groupBy(F.col("node").alias("a"), "b")
        .agg(F.max("centre_weight").alias("centre_weight")),
        "stars",
    )
    wanted = materialise(
        buckets.select("node").distinct().join(nodes.select("node", "first.id", "first.print"), "node"), "wanted"
    )
    sets = materialise(_sets(docs, wanted, size), "full-sets")

    best = stars.groupBy("a").agg(F.max(F.struct("centre_weight", "b")).alias("x")).select("a", "x.b")
    links = materialise(_linked(best, sets, percent), "links")
    rooted = materialise(_roots(wanted.select("node"), links), "roots")

    def across(pairs: DataFrame) -> DataFrame:
        return (
            pairs.join(rooted.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
            .join(rooted.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
            .where("ra <> rb")
            .select("a", "b")
        )

    more = materialise(_linked(across(stars.join(best, ["a", "b"], "left_anti")), sets, percent), "links")
    links = links.unionByName(more)
    rooted = materialise(_roots(wanted.select("node"), links), "roots")

    # Buckets that still hold several groups.
    inside = buckets.select("key", "c", "node", "n").join(rooted, "node")
    mixed = materialise(
        inside.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("key"),
        "mixed-keys",
    )
    left = materialise(inside.join(mixed, "key"), "mixed-buckets")
    few = left.where(F.col("c") <= SMALL_BUCKET)
    right = few.select("key", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"))
    pairs = (
        few.select("key", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"))
        .join(right, "key")
        .where("a < b AND ra <> rb")
        .where(_similar_size("na", "nb", percent))
        .select("a", "b")
    )
    rest = (
        pairs.unionByName(_joining_pairs(left.where(F.col("c") > SMALL_BUCKET), sets, percent))
        .distinct()
        .join(stars.select("a", "b"), ["a", "b"], "left_anti")
        .join(stars.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    )
    last = materialise(_linked(rest, sets, percent), "links")
    rooted = materialise(_roots(nodes.select("node"), links.unionByName(last)), "roots")
    return base, nodes.join(rooted, "node")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    percent: int = 80,
) -> DataFrame:
    """Per document: id, text hash, set size, smallest id of its group (null only if all
    ids of the group are null) and whether it is the one row that stands for it."""
    own = blocks.documents(docs, id_col, text_col)
    base, rooted = groups(own, size, percent)
    rooted = materialise(rooted.select("d1", "d2", "first", "root"), "rooted")
    # Written, so that the join with a very large group can be split.
    best = materialise(rooted.groupBy("root").agg(F.min("first").alias("best")), "group-first")
    named = rooted.join(best, "root").select("d1", "d2", "best")
    return (
        base.select(*KEY, "n", "d1", "d2")
        .join(named, ["d1", "d2"], "left")
        .select(
            F.col("id").alias(id_col),
            "print",
            F.col("n").alias("n_shingles"),
            F.when(F.col("best").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("component_id"),
            (
                F.col("best").isNull()
                | (F.col("best.id").eqNullSafe(F.col("id")) & (F.col("best.print") == F.col("print")))
            ).alias("stands"),
        )
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """The documents, all columns, one of each group (the one with the smallest id);
    texts without words all stay. Of rows that repeat id and text of the document that
    stays, the one whose columns come first as JSON stays.
    """
    found = near_duplicates(docs, id_col, text_col, size)
    gone = materialise(found.where("NOT stands").select(F.col(id_col).alias("id"), "print").distinct(), "gone")
    kept = without(docs, gone, id_col, text_col)
    key = [F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("print")]
    worded = docs.where(F.length(F.btrim(F.col(text_col).cast("string"), F.lit(SPACES))) > 0)
    again = worded.select(*key).groupBy("id", "print").agg(F.count("*").alias("c")).where("c > 1")
    again = materialise(again.select("id", "print"), "repeated")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = (
        without(kept, again, id_col, text_col, "left_semi")
        .groupBy(*key)
        .agg(F.min_by(row, F.to_json(row)).alias("row"))
        .select("row.*")
    )
    return without(kept, again, id_col, text_col).unionByName(first)
