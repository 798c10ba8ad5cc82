"""Language-model scores by Katz back-off over word pairs.

Tokens are the words of a text in lower case (A-Z) and one end; the history of a token
is the token before it, or the beginning. With c counted over the training documents:

    P(w)     = d(c(w)) c(w) / (N + 1), and the rest for the class of all unknown words
    P(w | h) = d(c(h,w)) c(h,w) / (c(h) + 1)       if the pair (h, w) was seen
             = a(h) P(w)                           if not

d is the Good-Turing discount for counts up to ``K``, 1 above. One occurrence of every
history is always held back, so that one whose followers are all frequent keeps mass
for others. a(h) makes P(. | h) sum to exactly 1 over the known words and the unknown
class: it is the mass that the seen followers leave, over the mass that they leave in P.

A text's score adds up per token, and most of it needs one lookup by pair only:

    score = sum over seen pairs   of log10(d c(h,w))
          + sum over unseen pairs of log10 P(w) + log10(a(h) (c(h) + 1))
          - sum over histories    of log10(c(h) + 1)

and as every token but the end is the history of the next one, the last sum is that of
log10(c(w) + 1) over the tokens. So:

1. Words are counted. This gives N, V, the discounts of single words and the few words
   that are too frequent for one task.
2. Pairs go, packed by chunks of documents, to the task of their word (of the pair, for
   frequent words), which has c(w) and c(h,w) then and works out, per document, the sums
   above, still by classes of c(h,w), as the discounts of pairs need all tasks; per
   history, the followers' counts and mass; and the unseen pairs.
3. Those tables, written in partitions, are summed up. Unseen pairs back off to the
   table of histories; each document's parts are added.

Words and pairs are told apart by 64-bit hashes. No table of words or pairs is held by
one task: packed pairs of a task are those of ``BUCKET`` tokens. A pair that stands in
very many documents costs its task one packed number for each of them.

Null and empty texts are one end. Documents without id are trained on and scored like
others; repeated rows count each time and are scored each. A text of any length is cut
at white space while it is read. Without training text every score is 0. No rows for
an empty table. Other columns are left alone, whatever their names.
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.blocks import Words, scramble
from quire.llm.common import give_back, lean
from quire.operators.lookup import lookup
from quire.session import materialise, scratch_path

#: Counts up to K are discounted.
K = 5
#: Tokens whose pairs one task holds at a time, and tokens that are packed together.
BUCKET = 2_000_000
CHUNK = 1_500_000
#: Documents and bytes of one text that are looked at together, at most.
DOCS, PIECE = 1 << 19, 1 << 20
#: A word in one of so many tokens, but half a bucket at least, is dealt by pairs. So
#: there are a million such words at most (16 MB, sent to every task).
SHARE = 1_000_000
END, BEGIN = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949D7C7509E6557)
_SPACE = re.compile(rb"[ \t-\r]")


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in parts that end at white space."""
    start = 0
    while len(text) - start > PIECE:
        found = _SPACE.search(text, start + PIECE)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(opened, word, history, doc, learnt) of about CHUNK tokens: per token the hashes of
    it and of its history, the number of its document in the task and whether that is
    learnt from; (number, id, trained) of each document that begins in the chunk."""
    number = -1
    opened, held, size = [], [], 0

    def chunk():
        word, history = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        doc, learnt = (np.repeat([x[k] for x in held], [x[0].size for x in held]) for k in (2, 3))
        return opened, word, history, doc, learnt

    for batch in batches:
        for i, (trained, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
            number += 1
            opened.append((number, batch.column(0)[i].as_py(), trained))
            before = BEGIN
            parts = list(_pieces(text.as_py().encode().lower()))
            for part in parts:
                hashes = Words(part).values()
                if part is parts[-1]:
                    hashes = np.append(hashes, END)
                if hashes.size:
                    held.append((hashes, np.concatenate(([before], hashes[:-1])), number, trained))
                    before = hashes[-1]
                    size += hashes.size
                if size >= CHUNK or len(held) >= DOCS:
                    yield chunk()
                    opened, held, size = [], [], 0
    if held:
        yield chunk()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, word, _, _, learnt in _chunks(batches):
        found, place, total = np.unique(word, return_inverse=True, return_counts=True)
        c = np.bincount(place, weights=learnt, minlength=found.size).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found.view(np.int64)), pa.array(c), pa.array(total)], names=["w", "c", "n"]
        )


def discounts(counts: list[int]) -> list[float]:
    """d(1) .. d(K) from the numbers of things seen once, twice, ... K + 1 times.

    Katz's form of the Good-Turing estimate, up to the largest count for which it gives
    discounts between 0 and 1. Where it gives none (very small tables), half an
    occurrence is taken from each count.
    """
    for most in range(K, 0, -1):
        n = counts[: most + 1]
        if min(n) <= 0:
            continue
        rest = (most + 1) * n[most] / n[0]
        if rest >= 1:
            continue
        d = [((r + 1) * n[r] / (r * n[r - 1]) - rest) / (1 - rest) for r in range(1, most + 1)]
        if all(0 < x < 1 for x in d):
            return d + [1.0] * (K - most)
    return [1 - 0.5 / r for r in range(1, K + 1)]


def _word_probability(c: np.ndarray, d: list[float], tokens: int, unknown: float) -> np.ndarray:
    """P(w) of words with counts c."""
    factor = np.append([0.0, *d], 1.0)[np.minimum(c, K + 1).astype(np.int64)]
    return np.where(c > 0, factor * c / (tokens + 1), unknown)


def _slot(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((scramble(hashes) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _pair(words: np.ndarray, history: np.ndarray) -> np.ndarray:
    return scramble(words * np.uint64(0x9E3779B97F4A7C15) + scramble(history))


_PACKED = "bucket int, base long, data binary, id {0}, held boolean"


def _rows(id_type: pa.DataType, bucket, base, data, ids, held) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.binary(), id_type, pa.bool_()]
    arrays = [pa.array(v, t) for v, t in zip((bucket, base, data, ids, held), types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", "base", "data", "id", "held"])


def _packed(word, history, doc, n, learnt, group: Callable) -> Iterator[tuple[int, bytes]]:
    """(group, packed pairs) for each group of 2^21 tokens at most: pairs once, with the
    documents that have them and how often."""
    pack = zstandard.ZstdCompressor(level=1).compress
    (words, w), (before, h), (docs, first, d) = (
        np.unique(word, return_inverse=True),
        np.unique(history, return_inverse=True),
        np.unique(doc, return_index=True, return_inverse=True),
    )
    learnt = learnt[first]
    mask, bits = np.uint64((1 << 21) - 1), np.uint64(21)
    code = (w.astype(np.uint64) << np.uint64(42)) | (h.astype(np.uint64) << bits) | d.astype(np.uint64)
    if n is None:
        entry, n = np.unique(code, return_counts=True)
    else:
        entry, place = np.unique(code, return_inverse=True)
        n = np.bincount(place, weights=n).astype(np.int64)
    pair = entry >> bits
    first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
    sizes = np.diff(np.append(first, entry.size))
    w, h, d = ((x & mask).astype(np.int64) for x in (pair[first] >> bits, pair[first], entry))
    of = group(words[w], before[h])
    order = np.argsort(of, kind="stable")
    edges = np.flatnonzero(np.diff(of[order], prepend=-1, append=-1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        some = order[a:b]
        many = sizes[some]
        inside = np.repeat(first[some] - np.cumsum(many) + many, many) + np.arange(many.sum())
        parts = []
        for names, index in ((words, w[some]), (before, h[some]), (docs, d[inside])):
            few, index = np.unique(index, return_inverse=True)
            parts += [names[few], _small(index)]
        flags = np.packbits(learnt[np.unique(d[inside])])
        yield int(of[some[0]]), pack(pickle.dumps((*parts, flags, _small(many), _small(n[inside])), protocol=5))


def _unpacked(pieces: list[tuple[int, bytes]]) -> tuple[np.ndarray, ...]:
    """(word, history, documents) of the pairs and (doc, n, learnt) of their documents;
    numbers of documents are counted on from the base of each piece."""
    unpack = zstandard.ZstdDecompressor().decompress
    held = [[] for _ in range(6)]
    for base, data in pieces:
        words, w, before, h, docs, d, flags, many, n = pickle.loads(unpack(data))
        learnt = np.unpackbits(flags, count=docs.size).astype(bool)
        found = (words[w], before[h], many.astype(np.int64), docs[d] + base, n.astype(np.int64), learnt[d])
        for to, values in zip(held, found, strict=True):
            to.append(values)
    return tuple(map(np.concatenate, held))


def _grouping(buckets: int, frequent: np.ndarray, width: int) -> Callable:
    """The group of ``width`` buckets that a pair belongs to."""

    def group(word: np.ndarray, history: np.ndarray) -> np.ndarray:
        bucket = _slot(word, buckets)
        split = np.isin(word, frequent)
        bucket[split] = _slot(_pair(word[split], history[split]), buckets)
        return bucket // width

    return group


def _pack_pairs(buckets: int, group: Callable) -> Callable:
    """(bucket, base, data) of each chunk's pairs, and (bucket, base, id, held) of every
    document, whose number ``base`` is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        kind: list[pa.DataType] = []

        def seen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kind[:] = [batch.schema.field(0).type]
                yield batch

        for opened, word, history, doc, learnt in _chunks(seen()):
            for to, data in _packed(word, history, doc, None, learnt, group):
                yield _rows(kind[0], [to], [base], [data], [None], [None])
            for a in range(0, len(opened), 50_000):
                number, ids, trained = zip(*opened[a : a + 50_000], strict=True)
                yield _rows(
                    kind[0],
                    [i % buckets for i in number],
                    [base + i for i in number],
                    [None] * len(ids),
                    ids,
                    [not t for t in trained],
                )

    return run


def _pack_again(group: Callable) -> Callable:
    """The same pairs by smaller groups; pieces that come together are merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        size, kind = 0, None

        def again() -> Iterator[pa.RecordBatch]:
            word, history, many, doc, n, learnt = _unpacked(held)
            word, history = np.repeat(word, many), np.repeat(history, many)
            for a in range(0, n.size, 1 << 21):
                part = slice(a, a + (1 << 21))
                for to, data in _packed(word[part], history[part], doc[part], n[part], learnt[part], group):
                    yield _rows(kind, [to], [0], [data], [None], [None])

        for batch in batches:
            kind = batch.schema.field(3).type
            headers = pa.compute.is_valid(batch.column(4))
            yield batch.filter(headers)
            packed = batch.filter(pa.compute.invert(headers))
            for base, data in zip(packed.column(1).to_pylist(), packed.column(2).to_pylist(), strict=True):
                held.append((base, data))
                size += len(data)
                if size >= 4 * CHUNK:
                    yield from again()
                    held, size = [], 0
        if held:
            yield from again()

    return run


def _small(values: np.ndarray) -> np.ndarray:
    """The values in the narrowest unsigned type."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


_CLASSES = [f"c{r}" for r in range(1, K + 2)]
_TABLES = "kind string, key long, id {0}, held boolean, h long, n long, known long, base double, score double, " + ", ".join(
    f"{c} long" for c in _CLASSES
)


def _count_pairs(
    word_discounts: list[float], tokens: int, unknown: float, frequent: np.ndarray, counts: np.ndarray
) -> Callable:
    """What one bucket knows: parts of documents, followers of histories, unseen pairs."""
    fields = ["kind", "key", "id", "held", "h", "n", "known", "base", "score", *_CLASSES]
    types = [pa.string(), pa.int64(), None, pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2, *[pa.int64()] * (K + 1)]

    def rows(kind: str, id_type: pa.DataType, size: int, **columns) -> pa.RecordBatch:
        columns["kind"] = [kind] * size
        arrays = [
            pa.array(columns[f], t or id_type) if f in columns else pa.nulls(size, t or id_type)
            for f, t in zip(fields, types, strict=True)
        ]
        return pa.RecordBatch.from_arrays(arrays, names=fields)

    def classes(place: np.ndarray, size: int, count: np.ndarray, times: np.ndarray) -> dict:
        """How often each place meets the counts 1 .. K and more, as columns."""
        slot = place * (K + 2) + np.minimum(count, K + 1).astype(np.int64)
        table = np.bincount(slot, weights=times, minlength=size * (K + 2)).reshape(-1, K + 2).astype(np.int64)
        return {c: table[:, r] for r, c in enumerate(_CLASSES, 1)}

    def run(bucket: pa.Table) -> pa.Table:
        id_type = bucket.schema.field("id").type
        given = bucket.filter(pa.compute.is_valid(bucket["held"]))
        columns = {f: given[g].combine_chunks() for f, g in (("key", "base"), ("id", "id"), ("held", "held"))}
        out = [rows("documents", id_type, given.num_rows, **columns)]
        packed = bucket.filter(pa.compute.is_null(bucket["held"]))
        if packed.num_rows:
            out += pairs(list(zip(packed["base"].to_pylist(), packed["data"].to_pylist(), strict=True)), id_type)
            give_back()
        return pa.Table.from_batches(out)

    def pairs(pieces: list, id_type: pa.DataType) -> list[pa.RecordBatch]:
        word, history, many, doc, n, learnt = _unpacked(pieces)
        _, first, same = np.unique(_pair(word, history), return_index=True, return_inverse=True)
        word, history = word[first], history[first]
        pair = np.repeat(same, many)
        del same, many
        seen = np.bincount(pair, weights=n * learnt, minlength=first.size)
        words, at = np.unique(word, return_inverse=True)
        of_word = np.bincount(at, weights=seen, minlength=words.size)
        if frequent.size:
            hot = np.minimum(np.searchsorted(frequent, words), frequent.size - 1)
            of_word = np.where(frequent[hot] == words, counts[hot], of_word)
        of_word = of_word[at]
        p = _word_probability(of_word, word_discounts, tokens, unknown)
        unseen = seen == 0
        own = np.where(unseen, np.log10(p), np.where(seen > K, np.log10(np.maximum(seen, 1)), 0.0))
        keys, place = np.unique(doc, return_inverse=True)

        def summed(values: np.ndarray) -> np.ndarray:
            return np.bincount(place, weights=values[pair] * n, minlength=keys.size)

        parts = rows(
            "documents",
            id_type,
            keys.size,
            key=keys,
            n=np.bincount(place, weights=n, minlength=keys.size).astype(np.int64),
            known=summed(of_word > 0).astype(np.int64),
            base=summed(np.log10(of_word + 1)),
            score=summed(own),
            **classes(place, keys.size, seen[pair], n),
        )
        kept = np.flatnonzero(~unseen)
        names, place = np.unique(history[kept], return_inverse=True)
        mass = np.bincount(place, weights=p[kept], minlength=names.size)
        table = classes(place, names.size, seen[kept], np.ones(kept.size))
        followers = rows("histories", id_type, names.size, h=names.view(np.int64), score=mass, **table)
        missed = np.flatnonzero(unseen[pair])
        before = history[pair[missed]].view(np.int64)
        return [parts, followers, rows("unseen", id_type, missed.size, key=doc[missed], h=before, n=n[missed])]

    return run


def _totals(words: DataFrame) -> tuple[int, int, int, list[int]]:
    """(all tokens, N, V, numbers of words seen once, twice, ... K + 1 times)."""
    trained = F.col("c") > 0
    wanted = [F.sum("n"), F.sum("c"), F.count_if(trained), *[F.count_if(F.col("c") == r) for r in range(1, K + 2)]]
    n, c, v, *seen = (x or 0 for x in words.agg(*wanted).first())
    return n, c, v, seen


def score(
    docs: DataFrame,
    trained: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket: int = BUCKET,
    fan: int = 256,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Where ``trained`` is false a document is only scored (null: it is learnt from).
    base_score is the add-one score of the words alone, log10((c + 1) / (N + V + 1)) each.
    ``fan``: pieces that a chunk of pairs is dealt to at a time; with more buckets than
    that, pairs are dealt in several rounds.
    """
    spark = docs.sparkSession
    given = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(trained, F.lit(True)).alias("trained"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    found = given.mapInArrow(lean(_count_words), "w long, c long, n long")
    words = materialise(found.groupBy("w").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "words")
    everything, tokens, vocabulary, seen = _totals(words)
    d = discounts(seen)
    unknown = (1 + sum((1 - d[r - 1]) * r * seen[r - 1] for r in range(1, K + 1))) / (tokens + 1)

    buckets = max(1, math.ceil(everything / bucket))
    often = max(bucket // 2, everything // SHARE)
    # SHARE rows at most, as each has more than its share of the tokens.
    hot = sorted((r.w % (1 << 64), r.c) for r in words.where(F.col("n") > often).select("w", "c").collect())
    frequent, counts = np.array([w for w, _ in hot], np.uint64), np.array([c for _, c in hot], np.float64)

    kind = given.schema["id"].dataType.simpleString()
    width = 1
    while width * fan < buckets:
        width *= fan
    packed = given.mapInArrow(lean(_pack_pairs(buckets, _grouping(buckets, frequent, width))), _PACKED.format(kind))
    while width > 1:
        width //= fan
        again = _pack_again(_grouping(buckets, frequent, width))
        packed = packed.repartition("bucket").mapInArrow(lean(again), _PACKED.format(kind))
    schema, path = _TABLES.format(kind), scratch_path(spark, "pairs")
    counted = packed.groupBy("bucket").applyInArrow(_count_pairs(d, tokens, unknown, frequent, counts), schema)
    counted.write.partitionBy("kind").parquet(path)
    tables = spark.read.schema(schema).parquet(path)

    followers = tables.where("kind = 'histories'")
    d2 = discounts([x or 0 for x in followers.agg(*[F.sum(c) for c in _CLASSES]).first()])
    left = sum(((1 - d2[r - 1]) * r * F.col(f"c{r}") for r in range(1, K + 1)), F.lit(0.0))
    histories = materialise(
        followers.groupBy("h")
        .agg(F.sum(left).alias("left"), F.sum("score").alias("mass"))
        .select("h", F.log10((F.col("left") + 1) / F.greatest(1 - F.col("mass"), F.lit(unknown))).alias("a")),
        "histories",
    )
    # A history that was never seen takes nothing off: a(h) (c(h) + 1) = 1.
    backed = lookup(
        tables.where("kind = 'unseen'").select("key", "h", "n"), histories, "h", "key", limit=32 * 1024 * 1024
    )
    none = F.lit(None)
    parts = tables.where("kind = 'documents'").select(
        "key",
        "id",
        "held",
        "n",
        "known",
        "base",
        sum((math.log10(d2[r - 1] * r) * F.col(f"c{r}") for r in range(1, K + 1)), F.col("score") - F.col("base")).alias("score"),
    )
    added = backed.select(
        "key",
        none.cast(kind).alias("id"),
        none.cast("boolean").alias("held"),
        none.cast("long").alias("n"),
        none.cast("long").alias("known"),
        none.cast("double").alias("base"),
        (F.col("n") * F.col("a")).alias("score"),
    )
    return (
        parts.unionByName(added)
        .groupBy("key")
        .agg(
            F.max("id").alias(id_col),
            F.max("held").alias("held_out"),
            F.sum("n").alias("n_tokens"),
            F.sum("known").alias("n_known"),
            F.lit(tokens).cast("long").alias("train_tokens"),
            (F.sum("base") - F.sum("n") * math.log10(tokens + vocabulary + 1)).alias("base_score"),
            F.sum("score").alias("score"),
        )
        .drop("key")
    )
