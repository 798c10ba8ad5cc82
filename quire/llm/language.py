"""Language of a text by fusing several kinds of evidence with Bayes' rule.

log posterior = tempered log likelihood of the text (byte trigrams)
              + log P(declared markup language | language)
              + log P(address suffix | language)
              + log P(language | host),

where the host's prior is smoothed by its domain's, and that by the global one.
All these tables are sums of the text's own posteriors over groups of all rows
(one grouped aggregation each, added up before the shuffle), so what a site
declares counts for as much as its texts bear out. An evidence that is missing
(null or empty) says nothing.

Every label is a class. The trigram model is fitted on a sample of the distinct
texts of each label, picked by their hash at a rate of the label's own: the labels
share ``TRAIN_ROWS`` equally, none has less than ``LABEL_ROWS`` in the mean, and labels
with no more texts than that are taken whole. Copies of a text count once. It is kept as (label, slot) pairs that
occur. Everything else covers all rows and whole texts. The class ``und`` has flat
trigrams: texts in none of the languages end up there.

Defined cases: a text that is null, empty or without a trigram has no likelihood
and is rejected (language ``und``); a null label is not used for fitting, and
without labelled rows every text is ``und``; repeated rows each get a row; an
empty table gives an empty one; ids are only carried along; other columns are
kept by ``accepted``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import lean, text_hash, without
from quire.session import materialise

#: Distinct texts the trigram model is fitted on, shared by the labels, and the least of
#: each label, both in the mean.
TRAIN_ROWS, LABEL_ROWS = 20_000, 100
SLOTS = 1 << 16
UNKNOWN = "und"
#: Trigrams overlap and long texts repeat themselves: this many count in full at most.
FULL_TRIGRAMS, TEMPER = 200, 0.5
#: Weights of the parent's distribution in smoothing.
HOST_WEIGHT, DOMAIN_WEIGHT, TABLE_WEIGHT = 20.0, 50.0, 50.0
CONFIDENCE = 0.5
_PART = 1 << 20
#: Up to so many classes are summed as columns, more as vectors; labels counted side by side in a task.
SUM_COLUMNS, _SIDE_BY_SIDE = 100, 64


class Trigrams(NamedTuple):
    """Log probability of a slot in a language: ``base`` of the language plus the
    ``gain`` of the pair, which is stored for the pairs that occur, ordered by slot."""

    base: np.ndarray
    upto: np.ndarray
    place: np.ndarray
    gain: np.ndarray

    def sums(self, slots: np.ndarray) -> np.ndarray:
        """Log probability of all slots together, by language."""
        out = slots.size * self.base
        used, times = np.unique(slots, return_counts=True)
        step = max(1, _PART // max(1, out.size))
        for at in range(0, used.size, step):
            own = used[at : at + step]
            first, count = self.upto[own], self.upto[own + 1] - self.upto[own]
            pairs = np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)
            weights = self.gain[pairs] * np.repeat(times[at : at + step], count)
            out += np.bincount(self.place[pairs], weights, minlength=out.size)
        return out


def _slots(text: str) -> Iterator[np.ndarray]:
    """Slots of the byte trigrams of the lower-cased text, in parts."""
    data = np.frombuffer(text.lower().encode(), np.uint8).astype(np.uint32)
    for at in range(0, max(data.size - 2, 0), _PART):
        d = data[at : at + _PART + 2]
        three = (d[:-2] << np.uint32(16)) | (d[1:-1] << np.uint32(8)) | d[2:]
        yield (three * np.uint32(2654435761)) >> np.uint32(16)


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang") -> tuple[list[str], Trigrams]:
    """(languages, trigram model).

    What reaches the driver is a row per label, and one number per slot and language
    of the sample.
    """
    rows = labelled.select(
        F.lower(F.col(label_col).cast("string")).alias("label"), F.col(text_col).cast("string").alias("text")
    ).where("label IS NOT NULL AND octet_length(text) >= 3 AND label <> ''")
    rows = rows.withColumn("print", F.xxhash64("text"))
    counted = rows.select("label", "print").distinct().groupBy("label").agg(F.count("*").alias("n")).toArrow()
    names = counted["label"].to_pylist()
    wanted = max(LABEL_ROWS, TRAIN_ROWS / max(1, len(names)))
    # Hashes from the smallest up to this one are in the sample.
    share = np.minimum(1.0, wanted / np.maximum(1, counted["n"].to_numpy()))
    rates = labelled.sparkSession.createDataFrame(
        list(zip(names, range(len(names)), ((2 * share - 1) * 2.0**63).tolist(), strict=True)),
        "label string, number int, upto double",
    )
    sample = (
        rows.join(F.broadcast(rates), "label")
        .where(F.col("print").cast("double") <= F.col("upto"))
        .select("number", "print", "text")
        .dropDuplicates(["number", "print"])
        .select("number", "text")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(SLOTS, np.int64))

        def given() -> Iterator[pa.RecordBatch]:
            for number, own in counts.items():
                used = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(used.size, number, np.int32)),
                        pa.array(used.astype(np.int32)),
                        pa.array(own[used]),
                    ],
                    names=["number", "slot", "n"],
                )
            counts.clear()

        for batch in batches:
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if number not in counts and len(counts) == _SIDE_BY_SIDE:
                    yield from given()
                for slots in _slots(text.as_py()):
                    counts[number] += np.bincount(slots, minlength=SLOTS)
        yield from given()

    found = (
        sample.mapInArrow(lean(count), "number int, slot int, n long")
        .groupBy("number", "slot")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    number, slot, n = (found[c].to_numpy() for c in ("number", "slot", "n"))
    used, place = np.unique(number, return_inverse=True)
    by_name = sorted(range(used.size), key=lambda k: names[used[k]])
    place = np.argsort(by_name)[place] if by_name else place
    order = np.argsort(slot, kind="stable")
    total = np.bincount(place, n, minlength=used.size) + 0.1 * SLOTS
    return [names[used[k]] for k in by_name], Trigrams(
        np.log(0.1 / total),
        np.concatenate(([0], np.cumsum(np.bincount(slot, minlength=SLOTS)))),
        place[order].astype(np.int32),
        np.log1p(n[order] / 0.1).astype(np.float32),
    )


def _likelihoods(rows: DataFrame, trigrams: Trigrams) -> DataFrame:
    """``rows`` (evidence columns and ``text``) with ``ll`` in place of the text: tempered
    log likelihoods of the languages and of ``und``; null without trigrams."""
    names = [c for c in rows.columns if c != "text"]
    at = rows.columns.index("text")
    schema = rows.select(*names).schema.add("ll", T.ArrayType(T.DoubleType()))
    shared = rows.sparkSession.sparkContext.broadcast(tuple(trigrams))
    flat = -np.log(SLOTS)
    size = trigrams.base.size + 1

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Trigrams(*shared.value)
        for batch in _pieces(batches, size):
            out = []
            for value in batch.column(at):
                n, sums = 0, np.zeros(size - 1)
                for slots in _slots(value.as_py() or ""):
                    n += slots.size
                    sums += model.sums(slots)
                weight = TEMPER * min(n, FULL_TRIGRAMS) / n if n else 0.0
                out.append(np.append(sums, flat * n) * weight if n else None)
            columns = [c for k, c in enumerate(batch.columns) if k != at]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(out, pa.list_(pa.float64()))], names=[*names, "ll"]
            )

    return rows.mapInArrow(lean(score), schema)


def _softmax(logs: np.ndarray) -> np.ndarray:
    powers = np.exp(logs - logs.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def _matrix(lists: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of lists of ``size`` numbers, zero where null; a column telling which are not null)."""
    there = lists.is_valid().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), size))
    out[there] = lists.drop_null().flatten().to_numpy().reshape(-1, size)
    return out, there[:, None]


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a matrix of ``size`` columns stays small."""
    at_once = max(1, _PART // size)
    for batch in batches:
        for start in range(0, batch.num_rows, at_once):
            yield batch.slice(start, at_once)


def _sums(rows: DataFrame, key: Column, name: str, size: int) -> DataFrame:
    """Soft counts per value of ``key``: an array with one sum per class. ``rows`` has ``ll``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, size):
            keys = batch.column(0).dictionary_encode()
            place = keys.indices.to_numpy()
            order = np.argsort(place, kind="stable")
            p = _softmax(_matrix(batch.column(1), size)[0])[order]
            starts = np.searchsorted(place[order], np.arange(len(keys.dictionary)))
            sums = pa.array(list(np.add.reduceat(p, starts)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([keys.dictionary, sums], names=[name, "s"])

    parts = rows.where("ll IS NOT NULL").select(key.alias(name), "ll").where(F.col(name).isNotNull())
    groups = parts.mapInArrow(lean(add), f"{name} string, s array<double>").groupBy(name)
    if size > SUM_COLUMNS:
        total = groups.agg(Summarizer.sum(array_to_vector("s")).alias("s"))
        return total.select(name, vector_to_array("s").alias(f"n_{name}"))
    total = groups.agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(size)])
    return total.select(name, F.array(*[f"s{i}" for i in range(size)]).alias(f"n_{name}"))


def _smoothed(counts: tuple[np.ndarray, np.ndarray], parent: np.ndarray, weight: float) -> np.ndarray:
    """Distributions over classes, pulled towards the parent's."""
    n, there = counts
    return np.where(there, (n + weight * parent) / (n.sum(axis=1, keepdims=True) + weight), parent)


def _fused(rows: DataFrame, classes: list[str], world: np.ndarray) -> DataFrame:
    """(id, print, language, confidence) from ``ll`` and the counts by kind of evidence."""
    kinds = ("host", "domain", "declared", "suffix")
    size = len(classes)

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, size):
            fused, known = _matrix(batch.column(2), size)
            host, domain, *others = (_matrix(batch.column(3 + k), size) for k in range(len(kinds)))
            fused += np.log(_smoothed(host, _smoothed(domain, world, DOMAIN_WEIGHT), HOST_WEIGHT))
            for counts in others:
                # log P(value | class) up to a constant of the value.
                fused += np.log(_smoothed(counts, world, TABLE_WEIGHT) / world)
            p, known = _softmax(fused), known[:, 0]
            language = [classes[k] if ok else UNKNOWN for k, ok in zip(p.argmax(axis=1), known, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(language, pa.string()),
                    pa.array(np.where(known, p.max(axis=1), 0.0)),
                ],
                names=["id", "print", "language", "confidence"],
            )

    schema = rows.select("id", "print").schema.add("language", T.StringType()).add("confidence", T.DoubleType())
    return rows.select("id", "print", "ll", *[f"n_{k}" for k in kinds]).mapInArrow(lean(fuse), schema)


def _clean(c: Column | None) -> Column:
    """An evidence in lower case; null where there is none."""
    if c is None:
        return F.lit(None).cast("string")
    c = F.lower(F.trim(c.cast("string")))
    return F.when(c != "", c)


def _mark(text: Column, evidence: Iterable[Column]) -> Column:
    """Hash of all that a verdict rests on: rows of one id with other text or other
    evidence have verdicts of their own."""
    told = [F.coalesce(F.concat(F.lit("="), c), F.lit("")) for c in evidence]
    return F.xxhash64(text_hash(text), *told)


def identify(
    docs: DataFrame,
    model: tuple[list[str], Trigrams],
    id_col: str = "doc_id",
    text_col: str = "text",
    declared: Column | None = None,
    suffix: Column | None = None,
    host: Column | None = None,
    domain: Column | None = None,
) -> DataFrame:
    """Per row: id, hash of text and evidence (print), language, confidence (its posterior), and
    whether it is accepted.

    The evidence is given as columns over ``docs``; what is left out is missing.
    """
    labels, trigrams = model
    classes = [*labels, UNKNOWN]
    size = len(classes)
    evidence = {
        k: _clean(c) for k, c in (("declared", declared), ("suffix", suffix), ("host", host), ("domain", domain))
    }
    rows = docs.select(
        F.col(id_col).alias("id"),
        _mark(F.col(text_col), evidence.values()).alias("print"),
        *[c.alias(k) for k, c in evidence.items()],
        F.col(text_col).cast("string").alias("text"),
    )
    # Everything after this works on narrow rows.
    scored = materialise(_likelihoods(rows, trigrams), "likelihoods")
    totals = _sums(scored, F.lit(""), "all", size).first()
    counts = np.array(totals["n_all"]) if totals else np.zeros(size)
    world = (counts + 1.0) / (counts.sum() + size)

    out = scored
    for key in ("host", "domain", "declared", "suffix"):
        out = out.join(materialise(_sums(scored, F.col(key), key, size), f"by-{key}"), key, "left")
    return (
        _fused(out, classes, world)
        .withColumnRenamed("id", id_col)
        .withColumn("accepted", (F.col("language") != UNKNOWN) & (F.col("confidence") >= CONFIDENCE))
    )


def accepted(
    docs: DataFrame,
    model: tuple[list[str], Trigrams],
    id_col: str = "doc_id",
    text_col: str = "text",
    declared: Column | None = None,
    suffix: Column | None = None,
    host: Column | None = None,
    domain: Column | None = None,
) -> DataFrame:
    """The documents, all columns, whose language is known well enough, row by row."""
    found = identify(docs, model, id_col, text_col, declared, suffix, host, domain)
    gone = materialise(
        found.where("NOT accepted").select(F.col(id_col).alias("id"), "print").distinct(), "no-language"
    )
    mark = _mark(F.col(text_col), [_clean(c) for c in (declared, suffix, host, domain)])
    return without(docs, gone, id_col, text_col, mark=mark)


def address(url: Column) -> dict[str, Column]:
    """Host, domain (its last two labels) and suffix (its last one) of an address."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)
    return {
        "host": host,
        "domain": F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1),
        "suffix": F.regexp_extract(host, r"\.([^.]+)$", 1),
    }


def declared_in(html: Column) -> Column:
    """The primary subtag of the markup's language attribute."""
    return F.regexp_extract(html, r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([a-z]+)", 1)


def visible_text(html: Column) -> Column:
    """Text of a page without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"&[#a-zA-Z0-9]+;", " ")
