"""Line dedup by spread over sites.

A line that stands on many sites is boilerplate, however often a single site
repeats it. The number of distinct sites of a line is estimated by HyperLogLog
sketches that merge in the aggregation (so a line on a third of all documents
leaves each task as one sketch). Only lines whose estimate is too close to the
threshold to be sure get an exact count of distinct sites.

A line is compared without white space at its ends; lines of white space alone
are never removed. Lines with fewer documents than the threshold are dropped
before any sketch is made.

Defined cases: a null text has no line and stays null; a null site is a site of
its own; an empty text stays; repeated rows count once per site anyway and each
keep their row; an empty table gives an empty one; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import SENT_KEYS, SPACES, lean, own_prefix, text_hash
from quire.session import materialise

#: Sites from which on a line is boilerplate, and the sketch's size (log2 of registers).
SITES, LOG_REGISTERS = 10, 12
_PYTHON_SPACES = SPACES.encode()


def _bare_lines(text: Column) -> Column:
    """Distinct lines of a text without white space at the ends and empty ones."""
    bare = F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)))
    return F.filter(F.array_distinct(bare), lambda x: x != "")


def _doc_lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(id, print, site, line hash), once per document and line."""
    text = F.col(text_col).cast("string")
    return docs.select(
        F.col(id_col).alias("id"),
        text_hash(text).alias("print"),
        F.coalesce(F.col(site_col).cast("string"), F.lit("\x00")).alias("site"),
        F.explode(_bare_lines(text)).alias("line"),
    ).select("id", "print", "site", F.xxhash64("line").alias("h"))


def spread(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = SITES
) -> DataFrame:
    """(h, sites, exact) of every line that stands on ``sites`` sites or more.

    ``sites`` is exact where ``exact`` says so, else the sketch's estimate, which is
    then clear of the threshold by four standard errors.
    """
    lines = _doc_lines(docs, id_col, text_col, site_col).select("h", "site")
    often = lines.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") >= sites).select("h")
    often = materialise(often, "frequent-lines")
    likely = lines.join(often, "h")
    sketched = materialise(
        likely.groupBy("h").agg(
            F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_REGISTERS))).alias("estimate")
        ),
        "line-sketches",
    )
    margin = 4 * 1.04 / (1 << LOG_REGISTERS) ** 0.5 * sites + 1
    near = sketched.where(F.abs(F.col("estimate") - sites) <= margin).select("h")
    counted = (
        lines.join(near, "h").distinct().groupBy("h").agg(F.count("*").alias("sites")).where(F.col("sites") >= sites)
    )
    clear = sketched.where(F.col("estimate") > sites + margin).select(
        "h", F.col("estimate").alias("sites"), F.lit(False).alias("exact")
    )
    return clear.unionByName(counted.select("h", "sites", F.lit(True).alias("exact")))


def _found(
    docs: DataFrame, id_col: str, text_col: str, site_col: str, sites: int
) -> DataFrame:
    """(id, print, bad): the boilerplate line hashes of each document that has some."""
    bad = materialise(spread(docs, id_col, text_col, site_col, sites).select("h"), "boilerplate")
    if bad.count() <= SENT_KEYS:
        bad = F.broadcast(bad)
    return materialise(
        _doc_lines(docs, id_col, text_col, site_col)
        .join(bad, "h")
        .groupBy("id", "print")
        .agg(F.collect_set("h").alias("bad")),
        "bad-lines",
    )


def removed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    sites: int = SITES,
    counts: tuple[str, str] | None = None,
) -> DataFrame:
    """The documents, all columns, without boilerplate lines.

    ``counts`` names two more columns, the lines of a text and how many were
    removed (they replace columns of these names).
    """
    found = _found(docs, id_col, text_col, site_col, sites)
    p = own_prefix(docs)
    named = found.select(
        F.col("id").alias(f"{p}id"), F.col("print").alias(f"{p}print"), F.col("bad").alias(f"{p}bad")
    )
    keys = named.drop(f"{p}bad")
    if found.count() <= SENT_KEYS:
        keys = F.broadcast(keys)
    same = (text_hash(F.col(text_col)) == F.col(f"{p}print")) & F.col(id_col).eqNullSafe(F.col(f"{p}id"))
    columns = [c for c in docs.columns if c not in (counts or ())]
    rows = docs.select(*columns)
    touched = rows.join(keys, same, "left_semi").join(named, same).drop(f"{p}id", f"{p}print")
    hashed = touched.withColumn(
        f"{p}lines",
        F.transform(
            F.split(F.col(text_col).cast("string"), "\n"),
            lambda x: F.xxhash64(F.btrim(x, F.lit(SPACES))),
        ),
    )
    at = columns.index(text_col)
    schema = rows.select(*columns).schema
    for name in counts or ():
        schema = schema.add(name, "long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                bad = set(row.column(len(columns))[0].as_py())
                lines = row.column(at)[0].as_py().split("\n")
                kept = [
                    line
                    for line, h in zip(lines, row.column(len(columns) + 1)[0].as_py(), strict=True)
                    if h not in bad or not line.encode().strip(_PYTHON_SPACES)
                ]
                out = list(row.columns[: len(columns)])
                out[at] = pa.array(["\n".join(kept)], pa.string())
                names = list(columns)
                if counts:
                    out += [pa.array([len(lines)], pa.int64()), pa.array([len(lines) - len(kept)], pa.int64())]
                    names += counts
                yield pa.RecordBatch.from_arrays(out, names=names)

    as_is = rows.join(keys, same, "left_anti")
    if counts:
        n = F.coalesce(F.size(F.split(F.col(text_col).cast("string"), "\n")), F.lit(0))
        n = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(n)
        as_is = as_is.select("*", n.cast("long").alias(counts[0]), F.lit(0).cast("long").alias(counts[1]))
    return hashed.mapInArrow(lean(cut), schema).unionByName(as_is)
