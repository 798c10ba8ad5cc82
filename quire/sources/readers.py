"""Scans of the metadata snapshot, of text tables and of vector files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.constants import SUBJECTS
from quire.operators.ordering import first_n
from quire.schemas import RAW_PAPER
from quire.sources.writers import many_lines

_JSON_MODES = {"fail": "FAILFAST", "drop": "DROPMALFORMED"}


def read_papers_json(spark: SparkSession, path: str, bad_records: str = "fail") -> DataFrame:
    """One record per line. A malformed line fails the job, or is left out with
    ``bad_records="drop"``."""
    return spark.read.schema(RAW_PAPER).option("mode", _JSON_MODES[bad_records]).json(path)


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    sep: str = "\t",
    nrows: int | None = None,
    id_col: str = "id",
    index_col: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """Delimited text with a header line; quoted fields may hold doubled quotes.

    A file is read by many tasks, line by line. Line breaks that ``write_table`` wrote as
    marks are put back. A file with raw line breaks inside quotes fails (some line has an
    odd number of quotes, which one more scan of the lines finds): set ``multi_line``, with
    which a file is one task, and convert such files to Parquet once. ``index_col`` skips
    a leading row-number column. ``nrows`` keeps the rows with the smallest ids."""
    if index_col:
        schema = T.StructType([T.StructField("_c0", T.StringType()), *schema.fields])
    df = (
        spark.read.schema(schema)
        .option("sep", sep)
        .option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("enforceSchema", True)
        .csv(path)
    )
    if not multi_line:
        odd = F.length("value") - F.length(F.replace("value", F.lit('"')))
        broken = spark.read.text(path).agg(F.count_if(odd % 2 == 1)).scalar()
        message = "quoted fields with line breaks: read with multi_line=True"
        df = df.where(F.when(broken > 0, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)))
    texts = [f.name for f in schema.fields if f.dataType == T.StringType()]
    df = df.withColumns({n: many_lines(F.col(f"`{n}`")) for n in texts})
    if index_col:
        df = df.drop("_c0")
    return df if nrows is None else first_n(df, nrows, id_col)


def read_vectors(spark: SparkSession, path: str, with_id: bool = True) -> DataFrame:
    """A numeric matrix in comma-separated text without a header.

    A row's place in the file is no identity in a distributed scan, so files
    written by ``write_vectors`` start each line with the row id.
    """
    parts = F.transform(F.split("value", ","), lambda part: part.cast("double"))
    rows = spark.read.text(path).select(parts.alias("parts"))
    if not with_id:
        return rows.select(F.col("parts").alias("vector"))
    return rows.select(
        F.get("parts", F.lit(0)).cast("bigint").alias("id"),
        F.slice("parts", F.lit(2), F.size("parts") - 1).alias("vector"),
    )


def category_dim(spark: SparkSession) -> DataFrame:
    """(code, name) of every known subject."""
    return spark.createDataFrame(SUBJECTS, "code string, name string")
