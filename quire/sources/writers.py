"""Text sinks. Parquet is the format between stages; these are for export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Stands before a letter in place of what would break a line or be lost in delimited text.
MARK = "\x1b"
_LETTERS = {MARK: "s", "\n": "n", "\r": "r"}
_EMPTY = MARK + "e"


def one_line(value: Column) -> Column:
    """A text without line breaks, from which ``many_lines`` has the text again."""
    out = value
    for char, letter in _LETTERS.items():
        out = F.replace(out, F.lit(char), F.lit(MARK + letter))
    return F.when(value == "", _EMPTY).otherwise(out)


def many_lines(value: Column) -> Column:
    """The text that ``one_line`` was given; a text without MARK is left as it is."""
    out = value
    for char, letter in reversed(_LETTERS.items()):
        out = F.replace(out, F.lit(MARK + letter), F.lit(char))
    return F.when(value == _EMPTY, "").otherwise(out)


def write_table(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    """Delimited text with a header, one line per row, so that a file can be read by
    many tasks: quotes are doubled, all fields quoted, and in texts a line break,
    carriage return, escape character and the empty text are written as MARK and a
    letter. ``readers.read_table`` undoes that."""
    flat = df.select(
        *[one_line(F.col(f"`{n}`")).alias(n) if kind == "string" else F.col(f"`{n}`") for n, kind in df.dtypes]
    )
    (
        flat.write.mode(mode)
        .option("sep", sep)
        .option("header", True)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_papers_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_vectors(df: DataFrame, path: str, id_col: str = "id", vector: str = "vector") -> None:
    """One line per row: the id, then the vector's numbers."""
    line = F.concat_ws(
        ",", F.col(id_col).cast("string"), F.array_join(F.col(vector).cast("array<double>").cast("array<string>"), ",")
    )
    df.select(line.alias("value")).write.text(path)


def report_lines(report: DataFrame, confusion: DataFrame, classes: list) -> DataFrame:
    """A classification report and a confusion matrix as ordered text lines.

    Both inputs have a few rows per class.
    """
    header = f"{'class':>14} {'precision':>9} {'recall':>9} {'f1':>9} {'support':>9}"
    spark = report.sparkSession
    width = 6
    titles = spark.createDataFrame(
        [
            (0, 0, "Classification Report"),
            (0, 1, header),
            (2, 0, "Confusion Matrix"),
            (2, 1, " " * 14 + "".join(f" {c!s:>{width}}" for c in classes)),
        ],
        "part int, place int, line string",
    )
    body = report.select(
        F.lit(1).alias("part"),
        F.col("place").cast("int").alias("place"),
        F.format_string(
            "%14s %9.4f %9.4f %9.4f %9d", "class", "precision", "recall", "f1", "support"
        ).alias("line"),
    )
    cells = confusion.groupBy("label").pivot("prediction", classes).agg(F.max("n"))
    matrix = cells.select(
        F.lit(3).alias("part"),
        F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label"))
        .cast("int")
        .alias("place"),
        F.format_string(
            "%14s" + f" %{width}d" * len(classes), "label", *[F.col(f"`{c}`") for c in classes]
        ).alias("line"),
    )
    return titles.unionByName(body).unionByName(matrix)


def write_report(lines: DataFrame, path: str) -> None:
    """The report has a few lines per class, so one output file is enough."""
    lines.orderBy("part", "place").select("line").coalesce(1).write.text(path)
