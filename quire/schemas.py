"""Declared schemas; nothing in this package infers one."""

from pyspark.sql import types as T

VERSIONS = T.ArrayType(
    T.StructType(
        [T.StructField("version", T.StringType()), T.StructField("created", T.StringType())]
    )
)

RAW_PAPER = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("update_date", T.StringType()),
        T.StructField("authors", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("abstract", T.StringType()),
        T.StructField("categories", T.StringType()),
        T.StructField("journal-ref", T.StringType()),
        T.StructField("versions", VERSIONS),
        T.StructField("doi", T.StringType()),
    ]
)

# Column order of the projected papers table; general_category is derived last.
PAPER_COLUMNS = [
    "id",
    "update_date",
    "author",
    "title",
    "abstract",
    "categories",
    "journal",
    "versions",
    "doi",
    "general_category",
]

PAPER_TEXT_TABLE = T.StructType(
    [T.StructField(c, T.StringType()) for c in PAPER_COLUMNS if c != "versions"]
)
