"""Queries over sources, sinks, projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import scalars
from quire.operators import joins, ordering, papers as ops
from quire.plans.registry import query, table
from quire.plans.views import (
    AUTHORS,
    DIMENSION,
    PAPERS,
    YEARS,
    author_list_sql,
    dimension,
    papers,
    with_views,
)
from quire.schemas import PAPER_TEXT_TABLE
from quire.session import scratch_path
from quire.sources import readers, writers
from quire.streaming.ingest import ingest_stream, stream_papers_json


def raw_records(spark, sf_dir):
    """The view in the shape of the metadata snapshot, one record per paper."""
    version = F.struct(F.lit("v1").alias("version"), F.col("update_date").alias("created"))
    return papers(spark, sf_dir).select(
        "id", "update_date", F.col("author").alias("authors"), "title", "abstract", "categories",
        F.col("journal").alias("journal-ref"), F.array(version).alias("versions"), "doi",
    )


def written_json(spark, sf_dir):
    path = scratch_path(spark, "snapshot")
    writers.write_papers_json(raw_records(spark, sf_dir), path)
    return path


SHORT = """id, update_date, author, title, md5(abstract) AS abstract_md5, categories, journal, doi,
  general_category"""


def short(df, *more):
    return df.select(
        "id", "update_date", "author", "title", F.md5("abstract").alias("abstract_md5"),
        "categories", "journal", "doi", "general_category", *more,
    )


@query("S1 S14 P1", with_views(PAPERS) + f"SELECT {SHORT}, 1::BIGINT AS n_versions FROM papers")
def json_lines(spark, sf_dir):
    df = ops.project_papers(readers.read_papers_json(spark, written_json(spark, sf_dir)))
    return short(df, F.size("versions").cast("bigint").alias("n_versions"))


@query(
    "S2",
    with_views(PAPERS)
    + """, opening AS (SELECT id, update_date, author, title, abstract, categories, journal, doi,
  general_category FROM papers ORDER BY id LIMIT 1)
SELECT key, value FROM opening UNPIVOT INCLUDE NULLS (value FOR key IN (id, update_date, author,
  title, abstract, categories, journal, doi, general_category))""",
)
def peek(spark, sf_dir):
    return ops.peek(papers(spark, sf_dir))


@query(
    "S3",
    with_views(PAPERS)
    + """SELECT id, TRY_CAST(substr(update_date, 1, 4) AS INTEGER) AS year FROM papers
WHERE CAST(id AS BIGINT) % 10 <> 0 AND TRY_CAST(substr(update_date, 1, 4) AS INTEGER) IS NOT NULL""",
)
def bad_records(spark, sf_dir):
    """Every tenth line is cut off; dates without a year are skipped."""
    record = F.to_json(F.struct("*"))
    line = F.when(F.col("id").cast("bigint") % 10 == 0, F.left(record, F.lit(12))).otherwise(record)
    path = scratch_path(spark, "broken")
    raw_records(spark, sf_dir).select(line.alias("value")).write.text(path)
    df = readers.read_papers_json(spark, path, bad_records="drop")
    year = scalars.year_of(F.col("update_date"))
    return df.select("id", year.alias("year")).where(F.col("year").isNotNull())


def written_table(spark, sf_dir, sep, columns=None):
    path = scratch_path(spark, "table")
    writers.write_table(columns or papers(spark, sf_dir), path, sep)
    return path


@query("S4 S8", with_views(PAPERS) + f"SELECT {SHORT} FROM papers")
def tsv_round_trip(spark, sf_dir):
    path = written_table(spark, sf_dir, "\t")
    return short(readers.read_table(spark, path, PAPER_TEXT_TABLE, "\t"))


@query("S5 S9", with_views(PAPERS) + f"SELECT {SHORT} FROM papers")
def csv_round_trip(spark, sf_dir):
    """With a leading row-number column that the reader skips."""
    numbered = ordering.dense_position(papers(spark, sf_dir), "id", "row")
    df = numbered.select(F.col("row").cast("string").alias("_row"), *PAPER_TEXT_TABLE.names)
    path = written_table(spark, sf_dir, ",", df)
    return short(readers.read_table(spark, path, PAPER_TEXT_TABLE, ",", index_col=True))


@query("S6", with_views(PAPERS) + f"SELECT {SHORT} FROM papers ORDER BY id LIMIT 400")
def first_rows_of_file(spark, sf_dir):
    path = written_table(spark, sf_dir, "\t")
    return short(readers.read_table(spark, path, PAPER_TEXT_TABLE, "\t", nrows=400))


@query(
    "S7 S10",
    """SELECT vec_id AS id, len(embedding)::INTEGER AS width,
  round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings""",
)
def vector_file(spark, sf_dir):
    path = scratch_path(spark, "vectors")
    writers.write_vectors(table(spark, sf_dir, "embeddings"), path, "vec_id", "embedding")
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return readers.read_vectors(spark, path).select(
        "id", F.size("vector").alias("width"), F.round(total, 6).alias("total")
    )


# Some codes of the public subject list, and some that never were on it.
LISTED = ["astro-ph", "cs.AI", "cs.LG", "hep-th", "math.CO", "quant-ph", "stat.ML"]
UNLISTED = ["cs.XX", "foo.bar", "cs", "CS.AI", "cs.AI cs.LG"]


def coded(spark, sf_dir):
    """Papers whose category is one of these codes, by turns."""
    codes = F.array(*[F.lit(c) for c in LISTED + UNLISTED])
    turn = F.pmod(F.col("id").cast("bigint"), F.lit(len(LISTED + UNLISTED))).cast("int")
    return papers(spark, sf_dir).withColumn("categories", F.get(codes, turn))


CODED = f"""coded AS (SELECT * REPLACE ({LISTED + UNLISTED}[(CAST(id AS BIGINT) % {len(LISTED + UNLISTED)}) + 1] AS categories)
  FROM papers)"""


@query(
    "S12 J2 U1",
    with_views(PAPERS, CODED)
    + f"SELECT DISTINCT categories AS code FROM coded WHERE categories IN ({str(UNLISTED)[1:-1]})",
)
def unknown_subjects(spark, sf_dir):
    """Codes of the corpus that the fixed subject list lacks."""
    return joins.unknown_categories(coded(spark, sf_dir), readers.category_dim(spark))


@query(
    "P2 J1 S12",
    with_views(PAPERS, CODED)
    + f"""SELECT id, categories, update_date FROM coded WHERE categories IN ({str(LISTED)[1:-1]})
AND TRY_CAST(substr(update_date, 1, 4) AS INTEGER) > 1991
AND TRY_CAST(substr(update_date, 1, 4) AS INTEGER) < 2010""",
)
def ingest_filter_by_subject(spark, sf_dir):
    """The ingest filter with the fixed subject list."""
    kept = ops.ingest_filter(coded(spark, sf_dir), readers.category_dim(spark))
    return kept.select("id", "categories", "update_date")


@query(
    "P2 J1",
    with_views(PAPERS, DIMENSION)
    + f"""SELECT {SHORT} FROM papers WHERE categories IN (SELECT code FROM dim)
AND TRY_CAST(substr(update_date, 1, 4) AS INTEGER) > 1991
AND TRY_CAST(substr(update_date, 1, 4) AS INTEGER) < 2010""",
)
def ingest_filter(spark, sf_dir):
    return short(ops.ingest_filter(papers(spark, sf_dir), dimension(spark, sf_dir)))


@query(
    "S1 P1 P2",
    with_views(PAPERS, DIMENSION)
    + f"""SELECT {SHORT} FROM papers WHERE categories IN (SELECT code FROM dim)
AND TRY_CAST(substr(update_date, 1, 4) AS INTEGER) > 1991
AND TRY_CAST(substr(update_date, 1, 4) AS INTEGER) < 2010""",
)
def ingest_stream_of_files(spark, sf_dir):
    """The same filter fed by a file stream."""
    raw = stream_papers_json(spark, written_json(spark, sf_dir))
    out = scratch_path(spark, "ingested")
    job = ingest_stream(raw, dimension(spark, sf_dir), out, scratch_path(spark, "progress"))
    job.awaitTermination()
    schema = T.StructType([f for f in PAPER_TEXT_TABLE])
    return short(spark.read.schema(schema).parquet(out))


@query(
    "P3 F15",
    with_views(PAPERS)
    + """SELECT count(*) AS n_papers, count(doi) AS n_doi, count(journal) AS n_journal,
  count(*) FILTER (doi IS NOT NULL AND journal IS NOT NULL) AS n_both FROM papers""",
)
def doi_journal_counts(spark, sf_dir):
    return ops.doi_journal_counts(papers(spark, sf_dir))


@query("P3", with_views(PAPERS) + "SELECT id, doi FROM papers WHERE doi IS NOT NULL AND journal IS NOT NULL")
def doi_and_journal(spark, sf_dir):
    return ops.with_journal(ops.with_doi(papers(spark, sf_dir))).select("id", "doi")


@query("P4", with_views(PAPERS) + "SELECT id, md5(abstract) AS abstract_md5 FROM papers WHERE abstract IS NOT NULL")
def with_abstract(spark, sf_dir):
    return ops.with_abstract(papers(spark, sf_dir)).select("id", F.md5("abstract").alias("abstract_md5"))


@query(
    "P5 P14 F17",
    with_views(PAPERS)
    + r"""SELECT id, n_words FROM (SELECT id,
  len(regexp_extract_all(coalesce(title, 'nan'), '[^\s\x{a0}]+'))::INTEGER AS n_words FROM papers)
WHERE n_words >= 10""",
)
def titles_of_ten_words(spark, sf_dir):
    """On titles, so that null texts count as one word and drop out."""
    return ops.min_words(papers(spark, sf_dir), text="title").select("id", "n_words")


@query("P6", with_views(PAPERS) + "SELECT id, title, doi FROM papers WHERE title IS NOT NULL AND doi IS NOT NULL")
def drop_incomplete(spark, sf_dir):
    return ops.drop_incomplete(papers(spark, sf_dir), ["title", "doi"]).select("id", "title", "doi")


@query(
    "P7",
    with_views(PAPERS)
    + """SELECT id, coalesce(update_date, '') AS update_date, coalesce(title, '') AS title,
  coalesce(journal, '') AS journal, coalesce(doi, '') AS doi FROM papers""",
)
def blank_nulls(spark, sf_dir):
    return ops.blank_nulls(papers(spark, sf_dir)).select("id", "update_date", "title", "journal", "doi")


@query("P8", with_views(PAPERS) + "SELECT * EXCLUDE (general_category, abstract) FROM papers")
def drop_label(spark, sf_dir):
    features, _ = ops.features_and_label(papers(spark, sf_dir), "general_category")
    return features.drop("abstract")


@query("P9", with_views(PAPERS) + "SELECT id, general_category FROM papers")
def label_column(spark, sf_dir):
    return ops.features_and_label(papers(spark, sf_dir), "general_category")[1]


@query(
    "P9b F7 F8",
    with_views(PAPERS) + f"SELECT id, array_to_string({author_list_sql()}, ',') AS authors FROM papers",
)
def authors_per_paper(spark, sf_dir):
    return ops.authors_per_paper(papers(spark, sf_dir)).select(
        "id", F.array_join("authors", ",").alias("authors")
    )


@query(
    "P10",
    with_views(PAPERS)
    + "SELECT id, CAST(general_category = 'fr' AS INTEGER) AS target FROM papers",
)
def binary_target(spark, sf_dir):
    return ops.binary_target(papers(spark, sf_dir), "fr").select("id", "target")


@query("P10", with_views(PAPERS) + "SELECT id, categories FROM papers WHERE general_category = 'fr'")
def category_slice(spark, sf_dir):
    return ops.category_slice(papers(spark, sf_dir), "fr").select("id", "categories")


@query("P11", "SELECT vec_id, label AS cluster FROM embeddings WHERE label = 3")
def cluster_slice(spark, sf_dir):
    clustered = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("cluster"))
    return ops.cluster_slice(clustered, 3)


@query(
    "P12",
    with_views(PAPERS)
    + "SELECT id, md5(title || abstract || author) AS text_md5 FROM papers",
)
def training_text(spark, sf_dir):
    df = ops.training_text(papers(spark, sf_dir), ["title", "abstract", "author"])
    return df.select("id", F.md5("training_text").alias("text_md5"))


@query("P13 F14", with_views(PAPERS, YEARS) + "SELECT id, year FROM dated")
def trend_years(spark, sf_dir):
    return ops.with_trend_year(papers(spark, sf_dir)).select("id", "year")


@query(
    "P15",
    "SELECT conv_id AS conversation, turn AS place, role AS speaker, md5(text) AS words FROM conversations",
)
def rename_columns(spark, sf_dir):
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.md5("text"))
    return ops.rename_columns(df, ["conversation", "place", "speaker", "words"])


@query("P16", with_views(PAPERS) + "SELECT count(*) AS n_rows, 9::BIGINT AS n_cols FROM papers")
def shape(spark, sf_dir):
    return ops.shape(papers(spark, sf_dir))


@query(
    "U6",
    with_views(PAPERS, AUTHORS) + "SELECT id, author FROM authors",
)
def flatten_authors(spark, sf_dir):
    return ops.exploded_authors(papers(spark, sf_dir), "id")
