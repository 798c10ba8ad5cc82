"""The papers view over ``documents``, and its SQL twin.

The given tables hold texts without bibliographic fields. The view derives these
from the document number, with nulls, bad dates, nested parentheses and codes
without a slash at fixed places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import scalars
from quire.plans.registry import table

LANGUAGES = ["de", "en", "es", "fr"]
MISSING_CODE, UNUSED_CODE = "en.src1", "zz.unused"


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")

    def number(value) -> F.Column:
        return value.cast("string")

    code = F.concat_ws(".", "lang", "source")
    return table(spark, sf_dir, "documents").select(
        number(d).alias("id"),
        F.when(d % 37 == 0, F.lit(None))
        .when(d % 41 == 0, F.lit("bad-date"))
        .otherwise(F.concat(number(1988 + d % 34), F.lit("-05-23")))
        .alias("update_date"),
        F.concat(
            F.lit("Ann A"), number(d % 23), F.lit(" (Inst (Dept "), number(d % 5),
            F.lit(")), Bo B-"), number(d % 17), F.lit(" and Cy C"), number(d % 11),
            F.when(d % 7 == 0, F.lit(", et al")).otherwise(F.lit("")),
        ).alias("author"),
        F.when(d % 53 != 0, F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"),
        F.col("text").alias("abstract"),
        F.when(d % 29 == 0, F.concat(code, F.lit(" "), "lang", F.lit(".src0")))
        .otherwise(code)
        .alias("categories"),
        F.when(d % 3 != 0, F.concat(F.lit("J"), number(d % 12))).alias("journal"),
        F.when(d % 4 == 0, F.lit(None))
        .when(d % 43 == 0, F.concat(F.lit("10."), number(1000 + d % 50), F.lit("x"), number(d)))
        .otherwise(F.concat(F.lit("10."), number(1000 + d % 50), F.lit("/x"), number(d)))
        .alias("doi"),
    ).withColumn("general_category", scalars.general_category(F.col("categories")))


PAPERS = """papers AS (
  SELECT CAST(doc_id AS VARCHAR) AS id,
    CASE WHEN doc_id % 37 = 0 THEN NULL WHEN doc_id % 41 = 0 THEN 'bad-date'
         ELSE CAST(1988 + doc_id % 34 AS VARCHAR) || '-05-23' END AS update_date,
    'Ann A' || (doc_id % 23) || ' (Inst (Dept ' || (doc_id % 5) || ')), Bo B-' || (doc_id % 17)
      || ' and Cy C' || (doc_id % 11) || CASE WHEN doc_id % 7 = 0 THEN ', et al' ELSE '' END AS author,
    CASE WHEN doc_id % 53 <> 0 THEN split_part(text, chr(10), 1) END AS title,
    text AS abstract,
    lang || '.' || source || CASE WHEN doc_id % 29 = 0 THEN ' ' || lang || '.src0' ELSE '' END AS categories,
    CASE WHEN doc_id % 3 <> 0 THEN 'J' || (doc_id % 12) END AS journal,
    CASE WHEN doc_id % 4 = 0 THEN NULL
         WHEN doc_id % 43 = 0 THEN '10.' || (1000 + doc_id % 50) || 'x' || doc_id
         ELSE '10.' || (1000 + doc_id % 50) || '/x' || doc_id END AS doi,
    lang AS general_category
  FROM documents)"""


def dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes in use but one, plus one that no paper carries."""
    codes = (
        table(spark, sf_dir, "documents")
        .select(F.concat_ws(".", "lang", "source").alias("code"))
        .distinct()
        .where(F.col("code") != MISSING_CODE)
    )
    unused = spark.createDataFrame([(UNUSED_CODE,)], "code string")
    return codes.unionByName(unused).withColumn("name", F.concat(F.lit("Topic "), "code"))


DIMENSION = f"""dim AS (
  SELECT DISTINCT lang || '.' || source AS code FROM documents
  WHERE lang || '.' || source <> '{MISSING_CODE}'
  UNION ALL SELECT '{UNUSED_CODE}')"""

SPACE_CLASS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NON_SPACE_CLASS = "[^" + SPACE_CLASS[1:]


def author_list_sql(column: str = "author") -> str:
    """The cleaning chain; two passes reach the depth the view has."""
    text = rf"regexp_replace(regexp_replace({column}, '\([^()]*\)', '', 'g'), '\([^()]*\)', '', 'g')"
    text = f"regexp_replace({text}, '{SPACE_CLASS}and{SPACE_CLASS}', ',', 'g')"
    text = f"regexp_replace(replace({text}, ', et al', ''), ',{{2,}}', ',', 'g')"
    kept = rf"regexp_replace(a, '[^\p{{L}}\p{{N}}_' || '{SPACE_CLASS[1:]}', '', 'g')"
    name = f"trim(regexp_replace(lower({kept}), '{SPACE_CLASS}+', ' ', 'g'))"
    return (
        f"list_filter(list_transform(string_split({text}, ','), lambda a: {name}), lambda a: a <> '')"
    )


YEARS = """dated AS (
  SELECT *, CAST(regexp_extract(update_date, '^([1-2][0-9]{3})', 1) AS INTEGER) AS year FROM papers
  WHERE regexp_matches(update_date, '^[1-2][0-9]{3}')
    AND CAST(regexp_extract(update_date, '^([1-2][0-9]{3})', 1) AS INTEGER) BETWEEN 1991 AND 2019)"""

AUTHORS = f"""authors AS (
  SELECT id, general_category, unnest({author_list_sql()}) AS author FROM papers)"""

YEAR_AUTHORS = f"""{YEARS},
year_authors AS (
  SELECT year, author, count(*) AS count
  FROM (SELECT year, unnest({author_list_sql()}) AS author FROM dated) GROUP BY ALL)"""

YEAR_CATEGORIES = f"""{YEARS},
year_categories AS (
  SELECT year, general_category, count(*) AS count FROM dated GROUP BY ALL)"""


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"
