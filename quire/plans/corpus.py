"""Queries over joins, counts, profiles, histograms and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import scalars
from quire.operators import histograms, joins, ordering, profile, quantiles, trends
from quire.plans.registry import query, table
from quire.plans.views import (
    AUTHORS,
    DIMENSION,
    LANGUAGES,
    NON_SPACE_CLASS,
    PAPERS,
    YEAR_AUTHORS,
    YEAR_CATEGORIES,
    YEARS,
    dimension,
    papers,
    with_views,
)
from quire.session import materialise, spread_small

TREND_YEARS = list(range(1991, 2020))


def written_year_authors(spark, sf_dir):
    """The yearly author counts as a written table: small next to the corpus, and
    read several times by the queries on top lists."""
    return materialise(trends.year_authors(papers(spark, sf_dir)), "year_authors")


def written_year_categories(spark, sf_dir):
    return materialise(trends.year_categories(papers(spark, sf_dir)), "year_categories")


# Joins -------------------------------------------------------------------------


@query(
    "J1",
    with_views(PAPERS, DIMENSION)
    + "SELECT id, categories FROM papers WHERE categories IN (SELECT code FROM dim)",
)
def known_categories(spark, sf_dir):
    return joins.known_categories(papers(spark, sf_dir), dimension(spark, sf_dir)).select("id", "categories")


@query(
    "J2 U1",
    with_views(PAPERS, DIMENSION)
    + "SELECT DISTINCT categories AS code FROM papers WHERE categories NOT IN (SELECT code FROM dim)",
)
def unknown_categories(spark, sf_dir):
    return joins.unknown_categories(papers(spark, sf_dir), dimension(spark, sf_dir))


@query(
    "J2 U1",
    with_views(PAPERS, DIMENSION)
    + "SELECT code FROM dim WHERE code NOT IN (SELECT categories FROM papers)",
)
def unused_categories(spark, sf_dir):
    return joins.unused_categories(papers(spark, sf_dir), dimension(spark, sf_dir))


EXCLUDED = ["bo b3", "ann a5", "cy c2", "japan"]


@query(
    "J3",
    with_views(PAPERS, YEAR_AUTHORS)
    + "SELECT * FROM year_authors WHERE author NOT IN ('bo b3', 'ann a5', 'cy c2', 'japan')",
)
def exclude_names(spark, sf_dir):
    return joins.exclude_names(trends.year_authors(papers(spark, sf_dir)), EXCLUDED)


# Places and affiliations that often stand between authors, and names close to them.
PLACES = ["Moscow", "CERN-Geneva", "The Netherlands", "Roma", "Romano", "et al.", "D. Collaboration"]


@query(
    "J3",
    with_views(PAPERS, f"""placed AS (SELECT * REPLACE (author || ', ' ||
  {PLACES}[(CAST(id AS BIGINT) % {len(PLACES)}) + 1] AS author) FROM papers)""",
        YEAR_AUTHORS.replace("FROM papers", "FROM placed", 1))
    + "SELECT * FROM year_authors WHERE author NOT IN ('moscow', 'the netherlands', 'roma', 'et al')",
)
def exclude_places(spark, sf_dir):
    """The fixed list on authors among whom places stand."""
    turn = F.pmod(F.col("id").cast("bigint"), F.lit(len(PLACES))).cast("int")
    place = F.get(F.array(*[F.lit(p) for p in PLACES]), turn)
    placed = papers(spark, sf_dir).withColumn("author", F.concat("author", F.lit(", "), place))
    return joins.exclude_names(trends.year_authors(placed))


@query(
    "J4",
    with_views(PAPERS)
    + """SELECT id, (SELECT count(DISTINCT p.general_category) FROM papers p
  WHERE p.general_category < papers.general_category)::INTEGER AS label_idx FROM papers""",
)
def label_index(spark, sf_dir):
    df = papers(spark, sf_dir)
    return joins.label_index(df, "general_category", df).select("id", "label_idx")


@query(
    "J5",
    with_views(PAPERS)
    + """SELECT p.id, title, quality FROM papers p
FULL JOIN (SELECT CAST(doc_id AS VARCHAR) AS id, quality FROM labels) l ON p.id = l.id""",
)
def align(spark, sf_dir):
    right = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), "quality")
    return joins.align(papers(spark, sf_dir).select("id", "title"), right)


@query(
    "J6 U3",
    with_views(PAPERS, YEAR_AUTHORS)
    + """SELECT * FROM year_authors WHERE author IN (SELECT author FROM (SELECT author,
  row_number() OVER (PARTITION BY year ORDER BY count DESC, author) AS r FROM year_authors) WHERE r <= 3)""",
)
def select_series(spark, sf_dir):
    counts = written_year_authors(spark, sf_dir)
    return joins.select_series(counts, trends.pooled_top(counts, 3), "author")


# Counts and groups --------------------------------------------------------------


@query("A1", with_views(PAPERS, AUTHORS) + "SELECT count(DISTINCT author) AS n_authors FROM authors")
def distinct_authors(spark, sf_dir):
    return profile.distinct_authors(papers(spark, sf_dir))


@query("A2", with_views(PAPERS, AUTHORS) + "SELECT author, count(*) AS n_papers FROM authors GROUP BY author")
def papers_per_author(spark, sf_dir):
    return profile.papers_per_author(papers(spark, sf_dir))


@query(
    "A3 F16",
    with_views(PAPERS)
    + r"SELECT count(DISTINCT nullif(regexp_extract(doi, '^[^/\n]*/', 0), '')) AS n_journals FROM papers",
)
def distinct_journals(spark, sf_dir):
    return profile.distinct_journals(papers(spark, sf_dir))


@query("A4", with_views(PAPERS) + "SELECT DISTINCT general_category FROM papers")
def distinct_categories(spark, sf_dir):
    return profile.distinct_values(papers(spark, sf_dir), "general_category")


@query("A4", with_views(PAPERS) + "SELECT count(DISTINCT general_category) AS n_categories FROM papers")
def n_categories(spark, sf_dir):
    return profile.n_distinct(papers(spark, sf_dir), "general_category", "n_categories")


@query(
    "A5",
    with_views(PAPERS)
    + """SELECT categories AS label, (row_number() OVER (ORDER BY categories) - 1)::INTEGER AS idx
FROM (SELECT DISTINCT categories FROM papers)""",
)
def label_dim(spark, sf_dir):
    return joins.label_dim(papers(spark, sf_dir), "categories")


@query(
    "A6",
    with_views(PAPERS)
    + """SELECT categories, count(*) AS count FROM papers GROUP BY categories
ORDER BY count DESC, categories LIMIT 17""",
)
def value_counts(spark, sf_dir):
    return profile.value_counts(papers(spark, sf_dir), "categories", 17)


@query(
    "A7",
    with_views(PAPERS)
    + """SELECT categories, count(id) AS id, count(update_date) AS update_date, count(author) AS author,
  count(title) AS title, count(abstract) AS abstract, count(journal) AS journal, count(doi) AS doi,
  count(general_category) AS general_category FROM papers GROUP BY categories""",
)
def group_non_null(spark, sf_dir):
    return profile.group_non_null(papers(spark, sf_dir), "categories")


@query(
    "A8",
    "SELECT l_returnflag, round(sum(l_quantity), 2) AS l_quantity FROM lineitem GROUP BY l_returnflag",
)
def group_sum(spark, sf_dir):
    sums = profile.group_sum(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity")
    return sums.select("l_returnflag", F.round("l_quantity", 2).alias("l_quantity"))


DESCRIBE = """SELECT count(x) AS count, round_even(avg(x), {d}) AS mean, round_even(stddev_samp(x), {d}) AS std,
  round_even(min(x)::DOUBLE, {d}) AS min, round_even(quantile_cont(x, 0.25)::DOUBLE, {d}) AS p25,
  round_even(quantile_cont(x, 0.5)::DOUBLE, {d}) AS p50, round_even(quantile_cont(x, 0.75)::DOUBLE, {d}) AS p75,
  round_even(max(x)::DOUBLE, {d}) AS max FROM """


@query(
    "A9 F21",
    with_views(PAPERS)
    + DESCRIBE.format(d=2)
    + "(SELECT count(*) AS x FROM papers GROUP BY categories)",
)
def describe_category_sizes(spark, sf_dir):
    sizes = papers(spark, sf_dir).groupBy("categories").agg(F.count("id").alias("id"))
    return quantiles.describe_counts(sizes, "id")


@query(
    "A9 F17 F21",
    with_views(PAPERS)
    + DESCRIBE.format(d=2)
    + f"(SELECT len(regexp_extract_all(abstract, '{NON_SPACE_CLASS}+')) AS x FROM papers)",
)
def describe_abstract_words(spark, sf_dir):
    counted = spread_small(papers(spark, sf_dir)).select(scalars.word_count(F.col("abstract"), True).alias("n"))
    return quantiles.describe_counts(counted, "n")


@query("A9", DESCRIBE.format(d=2) + "(SELECT l_extendedprice AS x FROM lineitem)")
def describe_prices(spark, sf_dir):
    return quantiles.describe_num(table(spark, sf_dir, "lineitem"), "l_extendedprice")


@query(
    "A10",
    with_views(PAPERS)
    + """, counts AS (SELECT categories AS v, count(*) AS n FROM papers GROUP BY ALL)
SELECT sum(n)::BIGINT AS count, count(*) AS unique,
  (SELECT v FROM counts ORDER BY n DESC, v LIMIT 1) AS top, max(n) AS freq FROM counts""",
)
def describe_categories(spark, sf_dir):
    return quantiles.describe_cat(papers(spark, sf_dir), "categories")


@query(
    "A14 U2",
    with_views(PAPERS, AUTHORS) + "SELECT DISTINCT general_category, author FROM authors",
)
def authors_by_category(spark, sf_dir):
    return profile.authors_by_category(papers(spark, sf_dir))


@query(
    "A15",
    with_views(PAPERS, AUTHORS)
    + "SELECT general_category, count(DISTINCT author) AS n_authors FROM authors GROUP BY ALL",
)
def authors_per_category(spark, sf_dir):
    return profile.authors_per_category(papers(spark, sf_dir))


@query(
    "A15 A9",
    with_views(PAPERS, AUTHORS)
    + DESCRIBE.format(d=2)
    + "(SELECT count(DISTINCT author) AS x FROM authors GROUP BY general_category)",
)
def describe_authors_per_category(spark, sf_dir):
    return quantiles.describe_counts(profile.authors_per_category(papers(spark, sf_dir)), "n_authors")


@query(
    "A1 A15",
    with_views(PAPERS, AUTHORS)
    + """SELECT general_category, count(DISTINCT author) AS n_exact, TRUE AS is_close FROM authors GROUP BY ALL
UNION ALL SELECT 'all', count(DISTINCT author), TRUE FROM authors""",
)
def sketched_authors(spark, sf_dir):
    """Authors per category and over all, rolled up from one written table of sketches by year
    and category, within four standard errors of the exact numbers."""
    rows = papers(spark, sf_dir)
    sketches = materialise(profile.author_sketches(rows), "sketches")
    whole = F.lit("all").alias("general_category")
    found = profile.sketched_authors(sketches, "general_category").unionByName(
        profile.sketched_authors(sketches).select(whole, "n_authors")
    )
    exact = profile.authors_per_category(rows).unionByName(profile.distinct_authors(rows).select(whole, "n_authors"))
    bound = 4 * 1.04 / 2 ** (profile.LOG_REGISTERS / 2)
    near = F.abs(F.col("n_authors") - F.col("n_exact")) <= 1 + bound * F.col("n_exact")
    return exact.withColumnRenamed("n_authors", "n_exact").join(found, "general_category").select(
        "general_category", "n_exact", near.alias("is_close")
    )


SPLIT = """split AS (SELECT *, row_number() OVER (ORDER BY md5('{seed}:' || {id}))
  <= ceil({share}::DOUBLE * count(*) OVER ()) AS is_test FROM {source})"""


@query(
    "A16 O9",
    with_views(PAPERS, SPLIT.format(seed=5, share=0.25, id="id", source="papers"))
    + """SELECT CASE WHEN is_test THEN 'test' ELSE 'train' END AS split, general_category, count(*) AS n
FROM split GROUP BY ALL""",
)
def label_counts(spark, sf_dir):
    parts = ordering.split_flag(papers(spark, sf_dir), "id", 0.25, 5)
    named = parts.withColumn("split", F.when(F.col("is_test"), "test").otherwise("train"))
    return profile.label_counts(named, "general_category")


# Histograms ---------------------------------------------------------------------

HIST = """, span AS (SELECT min(x)::DOUBLE - CASE WHEN min(x) = max(x) THEN 0.5 ELSE 0 END AS lo,
  max(x)::DOUBLE + CASE WHEN min(x) = max(x) THEN 0.5 ELSE 0 END AS hi FROM vals),
bins AS (SELECT i AS bin, lo + i * ((hi - lo) / 149) AS "left",
  CASE WHEN i = 148 THEN hi ELSE lo + (i + 1) * ((hi - lo) / 149) END AS "right", (hi - lo) / 149 AS w
  FROM range(149) t(i), span),
hist AS (SELECT bin, "left", "right", count(x) AS n, count(x) / (SELECT count(*) FROM vals) / w AS density
  FROM bins LEFT JOIN vals ON x >= "left" AND (x < "right" OR (bin = 148 AND x = "right"))
  GROUP BY bin, "left", "right", w)
"""


@query(
    "A17",
    with_views(PAPERS, "vals AS (SELECT count(*) AS x FROM papers GROUP BY categories)")
    + HIST
    + 'SELECT bin, round("left", 6) AS "left", n, round(density, 9) AS density FROM hist',
)
def hist_category_sizes(spark, sf_dir):
    sizes = papers(spark, sf_dir).groupBy("categories").agg(F.count("id").alias("n_papers"))
    return histograms.hist_density(sizes, "n_papers").select(
        "bin", F.round("left", 6).alias("left"), "n", F.round("density", 9).alias("density")
    )


@query(
    "A17",
    "WITH vals AS (SELECT l_extendedprice AS x FROM lineitem)"
    + HIST
    + 'SELECT bin, round("left", 6) AS "left", n, round(density, 12) AS density FROM hist',
)
def hist_prices(spark, sf_dir):
    return histograms.hist_density(table(spark, sf_dir, "lineitem"), "l_extendedprice").select(
        "bin", F.round("left", 6).alias("left"), "n", F.round("density", 12).alias("density")
    )


@query(
    "A18 F20",
    with_views(PAPERS)
    + f""", words AS (SELECT least(greatest(len(regexp_extract_all(abstract, '{NON_SPACE_CLASS}+')), 0), 400) AS x
  FROM papers),
bins AS (SELECT i AS bin FROM range(6) t(i))
SELECT bin * 50 AS "left", (bin + 1) * 50 AS "right", count(x) AS n
FROM bins LEFT JOIN words ON x >= bin * 50 AND (x < (bin + 1) * 50 OR (bin = 5 AND x = 300))
GROUP BY bin""",
)
def hist_abstract_words(spark, sf_dir):
    counted = spread_small(papers(spark, sf_dir)).select(scalars.word_count(F.col("abstract"), True).alias("n_words"))
    return histograms.hist_clipped(counted, "n_words")


@query(
    "A19",
    with_views(PAPERS, "vals AS (SELECT count(*) AS x FROM papers GROUP BY categories)")
    + HIST
    + """, edges AS (SELECT "left" AS edge FROM hist UNION ALL SELECT max("right") FROM hist)
SELECT round(edge, 6) AS edge, round((edge - min(edge) OVER ()) / stddev_pop(edge) OVER (), 6) AS scaled
FROM edges""",
)
def edge_scale(spark, sf_dir):
    sizes = papers(spark, sf_dir).groupBy("categories").agg(F.count("id").alias("n_papers"))
    return histograms.edge_scale(histograms.hist_density(sizes, "n_papers")).select(
        F.round("edge", 6).alias("edge"), F.round("scaled", 6).alias("scaled")
    )


@query("A20", "SELECT count(DISTINCT label) AS n_clusters FROM embeddings")
def n_clusters(spark, sf_dir):
    return profile.n_distinct(table(spark, sf_dir, "embeddings"), "label", "n_clusters")


# Yearly trends ------------------------------------------------------------------


@query("A11", with_views(PAPERS, YEAR_CATEGORIES) + "SELECT * FROM year_categories")
def year_categories(spark, sf_dir):
    return trends.year_categories(papers(spark, sf_dir))


@query("A12 F1 F2 F3 F4 F5 F6 F7", with_views(PAPERS, YEAR_AUTHORS) + "SELECT * FROM year_authors")
def year_authors(spark, sf_dir):
    return trends.year_authors(papers(spark, sf_dir))


@query(
    "A13 F18",
    with_views(PAPERS, YEARS)
    + f"""SELECT year, word, count(*) AS count FROM
  (SELECT year, unnest(regexp_extract_all(abstract, '{NON_SPACE_CLASS}+')) AS word FROM dated) GROUP BY ALL""",
)
def year_words(spark, sf_dir):
    return trends.year_words(spread_small(papers(spark, sf_dir)))


WIDE = ", ".join(
    f"sum(count) FILTER (year = {y})::BIGINT AS \"{y}\"" for y in TREND_YEARS
)


@query(
    "A21",
    with_views(PAPERS, YEAR_AUTHORS) + f"SELECT author, {WIDE} FROM year_authors GROUP BY author",
)
def authors_wide(spark, sf_dir):
    return profile.to_wide(trends.year_authors(papers(spark, sf_dir)), "author", TREND_YEARS)


@query(
    "A21 A22",
    with_views(PAPERS, YEAR_CATEGORIES)
    + """, cats AS (SELECT DISTINCT general_category FROM year_categories)
SELECT c.general_category, CAST(y AS VARCHAR) AS year, count FROM cats c
CROSS JOIN range(1991, 2020) t(y)
LEFT JOIN year_categories k ON k.general_category = c.general_category AND k.year = y""",
)
def wide_to_long(spark, sf_dir):
    wide = profile.to_wide(trends.year_categories(papers(spark, sf_dir)), "general_category", TREND_YEARS)
    return profile.to_long(wide, "general_category")


@query(
    "A23",
    with_views(PAPERS, YEAR_CATEGORIES)
    + """SELECT CAST(y AS VARCHAR) AS year, """
    + ", ".join(f"sum(count) FILTER (general_category = '{c}')::BIGINT AS {c}" for c in LANGUAGES)
    + " FROM range(1991, 2020) t(y) LEFT JOIN year_categories k ON k.year = y GROUP BY y",
)
def transpose(spark, sf_dir):
    wide = profile.to_wide(trends.year_categories(papers(spark, sf_dir)), "general_category", TREND_YEARS)
    long = profile.to_long(wide, "general_category", value="count")
    return profile.to_wide(long, "year", LANGUAGES, "general_category")


TOP_AUTHORS = """, ranked AS (SELECT year, author, count,
  (row_number() OVER (PARTITION BY year ORDER BY count DESC, author))::INTEGER AS rank FROM year_authors)
"""


@query(
    "W1",
    with_views(PAPERS, YEAR_AUTHORS) + TOP_AUTHORS + "SELECT * FROM ranked WHERE rank <= 15",
)
def top_authors_per_year(spark, sf_dir):
    return trends.top_authors_per_year(trends.year_authors(papers(spark, sf_dir)))


@query(
    "W2",
    with_views(PAPERS, YEAR_CATEGORIES)
    + """, filled AS (SELECT y.year, c.general_category, coalesce(count, 0) AS count
  FROM (SELECT DISTINCT year FROM year_categories) y
  CROSS JOIN (SELECT DISTINCT general_category FROM year_categories) c
  LEFT JOIN year_categories k ON k.year = y.year AND k.general_category = c.general_category)
SELECT *, (row_number() OVER (PARTITION BY year ORDER BY count DESC, general_category))::INTEGER AS rank
FROM filled""",
)
def rank_categories_per_year(spark, sf_dir):
    return trends.rank_categories_per_year(written_year_categories(spark, sf_dir))


@query(
    "U3",
    with_views(PAPERS, YEAR_AUTHORS)
    + TOP_AUTHORS
    + "SELECT DISTINCT author FROM ranked WHERE rank <= 15",
)
def pooled_top_authors(spark, sf_dir):
    return trends.pooled_top(trends.year_authors(papers(spark, sf_dir)))


@query(
    "W1 U3 J6 O4 P13",
    with_views(PAPERS, YEAR_AUTHORS)
    + TOP_AUTHORS
    + """, pooled AS (SELECT DISTINCT author FROM ranked WHERE rank <= 15)
SELECT y.year, p.author, k.count FROM (SELECT DISTINCT year FROM year_authors) y CROSS JOIN pooled p
LEFT JOIN year_authors k ON k.year = y.year AND k.author = p.author ORDER BY y.year, p.author""",
)
def top_author_series(spark, sf_dir):
    return trends.top_author_series(written_year_authors(spark, sf_dir))


@query(
    "W2 O4",
    with_views(PAPERS, YEAR_CATEGORIES)
    + """SELECT y.year, c.general_category, k.count FROM (SELECT DISTINCT year FROM year_categories) y
CROSS JOIN (SELECT DISTINCT general_category FROM year_categories) c
LEFT JOIN year_categories k ON k.year = y.year AND k.general_category = c.general_category""",
)
def category_series(spark, sf_dir):
    return trends.category_series(written_year_categories(spark, sf_dir))


# Order, samples, splits ---------------------------------------------------------


@query("O1", with_views(PAPERS) + "SELECT id, title FROM papers ORDER BY id LIMIT 5")
def head(spark, sf_dir):
    return ordering.head(papers(spark, sf_dir).select("id", "title"))


@query("O2", "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 600")
def first_n(spark, sf_dir):
    return ordering.first_n(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), 600, "doc_id")


@query(
    "O3",
    "SELECT event_id, event_type, value FROM events ORDER BY md5('7:' || event_id) LIMIT 2500",
)
def sample_n(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return ordering.sample_n(events, 2500, 7, "event_id")


@query(
    "O5",
    "SELECT event_type, round(sum(value), 2) AS total FROM events GROUP BY event_type ORDER BY total DESC, event_type",
)
def sort_by_value(spark, sf_dir):
    totals = profile.group_sum(table(spark, sf_dir, "events"), "event_type", "value")
    return totals.select("event_type", F.round("value", 2).alias("total")).orderBy(F.desc("total"), "event_type")


@query(
    "O6",
    """SELECT * FROM (SELECT o_orderpriority, o_orderkey, o_totalprice,
  (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey))::INTEGER AS rank
FROM orders) WHERE rank <= 15""",
)
def nlargest(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return ordering.top_n_per_group(orders, "o_orderpriority", "o_totalprice", "o_orderkey", 15)


EXTREMES = """SELECT vec_id, dim, weight, rank, side FROM (SELECT *,
  (row_number() OVER (PARTITION BY vec_id ORDER BY weight DESC, dim))::INTEGER AS rank, 'top' AS side FROM w)
WHERE rank BETWEEN {low} AND {high}
UNION ALL SELECT vec_id, dim, weight, rank, side FROM (SELECT *,
  (row_number() OVER (PARTITION BY vec_id ORDER BY weight, dim))::INTEGER AS rank, 'bottom' AS side FROM w)
WHERE rank <= 10"""

WEIGHTS = """WITH w AS (SELECT vec_id, (unnest(range(len(embedding))))::INTEGER AS dim,
  unnest(embedding) AS weight FROM embeddings)
"""


def _weights(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "weight"))


@query("O7", WEIGHTS + EXTREMES.format(low=1, high=10))
def extreme_terms(spark, sf_dir):
    return ordering.extreme_terms(_weights(spark, sf_dir), "vec_id", "dim", "weight")


@query("O7", WEIGHTS + EXTREMES.format(low=2, high=11))
def extreme_terms_without_largest(spark, sf_dir):
    return ordering.extreme_terms(_weights(spark, sf_dir), "vec_id", "dim", "weight", skip_max=True)


@query("O8", "SELECT * FROM labels")
def shuffled(spark, sf_dir):
    return ordering.shuffled(table(spark, sf_dir, "labels"), 5)


@query(
    "O8",
    """SELECT epoch::INTEGER AS epoch, count(*) AS n, count(*) AS n_places, 0::BIGINT AS low, count(*) - 1 AS high,
  TRUE AS differs FROM labels, range(1, 4) e(epoch) GROUP BY epoch""",
)
def epoch_orders(spark, sf_dir):
    """Three epochs over one table: each is a permutation, no two are the same."""
    rows = materialise(ordering.dense_position(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "at"), "positions")
    n = rows.count()
    orders = rows.select(*[ordering.epoch_place("at", n, e).alias(f"e{e}") for e in (1, 2, 3)])
    moved = [F.count_if(F.col(f"e{e}") != F.col(f"e{e % 3 + 1}")).alias(f"moved{e}") for e in (1, 2, 3)]
    differs = orders.agg(*moved).select(F.least(*[f"moved{e}" for e in (1, 2, 3)]) > 0).scalar()
    long = orders.select(F.posexplode(F.array("e1", "e2", "e3")).alias("epoch", "place"))
    return long.groupBy((F.col("epoch") + 1).alias("epoch")).agg(
        F.count("*").alias("n"),
        F.count_distinct("place").alias("n_places"),
        F.min("place").alias("low"),
        F.max("place").alias("high"),
    ).withColumn("differs", differs)


@query(
    "O9",
    with_views(PAPERS, SPLIT.format(seed=10, share=0.2, id="id", source="papers"))
    + "SELECT id, is_test FROM split",
)
def train_test_split(spark, sf_dir):
    return ordering.split_flag(papers(spark, sf_dir)).select("id", "is_test")


@query(
    "U4 U5",
    with_views(PAPERS, SPLIT.format(seed=5, share=0.25, id="id", source="papers"))
    + "SELECT DISTINCT categories FROM split",
)
def all_labels(spark, sf_dir):
    train, validation = ordering.split(papers(spark, sf_dir), "id", 0.25, 5)
    return joins.all_labels(train, validation, "categories")


@query(
    "W3",
    "SELECT event_id, ((row_number() OVER (ORDER BY event_id) - 1) // 16)::BIGINT AS batch FROM events",
)
def assign_batch(spark, sf_dir):
    return ordering.assign_batch(table(spark, sf_dir, "events").select("event_id"), 16, "event_id")


# Scalar functions ---------------------------------------------------------------


@query(
    "F22 F24",
    """SELECT vec_id, round(log2(label + 1), 9) AS log_label, len(embedding)::INTEGER AS width,
  len(list_distinct(list_transform(embedding, lambda x: round(x::DOUBLE, 1))))::INTEGER AS n_values
FROM embeddings""",
)
def array_functions(spark, sf_dir):
    rounded = F.transform("embedding", lambda x: F.round(x.cast("double"), 1) + 0.0)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.round(scalars.log2(F.col("label") + 1), 9).alias("log_label"),
        F.size("embedding").alias("width"),
        F.size(F.array_distinct(rounded)).alias("n_values"),
    )


@query(
    "F23",
    """SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS best FROM embeddings""",
)
def argmax(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", scalars.argmax(F.col("embedding")).alias("best"))


@query(
    "F25",
    """SELECT o_orderkey, CASE WHEN s >= 86400 THEN (s // 86400) || CASE WHEN s // 86400 = 1 THEN ' day, '
  ELSE ' days, ' END ELSE '' END || ((s % 86400) // 3600) || ':' || printf('%02d:%02d', (s % 3600) // 60, s % 60)
  AS elapsed FROM (SELECT o_orderkey, round_even(o_totalprice, 0)::BIGINT AS s FROM orders)""",
)
def elapsed_text(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", scalars.hms(F.col("o_totalprice")).alias("elapsed")
    )


@query(
    "F26",
    "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events",
)
def json_pairs(spark, sf_dir):
    pairs = scalars.json_pairs(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.explode(pairs).alias("key", "value"))


@query(
    "F12 F13",
    with_views(PAPERS)
    + """SELECT id, split_part(categories, '.', 1) AS general_category,
  TRY_CAST(substr(update_date, 1, 4) AS INTEGER) AS year FROM papers""",
)
def derived_fields(spark, sf_dir):
    return papers(spark, sf_dir).select(
        "id",
        scalars.general_category(F.col("categories")).alias("general_category"),
        scalars.year_of(F.col("update_date")).alias("year"),
    )


