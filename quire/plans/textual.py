"""Queries over text cleaning, tokens, encodings, TF-IDF and pooled vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.constants import ENGLISH_STOP_WORDS
from quire.functions import names, scalars, text
from quire.functions import stem as S
from quire.operators import cooccurrence, ordering, profile, tfidf, tokens
from quire.operators.lookup import lookup
from quire.plans.registry import query, table
from quire.plans.corpus import SPLIT
from quire.plans.views import NON_SPACE_CLASS, PAPERS, papers, with_views
from quire.session import materialise, settled, spread_small


def documents(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")
    return spread_small(df)


# Cleaning -----------------------------------------------------------------------


@query(
    "F1",
    with_views(PAPERS)
    + r"""SELECT id, regexp_replace(regexp_replace(author, '\([^()]*\)', '', 'g'), '\([^()]*\)', '', 'g') AS author
FROM papers""",
)
def strip_nested_parens(spark, sf_dir):
    return papers(spark, sf_dir).select("id", names.strip_nested_parens(F.col("author")).alias("author"))


@query(
    "F1b F7b",
    with_views(PAPERS)
    + r"""SELECT id, array_to_string(list_filter(list_transform(string_split(regexp_replace(
  regexp_replace(author, '\([^)]*\)', '', 'g'), '\sand\s', ',', 'g'), ','),
  lambda a: trim(lower(regexp_replace(a, '[^a-zA-Z]', ' ', 'g')))), lambda a: a <> ''), ',') AS authors
FROM papers""",
)
def author_list_ascii(spark, sf_dir):
    return papers(spark, sf_dir).select(
        "id", names.join_names(names.author_list_ascii(F.col("author"))).alias("authors")
    )


@query(
    "F2 F3 F4",
    with_views(PAPERS)
    + r"""SELECT id, regexp_replace(replace(regexp_replace(author, '\sand\s', ',', 'g'), ', et al', ''),
  ',{2,}', ',', 'g') AS author FROM papers""",
)
def author_commas(spark, sf_dir):
    joined = names.collapse_commas(names.drop_et_al(names.and_to_comma(F.col("author"))))
    return papers(spark, sf_dir).select("id", joined.alias("author"))


LETTERS = "trim(regexp_replace(lower(regexp_replace({c}, '[^a-zA-Z]', ' ', 'g')), ' +', ' ', 'g'))"
ALPHANUMERICS = "trim(regexp_replace(lower(regexp_replace({c}, '[^a-zA-Z0-9]+', ' ', 'g')), ' +', ' ', 'g'))"


@query("F9", f"SELECT doc_id AS id, md5({LETTERS.format(c='text')}) AS clean_md5 FROM documents")
def clean_letters(spark, sf_dir):
    return documents(spark, sf_dir).select("id", F.md5(text.clean_letters(F.col("text"))).alias("clean_md5"))


@query("F10", f"SELECT doc_id AS id, md5({ALPHANUMERICS.format(c='text')}) AS clean_md5 FROM documents")
def clean_alphanumerics(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "id", F.md5(text.clean_alphanumerics(F.col("text"))).alias("clean_md5")
    )


def _cut_words_sql(value: str) -> str:
    for head, tail in text.TWO_PART_WORDS:
        value = rf"regexp_replace({value}, '\b{head}{tail}\b', '{head} {tail}', 'g')"
    return value


LONG_WORDS = (
    "array_to_string(list_filter(string_split("
    + _cut_words_sql(LETTERS.format(c="text"))
    + ", ' '), lambda w: len(w) > 2), ' ')"
)


@query("F11", f"SELECT doc_id AS id, md5({LONG_WORDS}) AS clean_md5 FROM documents")
def long_word_text(spark, sf_dir):
    return documents(spark, sf_dir).select("id", F.md5(text.long_word_text(F.col("text"))).alias("clean_md5"))


@query(
    "F19",
    """SELECT doc_id AS id, len(t)::INTEGER AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z'']+') AS t FROM documents)""",
)
def lower_tokens(spark, sf_dir):
    df = documents(spark, sf_dir).select("id", text.lower_tokens(F.lower("text")).alias("t"))
    return df.select("id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query(
    "F17",
    f"SELECT doc_id AS id, len(regexp_extract_all(text, '{NON_SPACE_CLASS}+'))::INTEGER AS n_words FROM documents",
)
def word_count(spark, sf_dir):
    return documents(spark, sf_dir).select("id", scalars.word_count(F.col("text")).alias("n_words"))


@query(
    "A25",
    f"SELECT max(len(regexp_extract_all({ALPHANUMERICS.format(c='text')}, '[^ ]+')))::INTEGER AS max_tokens FROM documents",
)
def max_tokens(spark, sf_dir):
    return profile.max_tokens(_clean_tokens(spark, sf_dir), "tokens")


# Token encodings ----------------------------------------------------------------


def _clean_tokens(spark, sf_dir):
    """Alphanumeric words of the cleaned text."""
    words = text.alphanumeric_tokens(F.col("text"))
    return documents(spark, sf_dir).select("id", "lang", words.alias("tokens"))


ENCODED = f"""WITH docs AS (SELECT doc_id AS id,
  regexp_extract_all({ALPHANUMERICS.format(c='text')}, '[^ ]+') AS tokens FROM documents),
vocab AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx FROM
  (SELECT DISTINCT unnest(tokens) AS term FROM docs)),
placed AS (SELECT id, unnest(range(least(len(tokens), 254))) AS pos, unnest(tokens[1:254]) AS term FROM docs),
coded AS (SELECT id, list(idx + 4 ORDER BY pos) AS codes FROM placed JOIN vocab USING (term) GROUP BY id),
full_rows AS (SELECT id, coalesce(codes, []) AS codes FROM docs LEFT JOIN coded USING (id))
SELECT id, array_to_string(list_concat(list_concat([2], codes, [3]),
    list_transform(range(254 - len(codes)), lambda i: 0)), ',') AS input_ids,
  array_to_string(list_transform(range(256), lambda i: CASE WHEN i < len(codes) + 2 THEN 1 ELSE 0 END), ',')
    AS attention_mask FROM full_rows"""


@query("F27", ENCODED)
def encode_tokens(spark, sf_dir):
    docs = _clean_tokens(spark, sf_dir)
    coded = tokens.encode_tokens(docs, tokens.vocabulary(docs))
    return coded.select(
        "id",
        F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("input_ids"),
        F.array_join(F.col("attention_mask").cast("array<string>"), ",").alias("attention_mask"),
    )


# TF-IDF -------------------------------------------------------------------------


def _word_tokens(spark, sf_dir):
    return documents(spark, sf_dir).select("id", "lang", text.word_tokens(F.col("text")).alias("tokens"))


def tfidf_sql(docs: str, low: str = "1", high: str = "n", fit: str = "docs") -> str:
    """CTEs from ``docs (id, tokens)`` to ``weights (id, term, idx, tfidf)``; idf
    and vocabulary come from ``fit``."""
    return f"""{docs},
n_docs AS (SELECT count(*) AS n FROM {fit}),
vocab AS (SELECT term, df, ln((1 + n) / (1 + df)) + 1 AS idf, row_number() OVER (ORDER BY term) - 1 AS idx
  FROM (SELECT term, count(*) AS df FROM (SELECT id, unnest(list_distinct(tokens)) AS term FROM {fit})
    GROUP BY term), n_docs
  WHERE df >= {low} AND df <= {high}),
raw AS (SELECT id, term, idx, tf * idf AS w FROM (SELECT id, term, count(*) AS tf FROM
  (SELECT id, unnest(tokens) AS term FROM docs) GROUP BY ALL) JOIN vocab USING (term)),
weights AS (SELECT id, term, idx, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS tfidf FROM raw)
"""


WORD_DOCS = r"""docs AS (SELECT doc_id AS id, lang,
  regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS tokens FROM documents)"""


def _rounded(weights, *columns):
    return weights.select(*columns, F.round("tfidf", 6).alias("tfidf"))


@query(
    "T1",
    "WITH " + tfidf_sql(WORD_DOCS, "0.05::DOUBLE * n") + "SELECT id, term, idx, round(tfidf, 6) AS tfidf FROM weights",
)
def tfidf_share(spark, sf_dir):
    docs = _word_tokens(spark, sf_dir)
    return _rounded(tfidf.fit_tfidf(docs, min_df=0.05).transform(docs), "id", "term", "idx")


@query("T1", "WITH " + tfidf_sql(WORD_DOCS) + "SELECT id, term, round(tfidf, 6) AS tfidf FROM weights")
def tfidf_defaults(spark, sf_dir):
    docs = _word_tokens(spark, sf_dir)
    return _rounded(tfidf.fit_tfidf(docs).transform(docs), "id", "term")


@query(
    "T6",
    "WITH " + tfidf_sql(WORD_DOCS, "0.05::DOUBLE * n") + "SELECT term, idx, df, round(idf, 9) AS idf FROM vocab",
)
def vocabulary(spark, sf_dir):
    terms = tfidf.fit_tfidf(_word_tokens(spark, sf_dir), min_df=0.05).terms
    return terms.select("term", "idx", "df", F.round("idf", 9).alias("idf"))


@query(
    "T3 O9",
    "WITH "
    + tfidf_sql(
        WORD_DOCS.replace("docs AS", "every AS")
        + ",\n" + SPLIT.format(seed=10, share=0.2, id="id", source="every")
        + ",\nfitted AS (SELECT * FROM split WHERE NOT is_test), docs AS (SELECT * FROM split WHERE is_test)",
        "0.05::DOUBLE * n",
        fit="fitted",
    )
    + "SELECT id, term, idx, round(tfidf, 6) AS tfidf FROM weights",
)
def tfidf_transform(spark, sf_dir):
    train, test = ordering.split(_word_tokens(spark, sf_dir))
    return _rounded(tfidf.fit_tfidf(train, min_df=0.05).transform(test), "id", "term", "idx")


CATEGORY_DOCS = WORD_DOCS.replace(
    "FROM documents)", "FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 10000) WHERE lang = 'en')"
)


def _category_weights(spark, sf_dir, first=None):
    """One category, of the first rows only if ``first`` is given, with all default
    settings."""
    docs = _word_tokens(spark, sf_dir)
    docs = (docs if first is None else ordering.first_n(docs, first)).where("lang = 'en'")
    return docs, tfidf.fit_tfidf(docs).transform(docs)


@query(
    "T12",
    "WITH "
    + tfidf_sql(CATEGORY_DOCS)
    + """SELECT (SELECT count(*) FROM docs) AS n_docs, count(DISTINCT term) AS n_terms,
  round(CASE WHEN count(*) < count(DISTINCT term) * (SELECT count(*) FROM docs) THEN 0.0::DOUBLE
    ELSE min(tfidf) END, 6) AS min_tfidf FROM weights""",
)
def category_tfidf_min(spark, sf_dir):
    docs, weights = _category_weights(spark, sf_dir, first=10_000)
    return tfidf.matrix_minimum(weights, docs).select(
        "n_docs", "n_terms", F.round("min_tfidf", 6).alias("min_tfidf")
    )


@query(
    "T12",
    "WITH "
    + tfidf_sql(WORD_DOCS.replace("FROM documents)", "FROM documents WHERE lang = 'en')"))
    + """SELECT term, round(sum(tfidf), 4) AS weight FROM weights GROUP BY term
ORDER BY sum(tfidf) DESC, term LIMIT 20""",
)
def category_top_terms(spark, sf_dir):
    _, weights = _category_weights(spark, sf_dir)
    return tfidf.top_terms(weights, 20).select("term", F.round("weight", 4).alias("weight"))


# Stems, stop words, n-grams -----------------------------------------------------


def _case(ending: str, table_: dict, word: str = "w") -> str:
    rows = " ".join(f"WHEN '{e}' THEN '{r}'" for e, r in table_.items())
    return f"left({word}, len({word}) - len({ending})) || CASE {ending} {rows} END"


def stem_sql(source: str) -> str:
    """CTEs from distinct ``token`` rows of ``source`` to ``stems (token, stem)``,
    one per rule."""
    r1, r2 = f"regexp_extract(w, '{S.R1}', 1)", f"regexp_extract(regexp_extract(w, '{S.R1}', 1), '{S.R2}', 1)"

    def ending(endings) -> str:
        return f"regexp_extract(w, '{S.any_of(endings)}', 0) AS e"

    left = "left(w, len(w) - len(e))"
    cut1, cut2 = "left(w, len(w) - 1)", "left(w, len(w) - 2)"
    exceptions = " ".join(f"WHEN '{t}' THEN '{s}'" for t, s in S.EXCEPTIONS.items())
    repair = f"""CASE WHEN regexp_matches(l, '(?:at|bl|iz)$') THEN l || 'e'
      WHEN regexp_matches(l, '(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(l, len(l) - 1)
      WHEN len(r1) - len(e) <= 0 AND regexp_matches(l, '{S.SHORT_END}') THEN l || 'e' ELSE l END"""
    return f"""s0 AS (SELECT token, regexp_replace(regexp_replace(regexp_replace(token, '^''', ''), '^y', 'Y'),
    '([aeiouy])y', '\\1Y', 'g') AS w FROM {source}),
s1 AS (SELECT token, regexp_replace(w, '(''s''|''s|'')$', '') AS w FROM s0),
s2 AS (SELECT token, CASE WHEN regexp_matches(w, 'sses$') THEN {cut2}
    WHEN regexp_matches(w, '..(?:ied|ies)$') THEN {cut2} WHEN regexp_matches(w, '(?:ied|ies)$') THEN {cut1}
    WHEN regexp_matches(w, '(?:us|ss)$') THEN w WHEN regexp_matches(w, '[aeiouy].+s$') THEN {cut1}
    ELSE w END AS w FROM s1),
s3 AS (SELECT token, w, e, {left} AS l, {r1} AS r1 FROM
    (SELECT *, {ending(["eedly", "ingly", "edly", "eed", "ing", "ed"])} FROM s2)),
s4 AS (SELECT token, CASE WHEN e = '' THEN w
    WHEN e IN ('eed', 'eedly') THEN CASE WHEN len(e) <= len(r1) THEN l || 'ee' ELSE w END
    WHEN regexp_matches(l, '[aeiouy]') THEN {repair} ELSE w END AS w FROM s3),
s5 AS (SELECT token, regexp_replace(w, '^(.+[^aeiouy])[yY]$', '\\1i') AS w FROM s4),
s6 AS (SELECT token, CASE WHEN e <> '' AND len(e) <= len({r1}) AND (e <> 'ogi' OR regexp_matches(w, 'logi$'))
    AND (e <> 'li' OR regexp_matches(w, '[cdeghkmnrt]li$')) THEN {_case('e', S.R1_ENDINGS)} ELSE w END AS w
    FROM (SELECT *, {ending(S.R1_ENDINGS)} FROM s5)),
s7 AS (SELECT token, CASE WHEN e <> '' AND len(e) <= CASE WHEN e = 'ative' THEN len({r2}) ELSE len({r1}) END
    THEN {_case('e', S.R1_ENDINGS_LATER)} ELSE w END AS w
    FROM (SELECT *, {ending(S.R1_ENDINGS_LATER)} FROM s6)),
s8 AS (SELECT token, CASE WHEN e <> '' AND len(e) <= len({r2})
    AND (e <> 'ion' OR regexp_matches(w, '[st]ion$')) THEN {left} ELSE w END AS w
    FROM (SELECT *, {ending(S.R2_ENDINGS)} FROM s7)),
s9 AS (SELECT token, CASE WHEN regexp_matches(w, 'll$') THEN CASE WHEN {r2} <> '' THEN {cut1} ELSE w END
    WHEN regexp_matches(w, 'e$') AND ({r2} <> '' OR ({r1} <> ''
      AND NOT regexp_matches(w, '{S.SHORT_SYLLABLE}e$'))) THEN {cut1} ELSE w END AS w FROM s8),
stems AS (SELECT token, CASE WHEN len(token) <= 2 THEN token
    ELSE CASE token {exceptions} ELSE replace(w, 'Y', 'y') END END AS stem FROM s9)"""


LETTER_DOCS = f"""spelled AS (SELECT doc_id AS id, lang,
  regexp_extract_all({LETTERS.format(c='text')}, '[a-z'']+') AS tokens FROM documents)"""
DISTINCT_TOKENS = "tokens AS (SELECT DISTINCT unnest(tokens) AS token FROM spelled)"


def _stop_list() -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH_STOP_WORDS) + ")"


STEMMED_DOCS = f"""{LETTER_DOCS},
{DISTINCT_TOKENS},
{stem_sql('tokens')},
placed AS (SELECT id, unnest(range(len(tokens))) AS pos, unnest(tokens) AS token FROM spelled),
kept AS (SELECT id, list(stem ORDER BY pos) AS tokens FROM placed JOIN stems USING (token)
  WHERE stem NOT IN {_stop_list()} GROUP BY id),
stemmed AS (SELECT spelled.id, lang, coalesce(kept.tokens, []) AS tokens FROM spelled LEFT JOIN kept USING (id))"""

NGRAM_DOCS = """docs AS (SELECT id, lang, list_concat(tokens,
    list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1]),
    list_transform(range(1, len(tokens) - 1), lambda i: tokens[i] || ' ' || tokens[i + 1] || ' ' || tokens[i + 2])
  ) AS tokens FROM stemmed)"""


@query("T4", f"WITH {LETTER_DOCS}, {DISTINCT_TOKENS}, {stem_sql('tokens')} SELECT token, stem FROM stems")
def stem_table(spark, sf_dir):
    return tokens.stem_table(_letter_tokens(spark, sf_dir))


def _letter_tokens(spark, sf_dir):
    spelled = text.lower_tokens(text.clean_letters(F.col("text")))
    return documents(spark, sf_dir).select("id", "lang", spelled.alias("tokens"))


def stemmed_documents(spark, sf_dir):
    """(id, tokens): stems without stop words; written, as fitting and transforming
    both read it."""

    def kept():
        stems = tokens.stem_documents(_letter_tokens(spark, sf_dir))
        return stems.select("id", text.drop_stop_words(F.col("tokens")).alias("tokens"))

    return settled(kept, "stemmed")


@query(
    "T4 T5",
    f"""WITH {STEMMED_DOCS}
SELECT id, len(tokens)::INTEGER AS n_tokens, md5(array_to_string(tokens, ' ')) AS tokens_md5 FROM stemmed""",
)
def stemmed_tokens(spark, sf_dir):
    docs = stemmed_documents(spark, sf_dir)
    return docs.select(
        "id", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5")
    )


@query(
    "T2",
    "WITH "
    + tfidf_sql(f"{STEMMED_DOCS},\n{NGRAM_DOCS}", "10", "0.9::DOUBLE * n")
    + "SELECT id, term, idx, round(tfidf, 6) AS tfidf FROM weights",
)
def tfidf_ngrams(spark, sf_dir):
    docs = stemmed_documents(spark, sf_dir)
    model = tfidf.fit_tfidf(docs, min_df=10, max_df=0.9, ngrams=(1, 3))
    return _rounded(model.transform(docs), "id", "term", "idx")


def stemmed_weights(spark, sf_dir):
    """Unigram form, the input of clustering and projection."""
    docs = stemmed_documents(spark, sf_dir)
    model = tfidf.fit_tfidf(docs, min_df=10, max_df=0.9)
    return docs, model


@query(
    "T14 A8 O6",
    "WITH "
    + tfidf_sql(f"{STEMMED_DOCS},\ndocs AS (SELECT * FROM stemmed)", "10", "0.9::DOUBLE * n")
    + """, sums AS (SELECT lang AS cluster, term, sum(tfidf) AS weight FROM weights JOIN docs USING (id) GROUP BY ALL)
SELECT cluster, term, round(weight, 4) AS weight, rank FROM (SELECT *,
  (row_number() OVER (PARTITION BY cluster ORDER BY weight DESC, term))::INTEGER AS rank FROM sums) WHERE rank <= 15""",
)
def cluster_terms(spark, sf_dir):
    """With the language in the place of a fitted cluster."""
    docs, model = stemmed_weights(spark, sf_dir)
    clusters = documents(spark, sf_dir).select("id", F.col("lang").alias("cluster"))
    return tfidf.cluster_terms(model.transform(docs), clusters).select(
        "cluster", "term", F.round("weight", 4).alias("weight"), "rank"
    )


# Pooled vectors -----------------------------------------------------------------


@query(
    "T18",
    f"""WITH docs AS (SELECT doc_id AS id,
  regexp_extract_all({ALPHANUMERICS.format(c='text')}, '[^ ]+') AS tokens FROM documents),
vocab AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx FROM
  (SELECT DISTINCT unnest(tokens) AS term FROM docs)),
counts AS (SELECT id, idx % (SELECT count(*) FROM embeddings) AS vec_id, count(*) AS tf FROM
  (SELECT id, unnest(tokens) AS term FROM docs) JOIN vocab USING (term) GROUP BY ALL),
cells AS (SELECT vec_id, (unnest(range(len(embedding))))::INTEGER AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT id, dim, round(sum(tf * x) / sum(tf), 6) AS value FROM counts JOIN cells USING (vec_id) GROUP BY ALL""",
)
def mean_pool(spark, sf_dir):
    """Each vocabulary word takes the given vector at its place, modulo their number."""
    docs = _clean_tokens(spark, sf_dir)
    given = table(spark, sf_dir, "embeddings")
    n_vectors = given.count()
    places = tokens.vocabulary(docs).select("term", (F.col("idx") % n_vectors).alias("place"))
    vectors = given.select(F.col("vec_id").alias("place"), F.col("embedding").alias("vector"))
    pooled = tokens.mean_pool(docs, vectors, places=places)
    return pooled.select("id", F.posexplode("vector").alias("dim", "value")).withColumn(
        "value", F.round("value", 6)
    )


# Vectors learned from the corpus ------------------------------------------------

PAIRS = f"""docs AS (SELECT doc_id AS id, regexp_extract_all({ALPHANUMERICS.format(c='text')}, '[^ ]+') AS tokens FROM documents),
placed AS (SELECT id, unnest(tokens) AS term, unnest(range(len(tokens))) AS pos FROM docs),
vocab AS (SELECT term FROM placed GROUP BY term HAVING count(DISTINCT id) >= 20),
kept AS (SELECT placed.* FROM placed JOIN vocab USING (term)),
once AS (SELECT x.term AS a, y.term AS b FROM kept x JOIN kept y ON x.id = y.id AND y.pos IN (x.pos + 1, x.pos + 2)),
pairs AS (SELECT a, b, count(*) AS n FROM (SELECT a, b FROM once UNION ALL SELECT b, a FROM once) GROUP BY a, b),
margins AS (SELECT a, sum(n) AS n_a FROM pairs GROUP BY a)"""


def _frequent_vocabulary(docs):
    counted = tokens.exploded(docs, F.array_distinct("tokens")).groupBy("term").agg(F.count("*").alias("df"))
    kept = materialise(counted.where("df >= 20").select("term"), "terms")
    return materialise(ordering.dense_position(kept, "term", "idx"), "vocabulary")


@query(
    "T18",
    f"""WITH {PAIRS}
SELECT p.a, p.b, p.n::BIGINT AS n, round(greatest(ln(p.n * (SELECT sum(n) FROM pairs) / (x.n_a * y.n_a)), 0), 6) AS pmi
FROM pairs p JOIN margins x ON x.a = p.a JOIN margins y ON y.a = p.b""",
)
def token_pairs(spark, sf_dir):
    """Tokens that stand at most two places apart, and how much more often than by chance."""
    docs = materialise(_clean_tokens(spark, sf_dir), "tokens")
    vocab = _frequent_vocabulary(docs)
    counts = cooccurrence.cooccurrence(docs, vocab, 2)
    found = cooccurrence.positive_pmi(counts, every=True)
    for side, other in (("a", "b"), ("b", "a")):
        names = vocab.select(F.col("idx").alias(side), F.col("term").alias(f"term_{side}"))
        found = lookup(found, names, side, other)
    return found.select(
        F.col("term_a").alias("a"), F.col("term_b").alias("b"), "n", F.round("pmi", 6).alias("pmi")
    )


@query(
    "T18",
    f"""WITH {PAIRS} SELECT id, count(v.term) AS n_known, count(v.term) > 0 AS has_vector, TRUE AS is_wide
FROM docs LEFT JOIN placed USING (id) LEFT JOIN vocab v USING (term) GROUP BY id""",
)
def learned_vectors(spark, sf_dir):
    """Documents as means of token vectors that were learned from them."""
    docs = materialise(_clean_tokens(spark, sf_dir), "tokens")
    vocab = _frequent_vocabulary(docs)
    vectors = cooccurrence.token_vectors(docs, vocab, width=16, window=2, rounds=4)
    # A plain join would shuffle every token.
    placed = docs.select("id", F.explode_outer("tokens").alias("term"))
    known = lookup(placed, vocab.select("term", "idx"), "term", "id", how="left")
    counted = known.groupBy("id").agg(F.count("idx").alias("n_known"))
    pooled = tokens.mean_pool(docs, vectors)
    return pooled.join(counted, "id").select(
        "id",
        "n_known",
        F.col("vector").isNotNull().alias("has_vector"),
        F.coalesce(F.size("vector") == F.least(F.lit(16), F.lit(vocab.count())), F.lit(True)).alias("is_wide"),
    )
