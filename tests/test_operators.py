import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.operators import (
    evaluate,
    histograms,
    joins,
    lookup,
    neighbours,
    ordering,
    papers,
    profile,
    quantiles,
    tfidf,
    tokens,
    trends,
    vectors,
)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# Order, splits, samples ---------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_split_is_exact_disjoint_and_complete(spark, n):
    df = spark.range(n)
    train, test = ordering.split(df, "id", 0.2, 10)
    a, b = {r.id for r in train.collect()}, {r.id for r in test.collect()}
    assert len(b) == math.ceil(0.2 * n)
    assert a | b == set(range(n)) and not a & b


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(500)
    assert rows(ordering.split_flag(df)) == rows(ordering.split_flag(df.repartition(13)))


def test_sample_has_exactly_n_rows(spark):
    assert ordering.sample_n(spark.range(300), 40, 1).count() == 40
    assert ordering.sample_n(spark.range(30), 40, 1).count() == 30


def test_null_and_repeated_ids(spark):
    half = spark.range(20).select(F.when(F.col("id") < 10, F.col("id")).alias("id"))
    assert ordering.sample_n(half, 5, 1).count() == 5
    flags = ordering.split_flag(half, test=0.2)
    assert flags.where("is_test").count() == 2 and flags.where("id IS NULL AND is_test").count() == 0
    twice = spark.createDataFrame([(1,), (1,), (1,), (2,), (None,)], "id long")
    assert [ordering.first_n(twice, n).count() for n in (2, 3, 4, 9)] == [2, 3, 4, 4]
    assert ordering.first_n(twice.limit(0), 3).count() == 0


def test_borders_are_searched_by_halving(spark):
    borders = list(range(0, 2000, 2))
    df = spark.range(-3, 2005).withColumn("b", F.lit(borders))
    got = df.select("id", ordering.bucket_of("id", "b", len(borders)).alias("n")).collect()
    assert all(r.n == sum(x <= r.id for x in range(0, min(r.id, 1998) + 1, 2)) for r in got)


def test_any_number_of_classes(spark):
    df = spark.range(20_000).select("id", F.format_string("c%05d", "id").alias("c"))
    assert joins.label_index(df, "c", df).where("label_idx <> id").count() == 0
    pairs = df.select(F.col("id").alias("label"), (F.col("id") * 0).alias("prediction"))
    assert evaluate.confusion_cells(pairs).count() == 20_000


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_dense_position(spark, kind):
    df = spark.range(0, 3000, 3).select(F.col("id").cast(kind).alias("id"))
    got = ordering.dense_position(df.repartition(7), "id").toPandas().sort_values("position")
    assert got["position"].tolist() == list(range(1000))
    assert got["id"].tolist() == sorted(got["id"].tolist())


def test_first_n_and_batches(spark):
    df = spark.range(100).repartition(5)
    assert rows(ordering.first_n(df, 3)) == [(0,), (1,), (2,)]
    sizes = ordering.assign_batch(df, 8).groupBy("batch").count()
    assert rows(sizes) == [(b, 8 if b < 12 else 4) for b in range(13)]


def test_extreme_terms_skip_the_largest(spark):
    df = spark.createDataFrame([("g", t, w) for t, w in zip("abcd", [4.0, 3.0, 2.0, 1.0])], "g string, t string, w double")
    kept = ordering.extreme_terms(df, "g", "t", "w", 2, skip_max=True)
    assert rows(kept.select("side", "t")) == [("bottom", "c"), ("bottom", "d"), ("top", "b"), ("top", "c")]


# Joins --------------------------------------------------------------------------


def test_strict_exclusion_names_the_missing_entry(spark):
    df = spark.createDataFrame([("a",), ("b",)], "author string")
    assert rows(joins.exclude_names(df, ["b"], strict=True)) == [("a",)]
    with pytest.raises(KeyError, match="zz"):
        joins.exclude_names(df, ["b", "zz"], strict=True)


def test_unknown_class_fails(spark):
    train = spark.createDataFrame([(1, "x"), (2, "y")], "id int, c string")
    later = spark.createDataFrame([(3, "y"), (4, "z")], "id int, c string")
    assert rows(joins.label_index(later.where("c = 'y'"), "c", train)) == [(3, "y", 1)]
    with pytest.raises(Exception, match="unknown class: z"):
        joins.label_index(later, "c", train).collect()


def test_salted_lookup_equals_broadcast_lookup(spark):
    facts = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).alias("k"))
    words = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        small = lookup.lookup(facts, words, "k", "id", how=how)
        large = lookup.lookup(facts, words, "k", "id", how=how, limit=0)
        assert rows(small.select("id", "k").fillna(-1)) == rows(large.select("id", "k").fillna(-1))
        assert small.agg(F.sum("v")).first() == large.agg(F.sum("v")).first()


def test_hot_keys_are_few_and_get_their_share(spark):
    facts = spark.range(900).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    assert rows(lookup.hot_keys(facts, "k", 10)) == [(-1, 4)]


# Profiles and histograms --------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_quantiles_equal_pandas(spark, seed):
    rng = np.random.default_rng(seed)
    values = np.concatenate([rng.normal(size=777), np.full(400, 0.25), rng.integers(0, 5, 301)])
    df = spark.createDataFrame(pd.DataFrame({"x": values})).repartition(6)
    got = quantiles.describe_num(df, "x", round_to=None).first().asDict()
    want = pd.Series(values).describe()
    for ours, theirs in zip(("count", "mean", "std", "min", "p25", "p50", "p75", "max"), want, strict=True):
        assert got[ours] == pytest.approx(theirs, rel=1e-12, abs=1e-12)


def test_count_profile_equals_pandas(spark):
    values = [1, 1, 2, 3, 50, 7, 7, 7]
    df = spark.createDataFrame([(v,) for v in values], "x int")
    got = list(quantiles.describe_counts(df, "x").first())
    assert got == pytest.approx(list(pd.Series(values).describe().round(2)))


def test_small_profiles(spark):
    one = spark.createDataFrame([(5.0,)], "x double")
    assert list(quantiles.describe_num(one, "x").first()) == [1, 5.0, None, 5.0, 5.0, 5.0, 5.0, 5.0]


@pytest.mark.parametrize("values", [[1, 2, 2, 3, 10], [5], list(range(150)), [0.1 * i for i in range(1000)]])
def test_histogram_equals_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = histograms.hist_density(df, "x", 149).toPandas().sort_values("bin")
    density, edges = np.histogram(values, 149, density=True)
    counts, _ = np.histogram(values, 149)
    assert got["n"].tolist() == counts.tolist()
    assert np.allclose(got["density"], density) and np.allclose(got["left"], edges[:-1])
    scaled = histograms.edge_scale(histograms.hist_density(df, "x", 149)).toPandas().sort_values("edge")
    assert np.allclose(scaled["scaled"], (edges - edges.min()) / edges.std())


def test_clipped_histogram_drops_what_lies_above(spark):
    values = [0, 9, 49, 50, 299, 300, 301, 400, 401]
    df = spark.createDataFrame([(v,) for v in values], "x int")
    expected, _ = np.histogram(np.clip(values, 0, 400), bins=range(0, 350, 50))
    got = histograms.hist_clipped(df, "x").orderBy("left")
    assert [r.n for r in got.collect()] == expected.tolist()


def test_wide_and_long_are_inverse(spark):
    long = spark.createDataFrame([("a", 2000, 3), ("b", 2001, 4)], "k string, year int, count bigint")
    wide = profile.to_wide(long, "k", [2000, 2001])
    back = profile.to_long(wide, "k")
    assert back.count() == 4
    assert rows(back.where("count IS NOT NULL")) == [("a", "2000", 3), ("b", "2001", 4)]
    flipped = profile.transpose(wide, "k", ["a", "b"])
    assert rows(flipped.fillna(0)) == [("2000", 3, 0), ("2001", 0, 4)]


def test_year_bounds(spark):
    dates = [f"{y}-01-01" for y in (1990, 1991, 1992, 2009, 2010, 2019, 2020)] + [None, "x"]
    df = spark.createDataFrame([(d, "c") for d in dates], "update_date string, categories string")
    assert [r.year for r in papers.with_trend_year(df).orderBy("year").collect()] == [1991, 1992, 2009, 2010, 2019]
    dim = spark.createDataFrame([("c",)], "code string")
    assert rows(papers.ingest_filter(df, dim).select("update_date")) == [("1992-01-01",), ("2009-01-01",)]


def test_ties_in_yearly_lists_go_by_name(spark):
    counts = spark.createDataFrame([(2000, n, 5) for n in "dcba"], "year int, author string, count bigint")
    assert rows(trends.top_authors_per_year(counts, 2).select("author")) == [("a",), ("b",)]


# Text vectors -------------------------------------------------------------------


def brute_tfidf(docs, min_df=1, max_df=1.0):
    n = len(docs)
    df = {}
    for words in docs.values():
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    low = min_df if isinstance(min_df, int) else min_df * n
    high = max_df if isinstance(max_df, int) else max_df * n
    idf = {w: math.log((1 + n) / (1 + c)) + 1 for w, c in df.items() if low <= c <= high}
    out = {}
    for i, words in docs.items():
        raw = {w: words.count(w) * idf[w] for w in set(words) if w in idf}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out |= {(i, w): v / norm for w, v in raw.items()}
    return out


DOCS = {1: "a b b c".split(), 2: "a c c d".split(), 3: [], 4: "a".split(), 5: "e f a e".split()}


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(list(DOCS.items()), "id bigint, tokens array<string>")


@pytest.mark.parametrize(("low", "high"), [(1, 1.0), (2, 1.0), (0.3, 1.0), (1, 0.5)])
def test_tfidf_equals_brute_force_in_both_forms(spark, docs, low, high):
    model = tfidf.fit_tfidf(docs, low, high)
    expected = brute_tfidf(DOCS, low, high)
    got = {(r.id, r.term): r.tfidf for r in model.transform(docs).collect()}
    assert got == pytest.approx(expected)
    terms = [r.term for r in model.terms.orderBy("idx").collect()]
    assert terms == sorted(terms)
    dense = {
        (r.id, terms[i]): v
        for r in model.vectorizer().transform(docs).collect()
        for i, v in enumerate(r.features.toArray())
        if v
    }
    assert dense == pytest.approx(expected)


def test_tfidf_beyond_the_broadcast_limit(spark, docs, monkeypatch):
    model = tfidf.fit_tfidf(docs)
    small = {(r.id, r.term): r.tfidf for r in model.transform(docs).collect()}
    monkeypatch.setattr(tfidf, "fits_broadcast", lambda *a, **k: False)
    monkeypatch.setattr(lookup, "fits_broadcast", lambda *a, **k: False)
    assert {(r.id, r.term): r.tfidf for r in model.transform(docs).collect()} == pytest.approx(small)


def test_matrix_minimum(spark, docs):
    model = tfidf.fit_tfidf(docs)
    assert tuple(tfidf.matrix_minimum(model.transform(docs), docs).first()) == (5, 6, 0.0)
    full = docs.where("id = 4")
    assert tfidf.matrix_minimum(tfidf.fit_tfidf(full).transform(full), full).first().min_tfidf == 1.0


def test_stems_keep_positions_and_empty_documents(spark):
    df = spark.createDataFrame([(1, ["hopping", "cats", "hopping"]), (2, [])], "id bigint, tokens array<string>")
    assert {r.id: r.tokens for r in tokens.stem_documents(df).collect()} == {1: ["hop", "cat", "hop"], 2: []}


def test_encoding_pads_truncates_and_marks(spark, docs):
    vocab = tokens.vocabulary(docs.where("id < 5"))
    got = {r.id: (r.input_ids, r.attention_mask) for r in tokens.encode_tokens(docs, vocab, length=5).collect()}
    assert got[3] == ([2, 3, 0, 0, 0], [1, 1, 0, 0, 0])
    assert got[1] == ([2, 4, 5, 5, 3], [1] * 5)
    assert got[5] == ([2, 1, 1, 4, 3], [1] * 5)  # e and f are unknown


@pytest.mark.parametrize("width", [3, 64, 130])
def test_pooled_vectors_equal_numpy(spark, docs, width):
    rng = np.random.default_rng(1)
    table = {w: rng.normal(size=width) for w in "abcd"}
    given = spark.createDataFrame([(w, v.tolist()) for w, v in table.items()], "term string, vector array<double>")
    got = {r.id: r.vector for r in tokens.mean_pool(docs, given).collect()}
    assert got.keys() == DOCS.keys() and got[3] is None
    for i in (1, 2, 4, 5):
        known = [table[w] for w in DOCS[i] if w in table]
        assert np.allclose(got[i], np.mean(known, axis=0))


def test_vector_sums_with_weights(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 2.0), (1, [0.5, 0.0], 4.0)], "id int, v array<double>, w double")
    assert rows(vectors.sum_vectors(df, "id", "v", "w", 2, "total").selectExpr("id", "v[0]", "v[1]", "total")) == [(1, 4.0, 4.0, 6.0)]


# Neighbours ---------------------------------------------------------------------


def brute_knn(query, base, k):
    out = []
    for qi, q in query:
        near = sorted((float(np.linalg.norm(q - b)), bi) for bi, b in base)[:k]
        out += [(qi, bi, rank) for rank, (_, bi) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("case", ["random", "clusters", "copies"])
def test_knn_equals_brute_force(spark, case):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 8))
    if case == "clusters":
        base = base * 0.05 + rng.integers(0, 6, 300)[:, None] * 10.0
    if case == "copies":
        base[:120] = base[0]  # far more than a third are one vector
    query = np.concatenate([base[100:140] + 0.01 * rng.normal(size=(40, 8)), base[:20]])
    b = [(i, v) for i, v in enumerate(base)]
    q = [(1000 + i, v) for i, v in enumerate(query)]
    schema = "id bigint, vector array<double>"
    got = neighbours.knn_join(
        spark.createDataFrame([(i, v.tolist()) for i, v in q], schema),
        spark.createDataFrame([(i, v.tolist()) for i, v in b], schema),
        k=5, block_rows=37, n_pivots=9,
    )
    assert rows(got.select("query_id", "base_id", "rank")) == brute_knn(q, b, 5)


def test_knn_visits_few_balls_of_clustered_vectors(spark, monkeypatch):
    """Copies of a vector are counted in the tables that are compared."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8)) * 100
    base = [(i, (centres[i % 12] + rng.normal(size=8)).tolist()) for i in range(1200)]
    query = [(5000 + i, (centres[i % 12] + rng.normal(size=8)).tolist()) for i in range(120)]
    schema = "id bigint, vector array<double>"
    seen = []
    whole = neighbours._grid_join

    def counted(left, right, *args, **kwargs):
        seen.append((left.count(), right.count()))
        return whole(left, right, *args, **kwargs)

    monkeypatch.setattr(neighbours, "_grid_join", counted)
    got = neighbours.knn_join(
        spark.createDataFrame(query, schema), spark.createDataFrame(base, schema), block_rows=100, n_pivots=40
    )
    q, b = ([(i, np.array(v)) for i, v in x] for x in (query, base))
    assert rows(got.select("query_id", "base_id", "rank")) == brute_knn(q, b, 5)
    (own, size), (visits, again) = seen
    assert own == len(query) and size == again == len(base)
    assert visits <= 3 * len(query)  # of 12 shelves or more


def test_shelves_hold_a_block_each():
    count = np.array([5, 0, 250, 60, 50, 100, 1])
    first, many = neighbours._shelves(count, 100)
    load = {}
    for ball, n in enumerate(count):
        for s in range(many[ball]):
            load[first[ball] + s] = load.get(first[ball] + s, 0) + n / many[ball]
    assert max(load.values()) <= 100 and many.tolist() == [1, 1, 3, 1, 1, 1, 1]
    marked = np.array([False, False, True, True, False, False, False])
    assert neighbours._visited(marked, first, many).tolist() == sorted({*range(first[2], first[2] + 3), first[3]})


@pytest.mark.parametrize("case", ["clusters", "hot"])
def test_approximate_neighbours(spark, case):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(600, 8)) + rng.integers(0, 9, 600)[:, None] * 20.0
    if case == "hot":
        base[:400] = base[0]
    query = base[:60] + 0.1 * rng.normal(size=(60, 8))
    schema = "id bigint, vector array<double>"
    q = spark.createDataFrame([(5000 + i, v.tolist()) for i, v in enumerate(query)], schema)
    b = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], schema)
    found = neighbours.knn_approximate(q, b, width=12.0, block_rows=64).cache()
    exact = neighbours.knn_join(q, b).cache()
    share = neighbours.recall(found, exact).first().recall
    print(f"recall of 8 tables of 4 numbers, {case}: {share:.3f}")
    assert share >= 0.9
    assert found.select("query_id", "base_id").distinct().count() == found.count()
    assert neighbours.knn_approximate(q, b.limit(0), width=1.0).count() == 0


def test_knn_with_fewer_rows_than_k_and_vote_ties(spark):
    base = spark.createDataFrame([(1, [0.0], "b"), (2, [1.0], "a")], "id bigint, vector array<double>, c string")
    query = spark.createDataFrame([(9, [0.1])], "id bigint, vector array<double>")
    assert rows(neighbours.knn_join(query, base).select("base_id", "rank")) == [(1, 1), (2, 2)]
    assert rows(neighbours.knn_classify(query, base, "c")) == [(9, "a")]


# Scores -------------------------------------------------------------------------


def preds(spark, pairs):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id bigint, label int, prediction int")


def test_report_with_absent_and_never_predicted_classes(spark):
    report = evaluate.classification_report(preds(spark, [(0, 0), (0, 2), (1, 0), (1, 1)]))
    got = {r["class"]: (r.precision, r.recall, r.f1, r.support) for r in report.collect()}
    assert got["0"] == (0.5, 0.5, 0.5, 2)
    assert got["1"] == pytest.approx((1.0, 0.5, 2 / 3, 2))
    assert got["2"] == (0.0, 0.0, 0.0, 0)
    assert got["accuracy"] == (0.5, 0.5, 0.5, 4)
    assert got["macro avg"] == pytest.approx((0.5, 1 / 3, (0.5 + 2 / 3) / 3, 4))
    assert got["weighted avg"] == pytest.approx((0.75, 0.5, (0.5 + 2 / 3) / 2, 4))


def test_confusion_keeps_zeros(spark):
    got = rows(evaluate.confusion_matrix(preds(spark, [(0, 1), (0, 1), (2, 2)])))
    assert got == [(0, 0, 0), (0, 1, 2), (0, 2, 0), (1, 0, 0), (1, 1, 0), (1, 2, 0), (2, 0, 0), (2, 1, 0), (2, 2, 1)]


def test_mcc_of_a_one_class_batch_is_zero(spark):
    pairs = [(1, 1)] * 4 + [(0, 0), (1, 1), (0, 1), (1, 0)] + [(0, 0), (1, 1)]
    got = rows(evaluate.mcc_by_batch(preds(spark, pairs), 4))
    assert got == [(0, 0.0), (1, 0.0), (2, 1.0)]


def test_log_loss_is_clamped(spark):
    df = spark.createDataFrame([(0, [0.5, 0.5]), (1, [1.0, 0.0])], "label int, scores array<double>")
    assert evaluate.log_loss(df).first().log_loss == pytest.approx((math.log(2) - math.log(1e-15)) / 2)


def test_stems_of_repeated_and_null_ids_without_moving_every_token(spark, monkeypatch):
    monkeypatch.setattr(tokens, "_BATCH_DOCS", 2)
    rows = [(1, ["hopping", "cats", "hopping"]), (2, []), (3, None), (None, ["dogs"]), (5, ["b", None, "cats"])]
    once = tokens.stem_documents(spark.createDataFrame(rows, "id long, tokens array<string>"))
    assert "collect_list" not in once._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
    got = {r.id: r.tokens for r in once.collect()}
    assert got == {1: ["hop", "cat", "hop"], 2: [], 3: [], None: ["dog"], 5: ["b", None, "cat"]}
    more = [*rows, (None, ["running", "x"]), (5, ["cats", "running"])]
    twice = tokens.stem_documents(spark.createDataFrame(more, "id long, tokens array<string>"))
    got = {r.id: r.tokens for r in twice.collect()}
    assert got[None] == ["dog", "run", "x"] and got[5] == ["b", "cat", None, "run", "cat"]


def test_numbered_table_of_rows_with_nulls(spark, tmp_path):
    rows = [(i, None if i % 3 else f"a{i}\nb", None if i % 5 else "en", None if i % 7 else "s", i) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    from quire.plans import REGISTRY

    # The filter that went to the wrong side of a join came and went with the timing of stages.
    placed = ordering.dense_position(spark.read.parquet(f"{tmp_path}/documents.parquet"), "doc_id", "row")
    assert "Join" not in placed._jdf.queryExecution().optimizedPlan().toString()  # noqa: SLF001
    assert REGISTRY["csv_round_trip"].run(spark, str(tmp_path)).count() == 1000


def test_weighted_sums_of_a_table_beyond_a_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(4)
    table = spark.createDataFrame([(i, rng.normal(size=5).tolist()) for i in range(23) if i != 7], "idx long, v array<double>")
    cells = [(None if i % 9 == 4 else i % 9, int(rng.integers(23)), float(rng.normal())) for i in range(300)]
    rows = spark.createDataFrame(cells, "id long, idx long, w double")
    whole = {r.id: r.v for r in vectors.weighted_sums(rows, table, "id", "v", "w", 5).collect()}
    for name, size in (("JOINED", 0), ("SENT", 23 * 8 * 2), ("PIECE", 8 * 2 * 6)):
        monkeypatch.setattr(vectors, name, size)
    found = vectors.weighted_sums(rows, table, "id", "v", "w", 5)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().toString()
    got = {r.id: r.v for r in found.collect()}
    assert set(got) == set(whole) == {*range(9)} - {4} | {None}
    assert all(got[k] == pytest.approx(whole[k]) for k in got)
