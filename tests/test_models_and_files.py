import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import functions as F

from quire.operators import evaluate, models, papers
from quire.plans import REGISTRY
from quire.plans.vectors import text_features
from quire.session import scratch_path
from quire.sources import readers, writers
from quire.streaming.ingest import ingest_stream, stream_papers_json


@pytest.fixture(scope="module")
def data(spark):
    train, test, terms = text_features(spark, "/root/testdata/sf0.01")
    return train.cache(), test.cache(), terms


def accuracy(model, test):
    return evaluate.accuracy(models.score(model, test)).first().accuracy


def test_classifiers_learn_the_language(data):
    train, test, _ = data
    assert accuracy(models.logistic_regression(train), test) > 0.93
    assert accuracy(models.support_vectors(train, 20), test) > 0.93


def test_saved_model_predicts_the_same(spark, data):
    train, test, _ = data
    model = models.logistic_regression(train, max_iter=10)
    path = scratch_path(spark, "model")
    model.write().save(path)
    again = LogisticRegressionModel.load(path)
    assert models.score(model, test).exceptAll(models.score(again, test)).count() == 0
    losses = [r.loss for r in models.training_history(model).orderBy("iteration").collect()]
    assert losses[-1] < losses[0]


def test_class_terms_are_extremes_of_the_coefficients(data):
    train, _, terms = data
    fitted = models.binary_models(train, max_iter=30)
    got = models.class_terms(fitted, terms, 3).toPandas()
    for cls, model in enumerate(fitted.models):
        coef = np.sort(model.coefficients.toArray())
        want = np.sort(np.concatenate([coef[:3], coef[-3:]]))
        assert np.allclose(np.sort(got[got.cls == cls]["coef"]), want)
    assert (got["positive"] == (got["coef"] > 0)).all()


def test_perceptron_learns_a_separable_rule(spark):
    rng = np.random.default_rng(0)
    points = rng.normal(size=(300, 4))
    rows = [(i, v.tolist(), float(v[0] > 0)) for i, v in enumerate(points)]
    df = models.dense_features(spark.createDataFrame(rows, "id bigint, v array<double>, label double"), "v")
    assert accuracy(models.perceptron(df, 4, 2), df) > 0.95


def test_svd_equals_numpy(spark):
    rng = np.random.default_rng(4)
    dense = rng.normal(size=(60, 6))
    dense[7] = 0.0
    cells = [(i, j, float(dense[i, j])) for i in range(60) for j in range(6) if dense[i, j]]
    weights = spark.createDataFrame(cells, "id bigint, idx bigint, tfidf double")
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(dense)], "id bigint, v array<double>")
    basis, values = models.svd_basis(models.dense_features(rows, "v"), 2)
    _, singular, loadings = np.linalg.svd(dense, full_matrices=False)
    assert np.allclose(values, singular[:2])
    got = np.array([r.loadings for r in basis.orderBy("idx").collect()])
    assert np.allclose(np.abs(got), np.abs(loadings[:2].T), atol=1e-6)
    assert (got[np.abs(got).argmax(axis=0), [0, 1]] > 0).all()
    scores = np.array([r.scores for r in models.svd_scores(weights, basis, rows).orderBy("id").collect()])
    assert np.allclose(scores, dense @ got)


def test_kmeans_separates_clear_groups(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=3) * 0.1 + 10 * (i % 3)).tolist()) for i in range(90)]
    df = models.dense_features(spark.createDataFrame(rows, "id bigint, v array<double>"), "v")
    _, clusters = models.kmeans(df, k=3, seed=1)
    groups = clusters.groupBy((F.col("id") % 3).alias("g")).agg(F.count_distinct("cluster").alias("n"))
    assert [r.n for r in groups.collect()] == [1, 1, 1]


def test_projection_has_every_sampled_document(spark, sf_dir):
    got = REGISTRY["project_2d"].run(spark, sf_dir)
    assert got.count() == 200 and got.where("x IS NULL OR cluster IS NULL").count() == 0


# Files --------------------------------------------------------------------------

RECORD = '{"id": "%s", "update_date": "2001-01-01", "authors": "A", "categories": "c", "versions": [{"version": "v1", "created": "x"}]}'


def json_lines(spark, lines):
    path = scratch_path(spark, "lines")
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(path)
    return path


def test_malformed_line_fails_or_is_dropped(spark):
    path = json_lines(spark, [RECORD % "1", '{"id": "2", "upd', RECORD % "3"])
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        readers.read_papers_json(spark, path).collect()
    kept = readers.read_papers_json(spark, path, bad_records="drop")
    assert sorted(r.id for r in kept.select("id", "categories").collect()) == ["1", "3"]


def test_missing_keys_are_null(spark):
    row = papers.project_papers(readers.read_papers_json(spark, json_lines(spark, [RECORD % "1"]))).first()
    assert (row.author, row.doi, row.journal, row.general_category) == ("A", None, None, "c")


def test_stream_and_batch_ingest_agree(spark):
    path = json_lines(spark, [RECORD % i for i in range(5)] + [(RECORD % 9).replace('"c"', '"other c"')])
    dim = spark.createDataFrame([("c",)], "code string")
    out = scratch_path(spark, "out")
    ingest_stream(stream_papers_json(spark, path), dim, out, scratch_path(spark, "progress")).awaitTermination()
    batch = papers.ingest_filter(papers.project_papers(readers.read_papers_json(spark, path)), dim)
    stream = spark.read.schema(batch.schema).parquet(out)
    assert sorted(r.id for r in stream.collect()) == sorted(r.id for r in batch.collect()) == list("01234")


def test_text_tables_keep_awkward_values(spark):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "text")])
    values = [("1", 'a "quoted", value'), ("2", "line\nbreak\ttab"), ("3", None), ("4", "back\\slash")]
    values += [("5", ""), ("6", " spaces "), ("7", "\r\n\n\r"), ("8", "\\nu \x1bn \x1b\n\x1be"), ("9", "\x1be")]
    for sep in ("\t", ","):
        path = scratch_path(spark, "table")
        writers.write_table(spark.createDataFrame(values, schema), path, sep)
        got = sorted(tuple(r) for r in readers.read_table(spark, path, schema, sep).collect())
        assert got == values


def test_written_tables_are_cut_inside_files(spark):
    rows = [(str(i), "line\nbreak " * 50) for i in range(2000)]
    path = scratch_path(spark, "table")
    writers.write_table(spark.createDataFrame(rows, "id string, text string").coalesce(1), path)
    schema = spark.createDataFrame(rows[:1], "id string, text string").schema
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        back = readers.read_table(spark, path, schema, ",")
        assert back.select(F.spark_partition_id()).distinct().count() > 3
        assert sorted(tuple(r) for r in back.collect()) == sorted(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("text", ['"1","line\nbreak, x"\n', '"1","line\n""two"",x"\n', '"1","line\nplain\n"\n'])
def test_raw_line_breaks_fail_or_need_a_flag(spark, text):
    path = scratch_path(spark, "raw")
    whole = spark.createDataFrame([('"id","text"\n' + text + '"2","b"',)], "value string")
    whole.coalesce(1).write.text(path)
    schema = spark.createDataFrame([("", "")], "id string, text string").schema
    with pytest.raises(Exception, match="multi_line"):
        readers.read_table(spark, path, schema, ",").collect()
    assert readers.read_table(spark, path, schema, ",", multi_line=True).count() == 2


def test_marks_of_foreign_files_are_left_alone(spark):
    path = scratch_path(spark, "foreign")
    spark.createDataFrame([("id,text\n1,\\nu and \\rho\n2,plain",)], "value string").coalesce(1).write.text(path)
    schema = spark.createDataFrame([("", "")], "id string, text string").schema
    assert sorted(tuple(r) for r in readers.read_table(spark, path, schema, ",").collect()) == [("1", "\\nu and \\rho"), ("2", "plain")]


def test_vectors_survive_text_exactly(spark):
    df = spark.createDataFrame([(1, [0.1, -1e-9, 3.0])], "id bigint, vector array<float>")
    path = scratch_path(spark, "vectors")
    writers.write_vectors(df, path)
    back = readers.read_vectors(spark, path).first()
    assert back.id == 1 and back.vector == df.first().vector


def test_fixed_lists(spark):
    dim = readers.category_dim(spark)
    assert dim.count() == 153 and dim.select("code").distinct().count() == 153
    from quire.constants import ENGLISH_STOP_WORDS, NON_PERSON_NAMES

    assert len(set(NON_PERSON_NAMES)) == 51 and "d  collaboration" in NON_PERSON_NAMES
    assert len(set(ENGLISH_STOP_WORDS)) == 181
