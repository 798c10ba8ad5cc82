"""Epoch orders, sketches, kernel features and trained heads."""

import numpy as np
import pytest

from quire.operators import heads, kernels, ordering, profile
from quire.session import scratch_path


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 17, 100, 1000, 4097])
def test_epoch_places_are_a_permutation(spark, n):
    row = spark.range(n).select(*[ordering.epoch_place("id", n, e).alias(f"e{e}") for e in (1, 2)]).toPandas()
    assert sorted(row["e1"]) == sorted(row["e2"]) == list(range(n))
    if n > 5:
        assert (row["e1"] != row["e2"]).any() and (row["e1"] != range(n)).any()


def test_epoch_order_is_reproducible_and_looks_random(spark):
    df = spark.createDataFrame([(f"id{i:04}",) for i in range(900)], "id string").repartition(5)
    one = {r.id: r.place for r in ordering.epoch_order(df, "id", 3).collect()}
    assert one == {r.id: r.place for r in ordering.epoch_order(df.repartition(2), "id", 3).collect()}
    places = np.array([one[f"id{i:04}"] for i in range(900)])
    assert abs(np.corrcoef(places[:-1], places[1:])[0, 1]) < 0.15
    assert abs(np.corrcoef(places, np.arange(900))[0, 1]) < 0.15


def test_sketches_merge_without_counting_twice(spark):
    rows = [(f"{1990 + y}-01-01", c, ", ".join(f"Ann {k}" for k in range(y, y + 400))) for y in range(5) for c in "ab"]
    papers = spark.createDataFrame(rows, "update_date string, general_category string, author string")
    sketches = profile.author_sketches(papers)
    assert sketches.count() == 10
    for keys, exact in (([], 404), (["general_category"], 404), (["year"], 400)):
        for r in profile.sketched_authors(sketches, *keys).collect():
            assert abs(r.n_authors - exact) <= 1 + 4 * 1.04 / 64 * exact
    assert profile.sketched_authors(sketches.where("false"), "year").count() == 0


def test_kernel_error_shrinks_with_width(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id long, vector array<double>")
    true = np.exp(-0.3 * np.square(x[:, None] - x[None]).sum(axis=2))
    errors = []
    for width in (50, 800, 12_800):
        rows = kernels.fourier_features(df, gamma=0.3, width=width).orderBy("id").collect()
        assert rows[-1].features is None
        f = np.array([r.features.toArray() for r in rows[:-1]])
        errors.append(np.sqrt(np.mean((f @ f.T - true) ** 2)))
    assert errors[0] > 2 * errors[1] > 4 * errors[2]


def test_gradient_equals_differences():
    rng = np.random.default_rng(2)
    for hidden in ((), (4,), (5, 3)):
        head = heads.new_head(6, 3, hidden)
        x, y = rng.normal(size=(7, 6)), rng.integers(0, 3, 7)
        g, loss = head.gradient(x, y)
        for at in rng.integers(0, head.values.size, 12):
            step = np.zeros(head.values.size)
            step[at] = 1e-6
            other = heads.Head(head.widths, head.values + step).gradient(x, y)[1]
            assert (other - loss) / 1e-6 == pytest.approx(g[at], abs=1e-3)


def test_head_learns_goes_on_and_reports(spark):
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    rows = [(i, v.tolist(), float(v[0] + v[1] > 0)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label double").withColumn("features", array_to_vector("v"))
    train, valid = df.where("id % 4 > 0"), df.where("id % 4 = 0")
    path = scratch_path(spark, "head")
    heads.train_head(train, valid, 2, (8,), epochs=2, steps=3, rate=0.2, path=path)
    head, history = heads.train_head(train, valid, 2, (8,), epochs=5, steps=3, rate=0.2, path=path)
    whole, straight = heads.train_head(train, valid, 2, (8,), epochs=5, steps=3, rate=0.2)
    assert np.allclose(head.values, whole.values)
    got = [tuple(r)[:4] for r in history.orderBy("epoch").collect()]
    assert np.allclose(got, [tuple(r)[:4] for r in straight.orderBy("epoch").collect()])
    assert [r[0] for r in got] == list(range(1, 6)) and got[-1][3] > 0.9 and got[-1][1] < got[0][1]
    scored = heads.score_head(head, valid).collect()
    assert np.mean([r.label == r.prediction for r in scored]) == pytest.approx(got[-1][3])


def test_head_without_rows(spark):
    from pyspark.ml.functions import array_to_vector

    df = spark.createDataFrame([(1, [1.0], 0.0)], "id long, v array<double>, label double").withColumn("features", array_to_vector("v"))
    _, history = heads.train_head(df.where("false"), df, 2, (), epochs=1, steps=1)
    assert history.first().loss is None
