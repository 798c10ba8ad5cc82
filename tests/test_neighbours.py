import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import neighbours


def test_a_block_holds_few_distances_at_once():
    draw = np.random.default_rng(2)
    base, query = draw.normal(size=(16_384, 8)), draw.normal(size=(600, 8))
    tracemalloc.start()
    rows, cols, away = neighbours.nearest_in_block(query, base, np.arange(len(base)), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # all distances are 79 MB
    for row in (0, 63, 64, 599):
        true = np.sqrt(np.square(base - query[row]).sum(axis=1))
        assert cols[rows == row].tolist() == np.argsort(true)[:5].tolist()
        assert away[rows == row] == pytest.approx(np.sort(true)[:5])


@pytest.mark.parametrize("block_rows", [16, 10_000])
def test_neighbours_with_null_and_text_ids_and_null_labels(spark, block_rows):
    draw = np.random.default_rng(3)
    points = draw.normal(size=(120, 4)).round(1)
    names = [None if i == 5 else f"é{i}" if i % 2 else f"z{i}" for i in range(120)]
    data = [(n, p.tolist(), None if i % 3 else "c") for i, (n, p) in enumerate(zip(names, points))]
    base = spark.createDataFrame(data, "id string, vector array<float>, vote string").repartition(3)
    queries = base.where(F.col("id").startswith("z")).select("id", "vector")
    found = neighbours.knn_join(queries, base, 4, block_rows=block_rows, carry=("vote",))
    got = {(r.query_id, r["rank"]): (r.base_id, round(r.distance, 5), r.vote) for r in found.collect()}
    kept = np.array([p for p in points]).astype(np.float32).astype(float)
    for i in range(0, 120, 2):
        away = np.sqrt(np.square(kept - kept[i]).sum(axis=1)).round(5)
        best = sorted(range(120), key=lambda j: (away[j], names[j] is None, (names[j] or "").encode()))[:4]
        assert [got[names[i], k + 1][1] for k in range(4)] == [away[j] for j in best]
        assert all(got[names[i], k + 1][2] == data[names.index(got[names[i], k + 1][0])][2] for k in range(4))


def test_vectors_of_unequal_length_are_an_error(spark):
    base = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0])], "id bigint, vector array<double>")
    with pytest.raises(Exception, match="same length"):
        neighbours.knn_join(base.where("id = 1"), base).collect()


def test_hash_tables_do_not_depend_on_the_rows_held_at_once(spark, monkeypatch):
    draw = np.random.default_rng(4)
    data = [(i, (draw.integers(0, 6) * 20 + draw.normal(size=4)).tolist()) for i in range(200)]
    base = spark.createDataFrame(data, "id bigint, vector array<double>").coalesce(1)
    queries = base.where("id % 5 = 0")

    def found():
        near = neighbours.knn_approximate(queries, base, width=12.0, k=3, block_rows=50)
        return sorted((r.query_id, r["rank"], r.base_id, round(r.distance, 9)) for r in near.collect())

    whole = found()
    assert len(whole) > 100
    monkeypatch.setattr(neighbours, "_ROWS", 7)
    monkeypatch.setattr(neighbours, "_CELLS", 60)
    assert found() == whole
