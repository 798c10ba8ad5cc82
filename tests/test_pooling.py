import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import lookup, tokens
from quire.session import materialise

WORDS = "a b c d e f g".split()


def expected(rows, vectors):
    out = {}
    for i, words in rows:
        out.setdefault(i, []).extend(v for w in words or [] if w for v in vectors.get(w, []))
    return {i: tuple(np.mean(v, axis=0).round(9)) if v else None for i, v in out.items()}


def got(found):
    return {r.id: None if r.vector is None else tuple(np.round(r.vector, 9)) for r in found.collect()}


def rows_of(repeats):
    draw = np.random.default_rng(1)
    rows = [(i, [WORDS[k] for k in draw.integers(0, 7, draw.integers(0, 30))]) for i in range(60)]
    rows += [(100, None), (101, []), (102, ["g", "g"]), (103, ["a", None, "g"])]
    return rows + ([(3, ["a", "b"]), (None, ["c"]), (None, ["d", "g"])] if repeats else [])


@pytest.mark.parametrize("repeats", [False, True])
def test_vectors_beyond_the_broadcast_limit_move_once_a_batch(spark, monkeypatch, repeats):
    monkeypatch.setattr(tokens, "_SUM_ROWS", 7)
    rows = rows_of(repeats)
    docs = spark.createDataFrame(rows, "id bigint, tokens array<string>").coalesce(1)
    given = {w: [[float(k), 1.0 / (k + 1), -2.0]] for k, w in enumerate(WORDS[:6])}
    vectors = spark.createDataFrame([(w, v[0]) for w, v in given.items()], "term string, vector array<float>")
    want = expected(rows, {w: [np.float32(v[0]).astype(float)] for w, v in given.items()})
    vectors = materialise(vectors, "vectors")
    assert got(tokens.mean_pool(docs, vectors)) == want
    spark.conf.set("spark.quire.broadcastLimit", "0")
    moved = []

    def seen(facts, dictionary, key, *args, **kwargs):
        moved.append(facts.count())
        return lookup.lookup(facts, dictionary, key, *args, **kwargs)

    monkeypatch.setattr(tokens, "lookup", seen)
    try:
        assert got(tokens.mean_pool(docs, vectors)) == want
    finally:
        spark.conf.unset("spark.quire.broadcastLimit")
    assert moved == [len(WORDS)]  # not one for each of the tokens


def test_terms_that_share_vectors(spark):
    rows = rows_of(False)
    docs = spark.createDataFrame(rows, "id bigint, tokens array<string>").repartition(3)
    places = materialise(spark.createDataFrame([(w, k % 3) for k, w in enumerate(WORDS)], "term string, place bigint"), "places")
    # Place 1 is repeated, place 2 has a null element and is too long, place 0 is null.
    held = [(0, None), (1, [1.0, 2.0]), (1, [5.0, 2.0]), (2, [None, 7.0, 3.0]), (9, [1.0, 1.0])]
    vectors = spark.createDataFrame(held, "place bigint, vector array<float>")
    of = {0: [], 1: [[1.0, 2.0], [5.0, 2.0]], 2: [[0.0, 7.0]]}
    found = tokens.mean_pool(docs, vectors.orderBy(F.size("vector")), places=places)
    assert got(found) == expected(rows, {w: of[k % 3] for k, w in enumerate(WORDS)})
