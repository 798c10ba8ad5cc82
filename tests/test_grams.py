import numpy as np
import pyarrow as pa
import pytest

from quire.operators import grams, lookup, tfidf
from test_operators import brute_tfidf

TEXTS = {
    1: "a b c a b c d", 2: "a b c x", 3: "x a b", 4: "", 5: "c d a b c", 6: "a", 7: "b c d é b c d ß", 8: "x x x x",
}


def with_grams(words, low, high):
    return [" ".join(words[i : i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize(("least", "most", "sizes"), [(2, 1.0, (1, 3)), (2, 0.5, (1, 2)), (1, 1.0, (2, 3)), (9, 1.0, (1, 3))])
def test_ngram_weights_equal_brute_force_without_moving_their_rows(spark, monkeypatch, least, most, sizes):
    monkeypatch.setattr(grams, "BATCH_DOCS", 3)
    docs = spark.createDataFrame([(i, t.split()) for i, t in TEXTS.items()] + [(9, None)], "id bigint, tokens array<string>").coalesce(2)
    model = tfidf.fit_tfidf(docs, least, most, ngrams=sizes)
    found = model.transform(docs)
    expected = brute_tfidf({i: with_grams(t.split(), *sizes) for i, t in TEXTS.items()} | {9: []}, least, most)
    assert {(r.id, r.term): r.tfidf for r in found.collect()} == pytest.approx(expected)
    # No row per document and term is dealt out and sorted for the length of its document.
    assert "Window" not in found._jdf.queryExecution().toString()
    monkeypatch.setattr(lookup, "fits_broadcast", lambda *a, **k: False)
    assert {(r.id, r.term): r.tfidf for r in model.transform(docs).collect()} == pytest.approx(expected)


def test_ngrams_of_repeated_and_null_ids_and_of_tokens_with_blanks(spark):
    rows = [(1, ["a", "b"]), (1, ["c", "a", "b"]), (None, ["a b"]), (2, ["a", None, "b", "c"])]
    docs = spark.createDataFrame(rows, "id bigint, tokens array<string>")
    model = tfidf.fit_tfidf(docs, 1, ngrams=(2, 2))
    got = {(r.id, r.term) for r in model.transform(docs).collect()}
    assert got == {(1, "a b"), (1, "c a"), (2, "b c")}  # none across the rows of an id
    assert {r.term: r.df for r in model.terms.collect()} == {"a b": 2, "c a": 1, "b c": 1}
    whole = spark.createDataFrame([(1, ["a b", "c", "a", "b c"])], "id bigint, tokens array<string>")
    model = tfidf.fit_tfidf(whole, 1, ngrams=(2, 2))
    assert {r.term: r.df for r in model.terms.collect()} == {"a b c": 1, "c a": 1}


def test_bits_hold_all_terms_and_few_others(spark):
    words = pa.array([f"w{i} é{i % 7}" for i in range(3000)] + [""])
    bits = grams.bits_of(spark.createDataFrame([(w,) for w in words.to_pylist()[:1500]], "term string"))
    held = bits.may_hold(grams._hashed(words)[0])
    assert held[:1500].all() and held[1500:].mean() < 0.2
    sliced = grams._hashed(words.slice(5, 9))
    assert all(np.array_equal(a[5:14], b) for a, b in zip(grams._hashed(words), sliced))


def test_rows_of_a_batch_leave_it_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(grams, "_ROWS", 4)
    docs = spark.createDataFrame([(i, t.split()) for i, t in TEXTS.items()] + [(9, None), (None, ["a", "b"])], "id bigint, tokens array<string>")
    model = tfidf.fit_tfidf(docs, 1, ngrams=(1, 2))
    found = model.transform(docs.coalesce(1))
    assert "CoGroups" not in found._jdf.queryExecution().toString()  # which holds all rows of a batch at once
    expected = brute_tfidf({i: with_grams(t.split(), 1, 2) for i, t in TEXTS.items()} | {9: [], None: ["a", "b", "a b"]}, 1, 1.0)
    assert {(r.id, r.term): r.tfidf for r in found.collect()} == pytest.approx(expected)
    one = pa.record_batch(
        [pa.array([0]), pa.array([[7, 8]], pa.list_(pa.int64())), pa.array([3]), grams._packed(np.array([0, 1, 1, 1, 1, 1])), grams._packed(np.ones(6, np.int64))],
        names=["b", "ids", "many", "steps", "times"],
    )
    terms = pa.table({"u": pa.array([2, 0, 1], pa.int32()), "term": ["c", "a", "b"], "idx": [2, 0, 1], "idf": [3.0, 0.0, 4.0]})
    parts = list(grams._weighed(one, terms, ["id", "term", "idx", "tfidf"]))
    assert [p.num_rows for p in parts] == [4, 2]
    rows = [tuple(r.values()) for p in parts for r in p.to_pylist()]
    assert rows == [(i, *t) for i in (7, 8) for t in (("a", 0, 0.0), ("b", 1, 0.8), ("c", 2, 0.6))]
