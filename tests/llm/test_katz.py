"""The language model against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quire.llm import katz
from quire.llm.queries import op13_katz_scores

END, BEGIN, UNKNOWN = "<end>", "<begin>", "<unknown>"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Model:
    """The same model with dictionaries and plain recursion."""

    def __init__(self, texts):
        self.c1, self.c2 = Counter(), Counter()
        for text in texts:
            tokens = self.tokens(text)
            self.c1.update(tokens)
            self.c2.update(zip([BEGIN, *tokens], tokens, strict=False))
        self.n = sum(self.c1.values())
        self.d1, self.d2 = (
            katz.discounts([sum(c == r for c in counts.values()) for r in range(1, katz.K + 2)]) for counts in (self.c1, self.c2)
        )
        self.after = defaultdict(list)
        for h, w in self.c2:
            self.after[h].append(w)
        self.unknown = 1 - sum(self.p1(w) for w in self.c1)

    @staticmethod
    def tokens(text):
        return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), END]

    @staticmethod
    def cut(c, d):
        return c * (d[c - 1] if c <= katz.K else 1)

    def p1(self, w):
        return self.cut(self.c1[w], self.d1) / (self.n + 1) if self.c1[w] else self.unknown

    def p(self, w, h):
        seen = self.after.get(h, [])
        total = sum(self.c2[h, x] for x in seen) + 1
        if self.c2[h, w]:
            return self.cut(self.c2[h, w], self.d2) / total
        left = 1 - sum(self.cut(self.c2[h, x], self.d2) / total for x in seen)
        return left / (1 - sum(self.p1(x) for x in seen)) * self.p1(w)

    def row(self, text):
        tokens = self.tokens(text)
        base = sum(math.log10((self.c1[w] + 1) / (self.n + len(self.c1) + 1)) for w in tokens)
        score = sum(math.log10(self.p(w, h)) for h, w in zip([BEGIN, *tokens], tokens, strict=False))
        return len(tokens), sum(self.c1[w] > 0 for w in tokens), self.n, base, score


def same(got, rows, trained):
    model = Model([t for i, t in rows if trained(i)])
    wanted = sorted((str(i), not trained(i), *model.row(t)) for i, t in rows)
    found = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    assert [x[:5] for x in found] == [x[:5] for x in wanted]
    for a, b in zip(found, wanted, strict=True):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)
    return model


def some(seed, n, size):
    draw = random.Random(seed)
    words = [f"W{min(draw.randrange(1, 400), draw.randrange(1, 400))}" for _ in range(300)]
    return [(i, " ".join(draw.choice(words) for _ in range(draw.randrange(size)))) for i in range(n)]


def test_discounts():
    d = katz.discounts([1000, 300, 140, 80, 50, 35])
    a = 6 * 35 / 1000
    assert d == pytest.approx([((r + 1) * y / (r * x) - a) / (1 - a) for r, x, y in zip(range(1, 6), [1000, 300, 140, 80, 50], [300, 140, 80, 50, 35], strict=True)])
    assert katz.discounts([10, 3, 1, 0, 0, 0])[2:] == [1.0] * 3
    assert katz.discounts([0] * 6) == [1 - 0.5 / r for r in range(1, 6)]


def test_scores_equal_plain_recursion_and_are_normalised(spark, docs_of):
    rows = some(1, 150, 60)
    got = katz.score(docs_of(rows), F.col("doc_id") % 4 != 1).collect()
    model = same(got, rows, lambda i: i % 4 != 1)
    for h in [BEGIN, "w1", "w2", *list(model.c1)[:20], "never seen"]:
        assert sum(model.p(w, h) for w in model.c1) + model.p(UNKNOWN, h) == pytest.approx(1)


@pytest.mark.parametrize(("bucket", "fan"), [(500, 256), (300, 3)])
def test_many_buckets_frequent_words_and_rounds(spark, docs_of, bucket, fan):
    draw = random.Random(4)
    rows = [(i, " ".join(draw.choice(["the", "the", "the", f"x{draw.randrange(200)}"]) for _ in range(40))) for i in range(120)]
    got = katz.score(docs_of(rows), F.col("doc_id") % 4 != 1, bucket=bucket, fan=fan).collect()
    same(got, rows, lambda i: i % 4 != 1)


def test_odd_rows(spark, docs_of, odd):
    rows = [*odd, (7, "É Wörd WÖRD\tone\x0btwo\x0cthree\r\n"), (8, " ")]
    same(katz.score(docs_of(rows), F.col("doc_id") % 4 != 1).collect(), rows, lambda i: i is None or i % 4 != 1)


def test_texts_longer_than_a_piece_and_documents_over_chunks(spark, docs_of, monkeypatch):
    monkeypatch.setattr(katz, "PIECE", 50)
    monkeypatch.setattr(katz, "CHUNK", 20)

    rows = some(3, 30, 200)
    assert list(katz._pieces(b"a" * 70 + b" b")) == [b"a" * 70, b" b"]
    batch_tokens = []

    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays(
        [pa.array([i for i, _ in rows]), pa.array([True] * len(rows)), pa.array([t for _, t in rows])], names=["id", "trained", "text"]
    )
    opened, tokens = [], 0
    for begun, word, history, doc, learnt in katz._chunks(iter([batch])):
        opened += [i for _, i, _ in begun]
        tokens += word.size
        batch_tokens.append(word.size)
        assert history.size == doc.size == learnt.size == word.size
    assert opened == [i for i, _ in rows]
    assert tokens == sum(len(Model.tokens(t)) for _, t in rows)
    assert max(batch_tokens) < 20 + 26 and len(batch_tokens) > 30


def test_nothing_to_learn_from_and_no_rows(spark, docs_of):
    got = katz.score(docs_of([(1, "a b"), (2, None)]), F.lit(False)).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in got} == {(1, 3, 0, 0, 0), (2, 1, 0, 0, 0)}
    assert katz.score(docs_of([(1, "a")]).limit(0), F.lit(True)).count() == 0


def test_query_on_given_documents(spark, sf_dir):
    from zlib import crc32

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = op13_katz_scores(spark, sf_dir).collect()
    same(got, rows, lambda i: crc32(str(i).encode()) % 7 != 2)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
