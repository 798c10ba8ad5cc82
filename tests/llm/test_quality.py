"""Ledger, policies and ablation against plain Python."""

import re
from collections import Counter

from quire.llm import quality


def measured(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(hit),
    )


def test_ledger_equals_plain_counts(spark, sf_dir, docs_of, odd):
    texts = [
        *odd,
        (10, "a b c d e f a b c d e"),
        (11, "x " * 9),
        (12, "same line here\nsame line here\n\n \nother"),
        (13, "### $$$ | % & <a> *"),
        (14, "a a a a a a a a a a a a"),
    ]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    texts += [(i + 100, t) for i, t in rows]
    got = quality.apply_policy(quality.ledger(docs_of(texts))).collect()
    assert len(got) == len(texts)
    found = Counter(
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got
    )
    wanted = Counter()
    for i, t in texts:
        m = measured(t)
        wanted[(i, *m, m[0] < 10 or 100 * m[4] > 20 * m[0])] += 1
    assert found == wanted


def test_ablation_counts_each_rule(spark, docs_of):
    plain = "these are some quite ordinary words in a short but clean text"
    rows = [(1, plain), (2, "few"), (3, plain.upper()), (4, "# " + plain + " # # #"), (5, None)]
    ledger = quality.ledger(docs_of(rows))
    got = {r["rule"]: r for r in quality.ablation(ledger, "v3").collect()}
    assert set(got) == set(quality.POLICIES["v3"])
    bits = [r.fail_bits for r in ledger.collect()]
    for name, row in got.items():
        bit = quality.mask_of((name,))
        assert row.n_failed == sum(b & bit > 0 for b in bits)
        assert row.n_only == sum(b == bit for b in bits)
        assert row.n_kept_without == sum(b & ~bit == 0 for b in bits)
        assert row.n_kept == sum(b == 0 for b in bits)


def test_empty_table(docs_of):
    empty = docs_of([(1, "a")]).limit(0)
    assert quality.ledger(empty).count() == 0
    assert {r.n_failed for r in quality.ablation(quality.ledger(empty)).collect()} == {0}
