"""Factors of words and suffixes of bytes against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from quire.llm import blocks, factors, suffixes


def by_words(rows, length):
    first = {}
    cut = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in cut:
        for p in range(len(w) - length + 1):
            k = tuple(w[p : p + length])
            if k not in first or (i is not None and (first[k] is None or i < first[k])):
                first[k] = i
    out = {}
    for (i, text), (_, w) in zip(rows, cut, strict=True):
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            source = first[tuple(w[p : p + length])]
            if source is not None and (i is None or source < i):
                gone[p : p + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i, text or ""] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def by_bytes(rows, length):
    cut = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(d[p : p + length] for _, d in cut for p in range(len(d) - length + 1))
    out = {}
    for (i, text), (_, d) in zip(rows, cut, strict=True):
        gone = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        runs = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        kept = bytes(x for x, g in zip(d, gone, strict=True) if not g)
        out[i, text or ""] = (len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def mixture(seed, letters, joint):
    """Texts that share passages, repeat themselves, and come as copies."""
    rng = random.Random(seed)
    base = [joint.join(rng.choice(letters) for _ in range(60)) for _ in range(6)]
    rows = [(None, base[0]), (None, base[1] + joint + "q"), (1, ""), (2, None), (3, " \n ")]
    for i in range(4, 60):
        text = joint.join(rng.choice(base)[: rng.randint(5, 120)] for _ in range(rng.randint(1, 4)))
        if rng.random() < 0.3:
            text = joint.join([rng.choice("xyzé")] * rng.randint(1, 90))
        rows.append((i, text))
    return rows + rows[:7] + [(4, "another text of this id")]


@pytest.mark.parametrize("seed", [1, 2])
def test_words_against_brute_force(docs_of, seed):
    rows = mixture(seed, "abc", " ")
    got = factors.dedup(docs_of(rows), length=12, gram=3).collect()
    wanted = by_words(rows, 12)
    assert len(got) == len(wanted)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == Counter(
        (i, *v) for (i, _), v in wanted.items()
    )
    for r in got:
        assert sum(f["words"] for f in r.factors) == r.n_removed
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


@pytest.mark.parametrize("seed", [1, 3])
def test_bytes_against_brute_force(docs_of, seed):
    rows = mixture(seed, "abc", "")
    got = suffixes.dedup(docs_of(rows), length=12, gram=5).collect()
    wanted = by_bytes(rows, 12)
    assert len(got) == len(wanted)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter(
        (i, *v) for (i, _), v in wanted.items()
    )


def test_whole_tables_against_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    words = factors.dedup(df, keep_text=False).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in words} == {
        i: v for (i, _), v in by_words(rows, 50).items()
    }
    found = suffixes.dedup(df, keep_bytes=False).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == {
        i: v for (i, _), v in by_bytes(rows, 400).items()
    }


def test_passages_of_over_50_words_go_from_400_bytes_on(docs_of):
    rng = random.Random(9)

    def prose(words):
        return " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(words))

    planted = {}
    rows = []
    for size in (390, 399, 400, 401, 420):
        passage = prose(61)[:size]
        assert len(passage.split()) > 50 and len(passage) == size
        for place in ("start", "middle", "end"):
            # Bytes of its own stand on both sides, so that nothing longer is shared.
            mark = chr(ord("A") + len(rows))
            before, after = (prose(80) + mark) * (place != "start"), (mark + prose(80)) * (place != "end")
            planted[len(rows)] = size if size >= 400 else 0
            rows.append((len(rows), before + passage + after))
    rows += [(len(rows) + k, prose(200)) for k in range(5)]
    found = {r.doc_id: r for r in suffixes.dedup(docs_of(rows), keep_bytes=False).collect()}
    assert {i: r.n_removed for i, r in found.items()} == {i: planted.get(i, 0) for i, _ in rows}
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in found.items()} == {
        i: v for (i, _), v in by_bytes(rows, 400).items()
    }


def test_texts_join_by_shuffle_with_the_same_rows(docs_of, monkeypatch):
    rows = mixture(5, "abc", " ")
    sent = {tuple(r) for r in factors.dedup(docs_of(rows), length=12, gram=3, keep_text=False).drop("factors").collect()}
    monkeypatch.setattr(blocks, "SENT_KEYS", 0)
    shuffled = factors.dedup(docs_of(rows), length=12, gram=3, keep_text=False).drop("factors").collect()
    assert {tuple(r) for r in shuffled} == sent


def test_odd_rows_and_empty_tables(docs_of, odd):
    wanted = by_words(odd, 50)
    got = factors.dedup(docs_of(odd), keep_text=False).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == Counter(
        (i, *v) for (i, _), v in wanted.items()
    )
    long = [r for r in suffixes.dedup(docs_of(odd), keep_bytes=False).collect() if r.doc_id == 5]
    assert [(r.n_bytes, r.n_removed, r.n_spans) for r in long] == [(180_000, 180_000, 1)]
    empty = docs_of(odd).limit(0)
    assert factors.dedup(empty).count() == 0 and suffixes.dedup(empty).count() == 0
