"""Near-duplicate groups and components against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quire.llm import minmax
from quire.llm.graph import components


def brute(rows, size):
    rows = list(dict.fromkeys((i, t or "") for i, t in rows))
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        k = min(size, len(w))
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, a in enumerate(sets):
        for y in range(x):
            both = len(a & sets[y])
            if both and 100 * both >= 80 * (len(a) + len(sets[y]) - both):
                parent[root(x)] = root(y)
    members = defaultdict(list)
    for x, (i, _) in enumerate(rows):
        members[root(x)].append(i)
    return [
        (i, len(sets[x]), min((j for j in members[root(x)] if j is not None), default=None))
        for x, (i, _) in enumerate(rows)
    ]


def edited(seed, n, most):
    """Documents edited from a few, at similarities around the threshold."""
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(300)}" for _ in range(80)] for _ in range(5)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(80)] = f"w{rng.randrange(1000)}"
        rows.append((1000 - i, "  ".join(w[: rng.randint(60, 80)])))
    return rows


@pytest.mark.parametrize("size", [2, 5])
def test_groups_against_brute_force(docs_of, odd, size):
    rows = [*odd, (7, "ONE two THREE"), (8, "a"), (9, "a"), *edited(size, 250, 12)]
    rows += rows[-3:]
    got = minmax.near_duplicates(docs_of(rows), size=size).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute(rows, size))
    stand = defaultdict(int)
    for r in got:
        if r.n_shingles and r.component_id != 4:  # 4 has two texts, in groups of their own
            stand[r.component_id] += r.stands
    assert set(stand.values()) == {1}


@pytest.mark.parametrize("small,part", [(2, 1 << 20), (0, 600)])
def test_large_buckets_by_index(docs_of, small, part, monkeypatch):
    """All buckets, or those of three and more, through the index; and cut into parts."""
    monkeypatch.setattr(minmax, "SMALL_BUCKET", small)
    monkeypatch.setattr(minmax, "PART", part)
    rows = edited(9, 220, 14)
    got = minmax.near_duplicates(docs_of(rows), size=2).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute(rows, 2))


def test_large_buckets_compare_whole_hashes(spark):
    """80 of 100 hashes in common, two of which differ only in their upper half."""
    shared = [5, 5 + (1 << 40), *range(1000, 1078)]
    sets = [(1, shared + list(range(2000, 2010))), (2, shared + list(range(3000, 3010)))]
    buckets = [(9, 40, 1, 1), (9, 40, 2, 2)]
    got = minmax._joining_pairs(
        spark.createDataFrame(buckets, "key long, c long, node long, root long"),
        spark.createDataFrame(sets, "node long, own array<long>"),
        80,
    )
    assert [tuple(r) for r in got.collect()] == [(1, 2)]


def test_whole_table_against_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = minmax.near_duplicates(df, size=2).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute(rows, 2))


def test_one_of_each_group_stays(docs_of):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (2, "a  b c d e f"), (4, None), (5, ""), (6, "x y")]
    kept = minmax.keep_one(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6]
    assert minmax.keep_one(docs_of(rows).limit(0)).count() == 0


def test_repeated_rows_of_the_one_that_stays_go(docs_of):
    text = "a b c d e f"
    rows = [(1, text), (1, text), (1, text), (2, text), (4, None), (4, None), (None, "x y z"), (None, "x y z")]
    kept = minmax.keep_one(docs_of(rows)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, "x y z"), (1, text), (4, ""), (4, "")]
    assert [r.source for r in kept if r.doc_id == 1] == ["s0"]


def test_min_max_estimates_without_bias_and_finds_similar_pairs():
    rng = np.random.default_rng(4)
    guesses, missed = [], 0
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 900).astype(np.uint64)
        a, b = np.unique(pool[:810]), np.unique(pool[90:])  # 720 of 900 in common
        x, y = minmax.signature(a), minmax.signature(b)
        guesses.append(minmax.estimate(x, y))
        missed += not np.any(minmax.bands(x) == minmax.bands(y))
    assert abs(np.mean(guesses) - 0.8) < 0.01 and missed == 0
    assert np.std(guesses) < 0.045  # 128 values; 64 would give 0.05


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 30)] + [(2, 3), (3, 2), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[i] == 7 for i in range(7, 30))
    assert got[2] == got[3] == 2 and got[5] == 5
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
