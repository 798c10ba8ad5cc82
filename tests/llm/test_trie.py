"""The conversation trie against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from quire.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, conv int, no int"


def brute(rows):
    """The rows of the contract: conversations rebuilt, and a dictionary from prefix to members."""
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + turns[h:]
    members, kids = defaultdict(list), defaultdict(set)
    for c, turns in sorted(built.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, who in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(who) - 1) * len(node[-1][1]) if node else 0
    out = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in who if len(built[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append(
            (who[0], len(node), parent, len(who), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def found(spark, rows, small=trie.SMALL):
    turns = trie.numbered(table(spark, rows))
    nodes = trie.prefix_trie(trie.with_common_heads(turns), turns.where("r = 0").select("conv"), small)
    got = nodes.collect()
    assert sorted(x for r in got for x in (r.enter, r.exit)) == list(range(2 * len(got)))
    return sorted((tuple(r)[:8] for r in got), key=repr)


def some(seed, convs, longest, texts):
    draw = random.Random(seed)
    return [
        (c, t, draw.choice(["user", "assistant", None]), draw.choice(texts))
        for c in convs
        for t in range(draw.randrange(1, longest))
    ]


@pytest.mark.parametrize("small", [trie.SMALL, 40])
def test_nodes_equal_plain_python(spark, small):
    rows = some(1, [*range(0, 90), *range(300, 330), -7, -100, 10**12 + 5], 7, ["", None, "ä", "bb", "a much longer text"])
    assert found(spark, rows, small) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (None, 1, "user", "dropped"),
        (1, None, "user", "first"),
        (1, 0, None, None),
        (1, 1, "", ""),
        (2, 5, "user", "x" * 200_000),
        (3, 1, "user", "same"),
        (3, 1, "user", "same"),
        (203, 1, "user", "no base, all its turns replaced"),
    ]
    assert found(spark, rows) == brute(rows)


def test_one_conversation_with_most_turns_and_one_turn_in_most_conversations(spark, many_parts):
    rows = [(7, t, "user", f"turn {t % 3}") for t in range(700)]
    rows += [(c, t, "user", "hello" if t == 0 else f"{c} {t}") for c in range(1000, 10_000, 50) for t in range(2)]
    assert found(spark, rows, 300) == brute(rows)


def test_ends_of_many_ids_run_through_one_hash(spark, many_parts):
    rows = [(c, 0, "user", "hi") for c in range(0, 60_000, 7)]
    got, wanted = found(spark, rows), brute(rows)
    assert got == wanted


def test_list_rank_of_a_shuffled_list(spark, many_parts):
    ids = list(range(0, 3000, 2))
    random.Random(3).shuffle(ids)
    links = [(i, p, n) for i, p, n in zip(ids, [None, *ids], [*ids[1:], None], strict=False)]
    df = spark.createDataFrame(links, "id long, prev long, next long")
    assert {r.id: r.pos for r in trie.list_rank(df, 50).collect()} == {i: k for k, i in enumerate(ids)}


def test_no_conversations(spark):
    turns = trie.numbered(table(spark, []))
    assert trie.prefix_trie(turns, turns.select("conv")).count() == 0
