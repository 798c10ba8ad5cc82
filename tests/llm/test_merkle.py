"""The Merkle manifest against plain Python."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quire.llm import merkle

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves, fan_out):
    """(root, siblings left and right of every leaf, level by level)."""
    paths, level, below = [[] for _ in leaves], leaves, [[i] for i in range(len(leaves))]
    while len(level) > 1:
        nodes, groups = [], []
        for a in range(0, len(level), fan_out):
            run = level[a : a + fan_out]
            for k in range(len(run)):
                for i in below[a + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            nodes.append(sha("".join(run)))
            groups.append(sum(below[a : a + fan_out], []))
        level, below = nodes, groups
    return level[0], paths


def brute(rows, fan_out=2):
    """(doc_id, leaf, subroot, root, siblings) of every row."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0], leaf_of(row)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    done = []
    for g in names:
        members = sorted(groups[g], key=lambda m: (m[0] is not None, m[0] or 0, m[1]))
        done.append((members, *tree([m[1] for m in members], fan_out)))
    root, above = tree([d[1] for d in done], fan_out) if done else (None, [])
    return sorted(
        (
            (i, leaf, subroot, root, sha("".join(a + b for a, b in path + over)))
            for (members, subroot, paths), over in zip(done, above, strict=True)
            for (i, leaf), path in zip(members, paths, strict=True)
        ),
        key=repr,
    )


def found(spark, rows, fan_out=2, storey=merkle.STOREY, claim=None):
    schema = "doc_id long, source string, lang string, n_chars long, text string, pos int, leaf int, block string, path int"
    docs = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], schema)
    leaf = merkle.record(*[F.col(c) for c in COLUMNS])
    docs = docs.withColumns({"leaf": leaf, "claim": F.lit(None).cast("string") if claim is None else claim})
    got = merkle.manifest(docs, fan_out=fan_out, storey=storey)
    return got.withColumns(
        {"proof": merkle.proof(F.col("path")), "folded": merkle.folded(F.col("path"), F.col("claim"))}
    ).collect()


def some(n, langs):
    return [(i, f"s{i % 5}", langs[i * i % len(langs)], None if i % 11 == 0 else i, "text ä " * (i % 4)) for i in range(n)]


@pytest.mark.parametrize(("fan_out", "storey"), [(2, merkle.STOREY), (2, 1), (3, 2)])
def test_manifest_equals_plain_python(spark, fan_out, storey):
    rows = some(90, ["en", "en", "de", None, "fr", "é", ""]) + [(1000, "s", "only", 3, None), (1001, "s", "two", 3, "")]
    got = found(spark, rows, fan_out, storey)
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in got), key=repr) == brute(rows, fan_out)
    assert all(r.folded == r.root for r in got)


def test_a_group_of_several_blocks(spark, many_parts):
    rows = some(700, ["en"]) + some(3, ["de"])
    got = found(spark, rows)
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in got), key=repr) == brute(rows)


def test_odd_rows(spark, odd):
    rows = [(i, None, None if k % 2 else "en", k, t) for k, (i, t) in enumerate(odd)] + [(4, None, "en", 4, "one two three")] * 2
    got = found(spark, rows)
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in got), key=repr) == brute(rows)


def test_changed_records_do_not_fold_to_the_root(spark):
    rows = some(40, ["en", "de"])
    changed = F.when(F.col("doc_id") % 4 == 1, merkle.record(*[F.col(c) for c in COLUMNS[:4]], F.lit("else")))
    for r in found(spark, rows, claim=changed):
        assert (r.folded == r.root) == (r.doc_id % 4 != 1)


def test_one_row_and_none(spark):
    rows = [(5, "s", "en", 1, "text")]
    (r,) = found(spark, rows)
    assert r.leaf == r.subroot == r.root == r.folded and r.proof == sha("") and list(r.path) == []
    assert found(spark, []) == []
