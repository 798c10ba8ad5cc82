"""Running totals and neighbours across parts against plain Python."""

import random

from pyspark.sql import functions as F

from quire.llm.ordered import cut, neighbours, running


def test_totals_run_through_keys_larger_than_a_part(spark, many_parts):
    draw = random.Random(1)
    keys = [None if (k := draw.choice([0, 1, 1, 1, 1, 2, 3])) == 3 else k for _ in range(900)]
    rows = [(k, i, draw.randrange(-9, 9)) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "k long, i long, v long").repartition(7)
    placed = cut(df, ["k"], ["i"], "test")
    assert placed.select("part").distinct().count() > 1
    got = running(
        placed, ["k"], ["i"], s=("sum", F.col("v")), x=("xor", F.col("v")), m=("max", F.when(F.col("i") % 5 == 0, F.col("i")))
    )
    wanted, state = {}, {}
    for k, i, v in rows:
        s, x, m = state.get(k, (0, 0, None))
        state[k] = wanted[i] = (s + v, x ^ v, i if i % 5 == 0 else m)
    assert {r.i: (r.s, r.x, r.m) for r in got.collect()} == wanted


def test_one_run_through_the_whole_table(spark, many_parts):
    df = spark.range(1000).repartition(5)
    got = running(cut(df, [], ["id"], "test"), [], ["id"], n=("sum", F.lit(1)))
    assert {(r.id, r.n) for r in got.collect()} == {(i, i + 1) for i in range(1000)}


def test_neighbours_reach_over_parts(spark, many_parts):
    df = spark.range(0, 500, 3).repartition(6)
    got = neighbours(cut(df, [], ["id"], "test"), ["id"]).collect()
    ids = sorted(r.id for r in got)
    around = dict(zip(ids, zip([None, *ids], [*ids[1:], None], strict=False), strict=True))
    assert {r.id: (r.before and r.before.id, r.after and r.after.id) for r in got} == around


def test_empty_tables(spark, many_parts):
    empty = spark.range(0)
    placed = cut(empty, [], ["id"], "test")
    assert running(placed, [], ["id"], n=("sum", F.lit(1))).count() == 0
    assert neighbours(placed, ["id"]).count() == 0
