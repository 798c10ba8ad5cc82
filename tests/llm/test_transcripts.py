"""Roles and turns: Viterbi against brute force, any cut of the lines, held-out accuracy."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import transcripts


@pytest.fixture(scope="module")
def turns(spark):
    return spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")


@pytest.fixture(scope="module")
def model(turns):
    even = F.pmod(F.xxhash64("conv_id"), F.lit(2)) == 0
    return transcripts.fit(transcripts.with_markers(turns.where(even)))


def test_viterbi_is_the_best_path(model):
    moves, seen = model
    rng = np.random.default_rng(1)
    for _ in range(8):
        symbols = rng.integers(0, transcripts.SYMBOLS, 5)
        best = None
        for path in itertools.product(range(transcripts.STATES), repeat=5):
            before = (transcripts.STATES, *path[:-1])
            score = sum(moves[a, b] + seen[b, x] for a, b, x in zip(before, path, symbols, strict=True))
            if best is None or score > best[0] + 1e-12:
                best = score, path
        assert tuple(transcripts.decode(symbols, *model)) == best[1]


def rows_of(found):
    return sorted(map(tuple, found.select("conv_id", "turn", "role", "n_lines", "text").collect()))


def test_cutting_a_conversation_changes_nothing(turns, model, monkeypatch):
    lines = transcripts.lines_of(transcripts.with_markers(turns))
    whole = rows_of(transcripts.parse(lines, model))
    monkeypatch.setattr(transcripts, "SEGMENT", 3)
    assert rows_of(transcripts.parse(lines, model)) == whole


def test_held_out_roles(turns, model):
    raw = transcripts.with_markers(turns.where(F.pmod(F.xxhash64("conv_id"), F.lit(2)) == 1))
    found = transcripts.parse(transcripts.lines_of(raw), model).toPandas()
    true = raw.select("conv_id", (F.col("turn") + 1).alias("turn"), "role").toPandas()
    both = found.merge(true, on=["conv_id", "turn"], how="outer")
    assert (both.role_x == both.role_y).mean() > 0.8
    assert found.rendered is not None


def test_marked_turns_and_odd_rows(spark, model):
    rows = [
        (1, 0, "System: be brief"),
        (1, 1, "User: hi\nthere"),
        (1, 2, "### Assistant:\nhello"),
        (1, 3, "<|user|> bye"),
        (1, None, None),
        (None, 0, "Human: x"),
        (2, 0, ""),
        (3, 5, "**Bot**: y"),
        (3, 5, "**Bot**: y"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, text string, role string")
    got = transcripts.parse(transcripts.lines_of(df), model).collect()
    one = {r.text.strip(): r.role for r in got if r.conv_id == 1}
    assert one["be brief"] == "system" and one["bye"] == "user" and one["hello"] == "assistant"
    assert sum(r.n_lines for r in got) == 11
    assert [r.role for r in got if r.conv_id is None] == ["user"]
    assert all(r.rendered.startswith(f"<|im_start|>{r.role}\n") for r in got)
    assert transcripts.parse(transcripts.lines_of(df.limit(0)), model).count() == 0
    assert transcripts.fit(df.limit(0))[0].shape == (transcripts.STATES + 1, transcripts.STATES)
