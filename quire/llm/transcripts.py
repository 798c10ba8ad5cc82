"""Roles of transcript lines by a hidden Markov model, and canonical turns.

A transcript is an ordered list of lines, some of which begin with a speaker
marker ("User:", "### Assistant", "<|system|>", ...). Hidden states are the role
and whether a line begins a turn; what is seen of a line is one symbol made of its
marker, length, a question mark and a list or code sign. Viterbi's path through
the lines gives the roles; a turn is a start line and the lines that follow it.

A conversation may be of any length. Lines are range-partitioned and sorted by
conversation and place and cut into segments of at most ``SEGMENT`` lines. For each
segment a small table has the best score from any state before it to any state at
its end. These tables are chained per conversation (one row per 4,096 lines), which
settles the states at the borders; then each segment is decoded by itself.

Defined cases: a null text is a line without content; a null conversation is one of
its own; null places come first; lines with equal conversation and place are put in
order of their text and line number, so repeated rows stay and stand side by side;
an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import materialise

ROLES = ("system", "user", "assistant")
#: Words that stand for a role in a speaker marker; fixed values.
NAMES = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "customer", "question", "q", "prompter"),
    "assistant": ("assistant", "bot", "ai", "agent", "answer", "a", "model"),
}
SEGMENT = 4096
#: Conversations the model is fitted on, in the mean, and the turns they may have.
TRAIN, TRAIN_TURNS = 20_000, 200
#: Two states per role: it begins here, or it goes on.
STATES = 2 * len(ROLES)
MARKERS, LENGTHS = len(ROLES) + 1, 4
SYMBOLS = MARKERS * LENGTHS * 2 * 2


def _marker_pattern(role: str) -> str:
    """A whole marker: "<|name|>", or "### name" or "name" with a colon, or "### name" alone."""
    name = "(?:" + "|".join(NAMES[role]) + ")"
    return rf"(?i)^\s*(?:<\|{name}\|>|#+\s*{name}\s*(?::|$)|\**{name}\**\s*:\**)\s*"


def observe(text: Column) -> tuple[Column, Column]:
    """(symbol of a line, its content without the marker)."""
    text = F.coalesce(text, F.lit(""))
    marker, content = F.lit(0), text
    for k, role in reversed(list(enumerate(ROLES, 1))):
        has = text.rlike(_marker_pattern(role))
        marker = F.when(has, F.lit(k)).otherwise(marker)
        content = F.when(has, F.regexp_replace(text, _marker_pattern(role), "")).otherwise(content)
    size = F.length(content)
    length = F.when(size == 0, 0).when(size < 80, 1).when(size < 300, 2).otherwise(3)
    question = content.contains("?").cast("int")
    listed = content.rlike(r"^\s*(?:[-*+]|\d+[.)]|```)").cast("int")
    symbol = ((marker * LENGTHS + length) * 2 + question) * 2 + listed
    return symbol.cast("int"), content


def lines_of(
    turns: DataFrame, conv_col: str = "conv_id", place_col: str = "turn", text_col: str = "text"
) -> DataFrame:
    """(conv, place, text_hash, line_no, symbol, content): a row per line of each text."""
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(place_col).alias("place"),
        F.xxhash64(text_col).alias("text_hash"),
        F.posexplode(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n")).alias(
            "line_no", "line"
        ),
    )
    symbol, content = observe(F.col("line"))
    return rows.select("conv", "place", "text_hash", "line_no", symbol.alias("symbol"), content.alias("content"))


def fit(
    turns: DataFrame,
    conv_col: str = "conv_id",
    place_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> tuple[np.ndarray, np.ndarray]:
    """(log transitions with a last row for the beginning, log emissions) from labelled
    turns: counts over a bounded sample of conversations, plus one."""
    sizes = turns.groupBy(F.col(conv_col).alias("conv")).agg(F.count("*").alias("turns"))
    sizes = sizes.where((F.col("turns") <= TRAIN_TURNS) & F.col("conv").isNotNull())
    share = min(1.0, TRAIN / max(sizes.count(), 1))
    chosen = sizes.where(F.pmod(F.xxhash64("conv"), F.lit(1_000_000)) < int(share * 1_000_000)).select("conv")
    role = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.lower(F.col(role_col))) - 1
    sample = turns.select(
        F.col(conv_col).alias("conv"), F.col(place_col).alias("place"), role.alias("role"), F.col(text_col).alias("text")
    ).where("role >= 0")
    labelled = sample.join(chosen, "conv", "left_semi")
    lines = labelled.select("conv", "place", "role", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("k", "line"))
    symbol, _ = observe(F.col("line"))
    before = F.lag("state").over(Window.partitionBy("conv").orderBy("place", "k"))
    states = lines.select(
        "conv", "place", "k", (2 * F.col("role") + (F.col("k") > 0).cast("int")).cast("int").alias("state"), symbol.alias("symbol")
    ).withColumn("before", F.coalesce(before, F.lit(STATES)))
    moves, seen = np.ones((STATES + 1, STATES)), np.ones((STATES, SYMBOLS))
    # At most (states + 1) * states * symbols rows.
    for row in states.groupBy("before", "state", "symbol").agg(F.count("*").alias("n")).collect():
        moves[row["before"], row["state"]] += row["n"]
        seen[row["state"], row["symbol"]] += row["n"]
    for s in range(0, STATES, 2):  # a role goes on only after itself
        moves[:, s + 1] = np.where(np.isin(np.arange(STATES + 1), (s, s + 1)), moves[:, s + 1], 1e-9)
    return np.log(moves / moves.sum(1, keepdims=True)), np.log(seen / seen.sum(1, keepdims=True))


def _through(symbols: np.ndarray, moves: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Best scores from each state before (last: none) to each state at the end."""
    best = moves + seen[:, symbols[0]]
    for x in symbols[1:]:
        best = (best[:, :, None] + moves[None, :-1, :]).max(axis=1) + seen[:, x]
    return best


def decode(
    symbols: np.ndarray, moves: np.ndarray, seen: np.ndarray, enter: int = STATES, leave: int | None = None
) -> np.ndarray:
    """Viterbi's path of one segment; the smaller state wins a tie."""
    score = moves[enter] + seen[:, symbols[0]]
    back = np.zeros((symbols.size, STATES), np.int8)
    for t, x in enumerate(symbols[1:], 1):
        each = score[:, None] + moves[:-1]
        back[t] = each.argmax(axis=0)
        score = each.max(axis=0) + seen[:, x]
    path = np.empty(symbols.size, np.int8)
    path[-1] = score.argmax() if leave is None else leave
    for t in range(symbols.size - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def _segments(lines: DataFrame) -> DataFrame:
    """One row per segment: (conv, part, seq, places, symbols, contents)."""
    order = ["conv", "place", "text_hash", "line_no"]
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        lines.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .select("conv", F.spark_partition_id().alias("part"), "symbol", "content")
    )
    conv_type = lines.schema["conv"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None
        seq = 0

        def out(x: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    x[0],
                    pa.array([x[1]], pa.int32()),
                    pa.array([x[2]], pa.int32()),
                    pa.array([x[3]], pa.list_(pa.int32())),
                    pa.array([x[4]], pa.list_(pa.string())),
                ],
                names=["conv", "part", "seq", "symbols", "contents"],
            )

        for batch in batches:
            convs, symbols, contents = (batch.column(k).to_pylist() for k in (0, 2, 3))
            part = batch.column(1)[0].as_py() if batch.num_rows else 0
            for i, conv in enumerate(convs):
                if held is None or held[5] != conv or len(held[3]) >= SEGMENT:
                    seq = seq + 1 if held is not None and held[5] == conv else 0
                    if held is not None:
                        yield out(held)
                    held = [batch.column(0).slice(i, 1), part, seq, [], [], conv]
                held[3].append(symbols[i])
                held[4].append(contents[i])
        if held is not None:
            yield out(held)

    return ranged.mapInArrow(
        pack, f"conv {conv_type}, part int, seq int, symbols array<int>, contents array<string>"
    )


def _borders(segments: DataFrame, moves: np.ndarray, seen: np.ndarray) -> DataFrame:
    """(conv, part, seq, enter, leave) of the segments of conversations that have several."""
    conv_type = segments.schema["conv"].dataType.simpleString()
    several = segments.groupBy("conv").agg(F.count("*").alias("c")).where("c > 1").select(F.col("conv").alias("_c"))
    wanted = segments.join(several, F.col("conv").eqNullSafe(F.col("_c")), "left_semi")

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            df["scores"] = [_through(np.asarray(s), moves, seen).ravel() for s in df["symbols"]]
            yield df[["conv", "part", "seq", "scores"]]

    def chain(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["part", "seq"]).reset_index(drop=True)
        scores = [np.asarray(s).reshape(STATES + 1, STATES) for s in df["scores"]]
        best, back = scores[0][STATES], []
        for s in scores[1:]:
            each = best[:, None] + s[:-1]
            back.append(each.argmax(axis=0))
            best = each.max(axis=0)
        leave = [int(best.argmax())]
        for b in reversed(back):
            leave.append(int(b[leave[-1]]))
        df["leave"] = leave[::-1]
        df["enter"] = [STATES, *leave[::-1][:-1]]
        return df[["conv", "part", "seq", "enter", "leave"]]

    return (
        wanted.select("conv", "part", "seq", "symbols")
        .mapInPandas(tables, f"conv {conv_type}, part int, seq int, scores array<double>")
        .groupBy("conv")
        .applyInPandas(chain, f"conv {conv_type}, part int, seq int, enter int, leave int")
    )


def parse(
    lines: DataFrame, model: tuple[np.ndarray, np.ndarray], conv_col: str = "conv_id"
) -> DataFrame:
    """(conversation, turn, role, lines, text, rendered): the recovered turns in order."""
    moves, seen = model
    segments = materialise(_segments(lines), "segments")
    borders = materialise(_borders(segments, moves, seen), "borders").withColumnsRenamed(
        {"conv": "_c", "part": "_p", "seq": "_s"}
    )
    same = (
        F.col("conv").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")) & (F.col("seq") == F.col("_s"))
    )
    bound = segments.join(borders, same, "left").drop("_c", "_p", "_s")
    conv_type = segments.schema["conv"].dataType.simpleString()

    def roles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names) if n != "conv"}
                enter = STATES if row["enter"] is None else row["enter"]
                path = decode(np.asarray(row["symbols"]), moves, seen, enter, row["leave"])
                starts = path % 2 == 0
                n = path.size
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(batch.schema.names.index("conv")).slice(i, 1).take(pa.array(np.zeros(n, np.int64))),
                        pa.array(np.full(n, row["part"], np.int32)),
                        pa.array(np.full(n, row["seq"], np.int32)),
                        pa.array(np.arange(n, dtype=np.int32)),
                        pa.array((path // 2).astype(np.int32)),
                        pa.array(np.cumsum(starts).astype(np.int64)),
                        pa.array(row["contents"], pa.string()),
                    ],
                    names=["conv", "part", "seq", "at", "role", "turn", "content"],
                )

    decoded = materialise(
        bound.mapInArrow(
            roles, f"conv {conv_type}, part int, seq int, at int, role int, turn long, content string"
        ),
        "decoded",
    )
    # Turns begun in the segments before; one row per segment.
    upto = Window.partitionBy("conv").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    begun = (
        decoded.groupBy("conv", "part", "seq")
        .agg(F.max("turn").alias("n"))
        .select(
            F.col("conv").alias("_c"),
            F.col("part").alias("_p"),
            F.col("seq").alias("_s"),
            F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("begun"),
        )
    )
    numbered = decoded.join(begun, same).withColumn("turn", F.col("turn") + F.col("begun"))
    names = F.array(*[F.lit(r) for r in ROLES])
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "seq", "at", "content"))), lambda x: x["content"]), "\n")
    return (
        numbered.groupBy("conv", "turn")
        .agg(F.get(names, F.min("role")).alias("role"), F.count("*").alias("n_lines"), text.alias("text"))
        .select(F.col("conv").alias(conv_col), "turn", "role", "n_lines", "text", rendered().alias("rendered"))
    )


def rendered() -> Column:
    """The canonical form of a turn."""
    return F.concat(F.lit("<|im_start|>"), F.col("role"), F.lit("\n"), F.btrim("text"), F.lit("<|im_end|>\n"))


def with_markers(
    turns: DataFrame, conv_col: str = "conv_id", place_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Raw transcripts from labelled turns: each conversation writes its markers in one of
    four ways, and about one turn in four, by a hash, has none."""
    role = F.lower(F.col(role_col))
    name = F.initcap(role)
    style = F.pmod(F.xxhash64(conv_col), F.lit(4))
    marker = (
        F.when(F.pmod(F.xxhash64(conv_col, place_col), F.lit(4)) == 0, F.lit(""))
        .when(style == 0, F.concat(name, F.lit(": ")))
        .when(style == 1, F.concat(F.lit("### "), name, F.lit(":\n")))
        .when(style == 2, F.concat(F.lit("<|"), role, F.lit("|>\n")))
        .otherwise(F.concat(F.lit("**"), name, F.lit("**: ")))
    )
    return turns.withColumn(text_col, F.concat(F.coalesce(marker, F.lit("")), F.coalesce(F.col(text_col), F.lit(""))))
