"""Quality rules as a ledger of failure bits, with policies and ablations on top.

Every rule is evaluated once per document. What it measured and whether it
failed (one bit per rule) is the ledger; a policy is a named and dated set of
rules and is applied to the stored bits, so a new policy costs no second look at
the texts. All of it is one pass of built-in functions without a shuffle.

Defined cases: a null text counts as empty (no words, so it fails ``few_words``);
a null id stays null; repeated rows each get their own ledger row; an empty table
gives an empty ledger; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import characters_in, words_of

WINDOW = 5
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ"

#: Rule name and failure condition over the measurements; the place is the bit.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("capitals", "10 * n_capitals > 4 * word_chars"),
    ("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("few_distinct_words", "n_words >= 50 AND 20 * n_distinct_words < n_words"),
)
BASE = ("few_words", "repeated_windows")

#: Policies by version: the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE,
    "v2": (*BASE, "short_words", "long_words", "symbols", "capitals"),
    "v3": tuple(name for name, _ in RULES),
}


def mask_of(rules: tuple[str, ...]) -> int:
    """The bits of these rules."""
    places = {name: place for place, (name, _) in enumerate(RULES)}
    return sum(1 << places[name] for name in rules)


def _window_hashes(words: str, size: str) -> Column:
    return F.when(
        F.col(size) >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), F.col(size) - WINDOW),
            lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _positions_found_again(hashes: str) -> Column:
    """Places of windows whose 64-bit hash occurs elsewhere in the same text."""
    by_hash = F.sort_array(
        F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    )
    return F.when(
        F.size(F.array_distinct(hashes)) == F.size(hashes),
        F.array().cast("array<struct<h:bigint,i:int>>"),
    ).otherwise(by_hash)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What the rules look at: one row per input row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    first = (
        docs.select(F.col(id_col).alias("id"), text.alias("text"))
        .select("*", words_of(F.col("text")).alias("words"), lines.alias("lines"))
        .select("*", F.size("words").alias("n"))
        .select("*", _window_hashes("words", "n").alias("hashes"))
        .select("*", _positions_found_again("hashes").alias("sorted"))
    )
    repeated = F.sort_array(
        F.transform(
            F.filter(
                "sorted",
                lambda x, j: (x["h"] == F.get("sorted", j + 1)["h"])
                | ((j > 0) & (x["h"] == F.get("sorted", F.greatest(j - 1, F.lit(0)))["h"])),
            ),
            lambda x: x["i"],
        )
    )
    # A repeated window adds the words up to the next repeated one, 5 at most.
    covered = F.aggregate(
        F.transform(
            "repeated",
            lambda p, j: F.least(
                F.lit(WINDOW), F.coalesce(F.get("repeated", j + 1) - p, F.lit(WINDOW))
            ),
        ),
        F.lit(0),
        lambda total, x: total + x,
    )
    return first.select("*", repeated.alias("repeated")).select(
        F.col("id").alias(id_col),
        F.col("n").cast("long").alias("n_words"),
        (F.length("text") - characters_in(F.col("text"), " \t\n\x0b\f\r"))
        .cast("long")
        .alias("word_chars"),
        characters_in(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        characters_in(F.col("text"), CAPITALS).cast("long").alias("n_capitals"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct_words"),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements plus ``fail_bits``: bit k is set if rule k failed."""
    bits = F.lit(0).cast("long")
    for place, (_, condition) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << place)).otherwise(F.lit(0)))
    return measure(docs, id_col, text_col).withColumn("fail_bits", bits)


def failed(policy: str | tuple[str, ...]) -> Column:
    """True where a ledger row fails a rule of the policy (a version or rule names)."""
    rules = POLICIES[policy] if isinstance(policy, str) else policy
    return F.col("fail_bits").bitwiseAND(F.lit(mask_of(rules)).cast("long")) != 0


def apply_policy(rows: DataFrame, policy: str = "v3") -> DataFrame:
    """Add ``base_failed`` and ``kept`` to ledger rows."""
    return rows.withColumn("base_failed", failed(BASE)).withColumn(
        "kept", ~failed(BASE) & ~failed(policy)
    )


def ablation(rows: DataFrame, policy: str = "v3") -> DataFrame:
    """Per rule of the policy: how many documents fail it, fail it alone, and what
    would be kept without it.

    The ledger is first counted by bit pattern, of which there are at most
    2^rules; everything else is arithmetic on these few rows.
    """
    spark = rows.sparkSession
    mask = mask_of(POLICIES[policy])
    patterns = rows.groupBy(
        F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")
    ).agg(F.count("*").alias("n"))
    rules = spark.createDataFrame(
        [(name, mask_of((name,))) for name in POLICIES[policy]], "rule string, bit long"
    )
    one = F.explode(F.array(*[F.lit(mask_of((name,))).cast("long") for name in POLICIES[policy]]))
    by_rule = patterns.select("bits", "n", one.alias("bit"))
    n = F.col("n")
    has = F.col("bits").bitwiseAND(F.col("bit")) != 0
    without = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0
    counts = by_rule.groupBy("bit").agg(
        F.sum(F.when(has, n).otherwise(0)).alias("n_failed"),
        F.sum(F.when(has & without, n).otherwise(0)).alias("n_only"),
        F.sum(F.when(without, n).otherwise(0)).alias("n_kept_without"),
        F.sum(F.when(F.col("bits") == 0, n).otherwise(0)).alias("n_kept"),
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_failed", "n_only", "n_kept_without", "n_kept")]
    return rules.join(counts, "bit", "left").select("rule", *zero)
