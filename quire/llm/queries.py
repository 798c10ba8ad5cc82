"""The registered queries of this folder and, where SQL can say it, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import (
    bpe,
    decontaminate,
    factors,
    katz,
    language,
    lines,
    merkle,
    minmax,
    quality,
    suffixes,
    token_counts,
    transcripts,
    trie,
)
from quire.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return register


@query(
    r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
places AS (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM split WHERE len(words) >= 5),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 4], chr(31)) AS w FROM places),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(0, 5) r(k) GROUP BY doc_id),
m AS (SELECT s.doc_id, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    len(lines)::BIGINT AS n_lines,
    length(regexp_replace(text, '[^A-ZÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ]', '', 'g'))::BIGINT AS n_capitals,
    len(list_distinct(words))::BIGINT AS n_distinct_words
  FROM split s LEFT JOIN covered c USING (doc_id)),
b AS (SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT
    + 4 * (word_chars < 2 * n_words)::BIGINT + 8 * (word_chars > 20 * n_words)::BIGINT
    + 16 * (10 * n_symbols > n_words)::BIGINT + 32 * (10 * n_capitals > 4 * word_chars)::BIGINT
    + 64 * (10 * n_dup_lines > 3 * n_lines)::BIGINT
    + 128 * (n_words >= 50 AND 20 * n_distinct_words < n_words)::BIGINT AS fail_bits FROM m)
SELECT *, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept FROM b"""
)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger, base verdict and verdict of the newest policy for every document."""
    return quality.apply_policy(quality.ledger(read(spark, sf_dir, "documents")))


@query()
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of the ids of every whole text, and of what they decode to."""
    return bpe.digests(
        read(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


@query()
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text, and whether they are more than 512."""
    return token_counts.count_tokens(
        read(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.PATTERN,
    ).withColumn("over_limit", F.col("n_tokens") > 512)


@query(
    r"""WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
    lambda w: w <> '') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item, s AS size, array_to_string(w[i:i + s - 1], ' ') AS win
  FROM (SELECT item, w, least(len(w), 13) AS s, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i
        FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM words, sizes WHERE len(w) >= size)),
found AS (SELECT doc_id, i, d.size, item FROM doc_windows d JOIN item_windows USING (size, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY 1),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS list
          FROM found GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""
)
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold how much of the benchmark, over all windows of both."""
    found = decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("found_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found_items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query()
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without passages of 50 words of earlier ones."""
    return factors.dedup(read(spark, sf_dir, "documents"), keep_text=False).drop("factors")


@query()
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without 400-byte strings that occur twice."""
    return suffixes.dedup(read(spark, sf_dir, "documents"), keep_bytes=False).drop("runs")


@query()
def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that links of 0.8 on word pairs form."""
    found = minmax.near_duplicates(read(spark, sf_dir, "documents"), size=2, percent=80)
    return found.select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


@query(
    r"""WITH lines AS (
  SELECT doc_id, source, i, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare
  FROM (SELECT doc_id, source, unnest(l) AS line, unnest(range(len(l))) AS i
        FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))),
bad AS (SELECT bare FROM lines WHERE bare <> '' GROUP BY bare
        HAVING count(DISTINCT coalesce(source, chr(0))) >= 10),
flagged AS (SELECT l.*, b.bare IS NOT NULL AS gone FROM lines l LEFT JOIN bad b USING (bare)),
cut AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
  FROM flagged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, kept_sha256
FROM documents d LEFT JOIN cut USING (doc_id)"""
)
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without lines that ten sites or more share."""
    kept = lines.removed(read(spark, sf_dir, "documents"), counts=("n_lines", "n_removed"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query()
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document: its text, its declared language, its source as host."""
    docs = read(spark, sf_dir, "documents")
    found = language.identify(
        docs, language.fit(docs), declared=F.col("lang"), host=F.col("source")
    )
    return found.select("doc_id", "language", "confidence", F.col("accepted").alias("kept"))


@query()
def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over pages, which have all kinds of evidence: markup, host,
    domain and suffix of the address."""
    html = F.col("html")
    pages = read(spark, sf_dir, "pages").select(
        "page_id", "url", language.declared_in(html).alias("declared"), language.visible_text(html).alias("text")
    )
    found = language.identify(
        pages,
        language.fit(read(spark, sf_dir, "documents")),
        id_col="page_id",
        declared=F.col("declared"),
        **language.address(F.col("url")),
    )
    return found.select("page_id", "language", "confidence", "accepted")


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL


@query()
def op7_chat_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns recovered from raw transcripts of all conversations, in canonical form."""
    turns = transcripts.with_markers(read(spark, sf_dir, "conversations"))
    found = transcripts.parse(transcripts.lines_of(turns), transcripts.fit(turns))
    return found.select("conv_id", "turn", "role", "n_lines", F.sha2("rendered", 256).alias("rendered_sha256"))


def _crc32(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of an ASCII text."""
    return f"""xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
    list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"""


@query(
    f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS r
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc32("CAST(conv_id AS VARCHAR)")} % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
rebuilt AS (
  SELECT i.conv_id, r, role, text FROM ids i JOIN t ON t.conv_id = i.base AND r < h
  UNION ALL SELECT i.conv_id, r, role, text FROM ids i JOIN t USING (conv_id) WHERE r >= h),
named AS (SELECT conv_id, row_number() OVER w AS depth, text,
    md5(string_agg(md5(role) || md5(text), '') OVER (w ROWS UNBOUNDED PRECEDING)) AS node FROM rebuilt
  WINDOW w AS (PARTITION BY conv_id ORDER BY r)),
steps AS (
  SELECT conv_id, 0 AS depth, '' AS text, '' AS node, NULL AS parent FROM ids
  UNION ALL SELECT conv_id, depth, text, node, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY depth), '') FROM named),
nodes AS (SELECT depth, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
    any_value(length(text)) AS chars FROM steps GROUP BY depth, node),
kids AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
below AS (  -- every node with each of the nodes of its subtree
  SELECT s.depth, s.node, count(*) FILTER (k.node IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved
  FROM nodes n JOIN steps s ON s.conv_id = n.conv_id AND s.depth <= n.depth LEFT JOIN kids k ON k.node = n.node GROUP BY 1, 2),
ends AS (SELECT node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS list
  FROM (SELECT conv_id, arg_max(node, depth) AS node FROM steps GROUP BY 1) GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs,
  coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved::BIGINT AS saved_tokens,
  sha256(coalesce(list, '')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN kids k ON k.node = n.node
JOIN below b ON b.node = n.node LEFT JOIN ends e ON e.node = n.node"""
)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shared beginning of the rebuilt conversations, and what lies below it."""
    turns = trie.numbered(read(spark, sf_dir, "conversations"))
    nodes = trie.prefix_trie(trie.with_common_heads(turns), turns.where("r = 0").select("conv"))
    return nodes.drop("enter", "exit")


_FIELD = "coalesce(strlen({0})::VARCHAR || ':' || {0}, '-')"
_RECORD = " || ".join(
    _FIELD.format(c) for c in ("doc_id::VARCHAR", "source", "lang", "({0})::VARCHAR", "text")
)


@query(
    f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '') AS g,
    sha256({_RECORD.format("n_chars")}) AS leaf,
    sha256({_RECORD.format(f"n_chars + ({_crc32('CAST(doc_id AS VARCHAR)')} % 7 = 0)::BIGINT")}) AS claim FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    count(*) OVER (PARTITION BY g) AS n FROM d),
tree AS (SELECT g, 0 AS lvl, i, leaf AS h, n FROM leaves
  UNION ALL SELECT g, lvl + 1, i // 2, sha256(h || coalesce(other, '')), (n + 1) // 2
  FROM (SELECT *, lead(h) OVER (PARTITION BY g, lvl ORDER BY i) AS other FROM tree WHERE n > 1) WHERE i % 2 = 0),
subroots AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (SELECT 0 AS lvl, i, h, n FROM subroots
  UNION ALL SELECT lvl + 1, i // 2, sha256(h || coalesce(other, '')), (n + 1) // 2
  FROM (SELECT *, lead(h) OVER (PARTITION BY lvl ORDER BY i) AS other FROM top WHERE n > 1) WHERE i % 2 = 0),
steps AS (
  SELECT l.doc_id, l.leaf, l.g, l.i, t.lvl, t.i % 2 AS slot, o.h AS other
  FROM leaves l JOIN tree t ON t.g = l.g AND t.i = l.i >> t.lvl AND t.n > 1
  LEFT JOIN tree o ON o.g = l.g AND o.lvl = t.lvl AND o.i = xor(t.i, 1)
  UNION ALL
  SELECT l.doc_id, l.leaf, l.g, l.i, 1000 + t.lvl, t.i % 2, o.h
  FROM leaves l JOIN subroots s USING (g) JOIN top t ON t.i = s.i >> t.lvl AND t.n > 1
  LEFT JOIN top o ON o.lvl = t.lvl AND o.i = xor(t.i, 1)),
paths AS (SELECT g, i, list(struct_pack(slot := slot, other := coalesce(other, '')) ORDER BY lvl) AS path FROM steps GROUP BY 1, 2),
fold AS (
  SELECT l.g, l.i, 1 AS k, claim AS f, coalesce(path, []) AS path FROM leaves l LEFT JOIN paths p ON p.g = l.g AND p.i = l.i
  UNION ALL SELECT g, i, k + 1, CASE WHEN path[k].slot = 0 THEN sha256(f || path[k].other) ELSE sha256(path[k].other || f) END, path
  FROM fold WHERE k <= len(path))
SELECT l.doc_id, l.leaf, s.h AS subroot, t.h AS root,
  sha256(coalesce(array_to_string(list_transform(path, lambda x: x.other), ''), '')) AS proof_sha256,
  f AS folded_root, f = t.h AS verified
FROM leaves l JOIN fold ON fold.g = l.g AND fold.i = l.i AND k = len(path) + 1
JOIN subroots s ON s.g = l.g JOIN top t ON t.n = 1"""
)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest, roots and proof of every document, and whether a copy with another number
    of characters in one of seven documents is still proved to be in the dataset."""
    docs = read(spark, sf_dir, "documents")

    def leaf(n_chars):
        return merkle.record(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))

    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    claim = F.when(tampered, leaf(F.col("n_chars").cast("decimal(20,0)") + 1))
    found = merkle.manifest(docs.withColumns({"leaf": leaf(F.col("n_chars")), "claim": claim}))
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        merkle.proof(F.col("path")).alias("proof_sha256"),
        merkle.folded(F.col("path"), F.col("claim")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@query()
def op13_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document by a model of six sevenths of them."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return katz.score(read(spark, sf_dir, "documents"), ~held_out)
