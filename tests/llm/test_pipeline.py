"""The pipeline against the same five steps in plain Python."""

from collections import defaultdict

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from test_filters import hits
from test_groups import brute

import corpus_pipeline
from quire.llm import bpe


def plain(docs, items):
    """[(doc_id, lang, source, ids)] of what the five steps leave.

    The texts here are all in a language, so the first step drops those without one.
    """
    docs = [d for d in docs if d[1] is not None and len(d[1].encode()) >= 3]
    sites = defaultdict(set)
    for _, text, _, source in docs:
        for line in text.split("\n"):
            sites[line.strip(" \t\n\x0b\f\r")].add(source)
    docs = [
        (
            i,
            "\n".join(x for x in t.split("\n") if not (b := x.strip(" \t\n\x0b\f\r")) or len(sites[b]) < 10),
            lang,
            s,
        )
        for i, t, lang, s in docs
    ]
    group = {i: (n, c) for i, n, c in brute([(i, t) for i, t, _, _ in docs], 5)}
    docs = [d for d in docs if group[d[0]][0] == 0 or group[d[0]][1] == d[0]]
    found = hits([(i, t) for i, t, _, _ in docs], items)
    docs = [d for d in docs if not found[d[0], d[1]][3]]
    codec = bpe.codec_for(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={}
    )
    return [(i, lang, s, library.encode_ordinary(t)) for i, t, lang, s in docs]


def test_run_equals_the_plain_steps(spark, sf_dir):
    read = spark.read.parquet
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in read(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in read(f"{sf_dir}/benchmark.parquet").collect()]
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert all(r.decodes and r.n_tokens == len(r.ids) for r in got)
    assert sorted((r.doc_id, r.lang, r.source, list(r.ids)) for r in got) == sorted(plain(docs, items))


def test_stages_take_odd_rows_and_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20)
    odd = spark.createDataFrame(
        [(None, "the of and to in", None, None, None), (1, None, "en", "src0", 0), (2, "", "en", "src0", 0), (2, "", "en", "src0", 0)],
        docs.schema,
    )
    docs = docs.unionByName(odd).withColumn("print", F.lit("own")).withColumn("__bad", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        out.collect()
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    name, last = corpus_pipeline.STAGES[-1]
    assert last(spark, docs, sf_dir).count() == docs.count()


def test_stages_and_their_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_copies", "benchmark", "tokens"]
    assert corpus_pipeline.ORACLE_SQL is None
