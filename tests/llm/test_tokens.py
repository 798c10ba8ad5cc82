"""Byte-level BPE and token counts against the tokenizer libraries."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
import tokenizers

from quire.llm import bpe, token_counts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def codec():
    return bpe.codec_for(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={}
    )


def texts(n=3000):
    rng = random.Random(7)
    for _ in range(n):
        kind = rng.random()
        if kind < 0.3:
            yield "".join(rng.choice("ab") for _ in range(rng.randint(1, 40)))
        elif kind < 0.5:
            yield "".join(rng.choice("etaoin shrdlu'") for _ in range(rng.randint(1, 60)))
        elif kind < 0.7:
            yield "".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0, 0x2FFF)])) for _ in range(30))
        elif kind < 0.85:
            yield rng.choice("abc=-_ \n.") * rng.randint(1, 200)
        else:
            yield "".join(rng.choice(["the", "ing", " ", "\n", "12", "'s", "é", "日本"]) for _ in range(20))


def test_ids_equal_the_library_and_decode(codec, library):
    for text in texts():
        ids = [x for piece in codec.encode(text) for x in piece]
        assert ids == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_every_token_encodes_to_itself(codec):
    assert all(codec.encode_piece(token) == [rank] for token, rank in codec.ranks.items())


def test_a_long_piece_takes_linear_work(codec, library):
    text = "ab" * 100_000
    assert [x for p in codec.encode(text) for x in p] == library.encode_ordinary(text[:200_000])


def test_digests_over_odd_rows(spark, docs_of, odd, library):
    got = bpe.digests(docs_of(odd), RANKS, public_tokenizers.PATTERN).collect()
    wanted = []
    for i, text in odd:
        ids = library.encode_ordinary(text or "")
        wanted.append(
            (
                i,
                len(ids),
                hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256((text or "").encode()).hexdigest(),
            )
        )
    assert sorted(map(tuple, got), key=repr) == sorted(wanted, key=repr)


def test_encoded_keeps_columns_and_replaces_clashing_ones(docs_of):
    got = bpe.encoded(docs_of([(1, "a b"), (2, None)]), RANKS, public_tokenizers.PATTERN)
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[1].ids == [64, 275] and bytes(rows[1].decoded) == b"a b" and rows[2].ids == []
    assert rows[1].n_words == 7
    assert bpe.encoded(docs_of([(1, "a")]).limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def counted(rows):
    library = tokenizers.Tokenizer.from_file(JSON)
    return {(i, t or ""): len(library.encode(t or "", add_special_tokens=False)) for i, t in rows}


@pytest.mark.parametrize("head", [0, 5, token_counts.HEAD])
def test_counts_equal_the_library(spark, docs_of, odd, head, monkeypatch):
    monkeypatch.setattr(token_counts, "HEAD", head)
    rows = [
        *odd,
        (10, "a<|endoftext|>b <|endoftext|>"),
        (11, "q՘ 한국 <|endoftext|><|endoftext|> " + "ab " * 50),
        *[(100 + k, t) for k, t in enumerate(texts(100))],
    ]
    got = token_counts.count_tokens(docs_of(rows), JSON, public_tokenizers.PATTERN).collect()
    wanted = counted(rows)
    assert len(got) == len(wanted)
    assert sorted((r.doc_id, r.n_tokens, r.n_bytes) for r in got if r.doc_id is not None) == sorted(
        (i, n, len(t.encode())) for (i, t), n in wanted.items() if i is not None
    )


def test_splitting_knows_the_same_characters_up_to_its_bound():
    """Up to U+04FF the pattern splits as the library does; beyond, the library is used."""
    split = token_counts.Splitter(JSON, public_tokenizers.PATTERN)
    for code in range(0x500):
        text = f"a{chr(code)} {chr(code)}  1{chr(code)}"
        found = split.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        assert split.find(text) == [text[a:b] for _, (a, b) in found]


def test_counts_of_an_empty_table(docs_of):
    empty = docs_of([(1, "a")]).limit(0)
    assert token_counts.count_tokens(empty, JSON, public_tokenizers.PATTERN).count() == 0
