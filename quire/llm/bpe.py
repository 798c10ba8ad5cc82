"""Byte-level BPE: exact encoding in linear time, and decoding.

Each match of the splitting pattern is encoded by itself. Its bytes are read as
Latin-1 characters, so that an Aho-Corasick automaton over the vocabulary finds
the longest token at every place. Encoding starts from longest matches and steps
back to shorter ones: two neighbouring tokens are kept only if the merges could
never have crossed their border, which is worked out from ranks and memoised per
pair. Tokens of such a chain are exactly those that the merges give, and a place
from which no chain goes on is visited once, so the work is linear.

Spark spreads the texts; a task keeps the codes of the pieces it has met in a
memo of bounded size (results do not depend on it).

Defined cases: a null text is an empty one (no ids, digests of nothing); a null
id stays null; repeated rows give a row each; an empty table gives an empty one;
other columns are not read, or kept by ``encoded`` if asked for.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import lean

#: Pieces (in each of two generations, about 200 bytes each) and pairs remembered by one
#: task, and the longest piece that is remembered.
MEMO = 250_000
LONG_PIECE = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks from a file of base64 tokens."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Ids of pieces by one set of ranks; every single byte must have a rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.lengths = [len(self.tokens.get(i, b"")) for i in range(max(self.tokens) + 1)]
        self.split = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        # One object per id, shared by all that is remembered.
        self.own = list(range(len(self.lengths)))
        self.halves: dict[int, tuple[int, int]] = {}
        self.shorter: dict[int, int] = {}
        self.fits: dict[int, bool] = {}
        self.recent: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    def _merged(self, token: bytes, below: int) -> list[bytes]:
        """The parts left when only merges of a rank under ``below`` are made."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1], below)
                if rank < best:
                    best, at = rank, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        found = self.halves.get(rank, False)
        if found is False:
            token = self.tokens[rank]
            parts = self._merged(token, rank) if len(token) > 1 else []
            found = tuple(self.ranks[p] for p in parts) if len(parts) == 2 else None
            self.halves[rank] = found
        return found

    def _fit(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens leaves just these two.

        Undoes merges next to the border, latest first; the pair is broken as
        soon as a merge across the border would have come before them.
        """
        if len(self.fits) > MEMO:
            self.fits.clear()
        a, b, limit, found = left, right, len(self.lengths) + 1, True
        while True:
            across = self.ranks.get(self.tokens[a] + self.tokens[b])
            if across is not None and across < limit and self._halves(across) == (a, b):
                found = False
                break
            halves_a, halves_b = self._halves(a), self._halves(b)
            # Of equal merges the left one is made first.
            if halves_a and (a > b or not halves_b):
                limit, a = a, halves_a[1]
            elif halves_b:
                limit, b = b + 1, halves_b[0]
            else:
                break
        self.fits[left << 32 | right] = found
        return found

    def _shorter(self, rank: int) -> int:
        """The longest token that is a proper start of this one, or -1."""
        found = self.shorter.get(rank)
        if found is None:
            token = self.tokens[rank]
            found = next(
                (self.ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks),
                -1,
            )
            self.shorter[rank] = found
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None and self._reachable(whole):
            return [whole]
        size, lengths, fits = len(piece), self.lengths, self.fits
        # Matches come by their end, so the last one of a start is its longest.
        longest = [-1] * (size + 1)
        for end, rank in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - lengths[rank]] = rank
        shut = bytearray(size + 1)
        out: list[int] = []
        at, token, last = 0, longest[0], -1
        while at < size:
            end = at + lengths[token]
            if not shut[end]:
                fit = last < 0 or fits.get(last << 32 | token)
                if fit is None:
                    fit = self._fit(last, token)
                if fit:
                    out.append(token)
                    at, last, token = end, token, longest[end]
                    continue
            token = self._shorter(token)
            while token < 0:  # nothing goes on from here: step back
                shut[at] = 1
                out.pop()
                at -= lengths[last]
                token, last = self._shorter(last), out[-1] if out else -1
        return out

    def _reachable(self, rank: int) -> bool:
        """Whether merging gives this token from its own bytes."""
        return len(self.tokens[rank]) == 1 or self._halves(rank) is not None

    def encode(self, text: str) -> list[list[int]]:
        """The ids of each piece of a text, in order."""
        pieces = self.split(text)
        out = list(map(self.recent.get, pieces))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    out[i] = self._of_piece(pieces[i])
        return out

    def _of_piece(self, piece: str) -> list[int]:
        ids = self.recent.get(piece) or self.older.get(piece)
        if ids is None:
            ids = [self.own[i] for i in self.encode_piece(piece.encode())]
            if len(piece) > LONG_PIECE:
                return ids
        if len(self.recent) >= MEMO:  # what was not used for a whole filling goes
            self.older, self.recent = self.recent, {}
        self.recent[piece] = ids
        return ids

    def forget(self) -> None:
        """Drop what is remembered of pieces and pairs."""
        self.recent, self.older, self.fits = {}, {}, {}

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def codec_for(path: str, pattern: str) -> Codec:
    """One codec per Python worker and vocabulary."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(read_ranks(path), pattern)
    return _codecs[path, pattern]


def forget() -> None:
    """Drop the memos of this worker; tasks of other operators call it when they begin."""
    for codec in _codecs.values():
        codec.forget()


def encoded(
    docs: DataFrame,
    path: str,
    pattern: str,
    text_col: str = "text",
    ids_col: str = "ids",
    decoded_col: str = "decoded",
) -> DataFrame:
    """All columns of ``docs``, the ids of the text and the bytes they decode to.

    New columns replace columns of the same name.
    """
    names = [c for c in docs.columns if c not in (ids_col, decoded_col)]
    schema = docs.select(*names).schema.add(ids_col, T.ArrayType(T.IntegerType())).add(decoded_col, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(path, pattern)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                text = row.column(names.index(text_col))[0].as_py() or ""
                ids = [x for piece in codec.encode(text) for x in piece]
                yield pa.RecordBatch.from_arrays(
                    [
                        *row.columns,
                        pa.array([ids], pa.list_(pa.int32())),
                        pa.array([codec.decode(ids)], pa.binary()),
                    ],
                    names=[*names, ids_col, decoded_col],
                )

    return docs.select(*names).mapInArrow(lean(run, keep_memos=True), schema)


def digests(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: id, number of tokens, digest of the ids, digest of the decoded bytes.

    The ids of a text live only while their digests are taken.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = own.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(path, pattern)
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for value in batch.column(1):
                ids = [x for piece in codec.encode(value.as_py() or "") for x in piece]
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return own.mapInArrow(lean(run, keep_memos=True), schema)
