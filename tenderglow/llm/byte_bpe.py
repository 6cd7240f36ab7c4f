"""Byte-level pair encoding without replaying merges, and decoding.

Bytes are read as Latin-1, so an automaton over the vocabulary finds, in one pass, the longest token that starts at
each place. Two adjacent tokens are compatible if merging their bytes from scratch would leave exactly these two; the
encoding of a text is the one sequence whose neighbours are all compatible. It is found by taking longest matches and
stepping back to shorter ones, never visiting a failed place twice, so the work is linear in the text.

Defined cases: a null or empty text has no ids; a null ``doc_id`` and repeated rows are kept; an empty table gives an
empty table; the query reads no other columns, ``with_tokens`` keeps them all.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from tenderglow.llm.common import text_session, texts

#: Pieces, words after a space, and token pairs that a worker remembers; a table that is full is emptied.
REMEMBERED, SPACED, PAIRS = 300_000, 60_000, 240_000
_LOOSE_SPACE = re.compile(r" (?!\S)").search


def read_ranks(content: bytes) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}


class ByteEncoder:
    """Encodes and decodes by the ranks of a vocabulary; ``pattern`` cuts a text into pieces that never merge."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.pieces = regex.compile(pattern).findall
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.whole: dict[tuple[int, int], int] = {}
        self.shorter: dict[int, int] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            halves = self._last_merge(token)
            if halves:
                self.halves[rank] = halves
                self.whole[halves] = rank
            elif len(token) > 1:
                continue  # merging never yields it, except as a whole piece
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
            self.shorter[rank] = -1
        for rank in self.shorter:
            token = self.tokens[rank]
            self.shorter[rank] = next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if ranks.get(token[:n]) in self.shorter), -1)
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        size = max(self.tokens, default=-1) + 1
        self.bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(size)), np.uint8)
        self.lengths = np.array([len(self.tokens.get(i, b"")) for i in range(size)], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _last_merge(self, token: bytes) -> tuple[int, int] | None:
        """The two tokens that merge last into this one, None if merging stops earlier."""
        parts = [token[i:i + 1] for i in range(len(token))]
        get = self.ranks.get
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: get(parts[i] + parts[i + 1], sys.maxsize))
            if parts[best] + parts[best + 1] not in self.ranks:
                return None
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) < 2 or parts[0] not in self.ranks or parts[1] not in self.ranks:
            return None
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the border between two tokens survives: no merge across it comes before the merges that made them.

        The merges on both sides are undone from the latest one; a merge across the border must not be earlier than
        the merge undone last.
        """
        key = left << 32 | right
        known = self.fits.get(key)
        if known is not None:
            return known
        bound, holds = sys.maxsize, True
        a, b = left, right
        while True:
            across = self.whole.get((a, b))
            if across is not None and across < bound:
                holds = False
                break
            # Undo the later of the two merges; of equal ones the left one happened first.
            undo_left, undo_right = a in self.halves, b in self.halves
            if undo_left and (a > b or not undo_right):
                bound, a = a, self.halves[a][1]
            elif undo_right:
                bound, b = b + 1, self.halves[b][0]
            else:
                break
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        self.fits[key] = holds
        return holds

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size = len(piece)
        longest = [-1] * size
        for last, (rank, length) in self.automaton.iter(piece.decode("latin-1")):
            longest[last - length + 1] = rank  # places come in order, so the longest is written last
        dead = bytearray(size + 1)
        out: list[int] = []
        tokens, shorter, compatible = self.tokens, self.shorter, self.compatible
        at, token = 0, longest[0]
        while at < size:
            while token >= 0:
                end = at + len(tokens[token])
                if not dead[end] and (not out or compatible(out[-1], token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < size else -1
            else:
                if not out:
                    raise ValueError("a byte is not in the vocabulary")
                dead[at] = 1
                token = out.pop()
                at -= len(tokens[token])
                token = shorter[token]
        return out

    def _pieces(self, text: str) -> bytes:
        """The ids of a text, piece by piece."""
        known, out = self.known, []
        for piece in self.pieces(text):
            ids = known.get(piece)
            if ids is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                ids = known[piece] = np.array(self.encode_piece(piece.encode()), "<u4").tobytes()
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        If each space is followed by ink, the pattern always cuts before a space, so what follows each space is looked up
        as a whole; other texts go through the pattern at once.
        """
        if _LOOSE_SPACE(text):
            return self._pieces(text)
        first, *rest = text.split(" ")
        get, out = self.spaced.get, [self._pieces(first)]
        for word in rest:
            ids = get(word)
            if ids is None:
                if len(self.spaced) >= SPACED:
                    self.spaced.clear()
                ids = self.spaced[word] = self._pieces(" " + word)
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        numbers = np.frombuffer(ids, "<u4")
        out = []
        for at in range(0, len(numbers), 1 << 18):
            part = numbers[at:at + (1 << 18)]
            size = self.lengths[part]
            ends = np.cumsum(size)
            place = np.arange(ends[-1]) + np.repeat(self.starts[part] - (ends - size), size)
            out.append(self.bytes[place].tobytes())
        return b"".join(out)


_built: dict[tuple[bytes, str], ByteEncoder] = {}


def encoder(content: bytes, pattern: str) -> ByteEncoder:
    """The encoder of a rank file, built once per worker process."""
    key = hashlib.sha256(content).digest(), pattern
    if key not in _built:
        _built[key] = ByteEncoder(read_ranks(content), pattern)
    return _built[key]


def _mapped(docs: DataFrame, rank_file: str, pattern: str, each, schema: str | S.StructType) -> DataFrame:
    """Runs ``each(encoder, batch)`` over the documents. The driver reads the rank file, whose size the vocabulary bounds."""
    spark = text_session(docs.sparkSession)
    with open(rank_file, "rb") as file:
        content = spark.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(content.value, pattern)
        for batch in batches:
            yield each(own, batch)

    return docs.mapInArrow(run, schema)


def encode_digest(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Per document: number of ids, hash of the ids, and hash of the bytes decoded from them."""
    def each(own: ByteEncoder, batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, ids_hash, bytes_hash = [], [], []
        for text in batch.column("text").to_pylist():
            ids = own.encode(text)
            counts.append(len(ids) // 4)
            ids_hash.append(hashlib.sha256(ids).hexdigest())
            bytes_hash.append(hashlib.sha256(own.decode(ids)).hexdigest())
        return pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()),
            "ids_sha256": pa.array(ids_hash, pa.string()), "decoded_sha256": pa.array(bytes_hash, pa.string())})

    return _mapped(texts(docs), rank_file, pattern, each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def with_tokens(docs: DataFrame, rank_file: str, pattern: str, into: str = "token_ids") -> DataFrame:
    """The documents, all columns kept, with their ids as an array of ints; a null text has an empty array.

    A column that already has the name ``into`` is replaced.
    """
    rest = docs.drop(into) if into in docs.columns else docs
    kept = rest.select(F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in rest.columns)).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    kind = kept.schema["row"].dataType

    def each(own: ByteEncoder, batch: pa.RecordBatch) -> pa.RecordBatch:
        encoded = [own.encode(text) for text in batch.column("text").to_pylist()]
        offsets = np.cumsum([0, *(len(ids) // 4 for ids in encoded)]).astype(np.int32)
        values = pa.array(np.frombuffer(b"".join(encoded), "<u4").astype(np.int32))
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.ListArray.from_arrays(pa.array(offsets), values)], ["row", "ids"])

    schema = S.StructType([S.StructField("row", kind), S.StructField("ids", S.ArrayType(S.IntegerType()))])
    out = _mapped(kept, rank_file, pattern, each, schema)
    return out.select("row.*", F.col("ids").alias(into))
