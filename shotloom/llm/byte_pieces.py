"""Byte-level BPE by a sentencepiece model that is written straight from the vocabulary.

A ranked vocabulary (base64 of a token's bytes and its rank, a line each) becomes a
serialised BPE model: each piece is spelled with one printing character a byte and
scored by its negative rank, normalisation is the identity, and the id of a piece is
its rank. Texts are split into pre-tokens, which the model encodes one by one; ids are
decoded by mapping the characters of their pieces back to bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotloom.llm.memory import map_batches

#: Distinct pre-tokens whose ids are remembered in a task before it starts afresh.
CACHE_SIZE = 400_000
#: Characters of the texts that are split together, but for one text that is longer by itself.
SPLIT_AT_ONCE = 1_000_000
#: Bytes that print as themselves; the others are spelled by code points from 256 on.
_PRINTING = [*range(33, 127), *range(161, 173), *range(174, 256)]
SPELLED = {b: chr(b) for b in _PRINTING} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(_PRINTING))}
BYTES = {ord(c): b for b, c in SPELLED.items()}


def spell(data: bytes) -> str:
    """One printing character a byte."""
    return data.decode("latin-1").translate(SPELLED)


def unspell(piece: str) -> bytes:
    """The bytes that ``piece`` spells."""
    return piece.translate(BYTES).encode("latin-1")


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, at their ranks; the ranks have to be 0, 1, 2 and so on."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in lines if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks have gaps or repeat")
    return [ranks[rank] for rank in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def serialise_model(tokens: list[bytes]) -> bytes:
    """The sentencepiece model of a ranked vocabulary; one unknown piece follows the last rank.

    Field numbers are those of the public model format: pieces 1 (piece 1, score 2,
    type 3), trainer 2 (model type 3, vocabulary size 4, unknown, begin, end and pad id
    40 to 43), normaliser 3 (name 1, dummy prefix 3, extra spaces 4, escaped spaces 5).
    """
    unknown, absent = len(tokens), (1 << 64) - 1
    pieces = [_bytes(1, _bytes(1, spell(token).encode()) + b"\x15" + struct.pack("<f", -rank)) for rank, token in enumerate(tokens)]
    pieces.append(_bytes(1, _bytes(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2)))
    trainer = _number(3, 2) + _number(4, unknown + 1) + _number(40, unknown) + b"".join(_number(field, absent) for field in (41, 42, 43))
    normaliser = _bytes(1, b"identity") + b"".join(_number(field, 0) for field in (3, 4, 5))
    return b"".join(pieces) + _bytes(2, trainer) + _bytes(3, normaliser)


class Codec:
    """Encodes texts to ids and ids to bytes by a serialised model.

    Ids are little-endian unsigned 32-bit bytes. A pre-token that is itself in the
    vocabulary is its own id, even where merging its bytes would end elsewhere.
    """

    def __init__(self, model: bytes, pattern: str) -> None:
        import regex
        from sentencepiece import SentencePieceProcessor

        self.pieces = SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        self.unknown = self.pieces.unk_id()
        self.tokens = [unspell(piece) for piece in self.pieces.id_to_piece(list(range(self.unknown)))]
        self.known: dict[str, bytes] = {}

    def _learn(self, parts: list[str]) -> None:
        spelled = [spell(part.encode()) for part in parts]
        for part, whole, ids in zip(parts, self.pieces.piece_to_id(spelled), self.pieces.encode(spelled, num_threads=1), strict=True):
            self.known[part] = struct.pack("<I", whole) if whole != self.unknown else struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        held, size = [], 0
        for text in texts:
            if size >= SPLIT_AT_ONCE:
                yield from self._encode(held)
                held, size = [], 0
            held.append(text or "")
            size += len(held[-1])
        yield from self._encode(held)

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        known, split = self.known, [self.split(text) for text in texts]
        if len(known) > CACHE_SIZE:
            known.clear()
        new = set().union(*split).difference(known)
        if new:
            self._learn(list(new))
        for parts in split:
            yield b"".join(map(known.__getitem__, parts))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I") if ids else ()))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every text: doc_id, ids (little-endian unsigned 32-bit numbers), n_tokens.

    The vocabulary is read and serialised once, on the driver; tasks get the model
    (about 1 MB). A null or empty text has no ids; null doc_ids stay; repeated rows are
    encoded each; special tokens are ordinary text; an empty table gives none. Other
    columns are left out. Nothing is shuffled.
    """
    model = serialise_model(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model, pattern)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(codec.encode(part.column(1).to_pylist()), pa.binary())], ["doc_id", "ids"])

    out = map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, ids binary")
    return out.withColumn("n_tokens", F.expr("octet_length(ids) div 4"))


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``encoded`` (doc_id, ids, n_tokens) and data: the bytes that the ids stand for.

    Null ids give no bytes; an id outside the vocabulary is an error.
    """
    model = serialise_model(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model, pattern)
        for batch in batches:
            data = pa.array([codec.decode(ids or b"") for ids in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, data], ["doc_id", "ids", "n_tokens", "data"])

    return map_batches(encoded.select("doc_id", "ids", "n_tokens"), run, "doc_id long, ids binary, n_tokens long, data binary")
