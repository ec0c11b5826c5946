"""Sequence packing by the sum-of-squares rule.

Each task keeps an array of how many partly filled windows stand at each fill
level. A document's tokens go to the level (or the new window) for which the sum
of the squared counts is least afterwards; tokens beyond whole windows are cut
off first. Windows still open at the end of a task are joined by cutting, and
what then is left over is split at powers of two, which need no padding.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotloom.llm.memory import map_batches

#: Distinct word pieces whose ids are remembered in a task before it starts afresh.
CACHE_SIZE = 400_000


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, from a byte-level BPE file.

    Byte-level BPE never merges across the pre-tokens of its split pattern, so
    the ids of each distinct pre-token are remembered. The pattern is spelled out
    for texts of the first Latin blocks; a text with any other character is given
    to the tokenizer whole. The strings of special tokens are ordinary text unless
    ``special`` is set.
    """

    #: Letters and digits of the blocks below (fixed values of the Unicode tables).
    LETTERS, DIGITS = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾"
    PLAIN = r"[\t\n\r\x20-\x7e¡-ſ]*"

    def __init__(self, path: str, special: bool = False) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special] if special else []
        letters, digits = self.LETTERS, self.DIGITS
        self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+| ?[^\s{letters}{digits}]+|\s+(?!\S)|\s+").findall
        self.plain = re.compile(self.PLAIN).fullmatch
        self.known: dict[str, bytes] = {}
        # Byte-level vocabularies write the bytes that print as themselves and the others from code point 256 on.
        printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printing)]
        self.spelled = {b: chr(b) for b in printing} | {b: chr(256 + k) for k, b in enumerate(others)}

    def _ids(self, part: str) -> bytes:
        spelled = part.encode().decode("latin-1").translate(self.spelled)
        return np.array([t.id for t in self.tokenizer.model.tokenize(spelled)], dtype="<u4").tobytes()

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        known = self.known
        if len(known) > CACHE_SIZE:
            known.clear()
        for text in texts:
            if not text:
                yield b""
            elif self.plain(text) and not any(s in text for s in self.special):
                parts = self.split(text)
                for part in set(parts).difference(known):
                    known[part] = self._ids(part)
                yield b"".join(map(known.__getitem__, parts))
            else:
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


class Packer:
    """Places token runs into windows; closed windows come out as piece rows.

    A piece is (doc_id, start, ids, doc_tokens); a row adds sequence and offset. Open
    windows hold what a task has read and not closed yet, at most its input; with
    ``max_open`` they are joined early above so many.
    """

    def __init__(self, window: int, first_sequence: int, max_open: int | None = None) -> None:
        self.window, self.next, self.max_open = window, first_sequence, max_open
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(window)]
        self.n_open, self.rows = 0, []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, size = len(ids) // 4, self.window
        whole = total - total % size
        for at in range(0, whole, size):
            self._close([(doc_id, at, ids[4 * at : 4 * (at + size)], total)])
        if whole < total:
            self._place((doc_id, whole, ids[4 * whole :], total), total - whole)
        if self.max_open is not None and self.n_open > self.max_open:
            self.drain()

    def _place(self, piece: tuple, size: int) -> None:
        n, room = self.count, self.window - size
        # Change of the sum of squares: one less at the level, one more above it; a full window counts nothing.
        change = 2 * n[size : self.window + 1] + 1
        change[-1] = 0
        change[1:] += 1 - 2 * n[1 : room + 1]
        change[1:][n[1 : room + 1] == 0] = np.iinfo(np.int64).max
        level = room - int(np.argmin(change[::-1]))  # of equals the fullest
        held = self.open[level].pop() if level else []
        if level:
            n[level] -= 1
            self.n_open -= 1
        held.append(piece)
        if level == room:
            self._close(held)
        else:
            self.open[level + size].append(held)
            n[level + size] += 1
            self.n_open += 1

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids) // 4, crc32(ids), total, self.next, offset, ids))
            offset += len(ids) // 4
        self.next += 1

    def drain(self) -> None:
        """Close all open windows: full ones by cutting pieces, the rest at powers of two."""
        queue = [piece for level in reversed(self.open) for held in level for piece in held]
        left = sum(len(p[2]) // 4 for p in queue)
        self.open, self.n_open = [[] for _ in range(self.window)], 0
        self.count[:] = 0
        queue.reverse()
        while left:
            want = self.window if left >= self.window else 1 << (left.bit_length() - 1)
            left, now = left - want, []
            while want:
                doc_id, start, ids, total = queue.pop()
                if len(ids) // 4 > want:
                    queue.append((doc_id, start + want, ids[4 * want :], total))
                    ids = ids[: 4 * want]
                now.append((doc_id, start, ids, total))
                want -= len(ids) // 4
            self._close(now)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1, with_ids: bool = True, special: bool = False) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most ``window`` tokens.

    A document is its token ids and ``end_id``; a null or empty text is the end
    id alone. Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset and, if asked, ids (little-endian unsigned 32-bit). Each token lies in
    one piece; pieces of a sequence follow each other without gaps. Repeated rows
    are packed each; null ids stay null; an empty table gives none. Tasks pack
    what they read, so nothing is shuffled, and sequence ids hold the task's
    number, so a task that is run again gives the same rows. A task holds the ids of
    its open windows, four bytes a token of the split it reads at most. The strings of
    the tokenizer's special tokens are ordinary text, as its own notes advise, or with
    ``special`` their single ids. Other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = Encoder(tokenizer_path, special), Packer(window, TaskContext.get().partitionId() << 33)
        end, kinds = np.array([end_id], dtype="<u4").tobytes(), [pa.int64()] * 7 + [pa.binary()] * with_ids

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True)) or [[]] * 8
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names)

        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    packer.add(doc_id, ids + end)
                yield out()
        packer.drain()
        yield out()

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: 7 + with_ids]
    schema = ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names)
    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, schema)
