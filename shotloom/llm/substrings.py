"""Removal of long repeated byte strings, by prefix-free parsing.

A rolling hash over a few bytes decides the triggers; triggers cut every text
into phrases in the same way wherever the same bytes stand. A string of
``min_bytes`` then has a place in the corpus order that is made of two parts: the
phrase suffix before its first trigger and the parse that follows the trigger.
Strings are equal exactly if both parts are, so the order's runs of equal
strings are found per trigger:

1. The strings of a trigger are taken in bands of their distance to it. A band
   gives a dictionary key, the bytes that all of its strings share, and a parse
   key, all bytes that its strings cover.
2. Dictionary keys that occur once end there; nearly all of a corpus does.
3. A parse key that occurs again repeats all strings of its band at once.
4. What is left, where a repeated passage begins or ends, is taken in narrower
   bands, down to single strings. One document for each parse key of step 3 that
   shares its dictionary key with one of these goes with them for comparison.

The order itself is never stored: what is asked of it is which neighbours share
``min_bytes``, and keys of 96 or 128 bits give its classes. All counts are
partial aggregates and all joins plain shuffles, so a passage that a third of the
corpus shares is summed before it is sent.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from shotloom.llm.memory import map_batches
from shotloom.session import broadcast_if_small, written

#: Bytes of text that are hashed at once.
BLOCK = 1 << 19
#: Size of the filter of repeated dictionary keys: 2**20 longs, 8 MB.
SIEVE_WORDS = 1 << 20
#: Document ids that are broadcast at most, to pick texts before they are shuffled.
IDS_AT_ONCE = 1_000_000
#: Bytes of the number that stands for a word.
CODE = 4
Encode = Callable[[str | None], bytes]
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX[0]
    return x ^ (x >> np.uint64(29))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a * _MIX[0] ^ _mix(b)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... of each given length, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class Rolling:
    """Polynomial hashes modulo 2**64 of substrings, from sums over a block."""

    def __init__(self, size: int) -> None:
        rng = np.random.default_rng(20240229)
        self.table = rng.integers(0, 1 << 63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.power, self.inverse = [], []
        for odd in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F):
            back = pow(odd, -1, 1 << 64)
            for base, into in ((odd, self.power), (back, self.inverse)):
                steps = np.full(size + 1, base, dtype=np.uint64)
                steps[0] = 1
                into.append(np.multiply.accumulate(steps))

    def sums(self, data: np.ndarray, which: int) -> np.ndarray:
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.table[which][data] * self.power[which][: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, which: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mix((sums[ends] - sums[starts]) * self.inverse[which][starts])


@dataclass
class Found:
    """Bands of a block: piece, place of the trigger, first and last distance, keys."""

    piece: np.ndarray
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    core: np.ndarray
    ctx: np.ndarray

    def begin(self) -> np.ndarray:
        return self.at - self.high

    def take(self, rows: np.ndarray) -> Found:
        return Found(self.piece[rows], self.at[rows], self.low[rows], self.high[rows], self.core[rows], self.ctx[rows])


class Parser:
    """Prefix-free parsing of blocks of bytes.

    A string of n bytes belongs to its first trigger t, at distance d before it.
    Strings without a trigger stand for themselves. ``widths`` are the widths of
    the bands of distances, from half of n down to single strings.
    """

    def __init__(self, min_bytes: int = 400, trigger: int = 16, modulus_bits: int = 6) -> None:
        if min_bytes < 4 * trigger:
            raise ValueError("min_bytes must be at least four times the trigger's width")
        self.n, self.w, self.bits = min_bytes, trigger, modulus_bits
        self.widths = (min_bytes // 2, max(2, min_bytes // 16), 1)
        self.rolling = Rolling(BLOCK + 4 * min_bytes)

    def blocks(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(bytes, table of pieces: text number, offset in the text, begin, end, own begin, own end), in blocks of bounded size."""
        held, rows, size = [], [], 0

        def out() -> tuple[np.ndarray, np.ndarray]:
            return np.frombuffer(b"".join(held), dtype=np.uint8), np.array(rows, dtype=np.int64).reshape(-1, 6)

        for k, text in enumerate(texts):
            if len(text) < self.n:
                continue
            for own in range(0, len(text), BLOCK):
                low, high = max(0, own - self.n), min(len(text), own + BLOCK + 2 * self.n)
                if size and size + high - low > BLOCK:
                    yield out()
                    held, rows, size = [], [], 0
                held.append(text[low:high])
                rows.append((k, low, size, size + high - low, size + own - low, size + min(len(text), own + BLOCK) - low))
                size += high - low
        if rows:
            yield out()

    def parse(self, data: np.ndarray, pieces: np.ndarray) -> tuple[Found, np.ndarray, np.ndarray]:
        n, w, roll = self.n, self.w, self.rolling
        first, second = roll.sums(data, 0), roll.sums(data, 1)
        starts = np.arange(max(0, len(data) - w + 1))
        hit = _mix((first[w:] - first[: len(starts)]) * roll.inverse[0][: len(starts)]) >> np.uint64(64 - self.bits) == 0
        t = np.flatnonzero(hit)
        begin, end, own_low, own_high = pieces[:, 2], pieces[:, 3], pieces[:, 4], pieces[:, 5]
        of = np.searchsorted(begin, t, side="right") - 1
        fits = t + w <= end[of]
        t, of = t[fits], of[fits]
        last = np.r_[-1, t[:-1]] if len(t) else t
        last = np.maximum(last, begin[of] - 1)  # the trigger before, or just before the piece
        own = (t >= own_low[of]) & (t < own_high[of])
        nearest, farthest = np.maximum(0, t + n - end[of]), np.minimum(t - last - 1, n - w)
        keep = own & (nearest <= farthest)
        none = np.empty(0, dtype=np.uint64)
        bands = self.bands(Found(of[keep], t[keep], nearest[keep], farthest[keep], none, none), 0, first, second)
        # Strings without any trigger: between two triggers (or the ends of a piece) more than n - w apart.
        edges = np.concatenate([t, begin - 1, end])
        kind = np.concatenate([np.ones(len(t), np.int8), np.zeros(len(begin), np.int8), np.full(len(end), 2, np.int8)])
        piece = np.concatenate([of, np.arange(len(begin)), np.arange(len(end))])
        order = np.lexsort((kind, edges, piece))
        edges, kind, piece = edges[order], kind[order], piece[order]
        a, b, p, closed = edges[:-1], edges[1:], piece[:-1], kind[1:] == 2
        low = np.maximum(a + 1, own_low[p])
        high = np.minimum(np.where(closed, end[p] - n, np.minimum(b + w - n - 1, end[p] - n)), own_high[p] - 1)
        gap = (p == piece[1:]) & (low <= high)
        i = _ranges(low[gap], (high - low + 1)[gap])
        zero = np.zeros(len(i), dtype=np.int64)
        p = np.repeat(p[gap], (high - low + 1)[gap])
        core = roll.of(first, 0, i, i + n) + np.uint64(1 << 20)
        alone = Found(p, i, zero, zero, core, _pair(core, roll.of(second, 1, i, i + n)))
        return _joined(bands, alone), first, second

    def bands(self, found: Found, level: int, first: np.ndarray, second: np.ndarray) -> Found:
        """The bands of the given ranges of distances at a level, with their keys."""
        n, width = self.n, self.widths[level]
        low, high = found.low // width, found.high // width
        rows = np.repeat(np.arange(len(low)), high - low + 1)
        k = _ranges(low, high - low + 1)
        at, near, far = found.at[rows], np.maximum(found.low[rows], k * width), np.minimum(found.high[rows], (k + 1) * width - 1)
        shared = at - k * width  # all strings of the band cover the bytes from here to the end of the farthest
        core = self.rolling.of(first, 0, shared, shared - width + 1 + n) + k.astype(np.uint64) * np.uint64(width > 1)
        ctx = self.rolling.of(second, 1, at - far, at - near + n)
        if width > 1:
            ctx = ctx + far.astype(np.uint64) * _MIX[1]
        return Found(found.piece[rows], at, near, far, core, _pair(core, ctx))


def _joined(a: Found, b: Found) -> Found:
    return Found(*(np.concatenate([getattr(a, f.name), getattr(b, f.name)]) for f in fields(Found)))


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _unique(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row numbers and counts of the distinct rows."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    starts = np.flatnonzero(new)
    return order[starts], np.diff(np.r_[starts, len(order)])


def _sieve(cores: DataFrame) -> np.ndarray:
    """Bits of a filter of fixed size (SIEVE_WORDS longs) that all given keys pass.

    It spares the shuffle of keys that occur once; the more keys there are, the
    more of the others pass, and the join that follows is exact in any case.
    """
    bit = F.expr(f"shiftleft(1L, CAST(shiftright(core, {SIEVE_WORDS.bit_length() - 1}) & 63 AS INT))")
    rows = cores.groupBy(F.col("core").bitwiseAND(SIEVE_WORDS - 1).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(SIEVE_WORDS, dtype=np.uint64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)
    return out


def _passes(sieve: np.ndarray, core: np.ndarray) -> np.ndarray:
    shift = np.uint64(SIEVE_WORDS.bit_length() - 1)
    return (sieve[core & np.uint64(SIEVE_WORDS - 1)] >> ((core >> shift) & np.uint64(63))) & np.uint64(1) == 1


def row_key(id_col: str, text_col: str) -> Column:
    """A number for a row's id and text; rows that repeat both share it."""
    return F.xxhash64(id_col, F.coalesce(F.col(text_col), F.lit("")))


def _trigger_rows(rows: DataFrame, parser_of: tuple, encode: Encode, sieve: np.ndarray | None = None) -> DataFrame:
    """(key, core, ctx, n) of every trigger that passes; equal rows of a text are one with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(*parser_of)
        for batch in batches:
            keys = batch.column(0)
            for low in range(0, batch.num_rows, 128):
                texts = [encode(x) for x in batch.column(1).slice(low, 128).to_pylist()]
                for data, pieces in parser.blocks(texts):
                    found, _, _ = parser.parse(data, pieces)
                    text = pieces[found.piece, 0]
                    own, n = _unique(found.ctx, found.core, text)
                    if sieve is not None:
                        passed = _passes(sieve, found.core[own])
                        own, n = own[passed], n[passed]
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(text[own] + low)), pa.array(found.core[own].view(np.int64)), pa.array(found.ctx[own].view(np.int64)), pa.array(n)], ["key", "core", "ctx", "n"])

    return map_batches(rows.select("key", "text"), run, "key long, core long, ctx long, n long")


def _levels(parser: Parser, text: bytes, going: list[np.ndarray]) -> Iterator[tuple[int, Found, int]]:
    """Bands of one text, level by level, and where the block stands in the text.

    ``going`` has for each level the keys of the bands that go on to the next.
    """
    for data, pieces in parser.blocks([text]):
        found, first, second = parser.parse(data, pieces)
        shift = int(pieces[0, 1] - pieces[0, 2])
        for level in range(len(going) + 1):
            if level:
                found = parser.bands(found.take(np.isin(found.ctx, going[level - 1])), level, first, second)
            yield level, found, shift


def _finer_rows(marked: DataFrame, parser_of: tuple, level: int) -> DataFrame:
    """(key, core, ctx, n) of the bands of a level, for what the levels before left open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(*parser_of)
        for batch in batches:
            for key, packed, *marks in zip(*(batch.column(k) for k in range(2 + level)), strict=True):
                going = [_keys(m) for m in marks]
                if not len(going[-1]):
                    continue
                for at, found, _ in _levels(parser, zstandard.decompress(packed.as_py()), going):
                    if at == level:
                        rows, n = _unique(found.ctx, found.core)
                        yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(rows), pa.int64()), pa.array(found.core[rows].view(np.int64)), pa.array(found.ctx[rows].view(np.int64)), pa.array(n)], ["key", "core", "ctx", "n"])

    return map_batches(marked.select("key", "packed", *(f"open{k}" for k in range(level))), run, "key long, core long, ctx long, n long")


def _keys(values: pa.Scalar) -> np.ndarray:
    if values.values is None:
        return np.empty(0, dtype=np.uint64)
    return values.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _spans(parser: Parser, data: bytes, open_keys: list[np.ndarray], whole: list[np.ndarray]) -> list[tuple[int, int]]:
    """Maximal covered runs of one text."""
    cover: list[np.ndarray] = []
    for level, found, shift in _levels(parser, data, open_keys):
        full = np.isin(found.ctx, whole[level])
        cover.append(np.stack([found.begin()[full], found.at[full] - found.low[full] + parser.n], axis=1) + shift)
    runs: list[tuple[int, int]] = []
    for low, high in sorted(map(tuple, np.concatenate(cover).tolist())) if cover else []:
        if runs and low <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(high, runs[-1][1]))
        else:
            runs.append((low, high))
    return runs


def _packed(rows: DataFrame, encode: Encode) -> DataFrame:
    """The same rows with compressed bytes of what is parsed of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                packed = pa.array([squeeze.compress(encode(x.as_py())) for x in part.column(2)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), packed, part.column(3), part.column(4)], ["key", "doc_id", "packed", "open0", "whole0"])

    return map_batches(rows.select("key", "doc_id", "text", "open0", "whole0"), run, "key long, doc_id long, packed binary, open0 array<long>, whole0 array<long>")


def _judge(rows_of: Callable[[np.ndarray | None], DataFrame], level: int) -> DataFrame:
    """(key, open, whole): of each text's bands with a repeated dictionary key, the parse keys to look into and those that are repeated."""
    counts = rows_of(None).groupBy("core").agg(F.sum("n").alias("m"))
    repeated = written(counts.where("m > 1").select("core"), "keys")
    candidates = written(rows_of(_sieve(repeated) if level == 0 else None).join(repeated, "core", "left_semi"), "bands")
    contexts = written(candidates.groupBy("core", "ctx").agg(F.sum("n").alias("m"), F.min("key").alias("first")), "parses")
    unsure = contexts.where("m = 1").select("core", F.lit(True).alias("unsure")).distinct()
    contexts = written(contexts.where("m > 1").join(unsure, "core", "left"), "parses")
    flagged = candidates.join(contexts, ["core", "ctx"], "left")
    whole, leads = F.col("m").isNotNull(), F.col("unsure") & (F.col("key") == F.col("first"))
    open_keys = F.collect_set(F.when(~whole | leads, F.col("ctx"))).alias(f"open{level}")
    return written(flagged.groupBy("key").agg(open_keys, F.collect_set(F.when(whole, F.col("ctx"))).alias(f"whole{level}")), "marks")


_NAMES = ("doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256", "kept")


def _changed(rows: DataFrame, parser_of: tuple, encode: Encode, with_kept: bool) -> tuple[DataFrame, DataFrame]:
    """Of ``rows`` (key, doc_id, text) the ones with a repeat, with what is taken out of them, and their keys."""
    marks = _judge(lambda sieve: _trigger_rows(rows, parser_of, encode, sieve), 0)
    own = F.col("key") == F.col("own")
    picked = rows.join(broadcast_if_small(marks.select(F.col("key").alias("own")), IDS_AT_ONCE), own, "left_semi")
    marked = written(_packed(picked.join(marks, "key"), encode), "texts")
    levels = [marks]
    for level in (1, 2):
        levels.append(_judge(lambda _, level=level: _finer_rows(marked, parser_of, level), level))  # noqa: B023
        marked = marked.join(levels[-1], "key", "left")
        marked = written(marked, "texts") if level == 1 else marked
    judged = marked.where(" or ".join(f"coalesce(size(whole{k}), 0) > 0" for k in range(3)))
    keys = levels[0].where("size(whole0) > 0").select("key")
    for k in (1, 2):
        keys = keys.unionByName(levels[k].where(f"size(whole{k}) > 0").select("key"))
    names = ["key", *_NAMES[: 6 + with_kept]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(*parser_of)
        span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        kinds = [pa.int64()] * 5 + [span, pa.string(), pa.binary()]
        for batch in batches:
            for key, doc_id, packed, *marks in zip(*(batch.column(k) for k in range(8)), strict=True):
                data = zstandard.decompress(packed.as_py())
                runs = _spans(parser, data, [_keys(m) for m in marks[:2]], [_keys(m) for m in marks[2:]])
                ends = [0, *(x for r in runs for x in r), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                row = (key.as_py(), doc_id.as_py(), len(data), len(data) - len(kept), len(runs), [{"begin": a, "end": b} for a, b in runs], hashlib.sha256(kept).hexdigest(), kept)
                yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row[: len(names)], kinds, strict=False)], names)

    schema = "key long, doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<begin: long, end: long>>, kept_sha256 string" + ", kept binary" * with_kept
    return map_batches(judged.select("key", "doc_id", "packed", "open0", "open1", "whole0", "whole1", "whole2"), run, schema), keys.distinct()


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select(row_key("doc_id", "text").alias("key"), "doc_id", "text")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 400, trigger: int = 16, modulus_bits: int = 6, with_kept: bool = True) -> DataFrame:
    """Take out every byte that a repeated string of ``min_bytes`` covers.

    One row per input row: doc_id, n_bytes, n_removed, n_spans, spans (begin and
    end of the maximal removed runs, in bytes of the UTF-8 text), kept_sha256 and,
    if asked, kept (binary, the other bytes in order). A string counts as repeated
    if it starts at two places of the corpus, in one text or in two, also where
    they overlap; all of its places are taken out, judged on the input. Strings
    never cross texts. A null text is empty; texts shorter than ``min_bytes`` stay
    whole. Rows that repeat a document repeat its strings. Null ids are kept; an
    empty table gives none; other columns are ignored.
    """
    rows = _keyed(docs, id_col, text_col)
    changed, keys = _changed(rows, (min_bytes, trigger, modulus_bits), _bytes, with_kept)
    zero, kept = F.lit(0).cast("long"), F.encode("text", "utf-8")
    same = rows.join(broadcast_if_small(written(keys.withColumnRenamed("key", "own"), "ids"), IDS_AT_ONCE), F.col("key") == F.col("own"), "left_anti")
    same = same.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.array().cast("array<struct<begin: long, end: long>>").alias("spans"), F.sha2(kept, 256).alias("kept_sha256"), *([kept.alias("kept")] if with_kept else []))
    return changed.drop("key").unionByName(same)


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def word_codes(text: str | None) -> bytes:
    """A hash of CODE bytes for each word of a text; equal runs of words are equal runs of bytes."""
    words = _bytes(text).split()
    return np.fromiter(map(xxh32_intdigest, words), dtype="<u4", count=len(words)).tobytes()


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 400, min_words: int = 51) -> DataFrame:
    """What of each document is repeated, as strings of ``min_bytes`` or as runs of ``min_words`` words, however short.

    Returns key (see ``row_key``) and, for ``cut_text``, by_bytes and by_words:
    spans in the text and in its word codes with the digest of the rest. Rows
    without a repeat are left out; rows that repeat id and text are one.
    """
    rows = _keyed(docs, id_col, text_col)
    # At 2**5 a run of words has a trigger as surely as 400 bytes have at 2**6.
    kinds = {"by_bytes": (_bytes, (min_bytes, 16, 6)), "by_words": (word_codes, (min_words * CODE, 16, 5))}
    found = None
    for name, (encode, parser_of) in kinds.items():
        out, _ = _changed(rows, parser_of, encode, with_kept=False)
        out = written(out.groupBy("key").agg(F.collect_set(F.struct("spans", "kept_sha256")).alias(name)), name)
        found = out if found is None else found.join(out, "key", "full")
    return found


def _without(data: bytes, spans: list) -> list[bytes]:
    ends = [0, *(x for s in spans for x in (s["begin"], s["end"])), len(data)]
    return [data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)]


def _own(data: bytes, told: list | None) -> list:
    """The spans of this text among those of its key."""
    for x in told or []:
        if hashlib.sha256(b"".join(_without(data, x["spans"]))).hexdigest() == x["kept_sha256"]:
            return x["spans"]
    return []


def cut_text(text: str | None, by_bytes: list | None, by_words: list | None, min_words: int = 51) -> str | None:
    """The text without its repeats, empty if no word is left; None if nothing is cut.

    A cut inside a character leaves the rest of it out.
    """
    data = _bytes(text)
    gone = [(s["begin"], s["end"]) for s in _own(data, by_bytes)]
    spans = _own(word_codes(text), by_words) if by_words else []
    if spans:
        places = [m.span() for m in _WORD.finditer(data)]
        for s in spans:
            first, end = -(-s["begin"] // CODE), s["end"] // CODE  # codes of unlike words may share bytes at the edges
            if end - first >= min_words:
                gone.append((places[first][0], places[end - 1][1]))
    if not gone:
        return None
    runs: list[dict[str, int]] = []
    for a, b in sorted(gone):
        if runs and a <= runs[-1]["end"]:
            runs[-1]["end"] = max(b, runs[-1]["end"])
        else:
            runs.append({"begin": a, "end": b})
    kept = _without(data, runs)
    return "".join(x.decode("utf-8", "ignore") for x in kept) if b"".join(kept).strip() else ""
