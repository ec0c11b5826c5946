"""Language-model scores by deleted interpolation.

Tokens are words and an end of text. Maximum-likelihood estimates of a token
after its predecessor and of a token alone are mixed with a uniform share for
what was never seen; the weights depend on how often the predecessor was seen and
are learned by expectation-maximisation on the counts of documents that were
deleted from the training counts for that purpose.

Counts are exchanged in columns: documents are dealt into blocks, a block sends
its distinct tokens and token pairs as sorted, packed keys to buckets by hash,
and gets back how often each occurs in all training documents. Texts never meet
a table of the whole vocabulary, and nothing of it goes to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from shotloom.llm.text import words_lower
from shotloom.session import written

#: Bytes of text in a block; bounds what a task holds.
BLOCK_BYTES = 16 << 20
#: Steps of the logarithm (base 2, halves) of an estimate's ratio to the uniform share.
STEPS = 80
#: Buckets of context frequency, by powers of two.
CONTEXTS = 32
END = b"\n"
_TOKEN, _PAIR = 0, 1


def fold(id_col: str, parts: int = 7) -> Column:
    """crc32 of the id as text modulo ``parts``; a null id is in part zero."""
    return F.coalesce((F.crc32(F.col(id_col).cast("string").cast("binary")) % parts).cast("int"), F.lit(0))


def fold_of(doc_id: int | None, parts: int = 7) -> int:
    return 0 if doc_id is None else crc32(str(doc_id).encode()) % parts


@dataclass
class Block:
    """Distinct tokens and pairs of a block of documents, each sorted by its key.

    ``token`` and ``pair`` give for every token of the block, document by
    document, its row in ``token_keys`` and the row of the pair that it ends in
    ``pair_keys``; ``before`` is the row of its predecessor, which for a first
    token is the end. Counts are those of the training documents of the block.
    """

    token_keys: np.ndarray
    token_count: np.ndarray
    pair_keys: np.ndarray
    pair_count: np.ndarray
    token: np.ndarray
    pair: np.ndarray
    before: np.ndarray
    starts: np.ndarray
    train: np.ndarray


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def make_block(texts: list[str | None], train: list[bool]) -> Block:
    rows: dict[bytes, int] = {END: 0}
    tokens, starts, at = [], [], 0
    for text in texts:
        words = words_lower(text)
        for w in set(words).difference(rows):
            rows[w] = len(rows)
        tokens.append(np.fromiter(map(rows.__getitem__, words), dtype=np.int32, count=len(words)))
        tokens.append(np.zeros(1, dtype=np.int32))
        starts.append(at)
        at += len(words) + 1
    keys = np.fromiter(map(xxh64_intdigest, rows), dtype=np.uint64, count=len(rows))
    order = np.argsort(keys)
    place = np.empty(len(order), dtype=np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    keys, token = keys[order], place[np.concatenate(tokens)]
    starts = np.array(starts, dtype=np.int64)
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[0] = place[0]  # the tokens before all others are ends
    counted = np.repeat(np.array(train, dtype=bool), np.diff(np.r_[starts, at]))
    pairs, pair = np.unique(before.astype(np.int64) * len(keys) + token, return_inverse=True)
    pair_keys = _mix(keys[pairs // len(keys)]) * np.uint64(0xD6E8FEB86659FD93) + keys[pairs % len(keys)]
    order = np.argsort(pair_keys)
    place = np.empty(len(order), dtype=np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    pair = place[pair]
    count = lambda rows, n: np.bincount(rows[counted], minlength=n).astype(np.int64)
    return Block(keys, count(token, len(keys)), pair_keys[order], count(pair, len(pair_keys)), token, pair, before, starts, counted)


def _pack(values: np.ndarray) -> bytes:
    """Compressed bytes of an array, low bytes first."""
    return zstandard.compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), 1)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), dtype=np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def _split(keys: np.ndarray, n: int) -> list[np.ndarray]:
    """Rows of the keys by bucket, each in the order of the keys."""
    bucket = ((_mix(keys) >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return np.split(order, np.cumsum(np.bincount(bucket, minlength=n))[:-1])


def _sent(block: Block, number: int, n_buckets: int) -> pa.Table:
    rows = {"bucket": [], "kind": [], "keys": [], "counts": []}
    for kind, keys, counts in ((_TOKEN, block.token_keys, block.token_count), (_PAIR, block.pair_keys, block.pair_count)):
        for bucket, own in enumerate(_split(keys, n_buckets)):
            if not len(own):
                continue  # so that there are at most as many messages as keys, however many blocks and buckets
            rows["bucket"].append(bucket)
            rows["kind"].append(kind)
            rows["keys"].append(_pack(np.diff(keys[own], prepend=np.uint64(0))))
            rows["counts"].append(_pack(counts[own]))
    return pa.table({"block": pa.array([number] * len(rows["kind"]), pa.int64()), "bucket": pa.array(rows["bucket"], pa.int64()), "kind": pa.array(rows["kind"], pa.int32()), "keys": pa.array(rows["keys"], pa.binary()), "counts": pa.array(rows["counts"], pa.binary())})


def _merge(first_deleted: int) -> object:
    """Function of one bucket: for each block the training counts of its keys, of all blocks and without the deleted ones."""

    kinds = {"block": pa.int64(), "bucket": pa.int64(), "kind": pa.int32(), "counts": pa.binary(), "kept": pa.binary(), "types": pa.int64(), "tokens": pa.int64(), "kept_tokens": pa.int64()}

    def run(table: pa.Table) -> pa.Table:
        out = {n: [] for n in kinds}
        for kind in (_TOKEN, _PAIR):
            own = table.filter(pa.compute.equal(table["kind"], kind)).sort_by("block")
            if not own.num_rows:
                continue
            numbers = own["block"].to_pylist()
            keys = [np.cumsum(_unpack(x.as_py(), "<u8"), dtype=np.uint64) for x in own["keys"]]
            counts = [_unpack(x.as_py(), "<i8") for x in own["counts"]]
            distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
            weights = np.concatenate(counts)
            ends = np.cumsum([len(x) for x in keys])
            kept_until = ends[sum(n < first_deleted for n in numbers) - 1] if numbers[0] < first_deleted else 0
            total = np.bincount(place, weights, len(distinct)).astype(np.int64)
            kept = np.bincount(place[:kept_until], weights[:kept_until], len(distinct)).astype(np.int64)
            for number, low, high in zip(numbers, ends - [len(x) for x in keys], ends, strict=True):
                rows = place[low:high]
                for name, value in zip(out, (number, own["bucket"][0].as_py(), kind, _pack(total[rows]), _pack(kept[rows]) if number >= first_deleted else None, 0, 0, 0), strict=True):
                    out[name].append(value)
            if kind == _TOKEN:  # the whole bucket's figures stand once
                out["types"][-1], out["tokens"][-1], out["kept_tokens"][-1] = int((total > 0).sum()), int(total.sum()), int(kept.sum())
        return pa.table({n: pa.array(v, kinds[n]) for n, v in out.items()})

    return run


def _received(answers: pa.Table, kind: int, keys: np.ndarray, n_buckets: int, column: str) -> np.ndarray:
    """Counts that came back, in the order of ``keys``."""
    own = answers.filter(pa.compute.equal(answers["kind"], kind))
    by_bucket = dict(zip(own["bucket"].to_pylist(), own[column].to_pylist(), strict=True))
    out = np.zeros(len(keys), dtype=np.int64)
    for bucket, rows in enumerate(_split(keys, n_buckets)):
        if len(rows):
            out[rows] = _unpack(by_bucket[bucket], "<i8")
    return out


def _steps(ratio: np.ndarray) -> np.ndarray:
    """Half octaves of ratios of at least about one, from 1; zero for zero."""
    return np.where(ratio > 0, 1 + np.clip(np.rint(2 * np.log2(np.where(ratio > 0, ratio, 1))) + 8, 0, STEPS - 1), 0).astype(np.int64)


def _contexts(count: np.ndarray) -> np.ndarray:
    return np.minimum(CONTEXTS - 1, np.log2(count + 1)).astype(np.int64)


def _ratio(count: np.ndarray, of: np.ndarray | float) -> np.ndarray:
    return np.divide(count, of, out=np.zeros(len(count)), where=np.broadcast_to(np.asarray(of) > 0, count.shape))


def learn(cells: np.ndarray, counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Mixture weights by context bucket: columns for pairs, for tokens and for the uniform share.

    A cell is a bucket and the steps of both estimates' ratios to the uniform share.
    """
    ratio = lambda step: np.where(step > 0, 2.0 ** ((step - 9) / 2), 0.0)
    bucket, first, second = cells // (STEPS + 1) ** 2, cells // (STEPS + 1) % (STEPS + 1), cells % (STEPS + 1)
    parts = np.stack([ratio(first), ratio(second), np.ones(len(cells))])
    weights = np.full((CONTEXTS, 3), 1 / 3)
    for _ in range(rounds):
        share = weights[bucket].T * parts
        share *= counts / share.sum(axis=0)
        new = np.stack([np.bincount(bucket, s, CONTEXTS) for s in share], axis=1).astype(float)
        overall = new.sum(axis=0) + 1e-3
        new += overall / overall.sum()  # a bucket that was not seen mixes as all do
        weights = new / new.sum(axis=1, keepdims=True)
    return weights


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 7, held_out: int = 2, deleted: int = 3, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose fold is ``held_out`` teach nothing. base_score is add-one
    unigram, score the interpolated model's log10 probability of the document's
    words and end. Null texts are empty; a null id is training; repeated rows each
    count; an empty table gives none.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    n_kept = max(tasks, ceil(size / block_bytes))
    n_deleted = max(1, n_kept // (parts - 1))
    n_buckets = n_kept
    part = F.pmod(F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary"))), F.lit(n_kept))
    number = F.when(fold("doc_id", parts) == deleted, n_kept + F.pmod(part, F.lit(n_deleted))).otherwise(part)
    dealt = rows.withColumn("block", number.cast("long"))

    def block_of(table: pa.Table) -> tuple[Block, list[int | None]]:
        ids = table["doc_id"].to_pylist()
        return make_block(table["text"].to_pylist(), [fold_of(x, parts) != held_out for x in ids]), ids

    def send(table: pa.Table) -> pa.Table:
        block, _ = block_of(table)
        return _sent(block, table["block"][0].as_py(), n_buckets)

    sent = dealt.groupBy("block").applyInArrow(send, "block long, bucket long, kind int, keys binary, counts binary")
    answers = written(sent.groupBy("bucket").applyInArrow(_merge(n_kept), "block long, bucket long, kind int, counts binary, kept binary, types long, tokens long, kept_tokens long"), "counts")
    types, tokens, kept_tokens = (x or 0 for x in answers.agg(F.sum("types"), F.sum("tokens"), F.sum("kept_tokens")).first())
    uniform = 1 / (types + 1)

    def estimates(block: Block, answered: pa.Table, column: str, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Token counts; and for each token of the block the two estimates and the count of its predecessor."""
        token = _received(answered, _TOKEN, block.token_keys, n_buckets, column)
        pair = _received(answered, _PAIR, block.pair_keys, n_buckets, column)
        context = token[block.before]
        return token, _ratio(pair[block.pair], context), token[block.token] / max(1, total), context

    def tabulate(left: pa.Table, right: pa.Table) -> pa.Table:
        block, _ = block_of(left)
        _, after, alone, context = estimates(block, right, "kept", kept_tokens)
        cell = (_contexts(context) * (STEPS + 1) + _steps(after / uniform)) * (STEPS + 1) + _steps(alone / uniform)
        cells, n = np.unique(cell[block.train], return_counts=True)
        return pa.table({"cell": cells, "n": n})

    deleted_answers = answers.where(F.col("block") >= n_kept).select("block", "bucket", "kind", "kept")
    table = dealt.where(F.col("block") >= n_kept).groupBy("block").cogroup(deleted_answers.groupBy("block")).applyInArrow(tabulate, "cell long, n long")
    # At most CONTEXTS * (STEPS + 1) ** 2 cells, whatever the corpus.
    table = table.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    weights = learn(table["cell"].to_numpy(), table["n"].to_numpy().astype(float))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        block, ids = block_of(left)
        token, after, alone, context = estimates(block, right, "counts", tokens)
        w = weights[_contexts(context)]
        logs = np.log10(w[:, 0] * after + w[:, 1] * alone + w[:, 2] * uniform)
        base = np.log10((token + 1) / (tokens + types + 1))[block.token]
        sums = lambda x: np.add.reduceat(x, block.starts)
        columns = (ids, [fold_of(x, parts) == held_out for x in ids], np.diff(np.r_[block.starts, len(block.token)]), sums((token[block.token] > 0).astype(np.int64)), [tokens] * len(ids), sums(base), sums(logs))
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    answers = answers.select("block", "bucket", "kind", "counts")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
