"""SimHash near-duplicate groups by covering locality-sensitive hashing.

Fingerprints are 64-bit majority votes over the XXH64 values of a text's word
shingles. Two fingerprints link if at most ``radius`` bits differ. For radius r,
every bit position is given a non-zero vector of r+1 bits; each of the
2**(r+1)-1 non-zero vectors v makes a mask of the positions whose vector has an
odd product with v. At most r differing positions span a space that some v is
orthogonal to, so such a pair agrees on all bits of that mask: each linked pair
meets in some table, without exception.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from shotloom.llm.memory import map_batches
from shotloom.llm.text import words_lower
from shotloom.operators.graph import connected_components
from shotloom.session import cut

#: Buckets of more distinct fingerprints than this go to a second level of masks.
BUCKET_LIMIT = 4096


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the unsigned 64-bit hashes, as a signed integer; zero for none."""
    votes = np.zeros(64, dtype=np.int64)
    for low in range(0, len(hashes), 65536):
        block = hashes[low : low + 65536].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of one text as a signed 64-bit integer; zero for a text without words."""
    words = words_lower(text)
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    total = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(xxh64_intdigest, parts, repeat(seed)), dtype="<u8", count=total)
    return majority(hashes)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(x.as_py(), shingle) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], ["doc_id", "fp"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, fp long")


def covering_masks(radius: int, bits: list[int]) -> list[int]:
    """Masks over the given bit positions, one for each non-zero vector of radius+1 bits."""
    vectors = range(1, 1 << (radius + 1))
    given = {bit: 1 + k % len(vectors) for k, bit in enumerate(bits)}
    return [sum(1 << bit for bit, own in given.items() if (own & v).bit_count() % 2) for v in vectors]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the components among ``values``: one for each value but the roots.

    Walks each component from its first value and compares the frontier with
    what is left, so that a group of m values never makes m*m rows.
    """
    rest, sons, roots = np.arange(1, len(values)), [], []
    first, frontier = 0, [0]
    while len(rest):
        if not frontier:
            first, rest = rest[0], rest[1:]
            frontier = [first]
            continue
        near = np.bitwise_count(values[rest] ^ values[frontier.pop()]) <= radius
        if near.any():
            new, rest = rest[near], rest[~near]
            sons.append(values[new])
            roots.append(np.full(len(new), values[first]))
            frontier.extend(new.tolist())
    empty = np.empty(0, dtype=np.int64)
    return (np.concatenate(sons), np.concatenate(roots)) if sons else (empty, empty)


def _bucket_links(members: DataFrame, radius: int) -> DataFrame:
    """Links inside each bucket. ``members``: (bucket, fp), all of a bucket in one partition, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_key, kept = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

        def solve(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            found = [forest(fps[a:b], radius) for a, b in zip(starts, np.r_[starts[1:], len(keys)], strict=True) if b - a > 1]
            empty = np.empty(0, dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in found] or [empty])) for k in (0, 1)], ["src", "dst"])

        for batch in batches:
            keys = np.r_[kept_key, batch.column(0).to_numpy()]
            fps = np.r_[kept, batch.column(1).to_numpy()]
            if not len(keys):
                continue
            last = np.searchsorted(-(keys != keys[-1]).astype(np.int8), 0)  # where the run of the last key begins
            if last:
                yield solve(keys[:last], fps[:last])
            kept_key, kept = keys[last:], fps[last:]
        if len(kept):
            yield solve(kept_key, kept)

    return map_batches(members, run, "src long, dst long")


def fingerprint_links(fps: DataFrame, radius: int = 3, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links (src, dst) that join all components of distinct fingerprints ``fps`` (fp).

    Buckets of one fingerprint are dropped before anything is compared. Larger
    ones are solved in their task. A bucket above ``bucket_limit`` is dealt out
    again by masks over the bits that its first mask left free; after that at
    most about a quarter of the 64 bits can differ inside a bucket, which bounds
    it whatever the input.
    """
    top = covering_masks(radius, list(range(64)))
    keys = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(top)))
    keyed = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key")
    sizes = cut(keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))

    def links(rows: DataFrame, *by: str) -> DataFrame:
        ordered = rows.withColumn("bucket", F.xxhash64(*by)).select("bucket", "fp")
        # Two buckets of one hash are compared together, which can only add true links.
        return _bucket_links(ordered.repartition("bucket").sortWithinPartitions("bucket"), radius)

    found = links(keyed.join(sizes.where(F.col("n") <= bucket_limit), ["t", "key"]), "t", "key")
    if sizes.where(F.col("n") > bucket_limit).limit(1).count():
        deeper = [[m | s for s in covering_masks(radius, [b for b in range(64) if not m >> b & 1])] for m in top]
        table = F.array(*(F.array(*(F.lit(_signed(x)) for x in row)) for row in deeper))
        hot = keyed.join(sizes.where(F.col("n") > bucket_limit).select("t", "key"), ["t", "key"])
        hot = hot.select("fp", "t", "key", F.posexplode(F.element_at(table, F.col("t") + 1)).alias("v", "mask"))
        hot = hot.withColumn("sub", F.col("fp").bitwiseAND(F.col("mask")))
        found = found.unionByName(links(hot, "t", "key", "v", "sub"))
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id reachable over links).

    Documents of one fingerprint are one node, so a group of copies costs one
    comparison whatever its size. Null and empty texts have fingerprint zero and
    link like any other; repeated rows of a doc_id keep their rows; a null id is
    kept and never names a component while another id is there. An empty table
    gives an empty result. Other columns are ignored.
    """
    marked = cut(fingerprints(docs, id_col, text_col, shingle))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = connected_components(fingerprint_links(nodes.select("fp"), radius, bucket_limit))
    rooted = nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    rooted = cut(rooted.select("fp", "root", "least"))
    names = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = cut(rooted.select("fp", "root").join(names, "root").select("fp", "component_id"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")
