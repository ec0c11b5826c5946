"""Groups of similar texts: SimHash neighbours, verified, and the similar texts that lie further apart.

Texts of one set of word shingles are one node. Nodes whose SimHashes differ in
at most RADIUS bits meet under the covering masks of ``simhash``; a pair links if
the Jaccard similarity of its sets reaches the bound. That finds the close copies
and settles large groups early, but a similarity of 0.8 leaves two SimHashes 9.7
of 64 bits apart on average (a bit differs with probability acos(2s / (1 + s)) / pi
= 0.15), so that under one pair in a hundred at the bound lies within three bits.
What the masks leave apart therefore meets in bands of MinHash values too: a pair
of similarity s is missed by all bands with probability (1 - s**rows)**bands, which for
40 bands of 7 rows is 8e-5 at s = 0.8 and 2e-6 at 0.85; other bounds have bands of
their own, so that a pair at the bound is missed no more often.

A band in which many texts of several groups are left (a template that pages share) is
not joined with itself. Its texts meet by prefixes instead: with shingles in the order
of how few of these texts have them, two texts of similarity s share one among the
first n - ceil(s n) + 1 of each, and what is left behind the first shared one bounds
what they have in common. What only the template has in common stands last, and no
pair meets there. That is exact.

Most pairs below the bound are told apart before their sets are read. A set flips one
of its parity bits for each shingle, so that two sets differ in at least as many
shingles as their parities in bits; at s sets of a and b shingles differ in at most
(a + b) (1 - s) / (1 + s) of them. That misses nothing at any size, as a set has about
as many bits as shingles. Every candidate is verified.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import repeat
from math import ceil, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from shotloom.llm.simhash import fingerprint_links, majority
from shotloom.llm.memory import map_batches
from shotloom.llm.text import words_lower
from shotloom.operators.graph import connected_components
from shotloom.session import broadcast_if_small, cut, written

#: Bits in which the SimHashes of first candidates may differ.
RADIUS = 3
#: Bands of MinHash values at a bound of 0.8 and above, and values of each.
BANDS, BAND_ROWS = 40, 7
#: How often a pair at the bound may be missed by all bands.
MOST_MISSED = 1e-4
#: Bits of the parities of a small set; a larger one has the next power of two above its size.
PARITY_BITS = 512
#: Texts of a band, of several groups, above which they meet by prefixes.
HOT_BAND = 128
#: Ids that are broadcast at most, to pick texts before they are shuffled.
IDS_AT_ONCE = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def band_shape(least: float) -> tuple[int, int]:
    """Number of bands, and of values in each, for pairs of a similarity of ``least`` or more."""
    if not 0 < least <= 1:
        raise ValueError("a similarity lies above 0 and is at most 1")
    rows = BAND_ROWS if least >= 0.8 else max(1, int(BAND_ROWS * log(0.8) / log(least)))
    return (BANDS if least >= 0.8 else max(BANDS, ceil(log(MOST_MISSED) / log1p(-(least**rows))))), rows


@cache
def _coefficients(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of the hash functions, the same in every process."""
    rng = np.random.default_rng(20240301)
    factors = rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return factors, rng.integers(0, 1 << 63, count, dtype=np.uint64)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of ``width`` words; a shorter text is one run, no words are none."""
    words = words_lower(text)
    parts = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)] if words else []
    return np.unique(np.fromiter(map(xxh64_intdigest, parts, repeat(7)), dtype=np.uint64))


def set_key(found: np.ndarray) -> int:
    """One number for a set of shingles; zero for the empty one."""
    return xxh64_intdigest(found.tobytes(), 11) if len(found) else 0


def bands(found: np.ndarray, shape: tuple[int, int] = (BANDS, BAND_ROWS)) -> np.ndarray:
    """Keys of the bands of MinHash values; none for an empty set."""
    if not len(found):
        return np.empty(0, dtype=np.uint64)
    n_bands, n_rows = shape
    factors, offsets = _coefficients(n_bands * n_rows)
    least = np.full(n_bands * n_rows, np.iinfo(np.uint64).max)
    for low in range(0, len(found), 256):
        least = np.minimum(least, (np.multiply.outer(found[low : low + 256], factors) + offsets).min(axis=0))
    keys = np.arange(n_bands, dtype=np.uint64) * _MIX
    for row in least.reshape(n_bands, n_rows).T:
        keys = (keys ^ row) * _MIX
        keys ^= keys >> np.uint64(29)
    return keys


def parities(found: np.ndarray, bits: int = PARITY_BITS) -> np.ndarray:
    """Bit k: whether an odd number of the set's hashes leaves k when divided by ``bits``, a power of two."""
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def wide_bits(size: int) -> int:
    """Parity bits of a set of so many shingles."""
    return max(PARITY_BITS, 1 << (size - 1).bit_length() if size else 0)


#: In how many bits two parities differ, the longer one folded to the length of the shorter.
_WIDE_FLIPS = """aggregate(sequence(0, least(size(wide), size(other_wide)) - 1), 0, (s, i) -> s + bit_count(
  aggregate(sequence(0, size(wide) div least(size(wide), size(other_wide)) - 1), 0L, (x, k) -> x ^ wide[i + cast(k as int) * least(size(wide), size(other_wide))]) ^
  aggregate(sequence(0, size(other_wide) div least(size(wide), size(other_wide)) - 1), 0L, (x, k) -> x ^ other_wide[i + cast(k as int) * least(size(wide), size(other_wide))])))"""


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _sets(docs: DataFrame, width: int, shape: tuple[int, int] | None) -> DataFrame:
    """(doc_id, node, n, fp, bands, parity, wide) of every row, or without a shape (doc_id, node, shingles); wide is null for small sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        of_longs = lambda rows: pa.array([None if x is None else x.view(np.int64) for x in rows], longs)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                found = [shingles(x.as_py(), width) for x in batch.column(1).slice(low, 256)]
                ids, nodes = batch.column(0).slice(low, 256), pa.array([_signed(set_key(x)) for x in found], pa.int64())
                if shape is None:
                    yield pa.RecordBatch.from_arrays([ids, nodes, of_longs(found)], ["doc_id", "node", "shingles"])
                else:
                    wide = [parities(x, wide_bits(len(x))) if len(x) > PARITY_BITS else None for x in found]
                    arrays = [of_longs(bands(x, shape) for x in found), of_longs(map(parities, found)), of_longs(wide)]
                    yield pa.RecordBatch.from_arrays([ids, nodes, pa.array([len(x) for x in found], pa.int64()), pa.array([majority(x) for x in found], pa.int64()), *arrays], ["doc_id", "node", "n", "fp", "bands", "parity", "wide"])

    return map_batches(docs, run, "doc_id long, node long, shingles array<long>" if shape is None else "doc_id long, node long, n long, fp long, bands array<long>, parity array<long>, wide array<long>")


def _whole_sets(texts: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the nodes of ``asked`` (node, least), made again from the text of each node's least document."""
    ids = broadcast_if_small(written(asked.select(F.col("least").alias("key")).distinct(), "ids"), IDS_AT_ONCE)
    picked = _sets(texts.join(ids, F.col("doc_id").eqNullSafe(F.col("key")), "left_semi"), width, None)
    # A document with several texts has other sets as well.
    return written(picked.join(asked.select("node"), "node", "left_semi").dropDuplicates(["node"]).select("node", "shingles"), "sets")


def _verified(texts: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (src, dst) of nodes whose sets reach the similarity."""
    asked = written(pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(nodes.select("node", "least"), "node"), "asked")
    sets = _whole_sets(texts, asked, width)
    side = lambda name: sets.select(F.col("node").alias(name), F.col("shingles").alias(f"{name}_set"))
    both = pairs.join(side("src"), "src").join(side("dst"), "dst")
    shared = F.size(F.array_intersect("src_set", "dst_set"))
    return both.where(shared >= least * (F.size("src_set") + F.size("dst_set") - shared) - 1e-9).select("src", "dst")


def _prefixes(texts: DataFrame, asked: DataFrame, width: int, least: float) -> DataFrame:
    """(node, shingle, pos) of the shingles by which the nodes of ``asked`` can meet, the ones that the fewest of them have first.

    A shingle that one node alone has takes its place, but no row, as nothing meets there.
    """
    each = written(_whole_sets(texts, asked, width).select("node", F.explode("shingles").alias("shingle")), "shingles")
    held = written(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")), "held")
    ordered = each.join(held, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("s"))
    first = F.slice("s", F.lit(1), (F.size("s") - F.ceil(least * F.size("s") - 1e-9) + 1).cast("int"))
    return ordered.select("node", F.posexplode(first).alias("pos", "s")).where("s.n > 1").select("node", "s.shingle", "pos")


def _components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    parts = connected_components(links)
    return written(nodes.join(parts, "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component"), "nodes")


def _apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The members, with their root, of the bands in which several groups are left, and how many each band has."""
    rooted = written(members.join(roots.select("node", "root"), "node"), "members")
    split = rooted.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("m")).where("a <> b").select("band", "m")
    return written(rooted.join(split, "band"), "apart")


def _neighbours(nodes: DataFrame, ends: Callable, near: Callable) -> DataFrame:
    """Pairs (src, dst) that join the nodes whose SimHashes lie within RADIUS bits, as far as sizes allow."""
    leads = cut(nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("lead")))
    same = nodes.join(leads, "fp").where(F.col("node") != F.col("lead.node"))
    same = same.where(near(F.col("n"), F.col("lead.n"))).select(*ends(F.col("node"), F.col("lead.node")))
    side = lambda name: leads.select(F.col("fp").alias(name), F.col("lead").alias(f"{name}_lead"))
    close = fingerprint_links(leads.select("fp"), RADIUS).join(side("src"), "src").join(side("dst"), "dst")
    close = close.where(near(F.col("src_lead.n"), F.col("dst_lead.n"))).select(*ends(F.col("src_lead.node"), F.col("dst_lead.node")))
    return same.unionByName(close)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, hot_band: int = HOT_BAND) -> DataFrame:
    """One row per document: doc_id, node and component_id (the smallest doc_id reachable over links).

    Two documents link if the Jaccard similarity of their sets of ``width``-word
    shingles is at least ``least``. Texts without words are one group. A null id is
    kept and never names a component while another id is there.

    Neighbours by SimHash, and each band's members with its smallest member, are held
    against each other first, which joins large groups by few comparisons; then all
    pairs of a band that are not yet in one group, and that parities leave possible,
    are, or, where over ``hot_band`` members are left in a band, all pairs that meet by
    prefixes. Repeated rows keep their rows; an empty table gives none; other columns
    are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marked = written(_sets(texts, width, band_shape(least)), "marked")
    nodes = written(marked.groupBy("node").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("n", "fp", "bands", "parity", "wide"))), "nodes")
    near = lambda a, b: F.least(a, b) >= least * F.greatest(a, b) - 1e-9
    ends = lambda a, b: (F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"))
    keyed = nodes.select("node", "n", F.explode("bands").alias("band"))
    full = written(keyed.groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("node", "n")).alias("lead")).where("m > 1"), "buckets")
    members = written(keyed.join(full.select("band", "lead"), "band"), "members")
    first = members.where((F.col("node") != F.col("lead.node")) & near(F.col("n"), F.col("lead.n"))).select(*ends(F.col("node"), F.col("lead.node")))
    first = written(first.unionByName(_neighbours(nodes.select("node", "n", "fp"), ends, near)).distinct(), "pairs")
    links = written(_verified(texts, nodes, first, width, least), "links")
    roots = _components(nodes.select("node", "least"), links)
    members = _apart(members, roots).select("band", "node", "n", "root", "m")

    narrow = [f"p{k}" for k in range(PARITY_BITS // 64)]
    small, large = F.col("n") <= PARITY_BITS / least, F.col("n") > PARITY_BITS
    parts = [F.when(small, F.col("parity")[k]).alias(c) for k, c in enumerate(narrow)]
    apart = (F.col("n") + F.col("other_n")) * ((1 - least) / (1 + least)) + 1e-6
    flipped = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"other_{c}"))) for c in narrow), F.lit(0))

    def met(rows: DataFrame, key: str, columns: list[str], possible: Column) -> DataFrame:
        held = ("node", "n", "root", *columns)
        other = rows.select(key, *(F.col(c).alias(f"other_{c}") for c in held))
        both = rows.select(key, *held).join(other, key)
        return both.where((F.col("root") < F.col("other_root")) & near(F.col("n"), F.col("other_n")) & possible).select("node", "other_node")

    def possible_pairs(rows: DataFrame, key: str, columns: list[str], also: Column) -> DataFrame:
        """Pairs of different groups that meet in a key: by the narrow parities if one set is small, else by the wide ones."""
        rows = written(rows.join(nodes.select("node", *parts, "wide"), "node"), "members")
        two_large = F.least("n", "other_n") > PARITY_BITS
        pairs = met(rows.where(small), key, [*columns, *narrow], also & ~two_large & (flipped <= apart))
        return pairs.unionByName(met(rows.where(large), key, [*columns, "wide"], also & two_large & (F.expr(_WIDE_FLIPS) <= apart)))

    pairs = possible_pairs(members.where(F.col("m") <= hot_band).drop("m"), "band", [], F.lit(True))
    hot = written(members.where(F.col("m") > hot_band).select("node", "n", "root").distinct().join(nodes.select("node", "least"), "node"), "hot")
    if not hot.isEmpty():
        rows = _prefixes(texts, hot.select("node", "least"), width, least).join(hot.select("node", "n", "root"), "node")
        # At the first shingle that two sets share, all that they share stands there or behind.
        behind = F.least(F.col("n") - F.col("pos"), F.col("other_n") - F.col("other_pos"))
        pairs = pairs.unionByName(possible_pairs(rows, "shingle", ["pos"], behind >= (F.col("n") + F.col("other_n")) * (least / (1 + least)) - 1e-6))
    rest = pairs.select(*ends(F.col("node"), F.col("other_node"))).distinct().join(first, ["src", "dst"], "left_anti")
    links = links.unionByName(written(_verified(texts, nodes, written(rest, "pairs"), width, least), "links"))
    roots = _components(nodes.select("node", "least"), links)
    names = written(roots.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    named = written(roots.join(names, "root").select("node", "component_id"), "named")
    return marked.join(named, "node").select("doc_id", "node", "component_id")
