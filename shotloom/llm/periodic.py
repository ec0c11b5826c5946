"""Periodic runs of words by longest common extensions in suffix trees.

Ukkonen's algorithm builds the suffix trees of a document and of its reversal; an
Euler tour of each with range minima answers longest common extensions as string
depths of lowest common ancestors. The longest Lyndon word at each place, under an
order of the words and under its inverse, is the only root that a run can have there;
extending it both ways gives the run (Bannai et al., the runs theorem).

Only words that a run can cover enter the trees. A run of at least four periods and
six words holds each of its three-word windows three times or more, so words outside
of such windows are replaced by gap symbols of their own, again and again until
nothing changes. That is exact: a run keeps all its words, and no run crosses a gap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotloom.llm.memory import map_batches

#: A run has at least this many words and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4


class SuffixTree:
    """The suffix tree of ``symbols`` (1 and above) and an end symbol 0, by Ukkonen's algorithm.

    ``order`` and ``inverse`` list the suffixes under the order of symbols and its
    inverse (a prefix comes first in both).
    """

    def __init__(self, symbols: list[int]) -> None:
        self.text = [*symbols, 0]
        self.wide = max(symbols, default=0) + 1
        self._build()
        self._tour()

    def _build(self) -> None:
        text, wide, n = self.text, self.wide, len(self.text)
        edges: dict[int, int] = {}
        get = edges.get
        start, stop, link = [0], [0], [0]
        node = edge = length = left = 0
        for i, symbol in enumerate(text):
            left += 1
            last = 0
            while left:
                if not length:
                    edge = i
                key = node * wide + text[edge]
                child = get(key)
                if child is None:
                    edges[key] = len(start)
                    start.append(i)
                    stop.append(n)
                    link.append(0)
                    if last:
                        link[last] = node
                        last = 0
                else:
                    begin = start[child]
                    span = (stop[child] if stop[child] <= i else i + 1) - begin
                    if length >= span:
                        edge += span
                        length -= span
                        node = child
                        continue
                    if text[begin + length] == symbol:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    middle = len(start)
                    edges[key] = middle
                    start += (begin, i)
                    stop += (begin + length, n)
                    link += (0, 0)
                    start[child] = begin + length
                    edges[middle * wide + text[begin + length]] = child
                    edges[middle * wide + symbol] = middle + 1
                    if last:
                        link[last] = middle
                    last = middle
                left -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - left + 1
        self.span = [b - a for a, b in zip(start, stop, strict=True)]
        keys, children = np.fromiter(edges, np.int64, len(edges)), np.fromiter(edges.values(), np.int64, len(edges))
        parents, symbols = np.divmod(keys, wide)
        self.first_child = np.searchsorted(np.sort(parents), np.arange(len(start) + 1)).tolist()
        self.children = children[np.lexsort((symbols, parents))].tolist()
        self.inverted = children[np.lexsort((np.where(symbols == 0, 0, wide - symbols), parents))].tolist()

    def _tour(self) -> None:
        """Euler tour of string depths; the place of each suffix in it, and the suffixes in order."""
        n, span, first, children = len(self.text), self.span, self.first_child, self.children
        depth, tour, at, order = [0] * len(span), [], [0] * n, []
        stack = [0]
        while stack:
            node = stack.pop()
            if node < 0:
                tour.append(~node)
                continue
            here = depth[node]
            low, high = first[node], first[node + 1]
            if low == high:
                order.append(n - here)
                at[n - here] = len(tour)
                tour.append(here)
                continue
            tour.append(here)
            for child in reversed(children[low:high]):
                depth[child] = here + span[child]
                stack += (~here, child)
        self.at, self.depths, self.order = np.array(at), np.array(tour, dtype=np.int64), order
        inverse, stack, children = [], [0], self.inverted
        while stack:
            node = stack.pop()
            low, high = first[node], first[node + 1]
            if low == high:
                inverse.append(n - depth[node])
            else:
                stack += children[low:high][::-1]
        self.inverse = inverse

    def extensions(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Longest common extensions of pairs of different suffixes, all at once.

        Each is the least depth between two places of the tour: two overlapping ranges
        of a power of two. The table of range minima is kept one level at a time.
        """
        low, high = np.minimum(self.at[left], self.at[right]), np.maximum(self.at[left], self.at[right])
        level = np.frexp(high - low + 1)[1] - 1
        out, minima = np.zeros(len(low), dtype=np.int64), self.depths
        by_level = np.argsort(level, kind="stable")
        bounds = np.searchsorted(level[by_level], np.arange(level.max(initial=0) + 2))
        for k in range(level.max(initial=0) + 1):
            ask = by_level[bounds[k] : bounds[k + 1]]
            out[ask] = np.minimum(minima[low[ask]], minima[high[ask] - (1 << k) + 1])
            minima = np.minimum(minima[: -(1 << k)], minima[1 << k :])
        return out


def lyndon_ends(order: list[int]) -> np.ndarray:
    """Where the longest Lyndon word at each place ends: at the next smaller suffix."""
    n = len(order) - 1  # the end symbol is a suffix, too
    rank = [0] * (n + 1)
    for k, suffix in enumerate(order):
        rank[suffix] = k
    ends = [n] * (n + 1)
    for i in range(n - 1, -1, -1):
        j, own = i + 1, rank[i]
        while rank[j] > own:
            j = ends[j]
        ends[i] = j
    return np.array(ends[:n])


def runs_of(symbols: list[int], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> np.ndarray:
    """All runs (start, length, smallest period), sorted, of at least so many symbols and (two or more) periods."""
    n = len(symbols)
    if n < max(least_words, least_periods):
        return np.zeros((0, 3), dtype=np.int64)
    ahead, back = SuffixTree(symbols), SuffixTree(symbols[::-1])
    found = []
    for order in (ahead.order, ahead.inverse):
        begin, end = np.arange(n), lyndon_ends(order)
        before, after = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        inner = end < n
        after[inner] = ahead.extensions(begin[inner], end[inner])
        before[1:] = back.extensions(n - begin[1:], n - end[1:])
        period, start = end - begin, begin - before
        length = end + after - start
        kept = length >= np.maximum(least_words, least_periods * period)
        found.append(np.stack([start, length, period], axis=1)[kept])
    runs = np.concatenate(found)
    return np.unique(runs[np.lexsort((runs[:, 1], runs[:, 2], runs[:, 0]))], axis=0) if len(runs) else runs


def covered(ids: np.ndarray, least: int = 3) -> np.ndarray:
    """Which words lie in three-word windows found ``least`` times or more, of which at least four follow each other."""
    n, wide = len(ids), int(ids.max()) + 1
    pairs = np.unique(ids[:-1] * wide + ids[1:], return_inverse=True)[1]
    _, windows, counts = np.unique(pairs[:-1] * wide + ids[2:], return_inverse=True, return_counts=True)
    steps = np.diff(np.concatenate(([0], (counts >= least)[windows].astype(np.int8), [0])))
    out = np.zeros(n, dtype=bool)
    for low, high in zip(np.flatnonzero(steps == 1).tolist(), np.flatnonzero(steps == -1).tolist(), strict=True):
        if high - low >= LEAST_WORDS - 2:
            out[low : high + 2] = True
    return out


def reduced(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words that runs can cover, with a gap symbol of its own for each stretch between them, and their places."""
    places = np.arange(len(ids))
    while len(ids) >= LEAST_WORDS:
        kept = covered(ids)
        gap = ~kept
        gap[1:] &= kept[:-1]  # one symbol stands for a whole gap
        stays = kept | gap
        ids, places = np.where(gap, ids.max() + 1 + np.cumsum(gap), ids)[stays], places[stays]
        if stays.all():
            return ids, places
    return ids[:0], places[:0]


def find_runs(words: list[bytes]) -> np.ndarray:
    """All runs of ``words`` (start, length, period), sorted by start and period."""
    if len(words) < LEAST_WORDS:
        return np.zeros((0, 3), dtype=np.int64)
    number: dict[bytes, int] = {}
    ids, places = reduced(np.array([number.setdefault(word, len(number)) for word in words], dtype=np.int64))
    if not len(ids):
        return np.zeros((0, 3), dtype=np.int64)
    runs = runs_of((np.unique(ids, return_inverse=True)[1] + 1).tolist())
    runs[:, 0] = places[runs[:, 0]]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words, joined by spaces, without those that a run covers after its first period."""
    kept = bytearray(b"\1") * len(words)
    for start, length, period in runs.tolist():
        kept[start + period : start + length] = bytes(length - period)
    return b" ".join([word for word, stays in zip(words, kept, strict=True) if stays]) if len(runs) else b" ".join(words)


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of every text and the text without their repeats.

    Returns doc_id, n_words, runs (array of start, length, period; sorted by start and
    period) and collapsed. Words are divided by spaces and ASCII controls 9 to 13. A null,
    empty or blank text has no words, no runs and an empty result. Null doc_ids stay;
    repeated rows are answered each; an empty table gives none; other columns are left
    out. A text is worked on whole, in memory that grows with its words; nothing is shuffled.
    """
    triple = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                counts, found, texts = [], [], []
                for text in part.column(1).to_pylist():
                    words = text.split() if text else []
                    runs = find_runs(words)
                    counts.append(len(words))
                    found.append([{"start": a, "length": b, "period": c} for a, b, c in runs.tolist()])
                    texts.append(collapse(words, runs))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(found, triple), pa.array(texts, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    out = map_batches(given, run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))
