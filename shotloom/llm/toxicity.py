"""Toxicity by multiple-instance learning: documents are labelled, sentences are found.

A sentence is toxic with probability s = sigmoid(b + sum of the weights of its
words and of their beginnings); a document is toxic unless all of its sentences are clean and an unseen
cause (the leak) stays away: p = 1 - (1 - leak) * product of (1 - s). Weights,
bias and leak are fitted to document labels only, by gradient ascent on a bounded
sample of labelled rows; the sentences to blame follow from the same model.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotloom.llm.memory import map_batches
from shotloom.session import written

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+").findall
#: Labelled documents that the fit reads at most; the ones of the smallest id hashes.
MAX_TRAIN = 8_000
#: Words and word beginnings that get a weight at most; those whose presence depends on the label most.
MAX_WORDS = 2_000
#: Lengths of the beginnings that count, in words longer than them.
PREFIXES = (4, 5, 6, 7, 8)
Counts = dict[str, list[int]]


def features(word: str) -> list[str]:
    return [word, *(word[:k] + "+" for k in PREFIXES if len(word) > k)]


@dataclass
class NoisyOr:
    """A fitted model: weights by word or beginning, sentence bias and leak."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -12.0
    leak: float = 0.0
    known: dict[str, float | None] = field(default_factory=dict, repr=False)

    def weight(self, word: str) -> float | None:
        """Sum of the weights that a word has; None if it has none."""
        if word not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            found = [self.weights[f] for f in features(word) if f in self.weights]
            self.known[word] = sum(found) if found else None
        return self.known[word]

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Probability that a text is toxic, and (begin, end, probability) of the sentences with a weighted word."""
        text, marked, plain = text or "", [], 0
        get, weight, missing = self.known.get, self.weight, object()
        for m in _SENTENCE.finditer(text):
            found = []
            for word in _WORD(m[0].lower()):
                w = get(word, missing)
                if w is missing:
                    w = weight(word)
                if w is not None:
                    found.append(w)
            if found:
                marked.append((m.start(), m.end(), 1 / (1 + math.exp(min(60.0, -self.bias - sum(found))))))
            else:
                plain += not m[0].isspace()
        clean = math.log1p(-self.leak) - plain * math.log1p(math.exp(self.bias))
        clean += sum(math.log(max(1e-300, 1 - s)) for _, _, s in marked)
        return min(1.0, max(0.0, -math.expm1(clean))), marked


def count_features(texts: Iterable[str], labels: Iterable[int], most: int = 200_000) -> Iterator[Counts]:
    """Documents with each feature and toxic documents with it; several counters if there are more than ``most`` features."""
    counts: Counts = {}
    for text, label in zip(texts, labels, strict=True):
        for f in {f for word in set(_WORD(text.lower())) for f in features(word)}:
            pair = counts.setdefault(f, [0, 0])
            pair[0] += 1
            pair[1] += label
        if len(counts) > most:
            yield counts
            counts = {}
    yield counts


def shrink(text: str, chosen: dict[str, int], own: dict[str, list[int]]) -> tuple[int, list[int], list[int]]:
    """Sentences without a chosen feature, and (sentence, feature) of the others. ``own`` remembers words."""
    plain, sent, feat, n_sent = 0, [], [], 0
    for m in _SENTENCE.finditer(text.lower()):
        found: list[int] = []
        for word in _WORD(m[0]):
            if word not in own:
                if len(own) > 200_000:
                    own.clear()
                own[word] = [chosen[f] for f in features(word) if f in chosen]
            found += own[word]
        if found:
            sent += [n_sent] * len(found)
            feat += found
            n_sent += 1
        else:
            plain += not m[0].isspace()
    return plain, sent, feat


def fit(names: list[str], toxic: np.ndarray, plain: np.ndarray, doc: np.ndarray, sent: np.ndarray, feat: np.ndarray, rounds: int = 400, rate: float = 0.1, decay: float = 1e-3) -> NoisyOr:
    """Maximum likelihood of the noisy-or model by Adam.

    ``toxic`` and ``plain`` (sentences without a feature) by document; ``doc``: the
    document of each other sentence; ``sent`` and ``feat``: the sentence and the
    place in ``names`` of each feature in it.
    """
    n_sent, k = len(doc), len(names)
    theta = np.concatenate([np.zeros(k), [-8.0, math.log(0.02)]])  # weights, bias, logit of the leak
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        z = np.bincount(sent, theta[feat], n_sent) + theta[k]
        s, s0, leak = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-theta[k])), 1 / (1 + np.exp(-theta[k + 1]))
        clean = np.log1p(-leak) - np.bincount(doc, np.logaddexp(0, z), len(toxic)) - plain * np.logaddexp(0, theta[k])
        p = np.clip(-np.expm1(clean), 1e-9, 1 - 1e-12)
        pull = np.where(toxic > 0, (1 - p) / p, -1.0)  # derivative of the likelihood by -log(1 - p)
        by_z = pull[doc] * s
        grad = np.concatenate([np.bincount(feat, by_z[sent], k), [by_z.sum() + (pull * plain).sum() * s0, pull.sum() * leak]]) / len(toxic)
        grad[:k] -= decay * theta[:k] / len(toxic) ** 0.5
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-10)
        theta[k] = min(theta[k], -4.0)
    return NoisyOr({f: float(theta[i]) for i, f in enumerate(names)}, float(theta[k]), float(1 / (1 + math.exp(-theta[k + 1]))))


def held_out(id_col: str, parts: int = 5) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo ``parts``, is zero. A null id is."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == 0, F.lit(True))


def _choose(sample: DataFrame, n: int, rate: float, max_words: int, least: int = 5, z_least: float = 4.0) -> list[str]:
    """The features whose share of toxic documents differs most from the rest, by z score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for counts in count_features(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen, ones = zip(*counts.values(), strict=True) if counts else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(seen, pa.int64()), pa.array(ones, pa.int64())], ["feature", "seen", "ones"])

    counts = map_batches(sample.select("text", "label"), run, "feature string, seen long, ones long").groupBy("feature").agg(F.sum("seen").alias("seen"), F.sum("ones").alias("ones"))
    spread = F.sqrt(F.col("seen") * rate * (1 - rate) * F.greatest(F.lit(1e-9), 1 - F.col("seen") / n) + 1e-9)
    z = (F.abs(F.col("ones") - F.col("seen") * rate) / spread).alias("z")
    best = counts.where(F.col("seen") >= least).select("feature", z).where(F.col("z") >= z_least)
    return [r.feature for r in best.orderBy(F.desc("z"), "feature").limit(max_words).collect()]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN, max_words: int = MAX_WORDS) -> NoisyOr:
    """Fit to at most ``max_train`` labelled documents outside the held-out part.

    Several labels of one document count as their majority (toxic on a tie);
    null labels count nothing. Rows that repeat a document's text count once, and
    the bound holds for rows. Texts stay in the tasks that read them: only their
    numbered features meet in the one task of the fit, and only weights go to the
    driver. One kind of label alone gives a model without words.
    """
    known = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("key")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    marked = F.broadcast(written(known.orderBy(F.xxhash64("key"), "key").limit(max_train), "labels"))
    rows = docs.select(F.col(id_col).alias("key"), F.coalesce(text_col, F.lit("")).alias("text")).join(marked, "key").withColumn("hash", F.xxhash64("text"))
    picked = rows.select("key", "hash").distinct().orderBy(F.xxhash64("key"), "key", "hash").limit(max_train)
    sample = written(rows.join(F.broadcast(written(picked, "sample")), ["key", "hash"]).dropDuplicates(["key", "hash"]), "sample")
    n, rate = sample.agg(F.count(F.lit(1)), F.avg("label")).first()
    if not n or rate in (0.0, 1.0):
        return NoisyOr(leak=rate * 0.98 + 0.01 if n else 0.0)
    names = _choose(sample, n, rate, max_words)
    chosen = {f: k for k, f in enumerate(names)}

    def shrunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, list[int]] = {}
        for batch in batches:
            plain, sent, feat = zip(*(shrink(x.as_py(), chosen, own) for x in batch.column(0)), strict=True) if batch.num_rows else ((), (), ())
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(plain, pa.int64()), pa.array(sent, ints), pa.array(feat, ints)], ["place", "hash", "label", "plain", "sent", "feat"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, plain, doc, sent, feat = [], [], [], [], []
        n_doc = n_sent = 0
        for batch in batches:
            toxic.append(batch.column(2).to_numpy())
            plain.append(batch.column(3).to_numpy())
            for own_sent, own_feat in zip(batch.column(4), batch.column(5), strict=True):
                s = own_sent.values.to_numpy().astype(np.int64)
                sent.append(s + n_sent)
                feat.append(own_feat.values.to_numpy().astype(np.int64))
                count = int(s[-1]) + 1 if len(s) else 0
                doc.append(np.full(count, n_doc, dtype=np.int64))
                n_doc, n_sent = n_doc + 1, n_sent + count
        model = fit(names, *(np.concatenate(x) for x in ([x.astype(float) for x in toxic], plain, doc, sent, feat)))
        values = [*(model.weights[f] for f in names), model.bias, model.leak]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values, pa.float64())], ["n", "value"])

    small = map_batches(sample.select("text", F.xxhash64("key").alias("place"), "hash", "label"), shrunk, "place long, hash long, label int, plain long, sent array<int>, feat array<int>")
    found = map_batches(small.repartition(1).sortWithinPartitions("place", "hash"), fitted, "n int, value double").collect()
    *weights, bias, leak = (r.value for r in sorted(found))
    return NoisyOr(dict(zip(names, weights, strict=True)), bias, leak)


def score(docs: DataFrame, model: NoisyOr, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted, n_marked, sentences) of every row, from the text alone.

    sentences: begin, end (code points) and score of the sentences whose own
    probability reaches ``threshold``, and of the likeliest one in a text that is
    predicted toxic. Null and empty texts have the score of the leak.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            scores, spans = [], []
            for x in batch.column(1):
                p, marked = model.score(x.as_py())
                best = max((s for _, _, s in marked), default=2.0)
                spans.append([{"begin": a, "end": b, "score": s} for a, b, s in marked if s >= threshold or (p >= threshold and s == best)])
                scores.append(p)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(p >= threshold) for p in scores], pa.int32()), pa.array([len(x) for x in spans], pa.int64()), pa.array(spans, kind)], ["doc_id", "score", "predicted", "n_marked", "sentences"])

    schema = "doc_id long, score double, predicted int, n_marked long, sentences array<struct<begin: long, end: long, score: double>>"
    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, schema)
