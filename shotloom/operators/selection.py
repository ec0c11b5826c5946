"""Ranking of candidates for a request. An extension: the ranker is our own design."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from shotloom.session import broadcast_if_small, written

#: Facet words that go to the tasks at most; beyond, facets and candidates meet by a shuffle join.
FACET_WORDS = 200_000


def rank_candidates(facets: DataFrame, candidates: DataFrame, most: int = 12, facet_id: str = "facet_id", facet_text: str = "facet_text", candidate_id: str = "candidate_id", text: str = "search_text", facet_words: int = FACET_WORDS) -> DataFrame:
    """For each facet the ``most`` candidates that share the heaviest words with it.

    A shared word weighs log(1 + candidates / candidates with it). Returns facet,
    candidate, n_shared, score (4 places) and rank; ties go to more shared words,
    then the smaller id. Up to ``facet_words`` words of facets go to every task:
    each candidate is scored where it is read, and a task hands on the best
    ``most`` of each facet only. Rows that repeat a candidate add up.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: F.length(x) > 3))
    asked = written(facets.select(facet_id, F.explode(words(F.col(facet_text))).alias("word")), "asked")
    held = lambda rows: rows.select(candidate_id, F.explode(words(F.col(text))).alias("word"))
    total = candidates.count()
    distinct = broadcast_if_small(written(asked.select("word").distinct(), "words"), facet_words)
    counts = held(candidates).join(distinct, "word", "left_semi").groupBy("word").count()
    weight = counts.select("word", F.log(1 + F.lit(total) / F.col("count")).alias("weight"))
    wanted = written(asked.join(weight, "word").select(facet_id, "word", "weight"), "weights")
    order = Window.partitionBy(facet_id).orderBy(F.desc("score"), F.desc("n_shared"), candidate_id)

    def joined(rows: DataFrame) -> DataFrame:
        pairs = broadcast_if_small(wanted, facet_words).join(held(rows), "word")
        return pairs.groupBy(facet_id, candidate_id).agg(F.count(F.lit(1)).alias("n_shared"), F.round(F.sum("weight"), 4).alias("score"))

    if wanted.limit(facet_words + 1).count() > facet_words:
        found = joined(candidates)
    else:
        again = written(candidates.groupBy(F.col(candidate_id).alias("again")).count().where("count > 1").select("again"), "again")
        same = F.col(candidate_id).eqNullSafe(F.col("again"))
        found = _best_of_tasks(candidates.join(again, same, "left_anti").select(candidate_id, words(F.col(text)).alias("words")), wanted, most, facet_id, candidate_id)
        found = found.unionByName(joined(candidates.join(again, same, "left_semi")))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _best_of_tasks(rows: DataFrame, wanted: DataFrame, most: int, facet_id: str, candidate_id: str) -> DataFrame:
    """The best candidates of each facet in each task. ``rows``: candidate_id, words; one row a candidate."""
    listed = wanted.orderBy("word", facet_id).collect()
    number: dict[object, int] = {}
    lists: dict[str, tuple[list[int], list[float]]] = {}
    for r in listed:
        own = lists.setdefault(r["word"], ([], []))
        own[0].append(number.setdefault(r[facet_id], len(number)))
        own[1].append(r["weight"])
    facet_kind = to_arrow_type(wanted.schema[facet_id].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {word: k for k, word in enumerate(lists)}
        sizes = np.array([len(own[0]) for own in lists.values()], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        facet_of = np.array([f for own in lists.values() for f in own[0]], dtype=np.int64)
        weight_of = np.array([w for own in lists.values() for w in own[1]])
        facet, score, n, ids = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), None
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                met = [sorted(place[w] for w in words if w in place) for words in part.column(1).to_pylist()]
                word = np.array([w for found in met for w in found], dtype=np.int64)
                owner = np.repeat(np.repeat(np.arange(len(met)), [len(x) for x in met]), sizes[word])
                ends = np.cumsum(sizes[word])
                at = np.arange(len(owner)) + np.repeat(starts[word] - ends + sizes[word], sizes[word])
                keys, which = np.unique(facet_of[at] * 256 + owner, return_inverse=True)
                sums = np.floor(np.bincount(which, weight_of[at], len(keys)) * 1e4 + 0.5) / 1e4
                own = part.column(0).take(pa.array(keys % 256))
                ids = own if ids is None else pa.concat_arrays([ids, own])
                facet, score, n = np.r_[facet, keys // 256], np.r_[score, sums], np.r_[n, np.bincount(which, minlength=len(keys))]
                ranks = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="first").to_numpy()
                best = np.lexsort((ranks, -n, -score, facet))
                first = np.r_[True, facet[best][1:] != facet[best][:-1]] if len(best) else np.empty(0, bool)
                nth = np.arange(len(best)) - np.maximum.accumulate(np.where(first, np.arange(len(best)), 0))
                best = best[nth < most]
                facet, score, n, ids = facet[best], score[best], n[best], ids.take(pa.array(best))
        if ids is not None:
            yield pa.RecordBatch.from_arrays([pa.array(list(number), facet_kind).take(pa.array(facet)), ids, pa.array(n.astype(np.int64)), pa.array(score)], [facet_id, candidate_id, "n_shared", "score"])

    kinds = f"{facet_id} {dict(wanted.dtypes)[facet_id]}, {candidate_id} {dict(rows.dtypes)[candidate_id]}, n_shared long, score double"
    return rows.mapInArrow(run, kinds)
