"""Connected components over an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotloom.session import ROWS_A_TASK, cut


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, few: int = ROWS_A_TASK) -> DataFrame:
    """Label every node of ``edges`` with the smallest node of its component.

    Large-star and small-star steps rewrite the edges until each node points at
    its root; a path of n nodes takes about log n rounds. Neighbour minima are
    partial aggregates and are written before they are joined, so that the joins
    stay plain shuffles that AQE may split when a hub holds most of the edges. Up to
    ``few`` edges need no shuffle: a round's tasks would be many and nearly empty.

    Edges are undirected; loops, repeats and nulls are ignored. No edges gives
    no rows. Returns (node, component) for the nodes that have an edge to
    another node.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
    e = cut(e.where("u is not null and v is not null and u <> v").distinct())
    seen = _fingerprint(e)
    dealt = (lambda rows: rows.coalesce(1)) if seen[0] <= few else (lambda rows: rows)
    held = F.broadcast if seen[0] <= few else dealt
    e = dealt(e)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        both = e.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = dealt(cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))))
        large = both.join(held(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = dealt(cut(large.distinct()))
        least = dealt(cut(large.groupBy("u").agg(F.min("v").alias("m"))))
        small = large.join(held(least), "u")
        e = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = dealt(cut(dealt(e.unionByName(least.select("u", F.col("m").alias("v")))).distinct()))
        now = _fingerprint(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
