"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A mask selects some tokens of a window and ignores the others, so that a passage
with substituted words still shares hashes with the benchmark item it was taken
from. Hits give alignments (document, item, offset), which are made distinct as
plain numbers; each alignment is then compared token by token over the whole item.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotloom.session import broadcast_if_small, cut

#: Selected positions of each mask; the positions between them are ignored. Of a run
#: of 7 to 9 tokens with one substituted and of 10 to 13 with two, wherever they are,
#: some mask always finds a place that avoids the substitutions.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 4, 5), (0, 1, 3, 6, 7))
#: Masks that one length of runs may need before a plain block of tokens is taken instead.
MOST_MASKS = 8
#: Placements of substitutions up to which it is tried whether masks meet them all.
MOST_PLACEMENTS = 5_000
#: Tokens of all items up to which items are broadcast to the documents that were hit.
TOKENS_AT_ONCE = 2_000_000
#: Seeds that are broadcast at once; more items are taken in blocks of this many.
SEEDS_AT_ONCE = 500_000
#: Alignments that are broadcast at most; more meet their documents by a shuffle.
ALIGNMENTS_AT_ONCE = 500_000


def _tokens(text: str) -> Column:
    """Lower-cased runs of letters and digits."""
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+")
    return words


def meet_all(masks: tuple[tuple[int, ...], ...], run: int, changed: int) -> bool:
    """Whether of ``run`` tokens with ``changed`` substituted, wherever they are, some mask selects only others."""
    for places in combinations(range(run), changed):
        free = set(range(run)).difference(places)
        if not any(free.issuperset(p + o for o in mask) for mask in masks for p in range(run - mask[-1])):
            return False
    return True


def masks_for(run: int, share: float) -> tuple[tuple[int, ...], ...]:
    """Masks by which every run of ``run`` tokens, of which at least ``share`` are equal, has a hit.

    The standard masks where they meet all placements of the substitutions; else all
    choices of the equal tokens, if they are few; else a plain block, which is free of
    substitutions somewhere as there are fewer of these than of such blocks.
    """
    changed = run - max(1, ceil(run * share))
    if comb(run, changed) <= MOST_PLACEMENTS and meet_all(MASKS, run, changed):
        return MASKS
    if comb(run, changed) <= MOST_PLACEMENTS:
        chosen = sorted({tuple(p - kept[0] for p in kept) for kept in combinations(range(run), run - changed)})
        if len(chosen) <= MOST_MASKS:
            return tuple(chosen)
    return (tuple(range(run // (changed + 1))),)


def _seeds(rows: DataFrame, masks: dict[tuple[int, ...], list[int]], run: Column | None = None) -> DataFrame:
    """A row for each position and mask that fits: the columns of ``rows`` with pos and seed.

    ``masks`` says which runs a mask is for; with ``run`` only those of a row's run are used.
    """
    n = F.size("tokens")
    at = rows.where(n >= min(m[-1] for m in masks) + 1).select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("pos"))
    meant = lambda runs: F.lit(True) if run is None else run.isin(runs)
    hashes = [F.when((F.col("pos") + m[-1] < n) & meant(runs), F.xxhash64(F.lit(",".join(map(str, m))), *(F.get("tokens", F.col("pos") + o) for o in m))) for m, runs in masks.items()]
    return at.select("*", F.explode(F.array(*hashes)).alias("seed")).where("seed is not null")


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", overlap: int = 13, share: float = 0.8, least_tokens: int = 1, seeds_at_once: int = SEEDS_AT_ONCE) -> DataFrame:
    """Pairs (doc_id, item_id) whose texts overlap, with the best alignment of each.

    An overlap is a run of ``overlap`` tokens (all of a shorter item) of which at
    least ``share`` are equal at the same places. Returns doc_id, item_id,
    matched (equal tokens of the alignment), item_tokens, best_run (equal tokens
    of the best run) and start (first token of the item in the document, below
    zero if the item begins before it); ties go to more matched tokens, then to the
    smaller start. Every overlap has a hit, as each length of runs has masks of its own
    where the standard ones miss placements; only masks of lengths that items have are
    hashed. An item without a token, or of fewer than ``least_tokens``, matches
    nothing. Null ids, null and empty texts match nothing; repeated rows give one row,
    and several texts of one id are all held against the item; empty tables give none;
    other columns are ignored. The items' seeds are broadcast in blocks of bounded
    size, whatever the number and length of the items.
    """
    tests = items.select(F.col(item_col).alias("item_id"), F.filter(_tokens(item_text_col), lambda x: x != "").alias("item")).where("item_id is not null")
    tests = cut(tests.where(F.size("item") >= max(1, least_tokens)).distinct())
    run = F.least(F.size("tokens"), F.lit(overlap))
    masks: dict[tuple[int, ...], list[int]] = {MASKS[0]: []}
    for r in tests.select(F.least(F.size("item"), F.lit(overlap)).alias("run")).distinct().collect():  # at most ``overlap`` lengths
        for mask in masks_for(r.run, share):
            masks.setdefault(mask, []).append(r.run)
    masks = {m: runs for m, runs in masks.items() if runs} or {MASKS[0]: [overlap]}
    seeds = cut(_seeds(tests.withColumnRenamed("item", "tokens"), masks, run).select("seed", "item_id", F.col("pos").alias("item_pos")))
    blocks = max(1, ceil(seeds.count() / seeds_at_once))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    rows = texts.select("doc_id", _tokens("text").alias("tokens"))
    found = None
    for k in range(blocks):
        block = F.broadcast(seeds.where(F.pmod(F.xxhash64("seed", "item_id", "item_pos"), F.lit(blocks)) == k))
        hit = _seeds(rows, masks).join(block, "seed").select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("start"))
        found = hit if found is None else found.unionByName(hit)
    found = cut(found.distinct())
    near = broadcast_if_small(found, ALIGNMENTS_AT_ONCE).withColumnRenamed("doc_id", "own")
    hit_ids = broadcast_if_small(found, ALIGNMENTS_AT_ONCE).select(F.col("doc_id").alias("own")).distinct()
    # Between the joins, tokens are made once for each document that was hit; a later projection would make them for each token of an item.
    own = texts.join(hit_ids, F.col("doc_id") == F.col("own"), "left_semi").select("doc_id", _tokens("text").alias("tokens"))
    small = (tests.agg(F.sum(F.size("item"))).first()[0] or 0) <= TOKENS_AT_ONCE
    both = own.join(near, F.col("doc_id") == F.col("own")).join(F.broadcast(tests) if small else tests, "item_id")
    equal = F.transform("item", lambda x, j: F.coalesce((F.get("tokens", F.col("start") + j) == x).cast("int"), F.lit(0)))
    both = both.select("doc_id", "item_id", "start", F.size("item").alias("item_tokens"), F.least(F.lit(overlap), F.size("item")).alias("run"), equal.alias("equal"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    runs = F.transform(F.sequence(F.lit(0), F.size("equal") - F.col("run")), lambda j: total(F.slice("equal", j + 1, F.col("run"))))
    both = both.select("doc_id", "item_id", "start", "item_tokens", "run", total("equal").alias("matched"), F.array_max(runs).alias("best_run"))
    both = both.where(F.col("best_run") >= F.ceil(F.col("run") * F.lit(share)))
    best = F.max(F.struct("best_run", "matched", (-F.col("start")).alias("before"), "item_tokens")).alias("b")
    return both.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.matched", "b.item_tokens", "b.best_run", (-F.col("b.before")).alias("start"))


# Every alignment with an equal token is tried: no seeds here.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') AS tk FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS tk FROM benchmark),
b7 AS (SELECT item_id, tk, len(tk) AS n FROM b WHERE len(tk) > 0),
bp AS (SELECT item_id, n, unnest(tk) AS w, unnest(range(1, len(tk) + 1)) AS p FROM b7),
dp AS (SELECT doc_id, unnest(tk) AS w, unnest(range(1, len(tk) + 1)) AS p FROM d),
a AS (SELECT doc_id, item_id, n, dp.p - bp.p AS st FROM dp JOIN bp USING (w) GROUP BY ALL HAVING count(*) >= ceil(least(13, n) * 0.8)),
e AS (SELECT doc_id, item_id, st, n, unnest(range(1, n + 1)) AS j, d.tk AS dt, b7.tk AS bt FROM a JOIN d USING (doc_id) JOIN b7 USING (item_id, n)),
x AS (SELECT doc_id, item_id, st, n, j, CASE WHEN st + j >= 1 AND dt[st + j] = bt[j] THEN 1 ELSE 0 END AS eq FROM e),
r AS (SELECT *, sum(eq) OVER w AS run, count(*) OVER w AS width FROM x WINDOW w AS (PARTITION BY doc_id, item_id, st ORDER BY j ROWS BETWEEN 12 PRECEDING AND CURRENT ROW)),
s AS (SELECT doc_id, item_id, st, n, sum(eq) AS matched, max(run) FILTER (width = least(13, n)) AS best FROM r GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY best DESC, matched DESC, st) AS k FROM s WHERE best >= ceil(least(13, n) * 0.8))
SELECT doc_id, item_id, matched::INTEGER AS matched, n::INTEGER AS item_tokens, best::INTEGER AS best_run, st::INTEGER AS start FROM t WHERE k = 1
"""
