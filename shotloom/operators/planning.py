"""Query plans, budgets and fair admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotloom.functions.scalars import PLATFORMS, case_folded, collapse_spaces
from shotloom.session import fresh_dir


def reference_audit(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Per key: children, whether the parent is there, and the problem: orphan (no parent), unused (no child) or ok."""
    counted = children.groupBy(F.col(child_key).alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    both = counted.join(parents.select(F.col(parent_key).alias("key"), F.lit(True).alias("known")).distinct(), "key", "full_outer")
    problem = F.when(F.col("known").isNull(), "orphan").when(F.col("n_children").isNull(), "unused").otherwise("ok")
    return both.select("key", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), problem.alias("problem"))


def platform_scope(scope: Column) -> Column:
    """The known platforms of a scope, in their fixed order."""
    return F.filter(F.array(*(F.lit(p) for p in PLATFORMS)), lambda p: F.array_contains(scope, p))


def round_robin(rows: DataFrame, plan: str, platform: str, rank: list[Column], most: int) -> DataFrame:
    """Per plan at most ``most`` rows, taken one from each platform in turn; inside a platform by rank.

    Platforms take turns in their fixed order, others after them by name. Two
    window passes: place inside the platform, then place over all platforms.
    """
    turn = F.row_number().over(Window.partitionBy(plan, platform).orderBy(*rank))
    rows = rows.withColumn("turn", turn).where(F.col("turn") <= most)
    known = F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(p) for p in PLATFORMS)), F.col(platform)), F.lit(0)), F.lit(len(PLATFORMS) + 1))
    place = F.row_number().over(Window.partitionBy(plan).orderBy("turn", known, platform))
    return rows.withColumn("place", place).where(F.col("place") <= most)


def admit_in_order(rows: DataFrame, plans: list[str], plan: str, platform: str, unit: str, rank: list[Column], most: int) -> DataFrame:
    """round_robin() plan after plan, where a unit admitted by one plan is out of the others.

    Sequential by definition. The rows are dealt into a folder a plan first; a plan then
    reads its own folder and the units taken so far, at most ``most`` a plan, and writes
    what it admits. So each row is read once, and no plan carries the work of another.
    """
    spark, path, taken = rows.sparkSession, fresh_dir(rows.sparkSession, "plans"), []
    rows.where(F.col(plan).isin(*plans)).repartition(F.col(plan)).write.partitionBy(plan).parquet(path)
    dealt = spark.read.schema(rows.schema).parquet(path)
    for name in plans:
        own = dealt.where(F.col(plan) == name)
        if taken:
            units = spark.read.schema(rows.schema).parquet(*taken).select(F.col(unit).alias("__taken"))
            own = own.join(F.broadcast(units), F.col(unit) == F.col("__taken"), "left_anti")  # at most ``most`` units a plan
        taken.append(fresh_dir(spark, "admitted"))
        round_robin(own, plan, platform, rank, most).write.parquet(taken[-1])
    return spark.read.parquet(*taken) if taken else round_robin(rows.limit(0), plan, platform, rank, most)


def query_keys(queries: DataFrame, platform: str = "platform", text: str = "text") -> DataFrame:
    """Distinct ``platform:text`` keys, texts case-folded with single spaces."""
    return queries.select(F.concat(F.col(platform), F.lit(":"), case_folded(collapse_spaces(F.col(text)))).alias("query_key")).distinct()


def new_queries(proposed: DataFrame, history: DataFrame) -> DataFrame:
    """Keys that earlier rounds have not asked."""
    return query_keys(proposed).join(query_keys(history), "query_key", "left_anti")


def round_budget(remaining: Column, rounds: Column) -> Column:
    """Budget of the next round: an even share, rounded up; zero when no round is left."""
    return F.when(rounds > 0, F.ceil(F.greatest(remaining, F.lit(0)) / rounds)).otherwise(0).cast("long")


def selection_ceiling(n_facets: Column) -> Column:
    return F.least(F.lit(12), 2 * n_facets + 2)


def status_rollup(status: Column, precedence: tuple[str, ...]) -> Column:
    """Aggregate: the first status of the precedence that any row has."""
    place = F.coalesce(*(F.when(status == s, F.lit(k)) for k, s in enumerate(precedence)), F.lit(len(precedence)))
    return F.element_at(F.array(*(F.lit(s) for s in precedence), F.lit("unknown")), F.min(place) + 1)


def content_groups(rows: DataFrame, content: Column, row_id: str, *same: str) -> DataFrame:
    """Rows of equal content: hash, number, sorted ids, and whether the columns ``same`` agree in the group."""
    own = rows.withColumn("content_hash", F.sha2(content, 256))
    agree = [(F.min(c).eqNullSafe(F.max(c))).alias(f"same_{c}") for c in same]
    out = own.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n_rows"), F.sort_array(F.collect_set(row_id)).alias("ids"), *agree)
    return out.withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


def set_audit(rows: DataFrame, key: str, value: str, expected: tuple[str, ...]) -> DataFrame:
    """Per key the expected values that it lacks and the values it has beyond them, sorted and joined by commas."""
    known = F.array(*(F.lit(e) for e in expected))
    held = rows.groupBy(key).agg(F.collect_set(value).alias("held"))
    listed = lambda a: F.array_join(F.sort_array(a), ",")
    return held.select(key, listed(F.array_except(known, F.col("held"))).alias("missing"), listed(F.array_except(F.col("held"), known)).alias("unexpected"))
