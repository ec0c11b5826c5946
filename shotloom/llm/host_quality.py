"""Document quality rules and host verdicts, in DataFrame functions only.

Each document is measured once; the measurements, without texts, are written and
then summed by host. A host's failure rate of each rule is shrunk towards the
rate of all hosts with a beta prior fitted to the hosts' own rates, so that a
host of few documents is not judged by its luck. Documents of hosts whose shrunk
rate of any rule is too high are not kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotloom.llm.text import SPACE_PATTERN
from shotloom.session import broadcast_if_small, cut

_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"

#: Rules by name, over the columns of measure(). Hosts are judged by each.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "10 * n_symbols > word_chars",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
}
BASE_RULES = ("few_words", "repeated_words")


def _at(array: str, index: Column) -> Column:
    return F.get(F.col(array), index)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Counts of each document: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    n_lines counts lines with a word. n_repeat_words counts the words that lie in
    a three-word window that the text has twice or more. A null text has no words.
    Steps are separate projections so that no array is built inside a lambda.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), text.alias("t"))
    rows = rows.withColumn("stripped", F.btrim("t", F.lit(_SPACES)))
    rows = rows.select(
        "doc_id",
        "host",
        F.when(F.col("stripped") == "", F.array().cast("array<string>")).otherwise(F.split("stripped", SPACE_PATTERN)).alias("words"),
        F.char_length(F.translate("t", _SPACES, "")).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.translate("t", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(_SPACES)) != "").alias("lines"),
    )
    n = F.size("words")
    window = lambda i: F.xxhash64(_at("words", i), _at("words", i + 1), _at("words", i + 2))
    rows = rows.select(
        "doc_id",
        "host",
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), window)).alias("g"),
    )
    # Most texts repeat no window and skip the sort.
    ordered = F.sort_array(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("z", F.when(F.size(F.array_distinct("g")) < F.size("g"), ordered)).drop("g")
    same = lambda j, k: F.coalesce(_at("z", j)["h"] == _at("z", k)["h"], F.lit(False))
    found = F.transform(F.sequence(F.lit(0), F.size("z") - 1), lambda j: F.when(same(j, j - 1) | same(j, j + 1), _at("z", j)["i"]))
    rows = rows.withColumn("p", F.sort_array(F.filter(found, lambda x: x.isNotNull()))).drop("z")
    steps = F.zip_with("p", F.slice("p", 2, F.size("p")), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))).cast("long"))
    repeated = F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    return rows.withColumn("n_repeat_words", repeated).drop("p")


def host_rates(measured: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """Per host: n_docs, and for each rule its failures and its shrunk failure rate.

    The beta prior of a rule has the mean of the hosts' rates and the strength
    that their variance implies (method of moments), from 1 to a million
    documents. One row of two numbers a rule goes to the driver.
    """
    rules = RULES if rules is None else rules
    hosts = cut(measured.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *(F.count_if(F.expr(e)).alias(f"f_{k}") for k, e in rules.items())))
    moments = hosts.agg(*(f(F.col(f"f_{k}") / F.col("n_docs")).alias(f"{name}_{k}") for k in rules for name, f in (("m", F.avg), ("v", F.var_pop)))).first()
    shrunk = []
    for k in rules:
        mean, var = moments[f"m_{k}"] or 0.0, moments[f"v_{k}"] or 0.0
        strength = min(1e6, max(1.0, mean * (1 - mean) / var - 1)) if var > 0 else 1e6
        shrunk.append(((F.col(f"f_{k}") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength))).alias(f"rate_{k}"))
    return hosts.select("*", *shrunk)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", rules: dict[str, str] | None = None, base_rules: tuple[str, ...] = BASE_RULES, max_rate: float = 0.5) -> DataFrame:
    """The columns of measure() with base_failed, host_failed and kept, one row for each input row.

    A null host groups the documents without one, which are judged like the rest.
    Repeated rows count as often as they occur. An empty table gives none.
    """
    rules = RULES if rules is None else rules
    measured = cut(measure(docs, id_col, text_col, host_col))
    bad = host_rates(measured, rules).where(" or ".join(f"rate_{k} > {max_rate}" for k in rules) or "false")
    bad = broadcast_if_small(bad.select(F.col("host").alias("bad_host"), F.lit(True).alias("host_failed")))
    out = measured.join(bad, F.col("host").eqNullSafe(F.col("bad_host")), "left").drop("bad_host")
    base = F.expr(" or ".join(f"({rules[k]})" for k in base_rules))
    out = out.withColumns({"base_failed": base, "host_failed": F.coalesce("host_failed", F.lit(False))})
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM g),
p AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS j FROM c WHERE n > 1),
q AS (SELECT r, sum(least(3, coalesce(j - i, 3))) AS n FROM p GROUP BY r),
m AS (SELECT w.r, doc_id, host, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(q.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN q USING (r)),
f AS (SELECT *, n_words < 50 AS x1, 100 * n_repeat_words > 50 * n_words AS x2, 10 * n_symbols > word_chars AS x3, 10 * n_dup_lines > 3 * n_lines AS x4 FROM m),
h AS (SELECT host, count(*) AS n, count(*) FILTER (x1) AS f1, count(*) FILTER (x2) AS f2, count(*) FILTER (x3) AS f3, count(*) FILTER (x4) AS f4 FROM f GROUP BY host),
u AS (SELECT host, n, unnest([f1, f2, f3, f4]) AS f, unnest([1, 2, 3, 4]) AS k FROM h),
b AS (SELECT k, avg(f / n) AS mean, var_pop(f / n) AS var FROM u GROUP BY k),
s AS (SELECT k, mean, CASE WHEN var > 0 THEN least(1e6, greatest(1.0, mean * (1 - mean) / var - 1)) ELSE 1e6 END AS s FROM b),
v AS (SELECT host, bool_or((f + mean * s) / (n + s) > 0.5) AS bad FROM u JOIN s USING (k) GROUP BY host)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words, x1 OR x2 AS base_failed, NOT (x1 OR x2) AND NOT bad AS kept
FROM f JOIN v ON f.host IS NOT DISTINCT FROM v.host
"""
