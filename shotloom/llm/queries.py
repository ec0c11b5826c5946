"""Queries of the corpus operators over the tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotloom.llm import byte_pieces, conversations, decontaminate, host_quality, html_text, interpolation, packing, periodic, prefix_trie, simhash, substrings, toxicity, warc
from shotloom.llm.text import SPACE_PATTERN


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer's file; a parameter of the operators, never copied here."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_file(), with_ids=False)


def op2_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = host_quality.judge(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_chunked_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.archive_pages(_table(spark, sf_dir, "pages"))
    return warc.resolve(warc.read_chunks(archives, with_data=False)).withColumnRenamed("record_id", "page_id")


def op4_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.score_documents(_table(spark, sf_dir, "documents"))


def op5_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model).withColumn("held_out", toxicity.held_out("doc_id"))
    return scored.select("doc_id", "held_out", "score", "predicted", "n_marked")


def op6_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_prefix_free_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(_table(spark, sf_dir, "documents"), with_kept=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    turns = turns.unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema))
    formatted = conversations.format_conversations(conversations.linear_messages(turns))
    return conversations.read_back(formatted).withColumnRenamed("tree", "conv_id")


def op10_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text; with h = crc32(doc_id as text), each tenth text repeats its first words from a place on.

    Where h % 10 = 0 and there are n > 0 words, word i >= a is word a + (i - a) % p of the
    original, a = g % n, p = 1 + (n - a) div (3 + g % 8), g = h div 10. A null id is left alone.
    """
    words = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    words = words.withColumn("words", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", SPACE_PATTERN), lambda w: w != "")))
    words = words.withColumns({"g": F.expr("h div 10"), "n": F.size("words")}).withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % n as int)")))
    words = words.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    planted = F.expr("array_join(transform(sequence(0, n - 1), i -> words[if(i < a, i, a + (i - a) % p)]), ' ')")
    return words.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op11_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.collapse_runs(planted_periods(_table(spark, sf_dir, "documents")))
    # the greatest length / period by exact products; of equals the first in the order of runs
    best = F.expr("aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = found.withColumn("best", best)
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_sentencepiece_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    back = byte_pieces.decode(byte_pieces.encode(_table(spark, sf_dir, "documents"), ranks, pattern), ranks, pattern)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(prefix_trie.rebuild(prefix_trie.turn_lists(_table(spark, sf_dir, "conversations"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sum_of_squares_packing": op1_sum_of_squares_packing,
    "op2_host_quality": op2_host_quality,
    "op3_chunked_warc": op3_chunked_warc,
    "op4_deleted_interpolation": op4_deleted_interpolation,
    "op5_noisy_or_toxicity": op5_noisy_or_toxicity,
    "op6_layout_text": op6_layout_text,
    "op7_simhash_groups": op7_simhash_groups,
    "op8_prefix_free_substrings": op8_prefix_free_substrings,
    "op9_reply_trees": op9_reply_trees,
    "op10_benchmark_leaks": op10_benchmark_leaks,
    "op11_lyndon_runs": op11_lyndon_runs,
    "op12_sentencepiece_bytes": op12_sentencepiece_bytes,
    "op13_prefix_trie": op13_prefix_trie,
}

_OP3_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha256(encode(coalesce(html, ''))) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, h AS payload_digest,
  CASE WHEN octet_length(b) >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN octet_length(b) >= 100 AND page_id <> first THEN first END AS refers_to FROM f
"""

_OP9_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t') AS body,
  replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\t'), chr(10), '\n') AS head FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(head) + 2 + length(body) + 9)::BIGINT AS formatted_chars FROM e GROUP BY conv_id
"""

ORACLE_SQL: dict[str, str] = {
    "op2_host_quality": host_quality.ORACLE_SQL,
    "op3_chunked_warc": _OP3_SQL,
    "op9_reply_trees": _OP9_SQL,
    "op10_benchmark_leaks": decontaminate.ORACLE_SQL,
    "op13_prefix_trie": prefix_trie.ORACLE_SQL,
}
