"""The corpus pipeline: five stages over ``documents``, each written and read again.

A stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with
the columns that came in; the last returns the packed pieces. Other columns pass
through. Rows of one doc_id are one document to the stages that join by it; a row
without an id is judged by its text, as one document with all rows of that text that
have no id either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotloom.llm import decontaminate, packing, similar, substrings, toxicity
from shotloom.llm.queries import tokenizer_file
from shotloom.session import broadcast_if_small, fresh_dir, written

#: SQL can express none of the stages' models and groupings as a whole.
ORACLE_SQL = None
#: Ids that are broadcast at most; more are joined by a shuffle.
IDS_AT_ONCE = 1_000_000


#: Rows without an id have this bit and 62 bits of their text's hash instead, beyond all ids in use.
KEY_BIT = 1 << 62


def _keyed(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a column ``name`` that names each document: its id, or for a null one a number made of its text."""
    made = F.xxhash64("text").bitwiseAND(F.lit(KEY_BIT - 1)).bitwiseOR(F.lit(KEY_BIT))
    return docs.withColumn(name, F.coalesce(F.col("doc_id").cast("long"), made))


def _without(keyed: DataFrame, name: str, ids: DataFrame) -> DataFrame:
    """The documents whose key is not in ``ids`` (doc_id)."""
    gone_id = _free(keyed, "gone_id")
    gone = written(ids.where("doc_id is not null").select(F.col("doc_id").alias(gone_id)).distinct(), "ids")
    gone = broadcast_if_small(gone, IDS_AT_ONCE)
    return keyed.join(gone, F.col(name) == F.col(gone_id), "left_anti")


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name += "_"
    return name


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the noisy-or model calls toxic go; it learns from ``labels`` of the documents at hand.

    Null and empty texts have a score, too, that of no evidence. Of several texts of an id
    one toxic one is enough. Ties: a score of just 0.5 is toxic. Very long texts are scored
    whole. An empty table gives an empty one.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    key = _free(docs, "doc_key")
    keyed = _keyed(docs, key)
    return _without(keyed, key, toxicity.score(keyed, model, id_col=key).where("predicted = 1")).drop(key)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts (five-word Jaccard of 0.8 or more) stays: the one of the smallest id.

    Null, empty and blank texts are one group. A row without an id stays only if no row of
    its group has one, and of several such rows one. Rows that repeat a document stay once;
    another text of a kept id stays as well. Very long texts are compared whole. An empty
    table gives an empty one.
    """
    key = _free(docs, "doc_key")
    keyed = _keyed(docs, key)
    kept = _without(keyed, key, similar.similar_groups(keyed, id_col=key).where("doc_id <> component_id"))
    name = _free(keyed, "same_text")
    return kept.withColumn(name, F.coalesce("text", F.lit(""))).dropDuplicates([key, name]).drop(name, key)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats of 400 bytes or of over 50 words are cut out of the texts; a text of which no word is left goes.

    A cut inside a character leaves the rest of it out, so that texts stay valid.
    Null texts and rows without an id stay as they are; rows that repeat a
    document are cut as it is. An empty table gives an empty one.
    """
    cut_key, cut_text, by_bytes, by_words = (_free(docs, name) for name in ("cut_key", "cut_text", "by_bytes", "by_words"))
    cuts = substrings.passages(docs).withColumnsRenamed({"key": cut_key, "by_bytes": by_bytes, "by_words": by_words})
    out = docs.join(written(cuts, "cuts"), (substrings.row_key("doc_id", "text") == F.col(cut_key)) & docs["doc_id"].isNotNull(), "left")
    cut = F.udf(substrings.cut_text, "string", useArrow=True).asNondeterministic()
    out = out.withColumn(cut_text, cut(F.when(F.col(cut_key).isNotNull(), F.col("text")), by_bytes, by_words)).where(f"{cut_text} is null or {cut_text} <> ''")
    columns = {"text": F.coalesce(cut_text, "text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col(cut_text).isNull(), F.col("n_chars")).otherwise(F.char_length(cut_text).cast("long"))
    return out.withColumns(columns).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go (see ``decontaminate.leaks``).

    Null and empty texts overlap nothing and stay. All texts of an id that has one such
    text go; repeated rows are treated alike. Very long texts are searched whole. An empty
    table, or no items, leaves the table as it is.
    """
    key = _free(docs, "doc_key")
    keyed = _keyed(docs, key)
    return _without(keyed, key, decontaminate.leaks(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key).select("doc_id")).drop(key)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left (see ``packing.pack``).

    A null or empty text is its end id alone; repeated rows are packed each; null ids stay
    null; very long texts are cut into windows; an empty table gives no pieces.
    """
    return packing.pack(docs, tokenizer_file(), with_ids=False)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; every stage reads what the one before has written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
