"""Ties and sizes that the other tests leave out."""

import hashlib
import random

from pyspark.sql import functions as F

from shotloom.llm import conversations, toxicity, warc


def test_branches_of_equal_score(spark):
    """Equal means: the longer path first, then the smaller leaf; repeated runs give the same."""
    rows = [(1, 1, None, 0.0), (1, 2, 1, 0.0), (1, 3, 1, 0.0), (1, 4, 1, 0.0), (1, 5, 4, 0.0), (1, 6, 3, 0.0), (2, 9, None, None), (2, 8, None, None)]
    messages = spark.createDataFrame([(t, n, p, "user", f"m{n}", s) for t, n, p, s in rows], "tree long, node long, parent long, role string, text string, score double").withColumn("leaf", F.lit("clash"))
    got = {(r.tree, r.leaf): r.path_rank for r in conversations.reply_paths(messages, None).collect()}
    assert got == {(1, 5): 1, (1, 6): 2, (1, 2): 3, (2, 8): 1, (2, 9): 2}
    assert {(r.tree, r.leaf) for r in conversations.reply_paths(messages, 1).collect()} == {(1, 5), (2, 8)}


def test_payloads_above_a_batch(spark, tmp_path):
    rng = random.Random(1)
    large = ["".join(rng.choice("abcdefghé") for _ in range(warc.BATCH_BYTES // 50)) * 60 for _ in range(2)]
    assert len(large[0].encode()) > warc.BATCH_BYTES
    pages = spark.createDataFrame([(1, "u", large[0]), (2, "u", large[1]), (3, "u", large[0]), (4, "u", "x" * 99), (5, "u", "x" * 99)], "page_id long, url string, html string")
    archives = warc.archive_pages(pages, f"file://{tmp_path}/w")
    got = {r.record_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.resolve(warc.read_chunks(archives, with_data=False)).collect()}
    want = {}
    for k, text, refers in ((1, large[0], None), (2, large[1], None), (3, large[0], 1), (4, "x" * 99, None), (5, "x" * 99, None)):
        want[k] = (len(text.encode()), hashlib.sha256(text.encode()).hexdigest(), "revisit" if refers else "response", refers)
    assert got == want
    whole = warc.read_chunks(archives).where("record_id = 2").orderBy("chunk_no").collect()
    assert b"".join(bytes(r.chunk) for r in whole) == large[1].encode() and len(whole) > 1


def test_labels_that_disagree_count_as_toxic(spark):
    rng = random.Random(2)
    plain = lambda k: " ".join(rng.choice(["ka", "lo", "mi", "nu", "pe"]) for _ in range(20 + k % 5))
    docs = [(k, f"{plain(k)}. {'grolk ' if k % 4 == 0 else ''}{plain(k)}") for k in range(400)]
    labels = [(k, int(k % 4 == 0)) for k, _ in docs] + [(k, 0) for k, _ in docs if k % 4 == 0]  # a tie for each toxic one
    model = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.weights.get("grolk", 0) > 0 and model.score("grolk")[0] > 0.5 > model.score("ka lo mi")[0]
