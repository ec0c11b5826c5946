"""Interval, fold and merge operators against plain-Python models and fixtures."""

import random

from pyspark.sql import functions as F

from shotloom.operators import folds, intervals, merge, retrieval
from shotloom.plans import timelines


def test_merge_plan_fixture(spark):
    rows = [("v", 1, 0, 1000, None, "keep"), ("v", 2, 1000, 2000, "b1", "remove"), ("v", 3, 2000, 3000, "b2", "review"), ("v", 4, 3000, 4000, "b3", "keep")]
    df = spark.createDataFrame(rows, "video string, ordinal int, start_ms long, end_ms long, boundary_id string, decision string")
    got = [tuple(r) for r in merge.merge_plan(df, "video").orderBy("segment_no").collect()]
    assert got == [("v", 1, 0, 2000, 2, "b2"), ("v", 2, 2000, 3000, 1, ""), ("v", 3, 3000, 4000, 1, "")]
    audit = merge.timeline_audit(merge.merge_plan(df, "video"), "video").first()
    assert (audit.n_breaks, audit.n_empty, audit.n_misnumbered, audit.covered_ms) == (0, 0, 0, 4000)


def test_audit_finds_gaps(spark):
    df = spark.createDataFrame([("v", 1, 0, 10), ("v", 3, 20, 20)], "video string, segment_no int, start_ms long, end_ms long")
    audit = merge.timeline_audit(df, "video").first()
    assert (audit.n_breaks, audit.n_empty, audit.n_misnumbered) == (1, 1, 1)


def test_decision_audit(spark):
    b = spark.createDataFrame([("a",), ("b",)], "id string")
    d = spark.createDataFrame([("a",), ("a",), ("c",)], "id string")
    assert {tuple(r) for r in merge.decision_audit(b, d, "id").collect()} == {("a", "duplicate"), ("b", "missing"), ("c", "unknown")}


def test_split_long_rounds_half_to_even(spark):
    df = spark.createDataFrame([("v", 0, 30), ("v", 30, 35)], "v string, start_ms long, end_ms long")
    got = sorted((r.start_ms, r.end_ms) for r in intervals.split_long(df, 10).collect())
    assert got == [(0, 10), (10, 20), (20, 30), (30, 35)]
    odd = spark.createDataFrame([("v", 0, 5)], "v string, start_ms long, end_ms long")
    assert sorted((r.start_ms, r.end_ms) for r in intervals.split_long(odd, 4).collect()) == [(0, 2), (2, 5)]


def test_overlap_join_equals_nested_loop(spark):
    rng = random.Random(5)
    make = lambda n: [(rng.randint(0, 2), k, s := rng.randint(-50, 200), s + rng.choice([0, 1, 5, 40, 120])) for k in range(n)]
    left, right = make(60), make(60)
    a = spark.createDataFrame(left, "k int, l_id int, l_start long, l_end long")
    b = spark.createDataFrame(right, "k int, r_id int, r_start long, r_end long")
    for closed in (False, True):
        meet = (lambda x, y: x[2] <= y[3] and y[2] <= x[3]) if closed else (lambda x, y: x[2] < y[3] and y[2] < x[3])
        want = sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and meet(x, y))
        got = sorted((r.l_id, r.r_id) for r in intervals.overlap_join(a, b, "k", 30, closed).collect())
        assert got == want


def test_nearest_prefers_earlier_id(spark):
    left = spark.createDataFrame([("u", 1, 100), ("w", 2, 5)], "u string, id int, ms long")
    right = spark.createDataFrame([("u", 9, 90), ("u", 7, 110), ("u", 8, 90)], "u string, rid int, ms long")
    got = {r.id: (r.near_id, r.near_ms) for r in intervals.nearest(left, right, "u", "ms", "rid").collect()}
    assert got == {1: (7, 110), 2: (None, None)}


def test_min_gap_model(spark):
    rng = random.Random(2)
    rows = [(k % 3, k, rng.randint(0, 300), rng.random()) for k in range(90)]
    df = spark.createDataFrame(rows, "u int, id int, ms long, score double")
    want = []
    for u in range(3):
        kept = []
        for r in sorted((r for r in rows if r[0] == u), key=lambda r: (r[2], r[1])):
            if not kept or r[2] - kept[-1][2] >= 20:
                kept.append(r)
            elif r[3] > kept[-1][3]:
                kept[-1] = r
        want += [(u, n + 1, r[1]) for n, r in enumerate(kept)]
    got = sorted((r.u, r.point_no, r.id) for r in folds.min_gap(df, "u", "ms", "score", "id", 20).collect())
    assert got == sorted(want)


def test_near_duplicates_look_back_over_kept(spark):
    rows = [("v", 1, 0), ("v", 2, 1), ("v", 3, 255), ("v", 4, 3), ("v", 5, -1)]
    df = spark.createDataFrame(rows, "v string, id long, h long")
    got = {r.id: (r.kept, r.near_id, r.distance) for r in folds.near_duplicates(df, "v", "id", "h", threshold=2, lookback=2).collect()}
    assert got == {1: (True, None, None), 2: (False, 1, 1), 3: (True, None, None), 4: (False, 1, 2), 5: (True, None, None)}


def test_near_duplicates_name_the_latest_within_the_threshold(spark):
    rows = [("a", 1, 0), ("a", 2, 7), ("a", 3, 1), ("a", 4, None), ("a", 5, 0), ("b", 6, 0), (None, 7, 0), (None, 8, 0)]
    df = spark.createDataFrame(rows, "v string, id long, h long")
    got = {r.id: (r.kept, r.near_id, r.distance) for r in folds.near_duplicates(df, "v", "id", "h", threshold=2, lookback=3).collect()}
    # 3 is one bit from 1 and two from 2: the later one is named.
    assert got[3] == (False, 2, 2) and got[5] == (False, 1, 0) and got[8] == (False, 7, 0)
    assert all(got[k] == (True, None, None) for k in (1, 2, 4, 6, 7))
    assert folds.near_duplicates(df.limit(0), "v", "id", "h").count() == 0


def test_near_duplicates_equal_a_plain_loop(spark):
    rng = random.Random(5)
    rows = [(rng.choice("xyz"), k, rng.getrandbits(64) - 2**63 if rng.random() < 0.3 else rng.choice([0, 3, 12, 255, 4095])) for k in range(400)]
    want = {}
    for name in "xyz":
        kept = []
        for _, k, h in (r for r in rows if r[0] == name):
            near = [(j, bin((h ^ g) % 2**64).count("1")) for j, g in kept[-3:] if bin((h ^ g) % 2**64).count("1") <= 4]
            want[k] = (not near, *(near[-1] if near else (None, None)))
            kept += [] if near else [(k, h)]
    got = folds.near_duplicates(spark.createDataFrame(rows, "v string, id long, h long").repartition(5), "v", "id", "h").collect()
    assert {r.id: (r.kept, r.near_id, r.distance) for r in got} == want


def test_keep_evenly(spark):
    df = spark.range(1, 101).select(F.lit("v").alias("v"), F.col("id").cast("int").alias("n"))
    got = sorted(r.n for r in intervals.keep_evenly(df, "v", "n", 7).collect())
    assert got == [round(i * 99 / 6) + 1 for i in range(7)]
    assert intervals.keep_evenly(df.where("n < 5"), "v", "n", 7).count() == 4


def test_motion_and_speed_may_be_met_apart(spark):
    schema = "shot_id string, viewpoints array<string>, shot_scale struct<start: string, end: string>, camera_motions array<struct<type: string, speed: string>>, cinematography_keywords array<string>"
    df = spark.createDataFrame([("s1", ["eye"], ("close", "wide"), [("pan", "slow"), ("tilt", "fast")], ["k"]), ("s2", ["eye"], ("wide", "wide"), [("pan", "slow")], [])], schema)
    ids = lambda **f: [r.shot_id for r in retrieval.filter_shots(df, **f).orderBy("shot_id").collect()]
    assert ids(motions=("pan",), speeds=("fast",)) == ["s1"]
    assert ids(scales=("wide",)) == ["s1", "s2"]
    assert ids(keywords=("k",), viewpoints=("eye",)) == ["s1"]


def test_transcript_slice_fixture(spark):
    seg = spark.createDataFrame([("j", 1, 1000, 5000)], "job string, segment_no int, start_ms long, end_ms long")
    spans = spark.createDataFrame([("j", "span_1", 1, 500, 2000, "a", "en"), ("j", "span_2", 2, 2000, 4800, "b", "en"), ("j", "span_3", 3, 5000, 5100, "c", "en")], "job string, span_id string, pos int, r_start long, r_end long, text string, language string")
    r = retrieval.transcript_slices(seg, spans, "job", 1000).first()
    assert (r.n_spans, r.n_clipped, r.text, r.span_ids, r.language) == (2, 1, "a b", "span_1,span_2", "en")


def test_last_annotation_wins_and_missing_fails(spark):
    shots = spark.createDataFrame([("s1", 1)], "shot_id string, ordinal int")
    notes = spark.createDataFrame([("s1", 1, "old"), ("s1", 2, "new")], "shot_id string, line_no int, note string")
    assert retrieval.with_annotations(shots, notes).first().note == "new"
    try:
        retrieval.with_annotations(shots, notes.where("false")).collect()
    except Exception as error:
        assert "no annotation" in str(error)
    else:
        raise AssertionError("a missing annotation must fail")


def test_page_counts_before_paging(spark):
    df = spark.range(10)
    got = retrieval.page(df, ["id"], 8, 5).collect()
    assert [(r.id, r.total) for r in got] == [(8, 10), (9, 10)]


def test_hamming_pairs_lose_no_pair(spark, tmp_path):
    rng = random.Random(9)
    signs = lambda h: [1.0 if h >> (63 - k) & 1 else -1.0 for k in range(64)]
    rows = []
    for k in range(30):
        base = rng.getrandbits(64)
        for _ in range(4):
            flips = 0
            for bit in rng.sample(range(64), rng.randint(0, 11)):
                flips |= 1 << bit
            rows.append((len(rows), k % 3, base ^ flips))
    # Fifteen and sixteen bits apart, two in each band.
    spread = sum(3 << (8 * k) for k in range(8))
    rows += [(900, 9, 0), (901, 9, spread ^ 1), (902, 9, spread)]
    spark.createDataFrame([(i, label, signs(h)) for i, label, h in rows], "vec_id long, label int, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    want = {(a[1], a[0], b[0], bin(a[2] ^ b[2]).count("1")) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and bin(a[2] ^ b[2]).count("1") <= 15}
    got = [tuple(r) for r in timelines.hamming_pairs(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and (9, 900, 901, 15) in want and len(want) > 50
