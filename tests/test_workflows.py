"""Workflow and semantics operators, their readers, and the queries against their SQL."""

import hashlib
import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from shotloom.functions import scalars
from shotloom.operators import folds, manifest, retrieval, semantics, workflow
from shotloom.plans import workflows
from shotloom.sources import readers

FOLDER = "/root/testdata/sf0.001"


def norm(rows):
    return sorted(tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(workflows.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("nation", "orders", "lineitem", "customer", "part", "events", "conversations"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    got = workflows.QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    want = con.execute(f"select {', '.join(columns)} from ({workflows.ORACLE_SQL[name]})").fetchall()
    assert norm(got.select(*columns).collect()) == norm(want)


def test_near_anchors_model(spark):
    rng = random.Random(5)
    points = [(k, rng.randrange(20_000), rng.choice(["scene_change", "periodic"])) for k in range(3) for _ in range(60)]
    points += [(k, t, r) for k in range(3) for t, r in ((0, "source_start"), (20_000, "source_end"))]
    want = []
    for k in range(3):
        anchors = []
        for _, t, r in sorted(p for p in points if p[0] == k):
            joins = anchors and not r.startswith("source") and not any(x.startswith("source") for x in anchors[-1][1]) and t - anchors[-1][0] <= 600
            if joins:
                anchors[-1][1].add(r)
                anchors[-1][0] = t if r == "scene_change" else anchors[-1][0]
            else:
                anchors.append([t, {r}])
        want += [(k, n, t, "+".join(sorted(r))) for n, (t, r) in enumerate(anchors)]
    got = folds.merge_near(spark.createDataFrame(points, "k int, at long, why string"), "k", "at", "why")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert folds.merge_near(spark.createDataFrame([], "k int, at long, why string"), "k", "at", "why").count() == 0


def test_pick_frames_model(spark):
    rng = random.Random(6)
    rows = [(k, n, rng.randrange(100, 1100), 100, 1000) for k, size in enumerate((0, 2, 3, 9, 40)) for n in range(size)]
    want = []
    for k in range(5):
        left = sorted((t, n) for g, n, t, a, b in rows if g == k and a <= t < b)
        if len(left) > 3:
            taken = []
            for i in range(3):
                best = min(left, key=lambda f: abs(f[0] - (100 + round((i + 1) * 900 / 4))))
                left.remove(best)
                taken.append(best)
            left = taken
        want += [(k, n, t) for t, n in left]
    got = folds.pick_frames(spark.createDataFrame(rows, "k int, n int, frame_ms long, start_ms long, end_ms long"), ["k"], "n", 3)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_unique_lookup(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "k string, v int")
    assert workflow.unique_lookup(rows, "k", "a").first().v == 1
    assert workflow.unique_lookup(rows, "k", "z").count() == 0
    with pytest.raises(Exception, match="more than one row"):
        workflow.unique_lookup(rows, "k", "b").collect()


def test_recorded_terminal_state_stands(spark):
    rows = [("s", 1, "running", ["b", "a", "a"]), ("s", 2, "running", ["a", "b"]), ("s", 3, "done", ["a"]), ("s", 4, "done", ["a"]), ("s", 5, "failed", ["a"])]
    got = workflow.record_states(spark.createDataFrame(rows, "k string, n int, status string, ids array<string>"), "k", ["n"], "status", "ids", ("done", "failed")).first()
    assert (got.status, got.ids, got.revision, got.n_refused) == ("done", "a", 2, 1)


def test_guards(spark):
    rows = [
        ("v", 1, "walk", False, False, "remove", "same_continuous_event"),
        ("v", 2, " Walk ", False, False, "remove", "same_continuous_event"),
        ("v", 3, "talk", False, False, "remove", "same_topic_new_event"),
        ("v", 4, "sit", False, False, None, None),
        ("v", 5, "x", False, False, "remove", "nonsense"),
        ("v", 6, "y", False, False, "keep", "different_topic"),
        ("v", 7, "z", False, False, None, None),
    ]
    frame = spark.createDataFrame(rows, "k string, n int, event string, starts_mid_action boolean, ends_mid_action boolean, decision string, relationship string")
    got = {r.n: (r.decision, r.relationship, r.review_reason) for r in semantics.guarded_decisions(frame, "k", "n").collect()}
    assert got == {
        1: ("remove", "same_continuous_event", None),
        2: ("review", "model_disagreement", "continuity_guard"),
        3: ("review", "same_topic_new_event", "relationship_guard"),
        4: ("review", "insufficient_evidence", "missing_model_row"),
        5: ("review", "insufficient_evidence", None),
        6: ("keep", "different_topic", None),
    }


def test_anchored_segments_problems(spark):
    anchors = spark.createDataFrame([("v", f"a{k}", k * 100) for k in range(5)], "k string, anchor_id string, at_ms long")
    proposed = [("v", 1, "a0", "a2"), ("v", 2, "a2", "a2"), ("v", 3, "a3", "a9"), ("v", 4, "a1", "a3")]
    frame = spark.createDataFrame(proposed, "k string, segment_no int, start_anchor string, end_anchor string")
    got = [r.problem for r in semantics.anchored_segments(frame, anchors, "k").orderBy("segment_no").collect()]
    assert got == [None, "empty_range", "unknown_anchor", "gap"]
    whole = semantics.anchored_segments(frame.where("segment_no = 1"), anchors, "k").first()
    assert (whole.problem, whole.segment_id) == ("short", "segment_0001")


def test_errors_of_bad_rows(spark):
    items = spark.createDataFrame([("j", [("s", None), ("s", "w")])], "job string, sources array<struct<collection_session_id: string, work_group_id: string>>")
    segments = spark.createDataFrame([("j", "x", 0, 5), ("j", "y", 5, 5)], "job string, seg string, start_ms long, end_ms long")
    good = semantics.candidate_rows(items, segments.where("seg = 'x'"), "job", "seg", "sources").first()
    assert (good.candidate_segment_id, good.session_ids, good.work_group_ids, good.duration_ms) == ("j:x", "s", "w", 5)
    with pytest.raises(Exception, match="invalid range"):
        semantics.candidate_rows(items, segments, "job", "seg", "sources").collect()
    ranges = spark.createDataFrame([("b1",)], "b string")
    none = spark.createDataFrame([], "b string, decision string")
    assert semantics.with_decisions(ranges, none, "b").first().decision == "keep"
    with pytest.raises(Exception, match="no decision"):
        semantics.with_decisions(ranges, none, "b", None).collect()
    units = spark.createDataFrame([("c", "u")], "candidate_id string, media_unit_id string")
    groups = spark.createDataFrame([("u", "g", "primary"), ("u", "h", "primary")], "media_unit_id string, work_group_id string, role string")
    with pytest.raises(Exception, match="more than one work group"):
        manifest.replace_groups(units, units, groups).collect()


def test_scalars_of_streams(spark):
    row = spark.range(1).select(
        scalars.stream_edge(F.lit(1920), F.lit(1080), F.lit("x")).alias("a"),
        scalars.stream_edge(F.lit(None).cast("int"), F.lit(5), F.lit("normal_720_0 12345 1080p")).alias("b"),
        scalars.stream_edge(F.lit(0), F.lit(5), F.lit("none")).alias("c"),
        scalars.escape_html(F.lit("<a href='x'>\"&</a>")).alias("d"),
        scalars.proxy_required(F.lit(720), F.lit(1280), F.lit(-90)).alias("e"),
        scalars.proxy_required(F.lit(720), F.lit(1280), F.lit(0)).alias("f"),
    ).first()
    assert tuple(row) == (1080, 720, None, "&lt;a href=&#x27;x&#x27;&gt;&quot;&amp;&lt;/a&gt;", False, True)


def test_event_log_and_sessions(spark, tmp_path):
    whole, torn = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    whole.write_bytes('{"id": 1, "t": "é"}\r\n\n{"id": 2, "t": ""}\n'.encode())
    torn.write_text('{"id": 3}\n{"id": 4}')
    assert readers.torn_files(spark, str(whole)).count() == 0
    assert sorted(r.id for r in readers.read_event_log(spark, str(whole), "id long, t string").collect()) == [1, 2]
    with pytest.raises(ValueError, match="incomplete event line"):
        readers.read_event_log(spark, str(tmp_path / "*.jsonl"), "id long, t string")
    for name, day in (("ses_a", "2024-01-01"), ("ses_b", "2024-01-02"), ("ses_c", "2024-01-02"), ("ses_bad!", "2024-01-03")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "session.json").write_text(json.dumps({"session_id": name, "created_at": day}))
    assert [r.session_id for r in readers.list_sessions(spark, str(tmp_path), "session_id string, created_at string").collect()] == ["ses_c", "ses_b", "ses_a"]


def test_session_views(spark):
    plan = b'{"a": 1}'
    sessions = spark.createDataFrame([("s", plan, hashlib.sha256(plan).hexdigest()), ("t", plan, "00")], "session_id string, plan binary, plan_sha256 string")
    segments = spark.createDataFrame([("s", 2, "b"), ("s", 1, "a")], "session_id string, position int, segment_id string")
    got = {r.session_id: r for r in readers.session_views(sessions, segments, segments.where("false")).collect()}
    assert [x.segment_id for x in got["s"].segments] == ["a", "b"] and got["s"].plan_valid and got["s"].warnings == []
    assert got["t"].segments == [] and not got["t"].plan_valid


def test_contracts(spark, tmp_path):
    one, two, three = (tmp_path / n for n in ("c.json", "p.json", "q.json"))
    one.write_text(json.dumps({"segments": [{"segment_id": "a"}, {"segment_id": "b"}]}))
    two.write_text(json.dumps({"plans": [{"segment_id": "b", "plan": "x"}, {"segment_id": "a", "plan": "y"}]}))
    three.write_text(json.dumps({"plans": [{"segment_id": "b", "plan": "x"}]}))
    segments, plans = readers.load_contracts(spark, str(one), str(two), "segment_id: string", "segment_id: string, plan: string")
    assert segments.count() == plans.count() == 2
    with pytest.raises(ValueError, match="'a'"):
        readers.load_contracts(spark, str(one), str(three), "segment_id: string", "segment_id: string, plan: string")


def test_references_of_unknown_shots(spark):
    shots = spark.createDataFrame([("a", 0, 1500)], "shot_id string, start_ms long, end_ms long")
    lines = spark.createDataFrame([(1, "a"), (3, "a"), (4, "b")], "line_no int, shot_id string")
    good = retrieval.annotation_references(lines.where("shot_id = 'a'"), shots, "shot_id")
    assert sorted(map(tuple, good.collect())) == [("cinematography_0001", "a", 0.0, 1.5), ("cinematography_0003", "a", 0.0, 1.5)]
    with pytest.raises(Exception, match="unknown shot b"):
        retrieval.annotation_references(lines, shots, "shot_id").collect()
