"""Evidence operators, file names and hashes, and the queries against their SQL."""

import hashlib
import json
import random
import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from shotloom.functions import scalars
from shotloom.operators import evidence
from shotloom.plans import evidences
from shotloom.sources import readers, writers

FOLDER = "/root/testdata/sf0.001"


def norm(rows):
    return sorted(tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(evidences.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "customer", "part", "events", "conversations", "documents", "pages"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    got = evidences.QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    want = con.execute(f"select {', '.join(columns)} from ({evidences.ORACLE_SQL[name]})").fetchall()
    assert norm(got.select(*columns).collect()) == norm(want)


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()[:8]


def test_safe_titles(spark):
    given = ["plain title", "a/b", " x. ", "", "con", "COM1.txt", "ﬁne", "long " * 30, "a\tb", None, "中文 标题"]
    rows = spark.createDataFrame([(x,) for x in given], "x string").select("x", scalars.safe_title(F.col("x"), 40).alias("y"), scalars.safe_identity(F.col("x")).alias("z"), scalars.safe_identity(F.col("x"), 0).alias("d"))
    got = {r.x: (r.y, r.z, r.d) for r in rows.collect()}
    want = {"plain title": "plain title", "中文 标题": "中文 标题", "a/b": "a_b--", " x. ": "x--", "": "untitled--", "con": "_con--", "COM1.txt": "_COM1.txt--", "ﬁne": "fine--", "a\tb": "a_b--"}
    for x, y in want.items():
        assert got[x][0] == (y + digest(x) if y.endswith("--") else y)
        assert got[x][2] == digest(x)
    assert got["long " * 30][0] == ("long " * 30)[:30].rstrip() + "--" + digest("long " * 30) and got[None] == (None, None, None)
    assert got["a/b"][1] == "a_b--" + digest("a/b") and got[""][1] == "id--" + digest("")


def test_words_and_hashes(spark):
    rng = random.Random(8)
    raw = [b"", *(bytes(rng.randrange(256) for _ in range(4 * n)) for n in (1, 5, 30))]
    rows = spark.createDataFrame([(bytearray(x),) for x in raw], "x binary").select("x", scalars.unpack_words(F.col("x")).alias("w")).collect()
    for r in rows:
        assert r.w == [v for (v,) in struct.iter_unpack("<I", bytes(r.x))]
    with pytest.raises(Exception, match="malformed"):
        spark.createDataFrame([(bytearray(b"abc"),)], "x binary").select(scalars.unpack_words(F.col("x"))).collect()
    frames = [[rng.randrange(256) for _ in range(72)] for _ in range(20)]
    got = spark.createDataFrame([(f,) for f in frames], "p array<int>").select("p", scalars.difference_hash(F.col("p")).alias("h")).collect()
    for r in got:
        bits = "".join("1" if r.p[k // 8 * 9 + k % 8] > r.p[k // 8 * 9 + k % 8 + 1] else "0" for k in range(64))
        assert r.h % (1 << 64) == int(bits, 2)
    assert spark.createDataFrame([([1, 2],)], "p array<int>").select(scalars.difference_hash(F.col("p"))).first()[0] is None


def test_probes_without_streams(spark):
    probes = [
        (1, json.dumps({"format": {"duration": "2.5"}, "streams": []})),
        (2, json.dumps({"format": {}, "streams": [{"codec_type": "audio", "duration": "3"}, {"codec_type": "video", "width": 4, "height": 3, "duration": "x"}]})),
        (3, json.dumps({"streams": [{"codec_type": "subtitle", "codec_name": "ass", "tags": {"language": "fr"}}, {"codec_type": "subtitle", "codec_name": "ass", "tags": {"language": "en"}}, {"codec_type": "subtitle", "codec_name": "hdmv_pgs"}]})),
    ]
    frame = spark.createDataFrame(probes, "id int, content string")
    got = {r.id: tuple(r)[1:] for r in evidence.probe_facts(frame, "id", "content").collect()}
    assert got == {1: (2500, None, None, 0, 0), 2: (3000, 4, 3, 1, 0), 3: (None, None, None, 0, 3)}
    assert [tuple(r) for r in evidence.choose_stream(frame, "id", "content", ("zh", "en")).collect()] == [(3, 1, "en")]


def test_motion_shapes(spark):
    shots = {"steady": [0.01] * 6, "faster": [0.01, 0.01, 0.05, 0.05], "slower": [0.05, 0.05, 0.01, 0.01], "turning": [0.01, -0.01, 0.01], "one": [0.01]}
    rows = [(k, n, x, 0.0, 0.0) for k, xs in shots.items() for n, x in enumerate(xs)]
    out = evidence.motion_summaries(spark.createDataFrame(rows, "k string, n int, dx double, dy double, ds double"), "k", ["n"], "dx", "dy", "ds")
    got = {r.k: (r.profile, r.n_turns) for r in out.collect()}
    assert got == {"steady": ("constant", 0), "faster": ("accelerating", 0), "slower": ("decelerating", 0), "turning": ("variable", 2), "one": ("unknown", 0)}


def test_retries_and_ranges(spark):
    held = spark.createDataFrame([(j, s) for j in "ab" for s in ("probe", "plan", "render")], "job string, stage string")
    retries = spark.createDataFrame([("a", "render"), ("a", "plan"), ("b", "no such stage")], "job string, from_stage string")
    got = {(r.job, r.stage): r.valid for r in evidence.invalidated(held, retries, "job", "stage", ("probe", "plan", "render")).collect()}
    assert got == {("a", "probe"): True, ("a", "plan"): False, ("a", "render"): False, ("b", "probe"): True, ("b", "plan"): True, ("b", "render"): True}
    ranges = spark.createDataFrame([("x", 0.0, 1.0), ("y", -1.0, -1.0), ("z", None, 1.0)], "clip string, a double, b double")
    assert sorted(map(tuple, evidence.range_audit(ranges, "clip", "a", "b").collect())) == [("y", "negative_start"), ("y", "not_half_open"), ("z", "missing_bound")]


def test_evidence_packages(spark):
    good = json.dumps({"frames": [{"frame_id": "f2", "timestamp_ms": 5, "path": "b"}, {"frame_id": "f1", "timestamp_ms": 1, "path": "a"}], "transcript": [{"start_ms": 0, "end_ms": 5, "text": ""}]})
    frames, spans = readers.evidence_packages(spark.createDataFrame([(1, good)], "id int, content string"), "id", "content")
    assert [(r.position, r.frame_id, r.package_sha256) for r in frames.orderBy("position").collect()] == [(k, f, hashlib.sha256(good.encode()).hexdigest()) for k, f in enumerate(("f2", "f1"))]
    assert spans.first().end_ms == 5
    for bad in ({"transcript": []}, {"frames": [{"frame_id": "f", "path": "a"}], "transcript": []}):
        with pytest.raises(Exception, match="incomplete frames in package 7"):
            readers.evidence_packages(spark.createDataFrame([(7, json.dumps(bad))], "id int, content string"), "id", "content")[0].collect()


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "t")
    writers.write_snapshot(spark.range(3), root, 1)
    writers.write_snapshot(spark.range(5), root, 2)
    assert readers.read_snapshot(spark, root, 1).count() == 3 and readers.read_snapshot(spark, root, 2).count() == 5
    with pytest.raises(Exception, match="(?i)exists"):
        writers.write_snapshot(spark.range(1), root, 2)
