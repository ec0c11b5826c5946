"""Frame motion, near titles, ordered folds across tasks, versioned tables, rounds and hand-overs."""

import html
import json
import os
import random
import unicodedata
from difflib import SequenceMatcher
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotloom.functions import canonical, scalars
from shotloom.operators import entity, folds, handover, merge, motion, planning, rounds, spanning, state
from shotloom.sources import readers
from shotloom.sources.versions import StaleVersion, VersionedTables

# frame motion


def score_by_loop(left, right, at, dx, dy):
    totals, counts = {}, {}
    for y in range(at.margin_y, at.height - at.margin_y):
        for x in range(at.margin_x, at.width - at.margin_x):
            if at.margin_y <= y - dy < at.height - at.margin_y and at.margin_x <= x - dx < at.width - at.margin_x:
                tile = ((x - at.margin_x) // at.tile_width, (y - at.margin_y) // at.tile_height)
                totals[tile] = totals.get(tile, 0) + abs(int(left[y - dy][x - dx]) - int(right[y][x]))
                counts[tile] = counts.get(tile, 0) + 1
    means = [totals[t] / counts[t] for t in totals]
    return median(means) / 255.0 if means else 0.0


def motion_by_loop(variants, scales, right, at):
    own = score_by_loop(variants[scales.index(1.0)], right, at, 0, 0)
    best = (own, 0, 0, 1.0)
    for scale, left in zip(scales, variants):
        for dy in range(-at.reach, at.reach + 1):
            for dx in range(-at.reach, at.reach + 1):
                score = score_by_loop(left, right, at, dx, dy)
                if score < best[0]:
                    best = (score, dx, dy, scale)
    return best[1] / at.width, best[2] / at.height, best[3] - 1.0, own, max(0.0, min(1.0, (own - best[0]) / max(own, 1e-6)))


@pytest.mark.parametrize("at", [motion.FrameGeometry(), motion.FrameGeometry(13, 11, 2, 1, 4, 3, 2), motion.FrameGeometry(6, 6, 2, 2, 8, 8, 3)])
def test_shift_search_by_plain_loop(spark, at):
    rng = np.random.default_rng(1)
    scales, rows, want = [0.96, 1.0, 1.04], [], []
    for k in range(6):
        base = rng.integers(0, 256, (at.height, at.width)) if k % 2 else np.add.outer(np.arange(at.height) * 5, np.arange(at.width) * 3) % 256
        right = np.roll(base, (k % 3, -(k % 2)), (0, 1)) if k else base
        variants = [rng.integers(0, 256, base.shape), base, np.roll(base, 1, 1)]
        rows.append((k, [int(v) for f in variants for v in f.ravel()], [int(v) for v in right.ravel()]))
        want.append((k, *motion_by_loop(variants, scales, right, at)))
    rows += [(10, None, rows[0][2]), (11, rows[0][1][:-1], rows[0][2]), (12, [256, *rows[0][1][1:]], rows[0][2]), (13, rows[0][1], [None, *rows[0][2][1:]])]
    df = spark.createDataFrame(rows, "k int, a array<int>, b array<int>").withColumn("dx", F.lit("clash"))
    got = motion.pair_measures(df, ["k"], "a", "b", at, tuple(scales)).orderBy("k").collect()
    assert [tuple(r) for r in got[:6]] == [pytest.approx(w, abs=0) for w in want]
    assert [tuple(r) for r in got[6:]] == [(k, None, None, None, None, None) for k in (10, 11, 12, 13)]
    assert motion.pair_measures(df.limit(0), ["k"], "a", "b", at, tuple(scales)).count() == 0


# titles and texts


def test_crossposts_by_all_pairs(spark):
    rng, rows = random.Random(2), []
    words = ["Straße", "STRASSE", "small", "smart", "bolt", "gear", "ring", "日本", "é"]
    for k in range(260):
        title = " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))
        rows.append((k, rng.choice(["a", "b", "c", None]), rng.choice(["Ann!", "ann", "Bob", "", None]), rng.choice([title, title, "", None]), rng.choice([10.0, 11.0, 12.5, 100.0, 104.0, None])))
    rows += [(1000 + k, rng.choice(["a", "b"]), "Ann", "the very same", 10.0) for k in range(60)]
    fold = lambda v: "".join(c for c in (v or "").casefold() if c.isalnum())
    want, compared = set(), 0
    for i, x in enumerate(rows):
        for y in rows[i + 1 :]:
            if x[1] is None or y[1] is None or x[1] == y[1] or not fold(x[2]) or fold(x[2]) != fold(y[2]) or not fold(x[3]) or not fold(y[3]) or x[4] is None or y[4] is None:
                continue
            compared += 1
            if SequenceMatcher(None, fold(x[3]), fold(y[3])).ratio() >= 0.72 and abs(x[4] - y[4]) <= max(2.0, 0.05 * max(x[4], y[4])):
                want.add((x[0], y[0]))
    df = spark.createDataFrame(rows, "id int, platform string, author string, title string, seconds double").withColumn("letters", F.lit("clash"))
    classes = entity.crosspost_classes(df, "id", "platform", "author", "title", "seconds").cache()
    pairs, bounded = entity.crosspost_pairs(classes).collect(), entity.bounded_pairs(classes).count()
    of = {}
    for r in rows:
        of.setdefault((r[1], fold(r[2]), fold(r[3]), r[4]), []).append(r[0])
    got = {(a, b) for p in pairs for a in of[p.l_platform, p.author, p.l_title, p.l_duration] for b in of[p.r_platform, p.author, p.r_title, p.r_duration] if a < b}
    assert got == want and len(pairs) <= bounded < compared
    links = {tuple(r) for r in entity.crosspost_links(df, "id", "platform", "author", "title", "seconds").collect()}
    assert links <= want and len(links) < len(want) and _parts(links) == _parts(want)


def _parts(links):
    root = {x: x for link in links for x in link}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


def test_texts_in_unicode(spark):
    rng = random.Random(3)
    pool = "aB ßẞﬁΣςσİıéé́ŉǅᾳẛ̣ \t日Å①½²_-"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    marked = ["a &eacute;&nbsp;b", "&#x27;&#39;&amp;lt;", "<b>x</b> &notanentity; &copy", "<>", "&lt;i&gt; <i>y", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, *marked])], "k int, t string")
    got = rows.select("k", "t", scalars.case_folded(F.col("t")).alias("f"), scalars.match_text(F.col("t")).alias("m"), scalars.normal_form(F.col("t")).alias("n"), scalars.inline_text(F.col("t")).alias("i"), scalars.clean_html(F.col("t")).alias("h")).collect()
    import re

    for r in got:
        if r.t is None:
            assert tuple(r)[2:] == (None,) * 5
            continue
        assert r.f == r.t.casefold() and r.m == "".join(c for c in r.t.casefold() if c.isalnum())
        assert r.n == unicodedata.normalize("NFC", r.t) and r.i == " ".join(unicodedata.normalize("NFC", r.t).split())
        assert r.h == " ".join(html.unescape(re.sub("<[^>]+>", "", r.t)).split())


def test_json_clocks(spark):
    raws = ['"1:02"', '"90.5"', "90.5", "-3", '" 7 "', "null", '"x"', None]
    got = [r.s for r in spark.createDataFrame([(k, v) for k, v in enumerate(raws)], "k int, v string").orderBy("k").select(scalars.json_clock(F.col("v")).alias("s")).collect()]
    assert got == [62.0, None, 90.5, 0.0, 7.0, None, None, None]


def test_canonical_json_is_what_python_writes(spark):
    rng = random.Random(4)
    schema = T.StructType.fromDDL("z double, `é` string, a struct<y: array<double>, x: map<string, long>, b: boolean>, B long, f array<struct<v: string>>")
    edge = [0.0, -0.0, 1e16, 9999999999999998.0, 1e-4, 9.999e-5, 5e-324, 1.7976931348623157e308, 2e-3, 0.1 + 0.2, 1e22, 1e23, 123456789012345680.0, 100.0, 2.0**-44, 1e100, 4.35, 2.2250738585072014e-308]
    number = lambda: rng.choice([rng.choice(edge), rng.random(), rng.uniform(-1e6, 1e6), rng.random() * 10.0 ** rng.randint(-320, 300), float(rng.randint(-(10**17), 10**17)), None])
    text = lambda: rng.choice([None, "", "".join(rng.choice('a"\\/\n\t\x00\x1f\x0b\x7fé日🎉</u000B') for _ in range(8))])
    rows = [(number(), text(), rng.choice([None, ([number() for _ in range(rng.randint(0, 3))], {text() or "k": rng.choice([None, 5]) for _ in range(3)}, rng.choice([True, None]))]), rng.choice([None, -(2**63), 7]), rng.choice([None, [], [(text(),)]])) for _ in range(700)]
    rows += [(e, None, None, None, None) for e in edge]
    df = spark.createDataFrame(rows, schema)
    got = sorted(r.j for r in df.select(canonical.row_json(df).alias("j")).collect())

    def plain(z, e, a, b, f):
        return {"z": z, "é": e, "a": a and {"y": a[0], "x": a[1], "b": a[2]}, "B": b, "f": f and [{"v": x[0]} for x in f] if f else f}

    assert got == sorted(json.dumps(plain(*r), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for r in rows)
    ids = df.select(canonical.frozen_id(df, "vmw", "z", "B").alias("i")).distinct().collect()
    assert all(r.i.startswith("vmw_") and len(r.i) == 24 for r in ids)
    bad = spark.createDataFrame([(float("nan"),)], "x double")
    with pytest.raises(Exception, match="finite"):
        bad.select(canonical.row_json(bad)).collect()


# ordered folds across tasks


def points_of(seed, n, step):
    rng, rows, at = random.Random(seed), [], 0
    for k in range(n):
        at += rng.choice([0, step // 3, step // 2, step - 1, step, 3 * step] if k % 50 else [5 * step])
        rows.append((rng.choice(["big"] * 9 + ["s"]), at, rng.choice([0.1, 0.5, 0.9]), k))
    return rows


@pytest.mark.parametrize("dense", [False, True])
def test_scene_points_of_a_key_that_spans_tasks(spark, dense):
    gap = 10**9 if dense else 100  # with a huge gap no point forgets the one before
    rows = points_of(5, 3000, 100)
    span = max(r[1] for r in rows) + (3 * gap if dense else 150)
    if dense:
        rows = [(k, at + gap, s, i) for k, at, s, i in rows]
    got = spanning.scene_points(spark.createDataFrame([*rows, ("none", 5, 1.0, -1), ("big", None, 1.0, -2)], "k string, at long, score double, id int"), spark.createDataFrame([("big", span), ("s", span)], "k string, d long"), "k", "at", "score", "id", "d", gap)
    want = []
    for key in ("big", "s"):
        kept = []
        for at, minus, i in sorted((at, -s, i) for k, at, s, i in rows if k == key and gap <= at <= span - gap):
            if kept and at - kept[-1][0] < gap:
                if -minus > kept[-1][1]:
                    kept[-1] = (at, -minus, i)
                continue
            kept.append((at, -minus, i))
        want += [(key, n, *row) for n, row in enumerate(kept, 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_near_anchors_of_a_key_that_spans_tasks(spark):
    rng, at, rows = random.Random(6), 0, []
    for k in range(4000):
        at += rng.choice([0, 100, 300, 599, 600, 601] if k % 100 else [5000])
        rows.append((rng.choice([None, "big", "big", "big"]), at, rng.choice(["scene_change", "interval", "interval", "source_end"] if k % 7 == 0 else ["scene_change", "interval"])))
    df = spark.createDataFrame(rows, "k string, at long, why string")
    want = sorted(map(str, map(tuple, folds.merge_near(df, "k", "at", "why").collect())))
    assert sorted(map(str, map(tuple, spanning.near_anchors(df, "k", "at", "why").collect()))) == want
    assert spanning.near_anchors(df.limit(0), "k", "at", "why").count() == 0


def test_line_numbers_over_many_splits(spark, tmp_path):
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    (tmp_path / "in").mkdir()
    for name, n in (("a", 3000), ("b", 2), ("c", 0)):
        (tmp_path / "in" / f"{name}.jsonl").write_text("".join(f'{{"n": {k}}}\n' + ("\n" if k % 5 == 0 else "") for k in range(n)))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 2000)
        spark.conf.set("spark.sql.files.openCostInBytes", 10)
        got = readers.read_ordered_json_lines(spark, str(tmp_path / "in"), "n int").collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert len(got) == 3002
    for r in got:
        assert r.ordinal == r.n + 1 and r.line_no == r.n + 1 + (r.n + 4) // 5


# versioned tables, rounds and hand-overs


def test_versions_compare_and_swap(spark, tmp_path):
    tables = VersionedTables(spark, str(tmp_path / "t"))
    rows = lambda *ids: spark.createDataFrame([(i, i % 3) for i in ids], "id int, bucket int")
    assert tables.latest() == 0 and tables.read("a") is None
    assert tables.commit(0, replace={"a": rows(1, 2)}, append={"log": rows(1)}, notes={"n": 1}) == 1
    with pytest.raises(StaleVersion):
        tables.commit(0, replace={"a": rows(9)})
    with pytest.raises(StaleVersion):  # another writer was faster, after this one had looked
        tables._publish(1, {"tables": {}, "notes": {}})
    tables.commit(1, append={"log": rows(2)}, buckets={"b": (rows(0, 1, 2, 3), "bucket", [0, 1, 2])})
    tables.commit(2, buckets={"b": (rows(4), "bucket", [1, 2])})
    assert sorted(r.id for r in tables.read("b").collect()) == [0, 3, 4] and [r.id for r in tables.read("b", parts=[1]).collect()] == [4]
    assert sorted(r.id for r in tables.read("log").collect()) == [1, 2] and tables.read("log", 1).count() == 1 and tables.notes() == {"n": 1}
    assert tables.compact("log", 1) == 4 and len(tables.commit_of(4)["tables"]["log"]["parts"]["all"]) == 1
    spark.createDataFrame([(1,)], "x int").write.parquet(str(tmp_path / "t" / "data" / "left-behind"))
    assert tables.vacuum(1) >= 2 and sorted(r.id for r in tables.read("log").collect()) == [1, 2] and tables.read("a").count() == 2
    assert not (tmp_path / "t" / "data" / "left-behind").exists()


PLANS = "plan string, platforms array<string>, facets array<string>, max_rounds int, max_videos long"
DECISIONS = "plan string, round_number int, status string, occupied long, history array<string>, assessments array<struct<facet_id: string, status: string, reason: string>>, gaps array<struct<gap_id: string, description: string, facet_ids: array<string>>>"
QUERIES = "plan string, query_id string, platform string, language string, text string, facet_ids array<string>, budget int"


def test_rounds_equal_a_plain_model(spark, tmp_path):
    plans = [("p1", ["x", "y"], ["f", "g"], 4, 10), ("p2", ["x"], ["f"], 2, 50), ("p3", ["x"], ["f"], 9, 3)]
    first = [("p1", "q1", "x", "en", "Ein  TEST", ["f"], None), ("p1", "q2", "y", "en", "b", ["g"], 5), ("p2", "q1", "x", "en", "a", ["f"], 1), ("p3", "q1", "x", "en", "a", ["f"], 1)]
    asked = {"p1": {"x:ein test", "y:b"}, "p2": {"x:a"}, "p3": {"x:a"}}
    facets = {p[0]: p[2] for p in plans}

    def said(number):
        decisions, queries = [], []
        for name, platforms, own, *_ in plans:
            decisions.append((name, number, "insufficient", 3 * number, sorted(asked[name]), [(f, "missing", "why") for f in own], [("g1", "lacks", own[:1])]))
            queries += [(name, f"q{k}", p, "en", f"straße {number}", own, None) for k, p in enumerate(platforms)]
        return decisions, queries

    def decide(number, tables):
        decisions, queries = said(number)
        for q in queries:
            asked[q[0]].add(f"{q[2]}:{q[4].casefold()}")
        return spark.createDataFrame(decisions, DECISIONS), spark.createDataFrame(queries, QUERIES)

    tables = VersionedTables(spark, str(tmp_path / "r"))
    last = rounds.run_rounds(tables, spark.createDataFrame(plans, PLANS), spark.createDataFrame(first, QUERIES), decide, 8)
    want, problems = [], []
    for name, _, _, most_rounds, most_videos in plans:
        number, occupied = 1, 0
        while True:
            left, slots = most_rounds - number + 1, most_videos - occupied
            if left < 1 or slots < 1:
                break
            want.append((name, number, occupied, left, slots, -(-slots // left)))
            occupied, number = 3 * number, number + 1
    assert sorted(map(tuple, tables.read("rounds").collect())) == sorted(want)
    assert last == max(w[1] for w in want) and {r.problem for r in tables.read("problems").collect()} >= {"max_rounds", "max_videos"}
    del problems, facets
    again = rounds.run_rounds(tables, spark.createDataFrame(plans, PLANS), spark.createDataFrame(first, QUERIES), decide, last)
    assert again == last  # all of them are committed
    plan = tables.read("rounds")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("\n") < 5


def test_each_problem_of_a_round(spark):
    good = dict(round_number=2, status="insufficient", occupied=1, history=["x:Old", "y:old"], assessments=[("f", "covered", "r"), ("g", "partial", "r")], gaps=[("1", "d", ["f"])])
    ask = [("q1", "x", "en", "new", ["f"], None), ("q2", "y", "de", "new", ["g"], 100)]
    cases = {
        "none": ({}, ask),
        "status": ({"status": "covered"}, ask),
        "round_number": ({"round_number": 1}, ask),
        "history": ({"history": ["x:old"]}, ask),
        "facet_assessment": ({"assessments": [("f", "covered", "r"), ("f", "covered", "r")]}, ask),
        "gap": ({"gaps": [("1", " ", ["f"])]}, ask),
        "no_queries": ({}, []),
        "query": ({}, [*ask, ("q3", "x", "en", "other", ["h"], 1)]),
        "repeated_query": ({}, [*ask, ("q3", "x", "en", " OLD ", ["f"], 1)]),
        "duplicate_query": ({}, [*ask, ("q1", "x", "en", "other", ["f"], 1)]),
        "platform_without_query": ({}, ask[:1]),
        "languages": ({}, [*ask, ("q3", "x", "fr", "other", ["f"], 1)]),
        "max_rounds": ({}, ask),
        "max_videos": ({"occupied": 9}, ask),
    }
    plans = [(name, ["x", "y"], ["f", "g"], 2 if name == "max_rounds" else 5, 9) for name in cases]
    decisions = [(name, *({**good, **change}[k] for k in ("round_number", "status", "occupied", "history", "assessments", "gaps"))) for name, (change, _) in cases.items()]
    queries = [(name, *q) for name, (_, asks) in cases.items() for q in asks]
    held = [(name, k, f"{p}:old") for name in cases for k, p in ((1, "x"), (2, "y"))]
    frames = [spark.createDataFrame(plans, PLANS), spark.createDataFrame([(n, k, 0, 1, 1, 1) for n in cases for k in (1, 2)], rounds.ROUND), spark.createDataFrame(held, rounds.ASKED)]
    frames += [spark.createDataFrame([*decisions, ("lost", *decisions[0][1:])], DECISIONS), spark.createDataFrame(queries, QUERIES)]
    got = {}
    for r in rounds.round_problems(*frames).collect():
        got.setdefault(r.plan, set()).add(r.problem)
    assert got.pop("lost") == {"unknown_plan"} and got.pop("no_queries") == {"no_queries", "platform_without_query"}
    assert got == {name: {name} for name in cases if name not in ("none", "no_queries")}


def hand_over_tables(spark, path, attempts=1):
    tables = VersionedTables(spark, path)
    jobs = ["good", "bad", "third"]
    number = {"good": attempts, "bad": attempts, "third": 3}
    requests = spark.createDataFrame([(j, "r", "h", "c", f"{j}{number[j]}", 100_000) for j in jobs], "job_id string, request_id string, request_hash string, context_hash string, attempt_id string, duration_ms long")
    tried = spark.createDataFrame([(j, f"{j}{k}", k, None, None) for j in jobs for k in range(1, number[j] + 1)], "job_id string, attempt_id string, number int, result_hash string, n_problems long")
    results = spark.createDataFrame([], "job_id string, attempt_id string, result_hash string")
    tables.commit(0, replace={"requests": requests, "attempts": tried, "results": results, "states": spark.createDataFrame([(j, "awaiting_subagent") for j in jobs], "job_id string, state string")})
    return tables, number


def test_import_of_results(spark, tmp_path):
    tables, number = hand_over_tables(spark, str(tmp_path / "h"))
    result = lambda *jobs, digest="d": spark.createDataFrame([(j, "r", "h", "c", f"{j}{number[j]}", digest) for j in jobs], "job_id string, request_id string, request_hash string, context_hash string, attempt_id string, result_hash string")
    segment = "job_id string, ordinal int, segment_id string, start_ms long, end_ms long, start_anchor string, end_anchor string, refs array<string>"
    sound = [("good", 0, "s0", 0, 40_000, "a", "b", ["e"]), ("good", 1, "s1", 40_050, 99_960, "b", "z", ["e", "e"])]
    broken = [(j, 0, "s", 60, 40_000, "a", "none", ["x"]) for j in ("bad", "third")] + [(j, 1, "s", 40_000, 50_000, "b", "z", None) for j in ("bad", "third")]
    segments = spark.createDataFrame(sound + broken, segment)
    anchors = spark.createDataFrame([(j, a, t) for j in ("good", "bad", "third") for a, t in (("a", 0), ("b", 40_010), ("z", 100_000))], "job_id string, anchor_id string, at_ms long")
    evidence = spark.createDataFrame([(j, "e") for j in ("good", "bad", "third")], "job_id string, evidence_id string")
    requests = tables.read("requests")
    told = {(r.job_id, r.segment_id, r.problem) for r in handover.result_problems(requests, result("good", "bad"), segments, anchors, evidence).collect()}
    assert told == {("bad", "s", p) for p in ("timeline_gap_or_overlap", "start_anchor_time_mismatch", "unknown_end_anchor", "unknown_evidence_ref", "duplicate_segment_id", "end_anchor_time_mismatch")} | {("bad", None, "timeline_duration_mismatch")}
    first = handover.import_results(tables, result("good", "bad", "third"), segments, anchors, evidence)
    want = {("good", "ready_to_resume", 1, 0), ("bad", "repair_required", 1, 7), ("third", "failed", 3, 7)}
    assert {tuple(r) for r in first.collect()} == want and tables.latest() == 2
    assert {tuple(r) for r in tables.read("states").collect()} == {("good", "subagent_ready"), ("bad", "awaiting_subagent"), ("third", "failed")}
    again = handover.import_results(tables, result("good", "bad", "third"), segments, anchors, evidence)
    assert {tuple(r) for r in again.collect()} == want and tables.latest() == 2  # nothing changed
    with pytest.raises(ValueError):
        handover.import_results(tables, result("good", digest="other"), segments, anchors, evidence)


def test_a_stale_import_leaves_the_tables(spark, tmp_path, monkeypatch):
    tables, number = hand_over_tables(spark, str(tmp_path / "h"))
    empty = lambda ddl: spark.createDataFrame([], ddl)
    result = spark.createDataFrame([("bad", "r", "h", "c", "bad1", "d")], "job_id string, request_id string, request_hash string, context_hash string, attempt_id string, result_hash string")
    rest = (empty("job_id string, ordinal int, segment_id string, start_ms long, end_ms long, start_anchor string, end_anchor string, refs array<string>"), empty("job_id string, anchor_id string, at_ms long"), empty("job_id string, evidence_id string"))
    write = VersionedTables._write

    def slow(self, name, rows, column=None):
        path = write(self, name, rows, column)
        if self is tables and name == "states":  # meanwhile another writer commits
            VersionedTables(spark, tables.folder).commit(1, notes={"other": True})
        return path

    monkeypatch.setattr(VersionedTables, "_write", slow)
    with pytest.raises(StaleVersion):
        handover.import_results(tables, result, *rest)
    assert tables.notes() == {"other": True} and tables.read("attempts").where("result_hash is not null").isEmpty()
    assert {r.state for r in tables.read("states").collect()} == {"awaiting_subagent"}


def test_evidence_chains_and_attempts(spark):
    rows = spark.createDataFrame([("j", k, c, m) for k, c, m in [(1, 4, 9), (2, 5, 9), (3, 2, 9), (4, 0, 9)]] + [("k", k, None, 2) for k in range(4)], "job string, at int, cost int, most int")
    got = {(r.job, r["at"], r.position, r.spent) for r in handover.evidence_prefix(rows, "job", ["at"], F.col("most"), "cost", F.lit(10)).collect()}
    assert got == {("j", 1, 1, 4), ("j", 2, 2, 9), ("k", 0, 1, 0), ("k", 1, 2, 0)}  # 3 would cost 11; 4 would fit, but comes after it
    chain = [("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "gone"), ("f", "e"), ("x", "y"), ("y", "x")]
    got = {tuple(r) for r in handover.attempt_chains(spark.createDataFrame(chain, "id string, prior string"), "id", "prior").collect()}
    assert got == {("a", "a", 1, None), ("b", "a", 2, None), ("c", "a", 3, None), ("d", "a", 4, "too_long"), ("e", "e", 1, "missing_prior"), ("f", "e", 2, "missing_prior"), ("x", None, None, "endless"), ("y", None, None, "endless")}
    jobs = spark.createDataFrame([("new", 200_000, None, None), ("small", 1000, None, False), ("none", None, 1, False), ("full", 600_000, 0, False), ("waits", 200_000, 1, False), ("again", 200_000, 1, True), ("out", 200_000, 1, True), ("early", 200_000, 1, True)], "job_id string, context_tokens long, slots int, repair boolean")
    tried = spark.createDataFrame([("waits", "w1", 1), ("again", "g1", 1), ("again", "g2", 2), ("out", "o3", 3)], "job_id string, attempt_id string, number int")
    got = {r.job_id: (r.decision, r.number, r.prior_attempt_id) for r in handover.next_attempts(jobs, tried).collect()}
    assert got == {"new": ("prepared", 1, None), "small": ("context_below_minimum", 0, None), "none": ("context_required", 0, None), "full": ("no_capacity", 0, None), "waits": ("awaiting", 1, "w1"), "again": ("prepared", 3, "g2"), "out": ("repair_exhausted", 3, "o3"), "early": ("repair_exhausted", 0, None)}


# merge plans, admission


def test_each_rule_of_a_merge_plan(spark):
    cand = [(0, "c0", 0, 10, None, "b1"), (1, "c1", 10, 20, "b1", "b2"), (2, "c2", 20, 30, "b2", "b3"), (3, "c3", 30, 40, "b3", None)]
    dec = [("b1", "remove"), ("b2", "review"), ("b3", "keep")]
    good = [(0, 0, 20, ["c0", "c1"], ["b1"], ["b2"]), (1, 20, 30, ["c2"], [], []), (2, 30, 40, ["c3"], [], [])]
    change = lambda k, i, v: [tuple(v if (n, m) == (k, i) else x for m, x in enumerate(row)) for n, row in enumerate(good)]
    cases = {
        "fine": (good, dec, cand, set()),
        "no_segments": ([], dec, cand, {"no_segments"}),
        "candidates": (change(0, 3, ["c1", "c0"]), dec, cand, {"candidates", "first_member", "last_member", "not_adjacent", "boundary_between", "crosses_kept", "removed_ids", "review_place"}),
        "ordinal": (change(2, 0, 3), dec, cand, {"ordinal"}),
        "gap": (change(1, 1, 21), dec, cand, {"gap", "first_member"}),
        "beyond": (change(2, 2, 41), dec, cand, {"beyond_duration", "last_member", "end_of_timeline"}),
        "last": (change(2, 2, 39), dec, cand, {"last_member", "end_of_timeline"}),
        "kept": (good, [("b1", "keep"), *dec[1:]], cand, {"crosses_kept", "removed_account"}),
        "removed": (change(0, 4, []), dec, cand, {"removed_ids", "removed_account"}),
        "review": (change(0, 5, ["b3"]), dec, cand, {"review_unknown", "review_place", "review_account"}),
        "unreviewed": (change(0, 5, []), dec, cand, {"review_account"}),
        "place": ([good[0][:5] + ([],), good[1][:5] + (["b2"],), good[2]], dec, cand, {"review_place"}),
        "adjacent": (good, dec, [cand[0], (1, "c1", 11, 20, "b1", "b2"), *cand[2:]], {"not_adjacent"}),
        "between": (good, dec, [cand[0], (1, "c1", 10, 20, "b9", "b2"), *cand[2:]], {"boundary_between"}),
        "missing": (good, dec[:2], cand, {"missing_decision"}),
        "double": (good, [*dec, dec[2]], cand, {"duplicate_decision"}),
        "unknown": (good, [*dec, ("b7", "keep")], cand, {"unknown_decision"}),
    }
    rows = lambda part, ddl: spark.createDataFrame([(name, *row) for name, case in cases.items() for row in case[part]], "job_id string, " + ddl)
    got = {name: set() for name in cases}
    found = merge.merge_plan_problems(rows(0, "ordinal int, start_ms long, end_ms long, candidate_ids array<string>, removed_ids array<string>, review_ids array<string>"), rows(2, "ordinal int, candidate_id string, start_ms long, end_ms long, left_boundary string, right_boundary string"), rows(1, "boundary_id string, decision string"), spark.createDataFrame([(name, 40) for name in cases], "job_id string, duration_ms long"))
    for r in found.collect():
        got[r.job_id].add(r.problem)
    assert got == {name: case[3] for name, case in cases.items()}


def test_fifty_plans_in_order(spark):
    rng = random.Random(7)
    plans = [f"p{k:02d}" for k in range(50)]
    rows = [(p, rng.choice(["youtube", "tiktok"]), u, rng.random()) for p in plans for u in rng.sample(range(40), 6)]
    df = spark.createDataFrame(rows, "plan string, platform string, unit int, rank double")
    got = {(r.plan, r.unit) for r in planning.admit_in_order(df, plans, "plan", "platform", "unit", [F.asc("rank")], 2).collect()}
    taken, want = set(), set()
    for p in plans:
        lists = {q: sorted((r, u) for pl, q2, u, r in rows if pl == p and q2 == q and u not in taken) for q in ("youtube", "tiktok")}
        turn, picked = 0, []
        while len(picked) < 2 and any(len(v) > turn for v in lists.values()):
            picked += [v[turn][1] for v in lists.values() if len(v) > turn]
            turn += 1
        want |= {(p, u) for u in picked[:2]}
        taken |= set(picked[:2])
    assert got == want


def test_active_ids_in_order(spark):
    df = spark.createDataFrame([("g", 3, True), ("g", 1, True), ("g", 2, False), ("h", 5, False)], "g string, id int, on boolean")
    assert [tuple(r) for r in state.active_ids(df, "g", F.col("on"), "id").orderBy("place").collect()] == [("g", 1, 1), ("g", 2, 3)]


# payloads


def test_end_of_searches_and_ids(spark):
    said = lambda platform, *bodies: {r.k: r.exhausted for r in readers.search_exhausted(spark.createDataFrame([(k, json.dumps(b)) for k, b in enumerate(bodies)], "k int, body string"), platform, "k", "body", 2).collect()}
    assert said("douyin", {"has_more": False}, {"has_more": 0}, {"has_more": 1}, {"has_more": True}, {}) == {0: True, 1: True, 2: False, 3: False, 4: False}
    assert said("xiaohongshu", {"data": {"has_more": False}}, {"data": {"has_more": True}}) == {0: True, 1: False}
    video = {"bvid": "BV1ab2cd3EFg", "title": "a &eacute;", "duration": 90.5}
    assert said("bilibili", {"data": {"result": [video], "numResults": 1}}, {"data": {"result": [video], "numResults": 2}}, {"data": {"result": [video]}}) == {0: True, 1: False, 2: False}
    assert said("youtube", {"entries": [{"id": "1", "title": "t"}]}, {"entries": [{"id": "1", "title": "t"}, {"id": "2", "title": "t"}]}) == {0: True, 1: False}
    rows = lambda platform, body: readers.search_candidates(spark.createDataFrame([(1, json.dumps(body))], "k int, body string"), platform, "k", "body").collect()
    got = rows("bilibili", {"data": {"result": [video, {**video, "duration": "1:30"}, {**video, "duration": "90.5"}]}})
    assert [r.duration_seconds for r in got] == [90.5, 90.0, None] and got[0].title == "a é"
    for platform, body in (("bilibili", {"data": {"result": [{**video, "bvid": "BV1"}]}}), ("douyin", {"data": [{"aweme_id": "12"}]}), ("xiaohongshu", {"data": {"items": [{"id": "zz"}]}})):
        with pytest.raises(Exception, match="without source_id"):
            rows(platform, body)


# streams


def in_files(tmp_path, rows, size=20):
    (tmp_path / "in").mkdir()
    for n in range(0, len(rows), size):
        path = tmp_path / "in" / f"{n:05d}.json"
        path.write_text("\n".join(json.dumps(r) for r in rows[n : n + size]) + "\n")
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))
    return str(tmp_path / "in")


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def run_stream(stream, tmp_path):
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(200)
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / "out"))


def test_leases_of_a_stream(spark, tmp_path, rocks):
    from shotloom.streaming import leases

    rng, at, beats = random.Random(8), 1_700_000_000_000, []
    for _ in range(102):
        at += rng.choice([1000, 9000, 31_000])
        beats.append({"key": rng.choice("abc"), "owner": "o", "at": at})
    beats += [{"key": "a", "owner": "o", "at": at + 1000}, {"key": "a", "owner": "p", "at": at + 2000}, {"key": "a", "owner": "p", "at": at + 31_000}]
    beats += [{"key": "a", "owner": "o", "at": at - 500}, {"key": "z", "owner": "o", "at": at + 10**7}, {"key": "z", "owner": "o", "at": at + 2 * 10**7}]
    stream = spark.readStream.schema("key string, owner string, at long").option("maxFilesPerTrigger", 1).json(in_files(tmp_path, beats, 21)).select("key", "owner", F.timestamp_millis("at").alias("at")).withWatermark("at", "1 second")
    got = run_stream(leases.leases(stream, 30_000), tmp_path).collect()
    batch = leases.lease_events(spark.createDataFrame([(b["key"], b["owner"], b["at"]) for b in beats[:102]], "key string, owner string, at_ms long"), 30_000)
    told = {tuple(r) for r in got if r.event in ("acquired", "renewed") and r.at_ms <= at}
    assert told == {tuple(r) for r in batch.collect()}
    late = [(r.event, r.owner) for r in got if r.key == "a" and r.at_ms in (at + 2000, at + 31_000, at - 500) and r.event != "expired"]
    assert sorted(late) == [("acquired", "p"), ("late", "o"), ("refused", "p")]
    generations = {(r.key, r.generation) for r in got if r.event == "acquired"}
    expired = [(r.key, r.generation) for r in got if r.event == "expired"]
    assert len(expired) == len(set(expired)) and set(expired) == generations - {("z", 2)}


def test_jobs_are_followed_until_their_end_was_told_twice(spark, tmp_path, rocks):
    from shotloom.streaming import leases

    rng, events = random.Random(9), []
    for k in range(150):
        events.append({"job_id": rng.choice("abcd"), "event_id": f"e{k:03d}", "state": rng.choice(["running", "running", "failed", "succeeded"]), "at": 1_700_000_000_000 + k * 1000})
    events = [e for k, e in enumerate(events) for _ in range(2 if k % 9 == 0 else 1)]
    schema = "job_id string, event_id string, state string, at long"
    timed = lambda df: df.select("job_id", "event_id", "state", F.timestamp_millis("at").alias("at"))
    stream = timed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(in_files(tmp_path, events)))
    got = sorted(map(tuple, run_stream(leases.follow_jobs(stream), tmp_path).collect()))
    want = leases.followed(timed(spark.createDataFrame([tuple(e.values()) for e in events], schema)))
    first_seen = {}
    for r in got:
        first_seen.setdefault(r[5], r)
    assert sorted(first_seen.values()) == sorted(map(tuple, want.select("job_id", "event", "seen", "state", "at_ms", "event_id").collect()))
    assert sum(r[1] == "closed" for r in got) == 4
