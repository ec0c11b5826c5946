"""Scalars, manifest, entity, planning, state, readers, sinks and streams."""

import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from shotloom import schemas
from shotloom.functions import scalars
from shotloom.operators import entity, graph, manifest, planning, reports, selection, state
from shotloom.sources import readers, writers
from shotloom.streaming import jobs


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_scalars(spark):
    r = one(
        spark,
        a=scalars.collapse_spaces(F.lit("  x \t\n y ")),
        b=scalars.clock_seconds(F.lit("1:02:03")),
        c=scalars.clock_seconds(F.lit("x")),
        d=scalars.clock_text(F.lit(3_723_004)),
        e=scalars.subtitle_ms(F.lit("01:02:03,004")),
        f=scalars.ratio(F.lit("16:9")),
        g=scalars.ratio(F.lit("0:9")),
        h=scalars.rational(F.lit("30000/1001")),
        i=scalars.rational(F.lit("1/0")),
        j=scalars.canonical_url(F.lit("HTTPS://WWW.Example.com/A/b?x=1#f")),
        k=scalars.context_tier(F.lit(300_000)),
        l=scalars.context_tier(F.lit(5)),
        m=F.array_join(scalars.ordered_distinct(F.array(F.lit(" b "), F.lit("a"), F.lit("b"), F.lit(" "))), ","),
        n=scalars.safe_id(F.lit("ok-1.x")),
        o=scalars.safe_id(F.lit("-no")),
        p=scalars.epoch_iso(F.lit(0)),
        q=scalars.epoch_iso(F.lit(1)),
        s=scalars.span_ms(F.lit(None), F.lit(0.0025)),
        t=scalars.hamming(F.lit(-1).cast("long"), F.lit(0).cast("long")),
        u=scalars.clean_html(F.lit("<b>a</b> &amp;\n b")),
        v=scalars.match_text(F.lit("A-b c!")),
        w=scalars.multiline_text(F.lit("a  \r\nb\t\n")),
    )
    assert (r.a, r.b, r.c, r.d, r.e) == ("x y", 3723, None, "01:02:03.004", 3_723_004)
    assert r.f == pytest.approx(16 / 9) and r.g is None and r.h == pytest.approx(29.97, abs=0.001) and r.i is None
    assert (r.j, r.k, r.l, r.m, r.n, r.o, r.p, r.q, r.s, r.t) == ("https://www.example.com/A/b", "256k", None, "b,a", True, False, None, "1970-01-01T00:00:01Z", 2, 64)
    assert (r.u, r.v, r.w) == ("a & b", "abc", "a\nb")


def test_geometry(spark):
    r = one(spark, a=scalars.geometry_disposition(scalars.display_ratio(F.lit(1080.0), F.lit(1920.0), 1.0, 90)), b=scalars.geometry_disposition(scalars.display_ratio(F.lit(1440.0), F.lit(1080.0), 4 / 3)), c=scalars.geometry_disposition(scalars.display_ratio(F.lit(4.0), F.lit(3.0))), d=scalars.geometry_disposition(scalars.display_ratio(F.lit(0.0), F.lit(3.0))))
    assert tuple(r) == ("accepted", "accepted", "rejected", "unknown")


def test_aligned_similarity_model(spark):
    rng = random.Random(3)
    rows = [([rng.getrandbits(63) for _ in range(rng.randint(0, 9))], [rng.getrandbits(63) for _ in range(rng.randint(0, 9))]) for _ in range(40)]

    def model(a, b):
        best = 0.0
        for s in range(-4, 5):
            x, y = a[max(s, 0) :], b[max(-s, 0) :]
            n = min(len(x), len(y))
            if n:
                best = max(best, 1 - sum((p ^ q).bit_count() for p, q in zip(x, y)) / (n * 64))
        return best

    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(rows)], "k int, a array<long>, b array<long>")
    for r in df.select("*", scalars.aligned_similarity(F.col("a"), F.col("b")).alias("s")).collect():
        assert r.s == pytest.approx(model(r.a, r.b))


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)] + [(k, k + 1) for k in range(200, 260)] + [(None, 3), (5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_upsert_keeps_known_and_least(spark):
    rows = [("c", 1, "t1", "a", 3), ("c", 2, "t2", None, 1), ("c", 3, None, None, 2)]
    df = spark.createDataFrame(rows, "id string, seq int, title string, author string, rank int")
    r = manifest.upsert(df, ["id"], ["seq"], ["title"], ["author"], ["rank"]).first()
    assert (r.title, r.author, r.rank, r.n_arrivals) == (None, "a", 1, 3)


def test_approved_is_reset_but_rejected_sticks(spark):
    rows = [("u", 1, "discovered"), ("u", 2, "approved"), ("u", 3, "discovered"), ("u", 4, "rejected"), ("u", 5, "discovered")]
    df = spark.createDataFrame(rows, "u string, seq int, status string")
    got = [r.held for r in manifest.sticky_state(df, "u", ["seq"], "status").orderBy("seq").collect()]
    assert got == ["discovered", "approved", "discovered", "rejected", "rejected"]


def test_review_decisions(spark):
    units = spark.createDataFrame([("a", "manual_review_required"), ("b", "proxy_ready"), ("c", "duration_unknown")], "media_unit_id string, status string")
    d = spark.createDataFrame([("a", True, "me", 1), ("a", False, "me", 2), ("b", True, "me", 1)], "media_unit_id string, approved boolean, actor string, decided_at int")
    got = {r.media_unit_id: (r.status, r.applied) for r in manifest.decide_review(units, d).collect()}
    assert got == {"a": ("rejected", True), "b": ("proxy_ready", False), "c": ("duration_unknown", None)}


def test_fingerprints(spark):
    schema = "id int, l_audio_hashes array<long>, r_audio_hashes array<long>, l_video_hashes array<long>, r_video_hashes array<long>, l_duration_seconds double, r_duration_seconds double"
    rows = [(1, [1, 2], [1, 2], [5], [5], 10.0, 11.0), (2, [1], [1], [0], [-1], 10.0, 10.0), (3, [], [1], [1], [1], 1.0, 1.0), (4, [1], [1], [1], [1], 10.0, 100.0)]
    got = {r.id: r.reason for r in entity.compare_fingerprints(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: "matched", 2: "video_mismatch", 3: "fingerprint_unavailable", 4: "duration_mismatch"}


def test_suspected_pairs_meet_all_that_agree(spark):
    rng = random.Random(4)
    rows = [(k, "ab"[k % 2], "x", rng.randint(1, 400)) for k in range(120)]
    got = {(r.l_id, r.r_id) for r in entity.suspected_pairs(spark.createDataFrame(rows, "id int, platform string, author string, seconds int"), ["author"], "platform", "id", "seconds").collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1] and abs(a[3] - b[3]) <= max(2.0, 0.05 * max(a[3], b[3]))}
    assert got == want


def test_round_robin_and_sequence_of_plans(spark):
    rows = [("p1", "a", "u1", 1), ("p1", "a", "u2", 2), ("p1", "b", "u3", 1), ("p2", "a", "u1", 1), ("p2", "b", "u4", 1)]
    df = spark.createDataFrame(rows, "plan string, platform string, unit string, rank int")
    got = [r.unit for r in planning.round_robin(df.where("plan = 'p1'"), "plan", "platform", [F.asc("rank")], 2).orderBy("place").collect()]
    assert got == ["u1", "u3"]
    both = planning.admit_in_order(df, ["p1", "p2"], "plan", "platform", "unit", [F.asc("rank")], 2)
    assert sorted((r.plan, r.unit) for r in both.collect()) == [("p1", "u1"), ("p1", "u3"), ("p2", "u4")]


def test_queries_and_budgets(spark):
    old = spark.createDataFrame([("youtube", "Red  Car")], "platform string, text string")
    new = spark.createDataFrame([("youtube", "red car "), ("tiktok", "red car")], "platform string, text string")
    assert [r.query_key for r in planning.new_queries(new, old).collect()] == ["tiktok:red car"]
    r = one(spark, a=planning.round_budget(F.lit(7), F.lit(2)), b=planning.round_budget(F.lit(7), F.lit(0)), c=planning.selection_ceiling(F.lit(3)), d=planning.selection_ceiling(F.lit(30)), e=F.array_join(planning.platform_scope(F.array(F.lit("tiktok"), F.lit("douyin"))), ","))
    assert tuple(r) == (4, 0, 8, 12, "douyin,tiktok")


def test_state(spark):
    rows = [("j", 1, 1), ("j", 2, 2), ("j", 1, 3)]
    df = spark.createDataFrame(rows, "job string, attempt int, at int")
    assert [r.stale for r in state.fenced_latest(df, "job", "attempt", ["at"]).orderBy("at").collect()] == [False, False, True]
    beats = spark.createDataFrame([("o", 0), ("o", 10), ("o", 40)], "owner string, at int")
    assert [r.generation for r in state.lease_generations(beats, "owner", "at", 30).orderBy("at").collect()] == [1, 1, 2]
    attempts = spark.createDataFrame([("a", "running"), ("b", "running"), ("b", "done")], "owner_id string, status string")
    live = spark.createDataFrame([("a",)], "owner_id string")
    assert sorted(r.status for r in state.recover_interrupted(attempts, live).collect()) == ["done", "interrupted", "running"]


def test_reports(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "a int, b int")
    assert tuple(reports.usage_totals(df, "a", "b").first()) == (1, 0)
    assert tuple(reports.usage_totals(df.where("false"), "a").first()) == (0,)
    assert reports.markdown_table(spark.createDataFrame([("x|y", 1)], "a string, b int")).splitlines()[-1] == "| x\\|y | 1 |"


def test_selection_is_bounded_and_ordered(spark):
    facets = spark.createDataFrame([(1, "large yellow balloon"), (2, "nothing here")], "facet_id int, facet_text string")
    c = spark.createDataFrame([(k, f"yellow balloon number{k}" if k % 2 else "yellow") for k in range(40)], "candidate_id int, search_text string")
    got = selection.rank_candidates(facets, c, most=5).orderBy("rank").collect()
    assert [(r.facet_id, r.candidate_id) for r in got] == [(1, k) for k in (1, 3, 5, 7, 9)]


def test_selection_keeps_common_words(spark):
    facets = spark.createDataFrame([(1, "common harbor"), (2, "common"), (3, "harbor lantern")], "facet_id int, facet_text string")
    rows = [(k, "common" + " harbor" * (k % 7 == 0) + " lantern" * (k % 11 == 0)) for k in range(10_100)] + [(10_200, "harbor"), (10_200, "harbor lantern"), (None, "lantern")]
    c = spark.createDataFrame(rows, "candidate_id int, search_text string")
    got = [(r.facet_id, r.candidate_id, r.n_shared, r.score) for r in selection.rank_candidates(facets, c, most=5).orderBy("facet_id", "rank").collect()]
    held = {w: sum(w in text.split() for _, text in rows) for w in ("common", "harbor", "lantern")}
    want = []
    for facet, asked in ((1, "common harbor"), (2, "common"), (3, "harbor lantern")):
        found = {}
        for k, text in rows:
            for w in set(asked.split()) & set(text.split()):
                n, score = found.get(k, (0, 0.0))
                found[k] = (n + 1, score + math.log(1 + len(rows) / held[w]))
        best = sorted((-round(s, 4), -n, -1 if k is None else k, k) for k, (n, s) in found.items())[:5]
        want += [(facet, k, -n, -s) for s, n, _, k in best]
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 2e-4 for g, w in zip(got, want, strict=True))
    slow = [tuple(r)[:3] for r in selection.rank_candidates(facets, c, most=5, facet_words=1).orderBy("facet_id", "rank").collect()]
    assert slow == [w[:3] for w in want]


def test_subtitles(spark):
    srt = "﻿1\r\n00:00:01,000 --> 00:00:02,500\r\n<i>Hello</i>\r\nthere\r\n\r\n2\r\n00:00:03,000 --> 00:00:04,000\r\n\r\n\r\n3\r\n00:00:05,000 --> 00:00:06,000\r\nend"
    got = [tuple(r)[1:5] for r in readers.parse_subtitles(spark.createDataFrame([("f", srt)], "f string, t string"), "f", "t").orderBy("span_no").collect()]
    assert got == [(1, 1000, 2500, "Hello there"), (2, 5000, 6000, "end")]


def test_scene_points(spark):
    lines = [(1, "frame:0 pts_time:1.5"), (2, "lavfi.scene_score=0.4"), (3, "pts_time:1.5"), (4, "lavfi.scene_score=0.7"), (5, "noise")]
    got = readers.scene_points(spark.createDataFrame(lines, "n int, line string").withColumn("k", F.lit("v")), "k", "n", "line").collect()
    assert [(r.timestamp_ms, r.score) for r in got] == [(1500, 0.7)]


def test_json_lines_guard_versions_and_missing_paths(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"schema_version": 1, "x": 1}\n\n{"schema_version": 999, "x": 2}\n')
    rows = readers.read_json_lines(spark, str(path), "schema_version int, x int", (1,))
    with pytest.raises(Exception, match="unsupported schema_version"):
        rows.collect()
    assert readers.read_json_lines(spark, str(tmp_path / "none"), "x int", missing_ok=True).count() == 0


def test_lenient_and_strict_json(spark):
    df = spark.createDataFrame([(1, '```json\n{"a": 1}\n```'), (2, 'so: {"a": 2} done'), (3, "no")], "k int, t string")
    assert [r.v and r.v.a for r in df.select("k", readers.lenient_json(F.col("t"), "a int").alias("v")).orderBy("k").collect()] == [1, 2, None]
    strict = spark.createDataFrame([(1, '{"a": 1, "a": 2}'), (2, '{"a": [{"b": 1}]}'), (3, "{"), (4, None)], "k int, t string")
    assert {r.k: r.problem for r in readers.duplicate_keys(strict, "k", "t").collect()} == {1: "duplicate_key", 3: "invalid_json", 4: "invalid_json"}


def _found(spark, platform, payload, **options):
    return readers.search_candidates(spark.createDataFrame([("q", json.dumps(payload))], "q string, t string"), platform, "q", "t", **options).orderBy("rank").collect()


def test_search_payloads_of_each_shape(spark):
    clips = [{"item": {"id": "1", "desc": "<b>a</b>  b", "author": {"unique_id": "x"}, "video": {"duration": 3}}}, {"id": "2", "title": "c"}, {"aweme_id": "3", "author": {"uniqueId": "y"}}]
    for name in ("item_list", "items", "data"):
        got = _found(spark, "tiktok", {name: clips})
        assert [(r.rank, r.candidate_id, r.title, r.author, r.duration_seconds) for r in got] == [(1, "tiktok:1", "a b", "x", 3.0), (2, "tiktok:3", "3", "y", None)]
    assert got[0].url == "https://www.tiktok.com/@x/video/1"
    work = lambda k, **more: {"aweme_id": f"{k:010d}", "video": {"duration": 1500}, "author": {"nickname": "n"}, **more}
    works = [{"aweme_info": work(1, desc="a")}, {"aweme_detail": work(2)}, {"aweme_mix_info": work(3, desc=" ")}, work(4, desc="d", create_time=60)]
    for payload in ({"data": works}, {"data": {"data": works}}, {"data": {"items": works}}):
        got = _found(spark, "douyin", payload)
        assert [(r.source_id, r.title, r.author, r.duration_seconds) for r in got] == [("0000000001", "a", "n", 1.5), ("0000000002", "抖音作品 0000000002", "n", 1.5), ("0000000003", "抖音作品 0000000003", "n", 1.5), ("0000000004", "d", "n", 1.5)]
    assert got[3].published_at == "1970-01-01T00:01:00Z"
    note = "ABCDEF0123456789abcdef01"
    notes = [{"id": note, "note_card": {"display_title": "t", "user": {"nickname": "u"}}}, {"note_id": note, "title": "plain", "user": {"nickname": "v"}}, {"note_card": {"note_id": note}}]
    got = _found(spark, "xiaohongshu", {"data": {"items": notes}})
    assert [(r.source_id, r.title, r.author) for r in got] == [(note.lower(), "t", "u"), (note.lower(), "plain", "v"), (note.lower(), f"小红书笔记 {note.lower()}", None)]
    assert len(_found(spark, "xiaohongshu", {"data": {"items": notes}}, limit=2)) == 2 and _found(spark, "tiktok", {}) == []


def test_search_records_without_an_id_are_errors(spark):
    for platform, payload in (("douyin", {"data": [{"aweme_info": {"desc": "x"}}]}), ("xiaohongshu", {"data": {"items": [{"title": "x"}]}}), ("youtube", {"entries": [{"id": "a"}]}), ("bilibili", {"data": {"result": [{"title": "x"}]}})):
        with pytest.raises(Exception, match="record without"):
            _found(spark, platform, payload)


def test_searches_say_whether_they_are_exhausted(spark):
    end = lambda platform, payload, **o: readers.search_exhausted(spark.createDataFrame([("q", json.dumps(payload))], "q string, t string"), platform, "q", "t", **o).first().exhausted
    assert end("douyin", {"has_more": 0}) and not end("douyin", {"has_more": 1}) and not end("douyin", {})
    assert end("xiaohongshu", {"data": {"has_more": False}}) and not end("xiaohongshu", {"data": {"has_more": True}})
    assert end("tiktok", {"data": []}) and not end("tiktok", {"data": [{"id": "1", "author": {"unique_id": "x"}}]}, limit=1)
    assert end("youtube", {}) and not end("bilibili", {})


def test_source_urls(spark):
    cases = [("https://WWW.Bilibili.com/video/BV1?p=2#t", "bilibili", "https://www.bilibili.com/video/BV1"), (" https://b23.tv ", "bilibili", "https://b23.tv/"), ("https://b23.tv:443?x", "bilibili", "https://b23.tv:443/"),
             ("http://bilibili.com/", "bilibili", None), ("https://me:pw@bilibili.com/", "bilibili", None), ("https://notbilibili.com/", "bilibili", None), ("https://tiktok.com.x.org/", "tiktok", None), ("https://youtu.be/a", "youtube", "https://youtu.be/a"), (None, "youtube", None)]
    for url, platform, want in cases:
        assert spark.range(1).select(scalars.source_url(F.lit(url).cast("string"), platform).alias("u")).first().u == want, url
    got = spark.range(1).select(scalars.work_id("xiaohongshu", F.lit(" ABCDEF0123456789abcdef01 ")).alias("a"), scalars.work_id("xiaohongshu", F.lit("xABCDEF0123456789abcdef01")).alias("b"), scalars.clock_seconds(F.lit(" 1:05 ")).alias("c")).first()
    assert tuple(got) == ("abcdef0123456789abcdef01", None, 65)


def test_exact_links_connect_what_all_pairs_connect(spark):
    rng = random.Random(6)
    rows = [(k, rng.choice(["a", "b", None]), rng.choice(["s", "s", "t", "u", None])) for k in range(60)] + [(100, "lone", "s"), (101, "lone", "s"), (3, "a", "t")]
    got = entity.exact_links(spark.createDataFrame(rows, "id int, body string, platform string"), ["body"], "platform", "id").collect()
    pairs = [(min(x[0], y[0]), max(x[0], y[0])) for x in rows for y in rows if x[1] and x[1] == y[1] and x[2] and y[2] and x[2] != y[2]]

    def groups(edges):
        root = {}
        find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
        for l, r in edges:
            l, r = sorted((find(l), find(r)))
            root[r] = l
        return {k: find(k) for k in root}

    assert groups([tuple(r) for r in got]) == groups(pairs) and set(map(tuple, got)) <= set(pairs) and len(got) <= len(rows)


def test_platforms_take_turns_in_their_fixed_order(spark):
    df = spark.createDataFrame([("p", name, k) for name in ("tiktok", "youtube", "bilibili", "another") for k in (1, 2)], "plan string, platform string, rank int")
    got = [r.platform for r in planning.round_robin(df, "plan", "platform", [F.asc("rank")], 6).orderBy("place").collect()]
    assert got == ["bilibili", "youtube", "tiktok", "another", "bilibili", "youtube"]


def test_page_units(spark):
    pages = json.dumps({"data": {"bvid": "BV1", "pages": [{"cid": 5, "page": 1, "part": "p", "duration": 9}]}})
    assert readers.page_units(spark.createDataFrame([("q", pages)], "q string, t string"), "q", "t").first().media_unit_id == "BV1:p1:cid5"


def test_write_once_and_cache(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = str(tmp_path / "t")
    assert writers.write_once(df, path) and not writers.write_once(df.orderBy(F.desc("k")), path)
    with pytest.raises(ValueError):
        writers.write_once(df.where("k = 1"), path)
    calls = []
    build = lambda rows: calls.append(1) or rows.where("k = 1")
    for config in ("c1", "c1", "c2"):
        assert writers.cached_stage(spark, str(tmp_path), "s", config, {"rows": df}, build).count() == 1
    assert len(calls) == 2
    with pytest.raises(Exception, match="not a number"):
        writers.write_json_lines(spark.createDataFrame([(float("nan"),)], "x double"), str(tmp_path / "j"))


def test_manifest_constraints(spark):
    tables = {"candidate_source": spark.createDataFrame([("c",), ("c",)], "candidate_id string"), "media_unit": spark.createDataFrame([("m", "d")], "media_unit_id string, candidate_id string")}
    assert {tuple(r) for r in schemas.violations(tables).collect()} == {("candidate_source", "duplicate", "c"), ("media_unit", "orphan", "d")}


def test_stream_of_states_equals_batch(spark, tmp_path):
    rng = random.Random(6)
    events = [{"schema_version": 1, "event_id": f"e{k:03d}", "job_id": f"j{k % 5}", "type": "state", "occurred_at": f"2024-01-01T00:{k % 60:02d}:00Z", "data": {"state": rng.choice(["queued", "running", "succeeded"]), "stage": str(k % 3), "attempt": str(1 + k // 20)}} for k in range(60)]
    rng.shuffle(events)
    (tmp_path / "in").mkdir()
    for n in range(3):
        (tmp_path / "in" / f"{n}.jsonl").write_text("\n".join(map(json.dumps, events[n * 20 : n * 20 + 20])) + "\n")
    stream = jobs.event_stream(spark, str(tmp_path / "in"), "2 hours", files_at_once=1)
    query = jobs.keep_states(jobs.first_operations(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    batch = jobs.states_of(spark.read.schema(schemas.EVENT).json(str(tmp_path / "in")))
    key = lambda r: (r.job_id, r.attempt, r.event_id, r.state)
    assert sorted(map(key, jobs.kept_states(spark, str(tmp_path / "out")).collect())) == sorted(map(key, batch.collect()))
    assert jobs.state_changes(spark.read.schema(schemas.EVENT).json(str(tmp_path / "in"))).count() > 0


def test_work_ids_and_metadata(spark):
    r = one(
        spark,
        a=scalars.work_id("bilibili", F.lit("https://x/video/BV1ab2cd3EFg?p=1")),
        b=scalars.work_id("douyin", F.lit("https://x/video/7123456789")),
        c=scalars.work_id("xiaohongshu", F.lit("https://x/explore/ABCDEF0123456789abcdef01")),
        d=scalars.work_id("douyin", F.lit("none")),
        e=scalars.allowed_entries(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"), F.lit("x"), F.lit("3")), ("a", "b")),
    )
    assert tuple(r) == ("BV1ab2cd3EFg", "7123456789", "abcdef0123456789abcdef01", None, '{"a":"1","b":"2"}')
