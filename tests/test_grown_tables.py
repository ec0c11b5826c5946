"""Steps that must not grow faster than their input."""

import random
import re

from shotloom import session
from shotloom.operators import contracts, entity, graph, handover, records
from shotloom.plans import catalogs, studies


def _units(spark, n):
    rng = random.Random(4)
    rows = [(k, rng.choice("abc"), rng.choice(["Ann", "ann", "Bob"]), rng.choice(["red ring", "red rings", "blue bolt", "blue bolts"]), rng.choice([10.0, 11.0, 30.0])) for k in range(n)]
    return spark.createDataFrame(rows, "id int, platform string, author string, title string, seconds double")


COLUMNS = ("id", "platform", "author", "title", "seconds")


def test_titles_are_compared_once_for_all_classes(spark):
    classes = entity.crosspost_classes(_units(spark, 300), *COLUMNS).cache()
    assert entity.near_titles(classes).count() == 16 and entity.bounded_pairs(classes).count() > 100


def test_groups_of_ends_are_the_groups_of_all_links(spark):
    units = _units(spark, 200)
    links = entity.crosspost_links(units, *COLUMNS)
    n_pairs = entity.crosspost_pairs(entity.crosspost_classes(units, *COLUMNS)).count()
    assert links.count() <= n_pairs + 2 * 200
    columns = ("group_id", "node", "role", "fallback_order")
    want = sorted(entity.work_groups(links).select(*columns).collect())
    assert sorted(entity.crosspost_groups(units, *COLUMNS).select(*columns).collect()) == want and len(want) > 100


def _dealt(df, key):
    """Tasks that the plan deals rows by ``key`` to."""
    return {int(n) for n in re.findall(rf"hashpartitioning\({key}#\d+L?, (\d+)\), REPARTITION_BY_NUM", df._jdf.queryExecution().toString())}


def test_units_of_groups_are_dealt_by_rows_a_task(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 5)
    members = spark.createDataFrame([("g", k, "p") for k in range(60)] + [("h", 3, "x"), (None, 99, None), ("h", 4, "p")], "work_group_id string, media_unit_id long, platform string")
    units = spark.createDataFrame([(k, "p") for k in range(60)], "media_unit_id long, platform string")
    got = contracts.group_problems(members.select("work_group_id").limit(2), members, units)
    assert _dealt(got, "media_unit_id") == {13}
    want = {("g", None, "duplicate_group"), ("h", "3", "platform_mismatch"), (None, "3", "several_groups"), (None, "4", "several_groups"), (None, "99", "unknown_unit")}
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_attempts_are_dealt_by_rows_a_task(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 5)
    rows = [(k, k - 1 if k % 7 else None) for k in range(60)] + [(100, -5), (101, 100)]
    got = handover.attempt_chains(spark.createDataFrame(rows, "id long, prior long"), "id", "prior")
    assert _dealt(got, "up") == {13}
    told = {r.attempt: (r.first, r.place, r.problem) for r in got.collect()}
    assert len(told) == 62 and told[0] == (0, 1, None) and told[9] == (7, 3, None) and told[3] == (0, 4, "too_long") and told[6] == (None, None, "endless") and told[100] == (100, 1, "missing_prior") and told[101] == (100, 2, "missing_prior")


def test_ranges_of_assets_are_dealt_once(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 5)
    assets = spark.createDataFrame([(f"a{k}", "w", "s", "h") for k in range(5)], "asset_id string, workflow_id string, selection_id string, source_sha256 string")
    ranges = spark.createDataFrame([(f"a{k % 4}", k, "c" if k % 4 == 1 else f"c{k}", 1.0, 2.0) for k in range(63)], "asset_id string, position int, clip_id string, start_seconds double, end_seconds double")
    got = records.export_requests(assets, ranges)
    assert _dealt(got, "asset_id") == {13}
    rows = {r.asset_id: r for r in got.collect()}
    assert rows["a1"].problems == "duplicate_clip" and rows["a4"].problems == "no_ranges" and rows["a1"].request_id is None and rows["a0"].request_id[3:] == rows["a0"].idempotency_key[5:17]


def test_files_of_lines_are_not_one_a_user(spark, tmp_path, monkeypatch):
    rows = [(f"2024-01-01 00:00:{k % 60:02d}", k % 90 if k % 31 else None, k, "purchase" if k % 5 == 0 else "view", 1.0) for k in range(400)]
    spark.createDataFrame(rows, "ts string, user_id long, event_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(studies, "fresh_dir", lambda spark, name: f"{tmp_path}/{name}")
    got = sorted(map(tuple, studies.ordered_lines(spark, str(tmp_path)).collect()), key=repr)
    files = [p for p in (tmp_path / "lines").rglob("*.txt")]
    assert 1 <= len(files) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    want, places = [], {}
    for _, user, event, kind, _ in rows:
        line, ordinal = places.get(user, (1, 1))
        want.append((user, event, line, ordinal))
        places[user] = (line + 1 + (kind == "purchase"), ordinal + 1)
    assert got == sorted(want, key=repr)


def test_texts_are_folded_once(spark, tmp_path):
    rows = [(1, "a", "en", "Some text"), (2, "b", "en", "some TEXT!"), (3, "a", "en", "sometext"), (4, "b", None, "Some text"), (5, "b", "en", None)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    links = catalogs.crosspost_blocked(spark, str(tmp_path))
    assert "regexp_replace" not in links._jdf.queryExecution().toString()
    assert sorted(map(tuple, links.collect())) == [(1, 2), (2, 3)]
    assert [(r.doc_id, r.role) for r in catalogs.work_groups(spark, str(tmp_path)).orderBy("doc_id").collect()] == [(1, "primary"), (2, "fallback"), (3, "fallback")]


def test_blocks_are_groups_and_are_connected_by_shared_units(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(120), rng.choice("abc"), rng.randrange(90)) for _ in range(200)] + [(500, "a", 200), (500, "b", 200), (501, None, 201), (502, "a", 201)]
    units = spark.createDataFrame(rows, "id long, platform string, block int")
    columns = ("group_id", "node", "role", "fallback_order")
    want = sorted(entity.work_groups(entity.exact_links(units, ["block"], "platform", "id"), "l", "r").select(*columns).collect())
    assert sorted(entity.exact_groups(units, ["block"], "platform", "id").select(*columns).collect()) == want and len(want) > 50
    alone = units.where("block < 90").dropDuplicates(["id"])
    want = sorted(entity.work_groups(entity.exact_links(alone, ["block"], "platform", "id"), "l", "r").select(*columns).collect())
    assert sorted(entity.exact_groups(alone, ["block"], "platform", "id").select(*columns).collect()) == want and want


def test_few_edges_are_not_dealt_out(spark):
    rng = random.Random(5)
    edges = spark.createDataFrame([(rng.randrange(300), rng.randrange(300)) for _ in range(200)], "src long, dst long")
    held = {"spark.sql.shuffle.partitions": "29", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        few, dealt = graph.connected_components(edges), graph.connected_components(edges, few=0)
        assert few.where("node <> component").rdd.getNumPartitions() < 29 <= dealt.where("node <> component").rdd.getNumPartitions()
        assert sorted(few.collect()) == sorted(dealt.collect()) and few.count() > 100
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
