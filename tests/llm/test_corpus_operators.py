"""Corpus operators against brute force, round trips and held-out accuracy, and on awkward tables."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shotloom.llm import conversations, decontaminate, host_quality, html_text, interpolation, packing, simhash, similar, substrings, toxicity, warc
from shotloom.llm.queries import tokenizer_file

#: Columns whose names the operators use themselves.
CLASH = ["fp", "core", "key", "host", "words", "tokens", "block", "kept", "packed", "cut_text", "gone_id", "same_text", "cut_id", "label", "seed"]
WORDS = [a + b for a in "ka lo mi nu pe ra so ti vu".split() for b in "ba do fi gu he jo lu ma ni".split()]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def rows_of(spark, rows, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema)
    for name in CLASH:
        df = df.withColumn(name, F.lit("clash"))
    return df.withColumns({"source": F.lit("s"), "lang": F.lit("en"), "n_chars": F.coalesce(F.char_length("text"), F.lit(0)).cast("long")})


@pytest.fixture(scope="module")
def awkward(spark):
    """Null ids and texts, an empty text, only spaces, one very long, ties and repeated rows."""
    rows = [(None, "a b c"), (1, None), (2, ""), (3, " \t\n "), (4, prose(1, 40_000)), (5, "x"), (5, "x"), (6, prose(2, 120)), (7, prose(2, 120)), (8, "日本語 テキスト é"), (9, "a" * 5000)]
    return rows_of(spark, rows)


@pytest.fixture(scope="module")
def nothing(spark):
    return rows_of(spark, [])


# packing


def test_packing_round_trip(spark, awkward):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file())
    tokenizer.encode_special_tokens = True
    out = packing.pack(awkward, tokenizer_file()).collect()
    want = Counter((r.doc_id, np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes()) for r in awkward.collect())
    by_sequence, by_doc = {}, {}
    for r in out:
        assert r.ids_crc32 == zlib.crc32(r.ids) and r.length * 4 == len(r.ids)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or at & (at - 1) == 0 and at < 2048
    for doc_id, pieces in by_doc.items():
        copies = [ids for (d, ids), n in want.items() for _ in range(n) if d == doc_id]
        assert sum(r.length for r in pieces) == sum(len(x) // 4 for x in copies)
        if len(copies) == 1:
            assert b"".join(bytes(r.ids) for r in sorted(pieces, key=lambda r: r.start)) == copies[0]
            assert {r.doc_tokens for r in pieces} == {len(copies[0]) // 4}
    assert set(by_doc) == {d for d, _ in want}


def test_packing_places_by_sum_of_squares():
    rng, window = random.Random(3), 16
    packer = packing.Packer(window, 0)
    for k in range(200):
        size, before = rng.randint(1, window - 1), packer.count.copy()

        def after(level):
            n = before.copy()
            if level:
                n[level] -= 1
            if level + size < window:
                n[level + size] += 1
            return int((n[1:window] ** 2).sum())

        choices = [h for h in range(window - size + 1) if h == 0 or before[h]]
        packer.add(k, b"\1\0\0\0" * size)
        got = int((packer.count[1:window] ** 2).sum())
        assert got == min(after(h) for h in choices)
    packer.drain()
    assert sum(r[2] for r in packer.rows) == sum(1 for r in packer.rows for _ in range(r[2]))
    assert packer.n_open == 0


def test_packing_joins_open_windows_early():
    packer = packing.Packer(64, 0, max_open=10)
    for k in range(200):
        packer.add(k, b"\2\0\0\0" * 40)
    assert packer.n_open <= 11
    packer.drain()
    assert sum(r[2] for r in packer.rows) == 8000


# quality


def test_quality_counts_by_brute_force(spark, awkward):
    rows = awkward.unionByName(rows_of(spark, [(20, "a b c a b c a b c d"), (21, "l one\nl one\n\n\nl one"), (22, "# $ x|y")]))
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in host_quality.measure(rows).collect()}
    for row in rows.collect():
        text = row.text or ""
        words = [w.decode() for w in text.encode().split()]
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert (row.doc_id, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)) in got


def test_hosts_are_judged_by_shrunk_rates(spark):
    rows = [(k, "short" if k % 10 else prose(k, 80), "bad") for k in range(200)] + [(1000 + k, prose(k, 80) if k % 20 else "short", f"good{k % 8}") for k in range(800)] + [(5000, "short", "tiny"), (5001, prose(7, 80), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in host_quality.judge(df).collect()}
    assert len(got) == len(rows)
    assert not any(got[k].kept for k in range(200)) and got[0].host_failed and not got[0].base_failed
    assert all(got[1000 + k].kept == (k % 20 != 0) for k in range(800))
    assert got[5001].kept and not got[5000].kept


def test_quality_of_nothing(nothing, awkward):
    assert host_quality.judge(nothing).count() == 0
    assert host_quality.judge(awkward).count() == awkward.count()


# archives


def test_archives_round_trip(spark, tmp_path):
    long = prose(5, 30_000)
    rows = [(3, "http://a/1", long), (1, "http://a/2", long), (2, None, "tiny"), (4, "u\r\nx", "tiny"), (5, "u", None), (6, "u", ""), (None, "u", prose(6, 60)), (1, "http://a/2", long), (7, "u", "é\r\n\r\nWARC/1.1\r\n" * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit("clash"), "chunk": F.lit("clash")})
    archives = warc.archive_pages(pages, f"file://{tmp_path}/w", chunk_bytes=1000)
    chunks = warc.read_chunks(archives, chunk_bytes=1000).collect()
    assert max(len(r.chunk) for r in chunks) <= 1000
    whole = {}
    for r in sorted(chunks, key=lambda r: (str(r.archive), r.chunk_no)):
        whole.setdefault((r.record_id, r.record_type), []).append(r)
    text = {(r[0], "response"): (r[2] or "").encode() for r in rows if r[0] != 3} | {(3, "revisit"): b""}
    for key, parts in whole.items():
        if key[0] != 1:  # that record is there twice
            data = b"".join(p.chunk for p in sorted(parts, key=lambda r: r.chunk_no))
            assert data == text[key]
            seen = hashlib.sha256()
            for p in sorted(parts, key=lambda r: r.chunk_no):
                seen.update(p.chunk)
                assert p.payload_digest == seen.hexdigest()
    assert set(whole) == set(text)
    got = {r.record_id: r for r in warc.resolve(warc.read_chunks(archives, with_data=False)).collect()}
    assert (got[3].record_type, got[3].refers_to, got[3].payload_bytes, got[3].payload_digest) == ("revisit", 1, len(long), hashlib.sha256(long.encode()).hexdigest())
    assert got[5].payload_bytes == 0 and got[4].record_type == "response"
    assert warc.resolve(warc.read_chunks(warc.archive_pages(pages.where("false"), f"file://{tmp_path}/e"))).count() == 0


# language model


def test_base_score_and_counts(spark, awkward):
    docs = awkward.unionByName(rows_of(spark, [(100 + k, prose(k % 40, 60)) for k in range(150)]))
    got = interpolation.score_documents(docs, block_bytes=20_000).collect()
    rows = [((r.text or "").encode().lower().split() + [b"\n"], r.doc_id) for r in docs.collect()]
    fold = lambda d: 0 if d is None else zlib.crc32(str(d).encode()) % 7
    counts = Counter(w for words, d in rows if fold(d) != 2 for w in words)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(d), fold(d) == 2, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for w, d in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 for r in got)


def test_mixture_weights_by_plain_em():
    rng = np.random.default_rng(1)
    after, alone, uniform = rng.choice([0, 0.5, 0.01], 500), rng.choice([0.001, 0.0001], 500), 1e-5
    context = rng.choice([3, 100], 500)
    cell = (interpolation._contexts(context) * (interpolation.STEPS + 1) + interpolation._steps(after / uniform)) * (interpolation.STEPS + 1) + interpolation._steps(alone / uniform)
    cells, n = np.unique(cell, return_counts=True)
    got = interpolation.learn(cells, n.astype(float))
    for c in (3, 100):
        own, w = context == c, np.full(3, 1 / 3)
        parts = np.stack([after[own], alone[own], np.full(own.sum(), uniform)])
        for _ in range(200):
            share = w[:, None] * parts
            w = (share / share.sum(axis=0)).mean(axis=1)
        assert np.abs(got[interpolation._contexts(np.array([c]))[0]] - w).max() < 0.03
    assert np.allclose(got.sum(axis=1), 1)


def test_scores_of_nothing(nothing):
    assert interpolation.score_documents(nothing).count() == 0


# toxicity


def toxic_rows(n=900):
    rng = random.Random(9)
    docs, labels = [], []
    for k in range(n):
        bad = rng.random() < 0.25
        sentences = [prose(k * 31 + j, 12) for j in range(rng.randint(2, 9))]
        if bad:
            sentences.insert(rng.randint(0, len(sentences)), f"{prose(k, 4)} {rng.choice(['grolk', 'vilezonk', 'vilezard'])} {prose(k + 1, 3)}")
        docs.append((k, ". ".join(s.replace(".", "") for s in sentences)))
        labels.append((k, int(bad)))
    return docs, labels


def test_toxicity_on_held_out_documents(spark, awkward, nothing):
    docs, labels = toxic_rows()
    table = rows_of(spark, docs)
    marks = spark.createDataFrame([*labels, (0, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(table, marks)
    truth = dict(labels)
    out = toxicity.score(table, model).withColumn("held_out", toxicity.held_out("doc_id")).collect()
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {d for d, _ in docs if zlib.crc32(str(d).encode()) % 5 == 0}
    right = sum(r.predicted == truth[r.doc_id] for r in held)
    assert right / len(held) > 0.97
    text = dict(docs)
    for r in held:
        if r.predicted and truth[r.doc_id]:
            spots = [text[r.doc_id][s.begin : s.end] for s in r.sentences]
            assert spots and all(any(w in s for w in ("grolk", "vilezonk", "vilezard")) for s in spots)
    odd = toxicity.score(awkward, model).collect()
    assert len(odd) == awkward.count() and all(0 <= r.score <= 1 for r in odd)
    empty = toxicity.train(nothing, marks.where("false"))
    assert toxicity.score(awkward, empty).where("predicted = 1").count() == 0
    assert toxicity.score(nothing, model).count() == 0


def test_toxicity_texts_stay_in_tasks(spark, monkeypatch):
    import ast
    import inspect
    import os

    names = [n.name for n in ast.parse(inspect.getsource(toxicity)).body if isinstance(n, (ast.FunctionDef, ast.ClassDef))]
    assert len(names) == len(set(names))  # a second definition would replace the first
    driver, fit = os.getpid(), toxicity.fit

    def guarded(*args):
        assert os.getpid() != driver, "the fit runs on the driver"
        return fit(*args)

    docs, labels = toxic_rows(300)
    docs += [docs[1]] * 3 + [(5, docs[5][1] + " More.")]
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    monkeypatch.setattr(type(marks), "toArrow", lambda self: pytest.fail("texts go to the driver"))
    monkeypatch.setattr(toxicity, "fit", guarded)
    model = toxicity.train(rows_of(spark, docs), marks)
    assert model.weights and all(isinstance(w, float) for w in model.weights.values())
    assert toxicity.train(rows_of(spark, docs), marks.where("toxic = 1")).leak == pytest.approx(0.99)


# pages


def test_layout():
    page = """<html><head><title>no</title><style>p{}</style></head><body><h1>Top</h1><p>One<p>two &amp; <b>three</b>
    <ul><li>a<li>b<ol start=3><li>c</ol></ul><div hidden>no</div><p style="display:none">no</p><script>var x = "</p>";</script>
    <table><tr><th>Name<th>N<tr><td>x<td>10<tr><td>longer<td><span>7</span></table><pre>\n  k\n   l</pre>end<br>of it"""
    want = ["Top", "", "One", "", "two & three", "", "- a", "- b", "  3. c", "", "Name    N", "x       10", "longer  7", "", "  k", "   l", "", "end", "of it"]
    assert html_text.visible_text(page).split("\n") == want
    assert html_text.visible_text(None) == html_text.visible_text("") == html_text.visible_text("<p hidden>x") == ""
    assert html_text.visible_text("a < b & c") == "a < b & c"
    deep = html_text.visible_text("<div>" * 20_000 + "x" + "<table><tr><td>" * 200 + "y")
    assert deep.split() == ["x", "y"]


def test_text_before_raw_elements_of_any_script():
    page = "<p>" + "İ" * 30 + "ß</p><ScRipt>no</sCRIPT ><p>one</p><STYLE>no</style><TextArea>box</TEXTAREA><p>two</p><script>no </scripted> no"
    assert html_text.visible_text(page).split() == ["İ" * 30 + "ß", "one", "box", "two"]


def test_visibility_is_inherited_and_turned_back():
    page = "<div style='visibility:hidden'>no<ul><li>no<li style='visibility: visible'>yes</ul><table><tr><td>no<td style='visibility:visible'>cell</table></div><body style='color:red'>end <q>said</q>"
    assert html_text.visible_text(page).split() == ["-", "yes", "cell", "end", '"said"']
    assert html_text.visible_text("<body style='visibility:hidden'>no<p>no<p style='visibility:visible'>yes") == "yes"


def test_cells_below_a_spanning_one():
    page = "<table><tr><td rowspan=2>a<td>bb<td rowspan=0>z<tr><td>c<tr><td>d<td>e</table>"
    assert html_text.visible_text(page).split("\n") == ["a  bb  z", "   c", "d  e"]
    page = "<table><tr><td colspan=2>wide<td>x<tr><td>1<td>2<td>3</table>"
    lines = html_text.visible_text(page).split("\n")
    assert lines[0].index("x") == lines[1].index("3")


def random_page(rng, depth, names, shown=True, inside="div"):
    """HTML of a random tree, and the words of it that a reader sees, in order."""
    if depth == 0 or rng.random() < 0.2:
        word = f"w{next(names)}w"
        return rng.choice(["{}", " {} ", "&amp;{}&#x21;"]).format(word), [word] if shown else []
    kind = rng.choice(["div", "p", "span", "ul", "ol", "blockquote", "table", "none", "hidden", "invisible", "visible", "script", "h2", "dl", "comment"])
    parts = [random_page(rng, depth - 1, names, shown if kind not in ("invisible", "visible") else kind == "visible") for _ in range(rng.randint(1, 3))]
    seen = [w for _, ws in parts for w in ws]
    htmls = [h for h, _ in parts]
    close = rng.random() < 0.5
    if kind in ("ul", "ol"):
        return f"<{kind}>" + "".join(f"<li>{h}" + "</li>" * close for h in htmls) + f"</{kind}>", seen
    if kind == "dl":
        return "<dl>" + "".join(f"<dt>{h}" + "</dt>" * close for h in htmls) + "</dl>", seen
    if kind == "table" and rng.random() < 0.5:
        word = f"w{next(names)}w"  # in no cell: it stands before the table
        return f"<table>{'<tr>' * (not close)}" + "".join(f"<tr><td>{h}" + "</td></tr>" * close for h in htmls) + f"{'</tr>' * (not close)}{word}</table>", [word] * shown + seen
    if kind == "table":
        return "<table>" + "".join(f"<tr><td>{h}" + "</td></tr>" * close for h in htmls) + "</table>", seen
    body = "".join(htmls)
    if kind in ("none", "hidden", "script", "comment"):
        shell = {"none": "<div style='display: none'>{}</div>", "hidden": "<div hidden>{}</div>", "script": "<script>{}</script>", "comment": "<!-- {} -->"}[kind]
        return shell.format("no" if kind in ("script", "comment") else body), []
    style = {"invisible": " style='visibility:hidden'", "visible": " style='visibility:visible'"}.get(kind, "")
    tag = "div" if style else kind
    return f"<{tag}{style}>{body}</{tag}>", seen


def test_loose_words_and_last_declarations():
    text = html_text.visible_text
    assert text("<head><title>t</title>hello<p>x</p>") == "hello\n\nx"
    assert text("<head> <meta charset=x> <style>p{}</style>&nbsp;a</head><p>b") .split() == ["a", "b"]
    assert text("<table>loose<tr><td>a<td>b</table>after") == "loose\n\na  b\n\nafter"
    assert text("<p>before</p><table><tr>direct<td>a</tr>more<tbody>and<tr><td>b</table>") == "before\n\ndirectmoreand\n\na\nb"
    assert text("<table><tr><td>x <table>in<tr><td>y</table></table>").split() == ["x", "in", "y"]
    for style, shown in (("display:none;display:block", True), ("display:block;display:none", False), ("display:none !important;display:block", False), ("display:none;display:nonsense", False), ("DISPLAY : None", False), ("color:red;display:none", False), ("x-display:none", True), ("visibility:hidden;visibility:visible", True), ("visibility:visible!important;visibility:hidden", True)):
        assert text(f'<div style="{style}">word</div>') == ("word" if shown else ""), style


def test_random_pages_lose_no_visible_word():
    import itertools
    import re

    rng = random.Random(31)
    for _ in range(400):
        page, want = random_page(rng, rng.randint(1, 6), itertools.count())
        got = re.findall(r"w\d+w", html_text.visible_text(page))
        assert got == want, page


def test_pages_table(spark):
    pages = spark.createDataFrame([(1, "<p>a"), (1, "<p>a"), (2, None), (None, "b")], "page_id long, html string").withColumn("text", F.lit("clash"))
    assert sorted((str(r.page_id), r.text, r.n_lines) for r in html_text.extract(pages).collect()) == [("1", "a", 1), ("1", "a", 1), ("2", "", 0), ("None", "b", 1)]
    assert html_text.extract(pages.where("false")).count() == 0


# near duplicates


def brute_fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprints_by_brute_force():
    for text in (None, "", "a", "A b", "a b c d", prose(4, 300), "É é a b"):
        assert simhash.fingerprint(text) % 2**64 == brute_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 1, 3])
def test_masks_cover_every_pair_in_the_radius(radius):
    rng, masks = random.Random(radius), simhash.covering_masks(radius, list(range(64)))
    for _ in range(2000):
        flips = sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius)))
        assert any(flips & m == 0 for m in masks)
    for top in masks[:3]:
        free = [b for b in range(64) if not top >> b & 1]
        for _ in range(300):
            flips = sum(1 << b for b in rng.sample(free, radius))
            assert any(flips & m == 0 for m in simhash.covering_masks(radius, free))


@pytest.mark.parametrize("limit", [2, 4096])
def test_groups_by_brute_force(spark, awkward, limit):
    rows = [(100 + 10 * k + j, " ".join(w if (i + j) % 97 else w + "x" * j for i, w in enumerate(prose(k, 400).split()))) for k in range(6) for j in range(8)]
    docs = awkward.unionByName(rows_of(spark, rows))
    got = simhash.near_duplicates(docs, bucket_limit=limit).collect()
    table = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    prints = sorted({f for _, f in table})
    group = {f: f for f in prints}
    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 3 and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {f: low if g == high else g for f, g in group.items()}
    least = {}
    for d, f in table:
        if d is not None:
            least[group[f]] = min(d, least.get(group[f], d))
    want = sorted((str(d), f, least.get(group[f])) for d, f in table)
    assert sorted((str(r.doc_id), r.fp % 2**64, r.component_id) for r in got) == want
    assert simhash.near_duplicates(docs.where("false")).count() == 0


# repeated strings


def brute_removal(texts, n):
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        runs = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def test_removal_by_brute_force(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcd é") for _ in range(rng.randint(0, 600))) for _ in range(12)]
    rows = [(k, "".join((lambda b, i: b[i : rng.randint(i, len(b))])(b := rng.choice(base), rng.randint(0, len(b))) + rng.choice(["", "x", "q" * 90, "ab" * 70]) for _ in range(rng.randint(0, 4)))) for k in range(50)]
    rows += [(90, None), (91, ""), (92, "z" * 63), (93, "z" * 64), (94, "z" * 65), (95, "w" * 64), (None, rows[3][1]), (3, rows[3][1])]
    df = rows_of(spark, rows)
    for n in (64, 400):
        got = Counter((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in substrings.remove_repeats(df, min_bytes=n).collect())
        assert got == Counter(zip([r[0] for r in rows], brute_removal([(r[1] or "").encode() for r in rows], n), strict=True))


def test_removal_across_blocks(spark, monkeypatch):
    text = prose(8, 4000)
    rows = [(1, text), (2, "front " + text[5000:9000] + " back"), (3, prose(9, 3000))]
    monkeypatch.setattr(substrings, "BLOCK", 2048)
    parser = substrings.Parser(400)
    found = [(f.at + int(p[0, 1] - p[0, 2])).tolist() for data, p in parser.blocks([text.encode()]) for f in [parser.parse(data, p)[0]]]
    monkeypatch.undo()
    whole = substrings.Parser(400)
    data, pieces = next(whole.blocks([text.encode()]))
    assert sorted(x for part in found for x in part) == sorted(whole.parse(data, pieces)[0].at.tolist())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(rows_of(spark, rows)).collect()}
    assert [got[k] for k in (1, 2, 3)] == brute_removal([r[1].encode() for r in rows], 400)


def test_removal_of_planted_passages(spark):
    """The size of the input says nothing of a passage, what is removed says it all; one under 400 bytes is the pipeline's."""
    passages = [prose(300 + k, n) for k, n in enumerate((51, 55, 75, 90, 120, 200))]
    planted = {10 * k + j: (f"{prose(400 + 10 * k + j, 90)} ", p, f" {prose(500 + 10 * k + j, 60)}") for k, p in enumerate(passages, 1) for j in range(2)}
    clean = {1000 + k: prose(600 + k, 60 + 20 * k) for k in range(30)}
    df = rows_of(spark, [*((d, "".join(parts)) for d, parts in planted.items()), *clean.items()])
    got = {r.doc_id: r for r in substrings.remove_repeats(df, with_kept=False).collect()}
    long = {d for d, (_, p, _) in planted.items() if len(p) >= 400}
    assert 0 < len(long) < len(planted)
    assert {d for d, r in got.items() if r.n_removed} == {d for d, r in got.items() if r.n_spans} == long
    for d in long:
        before, passage, _ = planted[d]
        (span,) = got[d].spans
        assert span.begin <= len(before) and span.end >= len(before) + len(passage) and got[d].n_removed < len(passage) + 40
    assert all(got[d].n_bytes == len("".join(parts)) for d, parts in [*planted.items(), *clean.items()])
    found = substrings.passages(df).where("by_words is not null").select("key")
    assert {r.doc_id for r in df.withColumn("key", substrings.row_key("doc_id", "text")).join(found, "key").collect()} == set(planted)


def test_removal_of_nothing(nothing, awkward):
    assert substrings.remove_repeats(nothing).count() == 0
    assert substrings.remove_repeats(awkward).count() == awkward.count()


# conversations


def test_escapes_round_trip():
    rng = random.Random(12)
    bits = ["\\", "#", "###", "</turn>", "\n", ":", "assistant", "<", "\\h", "\\t", "é", "### ", ":\n", "\n</turn>\n"]
    for _ in range(500):
        turns = [("".join(rng.choices(bits, k=rng.randint(0, 3))), "".join(rng.choices(bits, k=rng.randint(0, 8)))) for _ in range(rng.randint(0, 5))]
        text, mask = conversations.format_turns(turns, loss_role=turns[0][0] if turns else "")
        assert conversations.parse_turns(text) == turns
        assert [conversations.unescape(text[a:b]) for a, b in mask] == [t for r, t in turns if turns and r == turns[0][0]]


def test_best_path_of_a_reply_tree(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "good", 2.0), (1, 3, 1, "assistant", "bad", 1.0), (1, 4, 2, "user", "more", 0.0), (1, 5, 4, "assistant", "end", 3.0), (2, 1, 99, "user", None, None), (None, 1, None, None, "x", 0.0)]
    m = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double").withColumn("leaf", F.lit("clash"))
    got = {(r.tree, r.leaf): r for r in conversations.format_conversations(m).collect()}
    assert set(got) == {(1, 5), (2, 1), (None, 1)}
    assert [t for _, t in conversations.parse_turns(got[1, 5].formatted)] == ["q", "good", "more", "end"]
    every = conversations.reply_paths(m, None).where("tree = 1").groupBy("leaf", "path_rank").agg(F.count(F.lit(1)).alias("n")).collect()
    assert sorted((r.leaf, r.path_rank, r.n) for r in every) == [(3, 2, 2), (5, 1, 4)]
    with pytest.raises(ValueError, match="cycle"):
        conversations.reply_paths(spark.createDataFrame([(1, 1, 2, "u", "a", 0.0), (1, 2, 1, "u", "b", 0.0)], m.schema.fieldNames()[:6]))


def test_long_chain_and_repeated_rows(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(70)] + [(2, 0, "user", "a"), (2, 0, "user", "a"), (None, 0, "user", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit("clash"))
    got = {r.tree: r for r in conversations.read_back(conversations.format_conversations(conversations.linear_messages(turns))).collect()}
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows[:70]).encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256("".join(t for _, _, r, t in rows[:70] if r == "assistant").encode()).hexdigest()
    assert (got[1].n_turns, got[2].n_turns, got[None].n_turns, got[2].loss_chars) == (70, 2, 1, 0)
    assert conversations.format_conversations(conversations.linear_messages(turns.where("false"))).count() == 0


# benchmark leaks


def test_leaks_survive_substitutions(spark, awkward, nothing):
    items = spark.createDataFrame([(k, prose(500 + k, 12 + 3 * k)) for k in range(10)] + [(50, "one two"), (51, None), (3, prose(503, 21))], "item_id long, text string").withColumn("tokens", F.lit("clash"))
    text = {r.item_id: r.text for r in items.collect()}
    docs = []
    for k in range(10):
        words = text[k].split()
        words[5] = "zzz"
        docs.append((200 + k, f"{prose(900 + k, 30)} {' '.join(words)} {prose(950 + k, 30)}"))
    docs += [(300, " ".join(text[9].split()[:13])), (301, " ".join(text[9].split()[:8])), (302, "one two"), (303, prose(777, 400)), (200, docs[0][1])]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(awkward.unionByName(rows_of(spark, docs)), items).collect()}
    assert set(got) == {(200 + k, k) for k in range(10)} | {(300, 9), (302, 50)}
    assert got[205, 5].matched == got[205, 5].item_tokens - 1 and got[205, 5].start == 30
    parts = decontaminate.leaks(rows_of(spark, docs), items, seeds_at_once=40)
    assert {(r.doc_id, r.item_id) for r in parts.collect()} == set(got)
    assert decontaminate.leaks(nothing, items).count() == 0 and decontaminate.leaks(awkward, items.where("false")).count() == 0


@pytest.mark.parametrize("share", [0.5, 0.8, 0.9, 1.0])
def test_every_allowed_overlap_has_a_hit(share):
    for run in range(1, 21 if share > 0.5 else 14):
        changed = run - math.ceil(share * run)
        masks = decontaminate.masks_for(run, share)
        assert len(masks) <= decontaminate.MOST_MASKS and all(m[0] == 0 for m in masks)
        assert decontaminate.meet_all(masks, run, changed), run
    assert all(decontaminate.masks_for(run, 0.8) == decontaminate.MASKS for run in range(7, 14))
    assert not decontaminate.meet_all(decontaminate.MASKS, 5, 1)


def test_leaks_by_brute_force(spark):
    from math import ceil

    rng = random.Random(17)
    items = [(k, " ".join(rng.choice(WORDS[:40]) for _ in range(n))) for k, n in enumerate([1, 2, 3, 4, 5, 5, 6, 6, 7, 7, 8, 9, 10, 11, 12, 13, 14, 20, 33])]
    docs = []
    for k in range(400):
        words = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        low = rng.randint(0, 3)
        docs.append((k, " ".join(prose(k, rng.randint(0, 9)).replace(".", "").split() + words[low : len(words) - rng.randint(0, 3)] + prose(k + 1, rng.randint(0, 9)).replace(".", "").split())))
    docs.append((3, docs[4][1]))  # another text of the same id
    want = {}
    for d, text in docs:
        t = text.split()
        for i, item in items:
            x = item.split()
            run = min(13, len(x))
            for start in range(1 - len(x), len(t)):
                equal = [0 <= start + j < len(t) and t[start + j] == w for j, w in enumerate(x)]
                best = max(sum(equal[j : j + run]) for j in range(len(x) - run + 1))
                if best >= ceil(0.8 * run):
                    want[d, i] = max(want.get((d, i), (0,)), (best, sum(equal), -start))
    for options in ({}, {"seeds_at_once": 50}):
        found = decontaminate.leaks(rows_of(spark, docs), spark.createDataFrame(items, "item_id long, text string"), **options).collect()
        assert {(r.doc_id, r.item_id): (r.best_run, r.matched, -r.start) for r in found} == want
    assert len(want) > 60 and any(n[0] < 13 for n in want.values())


def test_stage_cuts_passages_of_short_words(spark):
    short = random.Random(3)
    passage, fifty = (" ".join("".join(short.choice("abcdefghi") for _ in range(short.randint(1, 3))) for _ in range(n)) for n in (51, 50))
    assert len(passage) < 200
    blob = "".join(chr(0x4E00 + short.randrange(2000)) for _ in range(150))  # one word of 450 bytes
    rows = [(1, f"{prose(81, 40)} {passage} {prose(82, 40)}"), (2, f"{prose(83, 60)}\n{passage}  {prose(84, 9)}"), (3, f"{prose(85, 30)} {fifty} {prose(86, 30)}"), (4, f"{prose(87, 30)} {fifty} {prose(88, 30)}")]
    rows += [(5, f"{prose(89, 20)} {blob} {prose(90, 20)}"), (6, f"{prose(91, 20)} {blob} {prose(92, 20)}"), (7, passage), (2, prose(93, 30)), (None, passage), (8, None)]
    got = Counter((r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.substring_stage(spark, rows_of(spark, rows), "").collect())
    want = []
    for k, text in rows:
        if k is not None and text:
            text = text.replace(passage, "").replace(blob, "")
        if text != "":
            want.append((k, text, len(text or "")))
    squeezed = lambda rows: Counter((k, x and "".join(x.split())) for k, x, _ in rows)
    assert all(n == len(x or "") for _, x, n in got.elements())
    assert squeezed(got.elements()) == squeezed(want)


# similar texts


def edited(text: str, every: int) -> str:
    words = text.split()
    return " ".join(f"new{k}" if k % every == every // 2 else w for k, w in enumerate(words))


@pytest.mark.parametrize(("low", "high"), [(3, 400), (600, 1000)])
def test_similar_texts_by_brute_force(spark, nothing, low, high):
    rng = random.Random(5)
    texts = [prose(k, rng.randint(low, high)) for k in range(40)]
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [(100 + 40 * j + k, edited(t, every)) for j, every in enumerate((35, 47, 60, 120)) for k, t in enumerate(texts)]
    rows += [(900, None), (901, ""), (902, " "), (903, "a b"), (904, "A  b"), (None, texts[3]), (905, texts[4]), (4, prose(77, 50))]
    sets = [set(similar.shingles(t).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    spread = 0
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
                spread += rows[a][1] != rows[b][1] and (simhash.fingerprint(rows[a][1]) ^ simhash.fingerprint(rows[b][1])).bit_count() > 3
    assert spread > 20
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k][0])
    want = Counter((rows[k][0], min(x for x in groups[find(k)] if x is not None)) for k in range(len(rows)))
    for hot_band in (similar.HOT_BAND, 1)[: 1 + (low > 3)]:  # with 1, all that is left meets by prefixes
        got = Counter((r.doc_id, r.component_id) for r in similar.similar_groups(rows_of(spark, rows), hot_band=hot_band).collect())
        assert got == want
    assert similar.similar_groups(nothing).count() == 0


def test_parities_never_differ_in_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(3)
    for size in (0, 1, 40, 300, 3000):
        for moved in {0, 1, size // 9, size}:
            own = rng.integers(0, 1 << 64, size, dtype=np.uint64)
            other = np.r_[own[moved:], rng.integers(0, 1 << 64, moved, dtype=np.uint64)]
            flipped = int(np.bitwise_count(similar.parities(np.unique(own)) ^ similar.parities(np.unique(other))).sum())
            assert flipped <= len(np.setxor1d(own, other))
            assert flipped or not moved or size > 2


def test_folded_parities_and_bands():
    rng = np.random.default_rng(4)
    own = np.unique(rng.integers(0, 1 << 64, 3000, dtype=np.uint64))
    wide = similar.parities(own, similar.wide_bits(len(own)))
    assert len(wide) * 64 == 4096 and (similar.wide_bits(512), similar.wide_bits(513), similar.wide_bits(0)) == (512, 1024, 512)
    bits = np.unpackbits(wide.view(np.uint8))
    assert (bits[:2048] ^ bits[2048:] == np.unpackbits(similar.parities(own, 2048).view(np.uint8))).all()
    assert similar.band_shape(0.8) == (similar.BANDS, similar.BAND_ROWS)
    for least in (0.05, 0.3, 0.5, 0.7, 0.79, 0.8, 0.95, 1.0):
        n, rows = similar.band_shape(least)
        assert (1 - least**rows) ** n <= similar.MOST_MISSED
    with pytest.raises(ValueError):
        similar.band_shape(0)


@pytest.mark.parametrize(("least", "hot_band"), [(0.5, 4), (0.9, 4)])
def test_other_bounds_and_templates_by_brute_force(spark, least, hot_band):
    """Pages of a template that share three quarters of it, none of which may cost a link or make one."""
    rng = random.Random(15)
    template = prose(600, 300).split()
    rows = []
    for k in range(60):
        own = [f"own{k}x{j}" if rng.random() < 0.012 * (k % 5) else w for j, w in enumerate(template)]
        rows.append((k, " ".join(own + prose(700 + k, rng.choice([5, 60])).split())))
    rows += [(100, prose(701, 900)), (101, edited(prose(701, 900), 90)), (102, edited(prose(701, 900), 30))]
    sets = [set(similar.shingles(t).tolist()) for _, t in rows]
    links = [(rows[b][0], rows[a][0]) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    root = {k: k for k, _ in rows}
    for _ in rows:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id: r.component_id for r in similar.similar_groups(rows_of(spark, rows), least=least, hot_band=hot_band).collect()}
    assert got == root and len(links) > 3


def test_stage_drops_copies_with_spread_edits(spark):
    text = prose(501, 300)
    other = edited(text, 60)
    assert (simhash.fingerprint(text) ^ simhash.fingerprint(other)).bit_count() > 3
    out = corpus_pipeline.near_duplicate_stage(spark, rows_of(spark, [(1, text), (2, other), (3, edited(text, 20))]), "")
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == [1, 3]


# pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, labels = toxic_rows(400)
    item = prose(4242, 30)
    docs += [(1000, prose(60, 300)), (1001, prose(60, 300)), (1002, f"{prose(61, 40)} {item} {prose(62, 40)}"), (1003, f"{prose(63, 50)} {prose(70, 120)} {prose(64, 50)}"), (1004, f"{prose(65, 50)} {prose(70, 120)} {prose(66, 50)}"), (1005, None), (1006, ""), (None, prose(67, 60)), (None, prose(67, 60)), (1000, prose(60, 300)), (None, prose(60, 300)), (None, f"{prose(68, 40)} {item} {prose(69, 40)}")]
    docs.append((None, docs[next(k for k, toxic in labels if toxic)][1]))
    path = str(tmp_path_factory.mktemp("tables"))
    rows_of(spark, docs).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, dict(labels)


def test_stages(spark, folder):
    path, truth = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = spark.createDataFrame(stage(spark, docs, path).collect(), docs.schema)
        assert docs.columns == columns
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept[name] <= before
    gone = set(truth) - kept["toxicity"]
    assert sum(truth[d] for d in gone) / max(1, len(gone)) > 0.95 and len(gone) > 0.9 * sum(truth.values())
    assert 1001 not in kept["near_duplicates"] and {1000, 1005, None} <= kept["near_duplicates"]
    assert [r.text for r in docs.where("doc_id is null").collect()] == [prose(67, 60)]  # the toxic, the copied and the leaked ones without an id went
    assert 1006 not in kept["near_duplicates"]  # empty like 1005
    assert {1003, 1004} <= kept["substrings"] and 1002 in kept["substrings"]
    assert kept["substrings"] - kept["decontamination"] == {1002}
    rows = {r.doc_id: r for r in docs.where("doc_id in (1003, 1004)").collect()}
    passage = prose(70, 120)
    assert all(passage not in r.text and r.n_chars == len(r.text) for r in rows.values())
    pieces = corpus_pipeline.packing_stage(spark, docs, path)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == kept["decontamination"]


def test_run_and_stages_on_nothing(spark, folder, tmp_path):
    path, _ = folder
    assert corpus_pipeline.run(spark, path).count() > 0
    empty = spark.read.parquet(f"{path}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, path).count() == 0
