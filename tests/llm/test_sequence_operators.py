"""Periodic runs, byte pieces and the prefix trie against brute force and the public library."""

import hashlib
import random
import struct
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotloom.llm import byte_pieces, periodic, prefix_trie, queries
from shotloom.llm.radix_tree import Direct, Indexed, RadixTree, Sorted

CLASH = ["runs", "ids", "words", "key", "path", "h", "n", "a", "part", "head", "collapsed"]


def clashing(df):
    return df.withColumns({name: F.lit("clash") for name in CLASH})


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


# periodic runs


def runs_by_force(words, least=6, periods=4):
    """Every maximal stretch of equal words at distance q, kept if no smaller period holds in it."""
    found = set()
    for q in range(1, len(words) // periods + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, periods * q) and not any(words[i : i + length - r] == words[i + r : i + length] for r in range(1, q)):
                found.add((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def some_words(rng, most=60):
    n, kinds = rng.randint(0, most), rng.choice([1, 2, 2, 3, 5])
    words = [b"%d" % rng.randrange(kinds) for _ in range(n)]
    if n and rng.random() < 0.5:
        a = rng.randrange(n)
        p = 1 + (n - a) // (3 + rng.randrange(8))
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    return words


def test_runs_by_brute_force():
    rng = random.Random(5)
    for _ in range(1500):
        words = some_words(rng)
        assert [tuple(r) for r in periodic.find_runs(words).tolist()] == runs_by_force(words)


def test_runs_of_two_periods_need_no_reduction():
    rng = random.Random(6)
    for _ in range(300):
        symbols = [1 + rng.randrange(2) for _ in range(rng.randint(0, 40))]
        got = [tuple(r) for r in periodic.runs_of(symbols, 2, 2).tolist()]
        assert sorted(got) == sorted(runs_by_force(symbols, 2, 2))


def test_suffix_tree_orders_and_extensions():
    rng = random.Random(7)
    for _ in range(60):
        symbols = [1 + rng.randrange(3) for _ in range(rng.randint(1, 50))]
        tree, n = periodic.SuffixTree(symbols), len(symbols)
        suffixes = [symbols[i:] for i in range(n + 1)]
        assert tree.order == sorted(range(n + 1), key=suffixes.__getitem__)
        assert tree.inverse == sorted(range(n + 1), key=lambda i: [-s for s in suffixes[i]])
        i, j = np.array([(i, j) for i in range(n) for j in range(i + 1, n)] or [(0, 1)]).T
        same = [next((k for k, (a, b) in enumerate(zip(suffixes[x], suffixes[y])) if a != b), n - y) for x, y in zip(i, j)]
        assert tree.extensions(i, j).tolist() == same
        ends = periodic.lyndon_ends(tree.order)
        assert ends.tolist() == [next(j for j in range(i + 1, n + 1) if suffixes[j] < suffixes[i]) for i in range(n)]


def test_op11_by_brute_force(spark, tmp_path):
    rng = random.Random(8)
    texts = {k: b" ".join(some_words(rng, 90)).decode() for k in range(300)}
    texts |= {1000: None, 1001: "", 1002: " \t\n", 1003: "é " * 30, 1007: " ".join(str(k % 700) for k in range(30_000)), 1005: "x"}
    rows = [*texts.items(), (3, texts[3]), (None, "a " * 10)]
    clashing(spark.createDataFrame(rows, "doc_id long, text string")).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_lyndon_runs(spark, str(tmp_path)).collect()
    want = []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        n, h = len(words), crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = runs_by_force(words) if n < 1000 else [(0, n, 700)]
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        gone = {i for start, length, q in runs for i in range(start + q, start + length)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        milli = 1000 * best[1] // best[2] if runs else None
        want.append((doc_id, len(runs), *best, milli, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(kept)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sum(r.n_runs > 0 for r in got) > 50


def test_runs_of_nothing(spark):
    assert periodic.collapse_runs(clashing(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


# byte pieces


@pytest.fixture(scope="module")
def vocabulary():
    return queries.tokenizer_file("byte_bpe_50k.tiktoken")


def library(path):
    import public_tokenizers
    import tiktoken

    ranks = {token: rank for rank, token in enumerate(byte_pieces.read_ranks(path))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def hard_texts():
    rng = random.Random(9)
    pools = ["abc ", " \t\n\r\x0b\x00", "aé日本🎉ßŁ", "'s't're'LL 12٣", "▁ \u0085　", "<|endoftext|><unk><s>"]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    return [*texts, None, "", "hi <|endoftext|> there", "a" * 3000, " " * 500, "日本語" * 50, "".join(chr(c) for c in range(0x20, 0x3000))]


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_pieces_equal_the_library(name):
    import public_tokenizers

    path = queries.tokenizer_file(name)
    codec, encode = byte_pieces.Codec(byte_pieces.serialise_model(byte_pieces.read_ranks(path)), public_tokenizers.PATTERN), library(path)
    texts = hard_texts()
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        own = encode(text or "")
        assert ids == struct.pack(f"<{len(own)}I", *own)
        assert codec.decode(ids) == (text or "").encode()


def test_every_token_is_its_own_piece(vocabulary):
    import public_tokenizers

    tokens = byte_pieces.read_ranks(vocabulary)
    codec = byte_pieces.Codec(byte_pieces.serialise_model(tokens), public_tokenizers.PATTERN)
    assert codec.tokens == tokens and codec.unknown == len(tokens)
    assert codec.pieces.encode([byte_pieces.spell(t) for t in tokens]) == [[k] for k in range(len(tokens))]


def test_ranks_with_gaps_are_refused(tmp_path):
    (tmp_path / "ranks").write_bytes(b"YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        byte_pieces.read_ranks(str(tmp_path / "ranks"))


def test_op12_by_the_library(spark, vocabulary, tmp_path):
    texts = [*hard_texts(), "the cat sat " * 40_000]
    rows = [*enumerate(texts), (3, texts[3]), (None, "no id")]
    clashing(spark.createDataFrame(rows, "doc_id long, text string")).write.parquet(f"{tmp_path}/documents.parquet")
    encode = library(vocabulary)
    want = []
    for doc_id, text in rows:
        ids = encode(text or "")
        want.append((doc_id, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(text or "")))
    got = queries.op12_sentencepiece_bytes(spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_null_ids_decode_to_nothing(spark, vocabulary):
    import public_tokenizers

    rows = spark.createDataFrame([(1, None, 0), (2, b"", 0)], "doc_id long, ids binary, n_tokens long")
    assert [bytes(r.data) for r in byte_pieces.decode(rows, vocabulary, public_tokenizers.PATTERN).collect()] == [b"", b""]


# prefix trie


def test_layouts_grow_and_keep_order():
    rng = random.Random(10)
    for n in (1, 4, 5, 16, 17, 48, 49, 256):
        layout, given = Sorted(), rng.sample(range(256), n)
        for byte in given:
            layout = layout.put(byte, -byte).put(byte, byte)
        assert type(layout) is (Sorted if n <= 16 else Indexed if n <= 48 else Direct)
        assert n > 16 or layout.room == (4 if n <= 4 else 16)
        assert [b for b, _ in layout] == sorted(given) and all(layout.get(b) == b for b in given)
        assert all(layout.get(b) is None for b in range(256) if b not in given)


def test_radix_tree_holds_all_keys_in_order():
    rng = random.Random(11)
    for kinds in (2, 5, 60, 256):
        keys = {bytes(rng.randrange(kinds) for _ in range(rng.randint(0, 9))) for _ in range(400)}
        tree, given = RadixTree(), sorted(keys, key=lambda _: rng.random())
        for key in given:
            tree.set(key, 0)
            tree.set(key, len(key) + 1)
        seen, path, nodes = [], b"", 0
        for depth, part, value in tree.walk():
            path, nodes = path[:depth] + part, nodes + 1
            if value is not None:
                assert value == len(path) + 1
                seen.append(path)
        assert seen == sorted(keys)
        assert nodes <= 2 * len(keys) + 1  # paths are compressed


def trie_by_force(turns):
    own = defaultdict(list)
    for conv_id, turn, role, text in turns:
        if conv_id is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv_id].append((turn is not None, turn or 0, mark, role, text))
    own = {c: [t[3:] for t in sorted(said)] for c, said in own.items()}
    nodes = defaultdict(list)
    ends = defaultdict(list)
    for c, said in own.items():
        h = crc32(str(c).encode()) % 6
        base = c - int(c / 100) * 100
        whole = tuple(own.get(c - base, [])[:h] + said[h:])
        for d in range(len(whole) + 1):
            nodes[whole[:d]].append(c)
        ends[whole].append(c)
    children = defaultdict(list)
    for node in nodes:
        if node:
            children[node[:-1]].append(node)

    def below(node):
        kids = [below(k) for k in children[node]]
        saved = (len(nodes[node]) - 1) * len(node[-1][1]) if node else 0
        return saved + sum(k[0] for k in kids), sum(k[1] for k in kids) or 1

    rows = []
    for node, members in nodes.items():
        saved, leaves = below(node)
        above = min(nodes[node[:-1]]) if node else None
        rows.append((min(members), len(node), above, len(members), len(children[node]), leaves, saved, sha(",".join(map(str, sorted(ends[node]))))))
    return sorted(map(str, rows))


def some_turns(seed, n=400):
    rng, turns = random.Random(seed), []
    for c in rng.sample(range(-150, 900), n):
        size = 60 if rng.random() < 0.01 else rng.randint(1, 7)
        kinds = 1 if rng.random() < 0.3 else 3  # many conversations are equal
        for turn in range(size):
            turns.append((c, turn, rng.choice(["user", "assistant"]) if kinds > 1 else "user", "é" * rng.randrange(kinds)))
    return [*turns, (5, None, None, None), (5, None, "user", "x"), (5, 0, "user", "y"), (5, 0, "user", "y"), (None, 0, "user", "gone"), (10**12 + 7, 0, "user", "absent head")]


@pytest.mark.parametrize("size", [200, 2_000, 1 << 24])
def test_trie_by_brute_force_over_many_ranges(spark, monkeypatch, size):
    monkeypatch.setattr(prefix_trie, "RANGE_BYTES", size)
    monkeypatch.setattr(prefix_trie, "BLOCK", 7)
    turns = some_turns(12)
    df = clashing(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = prefix_trie.prefix_nodes(prefix_trie.rebuild(prefix_trie.turn_lists(df)))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == trie_by_force(turns)


def test_trie_joins_shared_nodes_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RANGE_BYTES", 500)
    monkeypatch.setattr(prefix_trie, "SHARED_AT_ONCE", 1)
    turns = some_turns(13, 150)
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = prefix_trie.prefix_nodes(prefix_trie.rebuild(prefix_trie.turn_lists(df)))
    assert sorted(map(str, map(tuple, got.collect()))) == trie_by_force(turns)


def test_trie_of_one_turnless_conversation_and_of_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    alone = spark.createDataFrame([(3, 0, "user", "x")], schema)  # crc32("3") % 6 = 5 turns come from an absent conversation
    got = prefix_trie.prefix_nodes(prefix_trie.rebuild(prefix_trie.turn_lists(alone))).collect()
    h = crc32(b"3") % 6
    assert [tuple(r) for r in got] == [(3, 0, None, 1, 0, 1, 0, sha("3"))] if h else len(got) == 2
    assert prefix_trie.prefix_nodes(prefix_trie.turn_lists(alone.where("false"))).count() == 0
