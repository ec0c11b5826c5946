"""The fitted models' final scores against plain versions of them."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from shotloom.llm import interpolation, toxicity

WORDS = [a + b for a in "ka lo mi nu pe ra".split() for b in "ba do fi gu".split()]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def fold(doc_id):
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % 7


def plain_interpolation(docs):
    """Scores of (doc_id, text), by dictionaries, with the parameters of ``interpolation``: fold 2 is held out, fold 3 deleted."""
    said = [(d, [*(text or "").encode().lower().split(), b"\n"]) for d, text in docs]
    said = [(d, words, [b"\n", *words[:-1]]) for d, words in said]
    one, two, kept_one, kept_two = Counter(), Counter(), Counter(), Counter()
    for d, words, before in said:
        if fold(d) != 2:
            one.update(words)
            two.update(zip(before, words))
            if fold(d) != 3:
                kept_one.update(words)
                kept_two.update(zip(before, words))
    n, kept_n, uniform = sum(one.values()), sum(kept_one.values()), 1 / (len(one) + 1)
    bucket = lambda c: min(interpolation.CONTEXTS - 1, int(math.log2(c + 1)))
    step = lambda x: 1 + min(interpolation.STEPS - 1, max(0, round(2 * math.log2(x / uniform)) + 8)) if x > 0 else 0
    seen = Counter()
    for d, words, before in said:
        if fold(d) == 3:
            for b, w in zip(before, words):
                after = kept_two[b, w] / kept_one[b] if kept_one[b] else 0
                seen[bucket(kept_one[b]), step(after), step(kept_one[w] / max(1, kept_n))] += 1
    back = lambda s: 2.0 ** ((s - 9) / 2) if s else 0.0
    weights = [[1 / 3] * 3 for _ in range(interpolation.CONTEXTS)]
    for _ in range(60):
        new = [[0.0] * 3 for _ in weights]
        for (b, s, t), count in seen.items():
            parts = [w * x for w, x in zip(weights[b], (back(s), back(t), 1.0))]
            for k in range(3):
                new[b][k] += count * parts[k] / sum(parts)
        overall = [sum(row[k] for row in new) + 1e-3 for k in range(3)]
        new = [[x + o / sum(overall) for x, o in zip(row, overall)] for row in new]
        weights = [[x / sum(row) for x in row] for row in new]
    out = []
    for d, words, before in said:
        total = 0.0
        for b, w in zip(before, words):
            share = weights[bucket(one[b])]
            after = two[b, w] / one[b] if one[b] else 0
            total += math.log10(share[0] * after + share[1] * one[w] / max(1, n) + share[2] * uniform)
        out.append((str(d), len(words), round(total, 5)))
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [3_000, 1 << 24])
def test_interpolated_scores_by_plain_counts(spark, block_bytes):
    docs = [(k, prose(k % 50, 5 + k % 60)) for k in range(220)] + [(None, "a b a b"), (500, None), (501, ""), (502, " "), (503, "unseen words only"), (7, prose(7, 12)), (7, prose(7, 12)), (504, "É é"), (505, prose(1, 3000))]
    got = interpolation.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), block_bytes=block_bytes).collect()
    assert sorted((str(r.doc_id), r.n_tokens, round(r.score, 5)) for r in got) == plain_interpolation(docs)


def plain_noisy_or(model, text):
    """1 - (1 - leak) * product over sentences of 1 - sigmoid(bias + weights of the words and beginnings in it)."""
    clean = 1 - model.leak
    for sentence in toxicity._SENTENCE.findall(text or ""):
        if sentence.isspace():
            continue
        z = model.bias + sum(model.weights.get(f, 0.0) for word in toxicity._WORD(sentence.lower()) for f in [word, *(word[:k] + "+" for k in toxicity.PREFIXES if len(word) > k)])
        clean *= 1 - 1 / (1 + math.exp(-z))
    return 1 - clean


def test_toxicity_scores_by_plain_product(spark):
    rng = random.Random(3)
    names = [*WORDS[:6], "grolk", "vile+", "vilez+", "kaba+"]
    model = toxicity.NoisyOr({n: rng.uniform(-3, 9) for n in names}, -6.0, 0.03)
    texts = [". ".join(prose(31 * k + j, 8).replace(".", "") for j in range(k % 6)) + rng.choice(["", " grolk!", "\nVilezonk? ", "!!!", " vilezard grolk. grolk"]) for k in range(200)]
    rows = [*enumerate(texts), (900, None), (901, ""), (902, " \n"), (None, "grolk"), (3, texts[3])]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    want = sorted((str(d), round(plain_noisy_or(model, t), 9)) for d, t in rows)
    assert sorted((str(r.doc_id), round(r.score, 9)) for r in got) == want
    assert all(r.predicted == (r.score >= 0.5) for r in got) and len({r.score for r in got if r.doc_id in (900, 901, 902)}) == 1


def test_fit_climbs_the_likelihood_that_it_names():
    """The fitted weights score higher than any small step away from them, by the likelihood written out."""
    rng = np.random.default_rng(5)
    n_docs, names = 120, ["a", "b", "c"]
    doc, sent, feat, plain = [], [], [], rng.integers(0, 4, n_docs)
    for d in range(n_docs):
        for _ in range(rng.integers(1, 4)):
            sent_no = len(doc)
            doc.append(d)
            for f in rng.choice(3, rng.integers(1, 3), replace=False):
                sent.append(sent_no)
                feat.append(int(f))
    has = np.zeros(n_docs)
    for s, f in zip(sent, feat):
        has[doc[s]] = max(has[doc[s]], f == 0)
    toxic = np.where(rng.random(n_docs) < 0.1, 1 - has, has)
    model = toxicity.fit(names, toxic, plain, np.array(doc), np.array(sent), np.array(feat), rounds=1500, rate=0.03)

    def likelihood(weights, bias, leak):
        clean = np.full(n_docs, math.log1p(-leak)) - plain * math.log1p(math.exp(bias))
        for number, d in enumerate(doc):
            z = bias + sum(weights[f] for s, f in zip(sent, feat) if s == number)
            clean[d] -= math.log1p(math.exp(z))
        p = np.clip(-np.expm1(clean), 1e-9, 1 - 1e-12)
        return float(np.where(toxic > 0, np.log(p), np.log1p(-p)).sum() / n_docs) - 0.5 * 1e-3 * sum(w * w for w in weights) / n_docs**0.5

    own = [model.weights[n] for n in names]
    top = likelihood(own, model.bias, model.leak)
    for k in range(3):
        for move in (-0.3, 0.3):
            moved = [w + move * (j == k) for j, w in enumerate(own)]
            assert likelihood(moved, model.bias, model.leak) < top
    for move in (-0.3, 0.3):
        assert model.bias + move > -4.0 or likelihood(own, model.bias + move, model.leak) < top
        odds = math.log(model.leak / (1 - model.leak)) + move
        assert likelihood(own, model.bias, 1 / (1 + math.exp(-odds))) < top
    assert re.fullmatch(r"[abc]", max(model.weights, key=model.weights.get)) and max(model.weights, key=model.weights.get) == "a"
