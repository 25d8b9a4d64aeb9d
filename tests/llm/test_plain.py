"""Operators against plain versions of themselves: loops over characters, a dictionary of weights, all pairs."""

import math
import random

import numpy as np
import pytest

from stridewell.llm import mil_quality, secrets, spotsigs, toxicity

LOWER_HEX = "0123456789abcdef"
VALUE = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")


def plain_base(text: str) -> list[tuple[int, int, int]]:
    """The three patterns read character by character, leftmost, each kind by itself."""
    found = []
    at = 0
    while at < len(text):
        end = None
        for word in WORDS:
            if "".join(c.lower() if "A" <= c <= "Z" else c for c in text[at : at + len(word)]) == word:
                k = at + len(word)
                k += text[k : k + 1] in ("'", '"') and text[k : k + 1] != ""
                while text[k : k + 1] == " ":
                    k += 1
                if text[k : k + 1] in (":", "=") and text[k : k + 1]:
                    k += 1
                    while text[k : k + 1] == " ":
                        k += 1
                    k += text[k : k + 1] in ("'", '"') and text[k : k + 1] != ""
                    stop = k
                    while stop < len(text) and text[stop] in VALUE:
                        stop += 1
                    if stop > k:
                        end = stop
                        if stop - k >= 12:
                            found.append((at, 0, stop))
                        break
        at = end or at + 1
    at = 0
    while at < len(text):
        stop = at
        if text.startswith("AKIA", at):
            stop = at + 4
            while stop < len(text) and (text[stop] in VALUE and (text[stop].isupper() or text[stop].isdigit())):
                stop += 1
            if stop > at + 4:
                if stop - at >= 18:
                    found.append((at, 1, stop))
                at = stop
                continue
        at += 1
    at = 0
    while at < len(text):
        stop = at
        while stop < len(text) and text[stop] in LOWER_HEX:
            stop += 1
        if stop - at >= 16:
            found.append((at, 2, stop))
        at = max(stop, at + 1)
    return sorted(found)


def test_base_spans_equal_a_plain_scan():
    rng = random.Random(11)
    pieces = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "apikey", "AKIA", "=", ":", " ", "  ", '"', "'", "é", "\n", "abcdef0123456789", "deadbeef", "XYZ", "0A", "Zk3vQ9xT7bLm", "."]
    for _ in range(4000):
        text = "".join(rng.choices(pieces, k=rng.randrange(1, 14)))
        assert secrets.base_spans(text) == plain_base(text), text


def random_found(text: str) -> list[str]:
    enc = secrets.encoder(secrets.vocabulary())
    return [text[a:b] for a, _, b in secrets.random_spans(text, secrets.base_spans(text), enc)]


def test_random_parts_of_paths_and_addresses():
    key = "Zk3vQ9xT7bLm2Rw8Yp5N"
    for around in ("config/production/service/credentials/{}", "see https://example.com/api/v2/users/{}/profile/settings", "a {} b", "name={}", "{}/live/settings-page", "first-{}-last"):
        assert random_found(around.format(key)) == [key], around
    joined = "AbC+dEf/gHiJkLmN0pQrStUvWxYz12=="
    assert random_found(f"x {joined} y") == [joined]
    two = random_found(f"path/{key}/word/settings/{key[::-1]}")
    assert two == [key, key[::-1]]
    for clean in ("/x/123e4567-e89b-12d3-a456-426614174000/y", "sha/DA39A3EE5E6B4B0D3255BFEF95601890AFD80709/end", "well-known-identifier-of-things", "2024-01-02T03-04-05Z-2024-01-02", "internationalization/of/documentation-pages"):
        assert random_found(clean) == [], clean


def plain_ftrl(rows, labels, epochs):
    """The update rule with a dictionary for each of its sums, weight by weight."""
    a, b, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2
    z, n, zb, nb = {}, {}, 0.0, 0.0
    weight = lambda i: 0.0 if abs(z.get(i, 0.0)) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((b + math.sqrt(n[i])) / a + l2)
    order = np.arange(len(rows))
    for epoch in range(epochs):
        np.random.default_rng(epoch).shuffle(order)
        for k in order:
            w = {i: weight(i) for i in rows[k].tolist()}
            wb = -zb / ((b + math.sqrt(nb)) / a)
            g = 1 / (1 + math.exp(-(wb + sum(w.values())))) - labels[k]
            for i, own in w.items():
                was = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(was + g * g) - math.sqrt(was)) / a * own
                n[i] = was + g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / a * wb
            nb += g * g
    return {i: weight(i) for i in z if weight(i)}, -zb / ((b + math.sqrt(nb)) / a)


def test_toxicity_weights_equal_a_plain_loop():
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choice(words, rng.integers(3, 20))) for _ in range(120)]
    labels = np.array([float("w3" in t.split() or "w7" in t.split()) for t in texts])
    rows = [np.unique(toxicity.places(toxicity.word_hashes(t), 16)) for t in texts]
    at, w, bias = toxicity.ftrl(rows, labels, 16, 3)
    want, want_bias = plain_ftrl(rows, labels, 3)
    assert {int(i): pytest.approx(v, abs=1e-9) for i, v in zip(at, w, strict=True)} == want and bias == pytest.approx(want_bias, abs=1e-9)
    # A text's score is the sum of the weights of its places.
    score = toxicity.Scorer((at, w.astype(np.float32), bias), 16).scores(texts[:20])
    by_hand = [1 / (1 + math.exp(-(bias + sum(want.get(i, 0.0) for i in r.tolist())))) for r in rows[:20]]
    assert score == pytest.approx(by_hand, abs=1e-5)


def test_attention_score_equals_a_plain_loop():
    """The score of a document, passage by passage: gates, weights that add up to one, weighted sum."""
    rng = np.random.default_rng(2)
    h, sizes = rng.normal(size=(7, 5)), [3, 1, 3]
    p = {"V": rng.normal(size=(5, 4)), "U": rng.normal(size=(5, 4)), "w": rng.normal(size=4), "c": rng.normal(size=5), "b": rng.normal(size=1)}
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    got = mil_quality.forward(p, h, np.repeat(np.arange(3), sizes), starts)[0]
    for k, (a, n) in enumerate(zip(starts, sizes, strict=True)):
        own = []
        for row in h[a : a + n]:
            gate = [math.tanh(float(row @ p["V"][:, j])) / (1 + math.exp(-float(row @ p["U"][:, j]))) for j in range(4)]
            own.append(math.exp(sum(x * y for x, y in zip(gate, p["w"], strict=True))))
        shown = sum((e / sum(own)) * row for e, row in zip(own, h[a : a + n], strict=True))
        assert got[k] == pytest.approx(1 / (1 + math.exp(-(float(shown @ p["c"]) + float(p["b"][0])))))


def test_fingerprint_pairs_equal_all_pairs(spark):
    rng = random.Random(6)
    words = ["the", "a", "is", "that", "there", "of"] + [f"w{k}" for k in range(40)]
    base = [" ".join(rng.choices(words, k=rng.randrange(20, 120))) for _ in range(25)]
    texts = [t if rng.random() < 0.3 else " ".join(w for w in t.split() if rng.random() > 0.04) for t in base for _ in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = spotsigs.fingerprints(docs)
    own = {r.doc_id: r.fingerprint for r in prints.collect()}
    first: dict = {}
    for i, f in sorted(own.items()):
        first.setdefault(f, i)
    sets = {i: set(spotsigs.read_back(f).tolist()) for f, i in first.items()}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    got = {(r[0], r[1]): r[2] for r in spotsigs.near_pairs(prints).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()} and len(want) > 5
