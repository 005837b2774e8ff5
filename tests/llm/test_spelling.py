"""Operator 13 against a plain-Python reading of the contract."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lectern.llm import spelling

DOC = "doc_id long, text string, word string, n int, form string, tree string"


def plain_groups(rows, min_length=7, min_count=2, drop=31, ratio=10):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % drop == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= min_length:
                count[run] += 1
    words = {w: n for w, n in count.items() if n >= min_count}
    cuts = {}
    for w in words:
        for i in range(len(w)):
            cuts.setdefault((i, w[:i] + w[i + 1:]), set()).add(w)
    near = {w: set() for w in words}
    for (_, k), ws in cuts.items():
        for w in ws:
            near[w] |= ws - {w}
            if k in words:
                near[w].add(k)
                near[k].add(w)
    form = {}
    for w, n in words.items():
        top = min(((-words[x], x) for x in near[w]), default=None)
        form[w] = top[1] if top and -top[0] >= ratio * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out, key=str)


def texts(seed):
    """Words with many variants, a word over all texts, odd runs, repeated rows."""
    rng = random.Random(seed)
    base = ["overwhelm", "capturing", "straßenbahn", "élémentaire", "AAAAAAAAAA", "mississippi", "wordword"]
    bag = []
    for w in base:
        bag += [w] * 150
        for _ in range(25):
            v, i = list(w), rng.randrange(len(w))
            kind = rng.randrange(3)
            v[i:i + 1] = [[], [rng.choice("abcdeßé")], [v[i], rng.choice("xyz")]][kind]
            bag += ["".join(v)] * rng.choice([1, 2, 3, 14])
    rng.shuffle(bag)
    rows = [(i, " ".join(bag[i * 20:i * 20 + 20])) for i in range(len(bag) // 20 + 1)]
    rows += [(None, "overwhelm overwhelms"), (None, None), (3, ""), (5, "short words ok 1234567 ....... ×÷×÷×÷×"), (5, "overwhelm " * 300),
             (5, "Overwhelm OVERWHELM ÉLÉMENTAIRE"), (6, "b" * 60_000 + " " + "b" * 60_000 + " " + "b" * 60_001 + "-" + "b" * 60_001)]
    return rows


@pytest.mark.parametrize("home,ask", [(20_000, 100_000), (15, 40)])
def test_groups_equal_the_plain_reading(spark, monkeypatch, home, ask):
    monkeypatch.setattr(spelling, "HOME", home)          # small: several chunks and groups a subtree
    monkeypatch.setattr(spelling, "ASK", ask)
    monkeypatch.setattr(spelling, "TASK", 2000)
    rows = texts(4)
    docs = spark.createDataFrame([(i, t, "w", 1, "f", "t") for i, t in rows], DOC).repartition(4)
    got = spelling.spelling_groups(docs).collect()
    want = plain_groups(rows)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert any(f for _, f, *_ in want) and max(n for *_, n, _ in want) > 10


def test_empty_tables(spark):
    assert spelling.spelling_groups(spark.createDataFrame([], DOC)).collect() == []
    assert spelling.spelling_groups(spark.createDataFrame([(1, None, "", 1, "", "")], DOC)).collect() == []


def test_forms_are_followed_to_the_last(spark):
    rows = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "e")], "word string, form string")
    assert {r.word: r.root for r in spelling._roots(rows).collect()} == dict.fromkeys("abcdx", "e")


def test_search_visits_little_and_loses_nothing():
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abcdefghij") for _ in range(rng.randrange(5, 8))) for _ in range(900)})
    words += [w[:3] + w[4:] for w in words[:300] if len(w) > 5 and w[:3] + w[4:] not in words]
    vec = spelling.frequency_vectors(words)
    trie = spelling.Trie(vec)
    asks = list(range(0, len(words), 37))
    one = np.ones(len(asks), np.int64)
    met = {i: [] for i in asks}
    for who, leaf in trie.search(vec[asks], one, one):
        for i in who.tolist():
            met[asks[i]] += [words[j] for j in leaf]
    for i in asks:
        assert {x for x in words if spelling.one_edit(words[i], x)} <= set(met[i]) and len(met[i]) == len(set(met[i]))
        assert len(met[i]) < len(words) // 4
    pairs = {(words[x], words[y]) for x, y in spelling.near_words(words, len(words), vec, *[np.ones(len(words), np.int64)] * 2, True)}
    assert pairs == {(a, b) for a in words for b in words if a < b and spelling.one_edit(a, b)}


def test_reachable_subtrees_cover_each_pair_from_one_side():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = tuple(rng.integers(0, 3, 4).tolist())
        d = [0] * 4
        if rng.random() < 0.7:
            d[rng.integers(4)] += 1
        if rng.random() < 0.7:
            d[rng.integers(4)] -= 1
        b = tuple(x + y for x, y in zip(a, d))
        if min(b) < 0 or sum(map(abs, d)) == 0:
            continue
        sides = (b in [o for o, _, _ in spelling.reachable(a)]) + (a in [o for o, _, _ in spelling.reachable(b)])
        assert sides == 1
