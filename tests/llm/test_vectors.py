"""Operators 11 and 12 against brute force on small frames, with the odd cases."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import ball_codes, vector_dedup

VEC = "vec_id long, embedding array<double>, label int, code string, node string, n long, v int"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", "y", 1, 2) for i, v, lab in rows], VEC)


# -- 11 ball k-means ---------------------------------------------------------------------------
def plain_codes(rows, parts, entries, rounds, scale):
    """The contract in plain Python: (id, code, error) of kept rows and the codebooks (all of one dimension)."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(scale * x) for x in v] for _, v, _ in kept]
    size = len(ints[0]) // parts
    cut = [[v[p * size:(p + 1) * size] for p in range(parts)] for v in ints]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), i) for i, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(col) // len(groups[i]) for col in zip(*groups[i])] if i in groups else old
                        for i, old in enumerate(books[p])]
    out = []
    for (i, _, lab), c in zip(kept, cut):
        best = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((i, bytes(b for _, b in best), sum(d for d, _ in best), lab))
    return out, books


@pytest.mark.parametrize("seed,grid", [(1, 0), (2, 4)])
def test_codes_equal_plain_k_means(spark, seed, grid):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(300, 12))
    if grid:
        x = np.round(x * grid) / grid                       # many equal distances
    rows = [(int(i), v.tolist(), int(i) % 3 if i % 5 else None) for i, v in enumerate(x)]
    rows += [(7, rows[7][1], 1), (7, rows[8][1], 1), (None, rows[9][1], None), (400, None, 1), (401, [NAN] * 12, 1),
             (402, [1.0, None] * 6, 1), (403, [INF] + [0.0] * 11, 1)]
    rng.shuffle(rows)
    want, books = plain_codes(rows, 4, 16, 2, 8)
    codes, got = ball_codes.compress(frame(spark, rows).repartition(3), parts=4, entries=16, scale=8)
    assert got[12].tolist() == books
    assert sorted(((r.vec_id is None, r.vec_id or 0), bytes(r.code), r.error) for r in codes.collect()) == sorted(
        ((i is None, i or 0), c, e) for i, c, e, _ in want)
    totals = {}
    for _, _, e, lab in want:
        totals[lab] = totals.get(lab, 0) + e
    assert {r.label: r.label_error for r in ball_codes.label_totals(codes).collect()} == totals
    text = ",".join(str(x) for part in books for entry in part for x in entry)
    assert ball_codes._digest(got[12]) == hashlib.sha256(text.encode()).hexdigest()


def test_rings_and_cores_save_distances():
    rng = np.random.default_rng(3)
    c = rng.integers(-4000, 4000, (64, 4))
    near = rng.integers(0, 64, 5000)
    x = c[near] + rng.integers(-900, 900, (5000, 4))
    prev = np.where(rng.random(5000) < 0.05, rng.integers(0, 64, 5000), near)
    a, d, work = ball_codes.ball_assign(x, prev, c)
    fa, fd = ball_codes.full_assign(x, c)
    assert (a == fa).all() and (d == fd).all()
    assert 0 < work < 5000 * 63 // 3


def test_codes_of_small_and_odd_tables(spark):
    empty, books = ball_codes.compress(frame(spark, []))
    assert empty.collect() == [] and books == {}
    rows = [(1, [], 1), (2, [0.5] * 5, 1), (3, [0.25] * 5, None), (4, [1.0] * 32, 2)]
    codes, books = ball_codes.compress(frame(spark, rows))
    assert sorted((r.vec_id, r.dim, r.error) for r in codes.collect()) == [(1, 0, 0), (2, 5, 0), (3, 5, 0), (4, 32, 0)]
    assert {d: b.shape for d, b in books.items()} == {0: (16, 1, 0), 5: (16, 2, 1), 32: (16, 1, 2)}
    with pytest.raises(Exception, match="64 bits"):
        ball_codes.compress(frame(spark, [(1, [1e18] * 16, 1)]))


# -- 12 subspace pigeonhole join ---------------------------------------------------------------
def plain_links(rows, cosine):
    good = [i for i, (_, v, _) in enumerate(rows)
            if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {}
    for i in good:
        m = max(abs(x) for x in rows[i][1])
        w = [x / m for x in rows[i][1]]
        unit[i] = np.array(w) / math.sqrt(sum(x * x for x in w))
    near = {i: [] for i in range(len(rows))}
    for i in good:
        for j in good:
            if i != j and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= cosine:
                near[i].append(j)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        low = min(ids) if ids else None
        out.append((rows[i][0], len(near[i]), low, rows[i][0] == low))
    return sorted(out, key=str)


def cloud(seed, dim=16, n=240):
    """Chains, tight groups, exact copies and scattered vectors."""
    rng = np.random.default_rng(seed)
    x = [rng.normal(size=dim) for _ in range(n // 2)]
    for g in range(12):
        c = rng.normal(size=dim)
        x += [c + rng.normal(size=dim) * rng.choice([0.02, 0.1, 0.25, 0.35]) for _ in range(n // 30)]
    x += [x[int(i)] for i in rng.integers(0, len(x), 30)]
    x += [x[int(i)] * 3.0 for i in rng.integers(0, len(x), 10)]
    return [(int(i), v.tolist(), 0) for i, v in enumerate(x)]


@pytest.mark.parametrize("seed,dim,blocks,home,ask", [(2, 16, 4, 40, 90), (3, 12, 2, 60, 60)])
def test_links_equal_brute_force(spark, monkeypatch, seed, dim, blocks, home, ask):
    monkeypatch.setattr(vector_dedup, "HOME", home)      # small: several leaves, chunks and groups
    monkeypatch.setattr(vector_dedup, "ASK", ask)
    rows = cloud(seed, dim)
    rows += [(None, rows[3][1], 0), (None, [1e300] * dim, 0), (5, [1e-310] * dim, 0), (600, None, 0), (None, None, 0), (601, [0.0] * dim, 0),
             (602, [NAN] * dim, 0), (603, [], 0), (604, [1.0] * (dim + 1), 0), (605, [None] * dim, 0)]
    got = vector_dedup.near_duplicates(frame(spark, rows).repartition(5), blocks=blocks).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_links(rows, 0.95)


def test_hot_copies_and_a_hot_near_group(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "HOME", 64)
    monkeypatch.setattr(vector_dedup, "ASK", 128)
    rng = np.random.default_rng(9)
    c = rng.normal(size=8)
    rows = [(i, c.tolist(), 0) for i in range(700)]
    rows += [(1000 + i, (c + rng.normal(size=8) * 0.05).tolist(), 0) for i in range(300)]
    rows += [(2000 + i, rng.normal(size=8).tolist(), 0) for i in range(200)]
    got = vector_dedup.near_duplicates(frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_links(rows, 0.95)


@pytest.mark.parametrize("held, parts", [(40 * 8 * 16, 2), (1 << 30, 1), (90 * 8 * 16, 4)])
def test_links_by_parts_chunks_and_groups(spark, monkeypatch, held, parts):
    for name, value in (("HOME", 20), ("HELD", held), ("PARTS", parts), ("ASK", 50), ("ASK_HOMES", 1)):
        monkeypatch.setattr(vector_dedup, name, value)
    rows = cloud(4)
    got = vector_dedup.near_duplicates(frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_links(rows, 0.95)


def test_a_vector_is_copied_to_parts_and_not_to_leaves(spark, monkeypatch):
    """Isotropic vectors are near nearly every leaf; what is shuffled may not grow with the leaves."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist(), 0) for i in range(1000)]
    points, real = {}, vector_dedup.written

    def spy(df, name, *more):
        out = real(df, name, *more)
        if name == "points":
            points["rows"] = out.select("dim", F.explode("meets")).count()
            points["asked"] = out.select(F.explode("meets.leaves").alias("x")).agg(F.sum(F.size("x"))).first()[0]
        return out

    monkeypatch.setattr(vector_dedup, "written", spy)
    monkeypatch.setattr(vector_dedup, "HOME", 16)
    monkeypatch.setattr(vector_dedup, "PARTS", 2)
    got = vector_dedup.near_duplicates(frame(spark, rows)).collect()
    assert points["asked"] > 10_000 and points["rows"] <= 1000 * vector_dedup.BLOCKS * vector_dedup.PARTS
    assert sorted((tuple(r) for r in got), key=str) == plain_links(rows, 0.95)


def test_every_close_pair_is_asked_for():
    rng = np.random.default_rng(5)
    q = rng.integers(-1000, 1000, (400, 4)).astype(np.int32)
    tree = vector_dedup.Tree(q[:100], 16)
    limit = 300 ** 2
    row, leaf = tree.within(q, limit)
    asked = set(zip(row.tolist(), leaf.tolist()))
    home = tree.leaf(q)
    d = ((q[:, None].astype(np.int64) - q[None]) ** 2).sum(2)
    close = [(i, int(home[j])) for i, j in zip(*np.nonzero(d <= limit))]
    assert set(close) <= asked and len(asked) < 400 * 16


def test_empty_table(spark):
    assert vector_dedup.near_duplicates(frame(spark, [])).collect() == []
