"""Operator 12: embedding near-duplicates by a subspace pigeonhole join.

Unit vectors are rotated (two rounds of random signs and a Hadamard transform) and split into blocks of equal
width. Two vectors within squared distance 2 - 2 * cosine lie within their share of it in at least one
block, so the union of one range join a block misses no pair. Rotated coordinates are rounded to integers, and
the shares widened by the rounding, so that every block distance is exact and the same wherever it is computed.

A block's range join: a k-d tree (splits fitted on a bounded random sample, every vector is indexed) gives each
vector its home leaf; a vector also asks leaves whose box lies within the block's share. An unordered pair
meets once a block: in one of the two leaves, by turns the later and the earlier, and counts in the first block where
it is within the share. The leaves below one of the tree's upper nodes make a part of about HELD bytes; a vector is
copied once to each part in which it has a leaf to ask, and there it meets those leaves only. So the copies
grow with the parts that a vector is near to, and not with the leaves. Parts beyond HELD are cut into chunks and
their askers into groups; one task's unit is a (block, part, chunk, group). Pairs are never
emitted: a unit returns link counts by vector and, for the components, one edge a vector to the smallest vector
linked with it inside the unit. Equal vectors are one row from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.ball_codes import _binary, _matrix
from lectern.llm.common import discard, join_counted, load, written
from lectern.llm.components import connected_components

BLOCKS = 4                # blocks of rotated coordinates
HOME = 8192               # vectors a leaf, about
HELD = 96 << 20           # bytes of home vectors a chunk, about
PARTS = 8                 # parts a block, at least, if there are as many leaves
ASK = 65536               # vectors a group, or ASK_HOMES times those of its part
ASK_HOMES = 4
SAMPLE = 32768            # vectors the splits are fitted on, at most
PER_LEAF = 16             # sampled vectors a leaf, at least
GRID = 1 << 20            # integer steps a unit
SAMPLE_NUMBERS = 1 << 22  # coordinates the sample holds, at most
SLICE = 512               # askers compared with a chunk at a time
_SEED = 20240611


def unit_rows(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; a power of two first, so that no square overflows or vanishes."""
    _, e = np.frexp(np.abs(v).max(axis=1, keepdims=True))
    v = np.ldexp(v, -e)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def padded(dim: int) -> int:
    return 1 << max(0, (dim - 1).bit_length())


def rotate(u: np.ndarray) -> np.ndarray:
    """Integer coordinates of rotated rows: GRID steps a unit, the dimension filled up to a power of two."""
    n, dim = u.shape
    d = padded(dim)
    x = np.zeros((n, d))
    x[:, :dim] = u
    rng = np.random.Generator(np.random.PCG64(_SEED))
    for _ in range(2):
        x *= rng.integers(0, 2, d) * 2 - 1
        h = 1
        while h < d:
            y = x.reshape(n, d // (2 * h), 2, h)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
            h *= 2
        x /= math.sqrt(d)
    return np.rint(x * GRID).astype(np.int32)


def layout(dim: int, cosine: float, blocks: int) -> tuple[int, int, int]:
    """(blocks, width, the largest squared integer distance within a block's share)."""
    d = padded(dim)
    m = min(blocks, d)
    while d % m:
        m -= 1
    width = d // m
    share = math.sqrt(max(0.0, 2 - 2 * cosine) * width / d)
    return m, width, math.floor((share * GRID + math.sqrt(width) + 2) ** 2)


class Tree:
    """Median splits of one block's coordinates, as a heap of (coordinate, value); equal values go right."""

    def __init__(self, sample: np.ndarray, leaves: int, parts: int = 1) -> None:
        self.depth = max(0, (max(1, leaves) - 1).bit_length())
        self.below = self.depth - min(self.depth, (max(1, parts) - 1).bit_length())     # levels below a part's node
        size = 1 << self.depth
        self.axis, self.at = np.zeros(size, np.int64), np.full(size, -(1 << 40), np.int64)
        self.low = np.full((2 * size, sample.shape[1]), -(1 << 40), np.int64)
        self.high = np.full((2 * size, sample.shape[1]), 1 << 40, np.int64)
        held = {1: sample.astype(np.int64)}
        for node in range(1, size):
            part = held.pop(node)
            if len(part):
                axis = int(np.argmax(part.std(axis=0)))
                self.axis[node], self.at[node] = axis, int(np.median(part[:, axis]))
            a, s = self.axis[node], self.at[node]
            for child in (2 * node, 2 * node + 1):
                self.low[child], self.high[child] = self.low[node], self.high[node]
            self.high[2 * node, a] = min(self.high[node, a], s - 1)
            self.low[2 * node + 1, a] = max(self.low[node, a], s)
            right = part[:, a] >= s
            held[2 * node], held[2 * node + 1] = part[~right], part[right]
        self.first = size

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (x[np.arange(len(x)), self.axis[node]] >= self.at[node])
        return node - self.first

    def within(self, x: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves whose box is within ``limit`` squared distance of a row."""
        row, node = np.arange(len(x)), np.ones(len(x), np.int64)
        for _ in range(self.depth):
            gap = x[row, self.axis[node]] - self.at[node].astype(np.float64)
            # left box ends at value - 1: a row at or right of the split is gap + 1 away from it
            left = (gap < 0) | ((gap + 1) ** 2 <= limit)
            right = (gap >= 0) | (gap * gap <= limit)
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
        far = np.zeros(len(row), np.int64)
        for at in range(0, len(row), 1 << 16):
            s = slice(at, at + (1 << 16))
            v = x[row[s]].astype(np.int64)
            out = np.maximum(0, np.maximum(self.low[node[s]] - v, v - self.high[node[s]]))
            far[s] = (np.minimum(out, 1 << 24) ** 2).sum(axis=1)
        return row[far <= limit], node[far <= limit] - self.first


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances: integers below 2**53 in float64 whatever the order of the sums."""
    return (x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :]


def scaled(q: np.ndarray, block: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's coordinates in single precision (exact) and half their squared length."""
    x = q[:, block * width:(block + 1) * width].astype(np.float64) / GRID
    return x.astype(np.float32), (x * x).sum(axis=1) / 2


def links_between(x, y, block: int, width: int, limit: int, cosine: float, first: int | None = None):
    """(rows, columns, boolean links) of askers x and homes y that block ``block`` is the first to find, or None. Both
    are (integer coordinates, vectors, what :func:`scaled` gives); ``first``: x is y's rows from there on, and a
    pair counts in the earlier row only. A product in single precision leaves out what is surely beyond the share."""
    (xq, xv, xs, xx), (yq, yv, ys, yy) = x, y
    near = xs @ ys.T
    near -= yy.astype(np.float32)[None, :]
    margin = (width + 8) * 2.0 ** -22                       # blocks of unit vectors are no longer than 1
    found = near >= (xx - limit / GRID / GRID / 2 - margin).astype(np.float32)[:, None]
    if first is not None:
        found &= np.arange(len(yq))[None, :] > first + np.arange(len(xq))[:, None]
    at = np.flatnonzero(found.ravel())
    if not len(at):
        return None
    rows, cols = np.unique(at // len(yq)), np.flatnonzero(found.any(axis=0))
    part, a, b = found[np.ix_(rows, cols)], xq[rows].astype(np.float64), yq[cols].astype(np.float64)
    for k in range(block + 1):
        s = slice(k * width, (k + 1) * width)
        within = _distances(a[:, s], b[:, s]) <= limit
        part &= within if k == block else ~within
    if part.any():
        part &= unit_rows(xv[rows].astype(np.float64)) @ unit_rows(yv[cols].astype(np.float64)).T >= cosine
    return (rows, cols, part) if part.any() else None


def _stars(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node) for every node of a slice's link graph; each component becomes a star."""
    rows, cols = np.flatnonzero(found.any(axis=1)), np.flatnonzero(found.any(axis=0))
    m, x, y = found[np.ix_(rows, cols)], a[rows], b[cols]
    top = np.iinfo(np.int64).max
    lx, ly = x.copy(), y.copy()
    while True:
        nx = np.minimum(lx, np.where(m, ly[None, :], top).min(axis=1))
        ny = np.minimum(ly, np.where(m, nx[:, None], top).min(axis=0))
        if (nx == lx).all() and (ny == ly).all():
            return np.concatenate([x, y]), np.concatenate([lx, ly])
        lx, ly = nx, ny


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as the edges (a, b), one edge a node to the component's smallest node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[:len(a)], at[len(a):]
    lab = np.arange(len(nodes))
    while True:
        low = np.minimum(lab[u], lab[v])
        new = lab.copy()
        np.minimum.at(new, lab[u], low)
        np.minimum.at(new, lab[v], low)
        new = new[new]
        if (new == lab).all():
            keep = lab != np.arange(len(nodes))
            return nodes[keep], nodes[lab[keep]]
        lab = new


_POINT = ("node long, c long, dim int, q binary, v binary, "
          "meets array<struct<code:int,own:int,leaves:array<int>>>")


def _lists(ends: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)


def _prepare(trees: dict[int, list[Tree]], cosine: float, blocks: int, kind: type):
    """mapInArrow: class rows to points (node, c, dim, q, v, meets): for each part (``code``: part and block) that a
    vector goes to, its home leaf (-1: it only asks) and the other leaves that it asks there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = b.column("v")
            offs = vec.offsets.to_numpy().astype(np.int64)
            flat = vec.values.to_numpy(zero_copy_only=False)
            dims = np.diff(offs)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                for lo in range(0, len(at), max(1, (1 << 20) // dim)):
                    some = at[lo:lo + max(1, (1 << 20) // dim)]
                    v = flat[offs[some][:, None] + np.arange(dim)]
                    q = rotate(unit_rows(v))
                    m, width, limit = layout(dim, cosine, blocks)
                    n = len(some)
                    entries = []                             # row, code, leaf (-1: home), home leaf
                    for k, tree in enumerate(trees[dim]):
                        x = q[:, k * width:(k + 1) * width]
                        own = tree.leaf(x)
                        r, leaf = tree.within(x, limit)
                        turn = (leaf != own[r]) & ((leaf > own[r]) == ((leaf + own[r]) % 2 == 0))
                        r, leaf = r[turn], leaf[turn]
                        entries.append((np.arange(n), (own >> tree.below) * m + k, np.full(n, -1), own))
                        entries.append((r, (leaf >> tree.below) * m + k, leaf, own[r]))
                    row, code, leaf, own = (np.concatenate(x) for x in zip(*entries))
                    order = np.lexsort((leaf, code, row))
                    row, code, leaf, own = row[order], code[order], leaf[order], own[order]
                    new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])))
                    ends = np.append(0, np.cumsum(leaf >= 0))[np.append(new, len(row))]
                    meets = pa.StructArray.from_arrays(
                        [pa.array(code[new].astype(np.int32)), pa.array(np.where(leaf[new] < 0, own[new], -1).astype(np.int32)),
                         _lists(ends, pa.array(leaf[leaf >= 0].astype(np.int32)))], names=["code", "own", "leaves"])
                    yield pa.RecordBatch.from_arrays(
                        [b.column("node").take(pa.array(some)), b.column("c").take(pa.array(some)), pa.array(np.full(n, dim, np.int32)),
                         _binary(q), _binary(v.astype(kind)), _lists(np.searchsorted(row[new], np.arange(n + 1)), meets)],
                        names=["node", "c", "dim", "q", "v", "meets"])

    return run


def _units(cosine: float, blocks: int, kind: type):
    """mapInArrow over rows sorted by unit, homes first: (a, null, links) and edges (a, b, null)."""

    def out(a, b=None, n=None) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), none if b is None else pa.array(b, pa.int64()),
                                           none if n is None else pa.array(n, pa.int64())], names=["a", "b", "n"])

    def settle(unit) -> None:
        """All homes are in: sort them by leaf and compare them with each other."""
        if unit["homes"] is not None:
            return
        parts = unit.pop("parts")
        rows, own = tuple(np.concatenate(x) for x in zip(*(p[0] for p in parts))), np.concatenate([p[1] for p in parts])
        past = np.append(0, np.cumsum([len(p[1]) for p in parts]))
        row, leaf = (np.concatenate(x) for x in zip(*((p[2] + lo, p[3]) for p, lo in zip(parts, past))))
        parts.clear()
        order = np.argsort(own, kind="stable")
        unit["homes"] = tuple(x[order] for x in rows)
        unit["scaled"] = scaled(unit["homes"][2], unit["block"], unit["width"])
        unit["links"] = np.zeros(len(own), np.int64)
        leaves, start = np.unique(own[order], return_index=True)
        ends = [*start[1:].tolist(), len(own)]
        unit["leaves"] = dict(zip(leaves.tolist(), zip(start.tolist(), ends)))
        if unit["first"]:
            for lo, hi in unit["leaves"].values():
                for at in range(lo, hi, SLICE):
                    meet(unit, unit["homes"], unit["scaled"], np.arange(at, min(at + SLICE, hi)), at, hi, unit["links"], True)
            place = np.empty(len(own), np.int64)
            place[order] = np.arange(len(own))
            ask(unit, unit["homes"], unit["scaled"], place[row], leaf, unit["links"])

    def finish(unit) -> Iterator[pa.RecordBatch]:
        if unit:
            settle(unit)
            node = unit["homes"][0]
            if (unit["links"] > 0).any():
                yield out(node[unit["links"] > 0], n=unit["links"][unit["links"] > 0])
            if unit["edges"]:
                yield out(*_forest(*(np.concatenate(e) for e in zip(*unit["edges"]))))

    def ask(unit, rows, own_scaled, row: np.ndarray, leaf: np.ndarray, links: np.ndarray) -> None:
        """Row ``row[i]`` of the askers asks leaf ``leaf[i]``; adds to the askers' links."""
        order = np.argsort(leaf, kind="stable")
        row, leaf = row[order], leaf[order]
        found, start = np.unique(leaf, return_index=True)
        for i, lo, hi in zip(found.tolist(), start.tolist(), [*start[1:].tolist(), len(leaf)]):
            if i in unit["leaves"]:
                for at in range(lo, hi, SLICE):
                    meet(unit, rows, own_scaled, row[at:min(at + SLICE, hi)], *unit["leaves"][i], links)

    def meet(unit, rows, own_scaled, at: np.ndarray, lo: int, hi: int, links: np.ndarray, upper: bool = False) -> None:
        """Askers ``at`` meet the homes from ``lo`` to ``hi`` (``upper``: they are homes, the first of them at ``lo``)."""
        hn, hc, hq, hv = unit["homes"]
        hs, hh = unit["scaled"]
        an, ac = rows[0][at], rows[1][at]
        x = (rows[2][at], rows[3][at], own_scaled[0][at], own_scaled[1][at])
        for b in range(lo, hi, HOME):
            s = slice(b, min(b + HOME, hi))
            got = links_between(x, (hq[s], hv[s], hs[s], hh[s]), unit["block"], unit["width"], unit["limit"], cosine, lo - b if upper else None)
            if got is None:
                continue
            i, j, found = got
            weight = found.astype(np.float64)
            links[at[i]] += (weight @ hc[s][j]).astype(np.int64)
            unit["links"][b + j] += (ac[i] @ weight).astype(np.int64)
            unit["edges"].append(_stars(found, an[i], hn[s][j]))
            unit["held"] += len(unit["edges"][-1][0])
            if unit["held"] > 1 << 20:
                unit["edges"] = [_forest(*(np.concatenate(e) for e in zip(*unit["edges"])))]
                unit["held"] = 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, unit = None, None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("dim", "code", "chunk", "grp", "kind")], axis=1)
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(keys)]):
                if hi == lo:
                    continue
                dim, code, chunk, grp, asks = keys[lo].tolist()
                if (dim, code, chunk, grp) != key:
                    yield from finish(unit)
                    key = (dim, code, chunk, grp)
                    m, width, limit = layout(dim, cosine, blocks)
                    unit = {"block": code % m, "width": width, "limit": limit, "parts": [], "homes": None, "edges": [], "held": 0,
                            "first": grp == 0}
                part = b.slice(lo, hi - lo)
                rows = (part.column("node").to_numpy(), part.column("c").to_numpy().astype(np.float64),
                        _matrix(part.column("q"), padded(dim), np.int32), _matrix(part.column("v"), dim, kind))
                leaves = part.column("leaves")
                row, leaf = np.repeat(np.arange(hi - lo), np.diff(leaves.offsets.to_numpy())), leaves.flatten().to_numpy()
                if asks == 0:
                    unit["parts"].append((tuple(x.copy() for x in rows), part.column("own").to_numpy().copy(), row, leaf.copy()))
                    continue
                settle(unit)
                links = np.zeros(len(rows[0]), np.int64)
                ask(unit, rows, scaled(rows[2], unit["block"], unit["width"]), row, leaf, links)
                if (links > 0).any():
                    yield out(rows[0][links > 0], n=links[links > 0])
        yield from finish(unit)

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, cosine: float = 0.95,
                    blocks: int = BLOCKS) -> DataFrame:
    """One row a vector: ``id_col``, n_links, component_id, kept.

    Two vectors of one dimension are linked if their cosine, in double precision, is ``cosine`` or more. n_links
    counts the other rows linked directly (equal vectors are), component_id is the smallest id reachable, kept
    says whether that is the row's own. Vectors that are null, empty, zero or hold a null, NaN or infinite
    component link with nothing and name themselves. A null id names no component; a component without any id
    has a null component_id and all its rows are kept. Repeated ids are rows each. An empty table gives none.
    """
    v = F.col(vec_col).cast("array<double>")
    fine = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
                      & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), F.when(fine, v).alias("v"))
    classes = written(rows.where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("lo"))
                      .select(F.monotonically_increasing_id().alias("node"), "v", "c", "lo"), "classes")
    trees = _trees(classes, cosine, blocks)
    single = isinstance(getattr(vectors.select(vec_col).schema[0].dataType, "elementType", None), T.FloatType)
    edges, links = _links(classes, trees, cosine, blocks, np.float32 if single else np.float64)
    labels = connected_components(edges)
    named = classes.select("node", "lo").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "lo")
    tops = written(named.groupBy("label").agg(F.min("lo").alias("component_id"), F.count(F.lit(1)).alias("n")), "components")
    comp = join_counted(named.select("node", "label"), tops, ["label"], "n").select("node", "component_id")
    result = written(classes.join(links, "node", "left").join(comp, "node")
                     .select("v", "c", (F.col("c") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "result")
    alone = rows.where("v IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    both = join_counted(rows.where("v IS NOT NULL"), result, ["v"], "c").select("id", "n_links", "component_id").unionByName(alone)
    return both.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _trees(classes: DataFrame, cosine: float, blocks: int) -> dict[int, list[Tree]]:
    """A tree a block and dimension, fitted on at most SAMPLE random vectors or SAMPLE_NUMBERS coordinates."""
    sizes = {r.dim: r.n for r in classes.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    trees = {}
    for dim, n in sizes.items():
        most = max(PER_LEAF, min(SAMPLE, SAMPLE_NUMBERS // padded(dim)))
        m, width, _ = layout(dim, cosine, blocks)
        leaves = min(-(-n // HOME), most // PER_LEAF)
        q = np.zeros((0, padded(dim)), np.int32)
        if leaves > 1:
            some = classes.where(F.size("v") == dim).sample(min(1.0, 0.9 * most / n), seed=7).select("v").limit(most)
            table = some.toArrow().column("v").combine_chunks()
            flat = table.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            q = rotate(unit_rows(flat)) if len(flat) else q
        parts = max(min(PARTS, leaves), -(-n * 8 * dim // HELD))
        trees[dim] = [Tree(q[:, k * width:(k + 1) * width], leaves if len(q) else 1, parts) for k in range(m)]
    return trees


def _links(classes: DataFrame, trees: dict[int, list[Tree]], cosine: float, blocks: int, kind: type) -> tuple[DataFrame, DataFrame]:
    """(edges (a, b) that keep the components, links by node)."""
    points = written(classes.select("node", "c", "v").mapInArrow(_prepare(trees, cosine, blocks, kind), _POINT), "points")
    # a leaf and a chunk may be crowded whatever the trees are: limits hold for what was counted
    most = F.greatest(F.lit(HOME), F.floor(F.lit(HELD) / (8 * F.col("dim"))))
    units = written(points.select("dim", F.explode("meets").alias("m")).groupBy("dim", F.col("m.code").alias("code"))
                    .agg(F.sum((F.col("m.own") >= 0).cast("long")).alias("h"), F.count(F.lit(1)).alias("n")).where("h > 0")
                    .select("dim", "code", F.ceil(F.col("h") / most).cast("int").alias("chunks"),
                            F.ceil(F.col("n") / F.greatest(F.lit(ASK), F.col("h") * ASK_HOMES)).cast("int").alias("grps")), "units")
    count = units.agg(F.sum(F.col("chunks") * F.col("grps"))).first()[0] or 1

    def spread(n: str, salt: int):
        return F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")

    payload = ["node", "c", "dim", "q", "v", "code", "own"]
    # a tree has at most SAMPLE // PER_LEAF leaves: the unit table is bounded whatever the input
    met = (points.select("node", "c", "dim", "q", "v", F.explode("meets").alias("m")).select("node", "c", "dim", "q", "v", "m.*")
           .join(F.broadcast(units), ["dim", "code"]))
    home = met.where("own >= 0").withColumn("chunk", spread("chunks", 1))
    homes = home.select(*payload, "leaves", "chunk", F.explode(F.sequence(F.lit(0), F.col("grps") - 1)).alias("grp"), F.lit(0).alias("kind"))
    # homes of other chunks: the leaves asked, and the own leaf in later chunks
    other = (home.where("chunks > 1").withColumn("grp", spread("grps", 2)).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .where(F.col("to") != F.col("chunk"))
             .withColumn("leaves", F.when(F.col("to") > F.col("chunk"), F.concat("leaves", F.array("own"))).otherwise(F.col("leaves")))
             .where(F.size("leaves") > 0).select(*payload, "leaves", F.col("to").alias("chunk"), "grp", F.lit(1).alias("kind")))
    asks = (met.where("own < 0").withColumn("grp", spread("grps", 2))
            .select(*payload, "leaves", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "grp", F.lit(1).alias("kind")))
    rows = homes.unionByName(other).unionByName(asks)
    keys = ["dim", "code", "chunk", "grp"]
    found = written(rows.repartition(min(int(count), 100_000), *keys).sortWithinPartitions(*keys, "kind")
                    .mapInArrow(_units(cosine, blocks, kind), "a long, b long, n long"), "links")
    discard(points)
    return (found.where("b IS NOT NULL").select("a", "b"),
            found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links")))


def op12(spark, sf_dir: str) -> DataFrame:
    """Link counts and components of all ``embeddings`` at cosine 0.95."""
    return near_duplicates(load(spark, sf_dir, "embeddings"))
