"""J2 with an index: an inverted file of coarse cells, searched exactly by the triangle inequality.

Building: centres are fitted on a bounded random sample, every unit vector goes to its nearest centre, and each
cell is stored once, in blocks sorted by the distance to the centre. A vector at distance d from the centre is at
least ``|d(q, centre) - d|`` away from a query q, and a cell of radius r at least ``d(q, centre) - r``.

Searching: a query first visits its nearest cells; its k-th distance there bounds the answer. Then it reads of each
other cell only the ring of distances that can matter, none if the bound is beyond. Nothing outside can be among
the best k, so the result is that of the exact join. For the second step packed queries and cells are dealt over a
grid (``knn.grid``) and the bounds are taken where they meet, so a query is copied to a few parts of the index
and not to each cell: vectors without clusters, of which hardly any cell can be left out, cost no more disk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators.knn import Nearest, _best, grid, salted, vectors_of
from lectern.params import DEFAULT, Params
from lectern.session import materialise

SAMPLE = 16_384          # vectors the centres are fitted on, at most
SAMPLE_NUMBERS = 1 << 22  # and components
CELLS = 1024             # cells a dimension, at most
PER_CELL = 16            # sampled vectors a cell, at least
ROUNDS = 4               # rounds of moving the centres to the means of their sampled vectors
FIRST = 2                # cells a query visits before its bound is known
EXTRA = ("kth", *(f"first_{i}" for i in range(FIRST)))   # what packed queries carry to the second step
SLACK = 1e-7             # of the bounds, against rounding (a distance comes from a root)


@dataclass(frozen=True)
class Index:
    """Stored blocks (key, dim, cell, n, low, high, ids, dists, data) and, by dimension, centres and radii."""

    blocks: DataFrame
    centres: dict[int, np.ndarray]
    radii: dict[int, np.ndarray]


def _matrix(vec: pa.ListArray, at: np.ndarray, offs: np.ndarray, flat: np.ndarray, dim: int) -> np.ndarray:
    return flat[offs[at][:, None] + np.arange(dim)]


def _width(rows: DataFrame, vec: str = "vec") -> type:
    """Floats are kept in single precision, other numbers in double."""
    return np.float32 if isinstance(rows.schema[vec].dataType.elementType, T.FloatType) else np.float64


def _unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def _usable(col: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, rows, vectors) of the usable vectors of a column, by dimension."""
    flat = col.values.to_numpy(zero_copy_only=False).astype(np.float64)
    offs = col.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.where(col.is_valid().to_numpy(zero_copy_only=False), np.diff(offs), 0)
    for dim in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == dim)
        m = _matrix(col, at, offs, flat, dim)
        fine = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
        yield dim, at[fine], m[fine]


def _gaps(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of unit rows to centres."""
    return np.sqrt(np.maximum(0.0, 1 - 2 * (x @ c.T) + np.einsum("ij,ij->i", c, c)[None, :]))


def _fit(sample: np.ndarray, cells: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(11))
    centres = sample[rng.permutation(len(sample))[:cells]].copy()
    for _ in range(ROUNDS):
        near = _gaps(sample, centres).argmin(axis=1)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def _centres(corpus: DataFrame) -> dict[int, np.ndarray]:
    """Centres of each dimension, from at most SAMPLE vectors or SAMPLE_NUMBERS components of it."""
    vec = F.col("vec")
    sizes = corpus.where(F.size(vec) > 0).groupBy(F.size(vec).alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()
    out = {}
    for dim, n in sizes:
        most = max(PER_CELL, min(SAMPLE, SAMPLE_NUMBERS // dim))
        some = corpus.where(F.size(vec) == dim).sample(min(1.0, 0.9 * most / n), seed=5).select("vec").limit(most).toArrow()
        parts = [_unit(m) for _, _, m in _usable(some.column("vec").combine_chunks())] if some.num_rows else []
        m = parts[0] if parts and len(parts[0]) else np.eye(1, dim)
        out[dim] = _fit(m, max(1, min(CELLS, math.isqrt(n), len(m) // PER_CELL)))
    return out


def _packer(id_col: str, schema: T.StructType, params: Params, extra: tuple[str, ...]):
    """mapInArrow over rows (key, dim, cell, id, vec, *extra) sorted by the first three: blocks of one cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now, rows = None, 0

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            cols = [pa.array([v], f) for v, f in zip(now, (pa.string(), pa.int32(), pa.int32()))] + [pa.array([t.num_rows], pa.int32())]
            ids = t.column(id_col).combine_chunks()
            cols.append(pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids))
            numbers = [t.column(e).to_numpy() for e in extra]
            cols += [pa.array([float(numbers[0].min())]), pa.array([float(numbers[-1].max())])]
            cols += [pa.array([x.astype(np.float64).tobytes()], pa.binary()) for x in numbers]
            data = t.column("vec").combine_chunks()
            cols.append(pa.array([b"".join(v.as_buffer() for v in data)], pa.binary()))
            return pa.RecordBatch.from_arrays(cols, names=schema.names)

        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in ("key", "dim", "cell"))))
            at = 0
            while at < len(keys):
                limit = max(1, min(params.knn_query_block, params.knn_max_block_bytes // (8 * keys[at][1])))
                if held and (keys[at] != now or rows >= limit):
                    yield out()
                    held.clear()
                    rows = 0
                now, to = keys[at], at + 1
                while to < len(keys) and keys[to] == now and rows + to - at < limit:
                    to += 1
                held.append(b.slice(at, to - at))
                rows += to - at
                at = to
        if held:
            yield out()

    return run


def _block_type(ids: str, id_type: T.DataType, numbers: list[str], data: str) -> T.StructType:
    f = [T.StructField("key", T.StringType()), T.StructField("dim", T.IntegerType()), T.StructField("cell", T.IntegerType()),
         T.StructField("n", T.IntegerType()), T.StructField(ids, T.ArrayType(id_type)), T.StructField(f"{ids}_low", T.DoubleType()),
         T.StructField(f"{ids}_high", T.DoubleType())]
    return T.StructType(f + [T.StructField(x, T.BinaryType()) for x in [*numbers, data]])


def build(corpus: DataFrame, path: str, *, id_col: str = "chunk_id", vec_col: str = "embedding", keys: Column | None = None,
          params: Params = DEFAULT) -> Index:
    """Write the index of all usable vectors (see ``knn.invalid_vectors``) under ``path`` and open it.

    ``keys`` is an array of strings: a vector is found by queries that ask for one of its keys (``knn.corpus_keys``
    for metadata filters); without it every query searches all. A cell that holds a third of the vectors is
    spread over many blocks, by distance.
    """
    rows = corpus.select((keys if keys is not None else F.array(F.lit(""))).alias("keys"), F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    centres = _centres(rows)
    id_type, width = corpus.schema[id_col].dataType, _width(rows)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, at, m in _usable(b.column("vec")):
                for lo in range(0, len(at), 4096):
                    part, some = m[lo:lo + 4096], pa.array(at[lo:lo + 4096])
                    gap = _gaps(_unit(part), centres[dim])
                    cell = gap.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("keys").take(some), b.column("id").take(some), pa.array(np.full(len(part), dim, np.int32)),
                         pa.array(cell.astype(np.int32)), pa.array(gap[np.arange(len(part)), cell]),
                         pa.array([v.tobytes() for v in part.astype(width)], pa.binary())], names=["keys", "id", "dim", "cell", "dist", "vec"])

    schema = T.StructType([rows.schema["keys"], T.StructField("id", id_type), T.StructField("dim", T.IntegerType()),
                           T.StructField("cell", T.IntegerType()), T.StructField("dist", T.DoubleType()), T.StructField("vec", T.BinaryType())])
    placed = materialise(rows.mapInArrow(assign, schema), "ivf-rows").select(F.explode("keys").alias("key"), "id", "dim", "cell", "dist", "vec")
    order = ["key", "dim", "cell", "dist", "id"]
    kind = _block_type("ids", id_type, ["dists"], "data")
    (placed.repartitionByRange(*order).sortWithinPartitions(*order)
     .mapInArrow(_packer("id", kind, params, ("dist",)), kind).write.mode("overwrite").parquet(f"{path}/blocks"))
    spark = corpus.sparkSession
    flat = [(d, i, c.tolist()) for d, m in centres.items() for i, c in enumerate(m)]
    cells = spark.createDataFrame(flat, "dim int, cell int, centre array<double>")
    radii = spark.read.parquet(f"{path}/blocks").groupBy("dim", "cell").agg(F.max("ids_high").alias("radius"))
    cells.join(radii, ["dim", "cell"], "left").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    """The index written under ``path``: its centres (at most CELLS a dimension) come to the driver."""
    centres: dict[int, list] = {}
    radii: dict[int, list] = {}
    for r in sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: (r.dim, r.cell)):
        centres.setdefault(r.dim, []).append(r.centre)
        radii.setdefault(r.dim, []).append(-math.inf if r.radius is None else r.radius)      # an empty cell is never visited
    return Index(spark.read.parquet(f"{path}/blocks"), {d: np.array(c) for d, c in centres.items()}, {d: np.array(r) for d, r in radii.items()})


def _read(k: int, min_score: float | None, exclude_self: bool, names: list[str]):
    """mapInArrow over (cell block, query block): the best k of the ring, and a row a query with what was read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                dim = b.column("dim")[i].as_py()
                qids, cids = b.column("qids")[i].values, b.column("ids")[i].values
                low, high, dists = (np.frombuffer(b.column(c)[i].as_py(), np.float64) for c in ("low", "high", "dists"))
                q, c = (_unit(vectors_of(b.column(x)[i], dim, len(ids))) for x, ids in (("qdata", qids), ("data", cids)))
                qa, ca = (np.asarray(x.to_pylist()) for x in (qids, cids))
                start, stop = np.searchsorted(dists, low, "left"), np.searchsorted(dists, high, "right")
                for at in range(0, len(q), max(1, 4_000_000 // len(c))):
                    s = slice(at, at + max(1, 4_000_000 // len(c)))
                    lo, hi = int(start[s].min()), int(stop[s].max())
                    if lo < hi:
                        place = np.arange(lo, hi)[None, :]
                        sims = q[s] @ c[lo:hi].T
                        sims[(place < start[s, None]) | (place >= stop[s, None])] = np.nan
                        if min_score is not None:
                            sims[sims < min_score] = np.nan
                        if exclude_self:
                            sims[qa[s][:, None] == ca[None, lo:hi]] = np.nan
                        qi, cj = _best(sims, ca[lo:hi], k)
                        yield pa.RecordBatch.from_arrays([qids.take(pa.array(qi + at)), cids.take(pa.array(cj + lo)), pa.array(sims[qi, cj]),
                                                          pa.nulls(len(qi), pa.int64())], names=names)
                yield pa.RecordBatch.from_arrays([qids, pa.nulls(len(q), cids.type), pa.nulls(len(q), pa.float64()),
                                                  pa.array(np.maximum(0, stop - start).astype(np.int64))], names=names)

    return run


def _rings(k: int, exclude_self: bool, all_centres: dict[int, np.ndarray], names: list[str]):
    """mapInArrow over the cells of a grid, each its query blocks first: the best k of what the rings of the blocks
    that a query has not visited hold, and a row a query with what was read. The bound falls with what is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, near = None, [], None

        def finish() -> Iterator[pa.RecordBatch]:
            if near is None:
                return
            for q, c, s in near.found():
                yield pa.RecordBatch.from_arrays([q, c, s, pa.nulls(len(q), pa.int64())], names=names)
            at = np.flatnonzero(reads)
            if len(at):
                yield pa.RecordBatch.from_arrays([near.ids.take(pa.array(at)), pa.nulls(len(at), id_type), pa.nulls(len(at), pa.float64()),
                                                  pa.array(reads[at])], names=names)

        for b in batches:
            id_type = b.schema.field("ids").type.value_type
            places = list(zip(*(b.column(c).to_pylist() for c in ("key", "dim", "_row", "_col"))))
            cells = b.column("cell").to_pylist()
            for i, at in enumerate(places):
                if at != now:
                    yield from finish()
                    now, held, near = at, [], None
                if b.column("qids")[i].is_valid:
                    ids = b.column("qids")[i].values
                    held.append((ids, vectors_of(b.column("data")[i], at[1], len(ids)),
                                 *(np.frombuffer(b.column(x)[i].as_buffer(), np.float64) for x in EXTRA)))
                    continue
                if near is None:
                    if not held:
                        continue
                    ids, m, kth, *first = zip(*held)
                    near = Nearest(np.concatenate(m), pa.concat_arrays(ids), k, np.concatenate(kth), exclude_self, False)
                    first = np.stack([np.concatenate(x) for x in first], axis=1)
                    reads, held, unit = np.zeros(len(first), np.int64), [], _unit(near.q)
                cell, ids = cells[i], b.column("ids")[i].values
                dists = np.frombuffer(b.column("dists")[i].as_buffer(), np.float64)
                data = vectors_of(b.column("data")[i], at[1], len(ids))
                centre = all_centres[at[1]][cell:cell + 1]
                for lo in range(0, len(near.q), 16_384):
                    rows = np.arange(lo, min(lo + 16_384, len(near.q)))
                    gap = _gaps(unit[rows], centre)[:, 0]
                    reach = np.where(near.floor[rows] == -np.inf, 9.0, np.sqrt(np.maximum(0.0, 2 - 2 * near.floor[rows]))) + SLACK
                    go = (gap - reach <= dists[-1]) & (gap + reach >= dists[0]) & (first[rows] != cell).all(axis=1)
                    rows, gap, reach = rows[go], gap[go], reach[go]
                    start, stop = np.searchsorted(dists, gap - reach, "left"), np.searchsorted(dists, gap + reach, "right")
                    reads[rows] += stop - start
                    if len(rows):
                        ring = slice(int(start.min()), int(stop.max()))
                        if ring.start < ring.stop:
                            near.offer(data[ring], ids[ring], rows)
        yield from finish()

    return run


def search(index: Index, queries: DataFrame, k: int, *, query_id: str = "query_id", query_vec: str = "embedding", corpus_id: str = "chunk_id",
           key: Column | None = None, min_score: float | None = None, exclude_self: bool = False, params: Params = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(hits, reads): each query's exact best k as ``query_id, <corpus_id>, similarity, rank``, the rows of
    ``knn.knn_join``; and ``query_id, vectors_read``. ``key`` names the key a query asks for (see :func:`build`);
    ties go to the smaller id; unusable query vectors meet nothing."""
    rows = queries.select(F.col(query_id).alias("qid"), (key if key is not None else F.lit("")).alias("key"), F.col(query_vec).alias("vec"))
    qtype, ctype = queries.schema[query_id].dataType, index.blocks.schema["ids"].dataType.elementType

    centres, radii, width = index.centres, index.radii, _width(rows)

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, at, m in _usable(b.column("vec")):
                if dim not in centres:
                    continue
                full = np.isfinite(radii[dim])
                for lo in range(0, len(at), 1024):
                    part, some = m[lo:lo + 1024], pa.array(at[lo:lo + 1024])
                    near = np.argsort(_gaps(_unit(part), centres[dim]) + np.where(full, 0, 9), axis=1, kind="stable")[:, :FIRST]
                    near = np.where(full[near], near, -1)
                    near = np.pad(near, ((0, 0), (0, FIRST - near.shape[1])), constant_values=-1)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("qid").take(some), b.column("key").take(some), pa.array(np.full(len(part), dim, np.int32)),
                         pa.array([v.tobytes() for v in part.astype(width)], pa.binary()),
                         *(pa.array(x.astype(np.int32)) for x in near.T)], names=base.names)

    base = T.StructType([T.StructField("qid", qtype), T.StructField("key", T.StringType()), T.StructField("dim", T.IntegerType()),
                         T.StructField("vec", T.BinaryType()), *(T.StructField(x, T.IntegerType()) for x in EXTRA[1:])])
    asked = materialise(rows.mapInArrow(units, base), "ivf-queries")
    out = T.StructType([T.StructField("query_id", qtype), T.StructField(corpus_id, ctype), T.StructField("similarity", T.DoubleType()),
                        T.StructField("read", T.LongType())])

    def packed(asking: DataFrame, extra: list[str], data: str) -> DataFrame:
        block, order = _block_type("qids", qtype, extra, data), ["key", "dim", "cell", extra[0], "qid"]
        return materialise(asking.select("qid", "key", "dim", "cell", "vec", *[F.col(x).cast("double").alias(x) for x in extra])
                           .repartitionByRange(*order).sortWithinPartitions(*order)
                           .mapInArrow(_packer("qid", block, params, tuple(extra)), block), "ivf-visits")

    # the nearest cells, whole
    visits = packed(asked.select("qid", "key", "dim", "vec", F.explode(F.array(*EXTRA[1:])).alias("cell"), F.lit(-9.0).alias("low"),
                                 F.lit(9.0).alias("high")).where("cell >= 0"), ["low", "high"], "qdata")
    c, q = salted(index.blocks.drop("n"), visits.drop("n"), ["key", "dim", "cell"])
    one = materialise(c.join(q, ["key", "dim", "cell", "salt"]).select("dim", "ids", "dists", "data", "qids", "low", "high", "qdata")
                      .mapInArrow(_read(k, min_score, exclude_self, out.names), out), "ivf-found")

    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col(corpus_id))

    def best(found: DataFrame) -> DataFrame:
        return found.where("read IS NULL").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("read")

    # the rings of the others; a similarity may differ in its last bits from that of the first visit
    least = F.lit(-math.inf if min_score is None else float(min_score))
    kth = best(one).where(F.col("rank") == k).select(F.col("query_id").alias("qid"), (F.col("similarity") - 1e-12).alias("kth"))
    rest = packed(asked.join(kth, "qid", "left").withColumn("kth", F.greatest(F.coalesce("kth", least), least)).withColumn("cell", F.lit(0)), list(EXTRA), "data")
    q, c = grid(rest.select("key", "dim", "qids", "data", *EXTRA), index.blocks.select("key", "dim", "cell", "ids", "dists", "data"), ["key", "dim"],
                widths=(np.dtype(width).itemsize,) * 2)
    place = ["key", "dim", "_row", "_col"]
    met = (q.unionByName(c, allowMissingColumns=True).repartition(*place)
           .sortWithinPartitions(*place, F.col("qids").isNull(), "cell"))     # its queries first
    two = materialise(met.mapInArrow(_rings(k, exclude_self, centres, out.names), out), "ivf-found")
    both = one.unionByName(two)
    reads = both.where("read IS NOT NULL").groupBy("query_id").agg(F.sum("read").alias("vectors_read"))
    return best(both), reads
