"""Operator 10: exact top-k by inner product with vector-approximation files.

Vectors are packed into blocks; each block keeps a small cell number per component
(the approximation file). For a (query block, candidate block) pair the cells give
an upper and a lower bound of every score, and exact vectors are read in descending
order of the upper bound until the k-th best exact score is certain. Blocks meet in
a salted equi-join (a stated query set against all rows), and a window takes the
best k of the few rows each pair returns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import load, written

BLOCK = 8192            # candidate vectors a block
QUERY_BLOCK = 2048      # query vectors a block
GROUP = 4               # candidate blocks that share one copy of a query block
LEVELS = 64             # cells a component
LARGEST = 1 << 62       # scaled components stay below


def valid_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v array<long>): floor(scale * x) of each component; vectors that are null, empty or hold a
    null or non-finite component are left out, and so are rows with a null id. A scaled component of
    2**62 or more stops the job: scores could not be told in a long."""
    v = F.col(vec_col).cast("array<double>")
    good = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))

    def cell(x: Column) -> Column:
        y = F.lit(float(scale)) * x
        return F.when(F.abs(y) < float(LARGEST), F.floor(y)) \
                .otherwise(F.raise_error(F.lit("a vector component is too large for exact scores"))).cast("long")

    return (vectors.where(F.col(id_col).isNotNull() & F.coalesce(good, F.lit(False)))
            .select(F.col(id_col).cast("long").alias("id"),
                    F.transform(v, cell).alias("v")))


def pack(rows: DataFrame, block: int) -> DataFrame:
    """Blocks (dim, n, ids binary, data binary) of at most ``block`` vectors of one dimension each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(dim: int) -> pa.RecordBatch:
            ids, parts, _ = held.pop(dim)
            data = np.concatenate(parts)
            ids = np.concatenate(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()),
                 pa.array([ids.tobytes()], pa.binary()), pa.array([data.astype(np.int64).tobytes()], pa.binary())],
                names=["dim", "n", "ids", "data"])

        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            vec = b.column(1)
            flat = vec.flatten().to_numpy(zero_copy_only=False)
            size = np.diff(vec.offsets.to_numpy())
            start = np.concatenate([[0], np.cumsum(size)])
            for dim in np.unique(size).tolist():
                at = np.flatnonzero(size == dim)
                for lo in range(0, len(at), block):
                    part = at[lo:lo + block]
                    while len(part):
                        h = held.setdefault(dim, [[], [], 0])
                        take = part[:block - h[2]]
                        h[0].append(ids[take])
                        h[1].append(flat[start[take][:, None] + np.arange(dim)])
                        h[2] += len(take)
                        part = part[len(take):]
                        if h[2] >= block:
                            yield out(dim)
        for dim in sorted(held):
            yield out(dim)

    return rows.mapInArrow(run, "dim int, n int, ids binary, data binary")


class Approximation:
    """Equal-width cells per component and the value range of each cell."""

    def __init__(self, data: np.ndarray) -> None:
        lo, hi = data.min(axis=0), data.max(axis=0)
        step = np.maximum((hi - lo) // LEVELS + 1, 1)
        self.cell = ((data - lo) // step).astype(np.uint8)
        self.low = lo + self.cell.astype(np.int64) * step
        self.high = np.minimum(self.low + step - 1, hi)


def search(qids: np.ndarray, q: np.ndarray, cids: np.ndarray, c: np.ndarray, k: int):
    """Exact best k of a candidate block for each query: arrays (query, vec, score), ties to the
    smaller id; a candidate with the query's own id takes no part."""
    big = max(int(np.abs(q).max()), 1) * max(int(np.abs(c).max()), 1) * q.shape[1]
    if big >= 1 << 63:
        raise OverflowError("vector components are too large: a score may not fit a long")
    va = Approximation(c)
    kind = np.float64 if big < 1 << 52 else np.longdouble
    pos, neg = np.maximum(q, 0).astype(kind), np.minimum(q, 0).astype(kind)
    low, high, exact = va.low.astype(kind), va.high.astype(kind), c.astype(kind)
    out = []
    for at in range(0, len(q), 256):
        s = slice(at, at + 256)
        upper = pos[s] @ high.T + neg[s] @ low.T
        lower = pos[s] @ low.T + neg[s] @ high.T
        own = qids[s][:, None] == cids[None, :]
        upper[own] = lower[own] = -np.inf
        m = min(k, len(cids))
        # the m-th best lower bound is a floor for the k-th best score
        floor = -np.partition(-lower, m - 1, axis=1)[:, m - 1]
        for i in range(upper.shape[0]):
            cand = np.flatnonzero((upper[i] >= floor[i]) & (upper[i] > -np.inf))
            cand = cand[np.argsort(-upper[i, cand], kind="stable")]
            qi = q[at + i].astype(kind)
            got_i, got_s = np.zeros(0, np.int64), np.zeros(0, kind)
            step, done = 4 * k, 0
            while done < len(cand):
                if len(got_s) == k and upper[i, cand[done]] < got_s[-1]:
                    break                              # the k-th result is certain
                nxt = cand[done:done + step]
                done += len(nxt)
                step *= 2
                score = exact[nxt] @ qi if kind is np.float64 else (c[nxt] * q[at + i]).sum(axis=1).astype(kind)
                got_i = np.concatenate([got_i, cids[nxt]])
                got_s = np.concatenate([got_s, score])
                best = np.lexsort((got_i, -got_s))[:k]
                got_i, got_s = got_i[best], got_s[best]
            out.append((np.full(len(got_i), qids[at + i]), got_i, got_s.astype(np.int64)))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id",
                vec_col: str = "embedding") -> DataFrame:
    """Each query's k best rows by integer inner product: query_id, rank, vec_id, score.

    ``is_query`` is a condition on the column ``id``. Only vectors of the query's dimension are
    candidates, and none with the query's own id; fewer than k rows give fewer results. Repeated rows
    are candidates each; a repeated query id gives its list once. The job stops if the largest
    components of a block pair allow a score beyond a long; no wrong score is returned.
    """
    rows = valid_vectors(vectors, id_col, vec_col, scale)
    cand = written(pack(rows, BLOCK), "va-candidates")
    ask = written(pack(rows.where(is_query).dropDuplicates(["id"]), QUERY_BLOCK), "va-queries")
    cand = cand.withColumn("cb", F.monotonically_increasing_id())
    cand = cand.withColumn("salt", F.floor(F.pmod(F.xxhash64("cb"), F.lit(1 << 30)) * _groups(cand) / (1 << 30)))
    salts = _groups(cand)
    # candidates go to every query block (blocks are the unit, not rows), queries to every salt
    ask = ask.select("dim", F.monotonically_increasing_id().alias("qb"), F.col("ids").alias("qids"),
                     F.col("data").alias("qdata"))
    names = ask.groupBy("dim").agg(F.collect_list("qb").alias("qbs"))
    left = cand.join(names, "dim").select("dim", "salt", "ids", "data", F.explode("qbs").alias("qb"))
    right = ask.select("qb", "qids", "qdata", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    pairs = left.join(right, ["qb", "salt"]).select("dim", "ids", "data", "qids", "qdata")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                dim, ids, data, qids, qdata = (b.column(j)[i].as_py() for j in range(5))
                a, v, s = search(np.frombuffer(qids, np.int64), np.frombuffer(qdata, np.int64).reshape(-1, dim),
                                 np.frombuffer(ids, np.int64), np.frombuffer(data, np.int64).reshape(-1, dim), k)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(v), pa.array(s)],
                                                 names=["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _groups(cand: DataFrame) -> int:
    return max(1, -(-cand.count() // GROUP))
