"""Operator 11: vector code compression by product codes learned with ball k-means.

Vectors of integers are cut into equal consecutive parts; each part position has its own
codebook. In every round after the first, a part position's clusters are balls: an entry
and the largest distance of its parts. Two entries are neighbours if half their distance
is within the radius; a part nearer to its entry than half the way to the closest neighbour
lies in the stable core and is left alone, and one in the m-th annular ring is compared with
the m closest neighbours only. Distances are integers, so the tests are exact, ties included.

Balls are formed per Arrow batch (a batch's own radius is never wider than the whole
ball's). Every round is one narrow pass that writes the vectors with their new codes and, a
row a task, the sums of its parts by entry; only these sums are shuffled. Codebooks
(``entries`` vectors of each dimension) are all that the driver holds.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import discard, join_counted, load, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
PAIRS = 1 << 18           # (part, entry) distances computed at a time


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows; float64 products where they hold every value."""
    big = 4 * x.shape[1] * max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)), 1) ** 2
    kind = np.float64 if big < 1 << 52 else np.int64
    a, b = x.astype(kind), c.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)


def full_assign(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, squared distance) of each row, ties to the lower entry."""
    best = (_squares(x, c) * len(c) + np.arange(len(c))).min(axis=1)
    return best % len(c), best // len(c)


def ball_assign(x: np.ndarray, prev: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The same as :func:`full_assign`, from an earlier assignment ``prev``; also the number of distances
    to other entries that were computed."""
    k = len(c)
    gap = _squares(c, c)
    np.fill_diagonal(gap, np.iinfo(np.int64).max)
    near = np.argsort(gap, axis=1, kind="stable")[:, :k - 1]
    ring = np.take_along_axis(gap, near, axis=1)
    own = ((x - c[prev]) ** 2).sum(axis=1)
    by = np.argsort(prev, kind="stable")
    edge = np.searchsorted(prev[by], np.arange(k + 1))
    rings = np.zeros(len(x), np.int64)
    for i in range(k):
        ball = by[edge[i]:edge[i + 1]]
        if len(ball):
            neighbours = int(np.searchsorted(ring[i], 4 * own[ball].max(), side="right"))
            rings[ball] = np.searchsorted(ring[i, :neighbours], 4 * own[ball], side="right")   # 0: stable core
    best = own * k + prev
    moving = np.flatnonzero(rings)
    ends = np.cumsum(rings[moving])
    at = 0
    while at < len(moving):
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
        some, count = moving[at:to], rings[moving[at:to]]
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        row = np.repeat(some, count)
        entry = near[prev[row], np.arange(len(row)) - np.repeat(first, count)]
        key = ((x[row] - c[entry]) ** 2).sum(axis=1) * k + entry
        best[some] = np.minimum(best[some], np.minimum.reduceat(key, first))
        at = to
    return best % k, best // k, int(rings.sum())


def _binary(m: np.ndarray) -> pa.Array:
    """One binary value a row of a contiguous matrix."""
    m = np.ascontiguousarray(m)
    width = m.shape[1] * m.itemsize
    offsets = np.arange(len(m) + 1, dtype=np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), len(m), [None, pa.py_buffer(offsets), pa.py_buffer(m.tobytes())]).cast(pa.binary())


def _matrix(col: pa.Array, width: int, kind) -> np.ndarray:
    """The values of a binary column without nulls, each ``width`` numbers, as a matrix."""
    _, offsets, data = col.buffers()
    if not len(col) or data is None:
        return np.zeros((len(col), width), kind)
    at = np.frombuffer(offsets, np.int32)[col.offset:col.offset + len(col) + 1]
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]].view(kind).reshape(len(col), width)


def _by_dim(dims: np.ndarray):
    for dim in np.unique(dims).tolist():
        yield int(dim), np.flatnonzero(dims == dim)


def _integers(flat: np.ndarray, dim: int, parts: int, entries: int, scale: int) -> np.ndarray:
    """(n, parts * part length) floors; a dimension that ``parts`` does not divide is filled up with zeros."""
    length = -(-dim // parts)
    limit = min(1 << 30, math.isqrt((1 << 62) // (4 * max(length, 1) * entries)))
    v = np.floor(flat * float(scale))
    if v.size and not np.abs(v).max() < limit:
        raise ValueError(f"a component beyond {limit / scale:g}: squared distances would pass 64 bits")
    out = np.zeros((len(v), parts * length), np.int32)
    out[:, :dim] = v
    return out


def _pass(books: dict[int, np.ndarray], schema: T.StructType, parts: int, scale: int, first: bool):
    """mapInArrow function of a round: assign every part, add up the parts of each entry."""
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        kinds = None
        for b in batches:
            ids, labels = b.column("id"), b.column("label")
            kinds = ids.type, labels.type
            if first:
                vec = b.column("v")
                offs = vec.offsets.to_numpy().astype(np.int64)
                flat = vec.values.to_numpy(zero_copy_only=False)
                dims = np.diff(offs)
            else:
                dims = b.column("dim").to_numpy()
            for dim, at in _by_dim(dims):
                book = books[dim]
                _, k, length = book.shape
                if first:
                    v = _integers(flat[offs[at][:, None] + np.arange(dim)], dim, parts, k, scale)
                else:
                    v = _matrix(b.column("v").take(pa.array(at)), parts * length, np.int32)
                    prev = _matrix(b.column("code").take(pa.array(at)), parts, np.uint8)
                code, error = np.zeros((len(at), parts), np.uint8), np.zeros(len(at), np.int64)
                total = sums.setdefault(dim, np.zeros((parts, k, 1 + length), np.int64))
                for p in range(parts):
                    x = v[:, p * length:(p + 1) * length].astype(np.int64)
                    if first:
                        a, d = full_assign(x, book[p])
                    else:
                        a, d, _ = ball_assign(x, prev[:, p].astype(np.int64), book[p])
                    code[:, p] = a
                    error += d
                    total[p, :, 0] += np.bincount(a, minlength=k)
                    for j in range(length):
                        np.add.at(total[p, :, 1 + j], a, x[:, j])
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at)), labels.take(pa.array(at)), pa.array(np.full(n, dim, np.int32)), _binary(v),
                     _binary(code), pa.array(error), pa.nulls(n, pa.list_(pa.int64()))], names=names)
        for dim, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, kinds[0]), pa.nulls(1, kinds[1]), pa.array([dim], pa.int32()), pa.nulls(1, pa.binary()),
                 pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([total.ravel()], pa.list_(pa.int64()))], names=names)

    return run


def _renewed(books: dict[int, np.ndarray], stats: DataFrame) -> dict[int, np.ndarray]:
    """Entries moved to the floor of their parts' means; an entry without parts stays."""
    out = {}
    total: dict[int, np.ndarray] = {d: np.zeros(b.shape[0] * b.shape[1] * (1 + b.shape[2]), np.int64) for d, b in books.items()}
    rows = (stats.where("stat IS NOT NULL").select("dim", F.posexplode("stat").alias("pos", "s"))
            .groupBy("dim", "pos").agg(F.sum("s").alias("s")))
    for r in rows.toLocalIterator():       # entries x (1 + dimension) numbers a dimension
        total[r.dim][r.pos] = r.s
    for dim, book in books.items():
        t = total[dim].reshape(book.shape[0], book.shape[1], -1)
        n = t[:, :, :1]
        out[dim] = np.where(n > 0, t[:, :, 1:] // np.maximum(n, 1), book)
    return out


def _digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label", *,
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, dict]:
    """Codes of all vectors and the final codebooks.

    The table holds (``id_col``, label, dim, code binary, error): one byte a part and the squared distances
    summed over the parts. The codebooks are a dictionary from the dimension to an integer array (part, entry,
    position). A part position's codebook starts as that part of the ``entries`` vectors with the smallest ids
    (null ids last, equal ids in the order of their vectors), ``rounds`` rounds follow and a last assignment.

    Vectors that are null or hold a null, NaN or infinite component are left out. Vectors of each dimension have
    codebooks of their own; with fewer vectors than ``entries`` these are shorter. An empty vector has code zero
    and error 0; a dimension that ``parts`` does not divide is filled up with zero components. Repeated rows
    are rows each. A component too large for 64-bit distances stops the job. Empty tables give empty ones.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    label = F.col(label_col) if label_col else F.lit(None).cast("string")
    rows = vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).alias("id"), label.alias("label"), v.alias("v"))

    w = W.partitionBy("dim").orderBy(F.col("id").asc_nulls_last(), "v")
    start = (rows.select(F.size("v").alias("dim"), "id", "v").withColumn("r", F.row_number().over(w))
             .where(F.col("r") <= entries).select("dim", "r", "v"))
    seeds: dict[int, list] = {}
    for r in sorted(start.collect(), key=lambda r: (r.dim, r.r)):      # ``entries`` vectors a dimension
        seeds.setdefault(r.dim, []).append(r.v)
    books = {}
    for dim, vs in seeds.items():
        m = _integers(np.array(vs, np.float64).reshape(len(vs), dim), dim, parts, entries, scale).astype(np.int64)
        books[dim] = np.ascontiguousarray(m.reshape(len(vs), parts, -1).transpose(1, 0, 2)) if m.size else np.zeros((parts, len(vs), 0), np.int64)

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("label", rows.schema["label"].dataType),
                           T.StructField("dim", T.IntegerType()), T.StructField("v", T.BinaryType()),
                           T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType()),
                           T.StructField("stat", T.ArrayType(T.LongType()))])
    now = written(rows.mapInArrow(_pass(books, schema, parts, scale, True), schema), "codes")
    for _ in range(rounds):
        books = _renewed(books, now)
        before = now
        now = written(before.where("stat IS NULL").select("id", "label", "dim", "v", "code")
                      .mapInArrow(_pass(books, schema, parts, scale, False), schema), "codes")
        discard(before)
    return now.where("stat IS NULL").select(F.col("id").alias(id_col), "label", "dim", "code", "error"), books


def label_totals(codes: DataFrame) -> DataFrame:
    """``codes`` with label_error, the error summed over the rows of an equal label (nulls together)."""
    totals = written(codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "labels")
    return join_counted(codes, totals, ["label"], "n")


def op11(spark, sf_dir: str) -> DataFrame:
    """Codes of all ``embeddings``, their errors and a digest of the codebooks of their dimension."""
    codes, books = compress(load(spark, sf_dir, "embeddings"))
    digest = F.lit(None).cast("string")
    for dim, book in books.items():
        digest = F.when(F.col("dim") == dim, F.lit(_digest(book))).otherwise(digest)
    return label_totals(codes).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error",
                                      digest.alias("codebooks_sha256"))
