"""Exact k-nearest-neighbour join by cosine similarity.

Both sides are packed into blocks of vectors (a binary matrix and its ids) per filter key
and dimension, and written once to the shared checkpoint folder. A per-query metadata
filter (F1) is part of the key, so it is applied by the join before any product: a query
meets only blocks of its own semester and subject. The blocks of a (key, dimension) are dealt
over a grid: a task holds one part of the queries, one part of the corpus passes them block by
block, and at most k ids a query and part come out, however many blocks there were. A window
(``WindowGroupLimit``) merges them, and metadata and texts are joined back by id for the
final rows only. Nothing of either side passes through the driver or is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.params import DEFAULT, Params
from lectern.session import materialise

GROUP = 4                # corpus blocks that share one copy of a query block (salted)
ROWS, COLUMNS = 8, 6     # parts of a key's queries and corpus (grid), where bytes ask for no more
SMALL = 4                # queries of less than one part in so many of their corpus are cut into fewer rows
HELD = 16 << 20          # bytes of query vectors that a task holds
PASSING = 64 << 20       # and of corpus vectors that pass them
PIECE = 16 << 10         # most bytes of vectors in a written row: Spark reads 4096 rows of a table at once


def invalid_vectors(rows: DataFrame, vec: str = "embedding", dim: int | None = None) -> DataFrame:
    """Quarantine: the rows whose vector is null, empty, of zero length, or (given ``dim``) of another
    dimension. They take no part in a join; count or store them beside it."""
    v = F.col(vec)
    bad = v.isNull() | (F.size(v) <= 0) | ~F.exists(v, lambda x: x != 0)
    return rows.where(F.coalesce(bad | (F.size(v) != dim) if dim else bad, F.lit(True)))


def precision(rows: DataFrame, vec: str = "vec") -> type:
    """Numpy type of the vectors of a table."""
    return np.float32 if isinstance(rows.schema[vec].dataType.elementType, T.FloatType) else np.float64


def narrow(m: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest of the types a block is written in."""
    least, most = m.min(initial=0), m.max(initial=0)
    for kind in (np.int8, np.int16, np.float32):
        if m.dtype.itemsize > np.dtype(kind).itemsize and (kind is np.float32 or np.iinfo(kind).min <= least <= most <= np.iinfo(kind).max):
            with np.errstate(all="ignore"):
                x = m.astype(kind)
            if (x == m).all():
                return x
    return m


def _pack(rows: DataFrame, id_type: T.DataType, block_rows: int, block_bytes: int) -> DataFrame:
    """Blocks (key, dim, n, ids, data) of ``rows(key, id, vec)``, floats in single precision, other numbers in double,
    either in fewer bytes where that loses nothing (``narrow``: counts); null, empty and NaN vectors are left out. A
    block is a small piece; tasks put pieces together again (``_joined``)."""
    kind = precision(rows)
    width = np.dtype(kind).itemsize
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("dim", T.IntegerType()),
                           T.StructField("n", T.IntegerType()), T.StructField("ids", T.ArrayType(id_type)),
                           T.StructField("data", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        size = 0
        ready: list[tuple] = []

        def out(at: tuple) -> None:
            ids, parts, n = held.pop(at)
            ready.append((*at, n, pa.concat_arrays(ids), narrow(np.concatenate(parts)).tobytes()))

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            if len(ready) >= least:
                key, dims, n, ids, data = zip(*ready)
                ready.clear()
                ends = pa.array(np.cumsum([0, *n]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.string()), pa.array(dims, pa.int32()), pa.array(n, pa.int32()),
                     pa.ListArray.from_arrays(ends, pa.concat_arrays(ids)), pa.array(data, pa.binary())], names=schema.names)

        for b in batches:
            vec = b.column("vec")
            flat = vec.values.to_numpy(zero_copy_only=False).astype(kind)
            offs = vec.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
            length = np.where(vec.is_valid().to_numpy(zero_copy_only=False), np.diff(offs), 0)
            keys = np.array(b.column("key").to_pylist(), dtype=object)
            for dim in np.unique(length[length > 0]).tolist():
                at = np.flatnonzero(length == dim)
                m = flat[offs[at][:, None] + np.arange(dim)]
                fine = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
                at, m = at[fine], m[fine]
                limit = max(1, min(block_rows, min(block_bytes, PIECE) // (width * dim)))
                for key in dict.fromkeys(keys[at].tolist()):
                    mine = np.flatnonzero(keys[at] == key)
                    while len(mine):
                        h = held.setdefault((key, dim), [[], [], 0])
                        take, mine = mine[:limit - h[2]], mine[limit - h[2]:]
                        h[0].append(b.column("id").take(pa.array(at[take])))
                        h[1].append(m[take])
                        h[2] += len(take)
                        size += width * dim * len(take)
                        if h[2] >= limit:
                            size -= width * dim * h[2]
                            out((key, dim))
                            yield from flush(64)
            if size > 4 * block_bytes:                 # many keys: let all small blocks go
                for at in list(held):
                    out(at)
                    yield from flush(64)
                size = 0
        for at in list(held):
            out(at)
            yield from flush(64)
        yield from flush(1)

    return rows.mapInArrow(run, schema)


def _best(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest entries of each row, NaN excluded; ties to the smaller id."""
    s = np.where(np.isnan(sims), -np.inf, sims)
    if s.shape[1] > k:
        floor = -np.partition(-s, k - 1, axis=1)[:, k - 1:k]
        qi, cj = np.nonzero((s >= floor) & (s > -np.inf))
    else:
        qi, cj = np.nonzero(s > -np.inf)
    order = np.lexsort((ids[cj], -s[qi, cj], qi))
    qi, cj = qi[order], cj[order]
    first = np.searchsorted(qi, qi, side="left")
    keep = np.arange(len(qi)) - first < k
    return qi[keep], cj[keep]


def vectors_of(data: pa.Scalar, dim: int, n: int) -> np.ndarray:
    """The ``n`` vectors of a block, in the type that it was written in."""
    buf = data.as_buffer()
    return np.frombuffer(buf, {1: np.int8, 2: np.int16, 4: np.float32, 8: np.float64}[buf.size // (dim * n)]).reshape(n, dim)


def _tie_order(ids: pa.Array) -> np.ndarray:
    """Values in the order of the ids, null first, to compare them by."""
    if pa.types.is_integer(ids.type):
        return ids.fill_null(np.iinfo(ids.type.to_pandas_dtype()).min).to_numpy(zero_copy_only=False)
    return np.asarray(["" if x is None else x for x in ids.to_pylist()] if pa.types.is_string(ids.type) else ids.to_pylist())


class Nearest:
    """The best k of a held set of queries among the corpus vectors that pass (:meth:`offer`).

    A product in single precision finds the pairs that may be among the best; its rounding is covered by a margin.
    Their similarity is computed in double precision, a pair at a time, so equal vectors get equal ones. ``floor`` is
    a similarity below which a query (array) or no query (number) needs a row; it rises to the k-th best found.
    """

    def __init__(self, q: np.ndarray, ids: pa.Array, k: int, floor, exclude_self: bool, after: bool) -> None:
        self.q, self.ids, self.k, self.exclude_self, self.after = q, ids, k, exclude_self, after
        self.norm, self.q32 = self._unit(q)
        self.margin = 2 * (q.shape[1] + 8) * 2.0 ** -23
        self.least = np.array(np.broadcast_to(np.asarray(floor, np.float64), len(q)))
        self.floor, self.short = self.least.copy(), np.ones(len(q), bool)
        self.order = _tie_order(ids) if exclude_self else None
        self.seen, self.seen_order, self.n_seen = [], [], 0
        self.best = [np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)]      # query, similarity, place among the seen
        self.new: list[list[np.ndarray]] = [[], [], []]
        self.n_new = 0

    @staticmethod
    def _unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        norm, unit = np.empty(len(m)), np.empty(m.shape, np.float32)
        step = max(1, (1 << 20) // m.shape[1])
        with np.errstate(all="ignore"):
            for lo in range(0, len(m), step):
                x = m[lo:lo + step].astype(np.float64)
                norm[lo:lo + step] = np.sqrt(np.einsum("ij,ij->i", x, x))
                unit[lo:lo + step] = x / norm[lo:lo + step, None]
        unit[~np.isfinite(unit).all(axis=1)] = np.nan              # meets nothing
        return norm, unit

    def offer(self, c: np.ndarray, ids: pa.Array, rows: np.ndarray | None = None) -> None:
        """Corpus vectors and their ids, for all held queries or the given ones."""
        rows = np.arange(len(self.q)) if rows is None else rows
        order = _tie_order(ids)
        norm, c32 = self._unit(c)
        same = self._same(order) if self.exclude_self else None
        step = max(1, 1_000_000 // len(c))
        for lo in range(0, len(rows), step):
            at = rows[lo:lo + step]
            s = self.q32[at] @ c32.T
            if same is not None:
                self._mask(s, at, *same)
            floor = self.floor[at]
            hit = self._above(s, floor)
            short = np.flatnonzero(self.short[at])
            if len(c) > self.k and len(short) and len(hit) > 4 * self.k * len(at):
                part = np.nan_to_num(s[short], nan=-np.inf, neginf=-np.inf)
                floor[short] = np.maximum(floor[short], np.partition(part, len(c) - self.k, axis=1)[:, len(c) - self.k])
                hit = self._above(s, floor)
            del s
            for i in range(0, len(hit), 1 << 17):
                r, j = np.divmod(hit[i:i + (1 << 17)], len(c))
                self._add(at[r], j, c, norm)
            if self.n_new > 4_000_000:
                self._prune(order)
        self.seen.append(ids)
        self.seen_order.append(order)
        self.n_seen += len(c)
        if self.n_new >= max(10_000, len(self.q) * self.k // 2):
            self._prune()

    def _above(self, s: np.ndarray, floor: np.ndarray) -> np.ndarray:
        limit = np.maximum(floor - self.margin, -3.0).astype(np.float32)
        return np.flatnonzero((s >= limit[:, None]).ravel())

    def _same(self, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        if order.dtype.kind != self.order.dtype.kind:
            return None
        by = np.argsort(order, kind="stable")
        return by, np.searchsorted(order, self.order, "left", sorter=by), np.searchsorted(order, self.order, "right", sorter=by)

    @staticmethod
    def _mask(s: np.ndarray, at: np.ndarray, by: np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
        n = (stop - start)[at]
        r = np.repeat(np.arange(len(at)), n)
        s[r, by[np.repeat(start[at] - np.cumsum(n) + n, n) + np.arange(len(r))]] = -np.inf

    def _add(self, r: np.ndarray, j: np.ndarray, c: np.ndarray, norm: np.ndarray) -> None:
        sims = np.empty(len(r))
        step = max(1, (1 << 20) // c.shape[1])
        with np.errstate(all="ignore"):
            for lo in range(0, len(r), step):
                a, b = r[lo:lo + step], j[lo:lo + step]
                x, y = self.q[a].astype(np.float64), c[b].astype(np.float64)
                if not self.after:
                    x, y = x / self.norm[a, None], y / norm[b, None]
                sims[lo:lo + step] = np.einsum("ij,ij->i", x, y)
                if self.after:
                    sims[lo:lo + step] /= self.norm[a] * norm[b]
        keep = sims >= self.least[r]
        for held, x in zip(self.new, (r[keep], sims[keep], self.n_seen + j[keep])):
            held.append(x)
        self.n_new += int(keep.sum())

    def _prune(self, last: np.ndarray | None = None) -> None:
        """Only the best k of each query stay; ``last``: the order of a block not yet among the seen."""
        q, s, at = (np.concatenate([x, *y]) for x, y in zip(self.best, self.new))
        self.seen_order = [np.concatenate(self.seen_order)] if self.seen_order else []
        ids = np.concatenate([*self.seen_order, *([] if last is None else [last])])
        by = np.lexsort((ids[at], -s, q))
        q, s, at = q[by], s[by], at[by]
        keep = np.arange(len(q)) - np.searchsorted(q, q, side="left") < self.k
        self.best, self.new, self.n_new = [q[keep], s[keep], at[keep]], [[], [], []], 0
        n = np.bincount(self.best[0], minlength=len(self.q))
        full = np.flatnonzero(n >= self.k)
        self.floor[full] = np.maximum(self.floor[full], self.best[1][np.cumsum(n)[full] - 1])
        self.short[full] = False

    def found(self) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
        """(query ids, corpus ids, similarities) of the best k."""
        if self.n_new:
            self._prune()
        if not len(self.best[0]):
            return
        seen = pa.concat_arrays(self.seen)
        for lo in range(0, len(self.best[0]), 100_000):
            q, s, at = (x[lo:lo + 100_000] for x in self.best)
            yield self.ids.take(pa.array(q)), seen.take(pa.array(at)), pa.array(s)


def _joined(pieces: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
    """The ids and vectors of some pieces, copied: a slice would keep the whole batch that it came in."""
    ids = pa.concat_arrays([x for x, _ in pieces])
    return ids.take(pa.array(np.arange(len(ids)))), np.concatenate([m for _, m in pieces])


def _scorer(k: int, min_score: float | None, exclude_self: bool, after: bool, names: list[str], rows: int, size: int):
    """mapInArrow over the cells of a grid, each its query blocks first: the best k of each cell's queries. Corpus
    blocks are offered together, up to ``rows`` vectors or ``size`` bytes of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, near = None, [], None
        passing, n = [], 0

        def offer() -> None:
            nonlocal n
            if passing:
                ids, m = _joined(passing)
                near.offer(m, ids)
                passing.clear()
                n = 0

        def finish() -> Iterator[pa.RecordBatch]:
            if near is not None:
                offer()
            for cols in near.found() if near is not None else ():
                yield pa.RecordBatch.from_arrays(list(cols), names=names)

        for b in batches:
            places = list(zip(*(b.column(c).to_pylist() for c in ("key", "dim", "_row", "_col"))))
            for i, at in enumerate(places):
                if at != now:
                    yield from finish()
                    now, held, near = at, [], None
                asks = b.column("qids")[i].is_valid
                ids = b.column("qids" if asks else "ids")[i].values
                m = vectors_of(b.column("data")[i], at[1], len(ids))
                if asks:
                    held.append((ids, m))
                    continue
                if near is None and held:
                    qids, q = _joined(held)
                    near = Nearest(q, qids, k, -np.inf if min_score is None else min_score, exclude_self, after)
                    held = []
                if near is not None:
                    passing.append((ids, m))
                    n += len(m)
                    if n >= rows or n * m[0].nbytes >= size:
                        offer()
            offer()                                    # nothing of a batch is kept when the next one comes
            held = [_joined(held)] if held else []
        yield from finish()

    return run


def grid(asked: DataFrame, stored: DataFrame, keys: list[str], widths: tuple[int, int] = (8, 8)) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt over the cells (``_row``, ``_col``) of a grid for each of the ``keys`` that both have: a query
    block is in one row and copied to its columns, a corpus block in one column and copied to the rows.
    A cell's vectors are bounded, and each block is copied about as often as the square root of the cells; a corpus
    much larger than its queries is copied less, to as many rows as the queries' bytes need.
    ``widths``: bytes of a number on both sides; the vectors themselves are not read to find the sizes."""
    def sizes(blocks: DataFrame, side: str, width: int) -> DataFrame:
        held = F.size("qids" if "qids" in blocks.columns else "ids") * F.col("dim") * F.lit(width)
        return blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{side}_n"), F.sum(held.cast("long")).alias(f"{side}_size"))

    few = F.ceil(F.col("q_size") * (SMALL * ROWS) / F.col("c_size"))       # a row more is a copy more of the whole corpus
    cells = materialise(sizes(asked, "q", widths[0]).join(sizes(stored, "c", widths[1]), keys).select(
        *keys, F.greatest(F.least("q_n", F.lit(ROWS), few), F.ceil(F.col("q_size") / HELD)).cast("int").alias("_rows"),
        F.greatest(F.least("c_n", F.lit(COLUMNS)), F.ceil(F.col("c_size") / PASSING)).cast("int").alias("_cols")), "knn-cells")
    mine = lambda n: F.pmod(F.monotonically_increasing_id(), F.col(n)).cast("int")
    copy = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    return (asked.join(cells, keys).withColumn("_row", mine("_rows")).withColumn("_col", copy("_cols")).drop("_rows", "_cols"),
            stored.join(cells, keys).withColumn("_col", mine("_cols")).withColumn("_row", copy("_rows")).drop("_rows", "_cols"))


def salted(stored: DataFrame, asked: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with a salt: the stored blocks of equal ``keys`` are dealt over one salt per GROUP of them, and
    asked blocks are copied to the salts of their own keys only. Keys whose blocks fit one group are not salted."""
    sizes = stored.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("_salts"))
    crowded = materialise(sizes.where("_salts > 1"), "knn-sizes")       # written: Spark knows its size and picks the join

    def salts(blocks: DataFrame) -> DataFrame:
        return blocks.join(crowded, keys, "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))

    return (salts(stored).withColumn("salt", F.pmod(F.xxhash64(*keys, F.monotonically_increasing_id()), F.col("_salts")).cast("int")).drop("_salts"),
            salts(asked).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts"))


def query_keys(semester: Column | None, subject: Column | None) -> Column:
    """The filter key of a query (F1): which filters it has, and their values."""
    sem = F.coalesce(semester.cast("long"), F.lit(0)) if semester is not None else F.lit(0)
    subj = F.coalesce(subject, F.lit("")) if subject is not None else F.lit("")
    has_sem, has_subj = sem > 0, F.trim(subj) != ""
    return F.concat_ws("\x1f", F.concat(F.when(has_sem, "m").otherwise(""), F.when(has_subj, "s").otherwise("")),
                       F.when(has_sem, sem.cast("string")), F.when(has_subj, subj))


def corpus_keys(semester: Column, subject: Column, kinds: Iterable[str] = ("", "m", "s", "ms")) -> Column:
    """The filter keys a corpus row answers to, of the given kinds."""
    sem = semester.cast("string")
    forms = {"": F.lit(""), "m": F.concat_ws("\x1f", F.lit("m"), sem), "s": F.concat_ws("\x1f", F.lit("s"), subject),
             "ms": F.concat_ws("\x1f", F.lit("ms"), sem, subject)}
    return F.array(*[forms[x] for x in sorted(kinds)])


def knn_join(queries: DataFrame, corpus: DataFrame, k: int, params: Params = DEFAULT, *,
             query_id: str = "query_id", query_vec: str = "embedding",
             corpus_id: str = "chunk_id", corpus_vec: str = "embedding",
             query_semester: str | None = None, query_subject: str | None = None,
             corpus_semester: str = "semester", corpus_subject: str = "subject",
             min_score: float | None = None, exclude_self: bool = False,
             carry: list[str] | None = None, normalize: str = "rows") -> DataFrame:
    """Top-k corpus rows per query by cosine similarity (exact).

    ``query_semester``/``query_subject`` name optional per-query filter columns
    (F1: semester applies when > 0, subject when non-blank, exact match),
    applied before the top-k. ``min_score`` drops rows below the floor; since
    the top-k of the rows above a floor equals the floor applied to the top-k,
    this is the same as thresholding afterwards (F2), only cheaper.
    ``normalize="rows"`` scales vectors to unit length before the product;
    ``"after"`` divides the raw dot product by both norms (bit-exact for
    integer count vectors, whose dot products are exact in float64).
    A query meets the vectors of its own dimension; null, empty, zero and non-finite
    vectors meet none (see ``invalid_vectors``). ``corpus`` is read again for ``carry``.
    Output: ``query_id, <corpus_id>, similarity (raw double), rank, *carry``.
    """
    carry = [c for c in (carry or []) if c != corpus_id]
    qtype, ctype = queries.schema[query_id].dataType, corpus.schema[corpus_id].dataType

    key = query_keys(F.col(query_semester) if query_semester else None, F.col(query_subject) if query_subject else None)
    limits = (params.knn_query_block, params.knn_max_block_bytes)
    asked = materialise(_pack(queries.select(key.alias("key"), F.col(query_id).alias("id"), F.col(query_vec).alias("vec")),
                              qtype, *limits), "knn-queries")
    kinds = {r.k for r in asked.select(F.substring_index("key", "\x1f", 1).alias("k")).distinct().collect()}  # 4 at most

    keys = corpus_keys(F.col(corpus_semester), F.col(corpus_subject), kinds) if kinds - {""} else F.array(F.lit(""))
    stored = materialise(_pack(corpus.select(F.explode(keys).alias("key"), F.col(corpus_id).alias("id"),
                                             F.col(corpus_vec).alias("vec")), ctype, *limits), "knn-corpus")
    q, c = grid(asked.select("key", "dim", F.col("ids").alias("qids"), "data"), stored.drop("n"), ["key", "dim"],
                widths=(np.dtype(precision(queries, query_vec)).itemsize, np.dtype(precision(corpus, corpus_vec)).itemsize))
    cell = ["key", "dim", "_row", "_col"]
    met = (q.unionByName(c, allowMissingColumns=True).repartition(*cell)
           .sortWithinPartitions(*cell, F.col("qids").isNull()))              # a cell's queries first
    schema = T.StructType([T.StructField("query_id", qtype), T.StructField(corpus_id, ctype),
                           T.StructField("similarity", T.DoubleType())])
    found = met.mapInArrow(_scorer(k, min_score, exclude_self, normalize == "after", schema.names, *limits), schema)
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col(corpus_id).asc())
    top = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if carry:
        top = top.join(corpus.select(corpus_id, *carry), corpus_id)
    return top.select("query_id", corpus_id, "similarity", "rank", *carry)
