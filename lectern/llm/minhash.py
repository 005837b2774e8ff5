"""Operator 7: near-duplicate detection by MinHash with tensored banding.

Two collections A and B of SIDE sub-hashes each (two minhashes a sub-hash) are
computed per distinct shingle set; table (i, j) is keyed by the pair (A_i, B_j).
So SIDE**2 tables cost 4 * SIDE minhashes. A pair at similarity 0.8 misses all
tables with probability 2 * (1 - 0.64)**10, about 7e-5.

Candidates are confirmed on full shingle sets. Equal sets are one node from the
start. In each bucket nodes are first compared with one pivot (linear work) and
merged. For buckets that still hold several components, each node's shingles that
occur in any other open component are counted: they bound every intersection across
components, which settles most nodes exactly without a comparison. The rest meet the
pivot with the best bound, and only the pairs then left between different
components are compared one by one. No partner is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import words
from lectern.llm.common import discard, iter_bytes, written
from lectern.llm.components import connected_components

SIDE = 10                 # sub-hashes a collection; SIDE**2 tables
HASHES = 4 * SIDE         # minhashes a set
AGREE = 21                # of HASHES; a pair at 0.8 agrees in fewer with probability 2.2e-5
PIVOTS = 4                # pivots a node meets in each later round
BOUND_ROUNDS = 2          # such rounds
_rng = np.random.Generator(np.random.PCG64(977))
_XOR = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KEY = _rng.integers(0, 1 << 63, 2 * SIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SIGNATURE = "n bigint, digest binary, a array<bigint>, b array<bigint>, sig array<bigint>"


def minhashes(s: np.ndarray) -> np.ndarray:
    """HASHES minima of a non-empty set of 64-bit hashes."""
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        part = s[at:at + 4096]
        np.minimum(out, ((part[None, :] ^ _XOR[:, None]) * _ODD[:, None]).min(axis=1), out=out)
    return out


def sub_hashes(m: np.ndarray) -> np.ndarray:
    """2 * SIDE sub-hashes (collection A, then B), each from two minhashes and its own index."""
    return words.mix(m[0::2] * _KEY + words.mix(m[1::2] + np.arange(2 * SIDE, dtype=np.uint64)))


def lanes(m: np.ndarray) -> np.ndarray:
    """One byte of each minhash, four to a number, for the agreement count in SQL."""
    low = (m >> np.uint64(40)) & np.uint64(0xFF)
    low = low.reshape(-1, 4)
    return low[:, 0] | low[:, 1] << np.uint64(8) | low[:, 2] << np.uint64(16) | low[:, 3] << np.uint64(24)


def signatures(text: Column, n_words: int) -> Column:
    """Struct of the shingle-set size, a 128-bit digest of the set and its sub-hashes (null for no words)."""

    @F.arrow_udf(f"struct<{SIGNATURE.replace(' ', ':').replace(',:', ',')}>")
    def run(col: pa.Array) -> pa.Array:
        rows = []
        for raw in iter_bytes(col):
            s = words.shingles(np.frombuffer(raw, np.uint8), n_words) if raw else ()
            if not len(s):
                rows.append((0, None, None, None, None))
                continue
            m = minhashes(s)
            k = sub_hashes(m).view(np.int64)
            rows.append((len(s), _digest(s.tobytes()),
                         k[:SIDE], k[SIDE:], lanes(m).view(np.int64)))
        cols = list(zip(*rows)) or [()] * 5
        kinds = [pa.int64(), pa.binary()] + [pa.list_(pa.int64())] * 3
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                          names=["n", "digest", "a", "b", "sig"])

    return run.asNondeterministic()(text)


def own_set(text: Column, digest: Column, n_words: int) -> Column:
    """The sorted distinct 64-bit shingle hashes of a text, as bytes; null if the set has another digest (an id may
    stand on several texts)."""

    @F.arrow_udf("binary")
    def run(col: pa.Array, digests: pa.Array) -> pa.Array:
        out = []
        for raw, want in zip(iter_bytes(col), iter_bytes(digests)):
            s = words.shingles(np.frombuffer(raw, np.uint8), n_words).tobytes() if raw else b""
            out.append(s if _digest(s) == bytes(want) else None)
        return pa.array(out, pa.binary())

    return run.asNondeterministic()(text, digest)


def _digest(shingle_set: bytes) -> bytes:
    return hashlib.blake2b(shingle_set, digest_size=16).digest()


def similar(x: Column, y: Column, percent: int) -> Column:
    """100 * |intersection| >= percent * |union| of two shingle sets."""

    @F.arrow_udf("boolean")
    def run(xs: pa.Array, ys: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(iter_bytes(xs), iter_bytes(ys)):
            u, v = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            both = np.sort(np.concatenate([u, v]), kind="stable")
            same = int(np.count_nonzero(both[1:] == both[:-1]))
            out.append(100 * same >= percent * (len(u) + len(v) - same))
        return pa.array(out, pa.bool_())

    return run.asNondeterministic()(x, y)


def may_link(n1: str, s1: str, n2: str, s2: str, percent: int) -> Column:
    """Necessary size ratio, and at least AGREE equal signature bytes (zero bytes of the XOR)."""
    size = F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent
    differ = F.lit(0)
    for i in range(HASHES // 4):
        x = F.col(s1)[i].bitwiseXOR(F.col(s2)[i])
        hit = (x.bitwiseAND(F.lit(0x7F7F7F7F)) + F.lit(0x7F7F7F7F)).bitwiseOR(x).bitwiseAND(F.lit(0x80808080))
        differ = differ + F.bit_count(hit)
    return size & (differ <= HASHES - AGREE)


def _buckets(nodes: DataFrame) -> DataFrame:
    """(x, y, node) of the tensored tables that hold at least two nodes, keyed by the pair (x, y) of sub-hashes.
    Sub-hashes that only one node has are dropped before pairs are formed: a table key is shared only if
    both of its halves are."""
    subs = nodes.select("node", F.explode(F.concat(
        F.transform("a", lambda x: F.struct(F.lit(0).alias("side"), x.alias("h"))),
        F.transform("b", lambda x: F.struct(F.lit(1).alias("side"), x.alias("h"))))).alias("s")).select("node", "s.*")
    shared = subs.groupBy("side", "h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("side", "h")
    halves = (subs.join(shared, ["side", "h"]).groupBy("node")
              .agg(F.collect_set(F.when(F.col("side") == 0, F.col("h"))).alias("a"),
                   F.collect_set(F.when(F.col("side") == 1, F.col("h"))).alias("b")))
    keys = written(halves.select("node", F.explode("a").alias("x"), "b")
                   .select("node", "x", F.explode("b").alias("y")), "keys")
    many = keys.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("x", "y")
    out = written(keys.join(many, ["x", "y"], "left_semi"), "buckets")
    discard(keys)
    return out


def near_duplicates(docs: DataFrame, n_words: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    Two texts are linked when 100 * |intersection| >= percent * |union| of their word-shingle sets; a
    component is closed under links and its id is its smallest doc_id (null ids count last). Null, empty
    and blank texts have size 0, no links and themselves as component. Equal texts, repeated rows and
    equal sets share a component. Other columns are not read; an empty table gives an empty result.
    """
    return _grouped(docs, n_words, percent, id_col, text_col).drop("th", "label")


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def keep_one(docs: DataFrame, n_words: int = 5, percent: int = 80, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """One row of ``docs`` of each near-duplicate group, with its own columns: that of the smallest id (null ids
    last), and of its texts (if the id repeats) the one with the smallest hash. Groups are told apart by their links,
    so unlinked texts under one id, or without an id, all stay. Rows without words have no links: each stays, rows
    equal in all columns once."""
    best = (_grouped(docs, n_words, percent, id_col, text_col).where("label IS NOT NULL")
            .groupBy("label").agg(F.min(_rank()).alias("k")).select(F.col("k.doc_id").alias("__i"), F.col("k.th").alias("__h")))
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.col(id_col).alias("__id"), text_hash(F.col(text_col)).alias("__th"), every.alias("__row"),
                       _wordless(F.col(text_col)).alias("__none"), F.to_json(every).alias("__all"))
    one = rows.where("NOT __none").drop("__all") \
              .join(best, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__th") == F.col("__h"))) \
              .dropDuplicates(["__id", "__th"])
    none = rows.where("__none").dropDuplicates(["__all"])
    return one.select("__row.*").union(none.select("__row.*"))


def _wordless(text: Column) -> Column:
    """Whether a text is null or has nothing but the blanks that separate words."""
    return ~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")


def _rank() -> Column:
    """Order of a group's rows: by id, null ids last, then by text hash."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")


def _grouped(docs: DataFrame, n_words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    t = written(docs.select("doc_id", text_hash(F.col("text")).alias("th"),
                            signatures(F.col("text"), n_words).alias("s")).select("doc_id", "th", "s.*"), "sigs", batch_rows=2000)
    nodes = written(t.where("n > 0").groupBy("digest")
                    .agg(F.min(_rank()).alias("k"), F.first("n").alias("n"), F.first("a").alias("a"),
                         F.first("b").alias("b"), F.first("sig").alias("sig"))
                    .select("digest", F.col("k.doc_id").alias("first"), F.col("k.th").alias("first_th"), "n", "a", "b", "sig"), "sets")
    nodes = nodes.withColumn("node", F.monotonically_increasing_id())
    nodes = written(nodes, "nodes")
    buckets = _buckets(nodes)
    links = _confirmed(docs, nodes, buckets, n_words, percent)
    if links is None:
        comp = nodes.select("digest", F.col("first").alias("component_id"), F.col("node").alias("label"))
    else:
        labels = connected_components(links)
        named = nodes.select("node", "digest", "first").join(labels, "node", "left") \
                     .select("digest", "first", F.coalesce("label", "node").alias("label"))
        low = named.groupBy("label").agg(F.min("first").alias("component_id"))
        comp = written(named.join(low, "label").select("digest", "component_id", "label"), "component")
    some = t.where("n > 0").select("doc_id", "th", "n", "digest").join(comp, "digest") \
            .select("doc_id", "th", F.col("n").alias("n_shingles"), "component_id", "label")
    none = t.where("n = 0").select("doc_id", "th", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"),
                                   F.lit(None).cast("long").alias("label"))
    return some.union(none).select("doc_id", "th", "n_shingles", "component_id", "label",
                                   F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _confirmed(docs, nodes, buckets, n_words, percent) -> DataFrame | None:
    """The confirmed links (a, b) that connect all components; None if no table holds two nodes."""
    if buckets.limit(1).count() == 0:
        return None
    # full sets of the nodes that share a bucket, from one text of each node
    busy = buckets.select("node").distinct().join(nodes.select("node", "first", "first_th", "digest"), "node")
    texts = docs.withColumn("th", text_hash(F.col("text"))) \
                .join(busy, F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("th") == F.col("first_th")))
    own = texts.select("node", own_set(F.col("text"), F.col("digest"), n_words).alias("set"))
    sets = written(own.where("set IS NOT NULL").dropDuplicates(["node"]), "shingle-sets", batch_rows=1000)
    info = nodes.select("node", "n", "sig", "a", "b")

    def verify(pairs: DataFrame) -> DataFrame:
        x = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
        y = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
        got = pairs.join(x, "a").join(y, "b").select("a", "b", similar(F.col("sa"), F.col("sb"), percent).alias("ok"))
        return written(got.where("ok").select("a", "b"), "confirmed", batch_rows=500)

    # 1: one pivot a bucket, the smallest node
    first = buckets.join(info.drop("a", "b"), "node").withColumn("comp", F.col("node"))
    links = verify(_with_pivots(first, F.col("node"), percent, 1))
    # 2: what buckets of several components can still link at all, with the pivots of the best bound
    live = buckets
    for _ in range(BOUND_ROUNDS):
        rows = _open(live, _component_of(nodes, links))
        bound = written(_cross_bound(rows, sets).join(info, "node")
                        .where(100 * F.col("c") >= percent * F.col("n")), "bounds", batch_rows=1000)
        rows = rows.join(bound, "node")
        links = written(links.union(verify(_with_pivots(rows, -F.col("c") / F.col("n"), percent, PIVOTS))), "links")
        live = written(live.join(bound.select("node"), "node", "left_semi"), "buckets")
    # 3: the pairs left between different components of a bucket, each in the first table they share; the members
    # of a bucket's main component meet its other members only
    # (after its members that are too large for every other member's size have left the bucket)
    labels = _component_of(nodes, links)
    rows = _open(live, labels).join(bound.select("node", "n", "c"), "node")
    least = rows.groupBy("x", "y").agg(F.min("n").alias("n0"))
    rows = rows.join(least, ["x", "y"]).where((100 + percent) * F.col("c") >= percent * (F.col("n") + F.col("n0")))
    rows = _open(rows.select("x", "y", "node"), labels)
    sizes = rows.groupBy("x", "y", "comp").agg(F.count(F.lit(1)).alias("m"))
    blocks = lambda n: F.ceil(n / BLOCK)
    main = sizes.groupBy("x", "y").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"),
                                       blocks(F.sum("m") - F.max("m")).alias("nl"), blocks(F.sum("m")).alias("nr"))
    left = rows.join(bound, "node").join(main, ["x", "y"])
    return links.union(_block_links(written(left, "left"), sets, percent))


BLOCK = 1024              # nodes of one side of a bucket compared in one group


def _block_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components of a bucket. ``rows`` has x, y, node, comp, main, n, c, sig, a, b
    and the numbers of blocks of a bucket's nodes outside its main component (nl) and of all its nodes (nr).

    A bucket's nodes outside its main component meet all its nodes, block by block; a pair counts in the
    first table it shares. A first pass finds the nodes that have a partner by size, bound and signature,
    so only their sets travel; a second pass compares these sets. Both return nodes or links, never pairs.
    """
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    chunk = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    cols = ["x", "y", "node", "comp", "main", "n", "c", "sig", "a", "b"]
    left = rows.where("comp <> main").select(*cols, F.lit(0).alias("side"), chunk("nl").alias("lc"), spread("nr").alias("rc"))
    right = rows.where("nl > 0").select(*cols, F.lit(1).alias("side"), spread("nl").alias("lc"), chunk("nr").alias("rc"))
    both = left.unionByName(right)
    key = ["x", "y", "lc", "rc"]
    kinds = ", ".join(f"{n} {t}" for n, t in both.dtypes)
    part = written(both.groupBy(*key).applyInArrow(lambda t: t.take(pa.array(_partners(t, percent)[2])), kinds), "partners")
    full = part.join(sets, "node")
    found = full.groupBy(*key).applyInArrow(lambda t: _links(t, percent), "a long, b long")
    return written(found.distinct(), "confirmed")


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    col = col.combine_chunks()
    return col.flatten().to_numpy().reshape(len(col), -1)


def _partners(t: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left row, right row) of the possible pairs of a block, and the rows that are in any."""
    c = {k: t.column(k).to_numpy() for k in ("side", "node", "comp", "main", "n", "c", "x", "y")}
    lo, hi = np.flatnonzero(c["side"] == 0), np.flatnonzero(c["side"] == 1)
    if not len(lo) or not len(hi):
        return lo[:0], lo[:0], lo[:0]
    sig = _matrix(t.column("sig")).astype(np.uint32).view(np.uint8).reshape(t.num_rows, -1)
    a, b = _matrix(t.column("a")), _matrix(t.column("b"))
    x, y = c["x"][0], c["y"][0]
    out = []
    for i in lo.tolist():
        fit = ((c["comp"][hi] != c["comp"][i]) & ((c["comp"][hi] == c["main"][i]) | (c["comp"][hi] > c["comp"][i]))
               & (100 * np.minimum(c["n"][hi], c["n"][i]) >= percent * np.maximum(c["n"][hi], c["n"][i]))
               & ((100 + percent) * np.minimum(c["c"][hi], c["c"][i]) >= percent * (c["n"][hi] + c["n"][i])))
        j = hi[fit]
        if not len(j):
            continue
        j = j[(sig[j] == sig[i]).sum(axis=1) >= AGREE]
        # the first shared sub-hash on either side is this table's
        j = j[(a[i][(a[j] == a[i]).argmax(axis=1)] == x) & (b[i][(b[j] == b[i]).argmax(axis=1)] == y)]
        out.append(np.stack([np.full(len(j), i), j]))
    if not out:
        return lo[:0], lo[:0], lo[:0]
    p = np.concatenate(out, axis=1)
    return p[0], p[1], np.unique(p)


def _links(t: pa.Table, percent: int) -> pa.Table:
    """The confirmed pairs of a block, on full sets."""
    first, second, _ = _partners(t, percent)
    node = t.column("node").to_numpy()
    sets = [np.frombuffer(raw, np.uint64) for raw in iter_bytes(t.column("set"))]
    links = []
    for i in np.unique(first).tolist():
        for j in second[first == i].tolist():
            same = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * same >= percent * (len(sets[i]) + len(sets[j]) - same):
                links.append((node[i], node[j]))
    p = np.array(links, np.int64).reshape(-1, 2)
    return pa.table({"a": p[:, 0], "b": p[:, 1]})


def _component_of(nodes: DataFrame, links: DataFrame) -> DataFrame:
    return connected_components(links).select("node", F.col("label").alias("comp"))


def _open(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(x, y, node, comp) of the buckets that hold several components."""
    at = written(buckets.join(labels, "node", "left").select("x", "y", "node", F.coalesce("comp", "node").alias("comp")), "at")
    several = at.groupBy("x", "y").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("x", "y")
    return written(at.join(several, ["x", "y"], "left_semi"), "open")


def _with_pivots(rows: DataFrame, order: Column, percent: int, each: int) -> DataFrame:
    """Pairs (a, b) of each node with suitable pivots of other components: the first row of a bucket in
    ``order`` is its pivot, and of a node's pivots (one a bucket at most) the first ``each`` count."""
    pivot = (rows.groupBy("x", "y").agg(F.min(F.struct(order.alias("o"), "node", "comp", "n", "sig")).alias("p"))
             .select("x", "y", "p.*").toDF("x", "y", "o", "node2", "comp2", "n2", "sig2"))
    pairs = rows.join(pivot, ["x", "y"]).where((F.col("comp") != F.col("comp2")) & may_link("n", "sig", "n2", "sig2", percent))
    near = pairs.groupBy(F.col("node").alias("a")).agg(F.sort_array(F.collect_set(F.struct("o", "node2"))).alias("m"))
    return near.select("a", F.explode(F.slice("m", 1, each)).alias("m")).select("a", F.col("m.node2").alias("b"))


def _cross_bound(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, c): how many of a node's shingles occur in another component among ``rows``. No intersection with
    a node of another component is larger."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, comps = b.column(1).to_numpy(), b.column(2).to_numpy()
            held, size = [], 0
            for i, raw in enumerate(iter_bytes(b.column(0))):
                held.append(np.frombuffer(raw, np.int64))
                size += len(held[-1])
                if size > 500_000 or i == b.num_rows - 1:
                    count = [len(h) for h in held]
                    at = slice(i + 1 - len(held), i + 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(held)), pa.array(np.repeat(nodes[at], count)),
                         pa.array(np.repeat(comps[at], count))], names=["token", "node", "comp"])
                    held, size = [], 0

    tokens = (rows.select("node", "comp").distinct().join(sets, "node").select("set", "node", "comp")
              .mapInArrow(spread, "token long, node long, comp long"))
    cross = tokens.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("token")
    return tokens.join(cross, "token").groupBy("node").agg(F.count(F.lit(1)).alias("c"))
