"""Token-bounded, overlapping chunks of ordered elements.

Semantics (per file, elements in order, ``n`` = tokens of the stripped element):

* ``n == 0``: skipped.
* ``n > max``: closes the open chunk; the element becomes its own chunk,
  emitted as windows of ``size`` tokens with stride ``size - overlap``.
* the open chunk takes the element while ``tokens + n <= size``; otherwise a
  new chunk starts, prefixed by the last ``overlap`` tokens of everything
  before it in the same segment (a segment = elements between forced splits).

Only chunk *numbers* need sequential state (four integers), so the fold runs on
integer columns alone and never ships text to Python. To keep any one task's
input bounded even when a single file holds a large share of all elements,
elements are cut into ``(file, block)`` groups of ``Params.chunk_block``
ordinals. Later blocks are summarised as a transition table over every
possible entry state (at most ``max(size, overlap + max) + 2`` states); tables
are composed per file in a JVM ``aggregate`` and each block is then replayed
from its resolved entry state. Texts are assembled with JVM grouping; the
overlap prefix is fetched by an equi-join on a dense element index (at most
``overlap`` predecessors, since each element has at least one token).
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import Tokenizer, detokenize, non_blank, strip, token_count, words
from lectern.params import DEFAULT, Params
from lectern.session import ensure_checkpoint_dir

CLOSED = -1


def _n_states(p: Params) -> int:
    return max(p.chunk_size, p.chunk_overlap + p.max_chunk_tokens) + 2  # CLOSED, 0..max


def _fold_scalar(ns, state, p: Params, seg_local: bool = True):
    """Fold one block from a known entry state.

    Returns per-element relative chunk and segment numbers, split flags, the
    overlap plan of each chunk start (``ov_n`` = how many preceding elements
    hold the last ``overlap`` tokens of the segment, ``ov_b`` = segment tokens
    before the chunk, -1 if not known inside this block), and the exit state.
    ``seg_local`` tells whether the open segment (if any) began in this block.
    """
    C, O, M = p.chunk_size, p.chunk_overlap, p.max_chunk_tokens
    m = len(ns)
    cs = np.empty(m, np.int64)
    segs = np.empty(m, np.int64)
    split = np.zeros(m, np.bool_)
    ov_n = np.zeros(m, np.int64)
    ov_b = np.zeros(m, np.int64)
    targets = [[] for _ in range(m)]   # later chunks (relative numbers) whose overlap uses element i
    bt, c, seg = state, 0, 0
    ends = []          # cumulative token ends of this block's part of the open segment
    first = 0          # block index of the first element in `ends`
    for i, n in enumerate(ns):
        if n > M:
            c += 1
            seg += 1
            bt = CLOSED
            split[i] = True
            ends = []
            first = i + 1
            seg_local = True
        elif bt >= 0 and bt + n <= C:
            bt += n
            ends.append((ends[-1] if ends else 0) + n)
        else:
            if bt >= 0:   # flush: the new chunk starts with the segment's last O tokens
                before = ends[-1] if ends else 0
                if seg_local or before > O:
                    ov_n[i] = len(ends) - bisect_right(ends, before - O)
                    ov_b[i] = before
                    for e in range(i - ov_n[i], i):
                        targets[e].append(c + 1)
                else:     # the segment began in an earlier block: fetch O+1, decide later
                    ov_n[i] = O + 1
                    ov_b[i] = -1
                bt = min(O, bt) + n
            else:
                bt = n
            c += 1
            ends.append((ends[-1] if ends else 0) + n)
        cs[i] = c
        segs[i] = seg
    return cs, segs, split, bt, c, seg, ov_n, ov_b, targets


def _fold_table(ns, p: Params):
    """Fold one block from every possible entry state at once (numpy over states)."""
    C, O, M = p.chunk_size, p.chunk_overlap, p.max_chunk_tokens
    st = np.arange(-1, _n_states(p) - 1, dtype=np.int64)
    cnt = np.zeros_like(st)
    for n in ns:
        if n > M:
            cnt += 1
            st[:] = CLOSED
            continue
        opened = st >= 0
        stay = opened & (st + n <= C)
        st = np.where(stay, st + n, np.where(opened, np.minimum(O, st), 0) + n)
        cnt += ~stay
    return st, cnt


def _summaries(p: Params):
    def run(batches):
        carry = None  # (file, blk, [n arrays]) spanning Arrow batches

        def emit(file, blk, ns):
            nsl = len(ns)
            if blk == 0:
                _, _, split, bt, c, _, _, _, _ = _fold_scalar(ns, CLOSED, p)
                end, cnt = [int(bt)], [int(c)]
                nseg = int(split.sum())
            else:
                e, c = _fold_table(ns, p)
                end, cnt = e.tolist(), c.tolist()
                nseg = int(sum(1 for n in ns if n > p.max_chunk_tokens))
            return (file, blk, end, cnt, nseg, nsl)

        rows = []
        for rb in batches:
            t = rb.to_pydict()
            for f, b, n in zip(t["file"], t["blk"], t["n"]):
                if carry is not None and (carry[0] != f or carry[1] != b):
                    rows.append(emit(carry[0], carry[1], carry[2]))
                    carry = None
                if carry is None:
                    carry = (f, b, [])
                carry[2].append(n)
            if len(rows) >= 1024:
                yield _rows_to_batch(rows)
                rows = []
        if carry is not None:
            rows.append(emit(carry[0], carry[1], carry[2]))
        if rows:
            yield _rows_to_batch(rows)
    return run


_SUMMARY_SCHEMA = "file string, blk long, end_state array<long>, n_chunks array<long>, n_segs long, n_elems long"


def _rows_to_batch(rows):
    f, b, e, c, s, n = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(f, pa.string()), pa.array(b, pa.int64()), pa.array(e, pa.list_(pa.int64())),
         pa.array(c, pa.list_(pa.int64())), pa.array(s, pa.int64()), pa.array(n, pa.int64())],
        names=["file", "blk", "end_state", "n_chunks", "n_segs", "n_elems"])


def _replay(p: Params):
    """Per-element fold of each (file, block) group from its resolved entry state.
    A group may span Arrow batches; it is buffered (at most ``chunk_block``
    elements) and folded once complete."""
    names = ["file", "ord", "chunk_no", "seg", "k", "is_split", "ov_n", "ov_b", "ov_targets"]

    def fold_group(g):
        file, blk, ords, ns, (st0, c0, g0, k0) = g
        st = CLOSED if st0 is None else st0
        local = blk == 0 or st == CLOSED
        cs, segs, split, _, _, _, on, ob, tg = _fold_scalar(ns, st, p, local)
        m = len(ns)
        off = c0 or 0
        return [pa.array([file] * m, pa.string()), pa.array(ords, pa.int64()), pa.array(cs + off),
                pa.array(segs + (g0 or 0)), pa.array(np.arange(1, m + 1) + (k0 or 0)), pa.array(split),
                pa.array(on), pa.array(ob), pa.array([[x + off for x in t] for t in tg], pa.list_(pa.int64()))]

    def run(batches):
        cur = None
        for rb in batches:
            t = rb.to_pydict()
            out = []
            for f, b, o, n, s0, c0, g0, k0 in zip(t["file"], t["blk"], t["ord"], t["n"], t["start_state"],
                                                  t["c_off"], t["seg_off"], t["k_off"]):
                if cur is not None and (cur[0] != f or cur[1] != b):
                    out.append(fold_group(cur))
                    cur = None
                if cur is None:
                    cur = (f, b, [], [], (s0, c0, g0, k0))
                cur[2].append(o)
                cur[3].append(n)
            for cols in out:
                yield pa.RecordBatch.from_arrays(cols, names=names)
        if cur is not None:
            yield pa.RecordBatch.from_arrays(fold_group(cur), names=names)
    return run


def assign_chunks(slides: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """W1 fold only: ``(file, ord, n)`` -> per-element chunk numbers (see ``_assign``)."""
    return _assign(slides, params)[0]


def _assign(slides: DataFrame, params: Params = DEFAULT) -> tuple[DataFrame, bool]:
    """W1 fold: ``(file, ord, n)`` with n >= 1 -> ``(file, ord, chunk_no, seg, k, is_split)``.

    ``chunk_no`` counts chunks per file from 1; ``seg`` numbers segments;
    ``k`` is the dense 1-based index of the element among non-blank elements;
    ``ov_n``/``ov_b`` give, on a chunk's first element, how many preceding
    elements its overlap needs and the segment tokens before it (-1: unknown);
    ``ov_targets`` lists the later chunks whose overlap uses this element (when
    known inside the block; chunks with ``ov_b = -1`` fetch theirs by join).
    Blocks are hash-partitioned by ``(file, blk)`` so a huge file spreads over tasks.
    """
    p = params
    spark = slides.sparkSession
    ensure_checkpoint_dir(spark)
    # The fold is CPU-bound Python per element: spread it over every core rather
    # than letting byte-based coalescing pack the small integer table into a few tasks.
    nparts = max(spark.sparkContext.defaultParallelism, 1)
    # The fold runs twice over (file, ord, n); materialise that small integer
    # table once in the shared checkpoint folder instead of re-reading text.
    ints = (slides.select(F.col("file").cast("string").alias("file"), F.col("ord").cast("long").alias("ord"),
                          F.col("n").cast("long").alias("n"))
            .withColumn("blk", F.floor((F.col("ord") - 1) / p.chunk_block).cast("long"))
            .checkpoint(eager=True))
    blk_max = ints.agg(F.max("blk")).first()[0] or 0
    if blk_max == 0:
        # every file fits in one block: all blocks start closed at offset 0
        with_starts = ints.select("*", *[F.lit(None).cast("long").alias(c)
                                         for c in ("start_state", "c_off", "seg_off", "k_off")])
    else:
        blocked = ints.repartition(nparts, "file", "blk").sortWithinPartitions("file", "blk", "ord")

        summ = blocked.select("file", "blk", "n").mapInArrow(_summaries(p), _SUMMARY_SCHEMA)
        # Two-level composition, JVM-side, every group bounded: (1) blocks are
        # composed into one table per super-block; (2) super-block tables are
        # folded per file from the closed state; (3) each super-block replays
        # its blocks from its entry state to give every block its start.
        G = max(p.chunk_superblock, 1)
        n_states = _n_states(p)
        summ = summ.withColumn("sblk", F.floor(F.col("blk") / G).cast("long"))
        start_t = "struct<blk:long,start_state:long,c_off:long,seg_off:long,k_off:long>"

        def idx(state, table):
            return F.when(F.size(table) == 1, F.lit(1)).otherwise(state + 2).cast("int")

        def fold_starts(blocks, acc0):
            def step(acc, b):
                i = idx(acc["state"], b["end_state"])
                here = F.struct(b["blk"].alias("blk"), acc["state"].alias("start_state"),
                                acc["c"].alias("c_off"), acc["seg"].alias("seg_off"), acc["k"].alias("k_off"))
                return F.struct(F.element_at(b["end_state"], i).alias("state"),
                                (acc["c"] + F.element_at(b["n_chunks"], i)).alias("c"),
                                (acc["seg"] + b["n_segs"]).alias("seg"),
                                (acc["k"] + b["n_elems"]).alias("k"),
                                F.concat(acc["starts"], F.array(here)).alias("starts"))
            return F.aggregate(blocks, acc0, step)["starts"]

        def acc_from(state, c, seg, k):
            return F.struct(state.cast("long").alias("state"), c.cast("long").alias("c"),
                            seg.cast("long").alias("seg"), k.cast("long").alias("k"),
                            F.array().cast(f"array<{start_t}>").alias("starts"))

        def table_of(blocks):
            # entry state s -> (exit state, chunks opened); scalar when the super-block holds block 0
            def run_from(s):
                def st(acc, b):
                    i = idx(acc["state"], b["end_state"])
                    return F.struct(F.element_at(b["end_state"], i).alias("state"),
                                    (acc["c"] + F.element_at(b["n_chunks"], i)).alias("c"))
                return F.aggregate(blocks, F.struct(s.cast("long").alias("state"), F.lit(0).cast("long").alias("c")), st)
            scalar = F.size(blocks[0]["end_state"]) == 1
            states = F.when(scalar, F.array(F.lit(CLOSED).cast("long"))).otherwise(
                F.sequence(F.lit(CLOSED).cast("long"), F.lit(n_states - 2).cast("long")))
            runs = F.transform(states, run_from)
            return (F.transform(runs, lambda r: r["state"]), F.transform(runs, lambda r: r["c"]))

        blocks = F.sort_array(F.collect_list(F.struct("blk", "end_state", "n_chunks", "n_segs", "n_elems")))
        sb = summ.groupBy("file", "sblk").agg(blocks.alias("blocks"),
                                               F.sum("n_segs").alias("n_segs"), F.sum("n_elems").alias("n_elems"))
        ends, counts = table_of(F.col("blocks"))
        sb = sb.select("file", "sblk", "blocks", "n_segs", "n_elems", ends.alias("end_state"),
                       counts.alias("n_chunks"))
        sb_starts = (sb.groupBy("file")
                     .agg(F.sort_array(F.collect_list(F.struct(F.col("sblk").alias("blk"), "end_state", "n_chunks",
                                                               "n_segs", "n_elems"))).alias("sbs"))
                     .select("file", F.inline(fold_starts(F.col("sbs"), acc_from(F.lit(CLOSED), F.lit(0), F.lit(0),
                                                                                  F.lit(0)))))
                     .withColumnRenamed("blk", "sblk"))
        starts = (sb.join(sb_starts, ["file", "sblk"])
                  .select("file", F.inline(fold_starts(F.col("blocks"), acc_from(
                      F.col("start_state"), F.col("c_off"), F.col("seg_off"), F.col("k_off")))))
                  .where(F.col("blk") > 0))

        with_starts = ints.join(starts, ["file", "blk"], "left")
    replay_in = (with_starts.repartition(nparts, "file", "blk").sortWithinPartitions("file", "blk", "ord")
                 .select("file", "blk", "ord", "n", "start_state", "c_off", "seg_off", "k_off"))
    out = replay_in.mapInArrow(
        _replay(p), "file string, ord long, chunk_no long, seg long, k long, is_split boolean, ov_n long, "
                    "ov_b long, ov_targets array<long>")
    return out, blk_max > 0


def chunk_elements(elements: DataFrame, meta_cols: list[str] | None = None, params: Params = DEFAULT,
                   tokenizer: Tokenizer = words, detokenizer: Tokenizer = detokenize) -> DataFrame:
    """W1+W2+W7+A7: elements ``(file, ord, text, *meta)`` -> chunks.

    Output: ``file, chunk_no, chunk_part, total_parts, content, n_tokens,
    slide_number, slides_covered, *meta`` (meta of the chunk's first element).

    After the integer fold, every element is routed to its own chunk and to
    the later chunks whose overlap it feeds, so own text, overlap text and
    forced windows come out of a single ``groupBy(file, chunk_no)`` (a chunk
    holds at most ``chunk_size`` own elements plus ``overlap`` predecessors).
    Token arrays are built only where text is cut.
    """
    p = params
    O = p.chunk_overlap
    meta_cols = list(meta_cols or [])
    el = (elements.where(non_blank(F.col("text")))  # F3
          .select(F.col("file").cast("string").alias("file"), F.col("ord").cast("long").alias("ord"),
                  strip(F.col("text")).alias("text"), *meta_cols)
          .withColumn("n", token_count(F.col("text"), tokenizer)))
    if tokenizer is not words:
        el = el.where("n > 0")     # another tokenizer may find no token in a text that is not blank
    fold, multi_block = _assign(el.select("file", "ord", "n"), p)
    tagged = el.join(fold, ["file", "ord"])

    # Route: role 0 = own element of `chunk_no`, role 1 = overlap element of a later chunk.
    routed = tagged.select(
        "file", "ord", "k", "n", "text", "is_split", "ov_n", "ov_b", *meta_cols,
        F.explode(F.concat(
            F.array(F.struct(F.col("chunk_no").alias("target"), F.lit(0).alias("role"))),
            F.transform(F.col("ov_targets"), lambda t: F.struct(t.alias("target"), F.lit(1).alias("role")))
        )).alias("r"))
    if multi_block:
        # chunks whose segment began in an earlier block: fetch O+1 predecessors by join
        want = (tagged.where(F.col("ov_b") < 0)
                .select("file", "seg", F.col("chunk_no").alias("target"),
                        F.explode(F.sequence(F.lit(1), F.col("ov_n"))).alias("j"), "k")
                .select("file", "seg", "target", (F.col("k") - F.col("j")).alias("k")))
        extra = (want.join(tagged.where(~F.col("is_split")).drop("ov_targets"), ["file", "seg", "k"])
                 .select("file", "ord", "k", "n", "text", "is_split", "ov_n", "ov_b", *meta_cols,
                         F.struct(F.col("target"), F.lit(1).alias("role")).alias("r")))
        routed = routed.unionByName(extra)
    routed = routed.select("*", F.col("r.target").alias("chunk_no"), F.col("r.role").alias("role")).drop("r")

    part = F.struct("role", "k", "ord", "n", "text", "is_split", "ov_b", *meta_cols)
    g = routed.groupBy("file", "chunk_no").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    own = F.filter("parts", lambda x: x["role"] == 0)
    prev = F.filter("parts", lambda x: x["role"] == 1)
    g = g.select("file", "chunk_no", own.alias("own"), prev.alias("prev"))
    first = F.col("own")[0]

    # An oversized element is a chunk of its own, cut into windows.
    stride = p.chunk_size - O
    big = g.where(first["is_split"]).withColumn("tok", tokenizer(first["text"]))
    starts = F.sequence(F.lit(0), F.size("tok") - 1, F.lit(stride))
    win = F.slice("tok", F.col("start") + 1, p.chunk_size)
    windows = (big.select("file", "chunk_no", "tok", F.col("own")[0].alias("e"),
                          F.posexplode(starts).alias("pos", "start"), F.size(starts).alias("total_parts"))
               .select("file", "chunk_no",
                       (F.col("pos") + 1).cast("int").alias("chunk_part"),
                       F.col("total_parts").cast("int").alias("total_parts"),
                       detokenizer(win).alias("content"),
                       F.size(win).cast("long").alias("n_tokens"),
                       F.col("e.ord").cast("int").alias("slide_number"),
                       F.lit(None).cast("array<int>").alias("slides_covered"),
                       *[F.col("e")[c].alias(c) for c in meta_cols]))

    # overlap = last O tokens of the segment before the chunk (raw text if it has <= O tokens).
    normal = g.where(~first["is_split"])
    fetched_tot = F.aggregate("prev", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    before = F.when(first["ov_b"] >= 0, first["ov_b"]).otherwise(fetched_tot)
    raw = F.array_join(F.transform("prev", lambda x: x["text"]), "\n\n")
    tails = F.transform("prev", lambda x: F.slice(tokenizer(x["text"]),
                                                  F.greatest(x["n"] - O, F.lit(0)).cast("int") + 1, O))
    flat = F.flatten(tails)
    tail = detokenizer(F.slice(flat, F.greatest(F.size(flat) - O, F.lit(0)) + 1, O))
    has_prev = F.size("prev") > 0
    overlap_text = F.when(~has_prev, F.lit(None)).when(before <= O, raw).otherwise(tail)
    overlap_tokens = F.when(~has_prev, F.lit(0)).otherwise(F.least(before, F.lit(O)))
    own_text = F.array_join(F.transform("own", lambda x: x["text"]), "\n\n")
    own_tokens = F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    slides = F.filter(F.transform("own", lambda x: x["ord"].cast("int")), lambda s: s > 0)  # F4
    normal_chunks = normal.select(
        "file", "chunk_no",
        F.lit(None).cast("int").alias("chunk_part"),
        F.lit(None).cast("int").alias("total_parts"),
        F.concat_ws("\n\n", overlap_text, own_text).alias("content"),
        (own_tokens + overlap_tokens).cast("long").alias("n_tokens"),
        F.element_at(slides, 1).alias("slide_number"),
        slides.alias("slides_covered"),
        *[first[c].alias(c) for c in meta_cols])
    return normal_chunks.unionByName(windows)


def token_windows(text_col, params: Params = DEFAULT, tokenizer: Tokenizer = words,
                  detokenizer: Tokenizer = detokenize):
    """W7 as a column: array of window texts (whole text if it fits in one window)."""
    p = params
    tok = tokenizer(text_col)
    stride = p.chunk_size - p.chunk_overlap
    wins = F.transform(F.sequence(F.lit(0), F.size(tok) - 1, F.lit(stride)),
                       lambda s: detokenizer(F.slice(tok, s + 1, p.chunk_size)))
    return F.when(F.size(tok) <= p.chunk_size, F.array(text_col)).otherwise(wins)
