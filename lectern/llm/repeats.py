"""Operator 2: removal of repeated passages by suffix arrays built with external induced sorting.

A byte goes if a string of ``depth`` bytes that covers it also starts at another place of the
corpus, the same document included. Equal strings have the same smallest hash of their K-byte
substrings, so all places of a string meet under that fingerprint: maximal runs of places with
one fingerprint are the units, and only runs whose fingerprint occurs again go on (a lossless
routing, which cuts nothing that could match), or whose text repeats itself. Equal runs are one text with a weight. The texts of a
fingerprint go to one shard, whose suffix order and common prefixes (``induced_sort``) tell which
places repeat. Intervals then return to their documents by key.

A fingerprint with more than ``hot_places`` runs would make one shard grow with the corpus. Its
runs are cut into single places under a fingerprint of the whole string, so that it spreads over
all shards and equal places still meet (and are counted before the shuffle).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import words
from lectern.llm.common import iter_bytes, load, long_key, written
from lectern.llm.induced_sort import repeated_positions

DEPTH = 200
GRAM = 50                    # bytes of a fingerprinted substring
PIECE = 1 << 18              # bytes of a text fingerprinted at a time
RUN = 4096                   # places of a run at most; longer (periodic) runs are cut
SHARD_BYTES = 2 << 20        # bytes sorted by one task (about 100 bytes of memory a byte)
HOT_PLACES = 50_000
MAX_HOT = 1_000_000          # fingerprints in the broadcast list of hot ones


def _minimum_filter(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive elements."""
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[:len(x) - (width - step)], x[width - step:])


def _periodic(x: np.ndarray, span: int) -> np.ndarray:
    """Places where a hash comes again within ``span - 1`` places, looked up at every 128th place. Two equal
    strings that start fewer than ``span`` places apart make more than 128 consecutive such places."""
    if len(x) < 2:
        return np.zeros(0, np.int64)
    ahead = np.lib.stride_tricks.sliding_window_view(np.append(x[1:], np.zeros(span - 1, np.uint64)), span - 1)
    hit = [np.flatnonzero((ahead[a:a + (1 << 19):128] == x[a:a + (1 << 19):128, None]).any(axis=1)) * 128 + a
           for a in range(0, len(x), 1 << 19)]
    return np.concatenate(hit)


def runs(buf: np.ndarray, depth: int = DEPTH, gram: int = GRAM, hot: np.ndarray | None = None):
    """(fingerprint, content hash, first place, end of text, own) of the runs of a text's places; the places of a
    run are [first, end - depth], and ``own`` is false only if no two of them start equal strings. Texts are read in pieces that overlap by depth - 1 bytes."""
    out = []
    n = len(buf)
    for at in range(0, max(n - depth + 1, 0), PIECE):
        b = buf[at:min(n, at + PIECE + depth - 1)]
        pw, inv = words._powers(len(b) + 1)
        pre = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(words._BYTE[b] * pw[:len(b)], out=pre[1:])
        x = words.mix((pre[gram:] - pre[:-gram]) * inv[:len(b) - gram + 1])
        width = depth - gram + 1
        low = _minimum_filter(x, width)
        cut = np.flatnonzero(low[1:] != low[:-1]) + 1
        first, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(low)]])
        if (end - first).max() > RUN:
            parts = [np.arange(f, e, RUN) for f, e in zip(first, end)]
            first = np.concatenate(parts)
            end = np.append(first[1:], len(low))
        fp = low[first]
        own = end - first > width        # more places than one smallest substring can serve
        near = _periodic(x, width)
        if len(near):
            at_or_after = near[np.minimum(np.searchsorted(near, first), len(near) - 1)]
            own |= (at_or_after >= first) & (at_or_after < end - 1 + depth)
        if hot is not None and len(hot):
            is_hot = np.isin(fp, hot)
            if is_hot.any():
                size = np.where(is_hot, end - first, 1)
                single = np.repeat(is_hot, size)
                step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                first, end, fp = np.repeat(first, size) + step, np.repeat(end, size), np.repeat(fp, size)
                own = np.repeat(own, size) & ~single
                end[single] = first[single] + 1
                whole = words.mix((pre[first[single] + depth] - pre[first[single]]) * inv[first[single]])
                fp[single] = words.mix(fp[single] ^ whole)
        stop = end - 1 + depth
        ctx = words.mix((pre[stop] - pre[first]) * inv[first] + (stop - first).astype(np.uint64))
        out.append((fp.view(np.int64), ctx.view(np.int64), first + at, stop + at, own))
    return [np.concatenate(x) for x in zip(*out)] if out else None


def key_columns(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """Identity of a document row: its id (a hash of one that is no integer; null apart from every id) and a hash of
    its text. Only equal texts can share a key, and these have equal spans."""
    return [long_key(docs, F.col(id_col)).alias("did"),
            F.xxhash64(F.col(text_col), F.col(id_col).isNull()).alias("th")]


def place_runs(docs: DataFrame, depth: int, gram: int, hot: np.ndarray | None) -> DataFrame:
    """(fp, ctx, first, stop, own, did, th) of every run of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["fp", "ctx", "first", "stop", "own", "did", "th"]

        def block(held: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=names)

        for b in batches:
            held, n = [], 0
            for raw, did, th in zip(iter_bytes(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist()):
                got = runs(np.frombuffer(raw, np.uint8), depth, gram, hot) if raw is not None else None
                if got is None:
                    continue
                m = len(got[0])
                held.append((*got, np.full(m, did, np.int64), np.full(m, th, np.int64)))
                n += m
                if n > 100_000:
                    yield block(held)
                    held, n = [], 0
            if held:
                yield block(held)

    return (docs.select("text", "did", "th").where(F.octet_length("text") >= depth)
            .mapInArrow(run, "fp long, ctx long, first long, stop long, own boolean, did long, th long"))


def _sort_shard(depth: int):
    """Repeated places of the distinct texts of one shard: (fp, ctx, spans) with spans as (from, to) byte
    ranges within the text, packed as int64 pairs; texts without any are left out."""

    def run(table: pa.Table) -> pa.Table:
        texts = [np.frombuffer(x, np.uint8) for x in iter_bytes(table.column("bytes"))]
        size = np.array([len(x) for x in texts], np.int64)
        # bytes are shifted by one (0 ends the shard); a byte that UTF-8 never has ends each text
        t = np.full(int(size.sum()) + len(size), 255, np.uint8)
        at = np.concatenate([[0], np.cumsum(size + 1)])
        for x, a in zip(texts, at.tolist()):
            t[a:a + len(x)] = x + np.uint8(1)
        twice = repeated_positions(t, depth)
        keep, spans = [], []
        for i, (a, n) in enumerate(zip(at.tolist(), size.tolist())):
            hit = twice[a:a + n - depth + 1]
            if not hit.any():
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).reshape(-1, 2)
            keep.append(i)
            spans.append(np.stack([edge[:, 0], edge[:, 1] - 1 + depth], 1).astype(np.int64).tobytes())
        part = table.select(["fp", "ctx"]).take(pa.array(keep, pa.int64()))
        return part.append_column("spans", pa.array(spans, pa.binary()))

    return run


def repeated_spans(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, hot_places: int = HOT_PLACES,
                   shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(did, th, spans): for each document (by ``key_columns``) with a repeated string, the byte ranges
    covered, as an array of (first, from, to) relative to the start ``first`` of a run. ``docs`` has text, did and th."""
    spark = docs.sparkSession
    placed = written(place_runs(docs, depth, gram, None), "runs", batch_rows=1000)
    seen = placed.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    hot = seen.where(F.col("n") > hot_places).select("fp").limit(MAX_HOT + 1).toArrow().column("fp").to_numpy()
    if len(hot) > MAX_HOT:
        raise ValueError("raise hot_places: too many hot fingerprints for a broadcast list")
    if len(hot):
        placed = written(place_runs(docs, depth, gram, hot.view(np.uint64)), "runs", batch_rows=1000)
    # texts of fingerprints that occur again, with their weight
    again = placed.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("ctx").alias("c0"), F.max("ctx").alias("c1"),
                                     F.max("own").alias("own")) \
                  .where("n > 1 OR own").select("fp", (F.col("own") | (F.col("c0") < F.col("c1"))).alias("several"))
    busy = written(placed.join(again, "fp"), "places")
    texts = busy.groupBy("fp", "ctx").agg(F.count(F.lit(1)).alias("n"), F.first("several").alias("several"),
                                          F.min(F.struct("did", "th", "first", "stop")).alias("at"))
    texts = written(texts, "texts")
    # a text that occurs twice as a whole repeats at every place; the others are sorted with all texts of their fingerprint
    whole = texts.where("n > 1").select("fp", "ctx", F.lit(None).cast("binary").alias("spans"))
    sort = texts.where("several").select("fp", "ctx", "at.did", "at.th", "at.first", "at.stop", "n")
    total = sort.agg(F.sum(F.col("stop") - F.col("first"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    per_doc = sort.groupBy("did", "th").agg(F.collect_list(F.struct("fp", "ctx", "first", "stop")).alias("cuts"))
    source = docs.select("did", "th", F.col("text").cast("binary").alias("raw")).dropDuplicates(["did", "th"])
    cut = (per_doc.join(source, ["did", "th"]).select("raw", F.explode("cuts").alias("c"))
           .select("c.fp", "c.ctx", F.expr("substring(raw, cast(c.first + 1 as int), cast(c.stop - c.first as int))").alias("bytes")))
    found = (cut.withColumn("shard", F.pmod(F.xxhash64("fp"), F.lit(int(shards))))
             .groupBy("shard").applyInArrow(_sort_shard(depth), "fp long, ctx long, spans binary"))
    partial = found.join(whole.select("fp", "ctx"), ["fp", "ctx"], "left_anti")
    result = written(whole.unionByName(partial), "repeats")
    return (busy.join(result, ["fp", "ctx"])
            .groupBy("did", "th").agg(F.collect_list(F.struct("first", "stop", "spans")).alias("spans")))


def _cover(n: int, spans: list[dict]) -> np.ndarray:
    """Edges (k, 2) of the maximal removed runs of a text of n bytes."""
    lo, hi = [], []
    for s in spans:
        if s["spans"] is None:
            lo.append(np.array([s["first"]]))
            hi.append(np.array([s["stop"]]))
        else:
            p = np.frombuffer(s["spans"], np.int64).reshape(-1, 2) + s["first"]
            lo.append(p[:, 0])
            hi.append(p[:, 1])
    lo, hi = np.concatenate(lo), np.concatenate(hi)
    turn = np.argsort(lo)
    lo, hi = lo[turn], np.maximum.accumulate(hi[turn])
    new = np.concatenate([[True], lo[1:] > hi[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(lo) - 1]])
    return np.stack([lo[new], hi[last]], 1)


def _kept(raw, spans: list[dict] | None) -> tuple[bytes, int, int]:
    """(remaining bytes, removed bytes, removed runs)."""
    if not spans:
        return bytes(raw), 0, 0
    edges = _cover(len(raw), spans)
    parts, at = [], 0
    for a, b in edges.tolist():
        parts.append(raw[at:a])
        at = b
    parts.append(raw[at:])
    return b"".join(parts), int((edges[:, 1] - edges[:, 0]).sum()), len(edges)


def _joined(docs: DataFrame, id_col: str, text_col: str, depth: int, gram: int, hot_places: int,
            shard_bytes: int, extra: list[Column]) -> DataFrame:
    keyed = docs.select(*key_columns(docs, id_col, text_col), F.col(text_col).alias("text"), *extra)
    spans = repeated_spans(keyed.select("did", "th", "text"), depth, gram, hot_places, shard_bytes)
    return keyed.join(spans, ["did", "th"], "left")


def repeat_digest(docs: DataFrame, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text",
                  gram: int = GRAM, hot_places: int = HOT_PLACES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs``. A null text counts as empty;
    texts shorter than ``depth`` lose nothing; repeated rows repeat each other, so they lose everything from
    ``depth`` bytes on. Other columns are not read; an empty table gives an empty result."""
    joined = _joined(docs, id_col, text_col, depth, gram, hot_places, shard_bytes, [F.col(id_col).alias("__id")])

    @F.arrow_udf("struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept_sha256:string>")
    def digest(text: pa.Array, spans: pa.Array) -> pa.Array:
        rows = []
        for raw, s in zip(iter_bytes(text), spans):
            kept, gone, n = _kept(raw if raw is not None else b"", s.as_py())
            rows.append((len(kept) + gone, gone, n, hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*rows)) or [()] * 4
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 3 + [pa.string()])],
                                          names=["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return (joined.select("__id", digest.asNondeterministic()(F.col("text"), F.col("spans")).alias("d"))
            .select(F.col("__id").alias("doc_id"), "d.*"))


def remove_repeats(docs: DataFrame, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text",
                   gram: int = GRAM, hot_places: int = HOT_PLACES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text_col``; all other columns as they are. A character cut
    in two by a removed range goes with it, so that the text stays valid UTF-8; null texts stay null."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("__row")
    joined = _joined(docs, id_col, text_col, depth, gram, hot_places, shard_bytes, [row])

    @F.arrow_udf("string")
    def kept(text: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([None if raw is None else _kept(raw, s.as_py())[0].decode("utf-8", "ignore")
                         for raw, s in zip(iter_bytes(text), spans)], pa.string())

    out = joined.select("__row", kept.asNondeterministic()(F.col("text"), F.col("spans")).alias("__text"))
    return out.select(*[F.col("__text").alias(c) if c == text_col else F.col(f"__row.`{c}`").alias(c)
                        for c in docs.columns])


def op2(spark, sf_dir):
    return repeat_digest(load(spark, sf_dir, "documents"))
