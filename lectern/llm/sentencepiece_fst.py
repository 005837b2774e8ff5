"""Operator 3: SentencePiece encoding and decoding as a weighted finite-state transducer.

A model file is compiled into three transducers: the normaliser (blank escaping and the
dummy prefix), the pieces (a trie over characters) and the byte fallback (one arc a
character that has no piece of its own). Composing them with an input gives a lattice
whose states are (position, last piece); the encoding is its shortest path in the
tropical semiring.

Unigram models weight an arc by the negative score of its piece. For BPE models the
scores are merge ranks, which no sum reproduces; there an arc costs 0 if merging the
last piece followed by the new one yields just these two, and infinity otherwise. A
sequence whose neighbours all agree in this way is the merge result itself, and each
prefix of the input has exactly one, so the finite path is the encoding.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.bpe_count import broadcast_file
from lectern.llm.common import iter_text

BLANK = "▁"
# Piece types and model types of the file format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNK_PENALTY = 10.0


def _fields(buf: bytes):
    """(number, value) of each field of a serialized message."""
    at, n = 0, len(buf)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = buf[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < n:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            yield tag >> 3, buf[at:at + size]
            at += size
        else:
            size = varint()
            yield tag >> 3, buf[at:at + size]
            at += size


class Transducer:
    """Compiled from the bytes of a SentencePiece model file (identity normalisation rules)."""

    CACHE = 200_000              # segments, and pairs of neighbours, remembered between texts

    def __init__(self, model: bytes, cache: int = CACHE) -> None:
        self.CACHE = cache
        self.pieces: list[str] = []
        self.types: list[int] = []
        self.scores: list[float] = []
        self.kind, self.byte_fallback, self.prefix, self.collapse, escape = UNIGRAM, False, True, True, True
        for no, value in _fields(model):
            if no == 1:
                f = dict(_fields(value))
                self.pieces.append(f.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                self.types.append(f.get(3, NORMAL))
            elif no == 2:
                f = dict(_fields(value))
                self.kind, self.byte_fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
            elif no == 3:
                f = dict(_fields(value))
                if f.get(2):
                    raise ValueError("models with compiled normalisation rules are not supported")
                self.prefix, self.collapse = bool(f.get(3, 1)), bool(f.get(4, 1))
                escape = bool(f.get(5, 1))
        if self.kind not in (UNIGRAM, BPE) or not escape or USER in self.types or UNUSED in self.types:
            raise ValueError("only unigram and BPE models with escaped blanks and without user-defined or unused pieces")
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == NORMAL}
        self.unk = self.types.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        self.longest = max(map(len, self.ids), default=1)
        self.unk_cost = UNK_PENALTY - min((self.scores[i] for i in self.ids.values()), default=0.0)
        self.cut = self._cuts()
        #: the text of the pieces that need no look at their neighbours (a byte below 128 is a character)
        self.alone = [p.replace(BLANK, " ") if t == NORMAL else chr(int(p[3:5], 16)) if t == BYTE and int(p[3:5], 16) < 128
                      else None for p, t in zip(self.pieces, self.types)]
        self.trie: dict = {}
        for p, i in self.ids.items():
            node = self.trie
            for ch in p:
                node = node.setdefault(ch, {})
            node[""] = i
        self.agree: dict[str, bool] = {}         # by left piece, tab, right piece
        self.cache: dict[str, tuple[int, ...]] = {}

    def _cuts(self) -> re.Pattern | None:
        """Where to split a normalised input: every path passes a single state before a blank and between a
        letter or digit and a sign, if no piece stands across. None if some piece crosses a blank."""
        beside: set[str] = set()                      # characters next to a letter or digit in some piece
        for p in self.ids:
            for x, y in zip(p, p[1:]):
                if y == BLANK and x != BLANK:
                    return None
                if x.isalnum():
                    beside.add(y)
                if y.isalnum():
                    beside.add(x)
        sign = "".join(re.escape(c) for c in map(chr, range(128)) if not c.isalnum() and c not in beside)
        blank = f"(?<=[^{BLANK}])(?={BLANK})"
        return re.compile(f"{blank}|(?<=[^\\W_])(?=[{sign}])|(?<=[{sign}])(?=[^\\W_])" if sign else blank)

    # -- the normaliser ------------------------------------------------------------------
    def normalise(self, text: str) -> str:
        if self.collapse:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return ((BLANK if self.prefix else "") + text).replace(" ", BLANK)

    # -- byte-pair agreement of neighbours -----------------------------------------------
    def merge(self, s: str) -> list[str]:
        """Merge result of a short string: repeatedly the best-scored, then leftmost, adjacent pair."""
        sym: list[str | None] = list(s)
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))

        def pair(i: int, j: int):
            k = self.ids.get(sym[i] + sym[j])
            return None if k is None else (-self.scores[k], i, sym[i], sym[j])

        heap = [p for i in range(n - 1) if (p := pair(i, i + 1))]
        heapify(heap)
        while heap:
            _, i, a, b = heappop(heap)
            j = nxt[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = a + b, None
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if p := pair(i, k):
                    heappush(heap, p)
            if prv[i] >= 0 and (p := pair(prv[i], i)):
                heappush(heap, p)
        return [x for x in sym if x is not None]

    def agrees(self, left: str, right: str) -> bool:
        """Whether merging the two pieces' characters yields just these two."""
        return self.merge(left + right) == ([left, right] if left else [right])

    # -- composition and shortest path ---------------------------------------------------
    def arcs(self, s: str, at: int):
        """(end, piece string) of the arcs that leave a position."""
        node, end, first = self.trie, at, False
        while end < len(s):
            node = node.get(s[end])
            if node is None:
                break
            end += 1
            if "" in node:
                first |= end == at + 1
                yield end, s[at:end]
        if not first:
            yield at + 1, s[at]                      # byte fallback, or the unknown piece

    def _path_bpe(self, s: str) -> list[str]:
        """Depth first, longest arcs first. A position reached at cost 0 has its only finite prefix behind it, so
        a position that leads nowhere is never entered again, and the first path to the end is the shortest."""
        n, trie, agree = len(s), self.trie, self.agree
        if len(agree) >= self.CACHE:
            agree.clear()
        seen = bytearray(n + 1)
        path: list[str] = []
        ahead: list[list[str]] = []                    # arcs not tried yet, shortest first
        at, left = 0, ""
        while at < n:
            if not seen[at]:
                seen[at] = 1
                arcs, node, end = [], trie, at
                while end < n:
                    node = node.get(s[end])
                    if node is None:
                        break
                    end += 1
                    if "" in node:
                        arcs.append(s[at:end])
                if not arcs or len(arcs[0]) > 1:
                    arcs.insert(0, s[at])              # byte fallback, or the unknown piece
            else:
                arcs = []
            while True:
                step = None
                while arcs:
                    piece = arcs.pop()
                    if seen[at + len(piece)]:
                        continue
                    key = left + "\t" + piece
                    ok = agree.get(key)
                    if ok is None:
                        ok = agree[key] = self.agrees(left, piece)
                    if ok:
                        step = piece
                        break
                if step is not None:
                    ahead.append(arcs)
                    path.append(step)
                    at += len(step)
                    left = step
                    break
                piece = path.pop()                     # back to the state before
                at -= len(piece)
                left = path[-1] if path else ""
                arcs = ahead.pop()
        return path

    def _path_unigram(self, s: str) -> list[str]:
        cost = [float("inf")] * (len(s) + 1)
        back: list[str | None] = [None] * (len(s) + 1)
        cost[0] = 0.0
        for at in range(len(s)):
            for end, piece in self.arcs(s, at):
                i = self.ids.get(piece)
                c = cost[at] + (self.unk_cost if i is None else -self.scores[i])
                if c < cost[end]:
                    cost[end], back[end] = c, piece
        return self._trace(s, back)

    @staticmethod
    def _trace(s: str, back: list[str | None]) -> list[str]:
        out, at = [], len(s)
        while at:
            out.append(back[at])
            at -= len(back[at])
        return out[::-1]

    def _emit(self, path: list[str]) -> tuple[int, ...]:
        out: list[int] = []
        for p in path:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.byte_fallback:
                out += [self.bytes[b] for b in p.encode("utf-8", "replace")]
            elif not out or out[-1] != self.unk:             # neighbouring unknown characters are one piece
                out.append(self.unk)
        return tuple(out)

    def forget(self) -> None:
        """Drop what is remembered between texts. A Python worker outlives its task, so a job among others calls
        this at the end of each task: the next job's memory is its own."""
        self.agree.clear()
        self.cache.clear()

    def encode(self, text: str) -> list[int]:
        s = self.normalise(text)
        path = self._path_bpe if self.kind == BPE else self._path_unigram
        if self.cut is None or (not self.byte_fallback and self.kind == UNIGRAM):
            return list(self._emit(path(s)))
        out: list[int] = []
        cache = self.cache
        for part in self.cut.split(s) if s else ():
            got = cache.get(part)
            if got is None:
                got = self._emit(path(part))
                if len(part) <= 64:
                    if len(cache) >= self.CACHE:
                        cache.clear()
                    cache[part] = got
            out += got
        return out

    # -- the inverse ---------------------------------------------------------------------
    def decode(self, ids: list[int]) -> str:
        """Text of the identifiers: pieces in turn, byte pieces joined (broken UTF-8 gives U+FFFD a byte),
        blanks restored and the dummy prefix dropped. Control pieces give nothing."""
        alone = self.alone
        parts = [alone[i] for i in ids]
        if None not in parts:
            if parts and self.prefix and self.types[ids[0]] == NORMAL and parts[0].startswith(" "):
                parts[0] = parts[0][1:]
            return "".join(parts)
        out, raw, first = [], bytearray(), self.prefix

        def flush() -> None:
            at = 0
            while at < len(raw):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(raw[at:at + n]).decode())
                    except UnicodeDecodeError:
                        continue
                    at += n
                    break
                else:
                    out.append("�")
                    at += 1
            raw.clear()

        for i in ids:
            t = self.types[i]
            if t == BYTE:
                raw.append(int(self.pieces[i][3:5], 16))
                first = False
                continue
            flush()
            if t == NORMAL:
                p = self.pieces[i]
                out.append((p[1:] if first and p[0] == BLANK else p).replace(BLANK, " "))
            elif t == UNKNOWN:
                out.append(" ⁇ ")
            first = first and t == CONTROL
        flush()
        return "".join(out)


_compiled: dict[tuple[int, int], Transducer] = {}
DIGEST_CACHE = 600_000       # for a job that does nothing beside it: about 200 MB a Python worker


def _load(key: int, model, cache: int = Transducer.CACHE) -> Transducer:
    t = _compiled.get((key, cache))
    if t is None:
        t = _compiled[key, cache] = Transducer(model.value, cache)
    return t


def encode(text: Column, model) -> Column:
    """array<int> of piece identifiers of a whole text (null and empty: no pieces); ``model`` is a
    broadcast of the model file's bytes. No begin or end marks; their strings in a text are plain text."""
    key = zlib.crc32(model.value)

    @F.arrow_udf("array<int>")
    def run(cols: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = _load(key, model)
        try:
            for col in cols:
                yield pa.array([t.encode(x) if x else [] for x in iter_text(col)], pa.list_(pa.int32()))
        finally:
            t.forget()

    return run.asNondeterministic()(text)


def decode(ids: Column, model) -> Column:
    """Text of an array of identifiers (null: the empty text)."""
    key = zlib.crc32(model.value)

    @F.arrow_udf("string")
    def run(col: pa.Array) -> pa.Array:
        t = _load(key, model)
        return pa.array([t.decode(x.as_py() or []) for x in col], pa.string())

    return run.asNondeterministic()(ids)


def encode_documents(docs: DataFrame, model_path: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """All rows and columns of ``docs`` plus ``out_col``. Row-local: no shuffle; repeated rows repeat and an
    empty table stays empty. Raises ValueError if the column exists already."""
    if out_col in docs.columns:
        raise ValueError(f"column exists already: {out_col}")
    model = broadcast_file(docs.sparkSession, model_path)
    return docs.withColumn(out_col, encode(F.col(f"`{text_col}`"), model))


def token_digest(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, round_trip) of every row: the digest is of the identifiers as 32-bit
    little-endian numbers, and round_trip tells whether decoding restores the text (null: empty)."""
    model = broadcast_file(docs.sparkSession, model_path)
    key = zlib.crc32(model.value)

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,round_trip:boolean>")
    def run(col: pa.Array) -> pa.Array:
        t = _load(key, model, DIGEST_CACHE)
        n, sha, same = [], [], []
        for x in iter_text(col):
            ids = t.encode(x or "")
            n.append(len(ids))
            sha.append(hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest())
            same.append(t.decode(ids) == (x or ""))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(sha, pa.string()),
                                           pa.array(same, pa.bool_())], names=["n_tokens", "ids_sha256", "round_trip"])

    return (docs.select(F.col(id_col), run.asNondeterministic()(F.col(text_col)).alias("__t"))
            .select(F.col(id_col), "__t.*"))
