"""Operator 6: token counts by heap-and-linked-list byte-pair merging.

A pre-token's bytes start as a doubly linked list of symbols; a heap holds the
rank of each adjacent pair, the lowest (then leftmost) pair is merged, and the
count is the number of initial symbols minus the merges. No identifier is made.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import iter_text

# White space as the byte-level pre-tokenizer of this vocabulary sees it.
_SPACE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_ASCII_SPACE = "\\t-\\r\\x20"
MAX_MODEL_BYTES = 64 << 20


def _pattern(letter: str, number: str, space: str) -> str:
    return (rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+"
            rf"|[{space}]+(?![^{space}])|[{space}]+")


_UNICODE = regex.compile(_pattern(r"\p{L}", r"\p{N}", _SPACE))
_ASCII = re.compile(_pattern("A-Za-z", "0-9", _ASCII_SPACE))


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next code point from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(extra)) for b in range(256)]


class MergeCounter:
    """Compiled from the bytes of a ``tokenizers`` JSON file with a byte-level BPE model."""

    CACHE = 400_000

    def __init__(self, model: bytes) -> None:
        t = json.loads(model)
        pre, bpe = t["pre_tokenizer"], t["model"]
        if bpe["type"] != "BPE" or t.get("normalizer") or pre["type"] != "ByteLevel" or pre["add_prefix_space"] \
                or not pre.get("use_regex", True) or bpe.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files are supported")
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in bpe["merges"])
        self.rank = {p: i for i, p in enumerate(pairs)}
        added = sorted((a["content"] for a in t.get("added_tokens", [])), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.symbol = byte_symbols()
        self.cache: dict[str, int] = {}

    def merged_length(self, token: str) -> int:
        """Number of tokens of one pre-token."""
        sym: list[str | None] = [self.symbol[b] for b in token.encode("utf-8", "replace")]
        n = len(sym)
        if n < 2:
            return n
        rank = self.rank
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := rank.get((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue                       # the pair is gone
            sym[i], sym[j] = a + b, None
            k = nxt[i] = nxt[j]
            merges += 1
            if k < n:
                prv[k] = i
                if (r := rank.get((sym[i], sym[k]))) is not None:
                    heapq.heappush(heap, (r, i, sym[i], sym[k]))
            p = prv[i]
            if p >= 0 and (r := rank.get((sym[p], sym[i]))) is not None:
                heapq.heappush(heap, (r, p, sym[p], sym[i]))
        return n - merges

    def _plain(self, text: str) -> int:
        total, cache = 0, self.cache
        for m in (_ASCII if text.isascii() else _UNICODE).findall(text):
            c = cache.get(m)
            if c is None:
                c = self.merged_length(m)
                if len(m) <= 64:
                    if len(cache) >= self.CACHE:
                        cache.clear()
                    cache[m] = c
            total += c
        return total

    def count(self, text: str) -> int:
        """Tokens of a whole text; each special string inside it is one token."""
        if self.special is None:
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


_compiled: dict[int, MergeCounter] = {}


def token_counts(text: Column, model) -> Column:
    """Struct (n_bytes, n_tokens) of a text column; ``model`` is a broadcast of the file's bytes.
    Null counts as the empty text: 0 bytes, 0 tokens."""

    key = zlib.crc32(model.value)

    @F.arrow_udf("struct<n_bytes:bigint,n_tokens:bigint>")
    def counts(col: pa.Array) -> pa.Array:
        m = _compiled.get(key)
        if m is None:
            m = _compiled[key] = MergeCounter(model.value)
        size, toks = [], []
        for t in iter_text(col):
            size.append(len(t.encode()) if t else 0)
            toks.append(m.count(t) if t else 0)
        return pa.StructArray.from_arrays([pa.array(size, pa.int64()), pa.array(toks, pa.int64())],
                                          names=["n_bytes", "n_tokens"])

    return counts.asNondeterministic()(text)


def broadcast_file(spark, path: str):
    """The bytes of a vocabulary file (a fixed file, refused above MAX_MODEL_BYTES) for all executors."""
    with open(path, "rb") as f:
        data = f.read(MAX_MODEL_BYTES + 1)
    if len(data) > MAX_MODEL_BYTES:
        raise ValueError("vocabulary file too large to broadcast")
    return spark.sparkContext.broadcast(data)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 512, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit of every row, from whole texts. Row-local: no shuffle;
    nulls count as empty, repeated rows repeat, an empty table stays empty, other columns are not read."""
    model = broadcast_file(docs.sparkSession, model_path)
    return (docs.select(F.col(id_col), token_counts(F.col(text_col), model).alias("__t"))
            .select(F.col(id_col), "__t.n_bytes", "__t.n_tokens",
                    (F.col("__t.n_tokens") > limit).alias("over_limit")))
