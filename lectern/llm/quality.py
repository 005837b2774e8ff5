"""Operator 5: quality rules as a short-circuit cascade.

Each rule's cost and rejection rate are estimated on a bounded sample, then the
rules run in descending order of rejections per unit of cost and a document stops
at its first rejection. The verdict is the conjunction of all rules, so the order
changes only the time, never the result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import words
from lectern.llm.common import iter_bytes

STATS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, "
         "n_repeat_words long, base_failed boolean, kept boolean")
_STAT_NAMES = [x.split()[0] for x in STATS.split(", ")]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)          # ASCII letters and every non-ASCII lead byte
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC2:0xF5] = True
_BANG = np.zeros(256, bool)
_BANG[list(b"!?")] = True


class Doc:
    """One text with its base statistics."""

    def __init__(self, raw) -> None:
        self.buf = buf = np.frombuffer(raw, np.uint8)
        self.word_chars = self.n_symbols = 0
        in_word = words._IS_WORD
        for s in words.slices(buf):
            self.word_chars += int(np.count_nonzero(in_word[s] & ((s & 0xC0) != 0x80)))
            self.n_symbols += int(np.count_nonzero(_SYMBOL[s]))
        h = words.word_hashes(buf)
        self.n_words = len(h)
        lines = [x for x in bytes(raw).split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
        self.n_lines = len(lines)
        self.n_dup_lines = self.n_lines - len(set(lines))
        self.n_repeat_words = repeated_window_words(h, 8)
        self.base_failed = self.n_words < 20 or 100 * self.n_repeat_words > 30 * self.n_words

    def count(self, table: np.ndarray) -> int:
        return sum(int(np.count_nonzero(table[s])) for s in words.slices(self.buf))


def repeated_window_words(h: np.ndarray, n: int) -> int:
    """Words inside an n-word window that occurs at least twice in the text."""
    w = words.windows(h, n)
    if len(w) < 2:
        return 0
    s = np.sort(w)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(w, twice))
    edge = np.zeros(len(h) + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1]) > 0))


@dataclass(frozen=True)
class Rule:
    """``rejects`` is called only for documents with at least one word."""
    name: str
    rejects: Callable[[Doc], bool]


RULES = (
    Rule("symbols_per_word", lambda d: d.n_symbols > 0.5 * d.n_words),
    Rule("duplicate_lines", lambda d: d.n_dup_lines > 0.5 * d.n_lines),
    Rule("word_length", lambda d: not 2 <= d.word_chars / d.n_words <= 18),
    Rule("upper_case", lambda d: d.count(_UPPER) > 0.6 * max(1, d.count(_LETTER))),
    Rule("exclamations", lambda d: d.count(_BANG) > 0.5 * d.n_words),
    Rule("letters", lambda d: d.count(_LETTER) < 0.5 * d.word_chars),
)


@dataclass(frozen=True)
class RuleCost:
    name: str
    seconds: float
    rejected: int
    seen: int

    @property
    def benefit(self) -> float:
        """Rejections per second, smoothed so that an unseen rejection is not free of value."""
        return (self.rejected + 1) / (self.seen + 2) / max(self.seconds / max(self.seen, 1), 1e-9)


def calibrate(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES,
              sample_rows: int = 400, seed: int = 5) -> list[RuleCost]:
    """Cost and selectivity of every rule on about ``sample_rows`` random documents (a bound;
    the figures only order the cascade). The sample stays on one executor; one row per rule
    returns to the driver. An empty table gives zero counts."""
    n = max(1, docs.count())
    part = docs.select(F.col(text_col).alias("t")).where(F.rand(seed) < min(1.0, 2.0 * sample_rows / n))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, hit, seen = [0.0] * len(rules), [0] * len(rules), 0
        for b in batches:
            for raw in iter_bytes(b.column(0)):
                d = Doc(raw or b"")
                if d.base_failed:
                    continue
                seen += 1
                for i, r in enumerate(rules):
                    t = time.perf_counter()
                    hit[i] += bool(r.rejects(d))
                    cost[i] += time.perf_counter() - t
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(rules)), pa.int32()), "s": cost, "r": hit,
                                          "n": pa.array([seen] * len(rules), pa.int64())})

    rows = (part.limit(sample_rows).coalesce(1).mapInArrow(measure, "i int, s double, r long, n long")
            .groupBy("i").agg(F.sum("s").alias("s"), F.sum("r").alias("r"), F.sum("n").alias("n")).collect())
    got = {r.i: r for r in rows}
    return [RuleCost(x.name, got[i].s, got[i].r, got[i].n) if i in got else RuleCost(x.name, 0.0, 0, 0)
            for i, x in enumerate(rules)]


def cascade_order(costs: list[RuleCost]) -> list[str]:
    """Rule names by descending rejections per cost (ties: by name)."""
    return [c.name for c in sorted(costs, key=lambda c: (-c.benefit, c.name))]


def quality_stats(text: Column, order: list[str], rules: tuple[Rule, ...] = RULES) -> Column:
    """Struct of the base statistics and the cascade's verdict for one text.

    Null and empty texts have no words: all counts 0, ``base_failed`` true,
    ``kept`` false. Whole texts are read, in slices. Equal texts get equal rows.
    """
    by_name = {r.name: r for r in rules}
    chain = [by_name[n] for n in order]

    @F.arrow_udf(f"struct<{STATS.replace(' long', ':bigint').replace(' boolean', ':boolean')}>")
    def stats(col: pa.Array) -> pa.Array:
        out: list[list] = [[] for _ in _STAT_NAMES]
        for raw in iter_bytes(col):
            d = Doc(raw if raw is not None else b"")
            kept = not d.base_failed and not any(r.rejects(d) for r in chain)
            for o, v in zip(out, (d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words,
                                  d.base_failed, kept)):
                o.append(v)
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
        return pa.StructArray.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], names=_STAT_NAMES)

    # non-deterministic: keeps the optimizer from evaluating it again inside a pushed filter
    return stats.asNondeterministic()(text)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          rules: tuple[Rule, ...] = RULES, sample_rows: int = 400) -> DataFrame:
    """``id_col`` plus the statistics and verdict of every row of ``docs`` (other columns are not read)."""
    order = cascade_order(calibrate(docs, text_col, rules, sample_rows))
    return (docs.select(F.col(id_col), quality_stats(F.col(text_col), order, rules).alias("__q"))
            .select(F.col(id_col), "__q.*"))


def keep(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES,
         sample_rows: int = 400) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns."""
    order = cascade_order(calibrate(docs, text_col, rules, sample_rows))
    names = [F.col(f"`{c}`") for c in docs.columns]
    return (docs.select(F.struct(*names).alias("__row"),
                        quality_stats(F.col(f"`{text_col}`"), order, rules).alias("__q"))
            .where("__q.kept").select("__row.*"))
