"""Operator 4: language identification by multinomial naive Bayes over hashed
character n-grams, with a broadcast log-probability matrix and sparse numpy scoring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import iter_text

BITS = 15                    # 32,768 hash buckets
ORDERS = (2, 3)              # n-gram lengths in code points
MAX_LANGS = 1000             # bound of the broadcast matrix: MAX_LANGS x 2**BITS doubles are refused beyond it
PIECE = 1 << 18              # code points scored at a time
_MULT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def buckets(text: str) -> Iterator[np.ndarray]:
    """Hash buckets of the n-grams of a text, piece by piece. Letters are lower-cased, every
    other run of characters is one blank, and the text stands between blanks. Nothing is
    yielded for a text without letters."""
    carry = np.array([32], np.uint64)
    seen = False
    for at in range(0, len(text), PIECE):
        cp = np.frombuffer(text[at:at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        ok = _is_letter()[cp]
        if not seen and not ok.any():
            continue
        seen = True
        a = np.concatenate([carry, np.where(ok, cp, 32).astype(np.uint64)])
        if at + PIECE >= len(text):
            a = np.append(a, np.uint64(32))
        blank = a == 32
        a = a[~(blank & np.concatenate([[False], blank[:-1]]))]
        fresh = len(carry) - 1
        out = []
        for n in ORDERS:
            # n-grams that end in this piece: the carry holds the last ORDERS[-1] - 1 characters
            first = max(0, fresh + 2 - n) if fresh else 0
            m = len(a) - n + 1 - first
            if m <= 0:
                continue
            h = np.full(m, np.uint64(n))
            for j in range(n):
                h = (h ^ a[first + j:first + j + m]) * _MULT[j % 3]
            out.append((h >> np.uint64(64 - BITS)).astype(np.int64))
        carry = a[-(ORDERS[-1] - 1):]
        if out:
            yield np.concatenate(out)


@dataclass(frozen=True)
class Model:
    langs: list[str]
    log_prob: np.ndarray     # (2**BITS, languages)
    log_prior: np.ndarray


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", alpha: float = 0.1) -> Model:
    """Fit on every row with a non-null text and language (no sample): tasks emit n-gram counts per
    (language, bucket), Spark adds them, and at most MAX_LANGS x 2**BITS sums reach the driver.
    Raises ValueError on more languages than MAX_LANGS; without any labelled row no language is known."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, c in held.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())],
                    names=["lang", "bucket", "n"])
            held.clear()

        for b in batches:
            for t, lang in zip(iter_text(b.column(0)), b.column(1).to_pylist()):
                for idx in buckets(t):
                    c = held.get(lang)
                    if c is None:
                        if len(held) >= 64:
                            yield from flush()
                        c = held[lang] = np.zeros((1 << BITS) + 1, np.int64)
                    c[:-1] += np.bincount(idx, minlength=1 << BITS)
                c = held.get(lang)
                if c is not None:
                    c[-1] += 1           # the slot after the buckets counts (texts of) the language
        yield from flush()

    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(text_col, lang_col)
    sums = (rows.mapInArrow(count, "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    got = sums.limit(MAX_LANGS * ((1 << BITS) + 1) + 1).toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    counts = np.zeros(((1 << BITS) + 1, len(langs)))
    col = np.searchsorted(np.array(langs), np.array(got.column("lang").to_pylist())) if langs else []
    counts[got.column("bucket").to_numpy(), col] = got.column("n").to_numpy()
    prior, grams = np.maximum(counts[-1], 1), counts[:-1] + alpha
    return Model(langs, np.log(grams / grams.sum(axis=0)) if langs else counts[:-1],
                 np.log(prior / prior.sum()) if langs else prior)


def predict(text: Column, model) -> Column:
    """Struct (lang_pred, score) of a text; ``model`` is a broadcast :class:`Model`. The score is the
    posterior of the predicted language; ties go to the first language in order. ``und`` with score 0
    for a null or empty text, one without a letter, or a model without languages."""

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def scored(col: pa.Array) -> pa.Array:
        m = model.value
        langs, scores = [], []
        for t in iter_text(col):
            total = None
            for idx in buckets(t) if t and m.langs else ():
                part = np.take(m.log_prob, idx, axis=0).sum(axis=0)
                total = part if total is None else total + part
            if total is None:
                langs.append("und")
                scores.append(0.0)
                continue
            total = total + m.log_prior
            best = int(np.argmax(total))
            langs.append(m.langs[best])
            scores.append(float(1.0 / np.exp(total - total[best]).sum()))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                          names=["lang_pred", "score"])

    return scored.asNondeterministic()(text)


def held_out(doc_id: Column) -> Column:
    """True for the test fold: crc32 of the id as text, mod 5, is 0 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on the rows outside the test fold and predict every row from its text alone.
    Rows repeat as given; an empty table gives an empty result; other columns are not read."""
    model = train(docs.where(~held_out(F.col(id_col))), text_col, lang_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return (docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"),
                        predict(F.col(text_col), sent).alias("__p"))
            .select(F.col(id_col), "held_out", "__p.lang_pred", "__p.score"))
