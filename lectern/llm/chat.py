"""Operator 8: chat formatting by prefix-target expansion.

Every assistant turn becomes one example: its context is everything formatted
before it, whole, and only its reply is trainable. The output is quadratic in the
turns of a conversation by its nature. It is made by blocks of turn numbers: a block
meets the turns of the blocks before it by a join, and its task spells the contexts of
its own replies out. A long context comes in pieces, so no row is large.

Template: ``<|turn|>`` role newline text ``<|end|>``. Control strings inside a role
or text are escaped reversibly by one backslash after their opening character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import load

OPEN, END = "<|turn|>", "<|end|>"
# What follows the opening bracket of a control string.
_TAIL = r"(?:\||/?s>|/?INST\]|/?SYS>>)"
_ESCAPE = regex.compile(rf"(<<|[<\[])(\\*)(?={_TAIL})")
_UNESCAPE = regex.compile(rf"(<<|[<\[])\\(\\*)(?={_TAIL})")
_PARSE = regex.compile(r"<\|turn\|>([^\n]*)\n(.*?)<\|end\|>", regex.S)
BLOCK = 64               # turn numbers whose replies are expanded together
PIECE = 1 << 20          # characters of context that close a piece of it


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return regex.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and the span of its text inside it."""
    head = f"{OPEN}{escape_role(role)}\n"
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted string."""
    return [(unescape_role(r), unescape(t)) for r, t in _PARSE.findall(formatted)]


_EXAMPLE = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("seq", pa.int64()), ("piece", pa.int64()),
                      ("context", pa.string()), ("reply", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()),
                      ("whole", pa.bool_())])


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """Examples (conv_id, block, seq, piece, context, reply, loss_start, loss_end, whole): one for each assistant turn,
    numbered by (block, seq) in the order of the turns.

    The ``context`` of an example is every turn of its conversation before the reply, formatted. One of more than
    ``piece`` characters is cut between turns into rows numbered by ``piece``; the last of them has the ``reply``, a
    formatted assistant turn, and [loss_start, loss_end), its trainable characters. A conversation that does not end
    with a reply ends with an example without one (null). ``whole`` marks the rows of a conversation's last example:
    context and reply are the whole conversation. Turns are ordered by number (null first), then role and text, so ties
    and repeated rows have a fixed order; null roles and texts are empty; a null conversation id is a conversation of
    its own. A long conversation is expanded by many tasks, one a block; each holds the formatted turns before it.
    """
    t = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                     F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                     F.floor(F.coalesce(F.col(turn_col).cast("long"), F.lit(-(1 << 62))) / BLOCK).alias("block"))
    blocks = t.groupBy("conv_id", "block").agg(F.max(F.col("role") == "assistant").alias("replies"))
    last = F.max("block").over(W.partitionBy("conv_id")) == F.col("block")
    asking = (blocks.withColumn("last", last).where("replies OR last")
              .select(F.col("conv_id").alias("conv"), F.col("block").alias("to"), "last"))
    pairs = (blocks.join(asking, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("block") <= F.col("to")))
             .select("conv", F.col("block").alias("of"), "to", "last"))
    met = (t.join(pairs, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("block") == F.col("of")))
           .repartition("conv_id", "to").sortWithinPartitions("conv_id", "to", "block", "turn", "role", "text")
           .select("conv_id", "to", F.expr("block = to").alias("own"), "last", "role", "text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, seq, pieces, tail, size = None, 0, [], [], 0
        turns_in = chain.from_iterable(zip(*(b.column(i).to_pylist() for i in range(6))) for b in batches)
        for one, after in pairwise(chain(turns_in, [None])):
            key, (own, last, role, text) = one[:2], one[2:]
            if key != now:
                now, seq, pieces, tail, size = key, 0, [], [], 0
            turn, lo, hi = format_turn(role, text)
            replies, ends = role == "assistant", last and (after is None or after[:2] != key)
            if not replies:
                tail.append(turn)
            if own and (replies or ends):
                tail = ["".join(tail)]
                for i, p in enumerate(pieces):
                    yield *now, seq, i, p, None, None, None, ends
                yield *now, seq, len(pieces), tail[0], *((turn, lo, hi) if replies else (None, None, None)), ends
                seq += 1
            if replies:
                tail.append(turn)
            size += len(turn)
            if size >= piece:
                pieces.append("".join(tail))
                tail, size = [], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for r in chain(rows(batches), [None]):
            if r is not None:
                held.append(r)
                size += 100 + len(r[4]) + len(r[5] or "")
            if held and (r is None or size >= PIECE):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _EXAMPLE)], schema=_EXAMPLE)
                held, size = [], 0

    return met.mapInArrow(run, "conv_id long, block long, seq long, piece long, context string, reply string, "
                               "loss_start long, loss_end long, whole boolean")


def example_texts(examples: DataFrame) -> DataFrame:
    """(conv_id, block, seq, prompt, reply): each example with the pieces of its context put together."""
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("piece", "context"))), lambda x: x["context"])
    return (examples.groupBy("conv_id", "block", "seq").agg(F.array_join(pieces, "").alias("prompt"), F.max("reply").alias("reply"))
            .where(F.col("reply").isNotNull()))


def digest(examples: DataFrame) -> DataFrame:
    """One row per conversation, read back from the formatted output: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars. The turns are those of its last example, whose context and reply
    are the whole conversation, the loss is that of the replies of all examples. A digest is sequential, so these
    rows are streamed, sorted, through one task with a running hash; nothing of them is held."""
    rows = (examples.where("whole OR reply IS NOT NULL").withColumn("context", F.expr("IF(whole, context, NULL)"))
            .repartition("conv_id").sortWithinPartitions("conv_id", "block", "seq", "piece"))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, started = None, None, False

        def close() -> tuple:
            n, th, lc, lh, fc = state
            return key, n, th.hexdigest(), lc, lh.hexdigest(), fc

        for b in batches:
            out = []
            for conv, context, reply, lo, hi, whole in zip(*(b.column(i).to_pylist() for i in range(6))):
                if not started or conv != key:
                    if started:
                        out.append(close())
                    key, started = conv, True
                    state = [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                if whole:
                    for role, text in parse(context) + parse(reply or ""):
                        state[0] += 1
                        state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    state[4] += len(context) + len(reply or "")
                if reply is not None:
                    loss = unescape(reply[lo:hi])
                    state[2] += len(loss)
                    state[3].update(loss.encode("utf-8", "surrogatepass"))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(close(), kinds)], names=names)

    return (rows.select("conv_id", "context", "reply", "loss_start", "loss_end", "whole")
            .mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                             "loss_sha256 string, formatted_chars long"))


def op8(spark, sf_dir):
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{planted}'), (-7L, 1L, 'assistant', '{planted}') "
                      "AS t(conv_id, turn, role, text)")
    return digest(format_conversations(turns.unionByName(extra)))
