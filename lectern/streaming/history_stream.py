"""ST3: rolling conversation memory per session.

State per conversation = a list of its last ``n`` messages; with ``keep_seconds`` it is dropped
when the conversation has been silent for so long (processing time). Each user message is emitted with the messages before it, oldest
first: the streaming twin of ``lectern.operators.history.previous_messages``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lectern.functions.dialog import DEFAULT_TEXTS, PromptTexts

OUT = "conv_id long, turn long, n_hist long, history_text string"
STATE = "role string, text string"


class History(StatefulProcessor):
    """One conversation: a list of its last messages, cleared by a timer when it has been silent for long."""

    def __init__(self, n: int, keep_ms: int | None, texts: PromptTexts) -> None:
        self.n, self.keep_ms, self.texts = n, keep_ms, texts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getListState("last", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["turn", "role", "text"], kind="stable")
        last = deque(self.last.get(), self.n)
        out = []
        for turn, role, text in zip(pdf["turn"], pdf["role"], pdf["text"]):
            if role == "user":
                lines = (f"{self.texts.user if r == 'user' else self.texts.other}: {c}" for r, c in last)
                out.append((key[0], int(turn), len(last), "\n".join(lines)))
            last.append((role, text))
        self.last.put(list(last))
        if self.keep_ms is not None:
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep_ms)
        yield pd.DataFrame(out, columns=["conv_id", "turn", "n_hist", "history_text"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame([], columns=["conv_id", "turn", "n_hist", "history_text"])

    def close(self) -> None:
        pass


def history_stream(messages: DataFrame, n: int = 5, keep_seconds: int | None = None,
                   texts: PromptTexts = DEFAULT_TEXTS) -> DataFrame:
    """``messages(conv_id, turn, role, text)`` stream -> history of each user message."""
    return messages.select("conv_id", "turn", "role", "text").groupBy("conv_id").transformWithStateInPandas(
        History(n, None if keep_seconds is None else keep_seconds * 1000, texts), OUT, "Append",
        "None" if keep_seconds is None else "ProcessingTime")
