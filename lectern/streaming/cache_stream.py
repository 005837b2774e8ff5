"""ST2: TTL response cache over a request stream.

State per key = the time of the stored answer (the last miss). Within a micro-batch a
key's events are folded in (time, id) order: hit iff ``t < stored + ttl``; a miss stores.
No event is dropped: there is no watermark, and an event older than the stored answer is
returned as a miss of its own with ``late`` set, without moving the state. With
``keep_seconds`` a key's state expires by processing time, that long after its last event;
a job over a bounded source needs no expiry (and would never end with it). Equal to the batch replay (``lectern.operators.cache.replay``) when
events arrive in time order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "event_id long, key string, hit boolean, stored_at_us long, late boolean"
STATE = "stored_us long"


class TtlCache(StatefulProcessor):
    """One key: the time of its stored answer, held as a value with an expiry of its own."""

    def __init__(self, ttl_us: int, keep_ms: int | None) -> None:
        self.ttl_us, self.keep_ms = ttl_us, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getValueState("stored", STATE, self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = list(rows)                      # two numbers an event
        ids = np.concatenate([p["event_id"].to_numpy(np.int64) for p in parts])
        t = np.concatenate([p["t_us"].to_numpy(np.int64) for p in parts])
        order = np.lexsort((ids, t))
        ids, t = ids[order], t[order]
        held = self.stored.get()
        anchor = None if held is None else held[0]
        late = np.zeros(len(t), bool) if anchor is None else t < anchor
        hit, stored = np.zeros(len(t), bool), t.copy()
        i = int(late.sum())
        while i < len(t):                       # from miss to miss
            if anchor is None or t[i] >= anchor + self.ttl_us:
                anchor = int(t[i])
                stored[i] = anchor
                i += 1
            j = int(np.searchsorted(t, anchor + self.ttl_us, side="left"))
            hit[i:j] = True
            stored[i:j] = anchor
            i = max(i, j)
        self.stored.update((anchor,))
        yield pd.DataFrame({"event_id": ids, "key": key[0], "hit": hit, "stored_at_us": stored, "late": late})

    def close(self) -> None:
        pass


def cache_stream(requests: DataFrame, ttl_seconds: int, keep_seconds: int | None = None) -> DataFrame:
    """``requests(event_id, key, ts)`` stream -> ``event_id, key, hit, stored_at_us, late``. ``keep_seconds``
    (at least the TTL; None: for ever) is how long a silent key's state is held."""
    r = requests.select("event_id", "key", F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"))
    return r.groupBy("key").transformWithStateInPandas(
        TtlCache(int(ttl_seconds) * 1_000_000, None if keep_seconds is None else keep_seconds * 1000), OUT, "Append",
        "None" if keep_seconds is None else "ProcessingTime")
