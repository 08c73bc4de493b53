"""Decaying sums over streams: (key, t, la, v, is_end) rows to (key, t, doc, y)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key bigint, t bigint, doc bigint, y double, late bigint"
STATE = "t bigint, doc bigint, s double, ended boolean, late bigint"


def advance(rows: pd.DataFrame, state: tuple) -> tuple[pd.DataFrame, tuple]:
    """Sorted rows of one key folded into its state; used by the stream and, from an empty state, for a batch."""
    last, doc, s, ended, late = state
    out = []
    for t, la, v, is_end in rows.sort_values("t")[["t", "la", "v", "is_end"]].itertuples(index=False):
        if t <= last:
            late += 1
            continue
        doc, s = (doc + 1, 0.0) if ended else (doc, s)
        s = math.exp(la) * s + v
        last, ended = int(t), bool(is_end)
        out.append((last, doc, s))
    return pd.DataFrame(out, columns=["t", "doc", "y"]).assign(late=late), (last, doc, s, ended, late)


EMPTY = (-1, 0, 0.0, False, 0)


def decayed_stream(rows: DataFrame) -> DataFrame:
    """Streaming form of ``operators.segments.segmented`` and ``operators.decay.blocked``; late counts rows dropped so far."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else EMPTY
        out, now = advance(pd.concat(list(frames)), now)
        state.update(now)
        yield out.assign(key=key[0])[["key", "t", "doc", "y", "late"]]

    return rows.groupBy("key").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
