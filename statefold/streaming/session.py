"""Chat sessions over streams: one conversation's model state is a key's state, whatever its length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.generate import Session
from ..plans.model import Model

OUT = "conv_id bigint, turn bigint, n_seen bigint, best bigint, reply array<bigint>, late bigint"
STATE = "turn bigint, n_seen bigint, late bigint, session binary"


def session_stream(turns: DataFrame, weights: dict[str, np.ndarray], answer: int = 0, new_each_turn: bool = False, **options) -> DataFrame:
    """(conv_id, turn, ids[, session]) to one row for each turn: tokens seen, the best next token, a greedy reply of up to
    ``answer`` tokens, which is written to the state (a stop is not), and how many turns came late so far.

    new_each_turn forgets the conversation before every turn. A row with a ``session``, as ``Session.snapshot`` gives it after
    a batch, goes on from that state. A turn that is not after the last one, or has no ids, is late: counted, not read.
    """
    shared = turns.sparkSession.sparkContext.broadcast(weights)
    seeded = "session" in turns.columns
    columns = ["turn", "ids"] + ["session"] * seeded

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        model = Model(shared.value, **options)
        last_turn, seen, late, raw = tuple(state.get) if state.exists else (-1, 0, 0, None)
        session = Session.restore(model, bytes(raw)) if raw else Session(model)
        out = []
        for turn, ids, *given in pd.concat([f[columns] for f in frames]).sort_values("turn").itertuples(index=False):
            ids = [] if ids is None else ids
            if turn <= last_turn or not (len(ids) or (given and given[0])):
                late += 1
                continue
            if given and given[0]:
                session = Session.restore(model, bytes(given[0]))
            elif new_each_turn:
                session, seen = Session(model), 0
            if len(ids):
                session.feed(ids)
            best = int(session.scores.argmax())
            reply = session.generate(answer) if answer else []
            last_turn, seen = int(turn), seen + len(ids) + len(reply)
            out.append((key[0], last_turn, seen, best, reply, late))
        state.update((last_turn, seen, late, session.snapshot() if session.states is not None else None))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "n_seen", "best", "reply", "late"])

    return turns.groupBy("conv_id").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
