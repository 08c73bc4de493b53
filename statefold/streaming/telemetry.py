"""Energy over streams: the last sample of each device is the state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.telemetry import POWER_CAP, THERMAL

OUT = "device string, samples bigint, covered_s double, gap_s double, joules double, thermal_s double, capped_s double"
STATE = "t double, watts double, reasons bigint, seen boolean"


def energy_stream(samples: DataFrame, max_gap: float = 5.0) -> DataFrame:
    """(device, t seconds, watts, reasons) to what each micro-batch adds: sums over batches are the batch summary's."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t, watts, reasons, seen = tuple(state.get) if state.exists else (0.0, float("nan"), 0, False)
        n, covered, gap, joules, thermal, capped = 0, 0.0, 0.0, 0.0, 0.0, 0.0
        for t2, w2, r2 in pd.concat(list(frames)).sort_values("t")[["t", "watts", "reasons"]].itertuples(index=False):
            n += 1
            r2 = 0 if pd.isna(r2) else int(r2)
            dt = t2 - t if seen else 0.0
            if dt > 0 and (dt > max_gap or pd.isna(watts) or pd.isna(w2)):
                gap += dt
            elif dt > 0:
                covered, joules = covered + dt, joules + 0.5 * (watts + w2) * dt
                thermal += dt if reasons & THERMAL else 0.0
                capped += dt if reasons & POWER_CAP else 0.0
            t, watts, reasons, seen = t2, w2, r2, True
        state.update((float(t), float(watts), int(reasons), True))
        yield pd.DataFrame([(key[0], n, covered, gap, joules, thermal, capped)], columns=[c.split()[0] for c in OUT.split(", ")])

    return samples.groupBy("device").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
