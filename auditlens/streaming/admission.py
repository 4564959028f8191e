"""Containment admission: at most `cap` per tenant and trailing window, in order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from auditlens import constants as K
from auditlens.operators.admission import LOG, Slots

OUTPUT = f"{LOG}, late boolean"
STATE = "admitted array<bigint>, newest bigint"
COLUMNS = ["tenant", "event_id", "time_us", "admitted", "room", "late"]
#: Rows that are Python objects or a frame at a time.
AT_ONCE = 50_000


def admit(
    confirmations: DataFrame,
    cap: int = K.CONTAINMENT_CAP,
    window_seconds: int = K.CONTAINMENT_WINDOW_SECONDS,
    late_seconds: int = K.CONFIRMATION_LATENESS_SECONDS,
) -> DataFrame:
    """Adds whether each confirmation (tenant, event_id, time_us) takes a slot.

    Only admitted ones take room, so the decision depends on order and is made per tenant.
    A micro-batch is ordered by time and id; its size is what bounds a task's memory (some 50
    bytes a confirmation of a tenant), so set maxFilesPerTrigger on the source. A confirmation that arrives in a later
    micro-batch than newer ones is admitted if every window it falls into keeps the cap,
    the ones that end after it too. One older than the newest by more than late_seconds is
    refused and marked late: the admissions around it may be forgotten. The state is the
    admissions of the last late_seconds and one window.
    """
    window_us, late_us = window_seconds * 1_000_000, late_seconds * 1_000_000

    def decide(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        taken, newest = state.get if state.exists else ((), None)
        slots = Slots(taken, cap, window_us)
        parts = [(b.event_id.to_numpy(copy=True), b.time_us.to_numpy(copy=True)) for b in batches]
        ids, times = (np.concatenate(column) for column in zip(*parts, strict=True))
        del parts
        order = np.lexsort((ids, times))
        ids, times = ids[order], times[order]
        del order
        n = len(times)
        admitted, late, room = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, "int32")
        for start in range(0, n, AT_ONCE):
            for i, now in enumerate(times[start : start + AT_ONCE].tolist(), start):
                if newest is not None and now < newest - late_us:
                    late[i] = True
                else:
                    admitted[i], room[i] = slots.offer(now)
        newest = max(int(times[-1]), newest if newest is not None else 0)
        slots.forget(newest - late_us - window_us)
        state.update((slots.taken, newest))
        for start in range(0, n, AT_ONCE):
            run = slice(start, start + AT_ONCE)
            yield pd.DataFrame(
                {
                    "event_id": ids[run], "time_us": times[run], "admitted": admitted[run],
                    "room": room[run], "late": late[run],
                }
            ).assign(tenant=key[0])[COLUMNS]

    return confirmations.groupBy("tenant").applyInPandasWithState(
        decide, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout
    )
