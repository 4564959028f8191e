"""Which confirmations become containments: at most `cap` in any trailing window."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlens import constants as K

LOG = "tenant string, event_id bigint, time_us bigint, admitted boolean, room int"


class Slots:
    """The admissions of one tenant that later decisions can still depend on."""

    def __init__(self, taken: Iterable[int], cap: int, window_us: int):
        self.taken, self.cap, self.window = sorted(taken), cap, window_us

    def offer(self, now: int) -> tuple[bool, int]:
        """(admitted, room before it). All windows that `now` falls into keep the cap.

        That includes windows that end later, so a late confirmation cannot push a
        newer admission over the cap.
        """
        first = bisect_left(self.taken, now - self.window)
        here = bisect_right(self.taken, now)
        near = self.taken[first : bisect_right(self.taken, now + self.window)]
        near.insert(here - first, now)
        fits = all(
            b - a > self.window for a, b in zip(near, near[self.cap :], strict=False)
        )
        if fits:
            insort(self.taken, now)
        return fits, self.cap - (here - first) if fits else 0

    def forget(self, before: int) -> None:
        del self.taken[: bisect_left(self.taken, before)]


def containment_log(
    confirmations: DataFrame,
    cap: int = K.CONTAINMENT_CAP,
    window_seconds: int = K.CONTAINMENT_WINDOW_SECONDS,
) -> DataFrame:
    """Decides all confirmations (tenant, event_id, time_us) in the order of their time.

    A decision depends on the admissions of one window before it, so a tenant's time line
    falls apart wherever a whole window has no confirmation; each such part is decided by
    itself. Only a tenant that is busy without a pause is one part. Rows without a tenant are
    left out.
    """
    window_us = window_seconds * 1_000_000
    number = F.floor(F.col("time_us") / window_us)
    sliced = confirmations.select("tenant", "event_id", "time_us", number.alias("_slice"))
    order = Window.partitionBy("tenant").orderBy("_slice")
    parts = (
        sliced.select("tenant", "_slice")
        .distinct()
        .withColumn("_part", F.col("_slice") - F.row_number().over(order))
    )

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, slots = None, Slots((), cap, window_us)
        for rows in batches:
            decided = []
            for tenant, number, now in zip(rows.tenant, rows["_part"], rows.time_us, strict=True):
                if (tenant, number) != part:
                    part, slots = (tenant, number), Slots((), cap, window_us)
                decided.append(slots.offer(now))
                slots.forget(now - window_us)
            admitted, room = zip(*decided, strict=True) if decided else ((), ())
            yield rows[["tenant", "event_id", "time_us"]].assign(
                admitted=np.array(admitted, bool), room=np.array(room, "int32")
            )

    # A task reads its parts one after the other as a stream and holds one window of each.
    return (
        sliced.join(parts, ["tenant", "_slice"])
        .select("tenant", "_part", "event_id", "time_us")
        .repartition("tenant", "_part")
        .sortWithinPartitions("tenant", "_part", "time_us", "event_id")
        .mapInPandas(decide, LOG)
    )


def with_room(
    rows: DataFrame,
    log: DataFrame,
    at_us: str = "time_us",
    include_current: bool = False,
    cap: int = K.CONTAINMENT_CAP,
    window_seconds: int = K.CONTAINMENT_WINDOW_SECONDS,
) -> DataFrame:
    """Adds the admitted containments in the window before at_us, and the room they leave.

    The log holds at most `cap` containments in any window, so a tenant's containments of
    two windows are a short list, and rows look their list up by tenant and window.
    """
    window_us = window_seconds * 1_000_000
    lists = (
        log.filter("admitted")
        .select(
            "tenant",
            "time_us",
            F.explode(
                F.array(*(F.floor(F.col("time_us") / window_us) + n for n in (0, 1)))
            ).alias("_slice"),
        )
        .groupBy("tenant", "_slice")
        .agg(F.collect_list("time_us").alias("_times"))
    )
    now = F.col(at_us)
    inside = F.filter(
        "_times",
        lambda t: (t >= now - window_us) & ((t <= now) if include_current else (t < now)),
    )
    count = F.coalesce(F.size(inside), F.lit(0)).cast("bigint")
    return (
        rows.withColumn("_slice", F.floor(now / window_us))
        .join(lists, ["tenant", "_slice"], "left")
        .withColumn("recent_containments", F.when(F.col("_times").isNull(), 0).otherwise(count))
        .withColumn(
            "room", F.greatest(F.lit(0), F.lit(cap) - F.col("recent_containments")).cast("bigint")
        )
        .drop("_slice", "_times")
    )
