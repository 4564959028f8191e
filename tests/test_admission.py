"""Containment admission against brute force, in order and late."""

import random

import pandas as pd
import pytest

from auditlens.operators.admission import Slots, containment_log, with_room
from auditlens.streaming import admission as streamed

SECOND = 1_000_000


def most_in_a_window(times, window):
    return max((sum(t <= x <= t + window for x in times) for t in times), default=0)


def test_a_late_confirmation_does_not_open_newer_windows():
    slots = Slots((), 5, 600)
    times = [1000, 1010, 1020, 1030, 1040, 300, 1050, 1060, 1070, 1080]
    admitted = [t for t in times if slots.offer(t)[0]]
    assert admitted == [1000, 1010, 1020, 1030, 1040, 300]
    assert most_in_a_window(admitted, 600) == 5


@pytest.mark.parametrize("seed", range(5))
def test_any_order_keeps_the_cap(seed):
    rng = random.Random(seed)
    slots, admitted = Slots((), 3, 50), []
    for _ in range(300):
        now = rng.randrange(0, 2000)
        fits, room = slots.offer(now)
        could = most_in_a_window([*admitted, now], 50) <= 3
        assert fits == could
        if fits:
            admitted.append(now)
            assert room == 3 - sum(now - 50 <= t <= now for t in admitted[:-1])
    assert slots.taken == sorted(admitted)


def test_the_log_equals_one_pass(spark):
    rng = random.Random(1)
    rows = []
    for tenant in "ab":
        now = 0
        for n in range(400):
            now += rng.choice((0, 1, 30, 200, 700, 5000)) * SECOND
            rows.append((tenant, n if tenant == "a" else 1000 + n, now))
    expected = {}
    for tenant in "ab":
        taken = []
        for _, event, now in sorted((r for r in rows if r[0] == tenant), key=lambda r: (r[2], r[1])):
            recent = [t for t in taken if t >= now - 600 * SECOND]
            expected[event] = (len(recent) < 5, 5 - len(recent))
            taken = [*recent, now] if len(recent) < 5 else recent
    frame = spark.createDataFrame(rows, "tenant string, event_id long, time_us long")
    log = containment_log(frame.repartition(7))
    assert {r.event_id: (r.admitted, r.room) for r in log.collect()} == expected
    for current in (False, True):
        for row in with_room(frame, log, include_current=current).collect():
            count = sum(
                t == row.tenant and expected[e][0]
                and row.time_us - 600 * SECOND <= x <= row.time_us - (not current)
                for t, e, x in rows
            )
            assert (row.recent_containments, row.room) == (count, max(0, 5 - count))
    assert containment_log(frame.filter("false")).count() == 0


def test_late_rows_of_a_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from auditlens.streaming.admission import admit

    batches = [[10_000 + 10 * n for n in range(5)], [9_300], [10_050, 10_060, 5_000], [10_641]]
    event = iter(range(100))
    target, found = tmp_path / "in", []
    schema = "tenant string, event_id long, time_us long"
    target.mkdir()

    def keep(frame, _):
        found.extend(frame.collect())

    for batch in batches:
        rows = [("t", next(event), t * SECOND) for t in batch]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(target))
        query = (
            admit(spark.readStream.schema(schema).parquet(str(target)))
            .withColumn("s", (F.col("time_us") / SECOND).cast("int"))
            .writeStream.foreachBatch(keep)
            .option("checkpointLocation", str(tmp_path / "state"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    assert [r.s for r in found if r.admitted] == [*batches[0], 9_300, 10_641]
    assert [r.s for r in found if r.late] == [5_000]


def test_a_large_micro_batch_is_decided_and_handed_on_in_pieces(monkeypatch):
    """A tenant's confirmations are numbers in arrays; frames have a bounded number of rows."""
    monkeypatch.setattr(streamed, "AT_ONCE", 7)

    class Frame:
        def groupBy(self, key):
            return self

        def applyInPandasWithState(self, decide, *rest):
            return decide

    class State:
        exists, kept = False, None

        def update(self, kept):
            self.kept, self.exists, self.get = kept, True, kept

    rng = random.Random(3)
    rows = [(n, rng.randrange(0, 40_000) * SECOND) for n in range(60)]
    frame = pd.DataFrame(rows, columns=["event_id", "time_us"]).assign(tenant="a")
    state, decide = State(), streamed.admit(Frame())
    out = [*decide(("a",), iter([frame[:25], frame[25:]]), state)]
    assert max(map(len, out)) <= 7
    got = pd.concat(out)
    assert [*got.columns] == streamed.COLUMNS and not got.late.any()
    slots, want = Slots((), 5, 600 * SECOND), []
    for event, now in sorted(rows, key=lambda r: (r[1], r[0])):
        want.append((event, now, *slots.offer(now)))
    found = got[["event_id", "time_us", "admitted", "room"]]
    assert [tuple(r) for r in found.to_numpy().tolist()] == want
    newest = max(now for _, now in rows)
    assert state.kept[1] == newest
    again = pd.concat(decide(("a",), iter([frame[:3].assign(time_us=[0, newest, newest])]), state))
    assert again.late.tolist() == [True, False, False]
