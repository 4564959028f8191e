"""Suppression with a late output against a plain loop over deliveries."""

import datetime
import random

from pyspark.sql import functions as F

from auditlens.plans import io
from auditlens.streaming import suppression

SCHEMA = "event_id long, event_time timestamp_ntz, owner string, extra int"
START = datetime.datetime(2024, 1, 1)
LOOK_BACK = 30


def _plain(batches):
    """(batch, id, minute, outcome) of every delivery, one at a time."""
    known, high, out = {}, None, []
    for number, rows in enumerate(batches):
        bound = None if high is None else high - LOOK_BACK
        known = {i: m for i, m in known.items() if m is not None and m >= (bound or 0)}
        for i, minute in rows:
            if bound is not None and minute is not None and minute < bound:
                outcome = "late"
            elif i is not None and i in known:
                outcome = "duplicate"
            else:
                outcome = "scored"
                if i is not None:
                    known[i] = minute
            out.append((number, i, outcome))
        times = [m for _, m in rows if m is not None]
        high = max([*times, *([high] if high is not None else [])], default=None)
    return out


def _stored(spark, path, rows):
    found = suppression.deliveries(spark, path, rows)
    counted = found.groupBy("batch", "event_id", "outcome").agg(F.sum("deliveries").alias("n"))
    return {(r.batch, r.event_id, r.outcome): r.n for r in counted.collect()}


def _frame(spark, rows):
    at = lambda m: None if m is None else START + datetime.timedelta(minutes=m)
    return spark.createDataFrame([(i, at(m), "x", None) for i, m in rows], SCHEMA)


def test_every_delivery_has_an_outcome(spark, tmp_path):
    """Ids keep their time; some rows have no id or time, one batch is empty, one runs twice."""
    pick = random.Random(4)
    minutes = {i: pick.randint(0, 240) for i in range(120)}
    minutes[7] = None
    batches = []
    for number in range(5):
        rows = [
            (i, minutes[i]) for i in minutes
            if minutes[i] is None or abs(minutes[i] - 60 * number) < 80
            for _ in range(pick.randint(0, 3))
        ]
        batches.append([*rows, (None, 60 * number), (None, None), *[(3, minutes[3])] * 500])
    batches.insert(2, [])
    path = str(tmp_path / "settled")
    for number, rows in enumerate(batches):
        frame = _frame(spark, rows)
        for _ in range(2 if number == 3 else 1):
            suppression.settle(frame, path, number, LOOK_BACK)
    want = {}
    for key in _plain(batches):
        want[key] = want.get(key, 0) + 1
    assert _stored(spark, path, frame) == want
    assert {k[2] for k in want} == {"scored", "duplicate", "late"}
    kept = suppression.deliveries(spark, path, frame)
    assert sum(map(len, batches)) == kept.agg(F.sum("deliveries")).first()[0]


def test_only_batches_inside_the_look_back_are_read(spark, tmp_path):
    path = str(tmp_path / "settled")
    for number in range(4):
        suppression.settle(_frame(spark, [(number, 100 * number)]), path, number, LOOK_BACK)
    live = [[b.batch for b in suppression._before(spark, path, n)] for n in range(5)]
    assert live == [[], [0], [0, 1], [1, 2], [2, 3]]


def test_streams_lose_no_delivery(spark, sf_dir):
    rows = io.stream_late(spark, sf_dir).groupBy("outcome").agg(F.sum("deliveries")).collect()
    n = {r[0]: r[1] for r in rows}
    ids = [r[0] for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id").collect()]
    assert set(n) == {"scored", "duplicate", "late"}
    assert sum(n.values()) == len(ids) + sum(i % 5 == 0 for i in ids) + sum(i % 7 == 0 for i in ids)
