"""Runs as a stream with state, against a loop, over batches in any order, and after a restart."""

from __future__ import annotations

import datetime as dt
import random

from tessera.streaming.events import LEGAL
from tessera.streaming.runs import IDLE, run_stream

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
SCHEMA = "key string, ts timestamp, event_id bigint, status string"
MINUTE = 60_000_000
FINAL = 400


def micros(ts):
    return (ts - START) // dt.timedelta(microseconds=1) + int(START.timestamp()) * 1_000_000


def by_loop(events):
    """Runs that are over ten minutes before the newest event."""
    end, out, keys = max(micros(e[1]) for e in events) - 10 * MINUTE, [], {}
    for key, ts, _, status in sorted(events, key=lambda e: (e[1], e[2])):
        at, run = micros(ts), keys.get(key)
        if run and at - run["last"] >= IDLE:
            out.append((key, run))
            run = None
        if run is None:
            run = keys[key] = {"opened": at, "status": None, "n": 0, "rejected": 0}
        moves = status is not None and (run["status"] is None or status in LEGAL.get(run["status"], ()))
        run.update(last=at, status=status if moves else run["status"], n=run["n"] + 1, rejected=run["rejected"] + (not moves))
    out += keys.items()
    return sorted((k, r["opened"], r["last"] + IDLE, r["status"] or "", r["n"], r["rejected"]) for k, r in out if r["last"] + IDLE <= end)


def made(seed):
    r = random.Random(seed)
    at = sorted(r.randint(0, 24 * 60) for _ in range(FINAL))
    events = [(r.choice("aaab") if r.random() < 0.6 else f"k{r.randint(0, 9)}", START + dt.timedelta(minutes=m, microseconds=r.choice([0, 0, 7])), i, r.choice([*LEGAL, None])) for i, m in enumerate(at)]
    return [(key, ts, i, status) for i, (key, ts, _, status) in enumerate(events)]


def shuffled_within(events, minutes, seed):
    r = random.Random(seed)
    return sorted(events, key=lambda e: e[1] + dt.timedelta(minutes=r.random() * minutes))


def collected(spark, folder, batches, rounds):
    """Batches of files, `rounds` of them before each start of the stream."""
    rows, done = None, 0
    for n in rounds:
        for b in batches[done : done + n]:
            spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        done += n
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        rows = run_stream(spark, stream, f"{folder}/work").collect()
    return sorted((x.key, x.opened, x.closed, x.status or "", x.n, x.rejected) for x in rows)


def test_one_batch_and_a_restart_with_events_out_of_order(spark, tmp_path):
    events = made(1)
    want = by_loop(events)
    assert len(want) > 20 and any(r[5] for r in want) and any(r[4] > 5 for r in want)
    assert collected(spark, tmp_path / "one", [events], [1]) == want
    mixed = shuffled_within(events, 9, 2)
    batches = [mixed[k : k + FINAL // 5] for k in range(0, FINAL, FINAL // 5)]
    assert collected(spark, tmp_path / "five", batches, [3, 2]) == want


def test_rows_of_no_run_and_no_rows(spark, tmp_path):
    t = lambda m: START + dt.timedelta(minutes=m)
    events = [("a", t(0), 1, None), ("a", t(0), 1, None), ("a", t(1), 2, "view"), ("a", t(61), 3, "view"), ("b", t(600), 4, "error")]
    none = [(None, t(2), 5, "view"), ("a", None, 6, "view")]
    got = collected(spark, tmp_path / "rows", [events + none], [1])
    assert got == by_loop(events) == [("a", micros(t(0)), micros(t(61)), "view", 3, 2), ("a", micros(t(61)), micros(t(121)), "view", 1, 0)]
    assert collected(spark, tmp_path / "none", [[]], [1]) == []
