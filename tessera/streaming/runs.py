"""Runs as a stream with state: a status machine for each key that rejects illegal moves, and a timer that closes idle runs.

The state of a key is one row (when its run was opened, its last event, its status and two counters) and the events that
wait, held in the state store and restored from the checkpoint after a lost executor or a restart. An event waits until the watermark
has passed it, when none before it can come any more; so events are taken in the order of (ts, event_id) and the rows do not
depend on how they fall into batches or in which order they come, as long as none is later than the watermark
allows (Spark drops those). A run is closed by an event-time timer once the watermark has passed its last event by IDLE; the next event
opens another.

An event does not move a run if its status may not follow the run's; it is counted as rejected, and the run stays open. A
null status is a move to nothing and always rejected; a null time or key belongs to no run and is left out; of two events of one time
the smaller id comes first, one without id before them; repeated events count each. One key's events of one batch and of the time that the watermark waits
are sorted in one task: `maxFilesPerTrigger` bounds them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

from tessera.plans.query import registry
from tessera.sources.checkpoints import ensure_folder
from tessera.sources.tables import table
from tessera.streaming.events import LATE, LEGAL, stream_to_parquet

QUERIES, ORACLE_SQL, query = registry()

#: Microseconds without an event after which a run is closed.
IDLE = 3_600_000_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLOSED = "key string, opened bigint, closed bigint, status string, n bigint, rejected bigint"
#: The state of a key in one value, as every call to the store costs more than its rows: the run (null: none), what waits, and the time (milliseconds) of the timer.
STATE = "opened bigint, last bigint, status string, n bigint, rejected bigint, ats array<bigint>, ids array<bigint>, statuses array<string>, due bigint"


def stepped(run: tuple | None, at: int, status: str | None, legal: dict[str, list[str]]) -> tuple:
    """The run (opened, last, status, n, rejected) after an event; None is no run yet."""
    if run is None:
        return (at, at, status, 1, 0) if status is not None else (at, at, None, 1, 1)
    opened, _, now, n, rejected = run
    moves = status is not None and (now is None or status in legal.get(now, ()))
    return (opened, at, status if moves else now, n + 1, rejected + (not moves))


class Machine(StatefulProcessor):
    """Closed runs of one key."""

    def __init__(self, legal: dict[str, list[str]], idle: int) -> None:
        self.legal, self.idle = legal, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)

    def advanced(self, key: tuple, fresh: list[tuple], watermark: int, expired: bool = False) -> Iterator:
        """Take what the watermark (milliseconds) has passed, close the run if it is over, and wait for the next time at which something is due."""
        import pandas as pd

        now, out = watermark * 1000, []
        held = self.state.get()
        run = tuple(held[:5]) if held is not None and held[0] is not None else None
        waiting = zip(*held[5:8], strict=True) if held is not None else ()
        before = held[8] if held is not None and not expired else None
        events = sorted([*waiting, *fresh], key=lambda e: (e[0], e[1] is not None, e[1] or 0))
        passed = sum(e[0] <= now for e in events)
        for at, _, status in [*events[:passed], (now, None, None)]:
            if run is not None and at - run[1] >= self.idle:
                opened, last, kept, n, rejected = run
                out.append((key[0], opened, last + self.idle, kept, n, rejected))
                run = None
            if passed > 0:
                run, passed = stepped(run, at, status, self.legal), passed - 1
        events = [e for e in events if e[0] > now]
        times = [e[0] for e in events[:1]] + ([run[1] + self.idle] if run is not None else [])
        due = -(-min(times) // 1000) if times else None
        if before is not None and before != due:
            self.handle.deleteTimer(before)
        if due is not None and before != due:
            self.handle.registerTimer(due)
        if times:
            self.state.update((*(run or (None,) * 5), *([e[c] for e in events] for c in range(3)), due))
        elif held is not None:
            self.state.clear()
        if out:
            yield pd.DataFrame(out, columns=["key", "opened", "closed", "status", "n", "rejected"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        fresh: list[tuple] = []
        for piece in rows:
            at, ids, statuses = (piece[c].astype(object).where(piece[c].notna(), None) for c in ("at", "event_id", "status"))
            fresh += [(int(a), None if i is None else int(i), s) for a, i, s in zip(at, ids, statuses, strict=True)]
        yield from self.advanced(key, fresh, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803
        yield from self.advanced(key, [], timerValues.getCurrentWatermarkInMs(), expired=True)

    def close(self) -> None:
        pass


def closed_runs(events: DataFrame, legal: dict[str, list[str]] = LEGAL, idle: int = IDLE, late: str = LATE) -> DataFrame:
    """(key, opened, closed, status, n, rejected), times in microseconds, of a stream (key string, ts timestamp, event_id, status); needs the state store STORE."""
    timed = events.filter("key is not null and ts is not null").select("key", "ts", "event_id", "status", F.unix_micros("ts").alias("at")).withWatermark("ts", late)
    return timed.groupBy("key").transformWithStateInPandas(Machine(legal, idle), CLOSED, "Append", "EventTime")


def run_stream(spark: SparkSession, events: DataFrame, folder: str) -> DataFrame:
    """The runs closed so far, by everything that the stream has now; going on with the same folder takes only what is new."""
    name, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, STORE)
    try:
        stream_to_parquet(closed_runs(events), folder)
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(CLOSED).parquet(f"{folder}/out")


_LEGAL_SQL = ", ".join(f"('{a}', '{b}')" for a, to in LEGAL.items() for b in to)


@query(f"""WITH RECURSIVE ok(a, b) AS (VALUES {_LEGAL_SQL}),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g),
o AS MATERIALIZED (SELECT user_id, run, event_type, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS k FROM s),
m AS (SELECT user_id, run, k, event_type AS status, 0 AS rejected FROM o WHERE k = 1
  UNION ALL SELECT m.user_id, m.run, o.k, CASE WHEN ok.a IS NULL THEN m.status ELSE o.event_type END, m.rejected + CASE WHEN ok.a IS NULL THEN 1 ELSE 0 END FROM m JOIN o ON o.user_id = m.user_id AND o.run = m.run AND o.k = m.k + 1 LEFT JOIN ok ON ok.a = m.status AND ok.b = o.event_type),
e AS (SELECT user_id, run, min(ts) AS opened, max(ts) + INTERVAL 1 HOUR AS closed, count(*) AS n FROM s GROUP BY user_id, run)
SELECT e.user_id, opened, closed, status, n, rejected::BIGINT AS rejected FROM e JOIN m ON m.user_id = e.user_id AND m.run = e.run AND m.k = e.n WHERE closed <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 10 MINUTE""")
def run_stream_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the users as a stream of the event file closes them: the status after legal moves, the rejected events, and the end by the timer."""
    ensure_folder(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/runs-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    events = stream.select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_type").alias("status"))
    time = lambda c: F.timestamp_micros(c).cast("timestamp_ntz").alias(c)
    return run_stream(spark, events, folder).select(F.col("key").cast("bigint").alias("user_id"), time("opened"), time("closed"), "status", "n", "rejected")
