"""Event streams: windowed counts with late data bounded by a watermark, and the run state machine."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.query import registry
from tessera.sources.checkpoints import ensure_folder
from tessera.sources.tables import table

QUERIES, ORACLE_SQL, query = registry()

LATE, WINDOW = "10 minutes", "1 hour"


def hourly(events: DataFrame) -> DataFrame:
    """Counts and values by hour and type, for a batch or a stream."""
    return events.groupBy(F.window("ts", WINDOW).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("hour"), "event_type", "n", F.round("value", 4).alias("value"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(table(spark, sf_dir, "events"))


def stream_to_parquet(events: DataFrame, folder: str) -> None:
    """Run what a stream has so far into Parquet files, exactly once by its checkpoint."""
    q = events.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


@query("SELECT user_id, event_id, event_type, value FROM events WHERE event_type IN (SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2)")
def streamed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of the event file joined with a static table of the two commonest types, and read back from its sink."""
    ensure_folder(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    batch = table(spark, sf_dir, "events")
    common = batch.groupBy("event_type").count().orderBy(F.desc("count"), "event_type").limit(2).select("event_type")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    stream_to_parquet(stream.join(F.broadcast(common), "event_type", "left_semi").select("user_id", "event_id", "event_type", "value"), folder)
    return spark.read.parquet(f"{folder}/out")


def as_files(spark: SparkSession, sf_dir: str, n: int = 4) -> str:
    """The events in files of their own, in the order of time, so that a stream takes several batches."""
    ensure_folder(spark)
    at = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/events-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events")
    days = e.agg(F.unix_seconds(F.min("ts").cast("timestamp")).alias("a"), F.unix_seconds(F.max("ts").cast("timestamp")).alias("b")).first()
    part = F.least(F.lit(n - 1), F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - days.a) * n / (days.b - days.a + 1)))
    for k in range(n):
        e.filter(part == k).coalesce(1).write.mode("append").parquet(at)
    return at


@query("""WITH h AS (SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL) SELECT * FROM h WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def windowed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts as a stream of several files gives them: a window is written once the watermark has passed its end."""
    at = as_files(spark, sf_dir)
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)
    stream_to_parquet(hourly(stream), f"{at}-windows")
    return spark.read.parquet(f"{at}-windows/out").withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("SELECT user_id, count(*) AS n_events, max(event_id) AS last_event FROM events GROUP BY user_id")
def upserted_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each user, brought up to date by every batch: the new snapshot of batch k is written under k, so doing a batch again changes nothing."""
    at = as_files(spark, sf_dir)
    done: list[int] = []

    def upsert(batch: DataFrame, k: int) -> None:
        new = batch.groupBy("user_id").agg(F.count("*").alias("n_events"), F.max("event_id").alias("last_event"))
        if k > 0:
            new = new.unionByName(batch.sparkSession.read.parquet(f"{at}-users/{k - 1}")).groupBy("user_id").agg(F.sum("n_events").alias("n_events"), F.max("last_event").alias("last_event"))
        new.write.mode("overwrite").parquet(f"{at}-users/{k}")
        done.append(k)

    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 1).parquet(at)
    stream.writeStream.foreachBatch(upsert).option("checkpointLocation", f"{at}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}-users/{max(done)}")


#: Which status may follow which.
LEGAL = {"view": ["click", "purchase", "error", "signup"], "click": ["view", "purchase", "error"], "signup": ["view", "click"], "error": ["view"], "purchase": ["view"]}


@query("""WITH l AS (SELECT user_id, event_type AS state, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events), ok(a, b) AS (VALUES ('view', 'click'), ('view', 'purchase'), ('view', 'error'), ('view', 'signup'), ('click', 'view'), ('click', 'purchase'), ('click', 'error'), ('signup', 'view'), ('signup', 'click'), ('error', 'view'), ('purchase', 'view'))
SELECT before, state, ok.a IS NOT NULL AS legal, count(*) AS n FROM l LEFT JOIN ok ON before = a AND state = b WHERE before IS NOT NULL GROUP BY ALL""")
def run_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each status followed each, and whether it may."""
    from pyspark.sql.window import Window as W

    before = F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    moves = table(spark, sf_dir, "events").select(F.col("event_type").alias("state"), before.alias("before")).filter("before is not null")
    legal = F.lit(False)
    for a, to in LEGAL.items():
        legal = legal | ((F.col("before") == a) & F.col("state").isin(to))
    return moves.groupBy("before", "state").agg(F.count("*").alias("n")).withColumn("legal", legal)


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS opened, max(ts) + INTERVAL 1 HOUR AS reaped_at, count(*) AS n FROM s GROUP BY user_id, k""")
def idle_reaping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats are closed when nothing has come for an hour."""
    return table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("opened"), F.col("w.end").alias("reaped_at"), "n")


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, event_type AS state, n FROM o WHERE k = 1""")
def run_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state that each run's newest event leaves it in."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count("*").alias("n"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, session::BIGINT AS session, min(ts) AS started, count(*) AS n FROM s GROUP BY ALL""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user no more than 30 minutes apart make a session."""
    from pyspark.sql.window import Window as W

    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.coalesce(F.col("ts") - F.lag("ts").over(w) <= F.expr("interval 30 minutes"), F.lit(False))
    e = table(spark, sf_dir, "events").withColumn("fresh", F.when(gap, 0).otherwise(1))
    return e.withColumn("session", F.sum("fresh").over(w)).groupBy("user_id", "session").agg(F.min("ts").alias("started"), F.count("*").alias("n"))


@query("""SELECT event_type, cast(json_extract(props, '$.k') AS BIGINT) % 10 AS bucket, count(*) AS n FROM events GROUP BY ALL""")
def parsed_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type", (k % 10).alias("bucket")).agg(F.count("*").alias("n"))
