"""Queries that run streams: tables come in slices, each start of a query takes one and goes on from its checkpoint.

The oracle of each is SQL over the whole table, so slices, restarts, timers and a broken start must leave no trace.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.sampling import group_ordinals
from millrace.plans.catalog import _r, query
from millrace.sources import remote
from millrace.sources.storage import cut, fresh_path, table
from millrace.streaming import runs
from millrace.streaming import windows as W


@query("""WITH RECURSIVE c AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN CASE WHEN turn % 4 = 0 THEN 'confirm' ELSE 'preview' END ELSE 'pop' END AS kind FROM conversations), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, kind) AS nth FROM c),
f AS (SELECT DISTINCT conv_id, 0::BIGINT AS nth, []::BIGINT[] AS waiting, NULL::BIGINT AS preview, NULL::BIGINT AS turn, NULL::VARCHAR AS kind, NULL::VARCHAR AS outcome, NULL::BIGINT AS item FROM c UNION ALL
SELECT f.conv_id, o.nth, CASE WHEN o.kind = 'confirm' AND len(waiting) < 2 THEN list_append(waiting, o.turn::BIGINT) WHEN o.kind = 'pop' AND len(waiting) > 0 THEN waiting[2:] ELSE waiting END,
CASE WHEN o.kind = 'preview' THEN o.turn::BIGINT WHEN o.kind = 'pop' AND len(waiting) = 0 THEN NULL ELSE preview END, o.turn::BIGINT, o.kind,
CASE o.kind WHEN 'preview' THEN CASE WHEN preview IS NULL THEN 'held' ELSE 'replaced' END WHEN 'confirm' THEN CASE WHEN len(waiting) < 2 THEN 'queued' ELSE 'rejected' END ELSE CASE WHEN len(waiting) > 0 OR preview IS NOT NULL THEN 'popped' ELSE 'empty' END END,
CASE WHEN o.kind = 'pop' THEN CASE WHEN len(waiting) > 0 THEN waiting[1] ELSE preview END END FROM f JOIN o ON o.conv_id = f.conv_id AND o.nth = f.nth + 1)
SELECT conv_id, turn, kind, outcome, coalesce(item, -1) AS item FROM f WHERE nth > 0""")
def queue_stream(spark, sf_dir):
    """The bounded queue of every conversation as keyed state: what became of each command, over four starts."""
    kind = F.when(F.col("role") == "user", F.when(F.col("turn") % 4 == 0, "confirm").otherwise("preview")).otherwise("pop")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").cast("long").alias("at"), kind.alias("kind"))
    feed = runs.Feed(rows, "commands")
    with runs.keyed_state(spark):
        out = feed.stream().groupBy("key").transformWithStateInPandas(W.BoundedQueue(2), W.BoundedQueue.SCHEMA, "Append", "None")
        done = runs.in_starts([feed], [(p,) for p in runs.slices(rows, F.col("at"), 4)], out, "queue")
    return done.select(F.col("key").alias("conv_id"), F.col("at").alias("turn"), "kind", "outcome", F.coalesce("item", F.lit(-1)).alias("item"))


@query("""SELECT event_id // 3 AS id, arg_min(event_id, event_id) AS event_id, arg_min(user_id, event_id) AS user_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY 1""")
def exactly_once_stream(spark, sf_dir):
    """Events that are sent up to three times, in batches of their own; a start breaks off between writing and marking its batch and is run again."""
    rows = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 3).alias("id"), "event_id", "user_id", "event_type")
    feed, broken = runs.Feed(rows, "events"), []

    def break_off(batch_id: int) -> None:
        if batch_id == 1 and not broken:
            broken.append(batch_id)
            raise InterruptedError("between write and commit")

    sink = runs.IdempotentSink(spark, fresh_path(spark, "shown"), "id", "event_id", break_off)
    checkpoint = fresh_path(spark, "shown-checkpoint")
    for nth in range(3):
        feed.add(rows.where(F.col("event_id") % 3 == nth))
        try:
            runs.advance(feed.stream(), checkpoint, each=sink)
        except Exception:
            if not broken:
                raise
            runs.advance(feed.stream(), checkpoint, each=sink)
    return sink.rows(rows.schema)


IDLE_S, MAX_AGE_S = 600, 60
DAY_US = 86_400_000_000
NO_ID = (1 << 63) - 1  # of clicks without an id, which come last among those of their instant


@query(f"""WITH c AS (SELECT click_id, coalesce(client_id, -1) AS client, epoch_us(arrived_at) AS a, coalesce(value IS NOT NULL AND kind <> 'error' AND arrived_at >= ts AND arrived_at - ts <= INTERVAL {MAX_AGE_S} SECOND, false) AS ok, value FROM clicks WHERE arrived_at IS NOT NULL),
l AS (SELECT *, lag(a) OVER w AS prev, lag(ok) OVER w AS pok, lead(a) OVER w AS nxt FROM c WINDOW w AS (PARTITION BY client ORDER BY a, click_id)),
s AS (SELECT *, sum((NOT ok OR prev IS NULL OR NOT pok OR a - prev > {IDLE_S} * 1000000)::INT) OVER (PARTITION BY client ORDER BY a, click_id ROWS UNBOUNDED PRECEDING) AS seg FROM l),
w AS (SELECT *, count(*) OVER p AS n, avg(value) OVER p AS m FROM s WINDOW p AS (PARTITION BY client, seg ORDER BY a, click_id ROWS 6 PRECEDING))
SELECT client, click_id, a AS at, CASE WHEN ok THEN n ELSE 0 END::BIGINT AS size, CASE WHEN ok THEN round(m, 6) END AS mean FROM w
UNION ALL SELECT client, -1, a + {IDLE_S} * 1000000, 0, NULL FROM l WHERE ok AND (nxt - a > {IDLE_S} * 1000000 OR nxt IS NULL AND a + {IDLE_S} * 1000000 <= (SELECT max(a) FROM l))""")
def clocked_window_stream(spark, sf_dir):
    """Windows of every client's clicks, which broken, late and future ones empty, and the clock after ten minutes without any; clicks without arrival have no place in the stream.

    Identical clicks follow each other in one order throughout. The SQL sorts anew for each of its windows and leaves their order open, so its own runs may differ there.
    """
    c = table(spark, sf_dir, "clicks").where("arrived_at is not null")
    us = lambda x: F.unix_micros(F.col(x).cast("timestamp"))
    first = c.agg(F.min(us("arrived_at"))).first()[0]
    later = F.lit(0 if first is None or first > 0 else (1 - first // DAY_US) * DAY_US)  # watermarks begin at 1970 and drop what is not behind it
    valid = F.coalesce(F.col("value").isNotNull() & (F.col("kind") != "error") & F.col("ts").isNotNull(), F.lit(False))
    rows = c.select(F.coalesce("client_id", F.lit(-1)).cast("long").alias("key"), F.coalesce("click_id", F.lit(NO_ID)).alias("id"), (us("arrived_at") + later).alias("at"), F.coalesce(us("ts") + later, F.lit(0)).alias("captured"), valid.alias("valid"), F.coalesce("value", F.lit(0.0)).alias("value"))
    feed = runs.Feed(rows, "clicks")
    with runs.keyed_state(spark):
        timed = feed.stream().withColumn("time", F.timestamp_micros("at")).withWatermark("time", "0 seconds")
        out = timed.groupBy("key").transformWithStateInPandas(W.ClockedWindow(7, MAX_AGE_S * 1_000_000, IDLE_S * 1000), W.ClockedWindow.SCHEMA, "Append", "EventTime")
        done = runs.in_starts([feed], [(p,) for p in runs.slices(rows, F.col("at"), 4)], out, "windows")
    click = F.when(F.col("id").isNull(), -1).when(F.col("id") != NO_ID, F.col("id"))
    return done.select(F.col("key").alias("client"), click.alias("click_id"), (F.col("at") - later).alias("at"), "size", _r("mean").alias("mean"))


@query("""WITH o AS (SELECT event_id, (event_id + event_id % 4) AS oid, event_id % 4 = 0 AS same FROM events) SELECT e.event_id, o.oid IS NULL AS fallback FROM events e LEFT JOIN o ON o.oid = e.event_id AND o.same""")
def frame_join_stream(spark, sf_dir):
    """Frames and observations as two streams: a frame without an observation of exactly its capture comes out as fallback once both watermarks have passed it."""
    e = table(spark, sf_dir, "events")
    ns, ts = F.unix_micros(F.col("ts").cast("timestamp")) * 1000, F.col("ts").cast("timestamp").alias("ts")
    frames = e.select("event_id", F.col("event_id").alias("frame_id"), ns.alias("captured_at_ns"), ts)
    seen = e.select(F.col("event_id").alias("frame_id"), (ns + F.col("event_id") % 4).alias("captured_at_ns"), ts)
    late = e.agg((F.max("ts").cast("timestamp") + F.expr("interval 1 day")).alias("ts"))  # one row, which closes both streams
    none = F.lit(-1).cast("long")
    end_f = late.select(none.alias("event_id"), none.alias("frame_id"), none.alias("captured_at_ns"), "ts")
    end_s = late.select((none - 1).alias("frame_id"), none.alias("captured_at_ns"), "ts")
    a, b = runs.Feed(frames, "frames"), runs.Feed(seen, "seen")
    out = W.same_frame(a.stream(), b.stream(), "10 minutes").select("event_id", F.col("o_frame").isNull().alias("fallback"))
    parts = [*zip(*(runs.slices(x, F.unix_micros("ts"), 3) for x in (frames, seen)), strict=True), (end_f, end_s)]
    return runs.in_starts([a, b], parts, out, "frames").where("event_id >= 0")


@query("""WITH f AS (SELECT 'cam' || user_id % 4 AS camera, event_id, event_id || ':' || event_type AS image, event_id % 10 <> 7 AS good FROM events)
SELECT camera, (row_number() OVER (PARTITION BY camera ORDER BY event_id) - 1)::BIGINT AS frame_id, image FROM f WHERE good""")
def camera_stream(spark, sf_dir):
    """Four cameras polled in executors: one read in ten fails and the capture is opened again; every start is a restart, ids go on without gaps."""
    e = table(spark, sf_dir, "events")
    image = F.concat(F.col("event_id").cast("string"), F.lit(":"), "event_type").cast("binary")
    reads = e.select(F.concat(F.lit("cam"), (F.col("user_id") % 4).cast("string")).alias("camera"), "event_id", F.when(F.col("event_id") % 10 != 7, image).alias("image"))
    placed = cut(group_ordinals(reads, "camera", [F.col("event_id")], "nth"))
    root = fresh_path(spark, "recordings")
    remote.write_recording(placed, root)
    cameras = placed.groupBy("camera").agg(F.max("nth").alias("n")).collect()  # four rows
    most = max((r.n for r in cameras), default=0)
    spark.dataSource.register(remote.Cameras)
    stream = spark.readStream.format("cameras").option("cameras", "\n".join(f"{r.camera}={root}/{r.camera}" for r in cameras)).option("capture", "millrace.sources.remote:Recording")
    stream = stream.option("log", fresh_path(spark, "camera-log")).option("perbatch", str(-(-most // 3))).option("failures", "50").load()
    done = runs.in_starts([], [(), ()], stream, "cameras")
    return done.select("camera", "frame_id", F.col("image").cast("string").alias("image"))
