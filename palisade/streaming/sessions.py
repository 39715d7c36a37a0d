"""Sessions of activity by keyed timers over event time.

1. Rows of an actor that fall into one slot of the length of the gap belong to one session whatever lies between them:
   ``slots`` brings them to one piece (first, last, number) with map-side partials, so that an actor with a third of all
   rows has no more than 48 pieces a day, and no Python process holds its rows.
2. Pieces are keyed by actor in the engine's session state: an ordered update opens a session of the actor or extends it
   and moves its inactivity timeout, the end of the session window; when the watermark passes that timeout the session
   goes out with start, end and count, and its state is gone. State is one row for each session that may still grow, in
   the JVM. (The same with a Python function for each actor and timer took twenty times as long.)

A stream (``session_stream``) and a bounded table (``sessions``) take the same operator. A bounded table is fed in slices
of event time, one micro-batch each, in order: at the end of a slice the watermark stands at its last piece, timers of
what lies a gap before it expire, and no row counts as late however late it was delivered. After the last slice a piece
of no actor, two gaps later than all others, lets the remaining timers expire.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.session import shared_dir, written

GAP_US = 1_800_000_000
PIECE = "actor_kind string, actor string, start_us bigint, end_us bigint, n_events bigint"
#: Pieces a micro-batch of a bounded table takes, about; and how many micro-batches it has at least.
SLICE, SLICES = 20_000_000, 3


def actor_events(requests: DataFrame) -> DataFrame:
    """actor_kind, actor, ts, ts_us, request_id. agent_id names the actor unless null or empty, else client_ip does. A row without ts can't be placed and takes no part."""
    has = F.col("agent_id").isNotNull() & (F.col("agent_id") != "")
    return requests.where(F.col("ts_us").isNotNull()).select(F.when(has, F.lit("agent")).otherwise(F.lit("ip")).alias("actor_kind"), F.when(has, F.col("agent_id")).otherwise(F.col("client_ip")).alias("actor"), F.timestamp_micros("ts_us").alias("ts"), "ts_us", "request_id")


def _piece() -> list:
    return [F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"), F.count("*").alias("n_events")]


def slots(events: DataFrame, gap_us: int = GAP_US) -> DataFrame:
    """Pieces of a bounded table: the events of an actor within one slot of gap_us, which can't be divided."""
    slot = F.expr(f"ts_us div {gap_us} - if(ts_us < 0 and ts_us % {gap_us} <> 0, 1, 0)")
    return events.groupBy("actor_kind", "actor", slot.alias("_slot")).agg(*_piece()).drop("_slot")


def timed_sessions(pieces: DataFrame, gap_us: int = GAP_US) -> DataFrame:
    """pieces: a stream with a watermark on ts, the start, of actor_kind, actor, ts, start_us, end_us, n_events. A session is emitted, whole, once the watermark is more than gap_us past its end.

    A piece holds its actor's session open from its start until gap_us after its end, that instant included.
    """
    open_for = F.make_interval(secs=((F.col("end_us") - F.col("start_us") + gap_us) / F.lit(1_000_000).cast("decimal(18,0)")).cast("decimal(18,6)"))
    grown = pieces.groupBy("actor_kind", "actor", F.session_window("ts", open_for).alias("_window"))
    return grown.agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n_events").alias("n_events")).drop("_window")


def session_stream(requests: DataFrame, lateness: str, gap_us: int = GAP_US) -> DataFrame:
    """Sessions of a stream of requests. A row may be late by ``lateness``; one that is later still is dropped. Rows delivered again within that time count once.
    """
    events = actor_events(requests).withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["request_id"])
    return timed_sessions(events.select("actor_kind", "actor", "ts", F.col("ts_us").alias("start_us"), F.col("ts_us").alias("end_us"), F.lit(1).cast("bigint").alias("n_events")), gap_us)


def sessions(spark: SparkSession, path: str, gap_us: int = GAP_US, slice_rows: int = SLICE) -> DataFrame:
    """Sessions of a bounded table of requests at path: actor_kind, actor, start_us, end_us, n_events.

    Rows with one request_id count once; rows at the same instant belong together; null client_ip without an agent is
    an actor of its own; rows without ts take no part; an empty table gives no rows. Only the columns named in
    ``actor_events`` are read.
    """
    work = shared_dir(spark, "sessions")
    table = spark.read.parquet(path).select("agent_id", "client_ip", "ts_us", "request_id")
    pieces = written(slots(actor_events(table).dropDuplicates(["request_id"]), gap_us), "pieces")
    n, first, last = pieces.agg(F.count("*"), F.min("start_us"), F.max("end_us")).first()
    # the stream's clock starts a day before the first piece: a watermark never stands before 1970
    shift = (first or 0) - 86_400_000_000
    pieces = pieces.withColumn("ts", F.timestamp_micros(F.col("start_us") - shift))
    source = f"{work}/in"
    columns = ["actor_kind", "actor", "ts", "start_us", "end_us", "n_events"]
    schema = pieces.select(*columns).schema
    if n:
        k = max(SLICES, -(-n // slice_rows))
        edges = pieces.approxQuantile("start_us", [i / k for i in range(1, k)], 0.001)
    else:
        last, edges = 0, []
    lows, highs = [None, *edges], [*edges, None]

    def run() -> None:
        stream = timed_sessions(spark.readStream.schema(schema).parquet(source).withWatermark("ts", "0 seconds"), gap_us)
        query = stream.writeStream.format("parquet").option("path", f"{work}/out").option("checkpointLocation", f"{work}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()

    # a slice is the input of one micro-batch: it is written once the one before has been taken
    for a, b in zip(lows, highs):
        part = pieces if a is None else pieces.where(F.col("start_us") >= a)
        part = part if b is None else part.where(F.col("start_us") < b)
        part.select(*columns).write.mode("append").parquet(source)
        if b is not None:
            run()
    end = spark.createDataFrame([(None, None, last + 2 * gap_us + 1_000_000, last, last, 0)], "actor_kind string, actor string, at bigint, start_us bigint, end_us bigint, n_events bigint").withColumn("ts", F.timestamp_micros(F.col("at") - shift))
    end.select(*columns).coalesce(1).write.mode("append").parquet(source)
    run()
    return spark.read.schema(PIECE).parquet(f"{work}/out").where("actor_kind IS NOT NULL")
