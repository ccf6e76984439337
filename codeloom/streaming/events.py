"""Repository events as streams: routing, index upserts, issues, telemetry windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT = "event string, action string, repo string, ref string, before string, after string, default_branch string, issue_number bigint, title string, body string, received timestamp"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).json(path)


def routed(events: DataFrame) -> DataFrame:
    """Adds ``route``: index (pushes to a main branch, installations), remove, localise; others go."""
    main = F.col("ref").endswith("/main") | F.col("ref").endswith("/master")
    route = (
        F.when((F.col("event") == "push") & main, "index")
        .when((F.col("event") == "installation") & F.col("action").isin("created", "added"), "index")
        .when((F.col("event") == "installation") & F.col("action").isin("deleted", "removed"), "remove")
        .when((F.col("event") == "issues") & (F.col("action") == "opened"), "localise")
    )
    return events.withColumn("route", route).filter("route IS NOT NULL")


def as_pushes(installations: DataFrame) -> DataFrame:
    """An installation is a push of the default branch without a former commit."""
    return installations.withColumns({"event": F.lit("push"), "ref": F.concat(F.lit("refs/heads/"), F.coalesce("default_branch", F.lit("main"))), "before": F.lit(None).cast("string")})


def process(events: DataFrame, handlers: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each micro-batch's rows go to the handler of their route."""

    def batch(df: DataFrame, number: int) -> None:
        df.persist()  # read once for all routes
        for route, handle in handlers.items():
            handle(df.filter(F.col("route") == route), number)
        df.unpersist()

    writer = routed(events).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def telemetry_windows(telemetry: DataFrame, late: str = "10 minutes", width: str = "1 hour", slide: str = "15 minutes") -> DataFrame:
    """Latency statistics over sliding event-time windows; rows later than ``late`` are left out."""
    stamped = telemetry.withWatermark("ts", late)
    return stamped.groupBy(F.window("ts", width, slide), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("avg_value"), F.max("value").alias("max_value"))


def last_n_per_key(telemetry: DataFrame, n: int = 1000) -> DataFrame:
    """A running list of the newest n values of each type, kept as state; emits the new size."""
    from typing import Any

    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(key: tuple, batches: Any, state: GroupState) -> Any:
        kept = list(state.get[0]) if state.exists else []
        for pdf in batches:
            kept = (kept + pdf.sort_values("ts")["value"].tolist())[-n:]
        state.update((kept,))
        yield pd.DataFrame({"event_type": [key[0]], "held": [len(kept)], "newest": [kept[-1] if kept else None]})

    return telemetry.groupBy("event_type").applyInPandasWithState(update, "event_type string, held int, newest double", "v array<double>", "update", GroupStateTimeout.NoTimeout)
