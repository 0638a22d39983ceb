"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.limiters import Bucket


def event_time(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP; the tables have TIMESTAMP_NTZ (read as UTC)."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def windowed(events: DataFrame, keys: list[str], value: str, width: str, slide: str | None = None, late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Tumbling or sliding windows with n, total, mean, low and high; rows later than the watermark are dropped."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    v = F.col(value)
    out = event_time(events, ts).withWatermark(ts, late).groupBy(w.alias("w"), *keys)
    out = out.agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total", "mean", "low", "high")


def sessions(events: DataFrame, keys: list[str], gap: str, late: str = "1 hour", ts: str = "ts") -> DataFrame:
    out = event_time(events, ts).withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def rate_limited(events: DataFrame, key: str, seconds: str, capacity: float, refill: float, burst: float | None = None, idle_ms: int | None = None) -> DataFrame:
    """Token-bucket decisions with one bucket per key as state.

    With idle_ms idle buckets are forgotten after that long (a stream that runs on; an available-now run
    would wait for its timeouts).
    """
    kind = dict(events.dtypes)[key]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if idle_ms is not None and state.hasTimedOut:
            state.remove()
            return
        bucket = Bucket(capacity, refill, burst)
        if state.exists:
            bucket.level, bucket.at = state.get
        rows = pd.concat(list(batches)).sort_values(seconds)
        out = [(k[0], t, *bucket.allow(t)) for t in rows[seconds]]
        state.update((bucket.level, bucket.at))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=[key, "ts", "allowed", "remaining", "retry_after"])

    return events.groupBy(key).applyInPandasWithState(
        step,
        f"{key} {kind}, ts double, allowed boolean, remaining double, retry_after double",
        "level double, at double",
        "append",
        GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout,
    )


def judge_stream(pairs: DataFrame, cache_path: str, judge: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Judge pairs as they arrive and append the verdicts that the cache lacks; restarts resume by the checkpoint."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        once = df.dropDuplicates(["pair_key"])
        path = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            known = spark.read.schema("pair_key string, same boolean").parquet(cache_path)
            once = once.join(known.select("pair_key"), "pair_key", "left_anti")
        judge(once).where("same is not null").select("pair_key", "same").write.mode("append").parquet(cache_path)

    return pairs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def collected(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over what is available now and return its result (a memory table: small results only)."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
