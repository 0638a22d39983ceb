"""Caches, rate limits and retries replayed over event tables.

Sequential state is kept per key while a task streams over its rows sorted by key and time, so a key of
any length needs no more memory than its state.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Bucket:
    """A token bucket: starts at capacity, refills up to burst; time going backwards earns nothing."""

    def __init__(self, capacity: float, refill: float, burst: float | None = None):
        burst = capacity if burst is None else burst
        if capacity <= 0 or refill < 0 or burst < capacity:
            raise ValueError(f"capacity {capacity}, refill {refill}, burst {burst}")
        self.capacity, self.refill, self.burst, self.level, self.at = capacity, refill, burst, capacity, None

    def advance(self, now: float) -> None:
        if self.at is not None and now > self.at:
            self.level = min(self.burst, self.level + (now - self.at) * self.refill)
        self.at = now

    def allow(self, now: float, cost: float = 1.0) -> tuple[bool, float, float]:
        """(allowed, tokens left, seconds until the cost could be paid)."""
        if cost < 0:
            raise ValueError("a cost must not be negative")
        if cost > self.burst:
            return False, self.level, float("inf")
        self.advance(now)
        if self.level >= cost:
            self.level -= cost
            return True, self.level, 0.0
        return False, self.level, (cost - self.level) / self.refill if self.refill > 0 else float("inf")

    def remaining(self, now: float) -> float:
        """Tokens at a time (capacity if the bucket was never used)."""
        if self.at is not None:
            self.advance(now)
        return self.level

    def full(self, now: float) -> bool:
        """Whether the bucket is back at its capacity, so that it may be forgotten."""
        return self.remaining(now) >= self.capacity


class LruTtl:
    """A cache of bounded size whose entries expire; get of a missing key is a miss, which sets it."""

    def __init__(self, capacity: int, ttl: float | None):
        self.capacity, self.ttl, self.entries = capacity, ttl, OrderedDict()
        self.hits = self.misses = self.evictions = self.expirations = 0

    def access(self, key, now: float) -> bool:
        deadline = self.entries.get(key, False)
        if deadline is not False and (deadline is None or now < deadline):
            self.entries.move_to_end(key)
            self.hits += 1
            return True
        if deadline is not False:
            del self.entries[key]
            self.expirations += 1
        self.misses += 1
        self.entries[key] = None if self.ttl is None else now + self.ttl
        while len(self.entries) > self.capacity:
            self.entries.popitem(last=False)
            self.evictions += 1
        return False

    def purge(self, now: float) -> int:
        """Drop expired entries; returns how many."""
        gone = [k for k, d in self.entries.items() if d is not None and now >= d]
        for k in gone:
            del self.entries[k]
        self.expirations += len(gone)
        return len(gone)


def _streamed(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    return df.repartition(key).sortWithinPartitions(key, *order)


def _with_limits(rows: DataFrame, limits: DataFrame | None, capacity: float, refill: float, burst: float | None) -> DataFrame:
    """rows with the capacity, refill and burst of their key: those of limits where it names the key, else the defaults."""
    usual = {"capacity": capacity, "refill": refill, "burst": capacity if burst is None else burst}
    if limits is None:
        return rows.select("*", *[F.lit(float(v)).alias(k) for k, v in usual.items()])
    own = limits.select("key", *[F.col(c).cast("double").alias(f"_{c}") for c in usual])
    rows = rows.join(own, "key", "left")
    for c in ("capacity", "refill"):
        rows = rows.withColumn(c, F.coalesce(f"_{c}", F.lit(float(usual[c]))))
    most = F.coalesce("_burst", F.greatest(F.col("capacity"), F.lit(float(usual["burst"]))))
    return rows.withColumn("burst", most).drop(*[f"_{c}" for c in usual])


def rate_limit(
    events: DataFrame, key: str, ts: str, capacity: float, refill: float, burst: float | None = None, cost: str | None = None, order: tuple[str, ...] = (), limits: DataFrame | None = None
) -> DataFrame:
    """key, ts (seconds) and the decision on each event: allowed, remaining, retry_after.

    limits (key, capacity, refill, burst; one row a key, null for the default) sets other parameters for some keys.
    """
    rows = events.select(F.col(key).alias("key"), F.col(ts).cast("double").alias("ts"), (F.col(cost) if cost else F.lit(1.0)).cast("double").alias("cost"), *order)
    rows = _with_limits(rows, limits, capacity, refill, burst)
    kind = dict(rows.dtypes)["key"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now_key, bucket = object(), None
        for b in batches:
            out = []
            for k, t, c, *limit in zip(b["key"], b["ts"], b["cost"], b["capacity"], b["refill"], b["burst"], strict=True):
                if k != now_key:
                    now_key, bucket = k, Bucket(*limit)
                out.append((k, t, *bucket.allow(t, c)))
            yield pd.DataFrame(out, columns=["key", "ts", "allowed", "remaining", "retry_after"])

    return _streamed(rows, "key", ["ts", *order]).mapInPandas(run, f"key {kind}, ts double, allowed boolean, remaining double, retry_after double")


def bucket_levels(decisions: DataFrame, at: float, capacity: float, refill: float, burst: float | None = None, limits: DataFrame | None = None) -> DataFrame:
    """key, remaining at a time after all decisions of rate_limit, and full: whether the bucket may be forgotten.

    The last decision of a key (latest ts; of equal ones the least remaining) is a grouped maximum.
    """
    last = decisions.groupBy("key").agg(F.max(F.struct("ts", (-F.col("remaining")).alias("r"))).alias("l")).select("key", "l.ts", (-F.col("l.r")).alias("level"))
    last = _with_limits(last, limits, capacity, refill, burst)
    gained = F.greatest(F.lit(0.0), F.lit(float(at)) - F.col("ts")) * F.col("refill")
    last = last.withColumn("remaining", F.least(F.greatest("burst", "level"), F.col("level") + gained))
    return last.select("key", "remaining", (F.col("remaining") >= F.col("capacity")).alias("full"))


def cache_replay(events: DataFrame, owner: str, item: str, ts: str, capacity: int, ttl: float | None, order: tuple[str, ...] = ()) -> DataFrame:
    """Per owner: hits, misses, evictions, expirations and hit_rate of a cache of its accesses."""
    rows = events.select(F.col(owner).alias("owner"), F.col(item).alias("item"), F.col(ts).cast("double").alias("ts"), *order)
    kind = dict(rows.dtypes)["owner"]
    names = ["owner", "hits", "misses", "evictions", "expirations", "hit_rate"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, cache = None, None

        def row() -> tuple:
            n = cache.hits + cache.misses
            return now, cache.hits, cache.misses, cache.evictions, cache.expirations, cache.hits / n if n else 0.0

        for b in batches:
            out = []
            for o, i, t in zip(b["owner"], b["item"], b["ts"], strict=True):
                if cache is None or o != now:
                    if cache is not None:
                        out.append(row())
                    now, cache = o, LruTtl(capacity, ttl)
                cache.access(i, t)
            if out:
                yield pd.DataFrame(out, columns=names)
        if cache is not None:
            yield pd.DataFrame([row()], columns=names)

    schema = f"owner {kind}, hits bigint, misses bigint, evictions bigint, expirations bigint, hit_rate double"
    return _streamed(rows, "owner", ["ts", *order]).mapInPandas(run, schema)


def ttl_hits(events: DataFrame, owner: str, item: str, ts: str, ttl: float) -> DataFrame:
    """Per owner the accesses whose item was accessed within ttl before (an unbounded cache that renews on use)."""
    before = F.lag(ts).over(Window.partitionBy(owner, item).orderBy(ts))
    hit = F.coalesce((F.col(ts) - before) < ttl, F.lit(False))
    return events.withColumn("_hit", hit).groupBy(owner).agg(F.count_if("_hit").alias("hits"), F.count_if(~F.col("_hit")).alias("misses"))


def backoff(retry: Column, base: float = 0.1, multiplier: float = 2.0, most: float = 30.0, jitter: str = "none", unit: Column | None = None) -> Column:
    """Seconds before the retry-th retry (from 1); unit is a uniform draw in [0, 1) for full or equal jitter."""
    raw = F.least(F.lit(most), base * F.pow(F.lit(multiplier), retry - 1))
    if jitter == "full":
        return raw * unit
    return raw / 2 + raw / 2 * unit if jitter == "equal" else raw


def retry_schedule(attempts: DataFrame, failed: str, key: str, order: str, max_attempts: int = 3, deadline: float | None = None, **kw) -> DataFrame:
    """Attempts that a retry policy makes: each key's tries up to the first success, attempt limit or deadline."""
    w = Window.partitionBy(key).orderBy(order)
    rows = attempts.withColumn("attempt", F.row_number().over(w))
    earlier = F.coalesce(F.min(F.col(failed).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1)) == 1
    rows = rows.withColumn("_reached", earlier).where((F.col("attempt") <= max_attempts) & F.col("_reached"))
    delay = F.when(F.col("attempt") > 1, backoff(F.col("attempt") - 1, **kw)).otherwise(0.0)
    rows = rows.withColumn("delay", delay).withColumn("waited", F.sum("delay").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return (rows if deadline is None else rows.where(F.col("waited") <= deadline)).drop("_reached")
