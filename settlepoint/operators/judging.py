"""Judging of the pairs that the deterministic stages leave: retries, votes, caches, resumable batches.

A judge is any callable (text_a, loc_a, text_b, loc_b) -> reply text, verdict or None. It runs in
mapInPandas over a filtered band, never over pairs that are already decided or cached.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

RETRY_STATUS = (429, 500, 502, 503, 504)


class JudgeUnavailable(RuntimeError):
    """A call that may succeed later; delay is the server's hint in seconds, if any."""

    def __init__(self, message: str, delay: float | None = None):
        super().__init__(message)
        self.delay = delay


def suggested_delay(headers: dict | None, body: str | None) -> float | None:
    """Plain form of text.suggested_delay for the caller of a service."""
    asked = ((headers or {}).get("Retry-After") or "").strip()
    if re.fullmatch(r"\d+\.?\d*|\.\d+", asked):
        return float(asked)
    found = re.search(r'"retryDelay"\s*:\s*"(\d+(?:\.\d+)?)s"', body or "")
    return float(found[1]) if found else None


def check_response(status: int, headers: dict | None = None, body: str | None = None) -> None:
    """Raise for a failed HTTP response: to be retried where the status is transient, else for good."""
    if status in RETRY_STATUS:
        raise JudgeUnavailable(f"status {status}", suggested_delay(headers, body))
    if status >= 400:
        raise RuntimeError(f"status {status}: {(body or '')[:500]}")


def with_retries(call: Callable, attempts: int = 3, base: float = 0.5, most: float = 45.0, sleep: Callable = time.sleep):
    """call() until it returns, waiting the hinted or a doubling delay after each failure; None if it never does."""
    for k in range(attempts):
        try:
            return call()
        except JudgeUnavailable as e:
            if k + 1 < attempts:
                sleep(min(most, e.delay if e.delay is not None else base * 2**k))
    return None


def judge_band(pairs: DataFrame, judge: Callable, votes: int = 1, attempts: int = 3) -> DataFrame:
    """Adds yes and cast (how many of the votes were decided) to pairs with text_a, text_b, location_a, location_b."""
    fields = [*pairs.schema.fields]
    names = [f.name for f in fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yes, cast = [], []
            for a, la, c, lc in zip(b["text_a"], b["location_a"], b["text_b"], b["location_b"], strict=True):
                said = [with_retries(lambda a=a, la=la, c=c, lc=lc: judge(a, la, c, lc), attempts) for _ in range(votes)]
                said = [v for v in said if v is not None]
                yes.append(sum(map(bool, said)))
                cast.append(len(said))
            yield b.assign(yes=yes, cast=cast)[[*names, "yes", "cast"]]

    from pyspark.sql import types as T

    schema = T.StructType([*fields, T.StructField("yes", T.IntegerType()), T.StructField("cast", T.IntegerType())])
    return pairs.mapInPandas(run, schema)


def majority(judged: DataFrame, votes: int = 1) -> DataFrame:
    """same (more than half of the votes) and decided (every vote was); an undecided pair counts as different."""
    return judged.withColumn("same", F.col("yes") * 2 > votes).withColumn("decided", F.col("cast") == votes)


def missing_keys(pairs: DataFrame, cache: DataFrame) -> DataFrame:
    """The distinct pair keys that a dry pass finds to be uncached."""
    return pairs.select("pair_key").distinct().join(cache.select("pair_key"), "pair_key", "left_anti")


def prejudge(band: DataFrame, cache: DataFrame, judge: Callable, votes: int = 1, max_new: int | None = None) -> DataFrame:
    """pair_key, same of newly decided pairs: one row per uncached key is judged, undecided ones are left out.

    The result is to be appended to the cache; running it again takes up only what is still missing.
    """
    once = band.join(missing_keys(band, cache), "pair_key", "left_semi").dropDuplicates(["pair_key"])
    if max_new is not None:  # a budget of calls, in key order
        once = once.orderBy("pair_key").limit(max_new)
    return majority(judge_band(once, judge, votes), votes).where("decided").select("pair_key", "same")


def robustness(first: DataFrame, again: DataFrame) -> DataFrame:
    """n, agreement and flips of two passes over the same keys, over pairs that both decided."""
    b = again.select("pair_key", F.col("same").alias("other"))
    both = first.join(b, "pair_key").where("same is not null and other is not null")
    return both.agg(F.count("*").alias("n"), F.avg((F.col("same") == F.col("other")).cast("double")).alias("agreement"), F.count_if(F.col("same") != F.col("other")).alias("flips"))


def rule_judge(a: str, _la, b: str, _lb) -> bool:
    """Content-token Jaccard of at least 0.34: the default judge without a network."""
    x, y = ({t for t in re.findall("[a-z0-9]+", (s or "").lower()) if t not in text.STOP_WORDS} for s in (a, b))
    return bool(x and y) and len(x & y) / len(x | y) >= 0.34


def clashes(judge_spec: str, models: DataFrame, column: str = "model_id") -> DataFrame:
    """Rows whose model is of the judge's family (an unknown family clashes with nothing)."""
    family = text.spec_family(F.lit(judge_spec))
    return models.where((family != "unknown") & (text.model_family(F.col(column)) == family))


def self_agreement(verdicts: DataFrame, key: str = "pair_key", verdict: str = "same") -> DataFrame:
    """One row: pairs, unstable (pairs with more than one distinct verdict over repeated passes) and their share."""
    per = verdicts.where(F.col(verdict).isNotNull()).groupBy(key).agg((F.min(verdict) != F.max(verdict)).alias("_mixed"))
    return per.agg(F.count("*").alias("pairs"), F.count_if("_mixed").alias("unstable"), F.avg(F.col("_mixed").cast("double")).alias("share"))


def judge_counts(judged: DataFrame, votes: int = 1) -> DataFrame:
    """One row over the output of judge_band: pairs, votes asked for, votes without a verdict, undecided pairs."""
    failed = votes - F.col("cast")
    return judged.agg(
        F.count("*").alias("pairs"), (F.count("*") * votes).alias("votes"), F.coalesce(F.sum(failed), F.lit(0)).cast("long").alias("failed"), F.count_if(failed > 0).alias("undecided")
    )
