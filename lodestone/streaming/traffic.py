"""Structured Streaming forms of the stateful operators: tolerant parsing, guardrails, fleet windows, caches, sessions.

events.ts-like columns without a zone are cast to timestamps first, as watermarks need them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import cache_key
from ..operators.monitoring import input_flags
from ..sources.files import json_lines


def parsed_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good records and dead letters of a stream of text lines (line)."""
    return json_lines(lines)


def guarded(requests: DataFrame) -> DataFrame:
    """Requests with their input flags; blocked where an injection is seen, before any model runs."""
    flags = input_flags(F.col("text"))
    return requests.withColumns({"flags": flags, "blocked": F.array_contains(flags, "input_injection")})


def fleet_windows(traces: DataFrame, width: str = "10 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts, mean latency and error share in tumbling or sliding windows of event time."""
    timed = traces.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = timed.groupBy(F.window("ts", width, slide) if slide else F.window("ts", width))
    out = grouped.agg(F.count("*").alias("requests"), F.avg("latency_ms").alias("mean_latency_ms"), F.avg(F.col("failed").cast("double")).alias("error_rate"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "requests", "mean_latency_ms", "error_rate")


def sessions(traces: DataFrame, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Requests of each key, parted where nothing comes for the gap."""
    timed = traces.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("requests"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "requests")


def first_requests(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """Requests whose normalized prompt was not seen within the watermark: what an exact cache lets through."""
    keyed = requests.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("key", cache_key(F.col("text")))
    return keyed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["key"])


def lru_cache(requests: DataFrame, bucket: str, capacity: int = 256) -> DataFrame:
    """(bucket, id, hit) of requests (bucket, id, text): an exact cache for each bucket, the least recently used key goes first."""

    def serve(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for batch in batches:
            hits = []
            for k in batch["key"]:
                hits.append(k in held)
                if hits[-1]:
                    held.remove(k)
                held.append(k)
                held = held[-capacity:]
            yield pd.DataFrame({"bucket": batch["bucket"], "id": batch["id"], "hit": hits})
        state.update((held,))

    rows = requests.select(F.col(bucket).cast("bigint").alias("bucket"), F.col("id").cast("bigint").alias("id"), cache_key(F.col("text")).alias("key"))
    return rows.groupBy("bucket").applyInPandasWithState(serve, "bucket bigint, id bigint, hit boolean", "keys array<string>", "append", "NoTimeout")


def canary_counter(requests: DataFrame, bucket: str, share: float = 0.1) -> DataFrame:
    """(bucket, id, variant): every int(1 / share)-th request of a bucket goes to the canary."""
    every = int(1 / share)

    def split(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for batch in batches:
            numbers = range(n + 1, n + len(batch) + 1)
            n += len(batch)
            yield pd.DataFrame({"bucket": batch["bucket"], "id": batch["id"], "variant": ["canary" if i % every == 0 else "control" for i in numbers]})
        state.update((n,))

    rows = requests.select(F.col(bucket).cast("bigint").alias("bucket"), F.col("id").cast("bigint").alias("id"))
    return rows.groupBy("bucket").applyInPandasWithState(split, "bucket bigint, id bigint, variant string", "n bigint", "append", "NoTimeout")
