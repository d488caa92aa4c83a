"""Leases and counts on event streams. The same functions serve batch tables, so that either can be checked against the other."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusflow.session import scratch_path


def windowed_counts(events: DataFrame, at: str, kind: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``start, kind, n, total`` for each window of event time; rows later than ``late`` fall out of a stream."""
    timed = events.withWatermark(at, late) if events.isStreaming else events
    return timed.groupBy(F.window(at, width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def lease_spans(events: DataFrame, at: str, holder: str, lease: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``holder, claimed_at, expires_at, n_renewals``: every event before a lease runs out renews it, the next one after claims anew."""
    timed = events.withWatermark(at, late) if events.isStreaming else events
    return timed.groupBy(holder, F.session_window(at, lease).alias("w")).agg((F.count("*") - 1).alias("n_renewals")).select(holder, F.col("w.start").alias("claimed_at"), F.col("w.end").alias("expires_at"), "n_renewals")


STATE = "owner string, until timestamp"
OUTCOME = "unit string, at timestamp, session string, action string, outcome string"


def exclusive_leases(requests: DataFrame, lease_seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """Requests ``unit, at, session, action`` (acquire, renew or release) in order of time, each with its outcome: granted, renewed,
    released, conflict (another session holds the unit), or missing (nothing to renew or release). A lease that has run out is free, and
    its state is gone once the watermark, ``late`` behind the latest request, has passed its end. The requests for a unit in one trigger
    are sorted in one task.
    """

    def serve(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        owner, until = state.get if state.exists else (None, None)
        rows = []
        batch = pd.concat(list(frames)).sort_values(["at", "session", "action"], kind="stable")
        for r in batch.itertuples():
            live = owner is not None and until > r.at
            mine = live and owner == r.session
            if live and not mine:
                outcome = "conflict"
            elif r.action == "acquire" or r.action == "renew" and mine:
                outcome = "renewed" if mine else "granted"
                owner, until = r.session, r.at + pd.Timedelta(seconds=lease_seconds)
            elif r.action == "release" and mine:
                outcome, owner, until = "released", None, None
            else:
                outcome = "missing"
            rows.append((key[0], r.at, r.session, r.action, outcome))
        if owner is None:
            state.remove()
        else:
            state.update((owner, until))
            state.setTimeoutTimestamp(max(int(until.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["unit", "at", "session", "action", "outcome"])

    return requests.withWatermark("at", late).groupBy("unit").applyInPandasWithState(serve, OUTCOME, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def replay(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, exactly once, into a table in the shared folder, and read it."""
    out, log = scratch_path(spark, name), scratch_path(spark, f"{name}-log")
    stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)
