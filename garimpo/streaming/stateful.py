"""Stateful operators over event streams, with a batch form of each for replay and verification."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garimpo.operators.blocks import carried


def admit(times: list[float], kept: list[float], most: int, window: float) -> tuple[list[bool], list[float]]:
    """Sliding window limit: which times are let in. Refused ones are not counted."""
    out = []
    for t in times:
        kept = [x for x in kept if x > t - window]
        ok = len(kept) < most
        if ok:
            kept.append(t)
        out.append(ok)
    return out, kept


def _with_before(rows: DataFrame, key: str, order: str, stretch: float) -> DataFrame:
    """rows with before_us, the time of the key's row before, found by stretches of time, so that no key is gathered whole."""
    return carried(rows, key, "us", ["us", order], {"before_us": F.col("us")}, strict=True, size=stretch * 1e6)


def rate_limit(events: DataFrame, key: str, at: str, order: str, most: int = 30, window: float = 60.0, stretch: float = 3600.0) -> DataFrame:
    """The events with ``allowed``. A key's events are cut into bursts that lie a window apart; these do not
    influence each other, so each is judged on its own and no key is gathered whole. stretch: seconds of a key
    that one task looks at when bursts are told apart."""
    us = F.unix_micros(F.col(at).cast("timestamp"))
    rows = _with_before(events.select(key, order, us.alias("us")), key, order, stretch)
    fresh = F.coalesce(F.col("us") - F.col("before_us") >= int(window * 1e6), F.lit(True))
    bursts = carried(rows, key, "us", ["us", order], {"burst": F.when(fresh, F.struct("us", order))}, size=stretch * 1e6)
    # A burst of no more events than the limit is let in whole, without Python.
    size = bursts.groupBy(key, "burst").agg(F.count("*").alias("n"))
    sized = bursts.join(size, [key, "burst"])
    calm = sized.filter(F.col("n") <= most).select(key, order, F.lit(True).alias("allowed"))

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["us", order])
        ok, _ = admit((pdf["us"] / 1e6).tolist(), [], most, window)
        return pd.DataFrame({key: pdf[key], order: pdf[order], "allowed": ok})

    kinds = dict(events.dtypes)
    busy = sized.filter(F.col("n") > most).withColumn("burst", F.to_json("burst")).groupBy(key, "burst").applyInPandas(judge, f"{key} {kinds[key]}, {order} {kinds[order]}, allowed boolean")
    return calm.unionByName(busy)


def rate_limit_stream(events: DataFrame, key: str, at: str, order: str, most: int = 30, window: float = 60.0) -> DataFrame:
    """The same on a stream: the state of a key is the times let in within the window, dropped after it."""
    schema = T.StructType([events.schema[key], events.schema[order], T.StructField("allowed", T.BooleanType())])
    state_schema = T.StructType([T.StructField("kept", T.ArrayType(T.DoubleType()))])

    def step(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values([at, order])
        ok, kept = admit([t.timestamp() for t in pdf[at]], kept, most, window)
        state.update((kept,))
        state.setTimeoutDuration(int(window * 1000))
        yield pd.DataFrame({key: pdf[key], order: pdf[order], "allowed": ok})

    return events.groupBy(key).applyInPandasWithState(step, schema, state_schema, "append", "ProcessingTimeTimeout")


def breaker(calls: list[tuple[float, bool]], failures: int = 3, reset: float = 60.0) -> list[str]:
    """State of a circuit breaker before each call (time, success): closed, open (the call is not made) or half_open."""
    out, count, opened = [], 0, None
    for t, ok in calls:
        if opened is not None and t - opened < reset:
            out.append("open")
            continue
        out.append("half_open" if opened is not None else "closed")
        if ok:
            count, opened = 0, None
        else:
            count += 1
            if count >= failures:
                opened = t
    return out


def breaker_states(calls: DataFrame, key: str, at: str, order: str, ok: str, failures: int = 3, reset: float = 60.0, stretch: float = 86_400.0) -> DataFrame:
    """The calls with ``state``. A success after a pause longer than the reset closes the breaker whatever came
    before; what follows it starts afresh. A key's history is cut there, and the cuts of a stretch of time (in
    seconds) are judged together, so no key is gathered whole."""
    us = F.unix_micros(F.col(at).cast("timestamp"))
    rows = _with_before(calls.select(key, order, us.alias("us"), F.col(ok).cast("boolean").alias("ok")), key, order, stretch)
    sure = F.coalesce((F.col("us") - F.col("before_us") >= int(reset * 1e6)) & F.col("ok"), F.lit(False))
    cut = carried(rows, key, "us", ["us", order], {"cut": F.when(sure, F.col("us"))}, strict=True, size=stretch * 1e6)
    parts = cut.withColumn("part", F.coalesce(F.floor(F.col("cut") / int(stretch * 1e6)), F.lit(-(2**62)))).drop("before_us", "cut")

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["us", order])
        return pd.DataFrame({key: pdf[key], order: pdf[order], "state": breaker(list(zip(pdf["us"] / 1e6, pdf["ok"])), failures, reset)})

    kinds = dict(calls.dtypes)
    return parts.groupBy(key, "part").applyInPandas(judge, f"{key} {kinds[key]}, {order} {kinds[order]}, state string")


# States of an ingestion job and their progress.
PROGRESS = {"queued": 5, "bronze_received": 20, "silver_processing": 45, "silver_extracted": 65, "gold_indexing": 85, "indexed": 100, "failed": 100}


def job_states(events: DataFrame, job: str, status: str, at: str, order: str) -> DataFrame:
    """Latest status and progress of each job; also the body of a foreachBatch over a stream of status events."""
    last = events.groupBy(job).agg(F.max_by(status, F.struct(at, order)).alias(status))
    progress = F.create_map(*[F.lit(x) for k, v in PROGRESS.items() for x in (k, v)])
    return last.withColumn("progress", F.coalesce(F.try_element_at(progress, F.col(status)), F.lit(0)))


def windowed(events: DataFrame, at: str, kind: str, value: str, length: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums by event-time window; with ``late`` the stream drops rows behind the watermark."""
    if late and events.isStreaming:
        events = events.withWatermark(at, late)
    w = F.window(at, length, slide) if slide else F.window(at, length)
    return events.groupBy(w.alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, at: str, key: str, gap: str) -> DataFrame:
    return events.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")
