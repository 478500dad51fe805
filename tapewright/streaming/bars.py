"""Structured Streaming: bars from event streams, open positions as keyed state."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` or the context's checkpoint folder; where neither is set, a temporary folder in local
    mode, where all tasks run on one machine, and an error on a cluster."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="stream-")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: what is used many times is computed once."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, with instants for times (watermarks need them)."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_bars(events: DataFrame, width: str = "1 hour", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Bars of tumbling (or sliding) windows, within the watermark."""
    order = F.struct("ts", "event_id")
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide) if slide else F.window("ts", width), F.col("event_type").alias("symbol"))
    agg = g.agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").cast("double").alias("volume"))
    return agg.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def stream_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(user_id, start, end, events): activity sessions."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def stream_distinct(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The stream's rows, those that repeat ``keys`` within the watermark once; keys older than it are forgotten."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Runs the stream over what is there, batch by batch, into the shared folder, and returns each key's last row."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    values = [c for c in stream.columns if c not in keys]

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("_batch", F.lit(n)).write.mode("append").parquet(f"{base}/out")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    rows = spark.read.schema(stream.withColumn("_batch", F.lit(0)).schema).parquet(f"{base}/out")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("x")).select(*keys, "x.*")


def track_positions(bars: DataFrame, positions: DataFrame, max_hold_days: int = 30) -> DataFrame:
    """(signal_id, status, closed_at, result_r): positions that the bars' stream closes: stop first, then target,
    else expiry at the close of the first bar at that age. The state is one row a position; closed ones keep a mark."""
    rows = bars.select("symbol", F.col("ts").alias("bar_ts"), "high", "low", "close").join(positions.select("signal_id", "symbol", "created_at", "side", "entry", "stop", "target"), "symbol")

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done = state.exists and state.get[0]
        for pdf in pdfs:
            pdf = pdf[pdf["bar_ts"] > pdf["created_at"]].sort_values("bar_ts")
            if done or pdf.empty:
                continue
            sign = np.where(pdf["side"] == "LONG", 1.0, -1.0)
            worst, best = np.where(sign > 0, pdf["low"], -pdf["high"]), np.where(sign > 0, pdf["high"], -pdf["low"])
            sl, tp = worst <= sign * pdf["stop"].to_numpy(), best >= sign * pdf["target"].to_numpy()
            ends = np.flatnonzero(sl | tp | ((pdf["bar_ts"] - pdf["created_at"]).dt.days >= max_hold_days).to_numpy())
            if len(ends):
                k, done = ends[0], True
                x = pdf.iloc[k]
                risk = abs(x.entry - x.stop)
                status = "sl" if sl[k] else "tp" if tp[k] else "expired"
                r = -1.0 if sl[k] else 0.0 if not risk else abs(x.target - x.entry) / risk if tp[k] else round(sign[k] * (x.close - x.entry) / risk, 4)
                yield pd.DataFrame([(key[0], status, x.bar_ts, r)], columns=["signal_id", "status", "closed_at", "result_r"])
        state.update((bool(done),))

    return rows.groupBy("signal_id").applyInPandasWithState(step, "signal_id long, status string, closed_at timestamp, result_r double", "done boolean", "update", GroupStateTimeout.NoTimeout)
