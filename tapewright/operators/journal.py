"""The signal journal as an append-only event log with a latest-state view; advice on open positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.core import CONFIG, is_long

SIGNAL = ["signal_id", "created_at", "symbol", "asset_class", "strategy", "side", "entry", "stop", "target"]


def number(plans: DataFrame) -> DataFrame:
    """Adds ``signal_id``, 1 onwards by symbol and bar: ranks within each symbol plus the number of plans of the symbols
    before it. Only these numbers, one row a symbol, are summed in one task."""
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = plans.groupBy(F.col("symbol").alias("_s")).agg(F.count("*").alias("_n")).select("_s", before.alias("_before"))
    ranked = plans.withColumn("signal_id", F.row_number().over(Window.partitionBy("symbol").orderBy("idx")))
    out = ranked.join(base, F.col("symbol").eqNullSafe(F.col("_s")))
    return out.withColumn("signal_id", F.col("signal_id") + F.col("_before")).drop("_s", "_before")


def latest(log: DataFrame) -> DataFrame:
    """One row a signal: its last event (status, closed_at, result_r). An event that closes wins over an opening."""
    last = F.max_by(F.struct("status", "closed_at", "result_r"), F.struct("at", (F.col("status") != "open").cast("int")))
    return log.groupBy(*SIGNAL).agg(last.alias("x")).select(*SIGNAL, "x.*")


def new_signals(signals: DataFrame, log: DataFrame, now: Column, cooldown_days: float = 3) -> DataFrame:
    """The events that open ``signals``, but for those with an open signal of the same symbol, strategy and side
    created within the cooldown."""
    recent = latest(log).where((F.col("status") == "open") & (F.col("created_at").cast("double") >= now.cast("timestamp").cast("double") - cooldown_days * 86400))
    fresh = signals.join(recent.select("symbol", "strategy", "side").distinct(), ["symbol", "strategy", "side"], "left_anti")
    return fresh.select(*SIGNAL, F.col("created_at").alias("at"), F.lit("open").alias("status"), F.lit(None).cast("timestamp").alias("closed_at"), F.lit(None).cast("double").alias("result_r"))


def hit(high: Column, low: Column) -> tuple[Column, Column]:
    """Whether a bar reaches the stop, the target."""
    return F.when(is_long(), low <= F.col("stop")).otherwise(high >= F.col("stop")), F.when(is_long(), high >= F.col("target")).otherwise(low <= F.col("target"))


def closing_events(resolved: DataFrame) -> DataFrame:
    """The events that close what ``resolve`` has closed, to be appended to the log; at the time of the deciding bar."""
    done = resolved.where(F.col("status") != "open")
    return done.select(*SIGNAL, F.coalesce("closed_at", "created_at").alias("at"), "status", "closed_at", "result_r")


def cleared(log: DataFrame, since: Column) -> DataFrame:
    """The log without signals created before ``since``: what a new log starts from."""
    return log.where(F.col("created_at") >= since)


#: Days of a bucket of bars, whose extremes tell whether a level is reached in it.
BUCKET_DAYS = 64


def resolve(open_signals: DataFrame, bars: DataFrame, now: Column, max_hold_days: int = 30) -> DataFrame:
    """``open_signals`` with status, closed_at and result_r by the bars after their creation: the first bar that hits
    (stop on a tie) decides; without one, age in whole days expires them at the last close. Signals without a later
    bar stay open.

    A signal meets its symbol's buckets of bars first, by their extremes, and then only the bars of its own bucket and of
    the first later one that reaches a level: an equi-join on symbol and bucket. No path is gathered."""
    bucket = lambda ts: F.floor(F.unix_seconds(ts) / (86400 * BUCKET_DAYS))
    b = bars.select(F.col("symbol").alias("_s"), F.col("ts").alias("_ts"), "high", "low", "close").withColumn("_b", bucket(F.col("_ts")))
    ends = b.groupBy("_s", "_b").agg(F.max("high").alias("high"), F.min("low").alias("low"), F.max(F.struct("_ts", "close")).alias("end"))
    s = open_signals.select("signal_id", "symbol", "created_at", "side", "stop", "target", bucket(F.col("created_at")).alias("_own"))
    stop, goal = hit(F.col("high"), F.col("low"))
    met = s.join(ends, (F.col("symbol") == F.col("_s")) & (F.col("_b") >= F.col("_own"))).where(F.col("end._ts") > F.col("created_at"))
    met = met.groupBy("signal_id", "symbol", "created_at", "side", "stop", "target", "_own").agg(F.min(F.when((F.col("_b") > F.col("_own")) & (stop | goal), F.col("_b"))).alias("_first"), F.max("end").alias("l"))
    near = met.withColumn("_b", F.explode(F.array_compact(F.array("_own", "_first")))).drop("l").withColumnRenamed("symbol", "_s")
    rows = near.join(b, ["_s", "_b"]).where(F.col("_ts") > F.col("created_at"))
    first = F.min(F.when(stop | goal, F.struct("_ts", F.when(stop, "sl").otherwise("tp").alias("status"))))
    seen = met.select("signal_id", "l").join(rows.groupBy("signal_id").agg(first.alias("f")), "signal_id", "left")
    out = open_signals.join(seen, "signal_id", "left")
    risk = F.abs(F.col("entry") - F.col("stop"))
    r = F.when(F.col("f.status") == "sl", -1.0).otherwise(F.coalesce(F.abs(F.col("target") - F.col("entry")) / F.nullif(risk, F.lit(0.0)), F.lit(0.0)))
    age = F.floor((F.unix_seconds(now.cast("timestamp")) - F.unix_seconds("created_at")) / 86400)
    move = F.when(is_long(), F.col("l.close") - F.col("entry")).otherwise(F.col("entry") - F.col("l.close"))
    expired = F.col("l").isNotNull() & (age >= max_hold_days)
    return out.select(
        *[c for c in open_signals.columns if c not in ("status", "closed_at", "result_r")],
        F.when(F.col("f").isNotNull(), F.col("f.status")).when(expired, "expired").otherwise("open").alias("status"),
        F.when(F.col("f").isNotNull(), F.col("f._ts")).when(expired, F.col("l._ts")).alias("closed_at"),
        F.when(F.col("f").isNotNull(), r).when(expired, F.coalesce(F.round(move / F.nullif(risk, F.lit(0.0)), 4), F.lit(0.0))).alias("result_r"),
    )


def performance(state: DataFrame) -> DataFrame:
    closed = F.col("status").isin("tp", "sl", "expired")
    n = F.count_if(closed)
    out = state.agg(
        F.count("*").alias("total"), (F.count("*") - n).alias("open"), n.alias("closed"), F.count_if(F.col("status") == "tp").alias("tp"), F.count_if(F.col("status") == "sl").alias("sl"),
        F.coalesce(F.count_if(F.col("status") == "tp") / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("win_rate"), F.coalesce(F.avg(F.when(closed, F.col("result_r"))), F.lit(0.0)).alias("avg_r"), F.coalesce(F.sum(F.when(closed, F.col("result_r"))), F.lit(0.0)).alias("total_r"),
    )
    return out.withColumns({c: F.round(c, 4) for c in ("win_rate", "avg_r", "total_r")})


def review(positions: DataFrame, p: dict = CONFIG["manage"]) -> DataFrame:
    """Advice on open positions, from side, entry, stop, target, current, atr, ma_trend, macd_hist, hi_since,
    lo_since, next_level: r_now, recommended stop and take-profit with its reason, four flags."""
    sign = F.when(is_long(), 1.0).otherwise(-1.0)
    risk = F.abs(F.col("entry") - F.col("stop"))
    ok = (risk > 0) & (F.col("atr") > 0)
    best = lambda a, b: F.when(is_long(), F.greatest(a, b)).otherwise(F.least(a, b))
    out = positions.withColumn("r_now", F.when(ok, sign * (F.col("current") - F.col("entry")) / F.nullif(risk, F.lit(0.0))).otherwise(0.0))
    locked = ok & (F.col("r_now") >= p["breakeven"])
    out = out.withColumn("_sl", F.when(locked, best(F.col("stop"), F.col("entry"))).otherwise(F.col("stop")))
    trail = F.when(is_long(), F.col("hi_since")).otherwise(F.col("lo_since")) - sign * p["trail"] * F.col("atr")
    out = out.withColumn("_trail", trail).withColumn("at_breakeven", locked & (F.col("_sl") == F.col("entry")))
    out = out.withColumn("trailed", F.coalesce(locked & (sign * (F.col("_trail") - F.col("_sl")) > 0) & (sign * (F.col("current") - F.col("_trail")) > 0), F.lit(False)))
    out = out.withColumn("recommended_sl", F.round(F.when(F.col("trailed"), F.col("_trail")).otherwise(F.col("_sl")), 6))
    past = sign * (F.col("current") - F.col("target")) >= 0
    out = out.withColumn("_past", ok & past).withColumn("near_target", ok & (past | (F.abs(F.col("target") - F.col("current")) <= p["near"] * F.col("atr"))))
    out = out.withColumn("danger", ok & F.coalesce((sign * (F.col("current") - F.col("ma_trend")) < 0) | (sign * F.col("macd_hist") < 0), F.lit(False)))
    level = F.col("next_level") - sign * p["buffer"] * F.col("atr")
    ahead = (sign * (F.col("next_level") - F.col("current")) > 0) & (sign * (F.col("target") - F.col("next_level")) > 0) & (sign * (level - F.col("current")) > 0)
    reason = F.when(~ok, "").when(F.col("_past"), "target reached").when(F.col("danger"), "thesis weakening").when(F.col("near_target"), "in the target zone").when(ahead, "level ahead").otherwise("let it run")
    out = out.withColumn("tp_reason", reason)
    tp = F.when(F.col("tp_reason").isin("target reached", "thesis weakening"), F.col("current")).when(F.col("tp_reason") == "level ahead", level).otherwise(F.col("target"))
    out = out.withColumn("recommended_tp", F.round(tp, 6)).withColumn("r_now", F.round("r_now", 2))
    return out.withColumn("actionable", F.col("at_breakeven") | F.col("trailed") | F.col("near_target") | F.col("danger")).drop("_sl", "_trail", "_past")


def extremes_since(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """(signal_id, hi_since, lo_since): extremes of the bars after each signal. A signal meets the bars of its own bucket of
    time, and one row of its symbol: the extremes of all later buckets, running from the last one back."""
    bucket = lambda ts: F.floor(F.unix_seconds(ts) / (86400 * BUCKET_DAYS))
    b = bars.select(F.col("symbol").alias("_s"), F.col("ts").alias("_ts"), "high", "low").withColumn("_b", bucket(F.col("_ts")))
    s = signals.withColumn("_own", bucket(F.col("created_at")))
    ends = b.groupBy("_s", "_b").agg(F.max("high").alias("high"), F.min("low").alias("low"))
    asked = s.select(F.col("symbol").alias("_s"), F.col("_own").alias("_b"), F.lit(None).cast("double").alias("high"), F.lit(None).cast("double").alias("low")).distinct()
    ends = ends.unionByName(asked).groupBy("_s", "_b").agg(F.max("high").alias("high"), F.min("low").alias("low"))
    w = Window.partitionBy("_s").orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    later = ends.select("_s", "_b", F.max("high").over(w).alias("high"), F.min("low").over(w).alias("low"))
    same = (F.col("symbol") == F.col("_s")) & (F.col("_own") == F.col("_b"))
    met = s.join(later, same).select("signal_id", "high", "low").unionByName(s.join(b, same & (F.col("_ts") > F.col("created_at"))).select("signal_id", "high", "low"))
    return met.groupBy("signal_id").agg(F.max("high").alias("hi_since"), F.min("low").alias("lo_since"))


def open_positions(state: DataFrame, rows: DataFrame) -> DataFrame:
    """Open signals with what ``review`` needs: the last bar's columns, extremes since creation, the next level."""
    last = rows.groupBy("symbol").agg(F.max_by(F.struct("close", F.col("high").alias("last_high"), F.col("low").alias("last_low"), "atr", "sma_200", "macd_hist", "sup", "res"), "ts").alias("x")).select(F.col("symbol").alias("_s"), "x.*")
    since = extremes_since(state.where("status = 'open'").select("signal_id", "symbol", "created_at"), rows)
    out = state.where("status = 'open'").join(last, F.col("symbol") == F.col("_s")).join(since, "signal_id", "left")
    cur = F.col("close")
    out = out.withColumns({"hi_since": F.coalesce("hi_since", "last_high"), "lo_since": F.coalesce("lo_since", "last_low"), "current": cur, "ma_trend": F.col("sma_200"),
                           "next_level": F.when(is_long(), F.array_min(F.filter("res", lambda v: v > cur))).otherwise(F.array_max(F.filter("sup", lambda v: v < cur)))})
    return out.drop("_s", "close", "last_high", "last_low", "sma_200", "sup", "res")
