"""Exits, non-overlapping selection, R statistics, out-of-sample split."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.core import is_long

KEY = ["strategy", "symbol"]


def _following(plans: DataFrame, bars: DataFrame, max_hold: int) -> DataFrame:
    """Each plan with its bar and up to ``max_hold`` bars after it: an equi-join on the exploded positions."""
    at = plans.withColumn("j", F.explode(F.sequence(F.col("idx"), F.col("idx") + max_hold)))
    b = bars.select("symbol", F.col("idx").alias("j"), F.col("high").alias("bh"), F.col("low").alias("bl"), F.col("close").alias("bc"))
    return at.join(b, ["symbol", "j"])


def _exit(rows: DataFrame, key: list[str], hit: Column, price: Column, outcome: Column) -> DataFrame:
    """The first bar after the entry that hits, or else the last bar there is, at its close."""
    first = F.min(F.when((F.col("j") > F.col("idx")) & hit, F.struct("j", price.alias("price"), outcome.alias("outcome"))))
    last = F.max(F.struct("j", F.col("bc").alias("price"), F.lit("time").alias("outcome")))
    out = rows.groupBy(*key).agg(F.coalesce(first, last).alias("x")).select(*key, F.col("x.j").alias("exit_idx"), F.col("x.price").alias("exit"), F.col("x.outcome").alias("outcome"))
    sign = F.when(is_long(), 1.0).otherwise(-1.0)
    return out.withColumn("r", sign * (F.col("exit") - F.col("entry")) / F.abs(F.col("entry") - F.col("stop")))


def fixed_exits(plans: DataFrame, bars: DataFrame, max_hold: int = 60) -> DataFrame:
    """Stop (also if both are hit on one bar), target, or time."""
    key = [c for c in plans.columns if c not in ("stop_level", "target_level")]
    rows = _following(plans.select(*key), bars, max_hold)
    stop = F.when(is_long(), F.col("bl") <= F.col("stop")).otherwise(F.col("bh") >= F.col("stop"))
    goal = F.when(is_long(), F.col("bh") >= F.col("target")).otherwise(F.col("bl") <= F.col("target"))
    return _exit(rows, key, stop | goal, F.when(stop, F.col("stop")).otherwise(F.col("target")), F.when(stop, "stop").otherwise("target"))


def trailing_exits(plans: DataFrame, bars: DataFrame, trail: float = 3.0, max_hold: int = 60) -> DataFrame:
    """The stop follows the best price of the bars before by ``trail`` ATRs (a running extreme); no target."""
    key = [c for c in plans.columns if c not in ("stop_level", "target_level")]
    w = Window.partitionBy(*[c for c in ("strategy", "symbol", "idx", "side") if c in key]).orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    rows = _following(plans.select(*key), bars, max_hold)
    rows = rows.withColumn("trailed", F.when(is_long(), F.greatest(F.col("stop"), F.max("bh").over(w) - trail * F.col("atr"))).otherwise(F.least(F.col("stop"), F.min("bl").over(w) + trail * F.col("atr"))))
    hit = F.when(is_long(), F.col("bl") <= F.col("trailed")).otherwise(F.col("bh") >= F.col("trailed"))
    return _exit(rows, key, hit, F.col("trailed"), F.lit("trail"))


def select_trades(trades: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Trades that do not overlap: the first one, then the first after its exit, and so on. Streamed in order with
    the last exit as the only state."""
    rows = trades.repartition(*key).sortWithinPartitions(*key, "idx")
    names = trades.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, done = None, -1
        for pdf in batches:
            keep = np.zeros(len(pdf), bool)
            same = pd.Series(True, index=pdf.index[1:])
            for c in key:
                same &= pdf[c].iloc[1:].to_numpy() == pdf[c].iloc[:-1].to_numpy()
            cuts = [0, *(np.flatnonzero(~same.to_numpy()) + 1), len(pdf)] if len(pdf) else [0]
            first, last = pdf["idx"].to_numpy(), pdf["exit_idx"].to_numpy()
            for a, b in zip(cuts, cuts[1:]):
                now = tuple(pdf[c].iloc[a] for c in key)
                held, done = now, done if now == held else -1
                # From each trade that is taken to the first one after its exit.
                while (at := a + int(np.searchsorted(first[a:b], done, "right"))) < b:
                    keep[at], done = True, int(last[at])
            yield pdf[keep][names]

    return rows.mapInPandas(run, trades.schema)


def stats(trades: DataFrame, key: list[str] = KEY, order: str = "idx", r: str = "r", full_list: bool = False) -> DataFrame:
    """Trades, win rate, profit factor (999 without a loss), expectancy, mean over deviation times root n, maximum
    drawdown of the running sum from its own peak, total R: by key, rounded to 4 places."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = trades.withColumn("_e", F.sum(r).over(w))
    x = x.withColumn("_d", F.max("_e").over(w) - F.col("_e"))
    won, lost = F.sum(F.when(F.col(r) > 0, F.col(r)).otherwise(0.0)), -F.sum(F.when(F.col(r) <= 0, F.col(r)).otherwise(0.0))
    out = x.groupBy(*key).agg(
        F.count("*").alias("trades"), F.avg(F.when(F.col(r) > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.when(lost > 0, won / F.nullif(lost, F.lit(0.0))).otherwise(F.when(won > 0, 999.0).otherwise(0.0)).alias("profit_factor"),
        F.avg(r).alias("expectancy"), (F.coalesce(F.avg(r) / F.nullif(F.stddev_pop(r), F.lit(0.0)), F.lit(0.0)) * F.sqrt(F.count("*"))).alias("sharpe"), F.max("_d").alias("max_drawdown"), F.sum(r).alias("total_r"),
        *([F.transform(F.array_sort(F.collect_list(F.struct(order, r))), lambda s: F.round(s[r], 6)).alias("returns_r")] if full_list else []),
    )
    return out.withColumns({c: F.round(c, 4) for c in ("win_rate", "profit_factor", "expectancy", "sharpe", "max_drawdown", "total_r")})


def out_of_sample(trades: DataFrame, key: list[str] = KEY, order: str = "idx", split: float = 0.7, least: int = 4) -> DataFrame:
    """The statistics of each key's last trades, from position int(n * split) on; keys with under ``least`` trades
    have none."""
    w = Window.partitionBy(*key)
    x = trades.withColumn("_n", F.count("*").over(w)).withColumn("_k", F.row_number().over(w.orderBy(order)))
    return stats(x.where((F.col("_n") >= least) & (F.col("_k") > F.floor(F.col("_n") * F.lit(float(split))))).drop("_n", "_k"), key, order)


def backtest(plans: DataFrame, bars: DataFrame, trail: float | None = None, max_hold: int = 60) -> DataFrame:
    """The trades of each strategy and symbol, in turn."""
    done = trailing_exits(plans, bars, trail, max_hold) if trail else fixed_exits(plans, bars, max_hold)
    return select_trades(done)
