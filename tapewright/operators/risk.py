"""Sizing, confidence, gate, publishing, portfolio: column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.core import CONFIG, clip, is_long


def kelly(win_rate: Column, b: Column) -> Column:
    """w - (1 - w) / b within 0 and 1; 0 where b is not positive."""
    w = clip(win_rate)
    return F.when(b > 0, clip(w - (1 - w) / F.nullif(b, F.lit(0.0)))).otherwise(0.0)


def payoff_ratio(win_rate: Column, profit_factor: Column) -> Column:
    return F.when((win_rate > 0) & (win_rate < 1), profit_factor * (1 - win_rate) / F.nullif(win_rate, F.lit(0.0))).otherwise(0.0)


def add_size(rows: DataFrame, equity: float, risk_pct: float, kelly_part: float, max_kelly_pct: float) -> DataFrame:
    """Adds units, notional, risk_amount, kelly_used: the smaller of fixed-fractional and part-Kelly units."""
    risk = F.abs(F.col("entry") - F.col("stop"))
    used = F.least(kelly(F.col("win_rate"), payoff_ratio(F.col("win_rate"), F.col("profit_factor"))) * kelly_part, F.lit(max_kelly_pct / 100.0))
    ok = (F.col("entry") > 0) & (risk > 0)
    fixed, part = equity * risk_pct / 100.0 / F.nullif(risk, F.lit(0.0)), equity * F.col("kelly_used") / F.nullif(F.col("entry"), F.lit(0.0))
    out = rows.withColumn("kelly_used", F.when(ok, used).otherwise(0.0))
    out = out.withColumn("units", F.when(ok & (part > 0), F.least(fixed, part)).otherwise(0.0))
    return out.withColumn("notional", F.col("units") * F.col("entry")).withColumn("risk_amount", F.col("units") * risk)


def backtest_confidence() -> Column:
    return F.round(0.40 * clip((F.col("win_rate") - 0.35) / 0.40) + 0.35 * clip(F.col("profit_factor") - 1.0) + 0.25 * clip(F.col("sharpe") / 2.0), 3)


def combined_confidence() -> Column:
    """From the backtest, the bootstrap, the edge over the baseline, the last trades, and how many strategies agree."""
    edge = clip((F.col("win_prob") - F.col("baseline_win_prob")) / 0.25 + 0.5)
    late = F.when(F.col("oos_expectancy") > 0, 1.0).when(F.col("oos_expectancy") == 0, 0.5).otherwise(0.0)
    base = 0.35 * backtest_confidence() + 0.30 * clip(F.col("prob_profitable")) + 0.20 * edge + 0.15 * late
    bonus = F.least(F.lit(0.10), 0.05 * F.greatest(F.lit(0), F.col("confluence") - 1))
    return F.round(F.least(F.lit(1.0), base + bonus) + 1e-9, 3)  # sums of whole ten-thousandths: exact halves go up


def measured_edge(g: dict = CONFIG["gate"]) -> Column:
    """What the gate asks of a strategy's trades, and of its late ones if there are enough."""
    base = (F.col("trades") >= g["trades"]) & (F.col("win_rate") >= g["win_rate"]) & (F.col("profit_factor") >= g["pf"]) & (F.col("sharpe") >= g["sharpe"])
    late = (F.col("oos_trades") < g["oos_trades"]) | (F.col("oos_expectancy") > g["oos_expectancy"])
    return F.coalesce(base & late, F.lit(False))


def passes_gate(g: dict = CONFIG["gate"]) -> Column:
    return F.coalesce(measured_edge(g) & (F.col("prob_profitable") >= g["prob"]), F.lit(False))


def apply_short_policy(signals: DataFrame, mode: str = "forecast", asset_class: str = "iran") -> DataFrame:
    """Shorts of a class that can't be sold short: off drops them, forecast keeps them at size 0, trade leaves them."""
    short = (F.col("asset_class") == asset_class) & ~is_long()
    if mode == "off":
        return signals.where(~short).withColumn("forecast_only", F.lit(False))
    flag = short if mode == "forecast" else F.lit(False)
    out = signals.withColumn("forecast_only", flag)
    return out.withColumns({c: F.when(F.col("forecast_only"), 0.0).otherwise(F.col(c)) for c in ("units", "notional", "risk_amount") if c in signals.columns})


def add_execution(signals: DataFrame, equity: float, breakeven: float = 1.0) -> DataFrame:
    """Adds rr (reward over risk), equity_pct and risk_pct (of the equity; 0 without any), risk_free_at (where the move
    is ``breakeven`` times the risk)."""
    gap, sign = F.abs(F.col("entry") - F.col("stop")), F.when(is_long(), 1.0).otherwise(-1.0)
    share = lambda c: F.round(F.col(c) / equity * 100.0, 2) if equity > 0 else F.lit(0.0)
    return signals.withColumns({
        "rr": F.coalesce(F.round(F.abs(F.col("target") - F.col("entry")) / F.nullif(gap, F.lit(0.0)), 3), F.lit(0.0)), "equity_pct": share("notional"), "risk_pct": share("risk_amount"),
        "risk_free_at": F.round(F.col("entry") + sign * breakeven * gap, 6),
    })


def by_confidence(signals: DataFrame) -> DataFrame:
    """Published signals first, the surest of them before, with ``place`` from 1. A scan's signals are one row a strategy
    and symbol: the last step before they are shown."""
    order = Window.orderBy(F.desc("published"), F.desc("confidence"), "strategy", "symbol", "side")
    return signals.withColumn("place", F.row_number().over(order)).orderBy("place")


def publish(signals: DataFrame, floor: float = CONFIG["gate"]["confidence"]) -> DataFrame:
    return signals.where(F.col("forecast_only") | (F.col("confidence") >= floor)) if floor > 0 else signals


def portfolio(signals: DataFrame, equity: float, max_pct: float = 6.0, max_open: int = 5) -> DataFrame:
    """One row: counts, exposures, risk, risk by asset class, warnings. Two partial aggregates; one row a class."""
    by = signals.groupBy("asset_class").agg(
        F.count("*").alias("n"), F.count_if(is_long()).alias("longs"), F.sum(F.when(is_long(), F.col("notional")).otherwise(0.0)).alias("up"),
        F.sum(F.when(is_long(), 0.0).otherwise(F.col("notional"))).alias("down"), F.sum("risk_amount").alias("risk"),
    )
    z = lambda c: F.coalesce(F.sum(c), F.lit(0))
    one = by.agg(
        z("n").alias("n"), z("longs").alias("longs"), (z("n") - z("longs")).alias("shorts"), (z("up") + z("down")).cast("double").alias("gross"), (z("up") - z("down")).cast("double").alias("net"), z("risk").cast("double").alias("risk"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("asset_class", "risk")))).alias("risk_by_class"),
        F.array_sort(F.collect_list(F.when(F.col("n") > max_open, F.format_string("%d %s positions", "n", "asset_class")))).alias("crowded"),
    )
    pct = F.col("risk") / equity * 100.0 if equity > 0 else F.lit(0.0)
    one = one.withColumn("risk_pct", pct)
    skew = F.when((F.col("n") >= 4) & ((F.col("longs") == 0) | (F.col("shorts") == 0)), "all signals are on one side")
    over = F.when(F.col("risk_pct") > max_pct, F.format_string("risk at stop is %.1f%% of equity", "risk_pct"))
    return one.withColumn("warnings", F.array_compact(F.concat(F.array(over), F.col("crowded"), F.array(skew)))).drop("crowded")
