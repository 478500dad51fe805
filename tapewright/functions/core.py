"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Thresholds that results depend on (fixed values of the method's default configuration).
CONFIG: dict[str, dict] = {
    "trend": {"donchian": 20, "ma": 200, "stop": 2.5, "reward": 2.0},
    "mean_reversion": {"bb": 20, "k": 2.0, "z": 2.0, "rsi_low": 10.0, "rsi_high": 90.0, "ma": 200, "stop": 3.0},
    "macd": {"fast": 12, "slow": 26, "signal": 9, "ma": 200, "stop": 2.5, "reward": 2.0},
    "dual_thrust": {"bars": 4, "k1": 0.5, "k2": 0.5, "ma": 200, "stop": 2.0, "reward": 2.0, "trend_filter": True},
    "squeeze": {"bb": 20, "k": 2.0, "keltner": 1.5, "ma": 200, "stop": 1.5, "reward": 3.0},
    "structure": {"width": 3, "buffer": 0.25, "lookback": 120, "min_rr": 0.8, "stop_min": 0.8, "stop_max": 4.0},
    "regime": {"trend": 25.0, "range": 20.0},
    "exits": {"max_hold": 60, "trail": 3.0},
    "pairs": {"lookback": 252, "p_max": 0.05, "entry": 2.0, "exit": 0.5, "stop": 3.5},
    "factor": {"lookback": 126, "skip": 21, "hold": 21, "top": 2, "bottom": 2, "stop": 3.0, "reward": 2.0, "min_trades": 24, "min_win_rate": 0.45, "min_pf": 1.15},
    "ml": {"horizon": 10, "k": 1.5, "min_train": 250, "refit": 42, "threshold": 0.58},
    "journal": {"cooldown_days": 3, "max_hold_days": 30},
    "manage": {"breakeven": 1.0, "trail": 3.0, "near": 0.5, "buffer": 0.25},
    "risk": {"equity": 10000.0, "risk_pct": 1.0, "kelly": 0.5, "max_kelly_pct": 5.0, "portfolio_max_pct": 6.0, "max_open": 5},
    "gate": {"trades": 15, "win_rate": 0.40, "pf": 1.40, "sharpe": 0.5, "prob": 0.68, "ruin": 10.0, "split": 0.7, "oos_trades": 4, "oos_expectancy": 0.0, "confidence": 0.62},
}

def by_symbol():
    return Window.partitionBy("symbol").orderBy("ts")


def over(n: int, ahead: int = 0, keys: tuple[str, ...] = ("symbol",)):
    """The last n bars, the current one included; ``ahead`` shifts the frame (negative: into the past)."""
    return Window.partitionBy(*keys).orderBy("ts").rowsBetween(ahead - n + 1, ahead)


def full(value: Column, count: Column, n: int) -> Column:
    """``value`` once n bars are there, else null."""
    return F.when(count == n, value)


def clip(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), x))


def is_long() -> Column:
    return F.col("side") == "LONG"


def valid_plan() -> Column:
    """A plan's stop, entry and target are finite and in order for its side."""
    finite = [F.abs(F.col(c)) < float("inf") for c in ("stop", "entry", "target")]
    up = (F.col("stop") < F.col("entry")) & (F.col("entry") < F.col("target"))
    down = (F.col("target") < F.col("entry")) & (F.col("entry") < F.col("stop"))
    return F.coalesce(F.when(is_long(), up).otherwise(down) & finite[0] & finite[1] & finite[2], F.lit(False))


def price_text(x: Column) -> Column:
    """1000 and over with 2 decimals, 1 and over with at most 4, else at most 6 (trailing zeros trimmed)."""
    trim = lambda c: F.rtrim(F.regexp_replace(F.regexp_replace(c, ",", ""), r"(\.\d*?)0+$", "$1"))
    bare = lambda c: F.regexp_replace(trim(c), r"\.$", "")
    return F.when(F.abs(x) >= 1000, F.format_number(x, 2)).when(F.abs(x) >= 1, bare(F.format_number(x, 4))).otherwise(bare(F.format_number(x, 6)))


def meter(x: Column, width: int = 10) -> Column:
    """A bar of ``width`` glyphs for a value of 0 to 1; null for null."""
    n = F.round(clip(x) * width).cast("int")
    return F.when(x.isNotNull(), F.concat(F.repeat(F.lit("#"), n), F.repeat(F.lit("-"), F.lit(width) - n)))
