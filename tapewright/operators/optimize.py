"""Walk-forward grid search: the grid's rows ride along as a column of one plan."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.core import CONFIG, full, is_long, over, valid_plan
from tapewright.operators.backtest import fixed_exits, out_of_sample, select_trades, stats
from tapewright.operators.indicators import add_indicators
from tapewright.operators.strategies import STRATEGIES, add_stop_and_target
from tapewright.sources.bars import tail

#: Fixed grids: frames and thresholds of the trigger, multiples of stop and reward.
GRIDS: dict[str, dict[str, tuple]] = {
    "trend_breakout": {"donchian": (10, 20, 40), "stop": (2.0, 2.5, 3.0), "reward": (1.5, 2.0, 3.0)},
    "mean_reversion": {"z": (1.5, 2.0, 2.5), "stop": (2.5, 3.0, 3.5)},
    "macd_trend": {"stop": (2.0, 2.5, 3.0), "reward": (1.5, 2.0, 3.0)},
    "dual_thrust": {"bars": (3, 4, 5), "k1": (0.4, 0.5, 0.7), "stop": (1.5, 2.0, 2.5)},
    "squeeze_breakout": {"stop": (1.0, 1.5, 2.0), "reward": (2.0, 3.0, 4.0)},
}


#: Parameters that the trigger depends on; the others (stop, reward) come after it.
OF_TRIGGER = ("donchian", "z", "bars", "k1")


def _channels(rows: DataFrame, grid: dict[str, tuple]) -> DataFrame:
    """The trigger's channels over the grid's numbers of bars: windows of the rows' one partitioning and order."""
    new = {}
    for n in grid.get("donchian", ()):
        k = F.count("close").over(over(n, -1))
        new |= {f"up_{n}": full(F.max("high").over(over(n, -1)), k, n), f"low_{n}": full(F.min("low").over(over(n, -1)), k, n)}
    for n in grid.get("bars", ()):
        w = over(n, -1)
        new[f"thrust_{n}"] = full(F.greatest(F.max("high").over(w) - F.min("close").over(w), F.max("close").over(w) - F.min("low").over(w)), F.count("close").over(w), n)
    return rows.withColumns(new) if new else rows


def _combos(grid: dict[str, tuple], names: list[str]) -> list[dict]:
    return [dict(zip(names, v, strict=True)) for v in itertools.product(*(grid[n] for n in names))]


def grid_plans(rows: DataFrame, strategy: str) -> DataFrame:
    """Plans of every combination of the strategy's grid, with ``params``. One pass over the rows: sides by the trigger's
    parameters are columns, and rows that trigger are repeated for the rest of the grid."""
    grid = GRIDS[strategy]
    trigger, section, _ = STRATEGIES[strategy]
    first, rest = (_combos(grid, [n for n in grid if (n in OF_TRIGGER) == of]) for of in (True, False))
    wide = _channels(rows, grid)
    sides = {}
    for k, combo in enumerate(first):
        p = CONFIG[section] | combo | ({"k2": combo["k1"]} if "k1" in combo else {})
        if "donchian" in combo:
            p |= {"up": f"up_{combo['donchian']}", "low": f"low_{combo['donchian']}"}
        if "bars" in combo:
            p["thrust"] = f"thrust_{combo['bars']}"
        sides[f"side_{k}"] = trigger(p)
    keep = ["symbol", "ts", "idx", "close", "atr", "sma_20"]
    hit = wide.withColumns(sides).where((F.col("atr") > 0) & F.col("sma_200").isNotNull())
    text = lambda c: ",".join(f"{n}={v}" for n, v in c.items())
    hit = hit.select(*keep, F.inline(F.array(*[F.struct(F.lit(text(c)).alias("p1"), F.col(f"side_{k}").alias("side")) for k, c in enumerate(first)]))).where("side IS NOT NULL")
    after = [F.struct(F.lit(text(c)).alias("p2"), F.lit(float(c["stop"])).alias("p_stop"), F.lit(float(c.get("reward", 0.0))).alias("p_reward")) for c in rest]
    hit = hit.select("*", F.inline(F.array(*after))).withColumn("entry", F.col("close"))
    if strategy == "mean_reversion":
        sign = F.when(is_long(), 1.0).otherwise(-1.0)
        out = hit.withColumns({"stop": F.col("entry") - sign * F.col("p_stop") * F.col("atr"), "target": F.col("sma_20")})
    else:
        reward = F.col("p_reward") if "reward" in grid else F.lit(float(CONFIG[section]["reward"]))
        out = add_stop_and_target(hit, F.col("p_stop"), reward)
    params = F.concat_ws(",", F.nullif("p1", F.lit("")), F.nullif("p2", F.lit("")))
    return out.where(valid_plan()).select(F.lit(strategy).alias("strategy"), params.alias("params"), "symbol", "ts", "idx", "side", "entry", "stop", "target", "atr")


def grid_search(rows: DataFrame, strategy: str, split: float = 0.7, min_trades: int = 10, min_oos: int = 3, max_hold: int = 60) -> DataFrame:
    """(strategy, symbol, params, trades, win_rate, expectancy, oos_trades, oos_expectancy, score, place): one row a symbol
    and combination that trades, scored by the expectancy of its last trades, or minus infinity where there are too few
    trades. ``place`` orders a symbol's rows by score, then expectancy, best first. Structure and trailing exits are not
    used."""
    key = ["strategy", "symbol", "params"]
    trades = select_trades(fixed_exits(grid_plans(rows, strategy), rows, max_hold), key)
    late = out_of_sample(trades, key, split=split).select(*key, F.col("trades").alias("oos_trades"), F.col("expectancy").alias("oos_expectancy"))
    both = stats(trades, key).join(late, key, "left").fillna({"oos_trades": 0, "oos_expectancy": 0.0})
    enough = (F.col("trades") >= min_trades) & (F.col("oos_trades") >= min_oos)
    out = both.select(*key, "trades", "win_rate", "expectancy", "oos_trades", "oos_expectancy", F.when(enough, F.col("oos_expectancy")).otherwise(float("-inf")).alias("score"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("strategy", "symbol").orderBy(F.desc("score"), F.desc("expectancy"), "params")))


def optimize_symbol(bars: DataFrame, symbol: str, strategy: str, lookback: int = 1250, **params) -> DataFrame:
    """One symbol's grid over its last ``lookback`` bars, best first."""
    return grid_search(add_indicators(tail(bars.where(F.col("symbol") == symbol), lookback)), strategy, **params).orderBy("place")
