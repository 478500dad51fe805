"""Plan generators: ordered conditions over the indicator columns; stops and targets refined by structure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.core import CONFIG, by_symbol, is_long, valid_plan


def _ohlc() -> tuple[Column, Column, Column, Column]:
    return F.col("open"), F.col("high"), F.col("low"), F.col("close")


def _bind(df: DataFrame, *names: str) -> DataFrame:
    """The same rows, with the named columns behind a generator: later filters and projections then use their values
    instead of being pushed below and repeating their expressions."""
    return df.select(*[x for x in df.columns if x not in names], F.inline(F.array(F.struct(*names))))


def _both(up: Column, down: Column) -> Column:
    """Long is tested first."""
    return F.when(F.coalesce(up, F.lit(False)), "LONG").when(F.coalesce(down, F.lit(False)), "SHORT")


def trend_breakout(p: dict) -> Column:
    o, h, lo, c = _ohlc()
    up, low = F.col(p.get("up", "donchian_up")), F.col(p.get("low", "donchian_low"))
    return _both((h > up) & (c > F.col("sma_200")), (lo < low) & (c < F.col("sma_200")))


def mean_reversion(p: dict) -> Column:
    o, h, lo, c = _ohlc()
    up = (c < F.col("bb_low")) & (F.col("zscore") <= -p["z"]) & (F.col("rsi_2") < p["rsi_low"]) & (c > F.col("sma_200"))
    return _both(up, (c > F.col("bb_up")) & (F.col("zscore") >= p["z"]) & (F.col("rsi_2") > p["rsi_high"]) & (c < F.col("sma_200")))


def macd_trend(p: dict) -> Column:
    o, h, lo, c = _ohlc()
    before = F.lag("macd_hist").over(by_symbol())
    up = (F.col("macd_hist") > 0) & (before <= 0) & (c > F.col("sma_200"))
    return _both(up, (F.col("macd_hist") < 0) & (before >= 0) & (c < F.col("sma_200")))


def dual_thrust(p: dict) -> Column:
    o, h, lo, c = _ohlc()
    thrust = F.col(p.get("thrust", "thrust"))
    up, down = h > o + p["k1"] * thrust, lo < o - p["k2"] * thrust
    if p["trend_filter"]:
        up, down = up & (c > F.col("sma_200")), down & (c < F.col("sma_200"))
    return _both(up, down)


def squeezed() -> Column:
    return F.coalesce((F.col("bb_up") < F.col("kc_up")) & (F.col("bb_low") > F.col("kc_low")), F.lit(False))


def squeeze_breakout(p: dict) -> Column:
    o, h, lo, c = _ohlc()
    off = F.coalesce(F.lag(squeezed()).over(by_symbol()), F.lit(False)) & ~squeezed()
    return _both(off & (c > F.col("sma_20")) & (c > F.col("sma_200")), off & (c < F.col("sma_20")) & (c < F.col("sma_200")))


#: name: (trigger, section of CONFIG, regime it prefers)
STRATEGIES: dict[str, tuple[Callable[[dict], Column], str, str]] = {
    "trend_breakout": (trend_breakout, "trend", "trending"),
    "mean_reversion": (mean_reversion, "mean_reversion", "ranging"),
    "macd_trend": (macd_trend, "macd", "trending"),
    "dual_thrust": (dual_thrust, "dual_thrust", "trending"),
    "squeeze_breakout": (squeeze_breakout, "squeeze", "trending"),
}


def nearest(levels: str, above: Column | None = None, below: Column | None = None) -> Column:
    """The lowest level over ``above``, or the highest under ``below``, within both if both are given; ``above`` leads."""
    ok = lambda v: (v > above if above is not None else F.lit(True)) & (v < below if below is not None else F.lit(True))
    return F.filter(levels, ok)


def add_stop_and_target(plans: DataFrame, stop: float | Column, reward: float | Column, structure: dict | None = None) -> DataFrame:
    """From side, entry, atr and the level arrays: the stop just beyond the nearest protective level if its risk is
    within bounds, else ATR-based; the target at ``reward`` risks, or just before a level that lies ahead of it."""
    s = structure
    sign = F.when(is_long(), 1.0).otherwise(-1.0)
    out = plans.withColumn("stop", F.col("entry") - sign * stop * F.col("atr")).withColumn("stop_level", F.lit(None).cast("double"))
    if s:
        level = F.when(is_long(), F.array_max(nearest("sup", below=F.col("entry")))).otherwise(F.array_min(nearest("res", above=F.col("entry"))))
        out = out.withColumn("_l", level).withColumn("_s", F.col("_l") - sign * s["buffer"] * F.col("atr"))
        risk = sign * (F.col("entry") - F.col("_s"))
        ok = F.coalesce((risk >= s["stop_min"] * F.col("atr")) & (risk <= s["stop_max"] * F.col("atr")), F.lit(False))
        out = _bind(out, "_l", "_s")
        out = out.withColumns({"stop": F.when(ok, F.col("_s")).otherwise(F.col("stop")), "stop_level": F.when(ok, F.col("_l"))}).drop("_l", "_s")
        out = _bind(out, "stop", "stop_level")
    out = out.withColumn("target", F.col("entry") + sign * reward * F.abs(F.col("entry") - F.col("stop"))).withColumn("target_level", F.lit(None).cast("double"))
    if s:
        level = F.when(is_long(), F.array_min(nearest("res", above=F.col("entry"), below=F.col("target")))).otherwise(
            F.array_max(nearest("sup", above=F.col("target"), below=F.col("entry")))
        )
        out = out.withColumn("_l", level).withColumn("_t", F.col("_l") - sign * s["buffer"] * F.col("atr"))
        gain = sign * (F.col("_t") - F.col("entry"))
        ok = F.coalesce((gain > 0) & (gain / F.nullif(F.abs(F.col("entry") - F.col("stop")), F.lit(0.0)) >= s["min_rr"]), F.lit(False))
        out = _bind(out, "_l", "_t")
        out = out.withColumns({"target": F.when(ok, F.col("_t")).otherwise(F.col("target")), "target_level": F.when(ok, F.col("_l"))}).drop("_l", "_t")
        out = _bind(out, "target", "target_level")
    return out.drop("sup", "res")


def plans(rows: DataFrame, strategy: str, params: dict | None = None, structure: dict | None = None) -> DataFrame:
    """(strategy, symbol, ts, idx, side, entry, stop, target, atr, levels): one row a bar that triggers a valid plan.
    ``rows`` have indicators, and structure arrays if ``structure`` is given."""
    trigger, section, _ = STRATEGIES[strategy]
    p = CONFIG[section] | (params or {})
    keep = ["symbol", "ts", "idx", "high", "low", "close", "atr", "sma_20"] + (["sup", "res"] if structure and strategy != "mean_reversion" else [])
    hit = _bind(rows.withColumn("side", trigger(p)).select(*keep, "sma_200", "side"), "side").where(F.col("side").isNotNull() & (F.col("atr") > 0) & F.col("sma_200").isNotNull()).select(*keep, "side")
    hit = hit.withColumn("entry", F.col("close"))
    if strategy == "mean_reversion":
        sign = F.when(is_long(), 1.0).otherwise(-1.0)
        out = hit.withColumns({"stop": F.col("entry") - sign * p["stop"] * F.col("atr"), "target": F.col("sma_20"), "stop_level": F.lit(None).cast("double"), "target_level": F.lit(None).cast("double")})
    else:
        out = add_stop_and_target(hit, p["stop"], p["reward"], structure)
    out = out.where(valid_plan()).withColumn("strategy", F.lit(strategy))
    return out.select("strategy", "symbol", "ts", "idx", "side", "entry", "stop", "target", "atr", "stop_level", "target_level")


def all_plans(rows: DataFrame, structure: dict | None = None) -> DataFrame:
    out = None
    for name in STRATEGIES:
        one = plans(rows, name, structure=structure)
        out = one if out is None else out.unionByName(one)
    return out


def structure_note() -> Column:
    """Names the levels that stop and target are anchored to."""
    return F.concat_ws("; ", F.when(F.col("stop_level").isNotNull(), F.format_string("stop beyond level %.4f", "stop_level")), F.when(F.col("target_level").isNotNull(), F.format_string("target before level %.4f", "target_level")))


def confluence(signals: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Adds how many strategies agree on a symbol's side (within the other keys, if given)."""
    return signals.withColumn("confluence", F.count("*").over(Window.partitionBy("symbol", "side", *(keys or []))))
