"""Indicators over bars: window frames for what has a finite memory, one streamed pass for recursive averages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tapewright.functions.core import by_symbol, full, over

_PREV = ("open", "high", "low", "close")


def add_window_indicators(bars: DataFrame) -> DataFrame:
    """Adds every indicator of finite memory; null while a window is not full. All frames share one partitioning and
    order, so the plan has one shuffle and one sort."""
    c, h, lo = F.col("close"), F.col("high"), F.col("low")
    out = bars.withColumns({
        "idx": F.row_number().over(by_symbol()) - 1,
        **{f"prev_{x}": F.lag(x).over(by_symbol()) for x in _PREV},
        "high_2": F.lag("high", 2).over(by_symbol()), "low_2": F.lag("low", 2).over(by_symbol()),
        **{f"n{n}": F.count("close").over(over(n)) for n in (20, 50, 200)},
        **{f"p{n}": F.count("close").over(over(n, -1)) for n in (4, 20)},
        **{f"sma_{n}": F.avg("close").over(over(n)) for n in (20, 50, 200)},
        "std_20": F.stddev_pop("close").over(over(20)),
        "donchian_up": F.max("high").over(over(20, -1)), "donchian_low": F.min("low").over(over(20, -1)),
        "hh": F.max("high").over(over(4, -1)), "hc": F.max("close").over(over(4, -1)), "lc": F.min("close").over(over(4, -1)), "ll": F.min("low").over(over(4, -1)),
        "mid_n": F.count("close").over(over(7, 3)), "mid_low": F.min("low").over(over(7, 3)), "mid_high": F.max("high").over(over(7, 3)),
    })
    out = out.withColumns({
        **{f"sma_{n}": full(F.col(f"sma_{n}"), F.col(f"n{n}"), n) for n in (20, 50, 200)},
        "std_20": full(F.col("std_20"), F.col("n20"), 20),
        **{x: full(F.col(x), F.col("p20"), 20) for x in ("donchian_up", "donchian_low")},
        "thrust": full(F.greatest(F.col("hh") - F.col("lc"), F.col("hc") - F.col("ll")), F.col("p4"), 4),
        "tr": F.greatest(h - lo, F.abs(h - F.col("prev_close")), F.abs(lo - F.col("prev_close"))),
        "change": c - F.col("prev_close"),
        "log_return": F.when((F.col("prev_close") > 0) & (c > 0), F.ln(c / F.nullif(F.col("prev_close"), F.lit(0.0)))),
        "piv_low": F.when((F.col("mid_n") == 7) & (lo == F.col("mid_low")), lo),
        "piv_high": F.when((F.col("mid_n") == 7) & (h == F.col("mid_high")), h),
        "fvg_sup": F.when(lo > F.col("high_2"), F.col("high_2")), "fvg_res": F.when(h < F.col("low_2"), F.col("low_2")),
        "ob_sup": F.when((c > F.col("prev_high")) & (F.col("prev_close") < F.col("prev_open")), F.col("prev_low")),
        "ob_res": F.when((c < F.col("prev_low")) & (F.col("prev_close") > F.col("prev_open")), F.col("prev_high")),
    })
    up, down = h - F.col("prev_high"), F.col("prev_low") - lo
    out = out.withColumns({
        "bb_up": F.col("sma_20") + 2.0 * F.col("std_20"), "bb_low": F.col("sma_20") - 2.0 * F.col("std_20"),
        "zscore": (c - F.col("sma_20")) / F.nullif(F.col("std_20"), F.lit(0.0)),
        "gain": F.when(F.col("change").isNotNull(), F.greatest(F.col("change"), F.lit(0.0))),
        "loss": F.when(F.col("change").isNotNull(), F.greatest(-F.col("change"), F.lit(0.0))),
        "plus_dm": F.coalesce(F.when((up > down) & (up > 0), up), F.lit(0.0)), "minus_dm": F.coalesce(F.when((down > up) & (down > 0), down), F.lit(0.0)),
        "returns_n": F.count("log_return").over(over(20)), "realized_vol": F.stddev_pop("log_return").over(over(20)) * F.sqrt(F.lit(252.0)),
        "drift_n": F.count("change").over(over(14)), "drift": F.avg("change").over(over(14)),
    })
    out = out.withColumn("realized_vol", full(F.col("realized_vol"), F.col("returns_n"), 20)).withColumn("drift", F.coalesce(full(F.col("drift"), F.col("drift_n"), 14), F.lit(0.0)))
    return out.drop("n20", "n50", "n200", "p4", "p20", "hh", "hc", "lc", "ll", "mid_n", "mid_low", "mid_high", "high_2", "low_2", "returns_n", "drift_n")


#: name: (input, alpha, observations until it shows)
AVERAGES = {
    "atr": ("tr", 1 / 14, 14), "atr_10": ("tr", 1 / 10, 10), "gain_14": ("gain", 1 / 14, 14), "loss_14": ("loss", 1 / 14, 14), "gain_2": ("gain", 1 / 2, 2), "loss_2": ("loss", 1 / 2, 2),
    "ema_12": ("close", 2 / 13, 12), "ema_26": ("close", 2 / 27, 26), "ema_20": ("close", 2 / 21, 20), "plus_14": ("plus_dm", 1 / 14, 14), "minus_14": ("minus_dm", 1 / 14, 14),
    "macd_signal": ("macd", 2 / 10, 9), "adx": ("dx", 1 / 14, 14),
}
RECURSIVE = ("atr", "rsi", "rsi_2", "macd", "macd_signal", "macd_hist", "ema_20", "kc_up", "kc_low", "adx")


def exponential_mean(x: np.ndarray, alpha: float, shows: int, state: tuple[float, int, int] | None) -> tuple[np.ndarray, tuple[float, int, int] | None]:
    """The recursion y = alpha x + (1 - alpha) y from the first value on, null until ``shows`` values. ``state``
    carries (y, missing values since, values seen) from one batch of a symbol to its next one."""
    value, gap, seen = state or (np.nan, 0, 0)
    head = [value, *[np.nan] * gap] if seen else []
    y = pd.Series(np.concatenate([head, x])).ewm(alpha=alpha, adjust=False).mean().to_numpy()[len(head) :]
    there = ~np.isnan(x)
    count = seen + np.cumsum(there)
    if there.any():
        last = int(np.flatnonzero(there)[-1])
        state = (float(y[last]), len(x) - 1 - last, int(count[-1]))
    elif seen:
        state = (value, gap + len(x), seen)
    return np.where(count >= shows, y, np.nan), state


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, states = None, {}
    for pdf in batches:
        out = {c: np.full(len(pdf), np.nan) for c in RECURSIVE}
        symbol = pdf["symbol"].to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]])) if len(pdf) else []
        for a, b in zip(cuts, [*cuts[1:], len(pdf)], strict=True):
            if symbol[a] != held:
                held, states = symbol[a], {}
            v = {c: pdf[c].to_numpy(float)[a:b] for c in ("tr", "gain", "loss", "close", "plus_dm", "minus_dm")}

            def mean(name: str) -> np.ndarray:
                source, alpha, shows = AVERAGES[name]
                y, states[name] = exponential_mean(v[source], alpha, shows, states.get(name))
                return y

            with np.errstate(all="ignore"):
                r = {"atr": mean("atr"), "ema_20": mean("ema_20")}
                for name, n in (("rsi", 14), ("rsi_2", 2)):
                    g, ls = mean(f"gain_{n}"), mean(f"loss_{n}")
                    r[name] = np.where(ls == 0, np.where(np.isnan(g), np.nan, 100.0), np.where(g == 0, 0.0, 100 - 100 / (1 + g / ls)))
                    r[name][np.isnan(g) | np.isnan(ls)] = np.nan
                v["macd"] = r["macd"] = mean("ema_12") - mean("ema_26")
                r["macd_signal"] = mean("macd_signal")
                r["macd_hist"] = r["macd"] - r["macd_signal"]
                band = 1.5 * mean("atr_10")
                r["kc_up"], r["kc_low"] = r["ema_20"] + band, r["ema_20"] - band
                atr = np.where(r["atr"] == 0, np.nan, r["atr"])
                plus, minus = 100 * mean("plus_14") / atr, 100 * mean("minus_14") / atr
                v["dx"] = 100 * np.abs(plus - minus) / np.where(plus + minus == 0, np.nan, plus + minus)
                r["adx"] = mean("adx")
            for c, x in r.items():
                out[c][a:b] = x
        yield pdf.assign(**out)


def add_recursive_indicators(rows: DataFrame) -> DataFrame:
    """Adds the recursive indicators to the output of ``add_window_indicators``, also after it was written, filtered or
    put together. Partitions hold whole symbols in order of time, which the row number asks for (Spark shuffles and sorts
    only where that does not hold already); tasks stream through them with a symbol's last values as their only state."""
    schema = StructType(rows.schema.fields[:])
    for c in RECURSIVE:
        schema = schema.add(c, "double")
    placed = rows.withColumn("_row", F.row_number().over(by_symbol())).where("_row > 0").drop("_row")
    out = placed.mapInPandas(_stream, schema)
    return out.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in RECURSIVE} | {c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c, t in rows.dtypes if t == "double"})


def add_indicators(bars: DataFrame) -> DataFrame:
    return add_recursive_indicators(add_window_indicators(bars))


def regime(rows: DataFrame, trend: float = 25.0, ranging: float = 20.0) -> DataFrame:
    """(symbol, regime): by the last bar's ADX, trending, ranging or neutral."""
    last = rows.groupBy("symbol").agg(F.max_by(F.coalesce("adx", F.lit(float("nan"))), "ts").alias("adx")).withColumn("adx", F.nanvl("adx", F.lit(None).cast("double")))
    return last.select("symbol", F.when(F.col("adx") >= trend, "trending").when(F.col("adx") < ranging, "ranging").otherwise("neutral").alias("regime"), "adx")


def add_structure(rows: DataFrame, lookback: int = 120, width: int = 3) -> DataFrame:
    """Adds ``sup`` and ``res``: arrays of the confirmed levels of the last ``lookback`` bars (at most 3 each a bar)."""
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(-lookback, -width)
    gather = lambda *cols: F.flatten(F.collect_list(F.array_compact(F.array(*cols))).over(w))
    enough = F.col("idx") - width > F.greatest(F.lit(0), F.col("idx") - lookback)
    return rows.withColumns({"sup": F.when(enough, gather("piv_low", "fvg_sup", "ob_sup")), "res": F.when(enough, gather("piv_high", "fvg_res", "ob_res"))})
