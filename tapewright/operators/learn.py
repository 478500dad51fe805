"""Features, triple-barrier labels, and a purged walk-forward with gradient-boosted trees, a model a symbol and cutoff."""

from __future__ import annotations

from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.core import by_symbol, is_long, over
from tapewright.operators import boosting
from tapewright.operators.backtest import select_trades
from tapewright.streaming.bars import staged

FEATURES = [
    "ret_1", "ret_3", "ret_5", "ret_10", "ret_20", "rsi", "rsi_2", "macd_hist_pct", "atr_pct", "zscore", "adx", "pct_b", "dist_ma50", "dist_ma200", "realized_vol", "mom_63", "mom_126", "vol_z",
]


def add_features(rows: DataFrame) -> DataFrame:
    """Adds the features (all known at the bar's close) to rows with indicators."""
    c = F.col("close")
    ret = lambda n: c / F.nullif(F.lag("close", n).over(by_symbol()), F.lit(0.0)) - 1.0
    div = lambda a, b: a / F.nullif(b, F.lit(0.0))
    v = F.when(F.count("volume").over(over(20)) == 20, (F.col("volume") - F.avg("volume").over(over(20))) / F.nullif(F.stddev_pop("volume").over(over(20)), F.lit(0.0)))
    return rows.withColumns({
        **{f"ret_{n}": ret(n) for n in (1, 3, 5, 10, 20)}, "mom_63": ret(63), "mom_126": ret(126), "macd_hist_pct": div(F.col("macd_hist"), c), "atr_pct": div(F.col("atr"), c),
        "pct_b": div(c - F.col("bb_low"), F.col("bb_up") - F.col("bb_low")), "dist_ma50": div(c, F.col("sma_50")) - 1.0, "dist_ma200": div(c, F.col("sma_200")) - 1.0, "vol_z": v,
    })


def _paths(rows: DataFrame, horizon: int) -> DataFrame:
    at = rows.where("atr > 0").withColumn("j", F.explode(F.sequence(F.col("idx") + 1, F.col("idx") + horizon)))
    b = rows.select("symbol", F.col("idx").alias("j"), F.col("high").alias("bh"), F.col("low").alias("bl"), F.col("close").alias("bc"))
    return at.select("symbol", "idx", "close", "atr", "j").join(b, ["symbol", "j"])


def labels(rows: DataFrame, horizon: int = 10, k: float = 1.5) -> DataFrame:
    """(symbol, idx, label): 1 if close + k ATR is reached before close - k ATR within the horizon (a bar that
    reaches both counts as up), 0 if the other way, else the sign of the return; the last bar has none."""
    up, down = F.col("bh") >= F.col("close") + k * F.col("atr"), F.col("bl") <= F.col("close") - k * F.col("atr")
    first = F.min(F.when(up | down, F.struct("j", F.when(up, 1).otherwise(0).alias("y")))).alias("f")
    got = _paths(rows, horizon).groupBy("symbol", "idx", "close").agg(first, F.max(F.struct("j", "bc")).alias("l"))
    return got.select("symbol", "idx", F.coalesce(F.col("f.y"), (F.col("l.bc") > F.col("close")).cast("int")).alias("label"))


def _assembled(rows: DataFrame, horizon: int, k: float) -> DataFrame:
    """(symbol, ts, idx, close, atr, label, x, end), written: x are the features, unknown ones null; end is the symbol's
    last bar."""
    names = ["symbol", "ts", "idx", "close", "atr"]
    x = add_features(rows).select(*names, F.array(*FEATURES).alias("x"))
    end = F.max("idx").over(Window.partitionBy("symbol"))
    return staged(x.join(labels(rows, horizon, k), ["symbol", "idx"], "left").select(*names, "label", "x", end.alias("end")), "features")


def fit_and_score(train: DataFrame, score: DataFrame, settings: boosting.Settings, least: int = 80) -> DataFrame:
    """(symbol, ts, idx, prob_up) of the rows of ``score`` (symbol, cut, ts, idx, x) by the model of their symbol and cut,
    fitted to the rows of ``train`` (symbol, cut, idx, label, x): every model is a group of its own, and all are fitted side
    by side. A model needs ``least`` labels, and both of them; without one its rows are left out, as are rows without
    any known feature."""
    known, given = F.exists("x", lambda v: v.isNotNull()), asdict(settings)
    rows = train.select("symbol", "cut", F.lit(None).cast("timestamp").alias("ts"), "idx", "label", "x")
    rows = rows.unionByName(score.where(known).select("symbol", "cut", "ts", "idx", F.lit(None).cast("int").alias("label"), "x"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        x = np.array(pdf["x"].tolist(), float)
        labelled = pdf["label"].notna().to_numpy()
        y = pdf.loc[labelled, "label"].to_numpy(float)
        out = pdf.loc[~labelled, ["symbol", "ts", "idx"]]
        if len(out) == 0 or len(y) < least or len(np.unique(y)) < 2:
            return out.head(0).assign(prob_up=0.0)
        return out.assign(prob_up=boosting.fit(x[labelled], y, boosting.Settings(**given)).probability(x[~labelled]))

    return rows.groupBy("symbol", "cut").applyInPandas(run, "symbol string, ts timestamp, idx int, prob_up double")


def walk_forward(rows: DataFrame, horizon: int = 10, k: float = 1.5, min_train: int = 250, refit: int = 42, iterations: int = 200, depth: int = 3, rate: float = 0.05, least: int = 80, l2: float = 1.0, leaf: int = 20) -> DataFrame:
    """(symbol, ts, idx, prob_up): probabilities of models that saw only labels complete before their first bar: at each
    cutoff (every ``refit`` bars) a symbol's model is fitted to its bars up to cutoff - horizon and scores the bars up to
    the next cutoff. Symbols of under min_train + horizon + 20 bars are left out.

    A bar takes part in all its symbol's later models, so rows grow as a history's square over 2 * ``refit``; a group is one
    symbol's history."""
    x = _assembled(rows, horizon, k).where(F.col("end") + 1 >= min_train + horizon + 20)
    step = lambda i: F.lit(min_train) + F.ceil((i - min_train) / refit).cast("int") * refit
    first = F.greatest(F.lit(min_train), step(F.col("idx") + horizon + 1))
    cut: Column = F.explode(F.sequence(first, F.col("end"), F.lit(refit)))
    train = x.where(F.col("label").isNotNull() & (first <= F.col("end"))).select("symbol", cut.alias("cut"), "idx", "label", "x")
    own = F.lit(min_train) + F.floor((F.col("idx") - min_train) / refit).cast("int") * refit
    score = x.where((F.col("idx") >= min_train) & (F.col("atr") > 0)).select("symbol", own.alias("cut"), "ts", "idx", "x")
    return fit_and_score(train, score, boosting.Settings(iterations, depth, rate, l2, leaf), least)


def latest_plans(rows: DataFrame, horizon: int = 10, k: float = 1.5, min_train: int = 250, threshold: float = 0.58, iterations: int = 200, depth: int = 3, rate: float = 0.05, least: int = 80, l2: float = 1.0, leaf: int = 20) -> DataFrame:
    """(symbol, ts, side, entry, stop, target, atr, prob_up): plans of the last bars, k ATR either way, where the symbol's
    model of all its complete labels is sure enough. Symbols of under min_train + horizon + 1 bars are left out."""
    x = _assembled(rows, horizon, k).where(F.col("end") >= min_train + horizon).withColumn("cut", F.col("end") + 1)
    train = x.where((F.col("idx") <= F.col("end") - horizon) & F.col("label").isNotNull())
    last = x.where((F.col("idx") == F.col("end")) & (F.col("atr") > 0))
    got = fit_and_score(train, last, boosting.Settings(iterations, depth, rate, l2, leaf), least).select("symbol", "idx", "prob_up").join(last, ["symbol", "idx"])
    got = got.withColumn("side", F.when(F.col("prob_up") >= threshold, "LONG").when(F.col("prob_up") <= 1 - threshold, "SHORT")).where("side IS NOT NULL")
    sign = F.when(is_long(), 1.0).otherwise(-1.0)
    return got.select("symbol", "ts", "side", F.col("close").alias("entry"), (F.col("close") - sign * k * F.col("atr")).alias("stop"), (F.col("close") + sign * k * F.col("atr")).alias("target"), "atr", "prob_up")


def signal_trades(scored: DataFrame, rows: DataFrame, threshold: float = 0.58, horizon: int = 10, k: float = 1.5) -> DataFrame:
    """Trades of the scored bars over the threshold: the adverse side is looked at first, the next trade begins after
    the horizon even if one ended early."""
    side = F.when(F.col("prob_up") >= threshold, 1.0).when(F.col("prob_up") <= 1 - threshold, -1.0)
    s = scored.withColumn("s", side).where("s IS NOT NULL").select("symbol", "idx", "s")
    p = _paths(rows, horizon).join(s, ["symbol", "idx"])
    up, down = F.col("bh") >= F.col("close") + k * F.col("atr"), F.col("bl") <= F.col("close") - k * F.col("atr")
    bad, good = F.when(F.col("s") > 0, down).otherwise(up), F.when(F.col("s") > 0, up).otherwise(down)
    first = F.min(F.when(bad | good, F.struct("j", F.when(bad, -1.0).otherwise(1.0).alias("r")))).alias("f")
    got = p.groupBy("symbol", "idx", "close", "atr", "s").agg(first, F.max(F.struct("j", "bc")).alias("l"))
    r = F.coalesce(F.col("f.r"), F.col("s") * (F.col("l.bc") - F.col("close")) / (k * F.col("atr")))
    return select_trades(got.select(F.lit("ml").alias("strategy"), "symbol", "idx", F.col("l.j").alias("exit_idx"), r.alias("r")))
