"""Cross-sectional momentum: panel backtest and live ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.core import is_long, valid_plan
from tapewright.operators.strategies import add_stop_and_target


def complete_panel(bars: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Bars at times when every symbol (of the group, by the columns ``by``) has one, with the dense position ``t``. The
    numbers of symbols are one row a group."""
    n = bars.groupBy(*by).agg(F.count_distinct("symbol").alias("n"))
    times = bars.groupBy(*by, "ts").agg(F.count_distinct("symbol").alias("k"))
    n = n.select(*[F.col(c).alias(f"_{c}") for c in by], "n")
    same = F.col("k") == F.col("n")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    times = times.join(n, same).select(*by, "ts")
    return bars.join(times, [*by, "ts"], "left_semi").withColumn("t", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1)


def basket_returns(bars: DataFrame, lookback: int = 126, skip: int = 21, hold: int = 21, top: int = 2, bottom: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """(basket, by, t, r): at every ``hold``-th position, the mean forward return of the ``top`` symbols by trailing
    return less that of the ``bottom`` ones, in each group. Ties go by symbol. A symbol is in one group."""
    w = Window.partitionBy("symbol").orderBy("t")
    p = complete_panel(bars, by).withColumns({"score": F.lag("close", skip).over(w) / F.nullif(F.lag("close", skip + lookback).over(w), F.lit(0.0)) - 1.0,
                                              "fwd": F.lead("close", hold).over(w) / F.nullif(F.col("close"), F.lit(0.0)) - 1.0})
    p = p.where((F.col("t") >= lookback + skip) & ((F.col("t") - (lookback + skip)) % hold == 0) & F.col("fwd").isNotNull() & F.col("score").isNotNull())
    at = Window.partitionBy(*by, "t")
    p = p.withColumns({"hi": F.row_number().over(at.orderBy(F.desc("score"), "symbol")), "lo": F.row_number().over(at.orderBy("score", F.desc("symbol")))})
    up, down = F.avg(F.when(F.col("hi") <= top, F.col("fwd"))), F.coalesce(F.avg(F.when(F.col("lo") <= bottom, F.col("fwd"))), F.lit(0.0))
    return p.groupBy(*by, "t").agg((up - down).alias("r")).select(F.lit("momentum").alias("basket"), *by, "t", "r")


def rank_live(rows: DataFrame, lookback: int = 126, skip: int = 21, top: int = 2, bottom: int = 2, stop: float = 3.0, reward: float = 2.0, structure: dict | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Legs of each group's strongest and weakest symbols by their own last bars: side, score, rank, entry, stop, target,
    ATR-based or, if ``structure`` is given, refined by levels. ``rows`` have indicators (and structure arrays). Symbols
    of under lookback + skip + 2 bars or without a positive price at the start are left out; groups of under top + bottom
    symbols have no legs. ``by``: columns that group symbols; none: all are one group."""
    w = Window.partitionBy("symbol").orderBy("ts")
    names = ["ts", "idx", "close", "atr", "past", "far", *by, *(["sup", "res"] if structure else [])]
    s = rows.withColumns({"past": F.lag("close", skip).over(w), "far": F.lag("close", skip + lookback).over(w)})
    last = s.groupBy("symbol").agg(F.max_by(F.struct(*names), "ts").alias("x")).select("symbol", "x.*")
    last = last.where((F.col("idx") >= lookback + skip + 1) & (F.col("far") > 0)).withColumn("score", F.col("past") / F.col("far") - 1.0).where("score IS NOT NULL")
    # One row a symbol: a group's are ranked from both ends, and counted, in one task.
    group = Window.partitionBy(*by)
    up, down = group.orderBy(F.desc("score"), "symbol"), group.orderBy("score", F.desc("symbol"))
    last = last.withColumns({"hi": F.row_number().over(up), "lo": F.row_number().over(down), "n": F.count("*").over(group)})
    ends = F.array(F.struct(F.lit("LONG").alias("side"), F.col("hi").alias("rank"), F.lit(top).alias("most")), F.struct(F.lit("SHORT").alias("side"), F.col("lo").alias("rank"), F.lit(bottom).alias("most")))
    legs = last.where(F.col("n") >= top + bottom).select("*", F.inline(ends)).where("rank <= most AND atr > 0").withColumn("entry", F.col("close"))
    if structure:
        legs = add_stop_and_target(legs, stop, reward, structure)
    else:
        sign = F.when(is_long(), 1.0).otherwise(-1.0)
        legs = legs.withColumns({"stop": F.col("close") - sign * stop * F.col("atr"), "target": F.col("close") + sign * stop * reward * F.col("atr")})
    return legs.where(valid_plan()).select(*by, "symbol", "ts", "side", "score", "rank", "entry", "stop", "target", "atr")


def passes_gate(stats: DataFrame, trades: int = 24, win_rate: float = 0.45, pf: float = 1.15) -> DataFrame:
    return stats.withColumn("passed", (F.col("trades") >= trades) & (F.col("win_rate") >= win_rate) & (F.col("profit_factor") >= pf))
