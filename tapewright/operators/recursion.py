"""Recursive averages of long histories: blocks of bars as affine maps, so that one symbol is many tasks."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bars a block; natural logs that decays within a block may add up to.
BLOCK, LOGS = 1024, 600.0


def blocked_mean(rows: DataFrame, value: str, alpha: float, shows: int, name: str, block: int = BLOCK) -> DataFrame:
    """``rows`` (symbol, idx without gaps, ``value``) with ``name``: the mean y = alpha x + (1 - alpha) y from the first value
    on, null until ``shows`` values. Where values are missing the last mean stays, and the next value weighs the more: it counts
    alpha against (1 - alpha) to the power of the bars since the last one.

    A value takes the mean before it to A y + B. Within a block of bars these maps are composed by running sums of logs and
    of scaled terms, from the block's first value on; a block as a whole is one row, and only those, one a
    block, are gone through symbol by symbol. Then each block's bars get their means from the block's first one."""
    block = max(1, min(block, int(LOGS / -math.log(1 - alpha)) if alpha < 1 else block))
    w = Window.partitionBy("symbol", "_block").orderBy("idx")
    so_far, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    there = F.col(value).isNotNull() & ~F.isnan(value)
    x = rows.withColumn("_block", F.floor(F.col("idx") / block)).withColumn("_x", F.when(there, F.col(value)))
    x = x.withColumn("_prev", F.last(F.when(F.col("_x").isNotNull(), F.col("idx")), ignorenulls=True).over(before))
    old = F.pow(F.lit(1 - alpha), F.col("idx") - F.col("_prev"))
    later = F.col("_x").isNotNull() & F.col("_prev").isNotNull()
    x = x.withColumns({"_log": F.when(later, F.ln(old / (old + alpha))), "_b": F.when(later, alpha * F.col("_x") / (old + alpha))})
    x = x.withColumn("_p", F.exp(F.coalesce(F.sum("_log").over(so_far), F.lit(0.0))))
    x = x.withColumn("_l", F.col("_p") * F.coalesce(F.sum(F.col("_b") / F.col("_p")).over(so_far), F.lit(0.0))).withColumn("_n", F.count("_x").over(so_far))
    first = F.min(F.when(F.col("_x").isNotNull(), F.struct("idx", "_x")))
    ends = x.groupBy("symbol", "_block").agg(
        F.min("idx").alias("start"), F.max("idx").alias("end"), first.alias("f"), F.max(F.when(F.col("_x").isNotNull(), F.col("idx"))).alias("last"),
        F.max_by("_p", "idx").alias("p"), F.max_by("_l", "idx").alias("l"), F.count("_x").alias("n"),
    ).select("symbol", "_block", F.col("f.idx").alias("at"), F.col("f._x").alias("x"), "last", "p", "l", "n")

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        y, last, seen, out = math.nan, None, 0, []
        for b in pdf.sort_values("_block").itertuples(index=False):
            symbol, number, at, value, end, p, rest, n = b
            into, known = y, seen
            if n:
                decay = (1 - alpha) ** (at - last) if seen else 0.0
                opens = (decay * y + alpha * value) / (decay + alpha) if seen else value
                y, last, seen = p * opens + rest, end, seen + n
            out.append((symbol, number, into, opens if n else math.nan, known))
        return pd.DataFrame(out, columns=["symbol", "_block", "_into", "_opens", "_seen"])

    carried = ends.groupBy("symbol").applyInPandas(carry, "symbol string, _block long, _into double, _opens double, _seen long")
    out = x.join(carried, ["symbol", "_block"])
    mean = F.when(F.col("_n") > 0, F.col("_p") * F.col("_opens") + F.col("_l")).otherwise(F.col("_into"))
    shown = F.when(F.col("_seen") + F.col("_n") >= shows, F.when(~F.isnan(mean), mean))
    return out.withColumn(name, shown).select(*rows.columns, name)
