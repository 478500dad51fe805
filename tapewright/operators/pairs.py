"""Pairs: hedge ratio, spread z-scores over prior bars, cointegration test, position machine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.core import valid_plan

#: Fixed values of the method: unit-root t statistics and their p-values.
CRITICAL = ((-3.90, 0.01), (-3.34, 0.05), (-3.04, 0.10), (-2.50, 0.25), (-1.50, 0.50), (-0.50, 0.75))


def align(bars: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, ts, a, b): closes of both legs at common times. ``pairs`` has symbol_a, symbol_b."""
    p = pairs.select(F.concat_ws("/", "symbol_a", "symbol_b").alias("pair"), "symbol_a", "symbol_b")
    leg = lambda s, x: bars.select(F.col("symbol").alias(s), "ts", F.col("close").alias(x))
    return p.join(leg("symbol_a", "a"), "symbol_a").join(leg("symbol_b", "b"), ["symbol_b", "ts"]).select("pair", "ts", "a", "b")


def rolling_z(aligned: DataFrame, lookback: int = 252) -> DataFrame:
    """Adds beta, alpha and z of each bar by least squares over the ``lookback`` bars before it."""
    w = Window.partitionBy("pair").orderBy("ts").rowsBetween(-lookback, -1)
    out = aligned.withColumns({
        "idx": F.row_number().over(Window.partitionBy("pair").orderBy("ts")) - 1, "_n": F.count("a").over(w), "_ma": F.avg("a").over(w), "_mb": F.avg("b").over(w),
        "_va": F.var_pop("a").over(w), "_vb": F.var_pop("b").over(w), "_ab": F.covar_pop("a", "b").over(w),
    })
    out = out.withColumn("beta", F.when(F.col("_n") == lookback, F.col("_ab") / F.nullif(F.col("_vb"), F.lit(0.0)))).withColumn("alpha", F.col("_ma") - F.col("beta") * F.col("_mb"))
    sigma = F.sqrt(F.greatest(F.col("_va") - F.col("beta") * F.col("_ab"), F.lit(0.0)))
    out = out.withColumn("z", F.when(F.col("beta").isNotNull(), (F.col("a") - F.col("beta") * F.col("b") - F.col("alpha")) / F.nullif(sigma, F.lit(0.0))))
    return out.drop("_n", "_ma", "_mb", "_va", "_vb", "_ab")


def pair_trades(z: DataFrame, entry: float = 2.0, exit_: float = 0.5, stop: float = 3.5, least: int = 252 + 30) -> DataFrame:
    """(pair, idx, r): trades of the position machine flat, long spread, short spread; one still open at the end is
    left out, and pairs of under ``least`` bars have none. A win is the move of z over the distance of the entry and
    stop thresholds. Streamed in order; the state is the position and its entry z."""
    rows = z.withColumn("_n", F.count("*").over(Window.partitionBy("pair"))).where(F.col("z").isNotNull() & (F.col("_n") >= least)).select("pair", "ts", "idx", "z").repartition("pair").sortWithinPartitions("pair", "ts")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, side, at = None, 0, 0.0
        for pdf in batches:
            out: list[tuple] = []
            pair, idx, z = pdf["pair"].to_numpy(), pdf["idx"].to_numpy(), pdf["z"].to_numpy()
            cuts = [0, *(np.flatnonzero(pair[1:] != pair[:-1]) + 1), len(pdf)] if len(pdf) else [0]
            for a, b in zip(cuts, cuts[1:]):
                if pair[a] != held:
                    held, side = pair[a], 0
                v = z[a:b]
                opens = np.flatnonzero(np.abs(v) >= entry)
                ends = {s: np.flatnonzero((s * v >= -exit_) | (s * v <= -stop)) for s in (1, -1)}
                k = -1  # the last bar that has been dealt with; each step goes to the next crossing
                while True:
                    places = ends[side] if side else opens
                    j = int(np.searchsorted(places, k, "right"))
                    if j == len(places):
                        break
                    k = int(places[j])
                    if side:
                        out.append((held, idx[a + k], side * (v[k] - at) / (stop - entry) if side * v[k] >= -exit_ else -1.0))
                        side = 0
                    else:
                        side, at = (1 if v[k] < 0 else -1), v[k]
            yield pd.DataFrame(out, columns=["pair", "idx", "r"]).astype({"idx": "int32", "r": "float64"})

    return rows.mapInPandas(run, "pair string, idx int, r double")


def p_value(t: Column) -> Column:
    """Linear between the critical values; 0.01 below them, at most 0.999 above."""
    out = F.when(t <= CRITICAL[0][0], CRITICAL[0][1])
    for (a, p), (b, q) in zip(CRITICAL, CRITICAL[1:], strict=False):
        out = out.when(t <= b, p + (t - a) / (b - a) * (q - p))
    return out.otherwise(F.least(F.lit(0.999), CRITICAL[-1][1] + (t - CRITICAL[-1][0]) * 0.1))


def pair_state(aligned: DataFrame, lookback: int = 252) -> DataFrame:
    """One row a pair with ``lookback`` bars or more, from its last ones: hedge, spread moments, z, AR(1) coefficient and its
    error, unit-root t and p-value. Pairs whose second leg does not move have none. All of it is sums over the bars and
    their lags.

    The unit-root t is that of the level in a regression of the spread's change on a constant, the level and the change
    before: with two regressors, the coefficients follow from the centred sums of squares and products."""
    w = Window.partitionBy("pair")
    last = aligned.withColumn("_k", F.row_number().over(w.orderBy(F.desc("ts")))).where(F.col("_k") <= lookback).select("pair", "ts", "a", "b")
    line = last.groupBy("pair").agg(
        F.count("*").alias("n"), (F.covar_pop("a", "b") / F.nullif(F.var_pop("b"), F.lit(0.0))).alias("beta"), F.avg("a").alias("ma"), F.avg("b").alias("mb")
    )
    line = line.where((F.col("n") == lookback) & F.col("beta").isNotNull()).select("pair", "beta", (F.col("ma") - F.col("beta") * F.col("mb")).alias("alpha"))
    s = last.join(line, "pair").withColumn("s", F.col("a") - (F.col("beta") * F.col("b") + F.col("alpha")))
    lag = lambda c: F.lag(c).over(w.orderBy("ts"))
    s = s.withColumn("x", lag("s")).withColumn("d", F.col("s") - F.col("x")).withColumn("e", lag("d")).withColumn("full", F.col("e").isNotNull())
    z = lambda c: (F.col(c) - F.col("mu")) / F.nullif(F.col("sigma"), F.lit(0.0))
    s = s.withColumns({"mu": F.avg("s").over(w), "sigma": F.stddev_pop("s").over(w)}).withColumns({"z": z("s"), "before": z("x")})
    s = s.withColumn("phi", F.least(F.lit(0.999), F.greatest(F.lit(0.0), F.sum(F.col("z") * F.col("before")).over(w) / F.nullif(F.sum(F.col("before") ** 2).over(w), F.lit(0.0)))))
    only = lambda f, *cols: f(*[F.when(F.col("full"), F.col(c)) for c in cols])
    one = s.groupBy("pair", "beta", "alpha", "mu", "sigma", "phi").agg(
        F.max_by(F.struct("ts", "a", "b", F.coalesce("z", F.lit(0.0)).alias("z")), "ts").alias("end"), F.stddev_pop(F.col("z") - F.col("phi") * F.col("before")).alias("eps"), F.count_if("full").alias("n"),
        *[only(F.covar_pop, p, q).alias(p + q) for p, q in ("xx", "ee", "dd", "xe", "xd", "ed")],
    )
    det = F.col("xx") * F.col("ee") - F.col("xe") * F.col("xe")
    one = one.withColumn("det", F.nullif(det, F.lit(0.0))).withColumn("level", (F.col("xd") * F.col("ee") - F.col("ed") * F.col("xe")) / F.col("det"))
    one = one.withColumn("change", (F.col("ed") * F.col("xx") - F.col("xd") * F.col("xe")) / F.col("det"))
    left = (F.col("dd") - F.col("level") * F.col("xd") - F.col("change") * F.col("ed")) / (F.col("n") - 3)
    t = F.when(F.col("n") < 18, 0.0).otherwise(F.coalesce(F.col("level") / F.sqrt(F.greatest(left * F.col("ee") / F.col("det"), F.lit(1e-30))), F.lit(0.0)))
    out = one.select("pair", "end.ts", "end.a", "end.b", "beta", "alpha", "mu", "sigma", "end.z", F.coalesce("phi", F.lit(0.0)).alias("phi"), F.coalesce("eps", F.lit(0.0)).alias("sigma_eps"), t.alias("t"))
    return out.withColumn("p_value", p_value(F.col("t")))


def pair_plans(state: DataFrame, p_max: float = 0.05, entry: float = 2.0, exit_: float = 0.5, stop: float = 3.5) -> DataFrame:
    """Plans of leg A for pairs that are cointegrated and stretched now: target and stop are A's prices at the z of
    exit and stop."""
    price = lambda z: F.col("mu") + z * F.col("sigma") + F.col("beta") * F.col("b") + F.col("alpha")
    sign = F.when(F.col("z") <= -entry, F.lit(-1.0)).otherwise(F.lit(1.0))
    hit = state.where((F.col("p_value") <= p_max) & (F.abs("z") >= entry) & (F.col("sigma") > 0) & (F.col("beta") != 0))
    return hit.withColumns({"side": F.when(F.col("z") <= -entry, "LONG").otherwise("SHORT"), "entry": F.col("a"), "target": price(sign * exit_), "stop": price(sign * stop)}).where(valid_plan())
