"""Monte Carlo checks in the JVM: draws are functions of (seed, path, step), paths are rows or folds over their draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions import draws

BOOTSTRAP_SEED, WALK_SEED, SPREAD_SEED = 42, 7, 11
#: R multiples are summed as whole numbers of 1 / UNIT, so that sums do not depend on their order.
UNIT = 1_000_000


def bootstrap(trades: DataFrame, key: list[str], order: str = "idx", sims: int = 5000, ruin: float = 10.0, seed: int = BOOTSTRAP_SEED) -> DataFrame:
    """(key, prob_profitable, median_total, p05_total, risk_of_ruin) of each key with trades (``order``, r): every path takes
    as many of them as there are, with replacement. Share of totals over 0, their median and 5th percentile, share of
    paths whose running sum falls to -``ruin``.

    A path's draws are rows: they meet the trades by key and place, and are summed in the order of their steps. Paths are dealt
    to tasks by key and path before they are unrolled, so that only trades move after."""
    n = F.count("*").over(Window.partitionBy(*key))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(order)) - 1
    own = trades.select(*key, n.alias("_n"), place.alias("_pick"), F.round(F.col("r") * UNIT).cast("long").alias("_units"))
    paths = own.where("_pick = 0").select(*key, "_n", F.explode(F.sequence(F.lit(0), F.lit(sims - 1))).alias("_path")).repartition(*key, "_path")
    steps = paths.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {draws.PER_HASH}"))))
    steps = steps.withColumn("_h", draws.hashed(seed, F.col("_path"), F.col("_block")))
    picks = F.array(*[draws.below(F.col("_h"), k, F.col("_n")) for k in range(draws.PER_HASH)])
    steps = steps.select(*key, "_n", "_path", "_block", F.posexplode(picks).alias("_k", "_pick"))
    steps = steps.withColumn("_step", F.col("_block") * draws.PER_HASH + F.col("_k")).where("_step < _n")
    drawn = steps.select(*key, "_path", "_step", "_pick").join(own.select(*key, "_pick", "_units"), [*key, "_pick"])
    so_far = F.sum("_units").over(Window.partitionBy(*key, "_path").orderBy("_step").rowsBetween(Window.unboundedPreceding, 0))
    ends = drawn.withColumn("_sum", so_far).groupBy(*key, "_path").agg(F.sum("_units").alias("_total"), F.min("_sum").alias("_low"))
    at = lambda p: F.round(F.percentile("_total", p) / UNIT, 4)
    share = lambda test: F.round(F.avg(F.when(test, 1.0).otherwise(0.0)), 4)
    return ends.groupBy(*key).agg(share(F.col("_total") > 0).alias("prob_profitable"), at(0.5).alias("median_total"), at(0.05).alias("p05_total"), share(F.col("_low") <= -ruin * UNIT).alias("risk_of_ruin"))


def add_bootstrap(stats: DataFrame, trades: DataFrame, key: list[str], order: str = "idx", sims: int = 5000, ruin: float = 10.0) -> DataFrame:
    """``stats`` with the bootstrap of their keys' trades; without any: 0, 0, 0 and certain ruin."""
    out = stats.join(bootstrap(trades, key, order, sims, ruin), key, "left")
    return out.fillna({"prob_profitable": 0.0, "median_total": 0.0, "p05_total": 0.0, "risk_of_ruin": 1.0})


def baseline() -> Column:
    """Of a walk without drift: risk over risk and reward; 0 where both are 0."""
    risk = F.abs(F.col("entry") - F.col("stop"))
    return F.coalesce(risk / F.nullif(risk + F.abs(F.col("target") - F.col("entry")), F.lit(0.0)), F.lit(0.0))


def _shares(rows: DataFrame, key: list[str], seed: int, bars: int, sims: int, start: Column, step, verdict) -> DataFrame:
    """(key, win): the share of ``sims`` paths that win. A path is a fold over its normal draws: ``step`` gives the next
    position, ``verdict`` 1, -1 or 0, of which the first one that is not 0 stays. All rows share the draws: ``sims`` rows
    of ``bars`` numbers, broadcast."""
    paths = rows.sparkSession.range(sims).select(F.col("id").alias("_path"))
    paths = F.broadcast(paths.select("_path", draws.normals(seed, F.col("_path"), bars).alias("_z")))
    each = rows.withColumn("_path", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sims - 1).cast("long")))).repartition(*key, "_path").join(paths, "_path")

    def on(s: Column, z: Column) -> Column:
        at = step(s["x"], z)
        return F.struct(at.alias("x"), F.when(s["end"] != 0, s["end"]).otherwise(verdict(at)).alias("end"))

    end = F.aggregate("_z", F.struct(start.alias("x"), F.lit(0).alias("end")), on, lambda s: s["end"])
    return each.groupBy(*key).agg(F.round(F.avg(F.when(end == 1, 1.0).otherwise(0.0)), 4).alias("_win"))


def add_barrier_probability(plans: DataFrame, key: list[str], drift: str | None = None, bars: int = 60, sims: int = 4000) -> DataFrame:
    """Adds win_prob, the share of normal walks (the plan's ATR as deviation) that reach the target before the stop within
    ``bars``, and baseline_win_prob, which also stands where the ATR is not positive. ``key`` tells plans apart."""
    sign = F.when(F.col("side") == "LONG", 1.0).otherwise(-1.0)
    rows = plans.where("atr > 0").select(
        *key, (sign * (F.col(drift) if drift else F.lit(0.0))).alias("_d"), (sign * F.col("atr")).alias("_s"),
        F.abs(F.col("target") - F.col("entry")).alias("_gain"), F.abs(F.col("entry") - F.col("stop")).alias("_risk"),
    ).fillna({"_d": 0.0})
    verdict = lambda x: F.when(x <= -F.col("_risk"), -1).when(x >= F.col("_gain"), 1).otherwise(0)
    won = _shares(rows, key, WALK_SEED, bars, sims, F.lit(0.0), lambda x, z: x + F.col("_d") + F.col("_s") * z, verdict)
    out = plans.join(won, key, "left").withColumn("baseline_win_prob", F.round(baseline(), 4))
    return out.withColumn("win_prob", F.coalesce("_win", "baseline_win_prob")).drop("_win")


def add_spread_probability(plans: DataFrame, key: list[str], exit_: float = 0.5, stop: float = 3.5, bars: int = 60, sims: int = 4000) -> DataFrame:
    """Adds win_prob of pair plans, the share of AR(1) paths of z that come back to the exit before the stop; where phi or
    the error do not make a path: the chance of a walk without drift."""
    fits = (F.col("phi") > 0) & (F.col("phi") < 1) & (F.col("sigma_eps") > 0)
    verdict = lambda x: F.when(F.abs(x) <= exit_, 1).when(F.abs(x) >= stop, -1).otherwise(0)
    rows = plans.where(fits).select(*key, F.col("z").alias("_z0"), F.col("phi").alias("_p"), F.col("sigma_eps").alias("_e"))
    won = _shares(rows, key, SPREAD_SEED, bars, sims, F.col("_z0"), lambda x, z: F.col("_p") * x + F.col("_e") * z, verdict)
    flat = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (stop - F.abs("z")) / (stop - exit_))) if stop > exit_ else F.lit(0.0)
    return plans.join(won, key, "left").withColumn("win_prob", F.coalesce("_win", F.round(flat, 4))).drop("_win")
