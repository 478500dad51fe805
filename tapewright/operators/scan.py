"""The universe scan: single-symbol, pair and factor plans, assessed, sized, gated and put in one order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.functions.core import CONFIG
from tapewright.operators import backtest as bt
from tapewright.operators import factor, indicators, montecarlo, pairs, risk, strategies
from tapewright.sources import bars as src
from tapewright.streaming.bars import staged

#: Bars of a symbol that a scan looks at, and that it needs.
LOOKBACK, LEAST_BARS = 1250, 60
SHOWN = [
    "strategy", "symbol", "asset_class", "ts", "side", "entry", "stop", "target", "rr", "units", "notional", "equity_pct", "risk_amount", "risk_pct", "risk_free_at", "regime", "trades",
    "win_rate", "profit_factor", "expectancy", "sharpe", "oos_trades", "oos_expectancy", "prob_profitable", "risk_of_ruin", "win_prob", "confluence", "confidence", "live", "passed", "forecast_only", "published",
]


def history(bars: DataFrame, lookback: int = LOOKBACK, least: int = LEAST_BARS) -> DataFrame:
    """The last ``lookback`` bars of each symbol that has ``least`` of them."""
    last = src.tail(bars, lookback)
    enough = last.groupBy("symbol").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("symbol")
    return last.join(enough, "symbol", "left_semi")


def classed(rows: DataFrame, universe: DataFrame | None) -> DataFrame:
    """``rows`` with the asset class of their symbols: what ``universe`` (symbol, class) lists, or what their form says."""
    if universe is None:
        return rows.withColumn("asset_class", src.asset_class(F.col("symbol")))
    return src.classify(rows.drop("asset_class"), universe)


def assess(plans: DataFrame, trades: DataFrame, key: list[str], order: str = "idx", short_mode: str = "forecast") -> DataFrame:
    """``plans`` (with asset_class, win_prob and baseline_win_prob) and what their key's trades say: statistics, late
    statistics, bootstrap, size, and the explicit plan: share of the equity, risk, the price at which the risk is earned
    back. Plans without trades are left out: they have no measured edge."""
    g, r = CONFIG["gate"], CONFIG["risk"]
    trades = staged(trades.select(*key, order, "r"), "trades")
    st = montecarlo.add_bootstrap(bt.stats(trades, key, order), trades, key, order, ruin=g["ruin"])
    late = bt.out_of_sample(trades, key, order, split=g["split"]).select(*key, F.col("trades").alias("oos_trades"), F.col("expectancy").alias("oos_expectancy"))
    out = plans.join(st, key).join(late, key, "left").fillna({"oos_trades": 0, "oos_expectancy": 0.0})
    out = risk.add_size(out, r["equity"], r["risk_pct"], r["kelly"], r["max_kelly_pct"])
    return risk.add_execution(risk.apply_short_policy(out, short_mode), r["equity"], CONFIG["manage"]["breakeven"])


def judged(signals: DataFrame) -> DataFrame:
    """Adds confidence, the gate and whether a signal is published: live, through the gate, and sure enough."""
    out = signals.withColumn("confidence", risk.combined_confidence()).withColumn("passed", risk.passes_gate())
    return out.withColumn("published", F.col("live") & F.col("passed") & (F.col("forecast_only") | (F.col("confidence") >= CONFIG["gate"]["confidence"])))


def symbol_signals(rows: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """Each strategy's latest plan of each symbol. ``live``: it is of the last bar and suits the regime, as a scan asks; the
    confluence counts such plans with each other, and the others with each other. ``rows`` have indicators and levels;
    ``universe`` lists the classes of symbols: shorts of one that can't be sold short are forecasts."""
    plan = staged(strategies.all_plans(rows, CONFIG["structure"]), "plans")
    bars = rows.select("symbol", "idx", "high", "low", "close")
    trend = plan.where("strategy <> 'mean_reversion'")
    done = bt.trailing_exits(trend, bars, CONFIG["exits"]["trail"]).unionByName(bt.fixed_exits(plan.where("strategy = 'mean_reversion'"), bars))
    last = plan.groupBy("strategy", "symbol").agg(F.max_by(F.struct(*[c for c in plan.columns if c not in ("strategy", "symbol")]), "idx").alias("x")).select("strategy", "symbol", "x.*")
    last = staged(classed(last.join(rows.select("symbol", "idx", "drift"), ["symbol", "idx"]), universe), "latest")
    last = montecarlo.add_barrier_probability(last, ["strategy", "symbol"], "drift")
    end = rows.groupBy("symbol").agg(F.max("idx").alias("end"))
    out = assess(last, bt.select_trades(done), ["strategy", "symbol"])
    out = out.join(indicators.regime(rows, CONFIG["regime"]["trend"], CONFIG["regime"]["range"]).select("symbol", "regime"), "symbol").join(end, "symbol")
    suits = F.when(F.col("strategy") == "mean_reversion", "ranging").otherwise("trending")
    out = out.withColumn("live", (F.col("idx") == F.col("end")) & ((F.col("regime") == "neutral") | (F.col("regime") == suits)))
    return judged(strategies.confluence(out, ["live"])).withColumn("note", strategies.structure_note())


def pair_bars(bars: DataFrame, candidates: DataFrame) -> DataFrame:
    """(pair, ts, a, b) of the candidates both of whose legs have a history."""
    return pairs.align(history(bars), candidates)


def pair_signals(aligned: DataFrame) -> DataFrame:
    """Plans of pairs that are cointegrated and stretched now, by the pair's own trades; the chance is that the spread
    comes back, its baseline that of a spread without a pull. ``symbol`` is the pair's first leg, a stock."""
    c = CONFIG["pairs"]
    aligned = staged(aligned, "pairs")
    plan = staged(pairs.pair_plans(pairs.pair_state(aligned, c["lookback"]), c["p_max"], c["entry"], c["exit"], c["stop"]), "pair-plans")
    flat = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (c["stop"] - F.abs("z")) / (c["stop"] - c["exit"])))
    plan = montecarlo.add_spread_probability(plan, ["pair"], c["exit"], c["stop"]).withColumns({"baseline_win_prob": F.round(flat, 4), "asset_class": F.lit("stock")})
    plan = plan.withColumns({"symbol": F.split("pair", "/")[0], "strategy": F.lit("pairs"), "regime": F.lit("pair"), "live": F.lit(True), "confluence": F.lit(1).cast("long")})
    trades = pairs.pair_trades(pairs.rolling_z(aligned, c["lookback"]), c["entry"], c["exit"], c["stop"], c["lookback"] + 30)
    return judged(assess(plan, trades, ["pair"]))


#: Classes whose symbols are ranked, each among its own.
RANKED = ("stock", "forex", "crypto")


def factor_signals(rows: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """Legs of each class's strongest and weakest symbols by the statistics of that class's baskets, behind the factor's
    own gate."""
    c, by = CONFIG["factor"], ("asset_class",)
    rows = classed(rows, universe).where(F.col("asset_class").isin(*RANKED))
    legs = factor.rank_live(rows, c["lookback"], c["skip"], c["top"], c["bottom"], c["stop"], c["reward"], CONFIG["structure"], by)
    last = rows.groupBy("symbol").agg(F.max_by("drift", "ts").alias("drift"))
    legs = montecarlo.add_barrier_probability(staged(legs.join(last, "symbol"), "legs"), ["symbol", "side"], "drift")
    legs = legs.withColumns({"strategy": F.lit("factor_momentum"), "regime": F.lit("cross-section"), "live": F.lit(True), "confluence": F.lit(1).cast("long")})
    out = judged(assess(legs, factor.basket_returns(rows, c["lookback"], c["skip"], c["hold"], c["top"], c["bottom"], by), ["asset_class"], "t"))
    own = factor.passes_gate(out.drop("passed"), c["min_trades"], c["min_win_rate"], c["min_pf"])
    return own.withColumn("published", F.col("passed") & (F.col("forecast_only") | (F.col("confidence") >= CONFIG["gate"]["confidence"])))


def universe_scan(rows: DataFrame, aligned: DataFrame | None = None, universe: DataFrame | None = None) -> DataFrame:
    """All signals in one table, the published ones and the surest first (``place`` from 1). ``universe``: (symbol, class)."""
    out = symbol_signals(rows, universe).select(*SHOWN).unionByName(factor_signals(rows, universe).select(*SHOWN))
    if aligned is not None:
        out = out.unionByName(pair_signals(aligned).select(*SHOWN))
    return risk.by_confidence(out)

