"""The registered queries: name -> (query, DuckDB SQL or None). Doubles are rounded to 4 places on both sides."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewright.functions.core import CONFIG, is_long, meter, price_text
from tapewright.functions.report import signal_card
from tapewright.operators import backtest as bt
from tapewright.operators import asof, factor, indicators, journal, learn, montecarlo, optimize, pairs, recursion, risk, scan, strategies
from tapewright.plans import oracles as sql
from tapewright.plans import scan_sql
from tapewright.sources import bars as src
from tapewright.streaming import bars as stream
from tapewright.streaming import loop, positions
from tapewright.streaming.bars import staged

PAIRS = [("Brand#11", "Brand#12"), ("Brand#21", "Brand#22"), ("Brand#31", "Brand#32"), ("Brand#41", "Brand#42"), ("Brand#51", "Brand#52")]
NUDGE = 1e-7
Query = Callable[[SparkSession, str], DataFrame]


def out(df: DataFrame, *cols: str) -> DataFrame:
    """Doubles rounded (NUDGE keeps exact halves off the edge), instants without zone."""
    df = df.select(*cols) if cols else df
    return df.select(*[F.round(F.col(c) + NUDGE, 4).alias(c) if t == "double" else F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.add_indicators(src.order_bars(spark, sf_dir))


def levels(x: DataFrame) -> DataFrame:
    return indicators.add_structure(x, CONFIG["structure"]["lookback"], CONFIG["structure"]["width"])


def structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels(rows(spark, sf_dir))


def source_of(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """Mean reversion needs dips within trends, which independent prices don't have: the walk of the order bars."""
    return src.walk_bars if name == "mean_reversion" else src.order_bars


def plan_query(name: str) -> Query:
    return lambda spark, d: out(strategies.plans(levels(indicators.add_indicators(source_of(name)(spark, d))), name, structure=CONFIG["structure"]))


def trades(spark: SparkSession, d: str, name: str) -> DataFrame:
    """Trending strategies leave by the trailing stop, mean reversion by its target."""
    bars = source_of(name)(spark, d)
    trail = CONFIG["exits"]["trail"] if strategies.STRATEGIES[name][2] == "trending" else None
    plan = strategies.plans(levels(indicators.add_indicators(bars)), name, structure=CONFIG["structure"])
    return bt.backtest(plan, src.number(bars).select("symbol", "idx", "high", "low", "close"), trail, CONFIG["exits"]["max_hold"])


def trade_query(name: str) -> Query:
    return lambda spark, d: out(trades(spark, d, name), "strategy", "symbol", "idx", "side", "exit_idx", "exit", "outcome", "r")


def fixed_query(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        bars = src.number(src.order_bars(spark, d)).select("symbol", "idx", "high", "low", "close")
        done = bt.backtest(strategies.plans(structured(spark, d), name, structure=CONFIG["structure"]), bars)
        return out(done, "strategy", "symbol", "idx", "side", "exit_idx", "exit", "outcome", "r")

    return run


def scan_rows(spark: SparkSession, d: str) -> DataFrame:
    """What a scan looks at, written once: every part of it reads the same rows."""
    return staged(levels(indicators.add_indicators(scan.history(src.order_bars(spark, d)))), "scan")


#: The classes that the scan's universe lists for order symbols; others are told by their form.
LISTED = [("1-URGENT", "iran"), ("2-HIGH", "crypto"), ("3-MEDIUM", "forex")]


def signals(spark: SparkSession, d: str) -> DataFrame:
    return scan.symbol_signals(scan_rows(spark, d), spark.createDataFrame(LISTED, "symbol string, class string"))


def signal_query(spark: SparkSession, d: str) -> DataFrame:
    return out(signals(spark, d), *[c for c in scan.SHOWN if c != "published"], "baseline_win_prob", "note")


def measured_query(spark: SparkSession, d: str) -> DataFrame:
    """The scan's signals without what draws say."""
    cols = ["strategy", "symbol", "asset_class", "ts", "side", "entry", "stop", "target", "rr", "units", "equity_pct", "risk_pct", "risk_free_at", "regime", "trades", "win_rate", "profit_factor", "expectancy", "sharpe", "oos_trades", "oos_expectancy", "confluence", "live", "measured_edge"]
    return out(signals(spark, d).withColumn("measured_edge", risk.measured_edge()), *cols)


def makers(bars: DataFrame) -> DataFrame:
    """(symbol, class): brands by the first digit of their number; 6 to 9 are not listed."""
    maker = F.substring("symbol", 7, 1)
    kind = F.when(maker == "1", "crypto").when(maker == "2", "forex").when(maker.isin("3", "4", "5"), "iran")
    return bars.select("symbol", kind.alias("class")).where("class IS NOT NULL").distinct()


def twins(bars: DataFrame) -> DataFrame:
    """A second symbol for each: 1.8 times its price and 10, give or take what the day's volume says. Such pairs return."""
    off = 2.0 * F.pow((F.col("volume") % 97 - 48) / 48.0, 3.0)
    return bars.withColumns({"symbol": F.concat("symbol", F.lit("~")), "close": 1.8 * F.col("close") + 10.0 + off})


def universe_query(spark: SparkSession, d: str) -> DataFrame:
    """Symbols and factor over the walk of the brand bars, by class, and pairs of brands and their twins."""
    bars = staged(src.brand_walk(spark, d), "walk")
    x = staged(levels(indicators.add_indicators(scan.history(bars))), "scan")
    names = bars.select("symbol").distinct()
    both = scan.pair_bars(bars.unionByName(twins(bars)), names.select(F.concat("symbol", F.lit("~")).alias("symbol_a"), F.col("symbol").alias("symbol_b")))
    return out(scan.universe_scan(x, both, makers(bars)))


def sizes_query(spark: SparkSession, d: str) -> DataFrame:
    got = signals(spark, d).withColumn("quality", risk.backtest_confidence())
    return out(got, "strategy", "symbol", "side", "entry", "stop", "kelly_used", "units", "notional", "risk_amount", "quality")


def cards_query(spark: SparkSession, d: str) -> DataFrame:
    return signals(spark, d).select("strategy", "symbol", signal_card().alias("card"))


def payload_query(spark: SparkSession, d: str) -> DataFrame:
    """The order bars sent as one JSON payload a symbol and month and parsed again. By the day of the month, numbers come
    with commas, with exponents, in tags, or as millionths of ten decimals, and dates with slashes, names, times."""
    b = src.order_bars(spark, d)
    kind = F.dayofmonth("ts") % 4
    cell = lambda c: F.when(kind == 0, F.format_number(c, 4)).when(kind == 1, F.format_string("%.10e", c)).when(kind == 2, F.concat(F.lit("<td>"), F.format_string("%.4f", c), F.lit("</td>"))).otherwise(F.format_string("%.12f", F.col(c) / 1e6))
    date = F.when(kind == 0, F.date_format("ts", "yyyy/MM/dd")).when(kind == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(kind == 2, F.concat(F.lit("<b>"), F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit("</b>"))).otherwise(F.date_format("ts", "MMM d, yyyy"))
    cells = F.array(*[cell(c) for c in ("open", "low", "high", "close")], F.lit("800"), F.lit("0.1%"), date, F.lit("1402/10/27"))
    sent = b.groupBy("symbol", F.date_trunc("month", "ts").alias("month")).agg(F.to_json(F.struct(F.collect_list(cells).alias("data"))).alias("body"))
    return out(src.parse_payload(sent))


def epoch_query(spark: SparkSession, d: str) -> DataFrame:
    """The order bars as rows with epoch milliseconds, some twice, read back."""
    b = src.order_bars(spark, d).withColumns({"ts": F.unix_millis("ts"), "ingest_seq": F.lit(1)})
    again = b.where(F.col("ts") % 5 == 0).withColumns({"ingest_seq": F.lit(0), "close": F.lit(-1.0)})
    return out(src.normalise(src.epoch_bars(b.unionByName(again))), "symbol", "ts", "open", "high", "low", "close", "volume")


def classes_query(spark: SparkSession, d: str) -> DataFrame:
    """Brands by class: those of the first two makers are listed, the others are told by their form."""
    part = src.table(spark, d, "part")
    listed = part.where(F.col("p_brand").rlike("#[12]")).select(F.col("p_brand").alias("symbol"), F.when(F.col("p_brand").contains("#1"), "crypto").otherwise("forex").alias("class"))
    return out(src.classify(part.groupBy(F.col("p_brand").alias("symbol")).agg(F.count("*").alias("parts")), listed))


def closed_query(spark: SparkSession, d: str) -> DataFrame:
    """The journal after its resolved signals were closed by events, read back from the log."""
    s, _ = state(spark, d)
    opened = s.select(*journal.SIGNAL, F.col("created_at").alias("at"), F.lit("open").alias("status"), F.lit(None).cast("timestamp").alias("closed_at"), F.lit(None).cast("double").alias("result_r"))
    log = staged(opened.unionByName(journal.closing_events(s)), "log")
    return out(journal.latest(log), "signal_id", "symbol", "strategy", "side", "created_at", "status", "result_r")


def labels_query(spark: SparkSession, d: str) -> DataFrame:
    return out(rows(spark, d), "symbol", "ts", price_text(F.col("close")).alias("close_text"), price_text(F.col("rsi")).alias("rsi_text"), meter(F.col("rsi") / 100).alias("rsi_meter"))


def portfolio_query(spark: SparkSession, d: str) -> DataFrame:
    p = risk.portfolio(signals(spark, d), CONFIG["risk"]["equity"], CONFIG["risk"]["portfolio_max_pct"], CONFIG["risk"]["max_open"])
    return out(p.withColumn("risk_by_class", F.to_json(F.transform_values("risk_by_class", lambda _, v: F.round(v + NUDGE, 2)))).withColumn("warnings", F.array_join("warnings", "; ")))


def state(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A journal: every trend-breakout plan opened as a signal, resolved up to the last bar."""
    x = staged(structured(spark, d), "journal")
    p = strategies.plans(x, "trend_breakout", structure=CONFIG["structure"])
    p = journal.number(p).withColumn("created_at", F.col("ts")).withColumn("asset_class", F.lit("stock"))
    log = p.select(*journal.SIGNAL, F.col("ts").alias("at"), F.lit("open").alias("status"), F.lit(None).cast("timestamp").alias("closed_at"), F.lit(None).cast("double").alias("result_r"))
    now = x.agg(F.max("ts")).first()[0]
    return journal.resolve(journal.latest(log), x.select("symbol", "ts", "high", "low", "close"), F.lit(now), CONFIG["journal"]["max_hold_days"]), x


def fresh_query(spark: SparkSession, d: str) -> DataFrame:
    """The latest plan of each symbol and side, but for those with a signal still open within the cooldown."""
    s, x = state(spark, d)
    log = s.withColumn("at", F.coalesce("closed_at", "created_at"))
    last = s.withColumn("_k", F.row_number().over(Window.partitionBy("symbol", "side").orderBy(F.desc("created_at")))).where("_k = 1")
    return out(journal.new_signals(last, log, F.lit(x.agg(F.max("ts")).first()[0]), CONFIG["journal"]["cooldown_days"]), "signal_id", "symbol", "strategy", "side", "created_at", "status")


def review_query(spark: SparkSession, d: str) -> DataFrame:
    s, x = state(spark, d)
    s = s.withColumn("status", F.when(F.col("created_at") >= F.lit(x.agg(F.max("ts")).first()[0]) - F.expr("INTERVAL 90 DAYS"), "open").otherwise(F.col("status")))
    got = journal.review(journal.open_positions(s, x))
    return out(got, "signal_id", "symbol", "side", "r_now", "recommended_sl", "recommended_tp", "tp_reason", "at_breakeven", "trailed", "near_target", "danger", "actionable")


def aligned(spark: SparkSession, d: str) -> DataFrame:
    return pairs.align(src.brand_bars(spark, d), spark.createDataFrame(PAIRS, "symbol_a string, symbol_b string"))


def pair_query(spark: SparkSession, d: str) -> DataFrame:
    return out(pairs.pair_state(aligned(spark, d)).drop("a", "b"))


def pair_chance_query(spark: SparkSession, d: str) -> DataFrame:
    st = pairs.pair_state(aligned(spark, d))
    return out(montecarlo.add_spread_probability(st, ["pair"]).select("pair", "z", "phi", "sigma_eps", "p_value", "win_prob"))


def blocked_query(spark: SparkSession, d: str) -> DataFrame:
    """Recursive averages of the order bars by blocks of 256 bars."""
    x = staged(indicators.add_window_indicators(src.order_bars(spark, d)).select("symbol", "ts", "idx", "tr", "close"), "bars")
    x = recursion.blocked_mean(recursion.blocked_mean(x, "tr", 1 / 14, 14, "atr", 256), "close", 2 / 21, 20, "ema_20", 256)
    return out(x, "symbol", "ts", "atr", "ema_20")


def asof_query(spark: SparkSession, d: str) -> DataFrame:
    """Orders at the close that their symbol had last, a week ago at most, on the calendar of a brand of the symbol's place."""
    o = src.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("ts"), F.concat(F.lit("Brand#"), F.substring("o_orderpriority", 1, 1)).alias("symbol"))
    return out(asof.asof_join(o, src.brand_bars(spark, d, "day"), ["symbol"], ["close"], tolerance=7 * 86400), "o_orderkey", "symbol", "ts", "ts_asof", "close")


def ml_query(spark: SparkSession, d: str) -> DataFrame:
    """Each symbol's models over its last 1250 bars, as a scan has them."""
    m = CONFIG["ml"]
    x = staged(indicators.add_indicators(scan.history(src.order_bars(spark, d))), "ml")
    s = staged(learn.walk_forward(x, m["horizon"], m["k"], m["min_train"], m["refit"]), "scores")
    return out(bt.stats(learn.signal_trades(s, x, m["threshold"], m["horizon"], m["k"])))


def grid_query(name: str) -> Query:
    return lambda spark, d: out(optimize.grid_search(staged(indicators.add_indicators(source_of(name)(spark, d)), "grid"), name).drop("strategy"))


def stream_bars_query(spark: SparkSession, d: str) -> DataFrame:
    return out(stream.run_available(stream.stream_bars(stream.event_stream(spark, d)), ["symbol", "ts"]))


def position_stream_query(spark: SparkSession, d: str) -> DataFrame:
    """Every trend-breakout plan as a signal of a stream, with the bars that close it."""
    x = staged(structured(spark, d), "journal")
    p = journal.number(strategies.plans(x, "trend_breakout", structure=CONFIG["structure"])).withColumn("created_at", F.col("ts"))
    e = positions.in_slices(staged(positions.events(p, x), "events"), 6, "events")
    j = CONFIG["journal"]
    return out(positions.last_moves(positions.follow(e, j["cooldown_days"], j["max_hold_days"])), "signal_id", "symbol", "side", "created_at", "status", "closed_at", "result_r")


def loop_query(spark: SparkSession, d: str) -> DataFrame:
    """The journal that the loop leaves after six batches of bars."""
    b = staged(src.order_bars(spark, d), "bars")
    log = loop.run_loop(positions.in_slices(b, 6, "bars"), f"{stream.shared_dir(spark).rstrip('/')}/loop-{uuid.uuid4().hex}")
    return out(journal.latest(log), "symbol", "strategy", "side", "created_at", "entry", "stop", "target", "status", "closed_at", "result_r")


def latest_query(spark: SparkSession, d: str) -> DataFrame:
    """Plans of the walk's last bars by each symbol's model of all its complete labels."""
    m = CONFIG["ml"]
    x = staged(indicators.add_indicators(scan.history(src.walk_bars(spark, d))), "ml")
    return out(learn.latest_plans(x, m["horizon"], m["k"], m["min_train"], m["threshold"]))


def stream_sessions_query(spark: SparkSession, d: str) -> DataFrame:
    e = src.table(spark, d, "events")
    return out(stream.stream_sessions(e))


PRICES = list(src.PRICES)
_W = ["sma_20", "sma_50", "sma_200", "std_20", "bb_up", "bb_low", "zscore", "donchian_up", "donchian_low", "thrust", "tr", "realized_vol", "drift", "piv_low", "piv_high", "fvg_sup", "fvg_res", "ob_sup", "ob_res"]
_R = ["atr", "rsi", "rsi_2", "macd", "macd_signal", "macd_hist", "ema_20", "kc_up", "kc_low", "adx"]
_round = lambda cols: ", ".join(f"round({c}, 4) AS {c}" for c in cols)
_OHLCV = _round(["open", "high", "low", "close", "volume"])
_FEATURES_SQL = {
    **{f"ret_{n}": f"close / lag(close, {n}) OVER v - 1" for n in (1, 3, 5, 10, 20)}, "mom_63": "close / lag(close, 63) OVER v - 1", "mom_126": "close / lag(close, 126) OVER v - 1",
    "rsi": "rsi", "rsi_2": "rsi_2", "macd_hist_pct": "macd_hist / close", "atr_pct": "atr / close", "zscore": "zscore", "adx": "adx", "pct_b": "(close - bb_low) / nullif(bb_up - bb_low, 0)",
    "dist_ma50": "close / sma_50 - 1", "dist_ma200": "close / sma_200 - 1", "realized_vol": "realized_vol",
    "vol_z": "CASE WHEN idx >= 19 THEN (volume - avg(volume) OVER (v ROWS 19 PRECEDING)) / nullif(stddev_pop(volume) OVER (v ROWS 19 PRECEDING), 0) END",
}

QUERIES: dict[str, tuple[Query, str | None]] = {
    "bars_orders": (lambda s, d: out(src.order_bars(s, d)), f"WITH {sql.BARS} SELECT symbol, ts, {_OHLCV} FROM bars"),
    "bars_brand": (lambda s, d: out(src.brand_bars(s, d)), f"WITH {sql.BRAND} SELECT symbol, ts, {_OHLCV} FROM bars"),
    "bars_events": (lambda s, d: out(src.event_bars(s, d)), f"WITH {sql.EVENTS} SELECT symbol, ts, {_OHLCV} FROM bars"),
    "bars_tail": (lambda s, d: out(src.tail(src.order_bars(s, d), 100)), f"WITH {sql.BARS} SELECT symbol, ts, {_OHLCV} FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 100"),
    "indicators_window": (lambda s, d: out(indicators.add_window_indicators(src.order_bars(s, d)), "symbol", "ts", *_W), f"WITH {sql.BARS}, {sql.WINDOWS} SELECT symbol, ts, {_round(_W)} FROM w"),
    "indicators_recursive": (lambda s, d: out(rows(s, d), "symbol", "ts", *_R), f"{sql.IND} SELECT symbol, ts, {_round(_R)} FROM x"),
    "indicators_blocked": (blocked_query, f"{sql.IND} SELECT symbol, ts, round(atr, 4) AS atr, round(ema_20, 4) AS ema_20 FROM x"),
    "asof_closes": (
        asof_query,
        f"""WITH {sql.BRAND.replace("'week'", "'day'")}, o AS (SELECT o_orderkey, 'Brand#' || o_orderpriority[1] AS symbol, o_orderdate AS ts FROM orders)
        SELECT o.o_orderkey, o.symbol, o.ts, if(o.ts - bars.ts <= INTERVAL 7 DAYS, bars.ts, NULL) AS ts_asof, round(if(o.ts - bars.ts <= INTERVAL 7 DAYS, bars.close, NULL), 4) AS close
        FROM o ASOF LEFT JOIN bars ON o.symbol = bars.symbol AND o.ts >= bars.ts""",
    ),
    "regime": (
        lambda s, d: out(indicators.regime(rows(s, d))),
        f"{sql.IND} SELECT symbol, CASE WHEN a >= 25 THEN 'trending' WHEN a < 20 THEN 'ranging' ELSE 'neutral' END AS regime, round(a, 4) AS adx FROM (SELECT symbol, arg_max(adx, ts) AS a FROM x GROUP BY symbol)",
    ),
    "structure_levels": (
        lambda s, d: out(structured(s, d).select("symbol", "ts", F.size("sup").alias("n_sup"), F.array_min("sup").alias("low_sup"), F.array_max("sup").alias("high_sup"), F.size("res").alias("n_res"), F.array_min("res").alias("low_res"), F.array_max("res").alias("high_res"))),
        f"{sql.IND}, {sql.STRUCTURE} SELECT symbol, ts, len(sup)::INT AS n_sup, round(list_min(sup), 4) AS low_sup, round(list_max(sup), 4) AS high_sup, len(res)::INT AS n_res, round(list_min(res), 4) AS low_res, round(list_max(res), 4) AS high_res FROM y",
    ),
    **{f"strategy_{n}": (plan_query(n), sql.plan_rows(n)) for n in strategies.STRATEGIES},
    **{f"trades_{n}": (trade_query(n), sql.trade_rows(n, sql.FIXED if n == "mean_reversion" else sql.TRAILING)) for n in strategies.STRATEGIES},
    "trades_fixed_exits": (fixed_query("trend_breakout"), sql.trade_rows("trend_breakout", sql.FIXED)),
    "backtest_stats": (lambda s, d: bt.stats(trades(s, d, "trend_breakout")), sql.stat_rows("trend_breakout", sql.TRAILING)),
    "out_of_sample": (lambda s, d: bt.out_of_sample(trades(s, d, "trend_breakout")), sql.late_rows("trend_breakout", sql.TRAILING)),
    "pairs_rolling_z": (lambda s, d: out(pairs.rolling_z(aligned(s, d)).where("z IS NOT NULL").select("pair", "ts", "idx", "beta", "z")), sql.PAIRS),
    "pairs_backtest": (lambda s, d: bt.stats(pairs.pair_trades(pairs.rolling_z(aligned(s, d))), ["pair"]), sql.PAIR_STATS),
    "pairs_state": (pair_query, sql.PAIR_STATE),
    "pairs_chance": (pair_chance_query, scan_sql.PAIR_CHANCE),
    "factor_baskets": (lambda s, d: out(factor.basket_returns(src.brand_bars(s, d))), sql.FACTOR),
    "factor_backtest": (
        lambda s, d: bt.stats(factor.basket_returns(src.brand_bars(s, d)), ["basket"], "t"), sql.FACTOR.replace("SELECT 'momentum'", ", done AS (SELECT 'momentum'").replace("round(avg(fwd) FILTER (hi <= 2) - avg(fwd) FILTER (lo <= 2), 4)", "avg(fwd) FILTER (hi <= 2) - avg(fwd) FILTER (lo <= 2)") + ") " + sql.stat_columns("t", "basket"),
    ),
    "factor_live": (lambda s, d: out(factor.rank_live(indicators.add_structure(indicators.add_indicators(src.brand_bars(s, d)), CONFIG["structure"]["lookback"], CONFIG["structure"]["width"]), structure=CONFIG["structure"])), sql.FACTOR_LIVE),
    "features": (lambda s, d: out(learn.add_features(rows(s, d)), "symbol", "ts", *learn.FEATURES), f"{sql.IND} SELECT symbol, ts, {', '.join(f'round({e}, 4) + 0.0 AS {c}' for c, e in _FEATURES_SQL.items())} FROM x WINDOW v AS (PARTITION BY symbol ORDER BY ts)"),
    "barrier_labels": (lambda s, d: learn.labels(rows(s, d)), sql.LABELS),
    "ml_walk_forward": (ml_query, None),
    "ml_latest_plans": (latest_query, None),
    "signals_scan": (signal_query, scan_sql.SIGNALS),
    "signals_measured": (measured_query, sql.MEASURED),
    "universe_scan": (universe_query, scan_sql.UNIVERSE),
    "position_sizes": (sizes_query, sql.SIZES),
    "signal_cards": (cards_query, sql.CARDS),
    "payload_bars": (payload_query, f"WITH {sql.BARS} SELECT symbol, ts, {', '.join(f'round({c} / if(day(ts) % 4 = 3, 1e6, 1), 4) AS {c}' for c in PRICES)}, 0.0::DOUBLE AS volume FROM bars"),
    "bars_epoch": (epoch_query, f"WITH {sql.BARS} SELECT symbol, ts, {_OHLCV} FROM bars"),
    "universe_classes": (
        classes_query,
        "SELECT p_brand AS symbol, count(*) AS parts, CASE WHEN contains(p_brand, '#1') THEN 'crypto' WHEN contains(p_brand, '#2') THEN 'forex' ELSE 'stock' END AS asset_class FROM part GROUP BY p_brand",
    ),
    "journal_log": (closed_query, f"{sql.RESOLVE} SELECT signal_id, symbol, strategy, side, created_at, status, round(result_r, 4) AS result_r FROM state"),
    "price_labels": (labels_query, sql.LABEL_TEXT),
    "journal_new_signals": (fresh_query, sql.FRESH),
    "portfolio_summary": (portfolio_query, sql.PORTFOLIO),
    "journal_resolve": (lambda s, d: out(state(s, d)[0], "signal_id", "symbol", "strategy", "side", "created_at", "status", "result_r"), f"{sql.RESOLVE} SELECT signal_id, symbol, strategy, side, created_at, status, round(result_r, 4) AS result_r FROM state"),
    "journal_performance": (
        lambda s, d: journal.performance(state(s, d)[0]),
        f"""{sql.RESOLVE} SELECT count(*) AS total, count(*) FILTER (status = 'open') AS open, count(*) FILTER (status <> 'open') AS closed, count(*) FILTER (status = 'tp') AS tp, count(*) FILTER (status = 'sl') AS sl,
        round(count(*) FILTER (status = 'tp') / count(*) FILTER (status <> 'open'), 2 + 2) AS win_rate, round(avg(result_r), 2 + 2) AS avg_r, round(sum(result_r), 2 + 2) AS total_r FROM state""",
    ),
    "position_review": (review_query, sql.REVIEW),
    **{f"optimize_{n}": (grid_query(n), sql.grid_rows(n)) for n in optimize.GRIDS},
    "stream_bars": (stream_bars_query, f"WITH {sql.EVENTS} SELECT symbol, ts, {_OHLCV} FROM bars"),
    "stream_positions": (position_stream_query, sql.MOVES),
    "journal_loop": (loop_query, sql.LOOP),
    "event_sessions": (
        stream_sessions_query,
        """SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 30 MINUTES AS "end", count(*) AS events FROM (
        SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, if(ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTES, 0, 1) AS new FROM events)) GROUP BY user_id, k""",
    ),
}
QUERIES = {name: (query, text and text.replace(", 4)", f" + {NUDGE}, 4)")) for name, (query, text) in QUERIES.items()}
