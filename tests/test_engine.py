import hashlib
import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapewright.functions import draws
from tapewright.functions.core import CONFIG, meter, price_text
from tapewright.functions.report import performance_text, signal_card
from tapewright.operators import asof, backtest, boosting, factor, indicators, journal, montecarlo, pairs, recursion, risk, strategies
from tapewright.sources import bars as src
from tapewright.streaming.bars import track_positions

DIR = "/root/testdata/sf0.001"


def walk(n=300, seed=1, symbol="A", drift=0.0009):
    r = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(r.normal(drift, 0.012, n)))
    open_ = np.concatenate([[100.0], close[:-1]])
    high, low = np.maximum(open_, close) * (1 + r.uniform(0, 0.01, n)), np.minimum(open_, close) * (1 - r.uniform(0, 0.01, n))
    return pd.DataFrame({"symbol": symbol, "ts": pd.date_range("2021-01-01", periods=n, freq="D"), "open": open_, "high": high, "low": low, "close": close, "volume": r.uniform(1e6, 5e6, n)})


@pytest.fixture(scope="module")
def rows(spark):
    b = spark.createDataFrame(pd.concat([walk(), walk(seed=2, symbol="B", drift=-0.0009)]))
    return indicators.add_structure(indicators.add_indicators(b)).persist()


def test_recursive_averages_follow_the_recursion(rows):
    p = walk()
    got = rows.where("symbol = 'A'").orderBy("ts").toPandas()
    prev = p["close"].shift()
    tr = pd.concat([p["high"] - p["low"], (p["high"] - prev).abs(), (p["low"] - prev).abs()], axis=1).max(axis=1)
    want = tr.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    np.testing.assert_allclose(got["atr"].astype(float), want)
    assert got["atr"].first_valid_index() == 13 and got["rsi"].first_valid_index() == 14 and got["adx"].first_valid_index() == 26
    assert got["macd"].first_valid_index() == 25 and got["macd_signal"].first_valid_index() == 33
    assert got["rsi"].dropna().between(0, 100).all()


def test_recursive_averages_of_rows_in_any_order(spark, rows):
    whole = indicators.add_window_indicators(spark.createDataFrame(pd.concat([walk(), walk(seed=2, symbol="B", drift=-0.0009)])))
    mixed = whole.where("idx % 2 = 0").unionByName(whole.where("idx % 2 = 1")).repartition(5, "idx")
    got = indicators.add_recursive_indicators(mixed).orderBy("symbol", "ts").toPandas()
    want = rows.orderBy("symbol", "ts").toPandas()
    np.testing.assert_allclose(got["atr"].astype(float), want["atr"].astype(float))
    np.testing.assert_allclose(got["macd_signal"].astype(float), want["macd_signal"].astype(float))


def test_plans_must_be_finite(spark):
    from tapewright.functions.core import valid_plan

    d = spark.createDataFrame([("LONG", 1.0, 2.0, 3.0), ("LONG", 1.0, 2.0, float("nan")), ("LONG", 1.0, 2.0, float("inf")), ("SHORT", float("nan"), 2.0, 1.0), ("LONG", None, 2.0, 3.0)], "side string, stop double, entry double, target double")
    assert [r.v for r in d.select(valid_plan().alias("v")).collect()] == [True, False, False, False, False]


def test_resolve_against_a_loop(spark):
    r = np.random.default_rng(14)
    bars = walk(500, 9)[["symbol", "ts", "high", "low", "close"]]
    sig = []
    for i in range(60):
        k = int(r.integers(0, 500))
        up, c = bool(r.integers(2)), float(bars.close[k])
        gap = c * float(r.choice([0.01, 0.05, 0.4]))
        sig.append((i, bars.ts[k].to_pydatetime(), "A", "stock", "s", "LONG" if up else "SHORT", c, c - gap if up else c + gap, c + 2 * gap if up else c - 2 * gap))
    s = spark.createDataFrame(sig, "signal_id long, created_at timestamp, symbol string, asset_class string, strategy string, side string, entry double, stop double, target double")
    got = {x.signal_id: (x.status, x.closed_at) for x in journal.resolve(s, spark.createDataFrame(bars), F.lit(bars.ts[499].to_pydatetime())).collect()}
    for i, at, *_, side, entry, stop, goal in sig:
        later = bars[bars.ts > at]
        sl, tp = (later.low <= stop, later.high >= goal) if side == "LONG" else (later.high >= stop, later.low <= goal)
        ends = later[sl | tp]
        if len(ends):
            assert got[i] == ("sl" if sl[ends.index[0]] else "tp", ends.ts.iloc[0]), i
        elif len(later) and (bars.ts[499] - pd.Timestamp(at)).days >= 30:
            assert got[i] == ("expired", later.ts.iloc[-1])
        else:
            assert got[i] == ("open", None)


def test_extremes_since_creation(spark):
    r = np.random.default_rng(6)
    bars = pd.concat([walk(400, 9), walk(150, 10, "B")])[["symbol", "ts", "high", "low"]]
    sig = [(i, "AB"[i % 2], bars.ts.iloc[int(r.integers(0, 400))].to_pydatetime() + timedelta(hours=int(r.integers(0, 9)))) for i in range(80)]
    got = {x.signal_id: (x.hi_since, x.lo_since) for x in journal.extremes_since(spark.createDataFrame(sig, "signal_id long, symbol string, created_at timestamp"), spark.createDataFrame(bars)).collect()}
    for i, s, at in sig:
        later = bars[(bars.symbol == s) & (bars.ts > at)]
        assert got[i] == ((later.high.max(), later.low.min()) if len(later) else (None, None))


def test_state_carries_over_batches():
    x = np.random.default_rng(3).normal(size=50)
    x[[20, 21, 30]] = np.nan
    whole, _ = indicators.exponential_mean(x, 0.2, 5, None)
    a, state = indicators.exponential_mean(x[:22], 0.2, 5, None)
    b, _ = indicators.exponential_mean(x[22:], 0.2, 5, state)
    np.testing.assert_allclose(np.concatenate([a, b]), whole)


@pytest.mark.parametrize(("alpha", "block"), [(1 / 14, 16), (0.5, 1024), (2 / 13, 7), (0.9, 1024)])
def test_blocked_means_are_the_streamed_ones(spark, alpha, block):
    r, want, parts = np.random.default_rng(8), [], []
    for symbol, n in (("A", 1500), ("B", 40), ("C", 300), ("D", 5)):
        x = 100 + np.cumsum(r.normal(size=n))
        x[r.random(n) < 0.2] = np.nan
        if symbol == "C":
            x[:70] = x[100:160] = np.nan
        if symbol == "D":
            x[:] = np.nan
        want.append(indicators.exponential_mean(x, alpha, 9, None)[0])
        parts.append(pd.DataFrame({"symbol": symbol, "idx": np.arange(n), "x": x}))
    got = recursion.blocked_mean(spark.createDataFrame(pd.concat(parts)).repartition(5), "x", alpha, 9, "y", block).orderBy("symbol", "idx").toPandas()
    np.testing.assert_allclose(got["y"].astype(float), np.concatenate(want), rtol=1e-9)
    assert len(got) == 1845


def test_asof_join_against_a_loop(spark):
    r = np.random.default_rng(4)
    day = lambda n: datetime(2024, 1, 1) + timedelta(hours=int(n))
    left = [(i, "AB"[int(r.random() < 0.2)] if i % 17 else None, day(r.integers(0, 4000)) if i % 13 else None) for i in range(400)] + [(5, "A", day(7))] * 2
    right = [("AB"[int(r.random() < 0.3)], day(t), float(v)) for t, v in zip(r.integers(0, 4000, 120), r.normal(size=120), strict=True)] + [("A", None, 1.0), (None, day(3), 2.0)]
    a = spark.createDataFrame(left, "id int, k string, ts timestamp").withColumn("v", F.lit("own"))
    b = spark.createDataFrame(right, "k string, ts timestamp, price double")
    for tolerance, bucket in ((None, 10 * 86400), (5 * 86400, 86400), (3600, 10**9)):
        got = sorted(((r.id, r.k, r.ts, r.ts_asof, r.price) for r in asof.asof_join(a, b, ["k"], ["price"], tolerance=tolerance, bucket=bucket).collect()), key=str)
        want = []
        for i, k, t in left:
            p = max(((s, v) for q, s, v in right if q == k and k and s and t and s <= t), default=None)
            p = p if p and (tolerance is None or (t - p[0]).total_seconds() <= tolerance) else (None, None)
            want.append((i, k, t, *p))
        assert got == sorted(want, key=str) and any(w[3] for w in want)
    assert asof.asof_join(a, b.where("false"), ["k"], ["price"]).where("price IS NULL").count() == len(left)
    assert asof.asof_join(a.where("false"), b, ["k"], ["price"]).count() == 0


def test_no_look_ahead(spark, rows):
    short = indicators.add_indicators(spark.createDataFrame(walk().head(250))).orderBy("ts").toPandas()
    full = rows.where("symbol = 'A'").orderBy("ts").toPandas().head(250)
    for c in ("sma_200", "atr", "adx", "macd_signal", "zscore", "donchian_up", "thrust"):
        np.testing.assert_allclose(short[c].astype(float), full[c].astype(float), err_msg=c)


def test_flat_series_has_rsi_100(spark):
    p = walk(40)
    p[["open", "high", "low", "close"]] = 5.0
    got = indicators.add_indicators(spark.createDataFrame(p)).orderBy("ts").toPandas()
    assert (got["rsi"].iloc[14:] == 100).all() and got["zscore"].isna().all()


@pytest.mark.parametrize("name", list(strategies.STRATEGIES))
def test_plans_are_valid(rows, name):
    p = strategies.plans(rows, name, structure=CONFIG["structure"]).toPandas()
    up = p["side"] == "LONG"
    assert ((p["stop"] < p["entry"]) == up).all() and ((p["target"] > p["entry"]) == up).all()


def test_exits_and_selection_match_a_loop(rows):
    plan = strategies.plans(rows, "trend_breakout", structure=CONFIG["structure"])
    bars = rows.select("symbol", "idx", "high", "low", "close")
    got = backtest.backtest(plan, bars, trail=3.0).orderBy("symbol", "idx").toPandas()
    want = []
    by = {s: g.sort_values("idx").reset_index(drop=True) for s, g in bars.toPandas().groupby("symbol")}
    for s, g in plan.toPandas().groupby("symbol"):
        free, b = -1, by[s]
        for x in g.sort_values("idx").itertuples():
            if x.idx <= free:
                continue
            up, end = x.side == "LONG", min(x.idx + 60, len(b) - 1)
            best, stop = (b.high if up else b.low)[x.idx], x.stop
            stop = max(stop, best - 3 * x.atr) if up else min(stop, best + 3 * x.atr)
            price, at = b.close[end], end
            for j in range(x.idx + 1, end + 1):
                if (b.low[j] <= stop) if up else (b.high[j] >= stop):
                    price, at = stop, j
                    break
                best = max(best, b.high[j]) if up else min(best, b.low[j])
                stop = max(stop, best - 3 * x.atr) if up else min(stop, best + 3 * x.atr)
            want.append((s, x.idx, at, (price - x.entry) * (1 if up else -1) / abs(x.entry - x.stop)))
            free = at
    assert [(a.symbol, a.idx, a.exit_idx) for a in got.itertuples()] == [w[:3] for w in want]
    np.testing.assert_allclose(got["r"], [w[3] for w in want])


def test_stats_of_known_returns(spark):
    t = spark.createDataFrame([("s", "A", i, r) for i, r in enumerate([1.0, -1.0, 2.0, 0.0])], "strategy string, symbol string, idx int, r double")
    x = backtest.stats(t).first()
    assert (x.trades, x.win_rate, x.profit_factor, x.expectancy, x.max_drawdown) == (4, 0.5, 3.0, 0.5, 1.0)
    assert backtest.out_of_sample(t).first().trades == 2
    assert backtest.stats(t.where("r > 0")).first().profit_factor == 999.0


def test_normalise_and_payload(spark):
    r = spark.createDataFrame([("A", "2021-01-01", "1", "2", "0.5", "1.5", "9", 1), ("A", "2021-01-01", "1", "3", "0.5", "2.5", "9", 2), ("A", "2021-01-02", "x", "3", "1", "2", "9", 3)], "symbol string, ts string, open string, high string, low string, close string, volume string, ingest_seq int")
    assert [tuple(x) for x in src.normalise(r).collect()] == [("A", "2021-01-01", 1.0, 3.0, 0.5, 2.5, 9.0)]
    body = '{"data": [["1,000", "900", "1,100", "1,050", "5", "1%", "<b>2024/01/02</b>", "1402/10/12"], ["bad"], ["10", "9", "11", "10", "1", "1%", "2024/01/03", "x"]]}'
    got = src.parse_payload(spark.createDataFrame([("g", body)], "symbol string, body string")).orderBy("ts").collect()
    assert [(x.open, x.high, x.low, x.close) for x in got] == [(1000.0, 1100.0, 900.0, 1050.0), (10.0, 11.0, 9.0, 10.0)]


def test_scalars(spark):
    x = spark.createDataFrame([(12345.678,), (1.25,), (0.0001234,)], "p double").select(price_text(F.col("p")).alias("t"), meter(F.lit(0.52)).alias("m")).collect()
    assert [r.t for r in x] == ["12,345.68", "1.25", "0.000123"] and x[0].m == "#####-----"
    s = spark.createDataFrame([("BTC/USDT",), ("EURUSD=X",), ("AAPL",)], "s string").select(src.asset_class(F.col("s")).alias("c")).collect()
    assert [r.c for r in s] == ["crypto", "forex", "stock"]


def test_pairs_accept_and_reject(spark):
    r = np.random.default_rng(3)
    b = 50 + np.cumsum(r.normal(0, 0.5, 400))
    e = np.zeros(400)
    for i in range(1, 400):
        e[i] = 0.6 * e[i - 1] + r.normal(0, 1)
    ts = pd.date_range("2021-01-01", periods=400)
    df = pd.concat([pd.DataFrame({"symbol": s, "ts": ts, "close": v}) for s, v in (("a", 1.8 * b + 10 + e), ("b", b), ("c", 50 + np.cumsum(np.random.default_rng(7).normal(0, 0.5, 400))))])
    al = pairs.align(spark.createDataFrame(df), spark.createDataFrame([("a", "b"), ("a", "c")], "symbol_a string, symbol_b string"))
    p = {x.pair: x for x in pairs.pair_state(al).collect()}
    assert p["a/b"].p_value <= 0.05 < p["a/c"].p_value and abs(p["a/b"].beta - 1.8) < 0.2
    z = pairs.rolling_z(al).where("pair = 'a/b' AND z IS NOT NULL").orderBy("ts").first()
    w = np.polyfit(b[:252], (1.8 * b + 10 + e)[:252], 1)
    assert abs(z.beta - w[0]) < 1e-9
    assert pairs.pair_trades(pairs.rolling_z(al)).count() > 0


def test_pair_machine_by_hand(spark):
    z = [0.0, -2.2, -1.0, -0.4, 2.5, 3.0, 3.6, 2.1, 0.4, 2.0]
    df = spark.createDataFrame([("p", i, i, v) for i, v in enumerate(z)], "pair string, ts long, idx int, z double")
    got = [(x.idx, round(x.r, 9)) for x in pairs.pair_trades(df, least=10).orderBy("idx").collect()]
    assert got == [(3, round(1.8 / 1.5, 9)), (6, -1.0), (8, round(1.7 / 1.5, 9))]
    assert pairs.pair_trades(df, least=11).count() == 0


def draw(seed, path, step):
    """The 32 bits of a step, by the rule."""
    return int(hashlib.md5(f"{seed}:{path}:{step // 4}".encode()).hexdigest()[8 * (step % 4) : 8 * (step % 4) + 8], 16)


def normal_draw(seed, path, step):
    even = step - step % 2
    far, turn = (math.sqrt(-2 * math.log((draw(seed, path, even) + 0.5) / 2**32)), 2 * math.pi * (draw(seed, path, even + 1) + 0.5) / 2**32)
    return far * (math.sin(turn) if step % 2 else math.cos(turn))


def chances(spark, cases, sims=4000):
    d = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "k int, side string, entry double, stop double, target double, atr double, d double")
    return [r.win_prob for r in montecarlo.add_barrier_probability(d, ["k"], "d", sims=sims).orderBy("k").collect()]


def spreads(spark, cases, sims=4000):
    d = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "k int, z double, phi double, sigma_eps double")
    return [r.win_prob for r in montecarlo.add_spread_probability(d, ["k"], sims=sims).orderBy("k").collect()]


def trades_of(spark, lists):
    return spark.createDataFrame([(k, i, float(r)) for k, rs in lists.items() for i, r in enumerate(rs)], "k string, idx int, r double")


def test_monte_carlo(spark):
    got = {r.k: r for r in montecarlo.bootstrap(trades_of(spark, {"good": [2, 2, -1, 2, 2], "bad": [-1, -1, 0.5, -1]}), ["k"]).collect()}
    assert got["good"].prob_profitable > 0.9 > 0.1 > got["bad"].prob_profitable
    none = montecarlo.add_bootstrap(spark.createDataFrame([("x",)], "k string"), trades_of(spark, {"y": [1]}), ["k"]).first()
    assert (none.prob_profitable, none.median_total, none.p05_total, none.risk_of_ruin) == (0.0, 0.0, 0.0, 1.0)
    flat, up, down = chances(spark, [("LONG", 100.0, 98.0, 104.0, 0.0, None), ("LONG", 100.0, 98.0, 104.0, 1.0, 0.5), ("LONG", 100.0, 98.0, 104.0, 1.0, -0.5)])
    assert flat == pytest.approx(1 / 3, abs=1e-4) and up > down
    back, free = spreads(spark, [(2.5, 0.5, 0.3), (2.5, 0.0, 1.0)])
    assert back > 0.9 and free == pytest.approx(1 / 3, abs=1e-4)


def test_draws_are_uniform_and_normal(spark):
    z = np.array([r.z for r in spark.range(2000).select(draws.normals(5, F.col("id"), 10).alias("z")).collect()])
    assert z.shape == (2000, 10) and abs(z.mean()) < 0.02 and abs(z.std() - 1) < 0.02 and abs((np.abs(z) > 1.96).mean() - 0.05) < 0.01
    assert abs(np.corrcoef(z.T) - np.eye(10)).max() < 0.09
    np.testing.assert_allclose(z[7], [normal_draw(5, 7, s) for s in range(10)], rtol=1e-12)


def test_sizing_and_portfolio(spark):
    s = spark.createDataFrame([("a", "stock", "LONG", 100.0, 98.0, 0.6, 2.0), ("b", "iran", "SHORT", 100.0, 102.0, 0.2, 0.5)], "symbol string, asset_class string, side string, entry double, stop double, win_rate double, profit_factor double")
    z = risk.add_size(s, 10000.0, 1.0, 0.5, 5.0)
    x = {r.symbol: r for r in z.collect()}
    assert x["a"].units == pytest.approx(5.0) and x["b"].units == 0.0
    f = {r.symbol: r.forecast_only for r in risk.apply_short_policy(z).collect()}
    assert f == {"a": False, "b": True} and risk.apply_short_policy(z, "off").count() == 1
    p = risk.portfolio(z, 10000.0).first()
    assert (p.n, p.longs, p.shorts) == (2, 1, 1) and p.risk_pct == pytest.approx(0.1) and risk.portfolio(z.where("false"), 10000.0).first().n == 0


def test_journal_ties_cooldown_and_stream(spark, tmp_path):
    t = datetime(2024, 1, 1)
    sig = spark.createDataFrame([(1, t, "A", "stock", "s", "LONG", 100.0, 98.0, 104.0), (2, t, "B", "stock", "s", "SHORT", 100.0, 102.0, 96.0), (3, t, "C", "stock", "s", "LONG", 100.0, 90.0, 200.0), (4, t, "D", "stock", "s", "LONG", 1.0, 0.5, 2.0)],
                                "signal_id long, created_at timestamp, symbol string, asset_class string, strategy string, side string, entry double, stop double, target double")
    log = sig.select(*journal.SIGNAL, F.col("created_at").alias("at"), F.lit("open").alias("status"), F.lit(None).cast("timestamp").alias("closed_at"), F.lit(None).cast("double").alias("result_r"))
    d = lambda n: t + timedelta(days=n)
    bars = spark.createDataFrame([("A", d(1), 105.0, 97.0, 100.0), ("B", d(1), 101.0, 99.0, 100.0), ("B", d(2), 101.0, 95.0, 96.0), ("C", d(40), 120.0, 95.0, 110.0), ("D", d(-1), 9.0, 0.1, 1.0)], "symbol string, ts timestamp, high double, low double, close double")
    got = {x.signal_id: (x.status, x.result_r) for x in journal.resolve(journal.latest(log), bars, F.lit(d(40))).collect()}
    assert got == {1: ("sl", -1.0), 2: ("tp", 2.0), 3: ("expired", 1.0), 4: ("open", None)}
    assert journal.new_signals(sig, log, F.lit(d(2))).count() == 0 and journal.new_signals(sig, log, F.lit(d(9))).count() == 4
    bars.write.parquet(str(tmp_path / "bars"))
    live = track_positions(spark.readStream.schema(bars.schema).parquet(str(tmp_path / "bars")), sig)
    q = live.writeStream.format("memory").queryName("closed").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert {x.signal_id: (x.status, x.result_r) for x in spark.table("closed").collect()} == {k: v for k, v in got.items() if v[0] != "open"}


def test_review(spark):
    cases = [("LONG", 100.0, 98.0, 110.0, 103.0, 1.0, 90.0, 1.0, 103.5, 99.0, None), ("LONG", 100.0, 98.0, 104.0, 104.5, 1.0, 90.0, 1.0, 104.5, 99.0, None), ("SHORT", 100.0, 102.0, 90.0, 99.0, 1.0, 95.0, -1.0, 100.0, 99.0, None), ("LONG", 100.0, 98.0, 110.0, 101.0, 1.0, 90.0, 1.0, 101.0, 99.0, 105.0)]
    cols = "side string, entry double, stop double, target double, current double, atr double, ma_trend double, macd_hist double, hi_since double, lo_since double, next_level double"
    a, b, c, e = journal.review(spark.createDataFrame(cases, cols)).collect()
    assert a.trailed and a.recommended_sl == 100.5 and b.tp_reason == "target reached" and c.danger and c.recommended_tp == 99.0 and e.tp_reason == "level ahead" and e.recommended_tp == 104.75


def test_momentum_and_entry(spark):
    import __spark_entry__ as e

    panel = pd.concat([walk(400, 20 + j, f"S{j}", 0.0006 * (j - 2)) for j in range(6)])
    x = backtest.stats(factor.basket_returns(spark.createDataFrame(panel)), ["basket"], "t").first()
    assert x.trades == 12
    assert e.entry(spark).columns[:3] == ["strategy", "symbol", "ts"]
    assert all(k in e.queries() for k in e.oracle_sql())


def test_live_ranking_needs_enough_symbols_and_bars(spark):
    def legs(n, bars):
        b = spark.createDataFrame(pd.concat([walk(bars, 20 + j, f"S{j}", 0.0006 * (j - 2)) for j in range(n)]))
        x = indicators.add_structure(indicators.add_indicators(b))
        return [(r.side, r["rank"], r.stop < r.entry < r.target if r.side == "LONG" else r.target < r.entry < r.stop) for r in factor.rank_live(x, structure=CONFIG["structure"]).collect()]

    got = legs(6, 200)
    assert got and all(ok for *_, ok in got) and len(got) <= 4
    assert not legs(3, 200) and not legs(6, 148)


def test_signals_are_numbered_by_symbol_and_bar(spark):
    plans = spark.createDataFrame([("B", 3), ("A", 9), (None, 4), ("A", 2), ("B", 1)], "symbol string, idx int")
    got = {(r.symbol, r.idx): r.signal_id for r in journal.number(plans).collect()}
    assert got == {(None, 4): 1, ("A", 2): 2, ("A", 9): 3, ("B", 1): 4, ("B", 3): 5}
    assert journal.number(plans.where("false")).count() == 0


def test_cards(spark):
    s = "strategy string, symbol string, side string, entry double, stop double, target double, units double"
    got = spark.createDataFrame([("t", "A", "LONG", 100.5, 98.0, 2000.0, 2.0), ("t", "B", "SHORT", 0.25, None, 0.125, 0.0)], s).select(signal_card().alias("c"))
    assert [r.c for r in got.collect()] == ["LONG A (t)\nentry 100.5, stop 98, target 2,000.00\nunits 2", "SHORT B (t)\nentry 0.25, stop n/a, target 0.125\nforecast only"]
    p = "total long, open long, closed long, tp long, sl long, win_rate double, avg_r double, total_r double"
    got = spark.createDataFrame([(3, 1, 2, 1, 1, 0.5, 0.5, 1.0), (1, 1, 0, 0, 0, 0.0, 0.0, 0.0)], p).select(performance_text().alias("c"))
    assert [r.c for r in got.collect()] == ["3 signals, 1 open, 2 closed (1 at target, 1 at stop); won 50.0%, total 1.00 R", "1 signals, 1 open, 0 closed (0 at target, 0 at stop); nothing closed yet"]


def test_payload_forms(spark):
    cells = [
        (["0.00001234", "0.00001", "0.00002", "0.000015", "5", "1%", "2024-01-02 00:00"], (datetime(2024, 1, 2), 0.00001234, 0.00002, 0.00001, 0.000015)),
        (["1.2e-5", "1E-5", "2e-5", "+1.5e-5", "5", "2024/01/03"], (datetime(2024, 1, 3), 1.2e-5, 2e-5, 1e-5, 1.5e-5)),
        (["12345678901234567890", "1", "2", "3", "x", "2024-01-04T10:30:00Z"], (datetime(2024, 1, 4, 10, 30), 12345678901234567890.0, 12345678901234567890.0, 1.0, 3.0)),
        (["<td>1,000</td>", " 900 ", "1,100.5", "1,050", *["0"] * 120, "<b>Jan 5, 2024</b>"], (datetime(2024, 1, 5), 1000.0, 1100.5, 900.0, 1050.0)),
        ([1.5, 1, 2, 1.25, 0, "1402/10/27", "1/16/2024"], (datetime(2024, 1, 16), 1.5, 2.0, 1.0, 1.25)),
        (["nan", "1", "2", "3", "5", "2024-01-07"], None), (["1d", "1", "2", "3", "5", "2024-01-08"], None), (["1", "1", "2", "3", "5", "1402/10/27"], None), (["1", "2", "3", "2024-01-09"], None),
        (["1", None, "2", "3", "5", "2024-01-10"], None),
    ]
    import json

    bodies = [("g", json.dumps({"data": [c for c, _ in cells]})), ("bad", "no json"), ("none", None), ("empty", '{"data": []}')]
    got = src.parse_payload(spark.createDataFrame(bodies, "symbol string, body string")).orderBy("ts").collect()
    assert [(r.ts, r.open, r.high, r.low, r.close) for r in got] == [w for _, w in cells if w]


def test_monte_carlo_against_loops(spark):
    """The same draws, path by path."""
    def target(side, entry, stop, goal, sigma, drift):
        won = 0
        for path in range(300):
            x = entry
            for step in range(60):
                x += drift + sigma * normal_draw(7, path, step)
                if (x <= stop) if side == "LONG" else (x >= stop):
                    break
                if (x >= goal) if side == "LONG" else (x <= goal):
                    won += 1
                    break
        return round(won / 300, 4)

    cases = [("LONG", 100.0, 98.0, 104.0, 1.0, 0.1), ("SHORT", 100.0, 102.0, 97.0, 0.7, 0.05), ("LONG", 100.0, 90.0, 130.0, 0.5, 0.0)]
    want = [target(*c) for c in cases]
    assert chances(spark, cases, 300) == pytest.approx(want, abs=1e-4)
    won = 0
    for path in range(300):
        z = 2.5
        for step in range(60):
            z = 0.7 * z + 0.6 * normal_draw(11, path, step)
            if abs(z) <= 0.5 or abs(z) >= 3.5:
                won += abs(z) <= 0.5
                break
    assert spreads(spark, [(2.5, 0.7, 0.6)], 300) == pytest.approx([won / 300], abs=1e-4)
    lists = {"a": [1.5, -1.0, 0.25, -1.0, 2.0, -0.5, 3.125], "b": [-1.0], "c": [-3.0, 1.0, -2.5]}
    got = {r.k: r for r in montecarlo.bootstrap(trades_of(spark, lists).repartition(3), ["k"], sims=200, ruin=5.0).collect()}
    for k, rs in lists.items():
        paths = [np.cumsum([rs[draw(42, p, s) * len(rs) >> 32] for s in range(len(rs))]) for p in range(200)]
        total = [p[-1] for p in paths]
        assert got[k].prob_profitable == pytest.approx(np.mean(np.array(total) > 0)) and got[k].risk_of_ruin == pytest.approx(np.mean([p.min() <= -5 for p in paths]))
        assert got[k].median_total == pytest.approx(np.median(total), abs=1e-4) and got[k].p05_total == pytest.approx(np.percentile(total, 5), abs=1e-4)


def test_classes_in_the_scan(spark):
    """Symbols are ranked among their class, and shorts that can't be sold short are forecasts without a size."""
    from tapewright.operators import scan

    names = [f"S{j}" for j in range(6)] + [f"C{j}" for j in range(5)] + ["G0", "G1"]
    b = pd.concat([walk(420, 20 + j, n, 0.0012 * (j % 5 - 2)) for j, n in enumerate(names)])
    x = indicators.add_structure(indicators.add_indicators(spark.createDataFrame(b))).persist()
    listed = spark.createDataFrame([(n, "crypto") for n in names if n[0] == "C"] + [(n, "iran") for n in names if n[0] == "G"], "symbol string, class string")
    got = scan.universe_scan(x, None, listed).toPandas()
    assert set(got["asset_class"]) == {"stock", "crypto", "iran"} and (got["asset_class"] == got["symbol"].str[0].map({"S": "stock", "C": "crypto", "G": "iran"})).all()
    barred = (got["asset_class"] == "iran") & (got["side"] == "SHORT")
    assert barred.any() and (got["forecast_only"] == barred).all() and (got.loc[barred, ["units", "notional", "risk_amount"]] == 0).all().all()
    legs = got[got["strategy"] == "factor_momentum"]
    assert set(legs["asset_class"]) == {"stock", "crypto"}
    c = CONFIG["factor"]
    for kind, g in legs.groupby("asset_class"):
        alone = x.where(F.col("symbol").startswith(kind[0].upper()))
        want = {(r.symbol, r.side) for r in factor.rank_live(alone, structure=CONFIG["structure"]).collect()}
        assert set(zip(g["symbol"], g["side"], strict=True)) == want
        stats = backtest.stats(factor.basket_returns(alone, c["lookback"], c["skip"], c["hold"], c["top"], c["bottom"]), ["basket"], "t").first()
        assert (g["trades"] == stats.trades).all() and (g["profit_factor"] == stats.profit_factor).all()
    off = scan.assess(x.where("false").selectExpr("symbol", "'stock' AS asset_class", "'LONG' AS side", "close AS entry", "close AS stop", "close AS target", "0.5D AS win_prob", "0.5D AS baseline_win_prob"), trades_of(spark, {"S0": [1]}).withColumnRenamed("k", "symbol"), ["symbol"], short_mode="off")
    assert off.count() == 0
    kept = risk.apply_short_policy(got_df := spark.createDataFrame([("iran", "SHORT", 3.0), ("iran", "LONG", 3.0), ("stock", "SHORT", 3.0)], "asset_class string, side string, units double"), "off")
    assert kept.count() == 2 and risk.apply_short_policy(got_df, "trade").where("units > 0").count() == 3


def test_unit_root_against_least_squares(spark):
    r = np.random.default_rng(5)
    b = 50 + np.cumsum(r.normal(0, 0.5, 260))
    a = 1.3 * b + r.normal(0, 1, 260)
    ts = pd.date_range("2021-01-01", periods=260)
    flat = pd.DataFrame({"pair": "flat", "ts": ts, "a": a, "b": 1.0})
    df = pd.concat([pd.DataFrame({"pair": "p", "ts": ts, "a": a, "b": b}), flat, flat.head(20).assign(pair="short", b=b[:20])])
    got = pairs.pair_state(spark.createDataFrame(df)).collect()
    assert [x.pair for x in got] == ["p"]
    x, a, b = got[0], a[-252:], b[-252:]
    beta, alpha = np.polyfit(b, a, 1)
    s = a - beta * b - alpha
    d = np.diff(s)
    m = np.column_stack([np.ones(250), s[1:-1], d[:-1]])
    c = np.linalg.lstsq(m, d[1:], rcond=None)[0]
    e = d[1:] - m @ c
    assert x.beta == pytest.approx(beta) and x.t == pytest.approx(c[1] / np.sqrt(e @ e / 247 * np.linalg.inv(m.T @ m)[1, 1]))
    z = s / s.std()
    phi = max(0, (z[:-1] * z[1:]).sum() / (z[:-1] ** 2).sum())
    assert x.phi == pytest.approx(phi) and x.sigma_eps == pytest.approx(np.std(z[1:] - phi * z[:-1])) and x.z == pytest.approx(z[-1])


def test_selection_carries_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        r = np.random.default_rng(6)
        rows = [("s", sym, int(i), int(i + r.integers(0, 9)), 1.0) for sym in "ABC" for i in range(40)]
        got = {(x.symbol, x.idx) for x in backtest.select_trades(spark.createDataFrame(rows, "strategy string, symbol string, idx int, exit_idx int, r double")).collect()}
        want = set()
        for sym in "ABC":
            free = -1
            for _, s, i, e, _ in rows:
                if s == sym and i > free:
                    want.add((s, i))
                    free = e
        assert got == want
        z = [("p", i, i, float(v)) for i, v in enumerate(r.normal(0, 2, 90))]
        got = [(x.idx, x.r) for x in pairs.pair_trades(spark.createDataFrame(z, "pair string, ts long, idx int, z double"), least=10).orderBy("idx").collect()]
        want, side, at = [], 0, 0.0
        for _, _, i, v in z:
            if side == 0:
                side, at = (1 if v <= -2 else -1 if v >= 2 else 0), v
            elif side * v >= -0.5:
                want.append((i, side * (v - at) / 1.5))
                side = 0
            elif side * v <= -3.5:
                want.append((i, -1.0))
                side = 0
        assert got == [(i, pytest.approx(v)) for i, v in want] and len(want) > 5
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_grid_and_scan(rows):
    from tapewright.functions.report import forecast_card, grid_line, management_text, portfolio_text, scan_line
    from tapewright.operators import optimize, scan

    got = optimize.grid_search(rows, "dual_thrust")
    best = got.where("place = 1").collect()
    assert got.select("params").distinct().count() <= 27 and all(r.score == max(x.score for x in got.where(F.col("symbol") == r.symbol).collect()) for r in best)
    assert got.select(grid_line().alias("t")).first().t.startswith("bars=")
    bars = rows.select("symbol", "ts", "open", "high", "low", "close", "volume")
    one = optimize.optimize_symbol(bars, "A", "macd_trend").collect()
    assert [r.place for r in one] == list(range(1, len(one) + 1)) and {r.symbol for r in one} <= {"A"}
    assert scan.history(bars, 100, 60).count() == 200 and scan.history(bars, 100, 301).count() == 0
    s = scan.universe_scan(rows)
    x = s.collect()
    assert [r.place for r in x] == list(range(1, len(x) + 1)) and [r.confidence for r in x if not r.published] == sorted((r.confidence for r in x if not r.published), reverse=True)
    for r in x:
        risk_gap = abs(r.entry - r.stop)
        assert r.risk_free_at == pytest.approx(r.entry + (risk_gap if r.side == "LONG" else -risk_gap), abs=1e-5) and r.equity_pct == pytest.approx(r.notional / 100, abs=0.01)
    assert all(t.t for t in s.select(scan_line().alias("t")).collect()) and all(t.t for t in s.select(forecast_card().alias("t")).collect())
    assert risk.portfolio(s, 10000.0).select(portfolio_text().alias("t")).first().t.startswith(f"{len(x)} positions")
    assert risk.portfolio(s.where("false"), 10000.0).select(portfolio_text().alias("t")).first().t == ""
    p = rows.sparkSession.createDataFrame([("LONG", "A", 1.25, 98.0, 110.0, "let it run", False, False, True, False)], "side string, symbol string, r_now double, recommended_sl double, recommended_tp double, tp_reason string, danger boolean, near_target boolean, at_breakeven boolean, trailed boolean")
    assert p.select(management_text().alias("t")).first().t == "LONG A +1.25 R: stop 98, take profit 110 (let it run); free of risk"


def test_latest_model_plans(rows):
    from tapewright.operators import learn

    got = learn.latest_plans(rows, threshold=0.5, iterations=3).collect()
    assert {r.symbol for r in got} == {"A", "B"} and all(abs(r.target - r.entry) == pytest.approx(1.5 * r.atr) and 0 <= r.prob_up <= 1 for r in got)
    assert all((r.stop < r.entry < r.target) == (r.prob_up >= 0.5) for r in got)
    assert learn.latest_plans(rows.where("idx < 200"), iterations=3).count() == 0


def plain_boosting(x, y, at, iterations, leaf=20, l2=1.0, rate=0.05, depth=3):
    """Trees by trying every cut of every node, one after the other."""
    base = math.log(y.mean() / (1 - y.mean()))
    f, out = np.full(len(y), base), np.full(len(at), base)
    for _ in range(iterations):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, p * (1 - p)
        score = lambda m, g=g, h=h: g[m].sum() ** 2 / (h[m].sum() + l2)

        def grow(rows, there, level, g=g, h=h, score=score):
            best = (0.0, None)
            for j in range(x.shape[1]):
                v = np.unique(x[np.isfinite(x[:, j]), j])
                for c in (v[1:] + v[:-1]) / 2:
                    for unknown in (False, True):
                        left = rows & np.where(np.isfinite(x[:, j]), x[:, j] <= c, unknown)
                        right = rows & ~left
                        if left.sum() < leaf or right.sum() < leaf:
                            continue
                        gain = round(score(left) + score(right) - score(rows), 12)
                        if gain > best[0]:
                            best = (gain, (j, c, unknown))
            if level == depth or best[1] is None:
                value = -rate * g[rows].sum() / (h[rows].sum() + l2)
                f[rows] += value
                out[there] += value
                return
            j, c, unknown = best[1]
            go = lambda a: np.where(np.isfinite(a[:, j]), a[:, j] <= c, unknown)
            grow(rows & go(x), there & go(at), level + 1)
            grow(rows & ~go(x), there & ~go(at), level + 1)

        grow(np.ones(len(y), bool), np.ones(len(at), bool), 0)
    return 1 / (1 + np.exp(-out))


def test_boosting_is_that_of_plain_trees():
    r = np.random.default_rng(5)
    x = np.round(r.normal(size=(150, 3)), 1)
    x[r.random((150, 3)) < 0.15] = np.nan
    x[:, 2] = np.where(np.isnan(x[:, 1]), 1.0, x[:, 2])
    y = (np.nan_to_num(x[:, 0], nan=0.7) + 0.5 * np.nan_to_num(x[:, 1], nan=-1) + r.normal(scale=0.5, size=150) > 0).astype(float)
    at = np.round(r.normal(size=(40, 3)), 1)
    at[0] = np.nan
    got = boosting.fit(x, y, boosting.Settings(iterations=4, bins=200)).probability(at)
    np.testing.assert_allclose(got, plain_boosting(x, y, at, 4), rtol=1e-9)
    m = boosting.fit(x, y, boosting.Settings(bins=16))
    assert ((m.probability(x) > 0.5) == y).mean() > 0.85


def test_walk_forward_sees_no_later_label(rows):
    """Each symbol's models know its bars up to the cutoff less the horizon: later bars and other symbols change nothing."""
    from tapewright.operators import learn

    of = lambda d: {(r.symbol, r.idx): r.prob_up for r in learn.walk_forward(d, min_train=120, refit=50, iterations=5).collect()}
    whole = of(rows)
    assert {s for s, _ in whole} == {"A", "B"} and min(i for _, i in whole) == 120 and max(i for _, i in whole) == 299
    assert whole.items() >= {k: v for k, v in of(rows.where("symbol = 'A'")).items()}.items()
    changed = rows.withColumn("close", F.when(F.col("idx") > 225, F.col("close") * 2).otherwise(F.col("close")))
    later = of(changed)
    assert all(later[k] == v for k, v in whole.items() if k[1] <= 219) and any(later[k] != v for k, v in whole.items() if k[1] > 230)
    assert of(rows.where("idx < 149")) == {}


def test_stream_distinct(spark, tmp_path):
    from tapewright.streaming.bars import stream_distinct

    t = datetime(2024, 1, 1)
    spark.createDataFrame([(1, t, 1.0), (1, t, 1.0), (2, t, 2.0), (2, t + timedelta(hours=1), 2.0)], "event_id long, ts timestamp, value double").write.parquet(str(tmp_path / "e"))
    s = stream_distinct(spark.readStream.schema("event_id long, ts timestamp, value double").parquet(str(tmp_path / "e")), ["event_id"])
    q = s.writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert sorted(r.event_id for r in spark.table("once").collect()) == [1, 2]


def test_universe_and_epoch(spark):
    u = spark.createDataFrame([("X1", "iran"), ("X1", "zz"), ("A/B", "forex")], "symbol string, class string")
    got = src.classify(spark.createDataFrame([("X1",), ("A/B",), ("C/D",), ("E=X",), ("Q",), (None,)], "symbol string"), u)
    assert {r.symbol: r.asset_class for r in got.collect()} == {"X1": "iran", "A/B": "forex", "C/D": "crypto", "E=X": "forex", "Q": "stock", None: "stock"}
    e = src.epoch_bars(spark.createDataFrame([(1_704_067_200_000,)], "ts long")).first()
    assert e.ts == datetime(2024, 1, 1)


def test_log_of_closed_signals(spark):
    t = datetime(2024, 1, 1)
    row = lambda n, status, closed, r: (n, t, "A", "stock", "s", "LONG", 1.0, 0.5, 2.0, status, closed, r)
    schema = "signal_id long, created_at timestamp, symbol string, asset_class string, strategy string, side string, entry double, stop double, target double, status string, closed_at timestamp, result_r double"
    done = spark.createDataFrame([row(1, "tp", t + timedelta(1), 2.0), row(2, "open", None, None)], schema)
    opened = done.select(*journal.SIGNAL, F.col("created_at").alias("at"), F.lit("open").alias("status"), F.lit(None).cast("timestamp").alias("closed_at"), F.lit(None).cast("double").alias("result_r"))
    log = opened.unionByName(journal.closing_events(done))
    assert {r.signal_id: (r.status, r.result_r) for r in journal.latest(log).collect()} == {1: ("tp", 2.0), 2: ("open", None)}
    assert journal.cleared(log, F.lit(t + timedelta(1))).count() == 0


def test_sliding_windows(spark, tmp_path):
    from tapewright.streaming.bars import run_available, stream_bars

    t = datetime(2024, 1, 1)
    spark.createDataFrame([(i, t + timedelta(minutes=20 * i), "a", float(i)) for i in range(6)], "event_id long, ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema("event_id long, ts timestamp, event_type string, value double").parquet(str(tmp_path / "e"))
    got = {r.ts: (r.open, r.high, r.close, r.volume) for r in run_available(stream_bars(s, "1 hour", "1 day", "30 minutes"), ["symbol", "ts"]).collect()}
    assert got[t] == (0.0, 2.0, 2.0, 3.0) and got[t + timedelta(minutes=30)] == (2.0, 4.0, 4.0, 3.0) and len(got) == 5
