"""DuckDB SQL for the registered queries, put together from common table expressions."""

from __future__ import annotations

import itertools

from tapewright.operators.optimize import GRIDS
from tapewright.operators.pairs import CRITICAL

BARS = """bars AS (SELECT o_orderpriority AS symbol, o_orderdate AS ts, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
  min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*)::DOUBLE AS volume FROM orders GROUP BY 1, 2)"""

BRAND = """bars AS (SELECT p_brand AS symbol, date_trunc('week', l_shipdate)::TIMESTAMP AS ts,
  arg_min(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)) AS open,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  arg_max(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)) AS close,
  sum(l_quantity) AS volume FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""

EVENTS = """bars AS (SELECT event_type AS symbol, date_trunc('hour', ts)::TIMESTAMP AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
  min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, date_trunc('hour', ts))"""

WALK = f"""{BARS.replace("bars AS", "day_bars AS", 1)}, walk AS (SELECT symbol, ts, volume, (high - low) / 1e8 AS spread, 100.0::DOUBLE * exp(sum((close - open) / 1e7) OVER w) AS close,
  100.0::DOUBLE * exp(coalesce(sum((close - open) / 1e7) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS open
  FROM day_bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
bars AS (SELECT symbol, ts, open, greatest(open, close) * (1 + spread) AS high, least(open, close) * (1 - spread) AS low, close, volume FROM walk)"""

_PRIOR = "PARTITION BY symbol ORDER BY ts ROWS BETWEEN {} PRECEDING AND 1 PRECEDING"
_LAST = "PARTITION BY symbol ORDER BY ts ROWS BETWEEN {} PRECEDING AND CURRENT ROW"
_MID = "PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING"

WINDOWS = f"""p AS (SELECT *, row_number() OVER w - 1 AS idx, lag(open) OVER w AS prev_open, lag(high) OVER w AS prev_high, lag(low) OVER w AS prev_low,
    lag(close) OVER w AS prev_close, lag(high, 2) OVER w AS high_2, lag(low, 2) OVER w AS low_2 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
q AS (SELECT *,
    CASE WHEN idx >= 19 THEN avg(close) OVER ({_LAST.format(19)}) END AS sma_20, CASE WHEN idx >= 49 THEN avg(close) OVER ({_LAST.format(49)}) END AS sma_50,
    CASE WHEN idx >= 199 THEN avg(close) OVER ({_LAST.format(199)}) END AS sma_200, CASE WHEN idx >= 19 THEN stddev_pop(close) OVER ({_LAST.format(19)}) END AS std_20,
    CASE WHEN idx >= 20 THEN max(high) OVER ({_PRIOR.format(20)}) END AS donchian_up, CASE WHEN idx >= 20 THEN min(low) OVER ({_PRIOR.format(20)}) END AS donchian_low,
    CASE WHEN idx >= 4 THEN greatest(max(high) OVER ({_PRIOR.format(4)}) - min(close) OVER ({_PRIOR.format(4)}), max(close) OVER ({_PRIOR.format(4)}) - min(low) OVER ({_PRIOR.format(4)})) END AS thrust,
    CASE WHEN count(*) OVER ({_MID}) = 7 AND low = min(low) OVER ({_MID}) THEN low END AS piv_low,
    CASE WHEN count(*) OVER ({_MID}) = 7 AND high = max(high) OVER ({_MID}) THEN high END AS piv_high,
    greatest(high - low, abs(high - prev_close), abs(low - prev_close)) AS tr, close - prev_close AS change,
    CASE WHEN prev_close > 0 AND close > 0 THEN ln(close / prev_close) END AS log_return,
    CASE WHEN low > high_2 THEN high_2 END AS fvg_sup, CASE WHEN high < low_2 THEN low_2 END AS fvg_res,
    CASE WHEN close > prev_high AND prev_close < prev_open THEN prev_low END AS ob_sup, CASE WHEN close < prev_low AND prev_close > prev_open THEN prev_high END AS ob_res,
    CASE WHEN high - prev_high > prev_low - low AND high - prev_high > 0 THEN high - prev_high ELSE 0.0 END AS plus_dm,
    CASE WHEN prev_low - low > high - prev_high AND prev_low - low > 0 THEN prev_low - low ELSE 0.0 END AS minus_dm FROM p),
w AS MATERIALIZED (SELECT *, sma_20 + 2 * std_20 AS bb_up, sma_20 - 2 * std_20 AS bb_low, (close - sma_20) / nullif(std_20, 0) AS zscore,
    CASE WHEN count(log_return) OVER ({_LAST.format(19)}) = 20 THEN stddev_pop(log_return) OVER ({_LAST.format(19)}) * sqrt(252.0) END AS realized_vol,
    CASE WHEN count(change) OVER ({_LAST.format(13)}) = 14 THEN avg(change) OVER ({_LAST.format(13)}) ELSE 0.0 END AS drift FROM q)"""

RECURSIVE = """e AS (
  SELECT symbol, idx, tr AS a14, tr AS a10, NULL::DOUBLE AS g14, NULL::DOUBLE AS l14, NULL::DOUBLE AS g2, NULL::DOUBLE AS l2, close AS e12, close AS e26, close AS e20,
    plus_dm AS pd, minus_dm AS md, NULL::DOUBLE AS sig, NULL::DOUBLE AS adx FROM w WHERE idx = 0
  UNION ALL
  SELECT symbol, idx, a14, a10, g14, l14, g2, l2, e12, e26, e20, pd, md,
    CASE WHEN idx = 25 THEN e12 - e26 WHEN idx > 25 THEN 0.2 * (e12 - e26) + 0.8 * sig END,
    CASE WHEN idx = 13 THEN dx WHEN idx > 13 THEN coalesce(dx / 14 + adx * 13 / 14, adx) END
  FROM (SELECT *, CASE WHEN pd + md > 0 AND a14 > 0 THEN 100 * abs(pd - md) / (pd + md) END AS dx FROM (
    SELECT w.symbol, w.idx, w.tr / 14 + e.a14 * 13 / 14 AS a14, w.tr / 10 + e.a10 * 9 / 10 AS a10,
      CASE WHEN w.idx = 1 THEN greatest(w.change, 0) ELSE greatest(w.change, 0) / 14 + e.g14 * 13 / 14 END AS g14,
      CASE WHEN w.idx = 1 THEN greatest(-w.change, 0) ELSE greatest(-w.change, 0) / 14 + e.l14 * 13 / 14 END AS l14,
      CASE WHEN w.idx = 1 THEN greatest(w.change, 0) ELSE greatest(w.change, 0) / 2 + e.g2 / 2 END AS g2,
      CASE WHEN w.idx = 1 THEN greatest(-w.change, 0) ELSE greatest(-w.change, 0) / 2 + e.l2 / 2 END AS l2,
      w.close * 2 / 13 + e.e12 * 11 / 13 AS e12, w.close * 2 / 27 + e.e26 * 25 / 27 AS e26, w.close * 2 / 21 + e.e20 * 19 / 21 AS e20,
      w.plus_dm / 14 + e.pd * 13 / 14 AS pd, w.minus_dm / 14 + e.md * 13 / 14 AS md, e.sig, e.adx
    FROM e JOIN w ON w.symbol = e.symbol AND w.idx = e.idx + 1))),
x AS MATERIALIZED (SELECT w.*, CASE WHEN idx >= 13 THEN a14 END AS atr, CASE WHEN idx >= 19 THEN e20 END AS ema_20,
    CASE WHEN idx >= 19 THEN e20 + 1.5 * a10 END AS kc_up, CASE WHEN idx >= 19 THEN e20 - 1.5 * a10 END AS kc_low,
    CASE WHEN idx >= 14 THEN CASE WHEN l14 = 0 THEN 100.0 WHEN g14 = 0 THEN 0.0 ELSE 100 - 100 / (1 + g14 / l14) END END AS rsi,
    CASE WHEN idx >= 2 THEN CASE WHEN l2 = 0 THEN 100.0 WHEN g2 = 0 THEN 0.0 ELSE 100 - 100 / (1 + g2 / l2) END END AS rsi_2,
    CASE WHEN idx >= 25 THEN e12 - e26 END AS macd, CASE WHEN idx >= 33 THEN sig END AS macd_signal, CASE WHEN idx >= 33 THEN e12 - e26 - sig END AS macd_hist,
    CASE WHEN idx >= 26 THEN adx END AS adx FROM w JOIN e USING (symbol, idx))"""

_LEVELS = "PARTITION BY symbol ORDER BY ts ROWS BETWEEN 120 PRECEDING AND 3 PRECEDING"
STRUCTURE = f"""y AS MATERIALIZED (SELECT *, lag(macd_hist) OVER (PARTITION BY symbol ORDER BY ts) AS before, coalesce(lag(sq) OVER (PARTITION BY symbol ORDER BY ts), false) AS was
  FROM (SELECT *, coalesce(bb_up < kc_up AND bb_low > kc_low, false) AS sq,
    CASE WHEN idx - 3 > greatest(0, idx - 120) THEN list_filter(flatten(list([piv_low, fvg_sup, ob_sup]) OVER ({_LEVELS})), lambda v: v IS NOT NULL) END AS sup,
    CASE WHEN idx - 3 > greatest(0, idx - 120) THEN list_filter(flatten(list([piv_high, fvg_res, ob_res]) OVER ({_LEVELS})), lambda v: v IS NOT NULL) END AS res FROM x))"""

IND = f"WITH RECURSIVE {BARS}, {WINDOWS}, {RECURSIVE}"

#: name: (long, short, stop, reward)
TRIGGERS = {
    "trend_breakout": ("high > donchian_up AND close > sma_200", "low < donchian_low AND close < sma_200", 2.5, 2.0),
    "mean_reversion": (
        "close < bb_low AND zscore <= -2 AND rsi_2 < 10 AND close > sma_200", "close > bb_up AND zscore >= 2 AND rsi_2 > 90 AND close < sma_200", 3.0, None),
    "macd_trend": ("macd_hist > 0 AND before <= 0 AND close > sma_200", "macd_hist < 0 AND before >= 0 AND close < sma_200", 2.5, 2.0),
    "dual_thrust": ("high > open + 0.5 * thrust AND close > sma_200", "low < open - 0.5 * thrust AND close < sma_200", 2.0, 2.0),
    "squeeze_breakout": ("was AND NOT sq AND close > sma_20 AND close > sma_200", "was AND NOT sq AND close < sma_20 AND close < sma_200", 1.5, 3.0),
}


def refined(stop: float, reward: float) -> str:
    """Stop and target of the rows of t, refined by levels, as t5."""
    return f"""t1 AS (SELECT *, CASE WHEN side = 'LONG' THEN list_max(list_filter(sup, lambda v: v < entry)) ELSE list_min(list_filter(res, lambda v: v > entry)) END AS l1 FROM t),
t2 AS (SELECT *, l1 - sgn * 0.25 * atr AS s1 FROM t1),
t3 AS (SELECT *, if(ok1, s1, entry - sgn * {stop} * atr) AS stop, if(ok1, l1, NULL) AS stop_level FROM (SELECT *, coalesce(sgn * (entry - s1) BETWEEN 0.8 * atr AND 4.0 * atr, false) AS ok1 FROM t2)),
t4 AS (SELECT *, CASE WHEN side = 'LONG' THEN list_min(list_filter(res, lambda v: v > entry AND v < goal)) ELSE list_max(list_filter(sup, lambda v: v > goal AND v < entry)) END AS l2
       FROM (SELECT *, entry + sgn * {reward} * abs(entry - stop) AS goal FROM t3)),
t5 AS (SELECT * EXCLUDE (ok1), if(ok2, g2, goal) AS target, if(ok2, l2, NULL) AS target_level FROM (
       SELECT *, coalesce(sgn * (g2 - entry) > 0 AND sgn * (g2 - entry) / nullif(abs(entry - stop), 0) >= 0.8, false) AS ok2 FROM (SELECT *, l2 - sgn * 0.25 * atr AS g2 FROM t4)))"""


def indicators(bars: str) -> str:
    return f"WITH RECURSIVE {bars}, {WINDOWS}, {RECURSIVE}"


def source(name: str) -> str:
    return WALK if name == "mean_reversion" else BARS


#: A scan's bars: the last 1250 of symbols that have 60.
SCANNED = f"""{BARS.replace("bars AS", "all_bars AS", 1)}, bars AS (SELECT * EXCLUDE (n_) FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n_ FROM all_bars) WHERE n_ >= 60
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 1250)"""


def plans(name: str, bars: str | None = None) -> str:
    up, down, stop, reward = TRIGGERS[name]
    head = f"{indicators(bars or source(name))}, {STRUCTURE}, t AS (SELECT *, close AS entry, if(side = 'LONG', 1.0, -1.0) AS sgn FROM (SELECT *, CASE WHEN {up} THEN 'LONG' WHEN {down} THEN 'SHORT' END AS side FROM y) WHERE side IS NOT NULL AND atr > 0 AND sma_200 IS NOT NULL)"
    if reward is None:
        body = f"t5 AS (SELECT *, entry - sgn * {stop} * atr AS stop, sma_20 AS target, NULL::DOUBLE AS stop_level, NULL::DOUBLE AS target_level FROM t)"
    else:
        body = refined(stop, reward)
    return f"""{head}, {body},
plans AS MATERIALIZED (SELECT '{name}' AS strategy, symbol, ts, idx::INT AS idx, side, sgn, entry, stop, target, atr, stop_level, target_level FROM t5
  WHERE CASE WHEN side = 'LONG' THEN stop < entry AND entry < target ELSE target < entry AND entry < stop END)"""


def plan_rows(name: str) -> str:
    return f"""{plans(name)} SELECT strategy, symbol, ts, idx, side, round(entry, 4) AS entry, round(stop, 4) AS stop, round(target, 4) AS target, round(atr, 4) AS atr,
  round(stop_level, 4) AS stop_level, round(target_level, 4) AS target_level FROM plans"""


FOLLOW = """f AS (SELECT p.*, b.idx::INT AS j, b.high AS bh, b.low AS bl, b.close AS bc FROM plans p JOIN x b ON b.symbol = p.symbol AND b.idx BETWEEN p.idx AND p.idx + 60)"""
FIXED = f"""{FOLLOW}, h AS (SELECT *, if(side = 'LONG', bl <= stop, bh >= stop) AS hs, if(side = 'LONG', bh >= target, bl <= target) AS ht FROM f),
trades AS MATERIALIZED (SELECT strategy, symbol, ts, idx, side, entry, stop, target, atr, sgn, coalesce(min(j) FILTER (j > idx AND (hs OR ht)), max(j)) AS exit_idx,
  coalesce(arg_min(if(hs, stop, target), j) FILTER (j > idx AND (hs OR ht)), arg_max(bc, j)) AS exit,
  coalesce(arg_min(if(hs, 'stop', 'target'), j) FILTER (j > idx AND (hs OR ht)), 'time') AS outcome FROM h GROUP BY ALL)"""
TRAILING = f"""{FOLLOW}, h AS (SELECT *, if(side = 'LONG', greatest(stop, max(bh) OVER v - 3.0 * atr), least(stop, min(bl) OVER v + 3.0 * atr)) AS ts_ FROM f
  WINDOW v AS (PARTITION BY symbol, idx ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
trades AS MATERIALIZED (SELECT strategy, symbol, ts, idx, side, entry, stop, target, atr, sgn, coalesce(min(j) FILTER (j > idx AND hit), max(j)) AS exit_idx,
  coalesce(arg_min(ts_, j) FILTER (j > idx AND hit), arg_max(bc, j)) AS exit, coalesce(arg_min('trail', j) FILTER (j > idx AND hit), 'time') AS outcome
  FROM (SELECT *, if(side = 'LONG', bl <= ts_, bh >= ts_) AS hit FROM h) GROUP BY ALL)"""
GREEDY = """n AS MATERIALIZED (SELECT t.symbol, t.idx, min(u.idx) AS nxt FROM trades t LEFT JOIN trades u ON u.symbol = t.symbol AND u.idx > t.exit_idx GROUP BY 1, 2),
g AS (SELECT symbol, min(idx) AS idx FROM trades GROUP BY 1 UNION ALL SELECT n.symbol, n.nxt FROM g JOIN n ON g.symbol = n.symbol AND g.idx = n.idx WHERE n.nxt IS NOT NULL),
done AS MATERIALIZED (SELECT t.*, sgn * (exit - entry) / abs(entry - stop) AS r FROM trades t JOIN g USING (symbol, idx))"""


def trade_rows(name: str, exits: str) -> str:
    return f"""{plans(name)}, {exits}, {GREEDY} SELECT strategy, symbol, idx, side, exit_idx, round(exit, 4) AS exit, outcome, round(r, 4) AS r FROM done"""


def stat_columns(order: str = "idx", key: str = "strategy, symbol") -> str:
    return f"""SELECT {key}, count(*) AS trades, round(avg(if(r > 0, 1.0, 0.0)), 2 + 2) AS win_rate,
  round(CASE WHEN -sum(if(r <= 0, r, 0)) > 0 THEN sum(if(r > 0, r, 0)) / -sum(if(r <= 0, r, 0)) WHEN sum(if(r > 0, r, 0)) > 0 THEN 999.0 ELSE 0.0 END, 2 + 2) AS profit_factor,
  round(avg(r), 2 + 2) AS expectancy, round(coalesce(avg(r) / nullif(stddev_pop(r), 0), 0) * sqrt(count(*)), 2 + 2) AS sharpe, round(max(peak - eq), 2 + 2) AS max_drawdown, round(sum(r), 2 + 2) AS total_r
FROM (SELECT *, max(eq) OVER (PARTITION BY {key} ORDER BY {order}) AS peak FROM (SELECT *, sum(r) OVER (PARTITION BY {key} ORDER BY {order}) AS eq FROM done)) GROUP BY {key}"""


def stat_rows(name: str, exits: str) -> str:
    return f"{plans(name)}, {exits}, {GREEDY} {stat_columns()}"


def late_rows(name: str, exits: str) -> str:
    cut = "done AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n_, row_number() OVER (PARTITION BY symbol ORDER BY idx) AS k_ FROM all_done) WHERE n_ >= 4 AND k_ > floor(n_ * 0.7::DOUBLE))"
    return f"{plans(name)}, {exits}, {GREEDY.replace('done AS', 'all_done AS')}, {cut} {stat_columns()}"


RESOLVE = f"""{plans("trend_breakout")},
s AS (SELECT row_number() OVER (ORDER BY symbol, idx) AS signal_id, * FROM plans),
r AS (SELECT s.*, b.ts AS bts, b.close AS bc, if(side = 'LONG', b.low <= stop, b.high >= stop) AS hs, if(side = 'LONG', b.high >= target, b.low <= target) AS ht
  FROM s JOIN x b ON b.symbol = s.symbol AND b.ts > s.ts),
c AS (SELECT signal_id, min(bts) FILTER (hs OR ht) AS hit_at, arg_min(if(hs, 'sl', 'tp'), bts) FILTER (hs OR ht) AS how, max(bts) AS last_at, arg_max(bc, bts) AS last_close FROM r GROUP BY 1),
state AS (SELECT s.signal_id, s.symbol, s.strategy, s.side, s.ts AS created_at,
  CASE WHEN how IS NOT NULL THEN how WHEN last_at IS NOT NULL AND floor((epoch((SELECT max(ts) FROM bars)) - epoch(s.ts)) / 86400) >= 30 THEN 'expired' ELSE 'open' END AS status,
  CASE WHEN how = 'sl' THEN -1.0 WHEN how = 'tp' THEN abs(target - entry) / abs(entry - stop)
       WHEN last_at IS NOT NULL AND floor((epoch((SELECT max(ts) FROM bars)) - epoch(s.ts)) / 86400) >= 30 THEN round(sgn * (last_close - entry) / abs(entry - stop), 2 + 2) END AS result_r
  FROM s LEFT JOIN c USING (signal_id))"""

LABELS = f"""{IND}, f AS (SELECT a.symbol, a.idx::INT AS idx, a.close, b.idx AS j, b.close AS bc, b.high >= a.close + 1.5 * a.atr AS up, b.low <= a.close - 1.5 * a.atr AS down
  FROM x a JOIN x b ON a.symbol = b.symbol AND b.idx BETWEEN a.idx + 1 AND a.idx + 10 WHERE a.atr > 0)
SELECT symbol, idx, coalesce(arg_min(if(up, 1, 0), j) FILTER (up OR down), if(arg_max(bc, j) > any_value(close), 1, 0))::INT AS label FROM f GROUP BY 1, 2"""

FACTOR = f"""WITH {BRAND}, k AS (SELECT ts FROM bars GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT symbol) FROM bars)),
p AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS t FROM bars WHERE ts IN (SELECT ts FROM k)),
s AS (SELECT *, lag(close, 21) OVER w / lag(close, 147) OVER w - 1 AS score, lead(close, 21) OVER w / close - 1 AS fwd FROM p WINDOW w AS (PARTITION BY symbol ORDER BY t)),
u AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, symbol) AS hi, row_number() OVER (PARTITION BY t ORDER BY score, symbol DESC) AS lo
  FROM s WHERE t >= 147 AND (t - 147) % 21 = 0 AND fwd IS NOT NULL AND score IS NOT NULL)
SELECT 'momentum' AS basket, t::INT AS t, round(avg(fwd) FILTER (hi <= 2) - avg(fwd) FILTER (lo <= 2), 4) AS r FROM u GROUP BY t"""

PAIRS = f"""WITH {BRAND}, a AS (SELECT x.symbol || '/' || y.symbol AS pair, x.ts, x.close AS a, y.close AS b FROM bars x JOIN bars y ON x.ts = y.ts
  WHERE (x.symbol, y.symbol) IN (('Brand#11', 'Brand#12'), ('Brand#21', 'Brand#22'), ('Brand#31', 'Brand#32'), ('Brand#41', 'Brand#42'), ('Brand#51', 'Brand#52'))),
m AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY ts) - 1 AS idx, count(*) OVER w AS n, avg(a) OVER w AS ma, avg(b) OVER w AS mb, var_pop(a) OVER w AS va, var_pop(b) OVER w AS vb,
  covar_pop(a, b) OVER w AS ab FROM a WINDOW w AS (PARTITION BY pair ORDER BY ts ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING))
SELECT pair, ts, idx::INT AS idx, round(ab / vb, 4) AS beta, round((a - ab / vb * b - (ma - ab / vb * mb)) / sqrt(va - ab / vb * ab), 4) AS z FROM m WHERE n = 252"""

_ORDERED = "CASE WHEN side = 'LONG' THEN stop < entry AND entry < target ELSE target < entry AND entry < stop END"

FACTOR_LIVE = f"""WITH RECURSIVE {BRAND}, {WINDOWS}, {RECURSIVE}, {STRUCTURE},
s AS (SELECT *, lag(close, 21) OVER v AS past, lag(close, 147) OVER v AS far FROM y WINDOW v AS (PARTITION BY symbol ORDER BY ts)),
l AS (SELECT *, past / far - 1 AS score FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1) WHERE idx >= 148 AND far > 0),
k AS (SELECT *, row_number() OVER (ORDER BY score DESC, symbol) AS hi, row_number() OVER (ORDER BY score, symbol DESC) AS lo, count(*) OVER () AS scored FROM l),
t AS (SELECT *, close AS entry, if(side = 'LONG', 1.0, -1.0) AS sgn FROM (SELECT *, 'LONG' AS side, hi AS place FROM k WHERE hi <= 2 UNION ALL SELECT *, 'SHORT', lo FROM k WHERE lo <= 2) WHERE atr > 0 AND scored >= 4),
{refined(3.0, 2.0)}
SELECT symbol, ts, side, round(score, 4) AS score, place::INT AS rank, round(entry, 4) AS entry, round(stop, 4) AS stop, round(target, 4) AS target, round(atr, 4) AS atr FROM t5 WHERE {_ORDERED}"""

PAIR_STATS = f"""{PAIRS.split("SELECT pair, ts, idx::INT")[0].replace("WITH ", "WITH RECURSIVE ", 1)},
zs AS (SELECT pair, idx, row_number() OVER (PARTITION BY pair ORDER BY ts) AS k, (a - ab / vb * b - (ma - ab / vb * mb)) / sqrt(va - ab / vb * ab) AS z, count(*) OVER (PARTITION BY pair) AS later FROM m WHERE n = 252),
q AS (SELECT pair, 0::BIGINT AS k, 0 AS pos, 0.0::DOUBLE AS since, 0::BIGINT AS idx, NULL::DOUBLE AS r FROM zs WHERE k = 1 AND later >= 30
  UNION ALL
  SELECT q.pair, zs.k, CASE WHEN pos = 0 THEN CASE WHEN z <= -2 THEN 1 WHEN z >= 2 THEN -1 ELSE 0 END WHEN pos * z >= -0.5 OR pos * z <= -3.5 THEN 0 ELSE pos END,
    if(pos = 0, z, since), zs.idx, CASE WHEN pos = 0 THEN NULL WHEN pos * z >= -0.5 THEN pos * (z - since) / 1.5 WHEN pos * z <= -3.5 THEN -1.0 END
  FROM q JOIN zs ON zs.pair = q.pair AND zs.k = q.k + 1),
done AS (SELECT pair, idx, r FROM q WHERE r IS NOT NULL) {stat_columns("idx", "pair")}"""

REVIEW = f"""{RESOLVE},
o AS (SELECT st.signal_id, st.created_at, s.symbol, s.side, s.sgn, s.entry, s.stop, s.target FROM state st JOIN s USING (signal_id)
  WHERE st.status = 'open' OR st.created_at >= (SELECT max(ts) FROM bars) - INTERVAL 90 DAYS),
end_ AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1),
h AS (SELECT o.signal_id, max(b.high) AS top, min(b.low) AS bottom FROM o JOIN bars b ON b.symbol = o.symbol AND b.ts > o.created_at GROUP BY 1),
p1 AS (SELECT o.*, end_.close AS now, end_.atr, end_.sma_200, end_.macd_hist, coalesce(top, end_.high) AS top, coalesce(bottom, end_.low) AS bottom, abs(entry - stop) AS risk,
  CASE WHEN side = 'LONG' THEN list_min(list_filter(res, lambda v: v > end_.close)) ELSE list_max(list_filter(sup, lambda v: v < end_.close)) END AS lv
  FROM o JOIN end_ ON end_.symbol = o.symbol LEFT JOIN h ON h.signal_id = o.signal_id),
p2 AS (SELECT *, risk > 0 AND coalesce(atr > 0, false) AS ok, sgn * (now - entry) / risk AS gain, if(side = 'LONG', top, bottom) - sgn * 3.0 * atr AS tr FROM p1),
p3 AS (SELECT *, ok AND gain >= 1 AS locked, if(ok AND gain >= 1, if(side = 'LONG', greatest(stop, entry), least(stop, entry)), stop) AS sl, ok AND sgn * (now - target) >= 0 AS past FROM p2),
p4 AS (SELECT *, coalesce(locked AND sgn * (tr - sl) > 0 AND sgn * (now - tr) > 0, false) AS trailed, ok AND (past OR abs(target - now) <= 0.5 * atr) AS near,
  ok AND coalesce(sgn * (now - sma_200) < 0 OR sgn * macd_hist < 0, false) AS danger, lv - sgn * 0.25 * atr AS before_lv FROM p3),
p5 AS (SELECT *, CASE WHEN NOT ok THEN '' WHEN past THEN 'target reached' WHEN danger THEN 'thesis weakening' WHEN near THEN 'in the target zone'
  WHEN sgn * (lv - now) > 0 AND sgn * (target - lv) > 0 AND sgn * (before_lv - now) > 0 THEN 'level ahead' ELSE 'let it run' END AS tp_reason FROM p4)
SELECT signal_id, symbol, side, round(round(if(ok, gain, 0.0), 2), 4) AS r_now, round(if(trailed, tr, sl), 4) AS recommended_sl,
  round(CASE WHEN tp_reason IN ('target reached', 'thesis weakening') THEN now WHEN tp_reason = 'level ahead' THEN before_lv ELSE target END, 4) AS recommended_tp, tp_reason,
  locked AND sl = entry AS at_breakeven, trailed, near AS near_target, danger, (locked AND sl = entry) OR trailed OR near OR danger AS actionable FROM p5"""


#: Triggers over the grid's columns n, z, k1.
GRID_TRIGGERS = {
    "trend_breakout": ("high > CASE n WHEN 10 THEN up_10 WHEN 20 THEN up_20 ELSE up_40 END AND close > sma_200", "low < CASE n WHEN 10 THEN low_10 WHEN 20 THEN low_20 ELSE low_40 END AND close < sma_200"),
    "mean_reversion": ("close < bb_low AND zscore <= -gr.z AND rsi_2 < 10 AND close > sma_200", "close > bb_up AND zscore >= gr.z AND rsi_2 > 90 AND close < sma_200"),
    "dual_thrust": ("high > open + k1 * CASE n WHEN 3 THEN th_3 WHEN 4 THEN th_4 ELSE th_5 END AND close > sma_200", "low < open - k1 * CASE n WHEN 3 THEN th_3 WHEN 4 THEN th_4 ELSE th_5 END AND close < sma_200"),
}


def grid_rows(name: str) -> str:
    """Symbols and combinations are one key, so that exits and selection are those of single strategies."""
    grid = GRIDS[name]
    up, down = GRID_TRIGGERS.get(name, TRIGGERS[name][:2])
    values = []
    for combo in itertools.product(*grid.values()):
        c = dict(zip(grid, combo))
        text = ",".join(f"{k}={v}" for k, v in c.items())
        values.append(f"('{text}', {c.get('donchian', c.get('bars', 0))}, {c.get('z', 0.0)}::DOUBLE, {c.get('k1', 0.0)}::DOUBLE, {c['stop']}::DOUBLE, {c.get('reward', TRIGGERS[name][3] or 0)}::DOUBLE)")
    over = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {} PRECEDING AND 1 PRECEDING)"
    new = [f"CASE WHEN idx >= {n} THEN max(high) {over.format(n)} END AS up_{n}, CASE WHEN idx >= {n} THEN min(low) {over.format(n)} END AS low_{n}" for n in grid.get("donchian", ())]
    new += [f"CASE WHEN idx >= {n} THEN greatest(max(high) {over.format(n)} - min(close) {over.format(n)}, max(close) {over.format(n)} - min(low) {over.format(n)}) END AS th_{n}" for n in grid.get("bars", ())]
    target = "sma_20" if name == "mean_reversion" else "entry + sgn * reward_ * abs(entry - (entry - sgn * stop_ * atr))"
    late = "late AS (SELECT * EXCLUDE (n_, k_) FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n_, row_number() OVER (PARTITION BY symbol ORDER BY idx) AS k_ FROM done) WHERE n_ >= 4 AND k_ > floor(n_ * 0.7::DOUBLE))"
    return f"""{indicators(source(name))}, {STRUCTURE}, gr(params, n, z, k1, stop_, reward_) AS (VALUES {", ".join(values)}),
c AS (SELECT {", ".join(["*", *new])} FROM y),
t AS (SELECT *, close AS entry, if(side = 'LONG', 1.0, -1.0) AS sgn FROM (SELECT c.symbol || '|' || params AS symbol, ts, idx, close, atr, sma_20, stop_, reward_, CASE WHEN {up} THEN 'LONG' WHEN {down} THEN 'SHORT' END AS side
  FROM c, gr WHERE atr > 0 AND sma_200 IS NOT NULL) WHERE side IS NOT NULL),
t5 AS (SELECT *, entry - sgn * stop_ * atr AS stop, {target} AS target FROM t),
plans AS MATERIALIZED (SELECT '{name}' AS strategy, symbol, ts, idx::INT AS idx, side, sgn, entry, stop, target, atr FROM t5 WHERE {_ORDERED}),
xx AS MATERIALIZED (SELECT x.symbol || '|' || params AS symbol, idx, high, low, close FROM x, gr),
{FIXED.replace("JOIN x b", "JOIN xx b")}, {GREEDY}, {late}, a AS ({stat_columns()}), z AS ({stat_columns().replace("FROM done", "FROM late")}),
r AS (SELECT split_part(symbol, '|', 1) AS symbol, split_part(symbol, '|', 2) AS params, a.trades, a.win_rate, a.expectancy, coalesce(z.trades, 0) AS oos_trades, coalesce(z.expectancy, 0.0) AS oos_expectancy,
  CASE WHEN a.trades >= 10 AND coalesce(z.trades, 0) >= 3 THEN z.expectancy ELSE '-infinity'::DOUBLE END AS score FROM a LEFT JOIN z USING (strategy, symbol))
SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, expectancy DESC, params)::INT AS place FROM r"""


def _p_value() -> str:
    steps = " ".join(f"WHEN t <= {b} THEN {p} + (t - ({a})) / ({b} - ({a})) * ({q} - {p})" for (a, p), (b, q) in zip(CRITICAL, CRITICAL[1:]))
    return f"CASE WHEN t <= {CRITICAL[0][0]} THEN {CRITICAL[0][1]} {steps} ELSE least(0.999, {CRITICAL[-1][1]} + (t - ({CRITICAL[-1][0]})) * 0.1) END"


#: The unit-root t by partialling out: level and change, each less what the change before explains.
PAIR_STATE = f"""{PAIRS.split(",%sm AS (SELECT" % chr(10))[0]},
l AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY pair ORDER BY ts DESC) <= 252),
h AS (SELECT pair, count(*) AS n, regr_slope(a, b) AS beta, regr_intercept(a, b) AS alpha FROM l GROUP BY pair),
s AS (SELECT pair, ts, beta, alpha, a - (beta * b + alpha) AS s FROM l JOIN h USING (pair) WHERE n = 252),
d AS (SELECT *, lag(s) OVER w AS x, s - lag(s) OVER w AS d, avg(s) OVER (PARTITION BY pair) AS mu, stddev_pop(s) OVER (PARTITION BY pair) AS sigma FROM s WINDOW w AS (PARTITION BY pair ORDER BY ts)),
e AS (SELECT *, (s - mu) / sigma AS z, (x - mu) / sigma AS zb, lag(d) OVER (PARTITION BY pair ORDER BY ts) AS e FROM d),
f AS (SELECT *, least(0.999, greatest(0, sum(z * zb) OVER (PARTITION BY pair) / sum(zb * zb) OVER (PARTITION BY pair))) AS phi,
  x - regr_slope(if(e IS NULL, NULL, x), e) OVER (PARTITION BY pair) * e AS rx, d - regr_slope(if(e IS NULL, NULL, d), e) OVER (PARTITION BY pair) * e AS rd FROM e),
k AS (SELECT pair, max(ts) AS ts, any_value(beta) AS beta, any_value(alpha) AS alpha, any_value(mu) AS mu, any_value(sigma) AS sigma, arg_max(z, ts) AS z, any_value(phi) AS phi, stddev_pop(z - phi * zb) AS sigma_eps,
  regr_slope(rd, rx) / sqrt((count(rx) * var_pop(rd) - regr_slope(rd, rx) ** 2 * count(rx) * var_pop(rx)) / (count(rx) - 3) / (count(rx) * var_pop(rx))) AS t FROM f GROUP BY pair)
SELECT pair, ts, round(beta, 4) AS beta, round(alpha, 4) AS alpha, round(mu, 4) AS mu, round(sigma, 4) AS sigma, round(z, 4) AS z, round(phi, 4) AS phi, round(sigma_eps, 4) AS sigma_eps, round(t, 4) AS t,
  round({_p_value()}, 4) AS p_value FROM k"""


#: The class that the scan's universe lists; shorts that can't be sold short have no size.
LISTED = "CASE symbol WHEN '1-URGENT' THEN 'iran' WHEN '2-HIGH' THEN 'crypto' WHEN '3-MEDIUM' THEN 'forex' ELSE 'stock' END"
BARRED = "(symbol = '1-URGENT' AND side = 'SHORT')"


def _latest(name: str) -> str:
    """The latest plan of each symbol with its strategy's statistics."""
    return f"""{plans(name, SCANNED)}, {FIXED if name == "mean_reversion" else TRAILING}, {GREEDY}, st AS ({stat_columns()}),
newest AS (SELECT * FROM plans QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY idx DESC) = 1)
SELECT strategy, symbol, side, entry, stop, target, win_rate, profit_factor, sharpe FROM newest JOIN st USING (strategy, symbol)"""


_SIZED = f"""WITH g AS ({" UNION ALL ".join(f"SELECT * FROM ({_latest(n)})" for n in TRIGGERS)}),
u AS (SELECT *, CASE WHEN win_rate > 0 AND win_rate < 1 THEN profit_factor * (1 - win_rate) / win_rate ELSE 0 END AS b FROM g),
v AS (SELECT *, least(CASE WHEN b > 0 THEN greatest(0, least(1, win_rate - (1 - win_rate) / b)) ELSE 0 END * 0.5, 0.05) AS kelly FROM u),
w AS (SELECT *, CASE WHEN kelly > 0 AND NOT {BARRED} THEN least(100 / abs(entry - stop), 10000 * kelly / entry) ELSE 0.0 END AS units FROM v)"""

PORTFOLIO = f"""{_SIZED},
c AS (SELECT {LISTED} AS asset_class, count(*) AS n, count(*) FILTER (side = 'LONG') AS longs,
  coalesce(sum(units * entry) FILTER (side = 'LONG'), 0) AS up, coalesce(sum(units * entry) FILTER (side = 'SHORT'), 0) AS down, sum(units * abs(entry - stop)) AS risk FROM w GROUP BY 1),
d AS (SELECT coalesce(sum(n), 0)::BIGINT AS n, coalesce(sum(longs), 0)::BIGINT AS longs, coalesce(sum(up + down), 0)::DOUBLE AS gross, coalesce(sum(up - down), 0)::DOUBLE AS net, coalesce(sum(risk), 0)::DOUBLE AS risk,
  '{{' || coalesce(string_agg('"' || asset_class || '":' || round(risk + 1e-7, 2), ',' ORDER BY asset_class), '') || '}}' AS risk_by_class,
  list_sort(coalesce(list(n || ' ' || asset_class || ' positions') FILTER (n > 5), [])) AS crowded FROM c)
SELECT n, longs, n - longs AS shorts, round(gross, 4) AS gross, round(net, 4) AS net, round(risk, 4) AS risk, risk_by_class, round(risk / 100, 4) AS risk_pct,
  array_to_string(list_filter(list_concat([CASE WHEN risk / 100 > 6 THEN printf('risk at stop is %.1f%% of equity', risk / 100) END], crowded,
    [CASE WHEN n >= 4 AND (longs = 0 OR longs = n) THEN 'all signals are on one side' END]), lambda t: t IS NOT NULL), '; ') AS warnings FROM d"""

SIZES = f"""{_SIZED} SELECT strategy, symbol, side, round(entry, 4) AS entry, round(stop, 4) AS stop, round(kelly, 4) AS kelly_used, round(units, 4) AS units, round(units * entry, 4) AS notional,
  round(units * abs(entry - stop), 4) AS risk_amount, round(round(0.4::DOUBLE * greatest(0, least(1, (win_rate - 0.35::DOUBLE) / 0.4::DOUBLE)) + 0.35::DOUBLE * greatest(0, least(1, profit_factor - 1)) + 0.25::DOUBLE * greatest(0, least(1, sharpe / 2)), 3), 4) AS quality FROM w"""

_TRIMMED = r"CASE WHEN abs({0}) >= 1000 THEN format('{{:,.2f}}', {0}) WHEN abs({0}) >= 1 THEN regexp_replace(printf('%.4f', {0}), '\.?0+$', '') ELSE regexp_replace(printf('%.6f', {0}), '\.?0+$', '') END"
LABEL_TEXT = f"""{IND} SELECT symbol, ts, {_TRIMMED.format("close")} AS close_text, CASE WHEN rsi IS NOT NULL THEN {_TRIMMED.format("rsi")} END AS rsi_text,
  repeat('#', round(rsi / 10)::INT) || repeat('-', 10 - round(rsi / 10)::INT) AS rsi_meter FROM x"""

CARDS = f"""{_SIZED} SELECT strategy, symbol, side || ' ' || symbol || ' (' || strategy || ')' || chr(10) || 'entry ' || {_TRIMMED.format("entry")} || ', stop ' || {_TRIMMED.format("stop")}
  || ', target ' || {_TRIMMED.format("target")} || chr(10) || CASE WHEN units > 0 THEN 'units ' || {_TRIMMED.format("units")} ELSE 'forecast only' END AS card FROM w"""

FRESH = f"""{RESOLVE}, n AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY symbol, side ORDER BY ts DESC) = 1)
SELECT signal_id, symbol, strategy, side, ts AS created_at, 'open' AS status FROM n ANTI JOIN (
  SELECT symbol, strategy, side FROM state WHERE status = 'open' AND created_at >= (SELECT max(ts) FROM bars) - INTERVAL 3 DAYS) USING (symbol, strategy, side)"""


def _measured(name: str) -> str:
    """The latest plan of each symbol with its strategy's statistics, its late ones, and the symbol's regime."""
    late = "late AS (SELECT * EXCLUDE (n_, k_) FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n_, row_number() OVER (PARTITION BY symbol ORDER BY idx) AS k_ FROM done) WHERE n_ >= 4 AND k_ > floor(n_ * 0.7::DOUBLE))"
    suits = "ranging" if name == "mean_reversion" else "trending"
    return f"""{plans(name, SCANNED)}, {FIXED if name == "mean_reversion" else TRAILING}, {GREEDY}, {late}, st AS ({stat_columns()}), lt AS ({stat_columns().replace("FROM done", "FROM late")}),
rg AS (SELECT symbol, max(idx) AS last_idx, CASE WHEN arg_max(adx, ts) >= 25 THEN 'trending' WHEN arg_max(adx, ts) < 20 THEN 'ranging' ELSE 'neutral' END AS regime FROM x GROUP BY symbol),
newest AS (SELECT * FROM plans QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY idx DESC) = 1)
SELECT p.strategy, p.symbol, p.ts, p.side, p.sgn, p.entry, p.stop, p.target, st.trades, st.win_rate, st.profit_factor, st.expectancy, st.sharpe, coalesce(lt.trades, 0) AS oos_trades,
  coalesce(lt.expectancy, 0.0) AS oos_expectancy, regime, p.idx = last_idx AND regime IN ('neutral', '{suits}') AS live
FROM newest p JOIN st USING (strategy, symbol) LEFT JOIN lt USING (strategy, symbol) JOIN rg USING (symbol)"""


MEASURED = f"""WITH g AS ({" UNION ALL ".join(f"SELECT * FROM ({_measured(n)})" for n in TRIGGERS)}),
u AS (SELECT *, CASE WHEN win_rate > 0 AND win_rate < 1 THEN profit_factor * (1 - win_rate) / win_rate ELSE 0 END AS b, count(*) OVER (PARTITION BY symbol, side, live) AS confluence FROM g),
v AS (SELECT *, least(CASE WHEN b > 0 THEN greatest(0, least(1, win_rate - (1 - win_rate) / b)) ELSE 0 END * 0.5, 0.05) AS kelly FROM u),
w AS (SELECT *, abs(entry - stop) AS gap, CASE WHEN kelly > 0 AND NOT {BARRED} THEN least(100 / abs(entry - stop), 10000 * kelly / entry) ELSE 0.0 END AS units FROM v)
SELECT strategy, symbol, {LISTED} AS asset_class, ts, side, round(entry, 4) AS entry, round(stop, 4) AS stop, round(target, 4) AS target, round(round(abs(target - entry) / gap, 3), 4) AS rr,
  round(units, 4) AS units, round(round(units * entry / 10000 * 100, 2), 4) AS equity_pct, round(round(units * gap / 10000 * 100, 2), 4) AS risk_pct, round(round(entry + sgn * gap, 6), 4) AS risk_free_at, regime,
  trades, round(win_rate, 4) AS win_rate, round(profit_factor, 4) AS profit_factor, round(expectancy, 4) AS expectancy, round(sharpe, 4) AS sharpe, oos_trades, round(oos_expectancy, 4) AS oos_expectancy, confluence, live,
  trades >= 15 AND win_rate >= 0.40 AND profit_factor >= 1.40 AND sharpe >= 0.5 AND (oos_trades < 4 OR oos_expectancy > 0) AS measured_edge FROM w"""


_ENDS = f"""{plans("trend_breakout")},
s AS MATERIALIZED (SELECT row_number() OVER (ORDER BY symbol, idx) AS signal_id, * FROM plans),
b AS (SELECT s.*, b.ts AS bts, b.close AS bc, if(side = 'LONG', b.low <= stop, b.high >= stop) AS hs, if(side = 'LONG', b.high >= target, b.low <= target) AS ht FROM s JOIN x b ON b.symbol = s.symbol AND b.ts > s.ts)"""

#: A signal is held back by an open one of its key that is three days old at most; signal by signal.
MOVES = f"""{_ENDS},
e0 AS (SELECT signal_id, min(bts) AS hit_, arg_min(CASE WHEN hs THEN 'sl' WHEN ht THEN 'tp' ELSE 'expired' END, bts) AS how, arg_min(bc, bts) AS price FROM b
  WHERE hs OR ht OR bts - ts >= INTERVAL 30 DAYS GROUP BY signal_id),
ev AS (SELECT signal_id, if(late, s.ts + INTERVAL 30 DAYS, hit_) AS ended, if(late, 'expired', how) AS how,
    if(late, (SELECT arg_max(z.close, z.ts) FROM x z WHERE z.symbol = s.symbol AND z.ts < hit_), price) AS price
  FROM (SELECT e0.*, hit_ - s.ts > INTERVAL 45 DAYS AS late FROM e0 JOIN s USING (signal_id)) JOIN s USING (signal_id)),
o AS (SELECT s.*, how, ended, price, row_number() OVER (PARTITION BY symbol, side ORDER BY ts) AS n FROM s LEFT JOIN ev USING (signal_id)),
h AS (SELECT symbol, side, n, signal_id, [{{'at': ts, 'ended': ended}}] AS open, false AS held FROM o WHERE n = 1
  UNION ALL
  SELECT symbol, side, n, signal_id, if(held, open, list_append(open, {{'at': ts, 'ended': ended}})), held FROM (
    SELECT o.symbol, o.side, o.n, o.signal_id, h.open, o.ts, o.ended, len(list_filter(h.open, lambda p: o.ts - p.at <= INTERVAL 3 DAYS AND coalesce(p.ended > o.ts, true))) > 0 AS held
    FROM h JOIN o ON o.symbol = h.symbol AND o.side = h.side AND o.n = h.n + 1))
SELECT signal_id, o.symbol, o.side, ts AS created_at, CASE WHEN held THEN 'held' ELSE coalesce(how, 'open') END AS status, CASE WHEN held THEN ts ELSE ended END AS closed_at,
  round(CASE WHEN held THEN NULL WHEN how = 'sl' THEN -1.0 WHEN how = 'tp' THEN abs(target - entry) / abs(entry - stop) WHEN how = 'expired' THEN round(sgn * (price - entry) / abs(entry - stop), 2 + 2) END, 4) AS result_r
FROM o JOIN h USING (signal_id)"""

#: Six slices of time, each resolving what is open at its end.
LOOP = f"""{_ENDS},
c AS (SELECT ts, least(5, floor((epoch_ms(ts) - (SELECT min(epoch_ms(ts)) FROM bars)) * 6 / (SELECT max(epoch_ms(ts)) - min(epoch_ms(ts)) FROM bars))) AS slice FROM (SELECT DISTINCT ts FROM bars)),
n AS (SELECT slice, max(ts) AS now FROM c GROUP BY slice),
f AS (SELECT signal_id, min(bts) FILTER (hs OR ht) AS hit_at, arg_min(if(hs, 'sl', 'tp'), bts) FILTER (hs OR ht) AS how FROM b GROUP BY signal_id),
m AS (SELECT s.signal_id, min(now) AS now FROM s JOIN c USING (ts) JOIN n ON n.slice > c.slice LEFT JOIN f USING (signal_id)
  WHERE hit_at <= now OR (floor(epoch(now - s.ts) / 86400) >= 30 AND EXISTS (SELECT 1 FROM bars z WHERE z.symbol = s.symbol AND z.ts > s.ts AND z.ts <= now)) GROUP BY s.signal_id),
l AS (SELECT signal_id, max(bts) AS last_at, arg_max(bc, bts) AS price FROM b JOIN m USING (signal_id) WHERE bts <= now GROUP BY signal_id)
SELECT symbol, strategy, side, ts AS created_at, round(entry, 4) AS entry, round(stop, 4) AS stop, round(target, 4) AS target,
  CASE WHEN m.now IS NULL THEN 'open' WHEN hit_at <= m.now THEN how ELSE 'expired' END AS status, CASE WHEN m.now IS NULL THEN NULL WHEN hit_at <= m.now THEN hit_at ELSE last_at END AS closed_at,
  round(CASE WHEN m.now IS NULL THEN NULL WHEN hit_at <= m.now THEN if(how = 'sl', -1.0, abs(target - entry) / abs(entry - stop)) ELSE round(sgn * (price - entry) / abs(entry - stop), 2 + 2) END, 4) AS result_r
FROM s LEFT JOIN f USING (signal_id) LEFT JOIN m USING (signal_id) LEFT JOIN l USING (signal_id)"""
