"""DuckDB SQL of the scans: plans of strategies, factor and pairs, measured, drawn, judged."""

from __future__ import annotations

from tapewright.operators.pairs import CRITICAL
from tapewright.plans import oracles as sql

#: Rounding of values that are worked on further; that of results gets a nudge besides.
def inner(x: str, n: int = 4) -> str:
    return f"round(({x}) + 1e-9, {n} + 0)"


def bits(k: int) -> str:
    return f"('0x' || m[{8 * k + 1}:{8 * k + 8}])::BIGINT"


def uniform(k: int) -> str:
    return f"(({bits(k)} + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def normals(seed: int, name: str, paths: int = 4000, bars: int = 60) -> str:
    """(path, step, z): the walks' draws."""
    far = {k: f"sqrt(-2.0::DOUBLE * ln({uniform(k)}))" for k in (0, 2)}
    four = ", ".join(f"{far[k]} * {f}(2.0::DOUBLE * pi() * {uniform(k + 1)})" for k in (0, 2) for f in ("cos", "sin"))
    return f"""{name} AS MATERIALIZED (SELECT path, block * 4 + k AS step, z[k + 1] AS z FROM (
  SELECT path, block, [{four}] AS z FROM (SELECT path, block, md5('{seed}:' || path || ':' || block) AS m FROM range({paths}) p(path), range({bars // 4}) b(block))), range(4) r(k))"""


def bootstrap(key: str, source: str, sims: int = 5000) -> str:
    """bs (key, ...) from ``source`` (key, units), units being a list of whole millionths in order."""
    return f"""own AS MATERIALIZED (SELECT {key}, len(units) AS n, unnest(units) AS unit, unnest(range(len(units))) AS pick FROM (SELECT DISTINCT {key}, units FROM {source})),
bp AS (SELECT {key}, n, path, unnest(range((n + 3) // 4)) AS block FROM own, range({sims}) p(path) WHERE pick = 0),
bm AS (SELECT *, md5('42:' || path || ':' || block) AS m FROM bp),
bk AS (SELECT {key}, path, n, block * 4 + k AS step, (((('0x' || m[8 * k + 1:8 * k + 8])::BIGINT) * n) >> 32) AS pick FROM bm, range(4) r(k) WHERE block * 4 + k < n),
bd AS (SELECT {key}, path, step, sum(unit) OVER (PARTITION BY {key}, path ORDER BY step) AS s FROM bk JOIN own USING ({key}, n, pick)),
be AS (SELECT {key}, path, arg_max(s, step) AS total, min(s) AS low FROM bd GROUP BY {key}, path),
bs AS (SELECT {key}, {inner("avg(if(total > 0, 1.0, 0.0))")} AS prob_profitable, {inner("avg(if(low <= -10000000, 1.0, 0.0))")} AS risk_of_ruin FROM be GROUP BY {key})"""


UNITS = "list(round(r * 1000000)::BIGINT ORDER BY {}) AS units"


def strategy_part(name: str, bars: str, least: str = "") -> str:
    """Each symbol's latest plan with its strategy's statistics."""
    late = "late AS (SELECT * EXCLUDE (n_, k_) FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n_, row_number() OVER (PARTITION BY symbol ORDER BY idx) AS k_ FROM done) WHERE n_ >= 4 AND k_ > floor(n_ * 0.7::DOUBLE))"
    suits = "ranging" if name == "mean_reversion" else "trending"
    return f"""{sql.plans(name, bars)}, {sql.FIXED if name == "mean_reversion" else sql.TRAILING}, {sql.GREEDY}, {late}, st AS ({sql.stat_columns()}), lt AS ({sql.stat_columns().replace("FROM done", "FROM late")}),
un AS (SELECT strategy, symbol, {UNITS.format("idx")} FROM done GROUP BY ALL),
rg AS (SELECT symbol, max(idx) AS last_idx, CASE WHEN arg_max(adx, ts) >= 25 THEN 'trending' WHEN arg_max(adx, ts) < 20 THEN 'ranging' ELSE 'neutral' END AS regime FROM x GROUP BY symbol),
newest AS (SELECT * FROM plans QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY idx DESC) = 1)
SELECT 'symbol' AS kind, p.strategy || '|' || p.symbol AS key, p.strategy || '|' || p.symbol AS tkey, p.strategy, p.symbol, NULL::VARCHAR AS class, p.ts, p.side, p.sgn, p.entry, p.stop, p.target, p.atr, x.drift, p.stop_level, p.target_level,
  st.trades, st.win_rate, st.profit_factor, st.expectancy, st.sharpe, coalesce(lt.trades, 0) AS oos_trades, coalesce(lt.expectancy, 0.0) AS oos_expectancy, units, regime,
  p.idx = last_idx AND regime IN ('neutral', '{suits}') AS live, NULL::DOUBLE AS z, NULL::DOUBLE AS phi, NULL::DOUBLE AS eps
FROM newest p JOIN st USING (strategy, symbol) JOIN un USING (strategy, symbol) LEFT JOIN lt USING (strategy, symbol) JOIN rg USING (symbol) JOIN x ON x.symbol = p.symbol AND x.idx = p.idx"""


def classed(universe: str) -> str:
    form = "CASE WHEN contains(symbol, '/') THEN 'crypto' WHEN suffix(symbol, '=X') THEN 'forex' ELSE 'stock' END"
    return f"coalesce(class, (SELECT c FROM ({universe}) q(s, c) WHERE q.s = symbol), {form})"


def judged(parts: list[str], universe: str) -> str:
    """w: all parts' rows with everything that a scan says of them."""
    half = "0.35::DOUBLE"
    quality = f"round(0.4::DOUBLE * greatest(0, least(1, (win_rate - {half}) / 0.4::DOUBLE)) + {half} * greatest(0, least(1, profit_factor - 1)) + 0.25::DOUBLE * greatest(0, least(1, sharpe / 2)), 3)"
    edge = "greatest(0, least(1, (win_prob - baseline_win_prob) / 0.25::DOUBLE + 0.5::DOUBLE))"
    late = "CASE WHEN oos_expectancy > 0 THEN 1.0::DOUBLE WHEN oos_expectancy = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END"
    return f"""g AS MATERIALIZED ({" UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)}),
{normals(7, "nz")}, {normals(11, "ez")}, {bootstrap("tkey", "g")},
a AS (SELECT *, {classed(universe)} AS asset_class, abs(entry - stop) AS gap, abs(target - entry) AS gain FROM g),
wk AS (SELECT key, path, step, gain, gap, sum(sgn * drift + sgn * atr * nz.z) OVER (PARTITION BY key, path ORDER BY step) AS pos FROM a, nz WHERE kind <> 'pair' AND atr > 0),
wf AS (SELECT key, path, min(step) FILTER (pos >= gain) AS up, min(step) FILTER (pos <= -gap) AS down FROM wk GROUP BY key, path),
ar AS (SELECT key, path, 0 AS step, z AS at, 0 AS won, phi, eps FROM a, range(4000) p(path) WHERE kind = 'pair' AND phi > 0 AND phi < 1 AND eps > 0
  UNION ALL
  SELECT key, ar.path, ar.step + 1, v, CASE WHEN won <> 0 THEN won WHEN abs(v) <= 0.5 THEN 1 WHEN abs(v) >= 3.5 THEN -1 ELSE 0 END, phi, eps
  FROM (SELECT ar.*, ar.phi * ar.at + ar.eps * ez.z AS v FROM ar JOIN ez ON ez.path = ar.path AND ez.step = ar.step) ar),
wp AS (SELECT key, {inner("avg(if(up IS NOT NULL AND (down IS NULL OR up < down), 1.0, 0.0))")} AS win FROM wf GROUP BY key
  UNION ALL SELECT key, {inner("avg(if(won = 1, 1.0, 0.0))")} FROM ar WHERE step = 60 GROUP BY key),
b AS (SELECT a.*, prob_profitable, risk_of_ruin, {inner("CASE WHEN kind = 'pair' THEN least(1, greatest(0, (3.5::DOUBLE - abs(z)) / 3.0::DOUBLE)) ELSE coalesce(gap / nullif(gap + gain, 0), 0) END")} AS baseline_win_prob, win,
  CASE WHEN win_rate > 0 AND win_rate < 1 THEN profit_factor * (1 - win_rate) / win_rate ELSE 0 END AS b, asset_class = 'iran' AND side = 'SHORT' AS forecast_only,
  CASE WHEN kind = 'symbol' THEN count(*) OVER (PARTITION BY kind, symbol, side, live) ELSE 1 END AS confluence
  FROM a JOIN bs USING (tkey) LEFT JOIN wp USING (key)),
c AS (SELECT * REPLACE (coalesce(win, baseline_win_prob) AS win), coalesce(win, baseline_win_prob) AS win_prob,
  least(CASE WHEN b > 0 THEN greatest(0, least(1, win_rate - (1 - win_rate) / b)) ELSE 0 END * 0.5, 0.05) AS kelly FROM b),
u AS (SELECT *, CASE WHEN kelly > 0 AND NOT forecast_only THEN least(100 / gap, 10000 * kelly / entry) ELSE 0.0 END AS size_,
  round(least(1.0::DOUBLE, {half} * {quality} + 0.30::DOUBLE * greatest(0, least(1, prob_profitable)) + 0.20::DOUBLE * {edge} + 0.15::DOUBLE * {late} + least(0.10::DOUBLE, 0.05::DOUBLE * greatest(0, confluence - 1))) + 1e-9, 3) AS confidence,
  CASE kind WHEN 'factor' THEN trades >= 24 AND win_rate >= 0.45 AND profit_factor >= 1.15 ELSE trades >= 15 AND win_rate >= 0.40 AND profit_factor >= 1.40 AND sharpe >= 0.5 AND (oos_trades < 4 OR oos_expectancy > 0) AND prob_profitable >= 0.68 END AS passed FROM c),
w AS (SELECT *, live AND passed AND (forecast_only OR confidence >= 0.62) AS published FROM u)"""


COLUMNS = """strategy, symbol, asset_class, ts, side, round(entry, 4) AS entry, round(stop, 4) AS stop, round(target, 4) AS target, round(coalesce(round(gain / nullif(gap, 0), 3), 0), 4) AS rr, round(size_, 4) AS units,
  round(size_ * entry, 4) AS notional, round(round(size_ * entry / 10000 * 100, 2), 4) AS equity_pct, round(size_ * gap, 4) AS risk_amount, round(round(size_ * gap / 10000 * 100, 2), 4) AS risk_pct,
  round(round(entry + sgn * gap, 6), 4) AS risk_free_at, regime, trades, round(win_rate, 4) AS win_rate, round(profit_factor, 4) AS profit_factor, round(expectancy, 4) AS expectancy, round(sharpe, 4) AS sharpe, oos_trades,
  round(oos_expectancy, 4) AS oos_expectancy, round(prob_profitable, 4) AS prob_profitable, round(risk_of_ruin, 4) AS risk_of_ruin, round(win_prob, 4) AS win_prob, confluence, round(confidence, 4) AS confidence, live, passed, forecast_only"""

ORDER_UNIVERSE = "SELECT * FROM (VALUES ('1-URGENT', 'iran'), ('2-HIGH', 'crypto'), ('3-MEDIUM', 'forex')) v(s, c)"

SIGNALS = f"""WITH RECURSIVE {judged([strategy_part(n, sql.SCANNED) for n in sql.TRIGGERS], ORDER_UNIVERSE)}
SELECT {COLUMNS}, round(baseline_win_prob, 4) AS baseline_win_prob,
  concat_ws('; ', CASE WHEN stop_level IS NOT NULL THEN printf('stop beyond level %.4f', stop_level) END, CASE WHEN target_level IS NOT NULL THEN printf('target before level %.4f', target_level) END) AS note FROM w"""

#: The brand bars' days as a walk, and the last 1250 of each symbol.
BRAND_WALK = f"""{sql.BRAND.replace("bars AS", "day_bars AS", 1).replace("'week'", "'day'")},
walk AS (SELECT symbol, ts, volume, (high - low) / 2e6 AS spread, round(100.0::DOUBLE * exp(sum((close - open) / 2e5) OVER w), 6) AS close,
  round(100.0::DOUBLE * exp(coalesce(sum((close - open) / 2e5) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)), 6) AS open
  FROM day_bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
bars AS (SELECT symbol, ts, open, greatest(open, close) * (1 + spread) AS high, least(open, close) * (1 - spread) AS low, close, volume FROM walk)"""
WALK_SCANNED = f"""{BRAND_WALK.replace("bars AS (SELECT symbol, ts, open", "all_bars AS (SELECT symbol, ts, open")}, bars AS (SELECT * EXCLUDE (n_) FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n_ FROM all_bars) WHERE n_ >= 60
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 1250)"""
BRAND_UNIVERSE = "SELECT DISTINCT p_brand, CASE substr(p_brand, 7, 1) WHEN '1' THEN 'crypto' WHEN '2' THEN 'forex' ELSE 'iran' END FROM part WHERE substr(p_brand, 7, 1) IN ('1', '2', '3', '4', '5')"


def late_of(key: str, order: str) -> str:
    return f"late AS (SELECT * EXCLUDE (n_, k_) FROM (SELECT *, count(*) OVER (PARTITION BY {key}) AS n_, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS k_ FROM done) WHERE n_ >= 4 AND k_ > floor(n_ * 0.7::DOUBLE))"


_NONE = "NULL::DOUBLE AS stop_level, NULL::DOUBLE AS target_level"
FACTOR_PART = f"""WITH RECURSIVE {WALK_SCANNED}, {sql.WINDOWS}, {sql.RECURSIVE}, {sql.STRUCTURE},
cb AS (SELECT *, NULL::VARCHAR AS class FROM bars), kc AS (SELECT *, {classed(BRAND_UNIVERSE)} AS ac FROM cb), kr AS (SELECT * FROM kc WHERE ac <> 'iran'),
kn AS (SELECT ac, count(DISTINCT symbol) AS n FROM kr GROUP BY ac), kt AS (SELECT ac, ts FROM kr JOIN kn USING (ac) GROUP BY ac, ts, n HAVING count(*) = n),
kp AS (SELECT ac, symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS t FROM kr JOIN kt USING (ac, ts)),
ks AS (SELECT *, lag(close, 21) OVER v / lag(close, 147) OVER v - 1 AS score, lead(close, 21) OVER v / close - 1 AS fwd FROM kp WINDOW v AS (PARTITION BY symbol ORDER BY t)),
ku AS (SELECT *, row_number() OVER (PARTITION BY ac, t ORDER BY score DESC, symbol) AS hi, row_number() OVER (PARTITION BY ac, t ORDER BY score, symbol DESC) AS lo
  FROM ks WHERE t >= 147 AND (t - 147) % 21 = 0 AND fwd IS NOT NULL AND score IS NOT NULL),
done AS (SELECT ac, t, avg(fwd) FILTER (hi <= 2) - avg(fwd) FILTER (lo <= 2) AS r FROM ku GROUP BY ac, t), {late_of("ac", "t")},
st AS ({sql.stat_columns("t", "ac")}), lt AS ({sql.stat_columns("t", "ac").replace("FROM done", "FROM late")}), un AS (SELECT ac, {UNITS.format("t")} FROM done GROUP BY ac),
s AS (SELECT *, NULL::VARCHAR AS class, lag(close, 21) OVER v AS past, lag(close, 147) OVER v AS far FROM y WINDOW v AS (PARTITION BY symbol ORDER BY ts)),
l AS (SELECT *, past / far - 1 AS score, {classed(BRAND_UNIVERSE)} AS ac FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1) WHERE idx >= 148 AND far > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY ac ORDER BY score DESC, symbol) AS hi, row_number() OVER (PARTITION BY ac ORDER BY score, symbol DESC) AS lo, count(*) OVER (PARTITION BY ac) AS scored FROM l WHERE ac <> 'iran'),
t AS (SELECT *, close AS entry, if(side = 'LONG', 1.0, -1.0) AS sgn FROM (SELECT *, 'LONG' AS side FROM k WHERE hi <= 2 UNION ALL SELECT *, 'SHORT' FROM k WHERE lo <= 2) WHERE atr > 0 AND scored >= 4),
{sql.refined(3.0, 2.0)}
SELECT 'factor' AS kind, symbol || '|' || side AS key, 'factor|' || ac AS tkey, 'factor_momentum' AS strategy, symbol, ac AS class, ts, side, sgn, entry, stop, target, atr, drift, {_NONE},
  st.trades, st.win_rate, st.profit_factor, st.expectancy, st.sharpe, coalesce(lt.trades, 0) AS oos_trades, coalesce(lt.expectancy, 0.0) AS oos_expectancy, units, 'cross-section' AS regime, true AS live,
  NULL::DOUBLE AS z, NULL::DOUBLE AS phi, NULL::DOUBLE AS eps
FROM t5 JOIN st USING (ac) JOIN un USING (ac) LEFT JOIN lt USING (ac) WHERE {sql._ORDERED}"""


def p_value() -> str:
    steps = " ".join(f"WHEN t <= {b} THEN {p} + (t - ({a})) / ({b} - ({a})) * ({q} - {p})" for (a, p), (b, q) in zip(CRITICAL, CRITICAL[1:]))
    return f"CASE WHEN t <= {CRITICAL[0][0]} THEN {CRITICAL[0][1]} {steps} ELSE least(0.999, {CRITICAL[-1][1]} + (t - ({CRITICAL[-1][0]})) * 0.1) END"


_STATE = sql.PAIR_STATE.split("l AS (SELECT * FROM a", 1)[1].split("\nSELECT pair, ts, round(beta", 1)[0]
PAIR_PART = f"""WITH RECURSIVE {WALK_SCANNED},
tw AS (SELECT symbol || '~' AS symbol, ts, 1.8 * close + 10.0 + 2.0 * pow((volume % 97 - 48) / 48.0, 3) AS close FROM bars),
a AS (SELECT tw.symbol || '/' || bars.symbol AS pair, bars.ts, tw.close AS a, bars.close AS b FROM tw JOIN bars ON tw.symbol = bars.symbol || '~' AND tw.ts = bars.ts),
m AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY ts) - 1 AS idx, count(*) OVER v AS n, avg(a) OVER v AS ma, avg(b) OVER v AS mb, var_pop(a) OVER v AS va, var_pop(b) OVER v AS vb,
  covar_pop(a, b) OVER v AS ab FROM a WINDOW v AS (PARTITION BY pair ORDER BY ts ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)),
zs AS (SELECT pair, idx, row_number() OVER (PARTITION BY pair ORDER BY ts) AS k, (a - ab / vb * b - (ma - ab / vb * mb)) / sqrt(va - ab / vb * ab) AS z FROM m WHERE n = 252),
pl AS (SELECT pair FROM m GROUP BY pair HAVING count(*) >= 282),
q AS (SELECT pair, 0::BIGINT AS k, 0 AS pos, 0.0::DOUBLE AS since, 0::BIGINT AS idx, NULL::DOUBLE AS r FROM pl
  UNION ALL
  SELECT q.pair, zs.k, CASE WHEN pos = 0 THEN CASE WHEN z <= -2 THEN 1 WHEN z >= 2 THEN -1 ELSE 0 END WHEN pos * z >= -0.5 OR pos * z <= -3.5 THEN 0 ELSE pos END,
    if(pos = 0, z, since), zs.idx, CASE WHEN pos = 0 THEN NULL WHEN pos * z >= -0.5 THEN pos * (z - since) / 1.5 WHEN pos * z <= -3.5 THEN -1.0 END
  FROM q JOIN zs ON zs.pair = q.pair AND zs.k = q.k + 1),
done AS (SELECT pair, idx, r FROM q WHERE r IS NOT NULL), {late_of("pair", "idx")},
st AS ({sql.stat_columns("idx", "pair")}), lt AS ({sql.stat_columns("idx", "pair").replace("FROM done", "FROM late")}), un AS (SELECT pair, {UNITS.format("idx")} FROM done GROUP BY pair),
l AS (SELECT * FROM a{_STATE},
kk AS (SELECT k.*, a.a, a.b, {p_value()} AS p, if(z <= -2, -1.0, 1.0) AS way FROM k JOIN a ON a.pair = k.pair AND a.ts = k.ts),
pp AS (SELECT *, if(z <= -2, 'LONG', 'SHORT') AS side, -way AS sgn, a AS entry, mu + way * 0.5 * sigma + beta * b + alpha AS target, mu + way * 3.5 * sigma + beta * b + alpha AS stop FROM kk WHERE p <= 0.05 AND abs(z) >= 2)
SELECT 'pair' AS kind, pair AS key, 'pair|' || pair AS tkey, 'pairs' AS strategy, split_part(pair, '/', 1) AS symbol, 'stock' AS class, ts, side, sgn, entry, stop, target, NULL::DOUBLE AS atr, NULL::DOUBLE AS drift, {_NONE},
  st.trades, st.win_rate, st.profit_factor, st.expectancy, st.sharpe, coalesce(lt.trades, 0) AS oos_trades, coalesce(lt.expectancy, 0.0) AS oos_expectancy, units, 'pair' AS regime, true AS live, z, phi, sigma_eps AS eps
FROM pp JOIN st USING (pair) JOIN un USING (pair) LEFT JOIN lt USING (pair) WHERE {sql._ORDERED}"""

UNIVERSE = f"""WITH RECURSIVE {judged([*[strategy_part(n, WALK_SCANNED) for n in sql.TRIGGERS], FACTOR_PART, PAIR_PART], BRAND_UNIVERSE)}
SELECT {COLUMNS}, published, row_number() OVER (ORDER BY published DESC, confidence DESC, strategy, symbol, side)::INT AS place FROM w"""

PAIR_CHANCE = f"""{sql.PAIR_STATE.split("SELECT pair, ts, round(beta", 1)[0].replace("WITH ", "WITH RECURSIVE ", 1).rstrip()}, {normals(11, "ez")},
ar AS (SELECT pair, path, 0 AS step, z AS at, 0 AS won, phi, sigma_eps AS eps FROM k, range(4000) p(path) WHERE phi > 0 AND phi < 1 AND sigma_eps > 0
  UNION ALL
  SELECT pair, path, step + 1, v, CASE WHEN won <> 0 THEN won WHEN abs(v) <= 0.5 THEN 1 WHEN abs(v) >= 3.5 THEN -1 ELSE 0 END, phi, eps
  FROM (SELECT ar.*, ar.phi * ar.at + ar.eps * ez.z AS v FROM ar JOIN ez ON ez.path = ar.path AND ez.step = ar.step)),
won AS (SELECT pair, {inner("avg(if(won = 1, 1.0, 0.0))")} AS win FROM ar WHERE step = 60 GROUP BY pair)
SELECT pair, round(z, 4) AS z, round(phi, 4) AS phi, round(sigma_eps, 4) AS sigma_eps, round({p_value()}, 4) AS p_value,
  round(coalesce(win, {inner("least(1, greatest(0, (3.5::DOUBLE - abs(z)) / 3.0::DOUBLE))")}), 4) AS win_prob FROM k LEFT JOIN won USING (pair)"""
