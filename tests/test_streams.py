from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.operators import journal
from tapewright.streaming import loop, positions

START = datetime(2024, 1, 1)
SIGNALS = "signal_id long, symbol string, strategy string, side string, created_at timestamp, entry double, stop double, target double"
BARS = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


def walk_rows(symbol, n, seed, skip=()):
    r = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(r.normal(0, 0.01, n)))
    return [(symbol, START + timedelta(days=i), float(c), float(c * 1.01), float(c * 0.99), float(c), 1.0) for i, c in enumerate(close) if i not in skip]


@pytest.fixture(scope="module")
def market():
    rng = np.random.default_rng(3)
    bars = walk_rows("A", 200, 1) + walk_rows("B", 120, 2) + walk_rows("C", 200, 3, range(60, 110))
    signals = []
    for n, (s, ts, _, _, _, c, _) in enumerate(bars):
        if rng.random() < 0.3:
            up, gap = bool(rng.integers(2)), c * float(rng.choice([0.02, 0.2]))
            signals.append((n, s, f"s{rng.integers(2)}", "LONG" if up else "SHORT", ts, c, c - gap if up else c + gap, c + 2 * gap if up else c - 2 * gap))
    return bars, signals


def plain(bars, signals, cooldown=3, hold=30):
    """Event by event; None for signals whose symbol has no bar at that age."""
    out, opened = {}, []
    for at, is_signal, e in sorted([(b[1], 0, b) for b in bars] + [(s[4], 1, s) for s in signals], key=lambda x: (x[0], x[1], x[2][0])):
        if is_signal:
            if any(q[1:4] == e[1:4] and (at - q[4]).days <= cooldown for q in opened):
                out[e[0]] = "held"
            else:
                opened.append(e)
                out[e[0]] = "open"
            continue
        for q in [q for q in opened if q[1] == e[0] and q[4] < at]:
            up = q[3] == "LONG"
            how = "sl" if (e[4] <= q[6] if up else e[3] >= q[6]) else "tp" if (e[3] >= q[7] if up else e[4] <= q[7]) else "expired" if (at - q[4]).days >= hold else None
            if how:
                opened.remove(q)
                out[q[0]] = how
    return out


def test_positions_follow_a_loop_and_forget(spark, market):
    bars, signals = market
    whole = [b for b in bars if b[0] == "A"]
    own = [s for s in signals if s[1] == "A"]
    e = positions.events(spark.createDataFrame(own, SIGNALS), spark.createDataFrame(whole, BARS))
    got = {r.signal_id: r.status for r in positions.last_moves(positions.follow(positions.in_slices(e, 4, "e"))).collect()}
    assert got == plain(whole, own) and {"held", "sl", "tp", "expired"} <= set(got.values())
    one = positions.last_moves(positions.follow(positions.in_slices(e, 1, "e"))).collect()
    assert {r.signal_id: r.status for r in one} == got


def test_timers_close_without_bars_and_the_state_goes(spark, market, tmp_path):
    """B's bars end, C's pause for 50 days: timers close what is 30 days old, by the last close; then nothing is kept."""
    bars, signals = market
    some = [s for s in signals if s[1] != "A" and s[4] < START + timedelta(days=150)]
    e = positions.events(spark.createDataFrame(some, SIGNALS), spark.createDataFrame(bars, BARS).unionByName(spark.createDataFrame(walk_rows("D", 290, 5), BARS)))
    stream = positions.follow(positions.in_slices(e, 12, "e"), late_days=1)
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(rows) == 4 and rows[-1] == 0  # a list and a last close each of B and C; D has no signals
    last = {}
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        if r.status != "open":
            assert r.signal_id not in last
            last[r.signal_id] = r
    told = plain(bars, some)
    ends = {"B": START + timedelta(days=119), "C": START + timedelta(days=59)}
    for s in some:
        got = last[s[0]]
        if told[s[0]] in ("held", "sl", "tp") and not (s[1] == "C" and got.status == "expired"):
            assert got.status == told[s[0]]
        else:
            assert got.status == "expired" and got.closed_at - s[4] >= timedelta(days=30)
        if got.status == "expired" and s[1] in ends and s[4] <= ends[s[1]] < s[4] + timedelta(days=30) < ends[s[1]] + timedelta(days=45):
            close = next(b[5] for b in bars if b[0] == s[1] and b[1] == ends[s[1]])
            r = (close - s[5]) / abs(s[5] - s[6]) * (1 if s[3] == "LONG" else -1)
            assert got.closed_at == s[4] + timedelta(days=30) and got.result_r == pytest.approx(r, abs=1e-4)


def plans_of(signals):
    """A scan that finds these signals at their bars."""
    def scan(bars):
        s = bars.sparkSession.createDataFrame(signals, SIGNALS).withColumnRenamed("created_at", "ts")
        return s.drop("signal_id").join(bars.select("symbol", "ts"), ["symbol", "ts"])

    return scan


def states(log):
    return {(r.symbol, r.strategy, r.side, r.created_at): (r.status, r.closed_at, r.result_r) for r in journal.latest(log).collect()}


def test_loop_is_exactly_once(spark, market, tmp_path, monkeypatch):
    bars, signals = market
    rows, scan = spark.createDataFrame(bars, BARS), plans_of(signals)
    want = loop.run_loop(positions.in_slices(rows, 5, "b"), str(tmp_path / "whole"), scan)
    events = want.count()
    assert events == want.select("signal_id", "status").distinct().count() and {"sl", "tp", "expired", "open"} <= {s for s, *_ in states(want).values()}
    # A batch that dies between its bars and its log, and one that dies after both, before the batch is noted.
    stream, base, real, died = positions.in_slices(rows, 5, "b"), str(tmp_path / "torn"), loop.one_batch, []

    def dies(batch, n, *a, **k):
        if n == 2 and "early" not in died:
            died.append("early")
            batch.write.mode("overwrite").parquet(f"{base}/bars/batch=2")
            raise RuntimeError("lost")
        real(batch, n, *a, **k)
        if n == 3 and "late" not in died:
            died.append("late")
            raise RuntimeError("lost")

    monkeypatch.setattr(loop, "one_batch", dies)
    for _ in range(2):
        with pytest.raises(Exception, match="lost"):
            loop.run_loop(stream, base, scan)
    got = loop.run_loop(stream, base, scan)
    assert died == ["early", "late"] and got.count() == events and states(got) == states(want)
    real(rows.where(F.col("ts") < START), 1, str(tmp_path / "none"), scan)
    assert loop.read_log(spark, str(tmp_path / "none")).count() == 0


def test_compaction_and_clear(spark, market, tmp_path):
    bars, signals = market
    base, scan = str(tmp_path / "c"), plans_of(signals)
    for n, days in enumerate((60, 120)):
        lo, hi = START + timedelta(days=60 * n), START + timedelta(days=days)
        loop.one_batch(spark.createDataFrame([b for b in bars if lo <= b[1] < hi], BARS), n, base, scan)
    before = loop.read_log(spark, base)
    many, whole = before.count(), states(before)
    loop.compact(spark, base, 1)
    assert states(loop.read_log(spark, base)) == whole and loop.read_log(spark, base).count() == len(whole) < many
    assert states(loop.read_log(spark, base, 1)).keys() < whole.keys()  # what batch 1 is run on, if it is run again
    cut = START + timedelta(days=40)
    loop.compact(spark, base, 1, F.lit(cut))
    loop.one_batch(spark.createDataFrame([b for b in bars if START + timedelta(days=120) <= b[1]], BARS), 2, base, scan)
    later = states(loop.read_log(spark, base))
    assert min(k[3] for k in later) >= cut and {k for k in whole if k[3] >= cut} <= later.keys() and len(later) > len({k for k in whole if k[3] >= cut})
