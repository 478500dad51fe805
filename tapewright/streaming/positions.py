"""The journal as a stream: signals and bars of a symbol meet in keyed state with timers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tapewright.streaming.bars import shared_dir

EVENT = "kind string, symbol string, ts timestamp, signal_id long, strategy string, side string, entry double, stop double, target double, high double, low double, close double"
MOVE = "signal_id long, symbol string, strategy string, side string, created_at timestamp, status string, closed_at timestamp, result_r double"
_HELD = "signal_id long, strategy string, side string, created_at long, entry double, stop double, target double"
DAY = 86_400_000


def events(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """One stream of both: signals (signal_id, symbol, strategy, side, created_at, entry, stop, target) and bars."""
    s = signals.select(F.lit("signal").alias("kind"), "symbol", F.col("created_at").alias("ts"), F.col("signal_id").cast("long"), "strategy", "side", "entry", "stop", "target")
    b = bars.select(F.lit("bar").alias("kind"), "symbol", "ts", "high", "low", "close")
    none = lambda df, *cols, t: df.withColumns({c: F.lit(None).cast(t) for c in cols})
    s = none(s, "high", "low", "close", t="double")
    b = none(none(none(b, "signal_id", t="long"), "strategy", "side", t="string"), "entry", "stop", "target", t="double")
    names = [c.split()[0] for c in EVENT.split(", ")]
    return s.select(*names).unionByName(b.select(*names))


def _millis(ts: pd.Timestamp) -> int:
    return int(ts.tz_localize("UTC").timestamp() * 1000) if ts.tzinfo is None else int(ts.timestamp() * 1000)


class Positions(StatefulProcessor):
    """State of a symbol: its open signals, a row each, and its last close. Both go when no signal is open."""

    def __init__(self, cooldown_days: float, max_hold_days: float, late_days: float):
        self.cooldown, self.hold, self.late = int(cooldown_days * DAY), int(max_hold_days * DAY), int(late_days * DAY)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", _HELD)
        self.last = handle.getValueState("last", "close double")

    def _move(self, symbol: str, p: tuple, status: str, at: int | None, r: float | None) -> tuple:
        return (p[0], symbol, p[1], p[2], pd.Timestamp(p[3], unit="ms"), status, None if at is None else pd.Timestamp(at, unit="ms"), r)

    @staticmethod
    def _r(p: tuple, price: float) -> float:
        risk = abs(p[4] - p[5])
        return round((price - p[4] if p[2] == "LONG" else p[4] - price) / risk, 4) if risk else 0.0

    def _timed_out(self, symbol: str, p: tuple, last: float | None) -> tuple:
        return self._move(symbol, p, "expired", p[3] + self.hold, 0.0 if last is None else self._r(p, last))

    def _after(self, symbol: str, held: list[tuple], at: int, high: float, low: float, close: float, last: float | None) -> tuple[list[tuple], list[tuple]]:
        """What a bar leaves open, and what it closes: at the stop, else at the target, else for age; but signals whose timer
        may have run out before it are closed as the timer does, whatever the batches."""
        left, moves = [], []
        for p in held:
            up = p[2] == "LONG"
            if at <= p[3]:
                left.append(p)
            elif at - p[3] > self.hold + self.late:
                moves.append(self._timed_out(symbol, p, last))
            elif low <= p[5] if up else high >= p[5]:
                moves.append(self._move(symbol, p, "sl", at, -1.0))
            elif high >= p[6] if up else low <= p[6]:
                moves.append(self._move(symbol, p, "tp", at, abs(p[6] - p[4]) / abs(p[4] - p[5]) if p[4] != p[5] else 0.0))
            elif at - p[3] >= self.hold:
                moves.append(self._move(symbol, p, "expired", at, self._r(p, close)))
            else:
                left.append(p)
        return left, moves

    def _keep(self, held: list[tuple], close: float | None) -> None:
        if held:
            self.open.put(held)
            if close is not None:
                self.last.update((close,))
        else:
            self.open.clear()
            self.last.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, moves, last = [tuple(p) for p in self.open.get()], [], self.last.get()
        close = last[0] if last else None
        batch = pd.concat(list(rows))
        # A bar of the time of a signal comes before it.
        for e in batch.sort_values(["ts", "kind", "signal_id"]).itertuples():
            at = _millis(e.ts)
            if e.kind == "bar":
                held, done = self._after(key[0], held, at, e.high, e.low, e.close, close)
                moves, close = moves + done, e.close
                continue
            p = (int(e.signal_id), e.strategy, e.side, at, e.entry, e.stop, e.target)
            if any(q[1:3] == p[1:3] and at - q[3] <= self.cooldown for q in held):
                moves.append(self._move(key[0], p, "held", at, None))
            else:
                held.append(p)
                self.handle.registerTimer(at + self.hold)
                moves.append(self._move(key[0], p, "open", None, None))
        self._keep(held, close)
        if moves:
            yield pd.DataFrame(moves, columns=[c.split()[0] for c in MOVE.split(", ")])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Time went by without a bar: signals of that age close at the last one, or at their entry if there was none."""
        now, last = expiredTimerInfo.getExpiryTimeInMs(), self.last.get()
        left, moves = [], []
        for p in (tuple(p) for p in self.open.get()):
            if now - p[3] >= self.hold:
                moves.append(self._timed_out(key[0], p, last[0] if last else None))
            else:
                left.append(p)
        self._keep(left, None)
        if moves:
            yield pd.DataFrame(moves, columns=[c.split()[0] for c in MOVE.split(", ")])

    def close(self) -> None:
        pass


def follow(stream: DataFrame, cooldown_days: float = 3, max_hold_days: float = 30, late_days: int = 15) -> DataFrame:
    """(signal_id, symbol, strategy, side, created_at, status, closed_at, result_r): what becomes of the signals of a stream
    of ``events``, a row a change. A signal is held back while one of its symbol, strategy and side is open and at most
    ``cooldown_days`` old; else it opens. It closes by the first bar after it that reaches its stop, else its target, or that
    is ``max_hold_days`` later; or, if no bar comes within ``late_days`` of that age, at that age and the last close: by a
    timer once the watermark, ``late_days`` behind, has passed it. Events of null symbol or time are left out; those
    behind the watermark too. Needs the RocksDB state store."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    known = stream.where("symbol IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", f"{late_days} days")
    return known.groupBy("symbol").transformWithStateInPandas(Positions(cooldown_days, max_hold_days, late_days), MOVE, "Append", "EventTime")


def in_slices(df: DataFrame, slices: int, name: str) -> DataFrame:
    """A stream of ``df`` by time: ``slices`` equal spans of ``ts``, each a batch, written one after the other."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    lo, hi = df.agg(F.min(F.unix_millis("ts")), F.max(F.unix_millis("ts"))).first()
    cut = F.least(F.lit(slices - 1), F.floor((F.unix_millis("ts") - (lo or 0)) * slices / max(1, (hi or 0) - (lo or 0))))
    for n in range(slices):
        df.where(cut == n).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def last_moves(stream: DataFrame) -> DataFrame:
    """Runs the stream over what is there; the last change of each signal."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/moves-{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out")
    q.awaitTermination()
    moves = spark.read.schema(stream.schema).parquet(f"{base}/out")
    last = F.max_by(F.struct("status", "closed_at", "result_r"), (F.col("status") != "open").cast("int"))
    return moves.groupBy("signal_id", "symbol", "strategy", "side", "created_at").agg(last.alias("x")).select("signal_id", "symbol", "strategy", "side", "created_at", "x.*")
