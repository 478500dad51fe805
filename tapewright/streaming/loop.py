"""The scheduled loop: every batch of bars resolves the journal's open signals, scans, and appends what is new. A batch
writes folders named by its number and reads only those of lower ones, so that a batch that is run again, after a crash, say,
leaves the journal as if it had run once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions.core import CONFIG
from tapewright.operators import indicators, journal, strategies

LOG = "signal_id long, created_at timestamp, symbol string, asset_class string, strategy string, side string, entry double, stop double, target double, at timestamp, status string, closed_at timestamp, result_r double"
Scan = Callable[[DataFrame], DataFrame]


def _parts(spark: SparkSession, folder: str, schema: str, key: str) -> DataFrame:
    """What the batches have written to a folder so far; nothing if there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], f"{schema}, {key} int")
    return spark.read.schema(f"{schema}, {key} int").parquet(folder)


def read_log(spark: SparkSession, base: str, before: int | None = None) -> DataFrame:
    """The journal's events of the batches ``before`` one (default: all): those of the last compaction, and later ones."""
    old, log = _parts(spark, f"{base}/compact", LOG, "upto"), _parts(spark, f"{base}/log", LOG, "batch")
    if before is not None:
        old, log = old.where(F.col("upto") < before), log.where(F.col("batch") < before)
    last = old.agg(F.max("upto")).first()[0]
    if last is None:
        return log.drop("batch")
    return old.where(F.col("upto") == last).drop("upto").unionByName(log.where(F.col("batch") > last).drop("batch"))


def compact(spark: SparkSession, base: str, upto: int, since=None) -> None:
    """Writes the log of the batches up to one as one event a signal, without signals created before ``since`` (a clear):
    readers start from it. The batches' own folders stay until they are removed."""
    rows = journal.latest(read_log(spark, base, upto + 1)).withColumn("at", F.coalesce("closed_at", "created_at"))
    rows = rows if since is None else journal.cleared(rows, since)
    rows.select(*[c.split()[0] for c in LOG.split(", ")]).write.mode("overwrite").parquet(f"{base}/compact/upto={upto}")


def breakout_plans(bars: DataFrame) -> DataFrame:
    x = indicators.add_structure(indicators.add_indicators(bars), CONFIG["structure"]["lookback"], CONFIG["structure"]["width"])
    return strategies.plans(x, "trend_breakout", structure=CONFIG["structure"])


def one_batch(bars: DataFrame, n: int, base: str, scan: Scan = breakout_plans, cooldown_days: float = 3, max_hold_days: int = 30) -> None:
    """Batch ``n`` of the loop: its bars join the history, open signals are resolved up to its last bar, the plans of its
    bars are new signals but for those held back by an open, young one. An empty batch does nothing."""
    spark = bars.sparkSession
    bars.write.mode("overwrite").parquet(f"{base}/bars/batch={n}")
    history = _parts(spark, f"{base}/bars", ", ".join(f"{c} {t}" for c, t in bars.dtypes), "batch").where(F.col("batch") <= n)
    own = history.where(F.col("batch") == n)
    first, now = own.agg(F.min("ts"), F.max("ts")).first()
    if now is None:
        return
    log = read_log(spark, base, n)
    open_ = journal.latest(log).where("status = 'open'")
    closed = journal.closing_events(journal.resolve(open_, history.select("symbol", "ts", "high", "low", "close"), F.lit(now), max_hold_days))
    plans = scan(history.drop("batch")).join(own.select("symbol", "ts"), ["symbol", "ts"], "left_semi")
    plans = plans.withColumns({"created_at": F.col("ts"), "asset_class": F.lit("stock"), "signal_id": F.xxhash64("symbol", "strategy", "side", "ts")})
    fresh = journal.new_signals(plans.select(*journal.SIGNAL), log.unionByName(closed), F.lit(now), cooldown_days)
    names = [c.split()[0] for c in LOG.split(", ")]
    closed.select(*names).unionByName(fresh.select(*names)).write.mode("overwrite").parquet(f"{base}/log/batch={n}")


def run_loop(bars: DataFrame, base: str, scan: Scan = breakout_plans, **settings) -> DataFrame:
    """Runs the loop over what the stream of bars has, from where the last run at ``base`` ended; the journal's log."""
    q = bars.writeStream.foreachBatch(lambda batch, n: one_batch(batch, n, base, scan, **settings)).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return read_log(bars.sparkSession, base)
