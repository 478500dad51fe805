"""Bars: built from event tables, parsed from payloads, normalised. A bar: symbol, ts, open, high, low, close, volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; zoneless timestamps become UTC instants, so that watermarks accept them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])


def build_bars(ticks: DataFrame, symbol: Column, ts: Column, price: Column, order: Column, volume: Column) -> DataFrame:
    """One bar a symbol and time: first and last price by ``order``; partial aggregates, one shuffle."""
    rows = ticks.select(symbol.alias("symbol"), ts.alias("ts"), price.alias("p"), order.alias("o"), volume.alias("v"))
    return rows.groupBy("symbol", "ts").agg(
        F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"), F.sum("v").cast("double").alias("volume")
    )


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol for each order priority, a bar a day."""
    o = table(spark, sf_dir, "orders")
    return build_bars(o, F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_totalprice"), F.col("o_orderkey"), F.lit(1.0))


def brand_bars(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    """A symbol for each part brand, a bar a week of shipping, price per unit."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    rows = li.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return build_bars(rows, F.col("p_brand"), F.date_trunc(unit, "l_shipdate"), F.col("l_extendedprice") / F.col("l_quantity"), order, F.col("l_quantity"))


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol for each event type, a bar an hour."""
    e = table(spark, sf_dir, "events")
    return build_bars(e, F.col("event_type"), F.date_trunc("hour", "ts"), F.col("value"), F.struct("ts", "event_id"), F.lit(1.0))


def geometric(bars: DataFrame, scale: float, places: int | None = None) -> DataFrame:
    """The bars' moves, over ``scale``, as steps of a geometric walk from 100: series with trends, as markets have them.
    ``places``: closes and opens are rounded to so many, so that flat bars are exactly flat."""
    step = (F.col("close") - F.col("open")) / scale
    w = Window.partitionBy("symbol").orderBy("ts")
    exact = lambda frame: 100.0 * F.exp(F.coalesce(F.sum(step).over(frame), F.lit(0.0)))
    level = exact if places is None else lambda frame: F.round(exact(frame), places)
    rows = bars.withColumns({
        "c": level(w.rowsBetween(Window.unboundedPreceding, 0)), "o": level(w.rowsBetween(Window.unboundedPreceding, -1)),
        "spread": (F.col("high") - F.col("low")) / (10 * scale),
    })
    high, low = F.greatest("o", "c") * (1 + F.col("spread")), F.least("o", "c") * (1 - F.col("spread"))
    return rows.select("symbol", "ts", F.col("o").alias("open"), high.alias("high"), low.alias("low"), F.col("c").alias("close"), "volume")


def walk_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order bars' days as a walk."""
    return geometric(order_bars(spark, sf_dir), 1e7)


def brand_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brand bars' days as a walk."""
    return geometric(brand_bars(spark, sf_dir, "day"), 2e5, 6)


def normalise(rows: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """Prices cast to numbers (bad ones null), rows without a price dropped, of repeated (symbol, ts) the last one by
    ``seq`` kept. Null symbol or ts: dropped."""
    cols = [F.expr(f"try_cast({c} AS double)").alias(c) for c in (*PRICES, "volume")]
    good = rows.select("symbol", "ts", *cols, seq).dropna(subset=["symbol", "ts", *PRICES])
    last = good.groupBy("symbol", "ts").agg(F.max_by(F.struct(*PRICES, "volume"), seq).alias("bar"))
    return last.select("symbol", "ts", "bar.*")


def number(bars: DataFrame) -> DataFrame:
    """Adds ``idx``, a bar's place in its symbol from 0."""
    return bars.withColumn("idx", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1)


def tail(bars: DataFrame, n: int) -> DataFrame:
    """The last n bars of each symbol (the rank limit is pushed below the shuffle)."""
    w = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    return bars.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def strip_html(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "<[^>]+>", ""))


#: Date forms, slashes read as dashes and a T between digits as a blank.
DATES = ("yyyy-M-d[ H:m[:s]]", "M-d-yyyy[ H:m[:s]]", "d MMM yyyy", "MMM d, yyyy", "yyyyMMdd")
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def cell_number(c: Column) -> Column:
    """A finite number of any precision, with or without commas, tags, exponent; else null."""
    t = F.trim(F.regexp_replace(strip_html(c), ",", ""))
    return F.when(t.rlike(_NUMBER), t.try_cast("double"))


def cell_time(c: Column) -> Column:
    """A date of 1990 or later, with or without a time of day; else null."""
    t = F.regexp_replace(strip_html(c), r"(\.[0-9]+)?Z?$", "")
    t = F.regexp_replace(F.regexp_replace(t, "/", "-"), r"(?<=[0-9])T(?=[0-9])", " ")
    ts = F.coalesce(*[F.try_to_timestamp(t, F.lit(form)) for form in DATES])
    return F.when(F.year(ts) >= 1990, ts)


def parse_payload(payloads: DataFrame, symbol: str = "symbol", body: str = "body") -> DataFrame:
    """Bars of JSON payloads {"data": [[open, low, high, close, ..., date, ...], ...]} of strings or numbers: commas and
    tags are stripped, high and low are the extremes of the four prices, the date is the first cell from the fifth on
    that is one of 1990 or later. Rows without four finite prices or a date are left out, as are bodies that are no such
    JSON. Of rows of one time the last one stays."""
    rows = F.from_json(F.get_json_object(body, "$.data"), "ARRAY<ARRAY<STRING>>")
    cell = payloads.select(F.col(symbol).alias("symbol"), F.posexplode(rows).alias("seq", "cells")).where(F.size("cells") >= 5)
    times = F.filter(F.transform(F.slice("cells", F.lit(5), F.size("cells")), cell_time), lambda t: t.isNotNull())
    got = cell.select("symbol", "seq", *[cell_number(F.get("cells", F.lit(i))).alias(f"p{i}") for i in range(4)], F.get(times, F.lit(0)).alias("ts"))
    got = got.dropna(subset=["p0", "p1", "p2", "p3", "ts"])
    each = [F.col(f"p{i}") for i in range(4)]
    bars = got.select("symbol", "ts", F.col("p0").alias("open"), F.greatest(*each).alias("high"), F.least(*each).alias("low"), F.col("p3").alias("close"), F.lit(0.0).alias("volume"), F.col("seq").alias("ingest_seq"))
    return normalise(bars)


def epoch_bars(rows: DataFrame) -> DataFrame:
    """Bars of rows whose ``ts`` is in epoch milliseconds."""
    return rows.withColumn("ts", F.timestamp_millis("ts"))


def asset_class(symbol: Column, crypto: tuple[str, ...] = (), forex: tuple[str, ...] = (), local: tuple[str, ...] = ()) -> Column:
    """Listed local codes, then crypto (listed, or with a slash), then forex (listed, or ending in =X), else stock."""
    return (
        F.when(symbol.isin(*local), "iran").when(symbol.isin(*crypto) | symbol.contains("/"), "crypto")
        .when(symbol.isin(*forex) | symbol.endswith("=X"), "forex").otherwise("stock")
    )


def classify(rows: DataFrame, universe: DataFrame) -> DataFrame:
    """Adds ``asset_class``: the class that ``universe`` (symbol, class; a row a symbol) lists for the symbol, or what its
    form says. Symbols listed twice count with the class first by name; a null symbol is a stock."""
    listed = universe.groupBy(F.col("symbol").alias("_s")).agg(F.min("class").alias("_class"))
    out = rows.join(listed, F.col("symbol") == F.col("_s"), "left")
    return out.withColumn("asset_class", F.coalesce("_class", asset_class(F.col("symbol")), F.lit("stock"))).drop("_s", "_class")
