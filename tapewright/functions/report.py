"""Text of signals and of the journal's performance, as columns: rows become text where they are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapewright.functions.core import price_text


def signal_card() -> Column:
    """Lines on a signal: what, where, and how much. Null prices show as n/a; size 0 as forecast only."""
    price = lambda c: F.coalesce(price_text(F.col(c)), F.lit("n/a"))
    head = F.concat_ws(" ", "side", "symbol", F.concat(F.lit("("), F.col("strategy"), F.lit(")")))
    plan = F.concat(F.lit("entry "), price("entry"), F.lit(", stop "), price("stop"), F.lit(", target "), price("target"))
    size = F.when(F.col("units") > 0, F.concat(F.lit("units "), price("units"))).otherwise(F.lit("forecast only"))
    return F.concat_ws("\n", head, plan, size)


def performance_text() -> Column:
    """One line on a row of ``journal.performance``."""
    share = F.format_string("%.1f%%", 100 * F.col("win_rate"))
    counts = F.format_string("%d signals, %d open, %d closed (%d at target, %d at stop)", "total", "open", "closed", "tp", "sl")
    return F.when(F.col("closed") == 0, F.concat(counts, F.lit("; nothing closed yet"))).otherwise(F.concat(counts, F.lit("; won "), share, F.format_string(", total %.2f R", "total_r")))


def management_text() -> Column:
    """One line on a row of ``journal.review``: where the position is, stop and target advised, why, and what to mind."""
    flags = F.concat_ws(", ", F.when(F.col("danger"), "in danger"), F.when(F.col("near_target"), "near the target"), F.when(F.col("at_breakeven") | F.col("trailed"), "free of risk"))
    head = F.concat_ws(" ", "side", "symbol", F.format_string("%+.2f R", "r_now"))
    advice = F.concat(F.lit("stop "), price_text(F.col("recommended_sl")), F.lit(", take profit "), price_text(F.col("recommended_tp")))
    reason = F.when(F.col("tp_reason") != "", F.concat(F.lit(" ("), F.col("tp_reason"), F.lit(")"))).otherwise("")
    return F.concat(head, F.lit(": "), advice, reason, F.when(flags != "", F.concat(F.lit("; "), flags)).otherwise(""))


def scan_line() -> Column:
    """One line on a signal of a scan: place, plan, and how sure."""
    plan = F.concat(F.lit("entry "), price_text(F.col("entry")), F.lit(", target "), price_text(F.col("target")))
    sure = F.format_string("%.1f to 1, confidence %.0f%%", F.col("rr"), 100 * F.col("confidence"))
    return F.concat(F.format_string("%d. ", "place"), F.concat_ws(" ", "side", "symbol", F.concat(F.lit("("), F.col("strategy"), F.lit(")"))), F.lit(": "), plan, F.lit(", "), sure, F.when(~F.col("published"), ", held back").otherwise(""))


def portfolio_text() -> Column:
    """Lines on a row of ``risk.portfolio``; empty without positions."""
    money = lambda c: F.format_number(F.col(c), 0)
    lines = F.array(
        F.format_string("%d positions: %d long, %d short", "n", "longs", "shorts"), F.concat(F.lit("at risk "), money("risk"), F.format_string(", %.1f%% of equity", "risk_pct")),
        F.concat(F.lit("exposure "), money("gross"), F.lit(" gross, "), money("net"), F.lit(" net")),
        F.array_join(F.transform(F.map_entries("risk_by_class"), lambda e: F.concat(e["key"], F.lit(" "), F.format_number(e["value"], 0))), ", "),
    )
    return F.when(F.col("n") == 0, "").otherwise(F.array_join(F.concat(lines, F.transform("warnings", lambda w: F.concat(F.lit("mind: "), w))), "\n"))


def grid_line() -> Column:
    """One line on a row of ``optimize.grid_search``."""
    late = F.when(F.col("score") > float("-inf"), F.format_string("%+.2f R late over %d trades", "oos_expectancy", "oos_trades")).otherwise(F.lit("too few trades"))
    return F.concat(F.col("params"), F.lit(": "), late, F.format_string(", %+.2f R in all, %.0f%% won", F.col("expectancy"), 100 * F.col("win_rate")))


def forecast_card() -> Column:
    """Lines on a signal that cannot be traded: the level expected and the one that ends the forecast."""
    price = lambda c: F.coalesce(price_text(F.col(c)), F.lit("n/a"))
    return F.concat_ws("\n", F.concat_ws(" ", F.lit("forecast:"), "symbol", F.when(F.col("side") == "SHORT", "down").otherwise("up"), F.concat(F.lit("("), F.col("strategy"), F.lit(")"))), F.concat(F.lit("towards "), price("target"), F.lit(", off at "), price("stop"), F.lit(", now "), price("entry")))
