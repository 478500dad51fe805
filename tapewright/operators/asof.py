"""As-of join: each row of one table with the last row of another at its time or before, by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a bucket of time.
BUCKET = 30 * 86400


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], ts: str = "ts", tolerance: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """``left`` with ``columns`` of the last row of ``right`` of the same keys whose ``ts`` is not later, and ``<ts>_asof``, its
    time; null where there is none, or none within ``tolerance`` seconds. Of right rows of one time the last one by
    their columns counts. Rows of null time or key have no partner; repeated left rows stay.

    Both sides are one table, in order within buckets of time; what a bucket's end hands on to the next ones is one row a
    bucket, so that a key with a third of all rows is many tasks'. No row meets more than its own partner."""
    time = F.unix_micros(F.col(ts).cast("timestamp"))
    stamp = f"{ts}_asof"
    value = F.struct(F.col(ts).alias(stamp), *columns)
    both = right.where(F.col(ts).isNotNull()).select(*keys, time.alias("_t"), value.alias("_v"), F.lit(None).cast(left.schema).alias("_row"))
    asks = left.select(*[F.col(k) for k in keys], time.alias("_t"), F.lit(None).cast(both.schema["_v"].dataType).alias("_v"), F.struct(*left.columns).alias("_row"))
    both = both.unionByName(asks).withColumn("_b", F.floor(F.col("_t") / (bucket * 1_000_000)))
    w = Window.partitionBy(*keys, "_b").orderBy("_t", F.col("_row").isNotNull(), "_v").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_near", F.last("_v", ignorenulls=True).over(w))
    ends = right.where(F.col(ts).isNotNull()).groupBy(*keys, F.floor(time / (bucket * 1_000_000)).alias("_b")).agg(F.max(value).alias("_end"))
    # One row a bucket that a key has rows of, on either side.
    steps = both.select(*keys, "_b").distinct().join(ends, [*keys, "_b"], "left")
    prior = F.last("_end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    steps = steps.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_c"), prior.alias("_far"))
    same = F.col("_b") == F.col("_c")
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"_k{i}"))
    out = both.where(F.col("_row").isNotNull()).join(steps, same, "left").withColumn("_hit", F.coalesce("_near", "_far"))
    if tolerance is not None:
        near = F.col("_t") - F.unix_micros(F.col(f"_hit.{stamp}").cast("timestamp")) <= tolerance * 1_000_000
        out = out.withColumn("_hit", F.when(near, F.col("_hit")))
    known = F.col("_t").isNotNull()
    return out.select("_row.*", *[F.when(known, F.col(f"_hit.{c}")).alias(c) for c in (stamp, *columns)])
