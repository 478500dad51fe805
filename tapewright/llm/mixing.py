"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm.store import fresh, stage

WEIGHTS = (5.0, 2.0, 1.0)
GOLDEN = 0.6180339887498949
MAX_REPEATS = 3
#: A block is total size / BLOCKS words, within [SMALLEST_BLOCK, LARGEST_BLOCK]; in a small source, its size / OWN_BLOCKS.
BLOCKS, SMALLEST_BLOCK, LARGEST_BLOCK, OWN_BLOCKS = 65536, 64, 4096, 16
#: Consecutive slots ranked together; runs of documents that one task sums up.
CHUNK, RUNS = 65536, 4096
#: Cells in which points of the schedule meet the sources' shares.
CELLS = 4096


def word_count(text: str | Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null: 0."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.coalesce(F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size): one row a source.

    Sources by code point, null last, weigh ``weights``, repeating. All sizes are shared by weight; a target stops at
    ``max_repeats`` times its source's size, and the excess is reshared until none is above. Each round is an
    aggregate over the sources that gives the driver two numbers. An empty table gives an empty result."""
    k = len(weights)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % k + 1).cast("int")))
    ranked = stage(ranked, "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    rate, cap = 0.0, F.col("source_size") * float(max_repeats)
    while True:
        free = ranked.agg(
            F.sum(F.when(F.col("weight") * rate > cap, cap).otherwise(0.0)).alias("held"),
            F.sum(F.when(F.col("weight") * rate > cap, 0.0).otherwise(F.col("weight"))).alias("w"),
        ).first()
        now = (total - (free["held"] or 0.0)) / free["w"] if free["w"] else rate
        if now <= rate:
            break
        rate = now
    return ranked.withColumn("target", F.least(F.col("weight") * rate, cap))


def schedule(sources: DataFrame) -> DataFrame:
    """(source, slot, rank) from (source, slots): ``slots`` slots of each source, ranked from 0, in a low-discrepancy
    order. Point j, frac(j * golden ratio), belongs to the source whose share of the cumulative slots holds it; a source
    leaves when it has its slots. Points are drawn until all sources have them: three times the slots, or more.

    Slots are ranked within chunks of consecutive ones, and chunks by their counts, so that a source's slots are never
    sorted in one task. A null source is one of its own; sources without slots have no rows."""
    spark = sources.sparkSession
    sources = sources.where("slots > 0").select("source", "slots")
    # Two numbers a source: one row each.
    up = F.sum("slots").over(Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
    shares = sources.select("source", "slots", up.alias("hi"))
    whole = shares.agg(F.max("hi")).first()[0] or 0
    shares = shares.select("source", "slots", ((F.col("hi") - F.col("slots")) / float(whole or 1)).alias("lo"), (F.col("hi") / float(whole or 1)).alias("hi"))
    # Points and shares meet in equal cells of [0, 1): an equi-join, whatever the number of sources.
    cells = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.floor(F.col("hi") * CELLS))))
    point, factor = F.col("id") * F.lit(GOLDEN), 3
    while True:
        points = spark.range(whole * factor).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
        placed = points.join(cells, (points["cell"] == cells["cell"]) & (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
        placed = placed.select("source", "slots", "slot", F.floor(F.col("slot") / CHUNK).alias("chunk"))
        counts = stage(placed.groupBy("source", "slots", "chunk").agg(F.count("*").alias("n")), "chunks")
        have = counts.groupBy("source", "slots").agg(F.sum("n").alias("n")).where("n >= slots").count()
        if have == sources.count():
            break
        factor *= 2
    before = counts.select(
        F.col("source").alias("s"), F.col("chunk").alias("c"),
        F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
    )
    within = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1
    ranked = placed.withColumn("within", within).join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c")))
    return ranked.withColumn("rank", F.col("base") + F.col("within")).where("rank < slots").select("source", "slot", "rank")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size",
        weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(id, size, source, source_size, target, taken, first_slot, n_slots): one row for each row of ``docs``, with the words
    that the mix takes of it, repeats counted, the first slot of the schedule that takes any (null: none does), and how many do.

    A source's documents, shuffled by the MD5 of their ids, form a line, cut into blocks of equal words. Its budget is its
    target, rounded to a word: whole passes over its blocks, then the first ones, the last of them cut where the budget
    ends, so that every source, however small, takes its target. ``schedule`` deals the slots; a source's k-th slot
    takes its k-th block, and a document its overlap with the blocks taken. Offsets on the line are summed in two steps,
    by runs of the shuffled order, so that a source with a third of all rows is spread over many tasks.

    Null size counts as 0; size 0 takes 0. Null is a source of its own. Rows that repeat an id are documents of their
    own (equal rows may swap places). An empty table gives an empty result. Only the three named columns are read."""
    return _taken(*_lines(docs, id_col, source_col, size_col, weights, max_repeats))


def block_order(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size",
                weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(slot, source, id, lo, hi): the mix as a sequence. Slot by slot, the words [lo, hi) of the documents of its block.
    Rows are as for ``mix``."""
    lined, targets = _lines(docs, id_col, source_col, size_col, weights, max_repeats)
    pieces = _pieces(lined).join(_slots(targets), F.col("source").eqNullSafe(F.col("us")) & (F.col("b") == F.col("ub")))
    lo, hi = F.greatest(F.col("start"), F.col("b") * F.col("block")), F.least(F.col("start") + F.col("size"), F.col("end"))
    return pieces.where(lo < hi).select("slot", "source", "id", (lo - F.col("start")).alias("lo"), (hi - F.col("start")).alias("hi"))


def _lines(docs: DataFrame, id_col: str, source_col: str, size_col: str, weights: tuple[float, ...], max_repeats: int) -> tuple[DataFrame, DataFrame]:
    """The documents with their start on their source's line and the source's block, and one row a source."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("h"),
    )
    rows = stage(rows.withColumn("run", F.conv(F.substring("h", 1, 3), 16, 10).cast("int") % RUNS), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    block = max(SMALLEST_BLOCK, min(LARGEST_BLOCK, total // BLOCKS))
    own = F.greatest(F.lit(1), F.least(F.lit(block), F.ceil(F.col("source_size") / OWN_BLOCKS))).cast("long")
    budget, line = F.round("target").cast("long"), F.greatest(F.col("source_size"), F.lit(1))
    targets = source_targets(sizes, weights, max_repeats).withColumns({"block": own, "rest": budget % line, "passes": ((budget - budget % line) / line).cast("long")})
    targets = targets.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")))
    targets = stage(targets.withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / F.col("block"))), "targets")
    runs = rows.groupBy("source", "run").agg(F.sum("size").alias("n"))
    base = runs.select(
        F.col("source").alias("s"), F.col("run").alias("r"),
        F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
    )
    order = Window.partitionBy("source", "run").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    lined = rows.withColumn("start", F.coalesce(F.sum("size").over(order), F.lit(0)))
    lined = lined.join(base, F.col("source").eqNullSafe(F.col("s")) & (F.col("run") == F.col("r"))).withColumn("start", F.col("start") + F.col("base"))
    lined = lined.join(targets.select(F.col("source").alias("ts"), "source_size", "target", "block"), F.col("source").eqNullSafe(F.col("ts")))
    return lined.select("id", "size", "source", "source_size", "target", "start", "block"), targets


def _slots(targets: DataFrame) -> DataFrame:
    """(us, ub, end, slot): the block that each slot takes of its source's line, and where the slot ends in it."""
    t = targets.select(F.col("source").alias("us"), "source_size", "block", "blocks", "passes", "rest")
    dealt = schedule(targets).join(t, F.col("source").eqNullSafe(F.col("us"))).withColumn("ub", F.col("rank") % F.col("blocks"))
    last = F.floor(F.col("rank") / F.col("blocks")) == F.col("passes")
    end = F.least((F.col("ub") + 1) * F.col("block"), F.when(last, F.col("rest")).otherwise(F.col("source_size")))
    return dealt.select("us", "ub", end.alias("end"), "slot")


def _pieces(lined: DataFrame) -> DataFrame:
    """Documents of a size, once for each block ``b`` that they lie in."""
    first, last = F.floor(F.col("start") / F.col("block")), F.floor((F.col("start") + F.col("size") - 1) / F.col("block"))
    return lined.where("size > 0").withColumn("b", F.explode(F.sequence(first, last)))


def _taken(lined: DataFrame, targets: DataFrame) -> DataFrame:
    used = _slots(targets).groupBy("us", "ub", "end").agg(F.count("*").alias("times"), F.min("slot").alias("slot"))
    pieces = _pieces(lined).join(used, F.col("source").eqNullSafe(F.col("us")) & (F.col("b") == F.col("ub")), "left")
    over = F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), F.col("end")) - F.greatest(F.col("start"), F.col("b") * F.col("block")))
    # Places on a source's line are all different where there is a size, so these are the rows themselves.
    whole = ["id", "size", "source", "source_size", "target"]
    some = pieces.groupBy(*whole, "start").agg(
        F.sum(F.coalesce(F.col("times") * over, F.lit(0))).cast("long").alias("taken"), F.min(F.when(over > 0, F.col("slot"))).alias("first_slot"),
        F.coalesce(F.sum(F.when(over > 0, F.col("times"))), F.lit(0)).alias("n_slots"),
    )
    none = [F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"), F.lit(0).cast("long").alias("n_slots")]
    return some.drop("start").unionAll(lined.where("size = 0").select(*whole, *none))
