"""Exact dedup by progressive refinement: length, then prefix hash, then full hash (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm.store import fresh, stage

#: The characters that do not count: space and \x09 to \x0D.
BLANKS = " \t\n\x0b\x0c\r"
#: Lengths, or (length, prefix hash) pairs, that are broadcast; of more, the join is a shuffled one.
FEW = 1 << 18


def normalised(text: str | Column) -> Column:
    """The text without blanks; null counts as empty."""
    out = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, with_text: bool = False) -> DataFrame:
    """Every row of ``docs`` (its text only if asked for), plus ``keep_id``, ``group_size`` and ``kept``.

    Rows are equal when their normalised texts are. Groups are refined: normalised lengths are counted; the first
    ``prefix`` characters are hashed only of rows whose length occurs twice, and the SHA-256 of the whole text is taken
    only of those whose (length, prefix hash) occurs twice. Of equal rows, the one with the most code points in the
    original text, then the smallest id, stays.

    The text is read and normalised twice: for lengths and first characters, which are written, and for full hashes.
    Lengths and prefixes are counted in partial aggregates, so a hot one is shuffled as a few counts, and no group is
    ever gathered; joins back to the rows are on keys alone, whose hot values the skew-join rule splits. Null text
    counts as empty; empty texts form one group. A null id sorts after all others. Rows that repeat an id are all
    counted, and all are kept if the id is. An empty table gives an empty result. Other columns pass through, but for
    clashes with the three new names, which are replaced."""
    n, length, head, pre, full, size, best, norm, key = fresh(docs, "n", "len", "head", "pre", "full", "size", "best", "norm", "key")
    rest = [c for c in docs.columns if (with_text or c != text_col) and c.lower() not in ("keep_id", "group_size", "kept")]
    shape = lambda rows: rows.withColumns({length: F.length(norm), head: F.substring(norm, 1, prefix)})
    keys = stage(shape(docs.select(normalised(text_col).alias(norm))).select(length, head), "lengths")
    twice = stage(keys.groupBy(length).agg(F.count("*").alias(size)).where(F.col(size) > 1).select(length), "repeated")
    twice = F.broadcast(twice) if twice.count() <= FEW else twice
    pairs = keys.groupBy(length, head).agg(F.count("*").alias(size)).join(twice, length, "left_semi")
    pairs = pairs.groupBy(length, F.xxhash64(head).alias(pre)).agg(F.sum(size).alias(size)).where(F.col(size) > 1)
    pairs = stage(pairs.select(length, pre, F.lit(True).alias(best)), "prefixes")

    rows = shape(docs.select(*rest, F.col(id_col).alias(key), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias(n), normalised(text_col).alias(norm)))
    rows = rows.join(twice.withColumn(size, F.lit(True)), length, "left").withColumn(pre, F.when(F.col(size), F.xxhash64(head)))
    if pairs.count() <= FEW:
        rows = rows.join(F.broadcast(pairs), [length, pre], "left").withColumn(full, F.when(F.col(best), F.sha2(norm, 256)))
    else:  # texts are not shuffled: their hashes are
        rows = rows.withColumn(full, F.when(F.col(size), F.sha2(norm, 256))).drop(norm, head)
        rows = rows.join(pairs, [length, pre], "left").withColumn(full, F.when(F.col(best), F.col(full)))
    rows = rows.select(*rest, key, n, full)
    if with_text:  # rows without a partner are not written
        some, alone = stage(rows.where(F.col(full).isNotNull()), "hashed"), rows.where(F.col(full).isNull())
    else:
        rows = stage(rows, "hashed")
        some, alone = rows.where(F.col(full).isNotNull()), rows.where(F.col(full).isNull())
    order = F.struct((-F.col(n)).alias("n"), F.col(key).isNull().alias("void"), F.col(key).alias("id"))
    groups = some.groupBy(full).agg(F.count("*").alias(size), F.min(order).alias(best))
    # Written, so that the join below is of two plain shuffles, whose hot keys the skew-join rule can split.
    groups = stage(groups.select(full, size, F.col(best)["id"].alias(best)), "groups")
    out = some.join(groups, full).select(*rest, F.col(best).alias("keep_id"), F.col(size).alias("group_size"), F.col(best).eqNullSafe(F.col(key)).alias("kept"))
    return out.unionAll(alone.select(*rest, F.col(key).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64) -> DataFrame:
    """The rows of ``docs`` that stay by ``exact_groups``, all columns; rows that repeat an id and a text stay once."""
    names = [c for c in docs.columns if c.lower() in ("keep_id", "group_size", "kept")]
    (own,) = fresh(docs, "own")
    held = docs.withColumn(own, F.struct(*names)).drop(*names) if names else docs
    kept = exact_groups(held, id_col, text_col, prefix, with_text=True).where("kept")
    once = kept.where("group_size > 1").dropDuplicates([id_col, text_col])
    kept = kept.where("group_size = 1").unionAll(once)
    return kept.select(*[F.col(own)[c].alias(c) if c in names else F.col(c) for c in docs.columns])
