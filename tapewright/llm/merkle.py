"""Merkle manifest of a table: a hash tree a group, and one over the groups.

Leaves get their places by ranks in bitmaps, not by a sort: every task ORs its rows into bitmaps of 64 ids, those of a
group are merged, empty ones are not stored, and a directory of running popcounts in steps of 4096 entries tells how
many rows lie before each. A row's place is the directory's count plus a popcount within its bitmap. Then blocks of
3 ** DEPTH places are arrays whose slots the nodes are put in by place; a block is reduced by DEPTH levels at once. Proofs
come down the same way: a block's rows get the siblings within it, and those above from the block's own row."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm.store import stage

FAN, DEPTH = 3, 5
BLOCK = FAN**DEPTH
#: Ids a bitmap holds, as a power of 2; entries that one step of the directory sums up, as a power of 2.
BITS, STEP = 6, 12
#: The place of null ids: before all others.
LEAST = -(2**63)
#: Cells by which rows that repeat an id are ranked: hexadecimal digits of their leaves.
DIGITS = 3
LEAVES = "tree string, slot long, size long, id long, leaf string, claimed string"


def leaf_hash(*fields: str | Column) -> Column:
    """Lowercase hex SHA-256 of the fields: each ``-`` if null, else UTF-8 byte count, ``:``, value (integers decimal)."""
    text = [(F.col(f) if isinstance(f, str) else f).cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def _offsets(counts: DataFrame, lo: int, hi: int) -> DataFrame:
    """(tree, key, base) from (tree, key, n): rows of the tree before the key. Keys lie in [lo, hi]. Running sums are over
    2 ** STEP neighbouring keys at most, then over the sums of such, and so on."""
    before = lambda w: F.coalesce(F.sum("n").over(w.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if hi - lo < 1 << STEP:
        return counts.select("tree", "key", before(Window.partitionBy("tree")).alias("base"))
    up = F.shiftright("key", STEP)
    above = _offsets(counts.groupBy("tree", up.alias("key")).agg(F.sum("n").alias("n")), lo >> STEP, hi >> STEP)
    within = counts.select("tree", "key", up.alias("up"), before(Window.partitionBy("tree", up)).alias("within"))
    above = above.select("tree", F.col("key").alias("up"), F.col("base").alias("above"))
    return within.join(above, ["tree", "up"]).select("tree", "key", (F.col("above") + F.col("within")).alias("base"))


def _directory(rows: DataFrame) -> DataFrame:
    """(tree, key, bits, base, size, more): a bitmap of 64 ids, the tree's rows before it and in all, and how many more
    rows than one its repeated ids have, by bit."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("id").bitwiseAND(63).cast("int"))
    keyed = rows.select("tree", "id", F.shiftright("id", BITS).alias("key"))
    words = stage(keyed.groupBy("tree", "key").agg(F.bit_or(bit).alias("bits"), F.count("*").alias("n")), "bitmaps")
    lo, hi = words.agg(F.min("key"), F.max("key")).first()
    sizes = words.groupBy("tree").agg(F.sum("n").alias("size"))
    out = words.join(_offsets(words.select("tree", "key", "n"), lo or 0, hi or 0), ["tree", "key"]).join(sizes, "tree")
    full = words.where(F.col("n") > F.bit_count("bits")).select("tree", "key")
    if full.isEmpty():
        return out.withColumn("more", F.lit(None).cast("array<struct<bit:int,n:bigint>>"))
    again = keyed.join(full, ["tree", "key"]).groupBy("tree", "key", "id").agg(F.count("*").alias("n")).where("n > 1")
    one = F.struct(F.col("id").bitwiseAND(63).cast("int").alias("bit"), (F.col("n") - 1).alias("n"))
    return out.join(again.groupBy("tree", "key").agg(F.collect_list(one).alias("more")), ["tree", "key"], "left")


def places(rows: DataFrame) -> DataFrame:
    """(tree, slot, size, id, leaf, claimed) from (tree, id, leaf, claimed): each row's place in its tree, by id, and the
    tree's rows. Rows that repeat an id are placed by leaf, equal ones in any order; null ids come first.

    Only bitmaps and their counts are ordered, in bounded steps, so that a tree with a third of all rows is many tasks'.
    """
    rows = rows.withColumn("id", F.coalesce("id", F.lit(LEAST)))
    d = stage(_directory(rows), "directory")
    bit = F.col("id").bitwiseAND(63).cast("int")
    under = F.col("bits").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), bit)))
    found = rows.withColumn("key", F.shiftright("id", BITS)).join(d, ["tree", "key"])
    more = F.aggregate(F.filter("more", lambda m: m["bit"] < bit), F.lit(0).cast("long"), lambda s, m: s + m["n"])
    slot = F.col("base") + F.bit_count(under) + F.coalesce(more, F.lit(0))
    alone = F.coalesce(~F.exists("more", lambda m: m["bit"] == bit), F.lit(True))
    found = found.select("tree", slot.alias("slot"), "size", "id", "leaf", "claimed", alone.alias("alone"))
    out = found.where("alone").drop("alone")
    if not d.where("more IS NOT NULL").isEmpty():
        of = ["tree", "slot", "size", "id"]
        kinds = stage(found.where("NOT alone").groupBy(*of, "leaf", "claimed").agg(F.count("*").alias("n")), "repeats").withColumn("cell", F.substring("leaf", 1, DIGITS))
        upto = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cells = kinds.groupBy(*of, "cell").agg(F.sum("n").alias("n"))
        cells = cells.select(*of, "cell", upto(Window.partitionBy(*of).orderBy("cell")).alias("above"))
        kinds = kinds.withColumn("within", upto(Window.partitionBy(*of, "cell").orderBy("leaf", "claimed"))).join(cells, [*of, "cell"])
        first = F.col("slot") + F.col("above") + F.col("within")
        own = kinds.select("tree", F.explode(F.sequence(first, first + F.col("n") - 1)).alias("slot"), "size", "id", "leaf", "claimed")
        out = out.unionByName(own)
    return out.select("tree", "slot", "size", F.when(F.col("id") != LEAST, F.col("id")).alias("id"), "leaf", "claimed")


def _depth(size: int) -> int:
    """Levels that one round reduces a tree of so many nodes by."""
    depth, reach = 0, 1
    while reach < size and depth < DEPTH:
        depth, reach = depth + 1, reach * FAN
    return depth


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(slots: list[int], values: list[str], size: int) -> list[list[str]]:
    """The block's array, each node in the slot of its place, and what it is reduced to, level by level."""
    array: list[str] = [""] * len(slots)
    for slot, value in zip(slots, values, strict=True):
        array[slot % BLOCK] = value
    levels = [array]
    for _ in range(_depth(size)):
        low = levels[-1]
        levels.append([_h("".join(low[i : i + FAN])) for i in range(0, len(low), FAN)])
    return levels


def _up(key: tuple, nodes: pa.Table) -> pa.Table:
    size = nodes["size"][0].as_py()
    top = _levels(nodes["slot"].to_pylist(), nodes["hash"].to_pylist(), size)[-1][0]
    return pa.table({"tree": [key[0].as_py()], "slot": pa.array([key[1].as_py()], pa.int64()), "size": pa.array([-(-size // BLOCK)], pa.int64()), "hash": [top]})


def _siblings(levels: list[list[str]], at: int) -> list[str]:
    """For each level, the run's others: those on the left, ``|``, those on the right."""
    out = []
    for low in levels[:-1]:
        run = at - at % FAN
        out.append("".join(low[run:at]) + "|" + "".join(low[at + 1 : run + FAN]))
        at //= FAN
    return out


def fold(leaf: str, path: str) -> str:
    """The root that a leaf and its path (siblings, level by level) give."""
    for step in path.split(",") if path else []:
        left, right = step.split("|")
        leaf = _h(left + leaf + right)
    return leaf


def _paths(nodes: pa.Table, above: pa.Table) -> tuple[list[str], str]:
    slots, up = nodes["slot"].to_pylist(), above["up_path"][0].as_py()
    levels = _levels(slots, nodes["hash"].to_pylist(), nodes["size"][0].as_py())
    return [",".join([*_siblings(levels, s % BLOCK), *([up] if up else [])]) for s in slots], above["up_root"][0].as_py()


def _down(key: tuple, nodes: pa.Table, above: pa.Table) -> pa.Table:
    paths, subroot = _paths(nodes, above)
    return pa.table({"tree": nodes["tree"], "slot": nodes["slot"], "path": pa.array(paths, pa.string()), "subroot": pa.array([subroot] * len(paths), pa.string())})


def _prove(key: tuple, nodes: pa.Table, above: pa.Table) -> pa.Table:
    paths, subroot = _paths(nodes.rename_columns(["hash" if c == "leaf" else c for c in nodes.column_names]), above)
    folded = [fold(leaf, p) for leaf, p in zip(nodes["claimed"].to_pylist(), paths, strict=True)]
    proof = [_h(p.replace(",", "").replace("|", "")) for p in paths]
    out = {c: nodes[c] for c in ("tree", "slot", "size", "id", "leaf")}
    return pa.table(out | {"subroot": pa.array([subroot] * len(paths), pa.string()), "path": pa.array(paths, pa.string()), "proof_sha256": proof, "folded_root": folded})


NODE = "tree string, slot long, size long, hash string"
PATH = "tree string, slot long, path string, subroot string"
PROOF = "tree string, slot long, size long, id long, leaf string, subroot string, path string, proof_sha256 string, folded_root string"


def _blocks(df: DataFrame):
    return df.groupBy("tree", F.floor(F.col("slot") / BLOCK).alias("block"))


def _reduce(nodes: DataFrame, largest: int) -> list[DataFrame]:
    """``nodes`` (tree, slot, size, hash) and what is left of them after each round; a tree of one node is left as it is."""
    rounds = [nodes]
    while largest > 1:
        rounds.append(stage(_blocks(rounds[-1].where("size > 1").select("tree", "slot", "size", "hash")).applyInArrow(_up, NODE), "nodes"))
        largest = -(-largest // BLOCK)
    return rounds


def _unfold(rounds: list[DataFrame], tops: DataFrame, last, schema: str) -> DataFrame:
    """What ``last`` makes of the first round's blocks and the paths above them; ``tops``: (tree, path, subroot)."""
    above = None
    for n in range(len(rounds) - 1, -1, -1):
        own = rounds[n].where("size = 1").select("tree", F.lit(0).cast("long").alias("slot")).join(tops, "tree").select("tree", "slot", "path", "subroot")
        above = own if above is None else above.unionByName(own)
        upper = above.select(F.col("tree").alias("up_tree"), F.col("slot").alias("up"), F.col("path").alias("up_path"), F.col("subroot").alias("up_root"))
        made = _blocks(rounds[n]).cogroup(upper.groupBy("up_tree", "up")).applyInArrow(_down if n else last, PATH if n else schema)
        above = stage(made, "paths") if n else made
    return above


def _in_order(trees: DataFrame) -> DataFrame:
    """(tree, slot, size, hash) with the trees' own places, by name, in one grove: ranks within ranges, plus the rows of
    the ranges before."""
    trees = stage(trees.repartitionByRange("tree").withColumn("part", F.spark_partition_id()), "trees")
    parts = trees.groupBy("part").agg(F.count("*").alias("n"))
    # One row a range of names.
    base = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("tree")) - 1
    return trees.withColumn("rank", rank).join(base, "part").select(F.col("tree").alias("name"), (F.col("base") + F.col("rank")).cast("long").alias("slot"), "hash")


def prove(rows: DataFrame, id_col: str = "id", group_col: str = "source", leaf_col: str = "leaf", claimed_col: str | None = None, with_path: bool = False) -> DataFrame:
    """(id, group, slot, size, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of ``rows``, with
    its leaf hash: its place among its group's leaves, which ascend by id; the roots of its group and of all; the SHA-256
    of its siblings up to the root; the root recomputed from ``claimed_col`` (default: the leaf) and those siblings; and
    whether that is the root. ``with_path`` adds the siblings themselves: for each level those on the left, ``|``, those
    on the right, joined by commas, as ``fold`` reads them.

    While several nodes remain, every 3 consecutive ones, the last run being as many as are left, become the hash of
    their texts; a lone leaf is its own root. Groups are ordered bytewise, null, a group of its own, first. Null ids
    come before all others; rows that repeat an id in a group are ordered by leaf, and equal rows are leaves of their own. An
    empty table gives an empty result. Only the named columns are read."""
    claimed = F.col(claimed_col or leaf_col)
    tree = F.coalesce(F.concat(F.lit("v"), F.col(group_col)), F.lit("n"))
    flat = rows.select(tree.alias("tree"), F.col(id_col).cast("long").alias("id"), F.col(leaf_col).alias("leaf"), claimed.alias("claimed"))
    leaves = stage(places(stage(flat, "leaves")), "places")
    rounds = _reduce(leaves.withColumnRenamed("leaf", "hash"), leaves.agg(F.max("size")).first()[0] or 0)
    roots = rounds[0].where("size = 1").select("tree", "hash")
    for r in rounds[1:]:
        roots = roots.unionByName(r.where("size = 1").select("tree", "hash"))
    grove = stage(_in_order(roots), "roots")
    n = grove.count()
    grove = grove.withColumns({"tree": F.lit("all"), "size": F.lit(n).cast("long")})
    over = _reduce(grove, n)
    root = over[-1].where("size = 1").select("hash").first()
    top = grove.sparkSession.range(1 if n else 0).select(F.lit("all").alias("tree"), F.lit("").alias("path"), F.lit("").alias("subroot"))
    paths = _unfold(over, top, _down, PATH)
    tops = stage(grove.drop("tree").join(paths.select("slot", "path"), "slot").select(F.col("name").alias("tree"), "path", F.col("hash").alias("subroot")), "tops")
    proofs = _unfold([leaves, *rounds[1:]], tops, _prove, PROOF).withColumn("root", F.lit(root["hash"] if root else None).cast("string"))
    group = F.when(F.col("tree").startswith("v"), F.substring("tree", 2, 2**31 - 1)).alias("group")
    told = (F.col("folded_root") == F.col("root")).alias("verified")
    return proofs.select("id", group, "slot", "size", "leaf", "subroot", "root", "proof_sha256", "folded_root", told, *(["path"] if with_path else []))
