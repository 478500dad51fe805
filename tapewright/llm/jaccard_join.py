"""N-gram Jaccard join by MinHash banding, with exact verification on the full n-gram sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm import textnum as tn
from tapewright.llm.graph import components, local_labels
from tapewright.llm.store import fresh, stage

GRAM, THRESHOLD, RECALL = 5, 0.8, 0.999
#: Members of a bucket that meet in one task: two blocks of this many.
BLOCK = 256
#: Rows up to which a table of buckets or classes is broadcast.
FEW = 1 << 17


def banding(threshold: float, recall: float, rows: int = 5) -> tuple[int, int]:
    """(bands, rows): the fewest bands of ``rows`` MinHashes that a pair at the threshold shares one of with
    probability ``recall``."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows))), rows


def _sets(words: tn.Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct gram hashes of each document, sorted within it, and each document's range."""
    g, lo, hi = words.grams(k)
    doc = np.repeat(np.arange(len(lo)), hi - lo)
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])]) if len(g) else np.zeros(0, bool)
    g, doc = g[new], doc[new]
    return g, np.searchsorted(doc, np.arange(len(lo))), np.searchsorted(doc, np.arange(len(lo)), "right")


def _signatures(k: int, bands: int, rows: int):
    a = np.random.default_rng(11).integers(1, 2**63, bands * rows, dtype=np.int64).astype(np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tn.slices(batch, "text"):
                g, lo, hi = _sets(tn.Words(part.column(1)), k)
                n = hi - lo
                full = np.flatnonzero(n)
                sums = [np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)]
                out = np.zeros((len(n), bands), np.uint64)
                if len(full):
                    for s, salt in zip(sums, (1, 2), strict=True):
                        s[full] = np.add.reduceat(tn.mix(g + np.uint64(salt)), lo[full])
                    for b in range(bands):
                        h = np.full(len(full), b, np.uint64)
                        for r in range(rows):
                            h = tn.mix(h + np.minimum.reduceat(g * a[b * rows + r], lo[full]))
                        out[full, b] = h
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands), pa.array(tn.signed(out.ravel())))
                yield pa.record_batch(
                    [part.column(0), pa.array(tn.signed(sums[0])), pa.array(tn.signed(sums[1])), pa.array(n.astype(np.int64)), lists],
                    names=["id", "k0", "k1", "n_grams", "bands"],
                )

    return run


def _gram_sets(k: int, names: list[str]):
    """The named columns of each row whose set is the one looked for, and the set; without ``k0`` among the columns,
    those and the set's hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tn.slices(batch, "text"):
                g, lo, hi = _sets(tn.Words(part.column(part.schema.get_field_index("text"))), k)
                sums = [np.zeros(len(lo), np.uint64), np.zeros(len(lo), np.uint64)]
                full = np.flatnonzero(hi - lo)
                if len(full):
                    for s, salt in zip(sums, (1, 2), strict=True):
                        s[full] = np.add.reduceat(tn.mix(g + np.uint64(salt)), lo[full])
                at = part.schema.get_field_index("k0")
                same = full if at < 0 else np.flatnonzero(tn.signed(sums[0]) == part.column(at).to_numpy(zero_copy_only=False))
                blob = pa.array([g[lo[d] : hi[d]].tobytes() for d in same], pa.large_binary())
                kept = part.take(pa.array(same))
                extra = [pa.array(tn.signed(s[same])) for s in sums] if at < 0 else []
                cols = [kept.column(kept.schema.get_field_index(c)) for c in names]
                yield pa.record_batch([*cols, *extra, blob.cast(pa.binary())], names=[*names, *["k0", "k1"][: len(extra)], "grams"])

    return run


def _candidates(bands: np.ndarray, band: int, side: np.ndarray, cross: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of a bucket of ``band`` that share no earlier band: those are another bucket's. Of both sides if
    ``cross``."""
    own = side[:, None] != side[None, :] if cross else np.ones((len(bands), len(bands)), bool)
    for b in range(band):
        own &= bands[:, b][:, None] != bands[:, b][None, :]
    return np.nonzero(np.triu(own, 1))


def _overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs of sets."""
    if len(i) <= 2 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    n = np.array([len(s) for s in sets])
    g, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    _, col, df = np.unique(g, return_inverse=True, return_counts=True)
    often = df > 1
    rank = np.cumsum(often) - 1
    use = often[col]
    row, col = row[use], rank[col[use]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    step = 4096
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, step):
        lo, hi = np.searchsorted(col, [at, at + step])
        x = np.zeros((len(sets), min(step, int(col[-1]) + 1 - at)), np.float32)
        x[row[lo:hi], col[lo:hi] - at] = 1
        both += x @ x.T
    return both[i, j].astype(np.int64)


def _verify(threshold: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        cross = key[1].as_py() != key[2].as_py()
        node = np.array(table.column("node").to_pylist(), object)
        node, first = np.unique(node, return_index=True)
        table = table.take(pa.array(first))
        mult, side = table.column("mult").to_numpy(), table.column("block").to_numpy()
        sets = [np.frombuffer(b.as_py(), np.uint64) for b in table.column("grams")]
        bands = np.stack([np.asarray(b, np.int64) for b in table.column("bands").to_pylist()])
        n = np.array([len(s) for s in sets])
        i, j = _candidates(bands, table.column("band")[0].as_py(), side, cross)
        close = np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j])
        i, j = i[close], j[close]
        both = _overlaps(sets, i, j)
        hit = both >= threshold * (n[i] + n[j] - both)
        i, j = i[hit], j[hit]
        links = np.zeros(len(node), np.int64)
        np.add.at(links, i, mult[j])
        np.add.at(links, j, mult[i])
        label = local_labels(len(node), i, j)
        some = np.flatnonzero(links)
        return pa.table({"node": pa.array(node[some], pa.string()), "peer": pa.array(node[label[some]], pa.string()), "links": links[some]})

    return run


def _few(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is small."""
    return F.broadcast(df) if df.count() <= FEW else df


def set_classes(docs: DataFrame, k: int = GRAM, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """From (id, text): the rows' set hashes (id, k0, k1, n_grams), and the distinct sets' (k0, k1, rep_id, class_id,
    n_links). See ``near_duplicates``."""
    bands, rows = banding(threshold, recall)
    sigs = stage(docs.mapInArrow(_signatures(k, bands, rows), "id long, k0 long, k1 long, n_grams long, bands array<long>"), "signatures")
    sets = sigs.where("n_grams > 0").groupBy("k0", "k1").agg(F.min("id").alias("rep_id"), F.count("*").alias("mult"), F.min("bands").alias("bands"))
    node = F.coalesce(F.col("rep_id").cast("string"), F.concat_ws("_", F.lit("n"), F.hex("k0"), F.hex("k1")))
    sets = stage(sets.withColumn("node", node), "sets")
    spread = sets.select("node", F.posexplode("bands").alias("band", "h"))
    full = spread.groupBy("h").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("h")
    member = spread.join(_few(stage(full, "buckets")), "h", "left_semi").join(sets.select("node", "bands"), "node")
    # A bucket whose members all share an earlier band has no pair of its own.
    ends = [f(F.get("bands", F.lit(b))).alias(f"{f.__name__}{b}") for b in range(bands) for f in (F.min, F.max)]
    inside = " OR ".join(f"(band > {b} AND min{b} = max{b})" for b in range(bands))
    own = member.groupBy("h", "band").agg(F.count("*").alias("n"), *ends).where(f"NOT ({inside})")
    own = _few(stage(own.select("h", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "own"))
    at = member.join(own, "h").groupBy("node").agg(F.collect_list(F.struct("h", "band", "blocks")).alias("at"))  # one a band
    at = at.join(sets, "node").select("node", "rep_id", "k0", "k1", "mult", "bands", "at")
    names = ["node", "mult", "bands", "at"]
    shape = "node string, mult long, bands array<long>, at array<struct<h:long,band:int,blocks:int>>"
    met = docs.where("id IS NOT NULL").join(at.where("rep_id IS NOT NULL").withColumnRenamed("rep_id", "id"), "id")
    met = met.mapInArrow(_gram_sets(k, names), f"{shape}, grams binary")
    none = docs.where("id IS NULL").select("text").mapInArrow(_gram_sets(k, []), "k0 long, k1 long, grams binary")
    none = none.join(at.where("rep_id IS NULL"), ["k0", "k1"]).groupBy("node").agg(*[F.first(c).alias(c) for c in (*names[1:], "grams")])
    met = met.unionByName(none).withColumn("at", F.explode("at")).select("node", "mult", "bands", "grams", "at.*")
    met = met.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"b0": F.least("block", "other"), "b1": F.greatest("block", "other")}).drop("blocks", "other")
    found = stage(met.groupBy("h", "b0", "b1").applyInArrow(_verify(threshold), "node string, peer string, links long"), "links")
    label = components(found, "node", "peer").join(sets.select("node", "rep_id"), "node")
    label = stage(label, "labels")
    least = _few(stage(label.groupBy("label").agg(F.min("rep_id").alias("class_id")), "names"))
    label = label.select("node", "label").join(least, "label").select("node", "class_id")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    out = sets.select("node", "k0", "k1", "rep_id", "mult").join(counts, "node", "left").join(label, "node", "left")
    n_links = F.coalesce("links", F.lit(0)) + F.col("mult") - 1
    return sigs, stage(out.select("k0", "k1", "rep_id", F.coalesce("class_id", "rep_id").alias("class_id"), n_links.alias("n_links")), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = GRAM, threshold: float = THRESHOLD,
                    recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(id, rep_id, class_id, n_links, n_grams): one row for each row of ``docs``.

    Two documents are linked when the Jaccard similarity of their sets of k-word grams is ``threshold`` or more.
    ``rep_id`` is the smallest id with the same set, ``n_links`` the number of other documents linked directly
    (copies included), ``class_id`` the smallest id reachable by links.

    Sets that are equal are one candidate from the start, whatever their number. Sets are shuffled on the hashes of
    their MinHash bands and verified, whole, against the others of the bucket; a pair that shares several bands is
    verified in the first one's bucket only, and buckets that lie within another one are not looked at. A large
    bucket's members meet in tasks of two blocks of about ``block``, so that no bucket is gathered and no list of pairs is
    written, only each member's number of links and its peer in a spanning forest; only verified links are connected.
    Pairs at the threshold are found with probability ``recall``, closer ones with more.

    Null and empty texts have no grams and link with nothing (not even each other): their class is their own id.
    Texts of 1 to k-1 words have one gram, of all their words. Rows of null id are compared and linked as others;
    their class is the smallest id of the class, null if there is none. Rows that repeat an id must repeat the text;
    they count as copies. An empty table gives an empty result. Only the two named columns are read."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sigs, classes = set_classes(docs, k, threshold, recall, block)
    linked = sigs.where("n_grams > 0").join(classes, ["k0", "k1"]).select("id", "rep_id", "class_id", "n_links", "n_grams")
    alone = sigs.where("n_grams = 0").select("id", F.col("id").alias("rep_id"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "n_grams")
    return linked.unionAll(alone)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = GRAM, **params) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its class of near duplicates; rows of null id stay only
    where their class has no id. Rows that repeat an id stay together; texts without words stay."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sigs, classes = set_classes(rows, k, **params)
    gone = sigs.where("n_grams > 0 AND id IS NOT NULL").join(classes, ["k0", "k1"]).where("id <> class_id")
    (key,) = fresh(docs, "gone")
    gone = gone.select(F.col("id").alias(key)).distinct()
    kept = docs.where(F.col(id_col).isNotNull()).join(gone, F.col(id_col).cast("long") == F.col(key), "left_anti")
    void = docs.where(F.col(id_col).isNull()).select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))
    void = void.mapInArrow(_keyed(k), void.drop("text").schema.add("k0", "long").add("k1", "long"))
    void = void.join(classes.where("class_id IS NOT NULL").select("k0", "k1"), ["k0", "k1"], "left_anti")
    return kept.unionAll(void.select(*[F.col("row")[c].alias(c) for c in docs.columns]))


def _keyed(k: int):
    """Rows (row, text) as (row, k0, k1): the set's hashes; 0 and 0 for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tn.slices(batch, "text"):
                g, lo, hi = _sets(tn.Words(part.column(1)), k)
                full = np.flatnonzero(hi - lo)
                cols = [part.column(0)]
                for salt in (1, 2):
                    sums = np.zeros(len(lo), np.uint64)
                    if len(full):
                        sums[full] = np.add.reduceat(tn.mix(g + np.uint64(salt)), lo[full])
                    cols.append(pa.array(tn.signed(sums)))
                yield pa.record_batch(cols, names=["row", "k0", "k1"])

    return run
