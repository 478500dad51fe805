"""Embedding near-dedup by product quantisation: coarse inverted lists with residual subspace codes, asymmetric
table-lookup distances over sufficient probes, exact cosine rerank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.graph import components, local_labels
from tapewright.llm.store import stage

THRESHOLD = 0.95
#: The bound of the sample that the index is fitted on; every vector is indexed.
SAMPLE = 16_384
SUBSPACES, CODES, ROUNDS = 8, 64, 12
#: Listed vectors, and probing vectors, of one task.
BLOCK = 2048
EPS = 1e-6


def _means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means; empty means keep their place."""
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        at = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


@dataclass
class Index:
    """Coarse centres and, for each subspace, the code book of the residuals."""

    centres: np.ndarray
    books: list[np.ndarray]
    cuts: list[int]

    @property
    def dim(self) -> int:
        return self.centres.shape[1]

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the distance between each residual and its reconstruction."""
        codes = np.empty((len(residual), len(self.books)), np.uint8)
        left = np.zeros(len(residual))
        for s, book in enumerate(self.books):
            part = residual[:, self.cuts[s] : self.cuts[s + 1]]
            d = (book * book).sum(1) - 2 * part @ book.T
            codes[:, s] = d.argmin(1)
            left += ((part - book[codes[:, s]]) ** 2).sum(1)
        return codes, np.sqrt(left)

    def distances(self, residual: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances, from one look-up table a subspace: probing residuals against listed codes."""
        out = np.zeros((len(residual), len(codes)), np.float32)
        for s, book in enumerate(self.books):
            part = residual[:, self.cuts[s] : self.cuts[s + 1]]
            table = ((part * part).sum(1)[:, None] + (book * book).sum(1) - 2 * part @ book.T).astype(np.float32)
            out += table[:, codes[:, s]]
        return np.sqrt(np.maximum(out, 0))

    def probes(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Home list of each vector, and which lists can hold a vector within ``radius`` of it: those whose bisector
        with the home list's centre is no farther than that."""
        d = (x * x).sum(1)[:, None] + (self.centres**2).sum(1) - 2 * x @ self.centres.T
        home = d.argmin(1)
        return home, d - d[np.arange(len(x)), home][:, None] <= 2 * self._gaps()[home] * (radius + EPS) + EPS

    def _gaps(self) -> np.ndarray:
        c = self.centres
        return np.sqrt(np.maximum((c * c).sum(1)[:, None] + (c * c).sum(1) - 2 * c @ c.T, 1e-18))


def fit(x: np.ndarray, lists: int) -> Index:
    """From unit vectors of a sample."""
    centres = _means(x, lists, 3)
    home = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
    residual = x - centres[home]
    parts = min(SUBSPACES, x.shape[1])
    cuts = [x.shape[1] * s // parts for s in range(parts + 1)]
    return Index(centres, [_means(residual[:, a:b], CODES, 4) for a, b in zip(cuts, cuts[1:], strict=False)], cuts)


def _units(batch: pa.RecordBatch, at: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of ``dim`` components as unit rows of doubles, and their places in the batch."""
    col = batch.column(at)
    n = np.diff(col.offsets.to_numpy())
    use = np.flatnonzero(n == dim)
    flat = col.take(pa.array(use)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(use), dim)
    x = x / np.abs(x).max(1, initial=0)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None], use


def _assign(index_of, radius: float):
    """Rows (node, mult, cell, home): each vector in its home list, and a probe for each later list that it reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of.value
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                x, use = _units(batch, 2, index.dim)
                home, near = index.probes(x, radius)
                near &= np.arange(near.shape[1]) > home[:, None]
                near[np.arange(len(x)), home] = True
                row, cell = np.nonzero(near)
                odd = np.setdiff1d(np.arange(batch.num_rows), use)
                size = np.diff(batch.column(2).offsets.to_numpy())
                rows = np.concatenate([use[row], odd])
                cells = np.concatenate([cell, -size[odd].astype(np.int64)])
                homes = np.concatenate([cell == home[row], np.ones(len(odd), bool)])
                part = batch.take(pa.array(rows))
                yield pa.record_batch([part.column(0), part.column(1), part.column(2), pa.array(cells.astype(np.int64)), pa.array(homes)], names=["node", "mult", "v", "cell", "home"])

    return run


def _compare(index_of, threshold: float, radius: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        index, cell = index_of.value, key[0].as_py()
        same = key[1].as_py() == key[2].as_py() and key[3].as_py()
        table = table.combine_chunks()
        batch = table.to_batches()[0]
        dim = index.dim if cell >= 0 else -cell
        x, _ = _units(batch, batch.schema.get_field_index("v"), dim)
        nodes, mult = np.array(batch.column(batch.schema.get_field_index("node")).to_pylist(), object), batch.column(batch.schema.get_field_index("mult")).to_numpy()
        listed = batch.column(batch.schema.get_field_index("listed")).to_numpy(zero_copy_only=False)
        data, probe = np.flatnonzero(listed), np.flatnonzero(~listed)
        if same:
            probe = data
        if cell >= 0:
            codes, error = index.encode(x[data] - index.centres[cell])
        i, j = [], []
        for at in range(0, len(probe), 256):
            p = probe[at : at + 256]
            near = index.distances(x[p] - index.centres[cell], codes) <= radius + error + 1e-4 if cell >= 0 else np.ones((len(p), len(data)), bool)
            if same:
                near &= p[:, None] < data[None, :]
            if near.mean() > 0.02:
                a, b = np.nonzero(near & (x[p] @ x[data].T >= threshold))
                i.append(p[a])
                j.append(data[b])
                continue
            a, b = np.nonzero(near)
            a, b = p[a], data[b]
            ok = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
            i.append(a[ok])
            j.append(b[ok])
        i, j = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (i, j))
        links = np.zeros(len(nodes), np.int64)
        np.add.at(links, i, mult[j])
        np.add.at(links, j, mult[i])
        some = np.flatnonzero(links)
        label = local_labels(len(nodes), i, j)
        return pa.table({"node": pa.array(nodes[some], pa.string()), "peer": pa.array(nodes[label[some]], pa.string()), "links": links[some]})

    return run


def valid_vector(col: str):
    """True for vectors that can be compared: no null or non-finite component, not all zero, not empty."""
    fine = F.forall(col, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return F.coalesce(F.col(col).isNotNull() & fine & F.exists(col, lambda v: F.coalesce(v != 0, F.lit(False))), F.lit(False))


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD,
                 sample: int = SAMPLE, lists: int | None = None, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept): one row for each row of ``rows``.

    Vectors are linked when their cosine, in doubles, is ``threshold`` or more. ``n_links`` counts the other vectors
    linked directly, ``component_id`` is the smallest id reachable by links, ``kept`` says that it is the row's own.

    Equal vectors are one entry with a multiplicity. The index (coarse centres, residual code books) is fitted on at
    most ``sample`` vectors, those first by their hash; every vector is listed. A vector probes all
    lists that can hold one within the threshold's radius (by the bisector bound, so none is lost), each pair of
    lists in one direction. In a list, table-look-up distances less the listed vector's own quantisation error bound
    the true ones, so that the filter loses nothing; what passes is compared exactly. Lists are cut into blocks of
    about ``block`` listed and as many probing vectors, a task for each pair of blocks; tasks return link counts and a
    spanning forest, never pairs.

    Null, empty and zero vectors and those with a null or non-finite component link with nothing. Vectors of another
    length than the index's are compared exactly, in blocks, with those of their length. A null id never names a
    component (null if all ids are). Rows that repeat an id count as rows. An empty table gives an empty result.
    Only the two named columns are read. Lists grow as the root of the number of vectors, comparisons as its power 1.5."""
    spark = rows.sparkSession
    # x + 0 makes one zero of the two.
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + 0.0).alias("v"))
    # Each distinct vector has a key of its own, 128 bits of hash, whatever its ids.
    good = rows.where(valid_vector("v")).withColumn("node", F.concat_ws("_", F.hex(F.xxhash64("v")), F.hex(F.xxhash64(F.lit(1), "v"))))
    entries = stage(good.groupBy("node", "v").agg(F.min("id").alias("rep"), F.count("*").alias("mult")), "entries")
    n = entries.count()
    dims = entries.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    labels = spark.createDataFrame([], "node string, component_id long, links long")
    if n > 1:
        first = entries.where(F.size("v") == dims["d"]).orderBy("node").limit(max(1024, min(sample, (1 << 23) // dims["d"]))).select("v").toPandas()["v"]
        x = np.stack(first.to_numpy()).astype(np.float64)
        x /= np.abs(x).max(1)[:, None]
        x /= np.sqrt((x * x).sum(1))[:, None]
        index_of = spark.sparkContext.broadcast(fit(x, lists or max(2, int(np.sqrt(n) / 14))))
        radius = float(np.sqrt(2 - 2 * threshold))
        placed = entries.select("node", "mult", "v").mapInArrow(_assign(index_of, radius), "node string, mult long, v array<double>, cell long, home boolean")
        placed = stage(placed, "lists")
        # One row a list.
        sizes = placed.groupBy("cell").agg(
            F.ceil(F.count_if("home") / block).cast("int").alias("blocks"), F.ceil(F.count_if(~F.col("home")) / block).cast("int").alias("others")
        )
        placed = placed.join(sizes, "cell").withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("home"), F.col("blocks")).otherwise(F.col("others"))).cast("int"))
        upto = lambda c: F.when(c > 0, F.sequence(F.lit(0), c - 1)).otherwise(F.array().cast("array<int>"))
        listed, probing = placed.where("home"), placed.where("NOT home")
        shape = ["cell", "b0", "b1", "within", "node", "mult", "v", "listed"]
        # Listed against listed: block pairs b0 <= b1, the second one probing.
        among = listed.withColumn("o", F.explode(upto(F.col("blocks")))).withColumn("b0", F.least("own", "o")).withColumn("b1", F.greatest("own", "o"))
        among = among.withColumn("within", F.lit(True)).withColumn("listed", F.col("own") == F.col("b0")).select(*shape)
        to = listed.withColumn("b1", F.explode(upto(F.col("others")))).withColumn("b0", F.col("own")).withColumn("within", F.lit(False)).withColumn("listed", F.lit(True))
        by = probing.withColumn("b0", F.explode(upto(F.col("blocks")))).withColumn("b1", F.col("own")).withColumn("within", F.lit(False)).withColumn("listed", F.lit(False))
        met = among.unionAll(to.select(*shape)).unionAll(by.select(*shape))
        found = met.groupBy("cell", "b0", "b1", "within").applyInArrow(_compare(index_of, threshold, radius), "node string, peer string, links long")
        found = stage(found, "links")
        names = stage(components(found, "node", "peer").join(entries.select("node", "rep"), "node"), "names")
        least = stage(names.groupBy("label").agg(F.min("rep").alias("component_id")), "least")
        names = names.join(least, "label").select("node", "component_id")
        labels = found.groupBy("node").agg(F.sum("links").alias("links")).join(names, "node").select("node", "component_id", "links")
    classes = entries.join(labels, "node", "left").select("node", F.when(F.col("links").isNull(), F.col("rep")).otherwise(F.col("component_id")).alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    out = good.select("id", "node").join(stage(classes, "classes"), "node").select("id", "n_links", "component_id")
    out = out.unionAll(rows.where(~valid_vector("v")).select("id", F.lit(0).cast("long"), F.col("id")))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
