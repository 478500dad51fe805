"""Substring dedup: Rabin-Karp hashes of every fixed-length token window, counted in Spark; repeated windows merge
into maximal removal intervals.

Every window of a document is hashed. Consecutive windows whose smallest word-gram hash is the same form a run, and
equal windows lie in runs of the same minimum. So runs are counted first (a run of ~20 windows is one row), and only
runs that share their minimum with a different run of another document are unrolled into windows, which are counted
by (minimum, window hash). A window in a run that is equal to a whole run elsewhere needs no unrolling. No window is
left out: one whose minimum occurs in a single document cannot occur in another."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm import textnum as tn
from tapewright.llm.store import stage

WINDOW, GRAM = 50, 8
#: Rows up to which a table of repeated runs or windows is broadcast; a larger one is joined by a shuffle.
FEW = 1 << 18


def _windows(words: tn.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For a slice: prefix sums over words, the first word of each window, its document, its minimum."""
    hashes = words.hashes()
    pre = tn.word_prefix(hashes)
    n = np.maximum(words.count - window + 1, 0)
    at = tn.expand(words.lo, n)
    doc = np.repeat(np.arange(len(n)), n)
    if not len(at):
        return pre, at, doc, np.zeros(0, np.uint64)
    low = tn.sliding_min(tn.word_grams(hashes, gram), window - gram + 1)
    return pre, at, doc, low[at]


def _runs(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tn.slices(batch, "text"):
                ids = part.column(0).to_numpy(zero_copy_only=False)
                words = tn.Words(part.column(1))
                pre, at, doc, low = _windows(words, window, gram)
                if not len(at):
                    continue
                new = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])]))
                n = np.diff(np.append(new, len(at)))
                start = at[new]
                whole = tn.word_spans(pre, start, start + n + window - 1)
                yield pa.record_batch(
                    [pa.array(tn.signed(low[new])), pa.array(tn.signed(whole)), pa.array(ids[doc[new]].astype(np.int64)),
                     pa.array((start - words.lo[doc[new]]).astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["m", "whole", "id", "start", "n"],
                )

    return run


def _unroll(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tn.slices(batch, "text"):
                words = tn.Words(part.column(1))
                pre = tn.word_prefix(words.hashes())
                runs = part.column(2)
                doc = np.repeat(np.arange(len(runs)), np.diff(runs.offsets.to_numpy()))
                flat = runs.flatten()
                n = flat.field("n").to_numpy().astype(np.int64)
                start = flat.field("start").to_numpy().astype(np.int64)
                fits = start + n + window - 1 <= words.count[doc]
                doc, n, start, m = doc[fits], n[fits], start[fits], flat.field("m").to_numpy()[fits]
                at = tn.expand(start + words.lo[doc], n)
                row = np.repeat(np.arange(len(n)), n)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                yield pa.record_batch(
                    [pa.array(m[row]), pa.array(tn.signed(tn.word_spans(pre, at, at + window))), pa.array(ids[doc[row]].astype(np.int64)),
                     pa.array((at - words.lo[doc[row]]).astype(np.int32))],
                    names=["m", "h", "id", "start"],
                )

    return run


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tn.slices(batch, "text"):
            words = tn.Words(part.column(1))
            out: dict[str, list] = {"n_removed": [], "kept": [], "spans": []}
            for d, spans in enumerate(part.column(2).to_pylist()):
                lo, n = int(words.lo[d]), int(words.count[d])
                gone = np.zeros(n + 1, np.int64)
                if spans:
                    np.add.at(gone, [min(s["start"], n) for s in spans], 1)
                    np.add.at(gone, [min(s["end"], n) for s in spans], -1)
                gone = np.cumsum(gone)[:n] > 0
                keep = np.flatnonzero(~gone) + lo
                out["n_removed"].append(n - len(keep))
                data = words.data
                out["kept"].append(b" ".join([data[a:b].tobytes() for a, b in zip(words.starts[keep].tolist(), words.ends[keep].tolist(), strict=True)]).decode())
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                out["spans"].append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
            yield pa.record_batch(
                [part.column(0), pa.array(words.count.astype(np.int64)), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept"], pa.string()),
                 pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                names=["id", "n_words", "n_removed", "kept_text", "removed"],
            )


def _written(df: DataFrame, name: str) -> DataFrame:
    """Written, so that a join with it is of two plain shuffles, whose hot keys the skew-join rule splits, or, if it is
    small, none at all."""
    df = stage(df, name)
    return F.broadcast(df) if df.count() <= FEW else df


def removal_intervals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, start, end) in words, end exclusive: every window whose words also start in a document of a smaller id.
    Intervals of one document may overlap; ``remove_repeats`` merges them."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    runs = stage(docs.mapInArrow(_runs(window, gram), "m long, whole long, id long, start int, n int"), "runs")
    kinds = runs.groupBy("m", "whole").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    shared = kinds.groupBy("m").agg(F.min("first").alias("lo"), F.max("last").alias("hi"), F.count("*").alias("kinds")).where("lo < hi").select("m", "kinds")
    kinds = _written(kinds.select("m", "whole", "first").join(shared, "m"), "kinds")
    hits = stage(runs.join(kinds, ["m", "whole"]).select("id", "m", "start", "n", "kinds", (F.col("id") > F.col("first")).alias("copy")), "hits")
    open_runs = hits.where("NOT copy AND kinds > 1").groupBy("id").agg(F.collect_set(F.struct("start", "n", "m")).alias("runs"))
    texts = docs.join(open_runs, "id").select("id", "text", "runs")
    windows = stage(texts.mapInArrow(_unroll(window), "m long, h long, id long, start int"), "windows")
    firsts = windows.groupBy("m", "h").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("m", "h", "first")
    more = windows.join(_written(firsts, "firsts"), ["m", "h"]).where("id > first").select("id", "start", (F.col("start") + window).alias("end"))
    return hits.where("copy").select("id", "start", (F.col("start") + F.col("n") + (window - 1)).alias("end")).unionAll(more)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, n_words, n_removed, kept_text, removed): one row for each row of ``docs``.

    Words are taken as they are. ``removed`` holds the maximal removal intervals in words (sorted, disjoint, end
    exclusive), ``kept_text`` the other words joined by one space. The first document, by id, that holds a passage
    keeps it. Windows are judged on the input.

    Null and empty texts have no words, texts under ``window`` words lose none. A row of null id loses nothing and
    takes nothing from others. Rows that repeat an id must repeat the text; they don't count as each other's copies.
    An empty table gives an empty result. Only the two named columns are read."""
    gone = removal_intervals(docs, id_col, text_col, window, gram)
    gone = gone.groupBy("id").agg(F.collect_set(F.struct("start", "end")).alias("removed"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    none = rows.where("id IS NULL").withColumn("removed", F.lit(None).cast(gone.schema["removed"].dataType))
    rows = rows.where("id IS NOT NULL").join(gone, "id", "left").unionAll(none)
    return rows.mapInArrow(_strip, "id long, n_words long, n_removed long, kept_text string, removed array<struct<start:int,end:int>>")


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
