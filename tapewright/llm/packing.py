"""Packing token pieces into fixed windows: non-negative least squares over length combinations, then greedy packing."""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm.store import stage

LENGTH, END_ID = 2048, 1
#: Pieces of one run at least: those of one length are ranked within runs, whose number and size grow alike.
RUN = 256
#: Characters encoded at once, about.
CHUNK = 1 << 18
_BLANK, _CUT = re.compile(r"\s"), re.compile(r"(?<=\S) ")


@lru_cache(1)
def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def added_tokens(ranks_path: str) -> dict[str, int]:
    """Id of each added token of the ``tokenizers`` file of the same name beside the ranks; none without that file."""
    path = os.path.splitext(ranks_path)[0] + ".json"
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or _BLANK.search(t["content"]) for t in tokens):
        raise ValueError("added tokens must be plain strings without white space")
    return {t["content"]: t["id"] for t in tokens}


class Encoder:
    """Ids of a text by a byte-level BPE vocabulary: those that its ``tokenizers`` file gives, an added token in the
    text being one id. A text falls apart before every space that follows a non-space: long ones are encoded in parts."""

    def __init__(self, ranks_path: str):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        added = added_tokens(ranks_path)
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        ordinary, names = own.encode_ordinary, tuple(added)

        def encode(text: str) -> list[int]:
            for name in names:
                if name in text:
                    return own.encode(text, allowed_special="all")
            return ordinary(text)

        self.encode = encode

    def ids(self, text: str) -> np.ndarray:
        parts, at = [], 0
        while at < len(text) or not parts:
            cut = _CUT.search(text, at + CHUNK)
            to = cut.start() if cut else len(text)
            parts.append(np.array(self.encode(text[at:to]), np.uint32))
            at = to
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


@lru_cache(1)
def encoder(ranks_path: str) -> Encoder:
    return Encoder(ranks_path)


def _pieces(ranks_path: str, length: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys = part.column(0).to_pylist()
                out: list[tuple] = []
                for key, text in zip(keys, part.column(1), strict=True):
                    ids = np.append(enc.ids(text.as_py() or ""), np.uint32(end_id))
                    for s in range(0, len(ids), length):
                        cut = ids[s : s + length]
                        out.append((key, s, len(cut), zlib.crc32(cut.tobytes()), len(ids), cut.tolist() if with_ids else None))
                cols = list(zip(*out, strict=True))
                yield pa.record_batch(
                    [pa.array(cols[0], pa.int64()), *[pa.array(c, pa.int64()) for c in cols[1:5]], pa.array(cols[5], pa.list_(pa.int32()))],
                    names=["id", "start", "length", "ids_crc32", "doc_tokens", "ids"],
                )

    return run


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID,
                 ranks_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, ids): the ids of each whole text and ``end_id``, cut every
    ``length`` ids. Null text counts as empty: one piece, the end id."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>"
    return rows.mapInArrow(_pieces(ranks_path or default_ranks(), length, end_id, with_ids), schema)


def combinations(length: int, counts: np.ndarray, spread: int = 12) -> np.ndarray:
    """Combinations of one to four piece lengths that fill a window: rows of four lengths, 0 for none. All pairs;
    triples and quadruples with ``spread`` evenly placed partners for each length; repeats of one length."""
    have = np.flatnonzero(counts)
    have = have[(have > 0) & (have < length)]
    if not len(have):
        return np.zeros((0, 4), np.int64)
    rows = [np.stack([have, length - have, 0 * have, 0 * have], 1)]
    for share in (np.arange(spread) + 0.5) / spread:
        rest = length - have
        b = np.maximum(1, (rest * share * 0.5).astype(np.int64))
        rows.append(np.stack([have, b, rest - b, 0 * have], 1))
        c = np.maximum(1, ((rest - b) * 0.5).astype(np.int64))
        rows.append(np.stack([have, b, c, rest - b - c], 1))
    for n in (2, 3, 4):
        rows.append(np.stack([have if k < n else 0 * have for k in range(4)], 1)[have * n == length])
    all_rows = np.sort(np.concatenate(rows), 1)[:, ::-1]
    ok = (all_rows >= 0).all(1) & (all_rows.sum(1) == length)
    ok &= ((all_rows == 0) | (counts[np.clip(all_rows, 0, length)] > 0)).all(1)
    return np.unique(all_rows[ok], axis=0)


def nnls(combos: np.ndarray, counts: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared error between the pieces used and the histogram, by
    accelerated projected gradient (columns have at most four entries)."""
    if not len(combos):
        return np.zeros(0)
    scale = float(counts.max()) or 1.0
    goal = counts / scale
    goal[0] = 0
    used = combos > 0
    flat, owner = combos[used], np.nonzero(used)[0]
    step = 1 / max(1.0, 4.0 * np.bincount(flat, minlength=len(counts)).max())
    x = np.zeros(len(combos))
    y, t = x.copy(), 1.0
    for _ in range(steps):
        error = np.bincount(flat, y[owner], minlength=len(counts)) - goal
        new = np.maximum(0, y - step * np.bincount(owner, error[flat], minlength=len(combos)))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x * scale


def plan(counts: np.ndarray, length: int = LENGTH) -> list[tuple[list[int], int]]:
    """(lengths in a window, number of such windows) that use exactly ``counts[l]`` pieces of each length l < length.

    The solved repeat counts are rounded and taken as far as pieces last; what is left is packed greedily, largest
    piece first, a whole run of equal windows at a time, so that the work depends on the lengths and not on how many
    pieces there are."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[list[int], int]] = []
    combos = combinations(length, left)
    times = np.rint(nnls(combos, left.astype(float))).astype(np.int64)
    for at in np.argsort(-times, kind="stable"):
        if times[at] < 1:
            break
        lengths = [int(v) for v in combos[at] if v]
        need = {v: lengths.count(v) for v in lengths}
        n = min([int(times[at]), *(int(left[v]) // k for v, k in need.items())])
        if n > 0:
            for v, k in need.items():
                left[v] -= n * k
            out.append((lengths, n))
    while (have := np.flatnonzero(left)).size:
        room, lengths, rest = length, [], left.copy()
        while room and (fit := have[(have <= room) & (rest[have] > 0)]).size:
            v = int(fit[-1])
            k = min(int(rest[v]), room // v)
            lengths += [v] * k
            rest[v] -= k
            room -= v * k
        need = {v: lengths.count(v) for v in lengths}
        n = min(int(left[v]) // k for v, k in need.items())
        for v, k in need.items():
            left[v] -= n * k
        out.append((lengths, n))
    return out


def _places(windows: list[tuple[list[int], int]]) -> tuple[np.ndarray, ...]:
    """For ranges of ranks of a length, sorted by (length, first rank): length, first rank, first sequence, pieces of
    the length in a window, offset of the first of them."""
    rows, taken, base = [], {}, 0
    for lengths, n in windows:
        at = 0
        for v in dict.fromkeys(lengths):
            k = lengths.count(v)
            rows.append((v, taken.get(v, 0), base, k, at))
            taken[v] = taken.get(v, 0) + k * n
            at += k * v
        base += n
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return (*cols, np.int64(base))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID,
         ranks_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): one row a piece of a text.

    Texts are cut every ``length`` ids; full pieces are sequences of their own, the others are packed by a plan that
    is made from the histogram of their lengths (at most ``length`` numbers) and looked up by a piece's rank among
    those of its length. Ranks are counted in two steps, by runs of a length's pieces (as many as each has, or of RUN
    pieces), so no length is sorted in one task. Texts are encoded once; the pieces' table is staged.

    Null and empty texts make one piece, the end id. Null ids and rows that repeat an id are packed as rows of their
    own. An empty table gives an empty result. Only the two named columns are read."""
    pieces = token_pieces(docs, id_col, text_col, length, end_id, ranks_path, with_ids)
    pieces = stage(pieces, "pieces")
    # One row a length.
    sizes = stage(pieces.groupBy("length").agg(F.count("*").alias("n")), "lengths")
    counts = np.zeros(length + 1, np.int64)
    for row in sizes.where(F.col("length") < length).collect():
        counts[row["length"]] = row["n"]
    shared = docs.sparkSession.sparkContext.broadcast(_places(plan(counts, length)))
    runs = F.ceil(F.col("n") / F.greatest(F.lit(RUN), F.sqrt("n")))
    dealt = pieces.join(F.broadcast(sizes), "length").withColumn("run", F.pmod(F.xxhash64("id", "start", "ids_crc32"), runs))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = dealt.groupBy("length", "run").agg(F.count("*").alias("n")).select("length", "run", before.alias("base"))
    rank = F.row_number().over(Window.partitionBy("length", "run").orderBy("id", "start", "ids_crc32")) - 1
    ranked = dealt.withColumn("rank", rank.cast("long")).join(base, ["length", "run"]).withColumn("rank", F.col("rank") + F.col("base"))
    wide = ["id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, first, seq, k, off, total = shared.value
        key = v * (1 << 44) + first
        for batch in batches:
            n, r = batch.column(2).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
            short = n < length
            at = np.where(short, np.searchsorted(key, n * (1 << 44) + r, "right") - 1, 0) if len(key) else np.zeros(len(n), np.int64)
            if len(key):
                q = r - first[at]
                where, offset = np.where(short, seq[at] + q // k[at], total + r), np.where(short, off[at] + q % k[at] * n, 0)
            else:
                where, offset = total + r, np.zeros(len(n), np.int64)
            yield pa.record_batch([*batch.columns[:-1], pa.array(where), pa.array(offset)], names=[*wide, "sequence_id", "offset"])

    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long, " + "ids array<int>, " * with_ids + "sequence_id long, offset long"
    return ranked.select(*wide, "rank").mapInArrow(place, schema)
