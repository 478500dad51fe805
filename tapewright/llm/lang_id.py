"""Language identification by a string kernel: blended-spectrum n-gram presence kernel, Nyström landmarks,
one-versus-rest kernel ridge regression, scored by batched matrix products."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm import textnum as tn
from tapewright.llm.store import fresh, stage

#: n-grams of 1 to ORDER characters, hashed into BINS presence bits; code points hashed at once.
ORDER, BINS, STEP = 4, 1 << 16, 1 << 20
#: Bins of the sample's presence rows that are floats at once.
WIDTH = 1 << 10
#: Bounds of the training sample: documents a language, and in all (8 KB of bits each reach the driver).
PER_LANGUAGE, SAMPLE = 400, 4096
#: Landmarks a language, and in all but for one a language at least; languages.
LANDMARKS, ALL_LANDMARKS, LANGUAGES, RIDGE = 64, 256, 512, 1e-2
#: Cells of the hash range by which labelled rows are counted: 2 ** CELL_BITS a language.
CELL_BITS = 11
#: The rejection level lies this far from the least score there is to a quantile of the sample's out-of-fold scores.
MARGIN, QUANTILE, FOLDS = 0.5, 0.001, 2
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def _seen(text: str) -> np.ndarray:
    """Which bins hold one of the text's 1- to ORDER-grams, lower case, whole text."""
    low = text.lower()
    seen = np.zeros(BINS, bool)
    for at in range(0, len(low), STEP):
        c = np.frombuffer(low[at : at + STEP + ORDER - 1].encode("utf-32-le"), np.uint32)
        h = np.zeros(len(c), np.uint32)
        for n in range(1, min(ORDER, len(c)) + 1):
            h = (h[: len(c) - n + 1] + c[n - 1 :] + np.uint32(n)) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            seen[(h * np.uint32(0x85EBCA6B)) >> np.uint32(16)] = True
    return seen


def bins(text: str) -> np.ndarray:
    """Sorted bins of the text's n-grams."""
    return np.flatnonzero(_seen(text))


def bits(text: str) -> bytes:
    return np.packbits(_seen(text)).tobytes()


def presence(rows: list[bytes]) -> np.ndarray:
    """One row a text, from its bits, scaled to length 1, so that products of rows are kernel values. For a few rows;
    of many, ``Presence`` makes the products."""
    x = np.unpackbits(np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), BINS // 8), axis=1).astype(np.float32)
    return x / np.sqrt(np.maximum(1, x.sum(1)))[:, None]


@dataclass
class Presence:
    """Products of the rows that ``presence`` makes, from their bits. Only WIDTH columns are floats at a time: whole rows, 256 KB
    each, would be much of the driver's memory."""

    bits: np.ndarray

    @classmethod
    def of(cls, rows: list[bytes]) -> Presence:
        return cls(np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), BINS // 8))

    def blocks(self) -> Iterator[tuple[int, np.ndarray]]:
        for a in range(0, BINS, WIDTH):
            yield a, np.unpackbits(self.bits[:, a // 8 : (a + WIDTH) // 8], axis=1).astype(np.float32)

    def lengths(self) -> np.ndarray:
        return np.sqrt(np.maximum(1, np.bitwise_count(self.bits).sum(1, dtype=np.int64)))

    def kernel(self, marks: np.ndarray) -> np.ndarray:
        """Kernel values of all rows with the rows ``marks``. Sums of presences are whole numbers, exact in floats."""
        out, n = np.zeros((len(self.bits), len(marks)), np.float32), self.lengths()
        for _, x in self.blocks():
            out += x @ x[marks].T
        return out / (n[:, None] * n[marks])

    def weighted(self, dual: np.ndarray) -> np.ndarray:
        """BINS x columns of ``dual``: the rows times their dual weights."""
        out, dual = np.empty((BINS, dual.shape[1]), np.float32), dual / self.lengths()[:, None]
        for a, x in self.blocks():
            out[a : a + WIDTH] = x.T @ dual
        return out

    def times(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.bits), weights.shape[1]))
        for a, x in self.blocks():
            out += x @ weights[a : a + WIDTH]
        return out / self.lengths()[:, None]


@dataclass
class Model:
    languages: list[str]
    #: BINS x languages: the landmarks' presence rows times the dual weights. K(x, landmarks) @ dual = x @ weights.
    weights: np.ndarray
    bias: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        """One row a text, one column a language: kernel row times dual weights, as a product with the presence row."""
        rows = [bins(t) for t in texts]
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        n = np.array([len(r) for r in rows])
        sums = np.zeros((len(rows), len(self.languages)))
        full = np.flatnonzero(n)
        if len(full):
            sums[full] = np.add.reduceat(self.weights[flat], (np.cumsum(n) - n)[full], axis=0)
        return sums / np.sqrt(np.maximum(n, 1))[:, None] + self.bias


def fit(rows: list[bytes], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression in the space spanned by ``landmarks`` texts of each language (the first ones; fewer if
    there are many languages). ``rows`` are the texts' bits."""
    languages = sorted(set(langs))
    if len(languages) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages")
    y = np.array([languages.index(x) for x in langs])
    each = max(1, min(landmarks, ALL_LANDMARKS // len(languages)))
    marks = np.concatenate([np.flatnonzero(y == c)[:each] for c in range(len(languages))])
    k_nm = Presence.of(rows).kernel(marks)
    k_mm = k_nm[marks]
    value, vector = np.linalg.eigh(k_mm)
    good = value > 1e-8 * value[-1]
    root = vector[:, good] / np.sqrt(value[good])
    z = k_nm @ root
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weight = 1 / np.bincount(y, minlength=len(languages))[y]
    weight = weight / weight.sum()
    zc, tc = weight @ z, weight @ target
    a = (z - zc).T @ ((z - zc) * weight[:, None]) + ridge / len(rows) * np.eye(z.shape[1])
    beta = np.linalg.solve(a, (z - zc).T @ ((target - tc) * weight[:, None]))
    return Model(languages, Presence.of([rows[i] for i in marks]).weighted(root @ beta), tc - zc @ beta)


def rejection_level(rows: list[bytes], langs: list[str]) -> float:
    """The score under which a text is told to be in none of the languages.

    Each of FOLDS parts of the sample is scored by a model of the others. The level lies MARGIN of the way from 1 over the number
    of languages, which a text gets that shares nothing with any of them, to the QUANTILE of those scores: so low that
    the sample's own texts stay. With one language there is nothing to tell it from: 0, no text is rejected."""
    n = len(set(langs))
    if n < 2:
        return 0.0
    told = []
    for fold in range(FOLDS):
        inside = [i for i in range(len(rows)) if i % FOLDS != fold]
        if len({langs[i] for i in inside}) < n:
            continue  # a language of so few texts can't be told without them
        m = fit([rows[i] for i in inside], [langs[i] for i in inside])
        out = [rows[i] for i in range(len(rows)) if i % FOLDS == fold]
        told += [((1 + Presence.of(out[a : a + 1024]).times(m.weights) + m.bias) / 2).max(1) for a in range(0, len(out), 1024)]
    scores = np.clip(np.concatenate(told), 0, 1) if told else np.zeros(1)
    return 1 / n + MARGIN * max(0.0, float(np.quantile(scores, QUANTILE, method="lower")) - 1 / n)


def _bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tn.slices(batch, "text"):
            got = [bits(t) for t in part.column(part.schema.get_field_index("text")).to_pylist()]
            yield pa.record_batch([part.column(part.schema.get_field_index(c)) for c in ("lang", "h")] + [pa.array(got, pa.binary())], names=["lang", "h", "bits"])


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, usable, per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> DataFrame:
    """(lang, h, bits): of each language, the ``per_language`` usable labelled texts first by the hash ``h`` of id and
    text, fewer if there are over ``sample / per_language`` languages. Of more than LANGUAGES languages those of the most
    usable texts (about; then the first by code point) are taken. Equal rows count once."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), usable.alias("usable"))
    rows = rows.where(F.col("usable") & F.col("lang").isNotNull() & F.col("id").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", F.xxhash64("id", "text").alias("h"), "text")
    keys = stage(rows.select("lang", "h", F.shiftright("h", 64 - CELL_BITS).cast("int").alias("cell")), "labelled")
    # Cells in order of the hash, counted first: only rows up to the cell that completes the sample are ranked.
    cells = stage(keys.groupBy("lang", "cell").agg(F.approx_count_distinct("h", 0.02).alias("about")), "cells")
    n = cells.select("lang").distinct().count()
    if n > LANGUAGES:  # at most so many rows
        most = cells.groupBy("lang").agg(F.sum("about").alias("about")).orderBy(F.desc("about"), "lang").limit(LANGUAGES)
        cells, n = cells.join(F.broadcast(stage(most.select("lang"), "languages")), "lang"), LANGUAGES
    per_language = max(1, min(per_language, sample // max(1, n)))
    before = F.sum(F.floor(F.col("about") * 0.8)).over(Window.partitionBy("lang").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    last = cells.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < per_language).groupBy("lang").agg(F.max("cell").alias("last"))
    # One row a language, LANGUAGES at most.
    first = keys.join(F.broadcast(last), "lang").where("cell <= last").select("lang", "h").distinct()
    first = first.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("n") <= per_language).select("lang", "h")
    # At most ``sample`` rows, or one a language.
    found = rows.join(F.broadcast(first), ["lang", "h"]).select("lang", "h", "text").mapInArrow(_bits_of, "lang string, h long, bits binary")
    return found.dropDuplicates(["lang", "h"])


def _sample(docs: DataFrame, usable, id_col: str, text_col: str, lang_col: str, per_language: int) -> tuple[list[bytes], list[str]]:
    rows = sorted((r["h"], r["lang"], bytes(r["bits"])) for r in training_sample(docs, id_col, text_col, lang_col, usable, per_language).toLocalIterator())
    return [r[2] for r in rows], [r[1] for r in rows]


def train(docs: DataFrame, usable, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """A model from the bounded sample of labelled rows, or None if there is no labelled row. Rows that repeat an id and
    a text are one row of the sample; of over LANGUAGES labelled languages the most frequent ones are learned."""
    rows, langs = _sample(docs, usable, id_col, text_col, lang_col, per_language)
    return fit(rows, langs) if rows else None


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1) instead of its text; columns of these names, in any case, are
    replaced. The score is the ridge's estimate of the best language's share: 1 over the number of languages, its
    least value, where nothing speaks for any of them.

    Every whole text is scored. Null texts and texts without a letter are ``und``, score 0; so is everything if
    there is no model. Rows are independent: ties between languages go to the first by code point, repeated rows get
    the same answer, an empty table gives an empty result."""
    rest = [c for c in docs.columns if c.lower() not in (text_col.lower(), "lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in tn.slices(batch, batch.schema.names[-1]):
                texts = part.column(part.num_columns - 1).to_pylist()
                known = [i for i, t in enumerate(texts) if t and m and _LETTER.search(t)]
                pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
                for at in range(0, len(known), 128):
                    some = known[at : at + 128]
                    s = np.clip((1 + m.scores([texts[i] for i in some])) / 2, 0, 1)
                    for i, c, p in zip(some, s.argmax(1), s.max(1), strict=True):
                        pred[i], score[i] = m.languages[c], float(p)
                yield pa.record_batch([*part.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*part.schema.names[:-1], "lang_pred", "score"])

    (t,) = fresh(docs, "text")
    schema = docs.select(*rest, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return docs.select(*rest, F.col(text_col).alias(t)).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """True for the quarter of ids that is kept from training; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", languages: list[str] | None = None,
               least_score: float | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, that are told to be in one of ``languages`` (default: all learned ones) with
    ``least_score`` or more (default: the ``rejection_level`` of the training sample); where ``lang_col`` is null it gets
    the language told. Other languages and noise are rejected. A label stays, even if another language is told.

    Null texts, empty ones and those without a letter go. Without any labelled row nothing can be told: then all texts
    with a letter stay as they are; with one labelled language all of them are told to be in it. Repeated rows stay or
    go together; an empty table gives an empty result; columns are found whatever the case of their names; other columns,
    whatever their names, pass through."""
    rows, langs = _sample(docs, ~held_out(id_col), id_col, text_col, lang_col, PER_LANGUAGE)
    if not rows:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    if least_score is None:
        least_score = rejection_level(rows, langs)
    own = next(c for c in docs.columns if c.lower() == lang_col.lower())
    told = predict(docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text")), fit(rows, langs)).where(F.col("score") >= least_score)
    told = told.where(F.col("lang_pred").isin(languages) if languages is not None else F.col("lang_pred") != UNKNOWN)
    named = F.coalesce(F.col("row")[own], F.col("lang_pred")).cast(docs.schema[own].dataType).alias(own)
    return told.select(*[named if c == own else F.col("row")[c].alias(c) for c in docs.columns])
