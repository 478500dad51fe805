"""LM scoring: prediction by partial matching over bytes (order 4, escapes by the number of distinct symbols, symbol
exclusion), pretrained on all training texts, beside a smoothed word model.

The trie of byte contexts is never in one place. Texts are written in portions; each tells the distinct grams (a context
of 4 bytes and its symbol) and words that it holds, with their training counts. Counts are summed over all portions.
The trie is built subtree by subtree: contexts that end in the same two bytes are one group of at most
256 * 256 * 257 grams, in which every gram gets its code length; contexts of one byte and none, 256 * 257 counts, are broadcast.
What a portion asked for is joined back to it, and each portion scores its texts with a table no larger than itself.
Words that only one portion holds are not sent back: it has counted them itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm import textnum as tn
from tapewright.llm.store import stage

ORDER, SYMBOLS, END = 4, 257, 256
#: Bytes of text a portion; symbols, or words, handled at once; entries of a portion's counts before they are merged.
PORTION, STEP, MERGE = 16 << 20, 1 << 20, 1 << 19
SCORES = "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes one after the other, each text after ORDER zeros and before END; where each text starts."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    off = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    starts = off + (ORDER + 1) * np.arange(n + 1)
    out = np.zeros(starts[-1], np.uint16)
    inner = np.ones(len(out), bool)
    for k in range(ORDER):
        inner[starts[:-1] + k] = False
    inner[starts[1:] - 1] = False
    out[inner] = data
    out[starts[1:] - 1] = END
    return out, starts


def grams(texts: pa.Array, step: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, texts' places): a gram for each byte and for the end of each text, whole texts, ``step`` symbols at once. A
    code is the four bytes before (zeros before the text) and the symbol, of 9 bits."""
    sym, starts = _symbols(texts)
    for a in range(0, len(sym), step):
        b = min(len(sym), a + step)
        at = np.arange(max(a, ORDER), b)
        doc = np.searchsorted(starts, at, "right") - 1
        real = at - starts[doc] >= ORDER
        at, doc = at[real], doc[real]
        code = np.zeros(len(at), np.int64)
        for k in range(ORDER, 0, -1):
            code = (code << 8) | sym[at - k]
        yield (code << 9) | sym[at], doc


def tokens(texts: pa.Array, step: int = STEP) -> Iterator[tuple[pa.DictionaryArray, np.ndarray]]:
    """(words, texts' places), lower-cased, ``step`` words at once."""
    words = tn.Words(texts, fold=_LOWER)
    body = words.data[~tn._WS[words.data]]
    offsets = np.concatenate([[0], np.cumsum(words.ends - words.starts)]).astype(np.int64)
    doc = np.repeat(np.arange(len(words.count)), words.count)
    for a in range(0, len(doc), step):
        b = min(len(doc), a + step)
        own = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(offsets[a : b + 1]), pa.py_buffer(body)])
        yield own.dictionary_encode(), doc[a:b]


def _written(portion: int):
    """(p, rows): the texts, each task's in portions of about so many bytes, in compressed batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part in tn.slices(batch, "text"):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_batch(part)
                yield pa.record_batch([pa.array([p]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["p", "rows"])
                held += part.column(part.schema.get_field_index("text")).nbytes
                if held >= portion:
                    p, held = p + 1, 0

    return run


def _read(rows: pa.Array | pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
    for packed in rows:
        yield from pa.ipc.open_stream(packed.as_buffer())


def _by_kind(part: pa.RecordBatch) -> Iterator[tuple[pa.Array, int]]:
    """The texts that train (1) and those that are held out (0)."""
    held, text = (part.column(part.schema.get_field_index(c)) for c in ("held", "text"))
    yield text.filter(pc.invert(held)), 1
    yield text.filter(held), 0


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, inverse = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    n = np.zeros(len(code), np.int64)
    np.add.at(n, inverse, np.concatenate([k for _, k in parts]))
    return code, n


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(p, code, n): a portion's distinct grams and how often they train."""
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        for at, p in enumerate(batch.column(0).to_pylist()):
            own = found.setdefault(p, [])
            for part in _read(batch.column(1).slice(at, 1)):
                for text, trains in _by_kind(part):
                    for code, _ in grams(text):
                        kinds = pc.value_counts(pa.array(code))
                        own.append((kinds.field("values").to_numpy(), kinds.field("counts").to_numpy() * trains))
            if sum(len(c) for c, _ in own) > MERGE:
                found[p] = [_merge(own)]
    for p, own in found.items():
        if own:
            code, n = _merge(own)
            yield pa.record_batch([pa.array(np.full(len(code), p)), pa.array(code), pa.array(n)], names=["p", "code", "n"])


class _Words:
    """A portion's words, coded: how often each trains, and the codes and texts' places of each batch's."""

    def __init__(self, rows: pa.Array | pa.ChunkedArray, keep: bool = False):
        self.code: dict[bytes, int] = {}
        self.batches: list[list[tuple[np.ndarray, np.ndarray]]] = []
        n = np.zeros(0, np.int64)
        for part in _read(rows):
            held, text = (part.column(part.schema.get_field_index(c)) for c in ("held", "text"))
            trains, own_batch = ~held.to_numpy(zero_copy_only=False), []
            for own, doc in tokens(text):
                codes = np.array([self.code.setdefault(w, len(self.code)) for w in own.dictionary.to_pylist()], np.int64)
                at = own.indices.to_numpy()
                n = np.pad(n, (0, len(self.code) - len(n)))
                n[codes] += np.bincount(at[trains[doc]], minlength=len(codes))
                if keep:
                    own_batch.append((codes.astype(np.int32)[at], doc.astype(np.int32)))
            self.batches.append(own_batch)
        self.n = n


def _word_counts(key: tuple, rows: pa.Table) -> pa.Table:
    """(p, word, n, kinds): a portion's distinct words and how often they train, and, as the empty word, their sums."""
    words = _Words(rows["rows"])
    names, n = pa.array([*words.code, b""], pa.binary()), words.n
    kinds = np.zeros(len(names), np.int64)
    kinds[-1] = (n > 0).sum()
    return pa.table({"p": pa.array(np.full(len(names), key[0].as_py())), "word": names, "n": pa.array(np.append(n, n.sum())), "kinds": pa.array(kinds)})


def code_lengths(code: np.ndarray, n: np.ndarray, one: np.ndarray) -> np.ndarray:
    """log10 probabilities of grams whose contexts end in the same two bytes; ``n``: their training counts, 0 for grams
    that are only asked for; ``one``: training counts of (byte, symbol), 256 x SYMBOLS.

    From the longest context down: a symbol seen in a context of T counts and U distinct symbols has n / (T + U), any other
    one escapes with U / (T + U), T and U being those of symbols not seen in the longer context. Contexts without
    training are passed by. At the end the symbols that training never saw are equally likely."""
    s, context = code & 511, code >> 9
    b2, b4 = (context >> 16) & 255, int(context[0] & 255)
    own, inverse = np.unique(context, return_inverse=True)
    seen = n > 0
    # Counts by context and symbol, from order 4 down to 0; every context's row in the next.
    three = np.zeros((256, SYMBOLS), np.int64)
    np.add.at(three, (b2[seen], s[seen]), n[seen])
    two = three.sum(0)
    zero = one.sum(0)
    dense = [three, two[None, :], one[b4][None, :], zero[None, :]]
    row = [b2, np.zeros_like(b2), np.zeros_like(b2), np.zeros_like(b2)]
    total = np.bincount(inverse[seen], n[seen], len(own))
    kinds = np.bincount(inverse[seen], minlength=len(own)).astype(np.float64)
    held = np.bincount(inverse[seen], three[b2[seen], s[seen]], len(own))  # of the next table, by what is seen here
    t, u, count = total[inverse], kinds[inverse], n.astype(np.float64)
    out, open_ = np.zeros(len(code)), np.ones(len(code), bool)
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in range(ORDER + 1):
            hit = open_ & (count > 0)
            whole = (k == ORDER) & (zero > 0).all()  # nothing is left to escape to
            out += np.where(hit, np.log10(count / (t + np.where(whole, 0, u))), 0)
            miss = open_ & ~hit & (u > 0)
            out += np.where(miss, np.log10(u / (t + u)), 0)
            open_ &= ~hit
            if k == ORDER:
                break
            table, at = dense[k], row[k]
            excluded, gone = (held[inverse], kinds[inverse]) if k == 0 else (held[row[k - 1]], kinds[row[k - 1]])
            total, kinds = table.sum(1).astype(np.float64), (table > 0).sum(1).astype(np.float64)
            t, u, count = total[at] - excluded, kinds[at] - gone, table[at, s].astype(np.float64)
            if k + 1 < len(dense):
                low = dense[k + 1]
                held = np.where(table > 0, low if len(low) == len(table) else np.broadcast_to(low, table.shape), 0).sum(1).astype(np.float64)
    return out - np.where(open_, np.log10(max(1, SYMBOLS - int((zero > 0).sum()))), 0)


def _lengths(one: np.ndarray):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        code = table["code"].to_numpy()
        return pa.table({"code": code, "value": code_lengths(code, table["n"].to_numpy(), one)})

    return run


def _score(total: int, kinds: int, ends: int):
    share = lambda c: np.log10((c + 1) / (total + kinds + 1))

    def run(key: tuple, texts: pa.Table, told: pa.Table) -> pa.Table:
        own_grams, own_words = told.filter(pc.is_valid(told["code"])), told.filter(pc.is_valid(told["word"]))
        known, length = own_grams["code"].to_numpy(), own_grams["value"].to_numpy()
        del own_grams
        order = np.argsort(known)
        known, length = known[order], length[order]
        del order
        words, out = _Words(texts["rows"], keep=True), []
        count = words.n
        at = np.fromiter((words.code[w.as_py()] for w in own_words["word"]), np.int64, own_words.num_rows)
        count[at] = own_words["value"].to_numpy().astype(np.int64)
        for part, coded in zip(_read(texts["rows"]), words.batches, strict=True):
            n, text = part.num_rows, part.column(part.schema.get_field_index("text"))
            score, base, size, hits = np.zeros(n), np.full(n, share(ends)), np.ones(n, np.int64), np.full(n, int(ends > 0))
            for own, doc in grams(text):
                # Each gram is looked up once a step; a hash table of all that is known, made anew every time, would be the most of a task.
                kinds = pa.array(own).dictionary_encode()
                at = np.searchsorted(known, kinds.dictionary.to_numpy())
                score += np.bincount(doc, length[at][kinds.indices.to_numpy()], n)
            for own, doc in coded:
                c = count[own]
                base += np.bincount(doc, share(c), n)
                size += np.bincount(doc, minlength=n)
                hits += np.bincount(doc, c > 0, n).astype(np.int64)
            columns = [part.column(part.schema.get_field_index(c)) for c in ("id", "held")]
            out.append(pa.record_batch([*columns, size, hits, base, score], names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"]))
        pa.default_memory_pool().release_unused()  # else idle workers keep it
        return pa.Table.from_batches(out)

    return run


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", portion: int = PORTION) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row for each row of ``docs``.

    ``score`` is the log10 probability of the text's bytes and its end under the model trained on all rows that are not
    ``held_out`` (null: not). ``base_score``: the sum over the text's words, A-Z lower-cased, and one end of log10((c + 1) / (N +
    V + 1)), c, N and V being the token's count, all tokens and distinct ones in training; ``n_known``: tokens of c > 0.

    Null texts are empty: one end. Without training rows all symbols are equally likely. Rows that repeat count in
    training as often as they are there, and all get their scores; null ids stay null. An empty table gives an empty result. Only
    the columns named are read. Texts are read whole; ``portion``: about so many bytes of text share a task."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ends = rows.where("NOT held").count()
    texts = stage(rows.mapInArrow(_written(portion), "p long, rows binary"), "texts")
    # Grams, and how often they occur in all portions; a portion's are sent back with their lengths.
    seen = stage(texts.mapInArrow(_gram_counts, "p long, code long, n long"), "grams")
    counts = stage(seen.groupBy("code").agg(F.sum("n").alias("n")), "counts")
    # At most 256 * 257 rows.
    low = counts.groupBy(F.col("code").bitwiseAND((1 << 17) - 1).alias("c")).agg(F.sum("n").alias("n")).collect()
    one = np.zeros((256, SYMBOLS), np.int64)
    for r in low:
        one[r["c"] >> 9, r["c"] & 511] = r["n"]
    lengths = counts.groupBy(F.shiftright("code", 9).bitwiseAND(0xFFFF).alias("tail")).applyInArrow(_lengths(one), "code long, value double")
    told = seen.select("p", "code").join(stage(lengths, "lengths"), "code").select(F.col("p").alias("q"), "code", F.lit(None).cast("binary").alias("word"), "value")
    # Words: one shuffle; of the keys that several portions share, all rows stay. A key has a row a portion at most.
    words = texts.groupBy("p").applyInArrow(_word_counts, "p long, word binary, n long, kinds long")
    key = Window.partitionBy("word")
    words = words.withColumns({"total": F.sum("n").over(key), "portions": F.count("*").over(key), "first": F.row_number().over(key.orderBy("p")) == 1})
    shared = stage(words.where("portions > 1 OR word = X''").drop("portions"), "words")
    whole, own = F.col("word") == F.lit(b""), F.col("word") != F.lit(b"")
    sums = shared.agg(
        F.coalesce(F.sum(F.when(whole, F.col("n"))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(whole, F.col("kinds"))), F.lit(0)).alias("kinds"),
        F.count_if(own & (F.col("n") > 0)).alias("again"), F.count_if(own & F.col("first") & (F.col("total") > 0)).alias("once"),
    ).first()
    total, kinds = sums["n"] + ends, sums["kinds"] - sums["again"] + sums["once"] + (ends > 0)
    told = told.unionByName(shared.where(own & (F.col("total") != F.col("n"))).select(F.col("p").alias("q"), F.lit(None).cast("long").alias("code"), "word", F.col("total").cast("double").alias("value")))
    scored = texts.groupBy("p").cogroup(told.groupBy("q")).applyInArrow(_score(total, kinds, ends), SCORES)
    return scored.select("id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def held_out(id_col: str = "doc_id") -> Column:
    """True for the seventh of ids that is kept from training; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))
