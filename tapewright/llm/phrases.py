"""Phrase collocation mining: n-gram counts by HAT-tries, scored against the parts of every cut.

Each task counts paths, one from every word up to ORDER words or the end of its piece, in a trie of task-local word ids:
a root by first word, hash containers of packed suffixes under it, which burst into containers by second word. A full
trie spills whole subtrees as sorted runs with their own words, one run for each prefix partition (by the first
two words). A prefix partition's runs are merged, and the counts of all shorter phrases are sums over neighbouring
paths. Partitions grow in number with the text; one that is too large for a task is dealt again by whole
paths, its sums over prefixes then being added up by Spark.

Single words are counted first, then pairs, then longer paths. No phrase of enough occurrences holds a word or a pair of
fewer, so paths end at rare ones: those whose bit in a table of fixed size, where every word (or pair) of enough
occurrences sets one, is not set. Those that share a bit with another are counted for nothing, but none is missed."""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm import textnum as tn
from tapewright.llm.store import stage

ORDER, LEAST, TOP, SCALE, COVER = 4, 30, 2000, 2_000_000, 80
UNKNOWN = "und"
#: Bits of a task's word id; positions encoded at once; keys of a container; keys of a trie.
WORD_BITS, STEP, BURST, MEMORY = 21, 1 << 19, 1 << 12, 3 << 17
MASK = (1 << WORD_BITS) - 1
#: Bytes of text a prefix partition; paths that one task merges; partitions at least.
PART_BYTES, PART_PATHS, PARTS = 8 << 20, 3_000_000, 16
FEW, CELLS = 1 << 16, 32
#: Bytes of text counted at once; distinct words that a task counts before it gives them out; bits of the table of words.
SLICE, KINDS, TABLE = 2 << 20, 1 << 18, 1 << 26
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BLANK = _SEPARATOR.copy()
_BLANK[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
RUN = "part int, sub int, lang string, n long, words binary, paths binary"
_NAMES = ["part", "sub", "lang", "n", "words", "paths"]
COUNT = "lang string, k int, phrase string, f long"


class HatTrie:
    """Counts of word-id paths: a first id, and the packed suffix after it."""

    def __init__(self, burst: int = BURST):
        self.burst, self.size = burst, 0
        #: By first id: a container of suffixes, or, burst, containers by second id.
        self.flat: dict[int, dict[int, int]] = {}
        self.deep: dict[int, dict[int, dict[int, int]]] = {}

    def add(self, root: int, suffixes: list[int], counts: list[int] | None = None) -> None:
        """Counts each suffix once, or as often as ``counts`` says."""
        counts = repeat(1) if counts is None else counts
        if root in self.deep:
            node = self.deep[root]
            for s, n in zip(suffixes, counts, strict=False):
                box = node.setdefault(s >> 2 * WORD_BITS, {})
                self.size += s not in box
                box[s] = box.get(s, 0) + n
            return
        box = self.flat.setdefault(root, {})
        before, get = len(box), box.get
        for s, n in zip(suffixes, counts, strict=False):
            box[s] = get(s, 0) + n
        self.size += len(box) - before
        if len(box) > self.burst:
            node = self.deep[root] = {}
            for s, n in self.flat.pop(root).items():
                node.setdefault(s >> 2 * WORD_BITS, {})[s] = n

    def spill(self, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Takes out whole subtrees, largest first, until ``keep`` keys are left: first ids, suffixes, counts."""
        sizes = [(len(b), r) for r, b in self.flat.items()] + [(sum(map(len, d.values())), r) for r, d in self.deep.items()]
        roots, boxes = [], []
        for size, root in sorted(sizes, reverse=True):
            if self.size <= keep:
                break
            own = [self.flat.pop(root)] if root in self.flat else list(self.deep.pop(root).values())
            boxes += own
            roots += [root] * len(own)
            self.size -= size
        n = [len(b) for b in boxes]
        keys, counts = (np.fromiter(chain.from_iterable(x), np.int64, sum(n)) for x in (boxes, map(dict.values, boxes)))
        return np.repeat(np.array(roots, np.int64), n), keys, counts


def _hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


_WIDTHS = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}


def _narrow(values: np.ndarray) -> np.ndarray:
    top = int(values.max()) if len(values) else 0
    return values.astype(next(kind for width, kind in _WIDTHS.items() if top < 1 << 8 * width))


def _pack(columns: list[np.ndarray]) -> bytes:
    """Columns of one length, each in its narrowest width, compressed."""
    narrow = [_narrow(c) for c in columns]
    return zstandard.ZstdCompressor(1).compress(bytes(c.dtype.itemsize for c in narrow) + b"".join(c.tobytes() for c in narrow))


def _unpack(packed: bytes, columns: int, n: int) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    out, at = [], columns
    for width in raw[:columns]:
        out.append(np.frombuffer(raw, _WIDTHS[width], n, at).astype(np.int64))
        at += n * width
    return out


def _runs(part: np.ndarray, sub: np.ndarray, lang: np.ndarray, ids: np.ndarray, counts: np.ndarray, names: list[bytes], langs: list[str]) -> pa.RecordBatch:
    """A row for each (part, sub, lang): its paths in order (first words as differences), and the words they use. ``ids``: a
    column a word, 0 for no word, else 1 plus the word's place in ``names``, which are sorted."""
    kind = (part * (int(sub.max()) + 1) + sub) * len(langs) + lang
    bits = len(names).bit_length()
    if int(kind.max()).bit_length() + 2 * bits < 64:
        key = [(((kind << bits) | ids[:, 0]) << bits) | ids[:, 1]]
        order = np.argsort(key[0]) if ids.shape[1] == 2 else np.lexsort(((ids[:, 2] << bits) | ids[:, 3], *key))
    else:
        order = np.lexsort((*ids.T[::-1], kind))
    kind, ids, counts = kind[order], ids[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
    ends = [*starts[1:].tolist(), len(kind)]
    words, paths = [], []
    for a, b in zip(starts.tolist(), ends, strict=True):
        own = ids[a:b]
        if 16 * len(own) > len(names):
            there = np.zeros(len(names) + 1, bool)
            there[own] = True
            there[0] = True
            used, local = np.flatnonzero(there), (np.cumsum(there) - 1)[own]
        else:
            used = np.union1d(own, [0])
            local = np.searchsorted(used, own)
        words.append(zstandard.ZstdCompressor(1).compress(b"\n".join([names[i - 1] for i in used[1:].tolist()])))
        paths.append(_pack([np.diff(local[:, 0], prepend=0), *local[:, 1:].T, counts[a:b]]))
    first = order[starts]
    columns = [pa.array(part[first], pa.int32()), pa.array(sub[first], pa.int32()), pa.array([langs[i] for i in lang[first].tolist()], pa.string()),
               pa.array(np.diff(np.append(starts, len(kind))), pa.int64()), pa.array(words, pa.binary()), pa.array(paths, pa.binary())]
    return pa.record_batch(columns, names=_NAMES)


def _bit(of: np.ndarray, *h: np.ndarray) -> np.ndarray:
    """The table's bit of words, by their hashes and their language's."""
    for x in h:
        of = tn.mix(of + x)
    return of & np.uint64(TABLE - 1)


def _set(table: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (table[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _word_array(words: tn.Words) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes, one after the other, and where each starts."""
    return words.data[~_BLANK[words.data]], np.concatenate([[0], np.cumsum(words.ends - words.starts)]).astype(np.int64)


def _words(step: int):
    """(lang, word, n): each task's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, dict[bytes, int]] = {}

        def give() -> Iterator[pa.RecordBatch]:
            for lang, own in found.items():
                columns = [pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.int64())]
                yield pa.record_batch(columns, names=["lang", "word", "n"])
            found.clear()

        for batch in batches:
            for rows in tn.slices(batch, "text", SLICE):
                words = tn.Words(rows.column(1), _BLANK, _LOWER)
                body, offsets = _word_array(words)
                langs = rows.column(0).dictionary_encode()
                lang = np.repeat(langs.indices.to_numpy(), words.count)
                names = langs.dictionary.to_pylist()
                for a in range(0, len(lang), step):
                    n = min(len(lang), a + step) - a
                    own = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets[a : a + n + 1]), pa.py_buffer(body)]).dictionary_encode()
                    kinds = np.bincount(lang[a : a + n] * len(own.dictionary) + own.indices.to_numpy(), minlength=len(names) * len(own.dictionary))
                    every = own.dictionary.to_pylist()
                    for k, name in enumerate(names):
                        counts, box = kinds[k * len(every) : (k + 1) * len(every)], found.setdefault(name, {})
                        for w in np.flatnonzero(counts).tolist():
                            box[every[w]] = box.get(every[w], 0) + int(counts[w])
                    if sum(map(len, found.values())) > KINDS:
                        yield from give()
        yield from give()

    return run


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bits of phrases of as many words each."""
    for batch in batches:
        for rows in tn.slices(batch, "phrase"):
            langs = rows.column(0).dictionary_encode()
            of = np.array([_hash(x.encode()) for x in langs.dictionary.to_pylist()], np.uint64)[langs.indices.to_numpy()]
            words = tn.Words(rows.column(1).cast(pa.string()), _BLANK)
            k, h = int(words.count[0]), words.hashes()
            bit = _bit(of, *(h[i::k] for i in range(k))).astype(np.int64)
            yield pa.record_batch([pa.array(bit + 1)], names=["bit"])  # Spark numbers bits from 1


def _table(frequent: DataFrame):
    """The table of bits of (lang, phrase), broadcast: TABLE / 8 bytes, in rows of 4096, however many phrases there are."""
    bits = frequent.select("lang", "phrase").mapInArrow(_bits, "bit long")
    bits = bits.groupBy(F.bitmap_bucket_number("bit").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    table = np.zeros(TABLE // 8, np.uint8)
    for r in bits.toLocalIterator():
        table[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return frequent.sparkSession.sparkContext.broadcast(table.tobytes())


class _Counter:
    """A task's trie, its words and its languages."""

    def __init__(self, parts: int, memory: int, most: int):
        self.parts, self.memory, self.most = parts, memory, most
        self.reset()

    def reset(self) -> None:
        self.trie, self.words, self.langs = HatTrie(), {}, {}
        self.hashes: list[int] = []

    def add(self, ids: np.ndarray, lang: np.ndarray, left: np.ndarray, least: int) -> None:
        """Counts a path from each of the first ``len(left)`` words, over as many words as are ``left``, if there are ``least``."""
        at = np.flatnonzero(left >= least)
        if not len(at):
            return
        n, left = len(at), left[at]
        if self.most == 2 and len(self.langs) < 1 << 20:
            # A pair fits one number: equal ones are counted before they go to the trie.
            key = (((lang[at] << WORD_BITS) | ids[at]) << WORD_BITS) | np.where(left > 1, ids[np.minimum(at + 1, len(ids) - 1)] + 1, 0)
            key.sort()
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            counts, key = np.diff(new, append=n).tolist(), key[new]
            root, keys = key >> WORD_BITS, ((key & MASK) << (ORDER - 2) * WORD_BITS).tolist()
            edge = np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1]]))
            edges = [*edge.tolist(), len(root)]
            for r, a, b in zip(root[edge].tolist(), edges, edges[1:], strict=False):
                self.trie.add(r, keys[a:b], counts[a:b])
            return
        root, suffix = (lang[at] << WORD_BITS) | ids[at], np.zeros(n, np.int64)
        for k in range(1, self.most):
            suffix |= np.where(left > k, ids[np.minimum(at + k, len(ids) - 1)] + 1, 0) << (ORDER - 1 - k) * WORD_BITS
        order = np.argsort(root, kind="stable")
        root, keys = root[order], suffix[order].tolist()
        edge = np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1]]))
        edges = [*edge.tolist(), n]
        for r, a, b in zip(root[edge].tolist(), edges, edges[1:], strict=False):
            self.trie.add(r, keys[a:b])

    def ids_of(self, names: list[bytes]) -> np.ndarray:
        out, words = np.empty(len(names), np.int64), self.words
        for i, name in enumerate(names):
            at = words.get(name)
            if at is None:
                at = words[name] = len(words)
                self.hashes.append(_hash(name))
            out[i] = at
        return out

    def spill(self, keep: int) -> Iterator[pa.RecordBatch]:
        root, suffix, counts = self.trie.spill(keep)
        if not len(root):
            return
        ids = np.stack([(root & MASK) + 1, *[(suffix >> (ORDER - 1 - k) * WORD_BITS) & MASK for k in range(1, self.most)]], axis=1)
        used = np.unique(ids)
        used = used[used > 0]
        every = list(self.words)
        names = pa.array([every[i - 1] for i in used.tolist()], pa.binary())
        order = pc.sort_indices(names)
        place = np.zeros(len(every) + 1, np.int64)
        place[used[order.to_numpy()]] = np.arange(1, len(used) + 1)
        langs = list(self.langs)
        lang, h = root >> WORD_BITS, np.array([0, *self.hashes], np.uint64)
        of = np.array([_hash(x.encode()) for x in langs], np.uint64)[lang]
        part = (tn.mix(tn.mix(h[ids[:, 0]] + of) + h[ids[:, 1]]) % np.uint64(self.parts)).astype(np.int64)
        yield _runs(part, np.zeros_like(part), lang, place[ids], counts, names.take(order).to_pylist(), langs)

    def flush(self) -> Iterator[pa.RecordBatch]:
        yield from self.spill(0)
        self.reset()


def _count(parts: int, memory: int, step: int, least: int, most: int, words_table, pairs_table=None):
    """The runs of paths of ``least`` to ``most`` words, within frequent words and pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The trie is a great many dicts without cycles, which the collector would go through again and again.
        gc.disable()
        try:
            yield from counted(batches)
        finally:
            gc.enable()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, single = _Counter(parts, memory, most), np.frombuffer(words_table.value, np.uint8)
        for batch in batches:
            for rows in tn.slices(batch, "text", SLICE):
                words = tn.Words(rows.column(1), _BLANK, _LOWER)
                if not len(words.starts):
                    continue
                langs = [c.langs.setdefault(x, len(c.langs)) for x in rows.column(0).to_pylist()]
                lang, h = np.repeat(np.array(langs, np.int64), words.count), words.hashes()
                of = np.array([_hash(x.encode()) for x in c.langs], np.uint64)[lang]
                often = _set(single, _bit(of, h))
                # Where no frequent word of the same piece follows, or none that makes a frequent pair.
                seps = np.cumsum(_SEPARATOR[words.data], dtype=np.int32)
                last = np.ones(len(often), bool)
                last[:-1] = (seps[words.starts[1:]] != seps[words.ends[:-1] - 1]) | ~often[1:]
                last[words.hi[words.count > 0] - 1] = True
                if pairs_table is not None:
                    last[:-1] |= ~_set(np.frombuffer(pairs_table.value, np.uint8), _bit(of[:-1], h[:-1], h[1:]))
                at = np.flatnonzero(often)
                lang, last = lang[at], last[at]
                ends, before = np.flatnonzero(last), np.cumsum(last) - last
                body, offsets = _word_array(words)
                names = pa.Array.from_buffers(pa.large_binary(), len(often), [None, pa.py_buffer(offsets), pa.py_buffer(body)]).take(pa.array(at))
                for a in range(0, len(at), step):
                    b, upto = min(len(at), a + step), min(len(at), a + step + ORDER - 1)
                    if len(c.words) + upto - a >= MASK:
                        known = list(c.langs)
                        yield from c.flush()
                        c.langs.update({x: i for i, x in enumerate(known)})
                    own = names.slice(a, upto - a).dictionary_encode()
                    ids = c.ids_of(own.dictionary.to_pylist())[own.indices.to_numpy()]
                    c.add(ids, lang[a:b], ends[before[a:b]] - np.arange(a, b) + 1, least)
                    if c.trie.size > memory:
                        yield from c.spill(memory // 2)
        yield from c.flush()

    return run


def _open(table: pa.Table | pa.RecordBatch, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Of all rows: the row of each path, the paths, the counts, the words; ids are 1 plus the word's place, 0 for none."""
    sizes = table["n"].to_pylist()
    lists = [zstandard.ZstdDecompressor().decompress(w).split(b"\n") for w in table["words"].to_pylist()]
    coded = pa.array([w for own in lists for w in own], pa.binary()).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(1, len(order) + 1)
    place, at = place[coded.indices.to_numpy()], 0
    ids, counts = np.empty((sum(sizes), most), np.int64), np.empty(sum(sizes), np.int64)
    done = 0
    for n, own, packed in zip(sizes, lists, table["paths"].to_pylist(), strict=True):
        *columns, counts[done : done + n] = _unpack(packed, most + 1, n)
        mine = np.concatenate([[0], place[at : at + len(own)]])
        columns[0] = np.cumsum(columns[0])
        for k, c in enumerate(columns):
            ids[done : done + n, k] = mine[c]
        done, at = done + n, at + len(own)
    return np.repeat(np.arange(len(sizes)), sizes), ids, counts, coded.dictionary.take(pa.array(order)).to_pylist()


def _split(most: int):
    """Runs dealt again by whole paths, into ``times`` each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                _, ids, counts, names = _open(one, most)
                h = np.array([0, *map(_hash, names)], np.uint64)
                sub = _bit(*(h[ids[:, k]] for k in range(most))) % np.uint64(one["times"][0].as_py())
                part = np.full(len(ids), one["part"][0].as_py(), np.int64)
                yield _runs(part, sub.astype(np.int64) + 1, np.zeros(len(ids), np.int64), ids, counts, names, one["lang"].to_pylist())

    return run


def _merge(least: int, first: int, most: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """The runs of a partition as one, and the counts of its phrases of ``first`` words or more: all that occur
        ``least`` times, or, of a partition that was dealt again (sub over 0), all whose other occurrences may be elsewhere."""
        row, ids, counts, names = _open(table, most)
        langs = table["lang"].to_pylist()
        kinds = sorted(set(langs))
        lang = np.array([kinds.index(x) for x in langs], np.int64)[row]
        bits = max(1, int(len(names)).bit_length())
        if (most * bits + len(kinds).bit_length()) < 63:
            path = lang
            for k in range(most):
                path = (path << bits) | ids[:, k]
            order = np.argsort(path, kind="stable")  # the runs are in order: a merge
        else:
            order = np.lexsort((*ids.T[::-1], lang))
        lang, ids, counts = lang[order], ids[order], counts[order]
        out: dict[str, list] = {"lang": [], "k": [], "phrase": [], "f": []}
        new = np.ones(len(ids), bool)
        new[1:] = (lang[1:] != lang[:-1]) | (ids[1:, 0] != ids[:-1, 0])
        for k in range(2, most + 1):
            new[1:] |= ids[1:, k - 1] != ids[:-1, k - 1]
            if k < first:
                continue
            starts = np.flatnonzero(new)
            f = np.add.reduceat(counts, starts) if len(starts) else counts
            good = ids[starts, k - 1] > 0
            if k == most or not key[1].as_py():
                good &= f >= least
            out["lang"] += [kinds[i] for i in lang[starts[good]].tolist()]
            out["phrase"] += [b" ".join([names[w - 1] for w in p]) for p in ids[starts[good], :k].tolist()]
            out["f"] += f[good].tolist()
            out["k"] += [k] * int(good.sum())
        text = pa.array(out["phrase"], pa.binary()).cast(pa.string())
        return pa.table([pa.array(out["lang"], pa.string()), pa.array(out["k"], pa.int32()), text, pa.array(out["f"], pa.int64())], names=["lang", "k", "phrase", "f"])

    return run


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, part_bytes: int = PART_BYTES, part_paths: int = PART_PATHS,
                  memory: int = MEMORY, step: int = STEP) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all words, and (lang, k, phrase, f) of all phrases of 2 to 4 words that occur ``least`` times.

    Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at blanks and tabs into words; a
    phrase lies within a piece. Null text is empty, null lang is ``und``. Nothing is left out: partitions that are too
    large for a task are dealt again. ``memory``: keys that a task's trie holds; ``step``: words that it takes at once."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(PARTS, size // part_bytes)
    words = rows.mapInArrow(_words(step), "lang string, word binary, n long").groupBy("lang", F.col("word").cast("string").alias("phrase")).agg(F.sum("n").alias("f"))
    words = stage(words, "words")
    single = _table(words.where(F.col("f") >= least))

    def paths(first: int, most: int, pairs=None) -> DataFrame:
        runs = stage(rows.mapInArrow(_count(parts, memory, step, first, most, single, pairs), RUN), "runs")
        large = runs.groupBy("part").agg(F.sum("n").alias("n")).where(F.col("n") > part_paths)
        large = stage(large.select("part", F.ceil(F.col("n") / part_paths).cast("int").alias("times")), "large")
        count = large.count()
        if count:
            large = F.broadcast(large) if count <= FEW else large
            again = runs.join(large, "part").mapInArrow(_split(most), RUN)
            runs = runs.join(large, "part", "left_anti").unionByName(again)
        found = runs.groupBy("part", "sub").applyInArrow(_merge(least, first, most), COUNT)
        found = found.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
        return stage(found, "phrases")

    pairs = paths(2, 2)
    return words, pairs.unionByName(paths(3, ORDER, _table(pairs)))


def _wide(name: str) -> Column:
    return F.col(name).cast("decimal(19,0)")


def _part(start, n) -> Column:
    return F.array_join(F.slice("w", start, n), " ")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, cover: int = COVER) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to 4 words.

    a: the phrase's occurrences, ``least`` or more; l, r: those of its two parts, at the cut of the lowest score
    floor(2000000 * a / (l + r)), the first of such; n: the language's words. A phrase goes if its words lie within a
    longer one that has ``cover`` per cent of its occurrences. Order: score, then a, descending, then the phrase by bytes. Arithmetic is in decimals. Null text is
    empty, null lang is ``und``; repeated rows count as often as they are there; an empty table gives an empty result. Only the
    two named columns are read."""
    words, found = phrase_counts(docs, text_col, lang_col, least)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    parts = words.where(F.col("f") >= least).unionByName(found.where("k < 4").select("lang", "phrase", "f"))
    split = found.select("lang", "k", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cut = split.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cut = cut.select("lang", "phrase", "a", "cut", _part(F.lit(1), F.col("cut")).alias("first"), _part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    left = parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    score = F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * _wide("a"), _wide("l") + _wide("r"))
    cut = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", score)
    best = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda s: _part(s, n))))
    longer = split.where("k > 2").select("lang", "a", F.explode(F.array_distinct(inner)).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("over"))
    best = best.join(longer, ["lang", "phrase"], "left").where((_wide("over") * 100 < _wide("a") * cover) | F.col("over").isNull())
    rank = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy(F.desc("score"), F.desc("a"), "phrase"))
    # The first ones of each cell, then of all: a language's task gets CELLS * top rows at most.
    cells = best.withColumn("cell", F.pmod(F.xxhash64("phrase"), F.lit(CELLS)))
    firsts = cells.withColumn("own", rank("cell")).where(F.col("own") <= top).drop("own", "cell")
    ranked = firsts.withColumn("rank", rank().cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
