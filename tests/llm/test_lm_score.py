import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapewright.llm import lm_score

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def symbols(text):
    return [0] * 4 + list((text or "").encode()) + [256]


class Plain:
    """Prediction by partial matching, symbol by symbol."""

    def __init__(self, texts):
        self.n = defaultdict(Counter)
        for t in texts:
            x = symbols(t)
            for i in range(4, len(x)):
                for k in range(5):
                    self.n[tuple(x[i - k : i])][x[i]] += 1

    def p(self, x, i, last=4):
        left, out = set(), 1.0
        for k in range(last, -1, -1):
            seen = self.n.get(tuple(x[i - k : i]), {})
            own = {s: c for s, c in seen.items() if s not in left}
            t, u = sum(own.values()), len(own)
            if x[i] in own:
                return out * own[x[i]] / (t + (0 if k == 0 and len(seen) == 257 else u))
            if u:
                out *= u / (t + u)
            left |= set(seen)
        return out / (257 - len(left))

    def score(self, text):
        x = symbols(text)
        return sum(math.log10(self.p(x, i)) for i in range(4, len(x)))


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [None]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    bits = ["the ", "Der ", "é", "un", "ion", "\n", "\t", " a", "ou", "\0", "Z", "漢", "😀", ".", "qu"]
    out = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 60))), None, "s", 1) for i in range(70)]
    return [*out, *out[:3], (100, None, None, None, None), (101, "", None, None, None), (102, "unseen \x7f~ words", None, None, None), (None, "null id", None, None, None),
            (103, "".join(rng.choice(bits) for _ in range(9000)), None, None, None)]


@pytest.mark.parametrize("size", [16 << 20, 100])
def test_scores(spark, rows, size, monkeypatch):
    docs = spark.createDataFrame(rows, DOCS).withColumns({"score": F.lit("clash"), "p": F.lit(1)}).repartition(3)
    train = [t for i, t, *_ in rows if not is_held(i)]
    model, c = Plain(train), Counter(w for t in train for w in words(t))
    total, kinds = sum(c.values()), len(c)
    base = lambda t: sum(math.log10((c[w] + 1) / (total + kinds + 1)) for w in words(t))
    want = sorted(((i, is_held(i), len(words(t)), sum(c[w] > 0 for w in words(t)), total, base(t), model.score(t)) for i, t, *_ in rows), key=lambda r: (str(r[:5]), r[5]))
    got = sorted((tuple(r) for r in lm_score.score_texts(docs, lm_score.held_out(), portion=size).collect()), key=lambda r: (str(r[:5]), r[5]))
    assert [g[:5] for g in got] == [w[:5] for w in want] and any(w[1] for w in want)
    np.testing.assert_allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def test_probabilities_sum_to_one(rows):
    """In every context, seen or not, over all symbols."""
    texts = [t for _, t, *_ in rows]
    n, rng = Counter(), random.Random(1)
    for code, _ in lm_score.grams(pa.array(texts)):
        n.update(code.tolist())
    one = np.zeros((256, 257), np.int64)
    for code, k in n.items():
        one[(code >> 9) & 255, code & 511] += k
    for context in [*rng.sample(sorted({c >> 9 for c in n}), 60), 0x20202020, 0x61626300, 0xFFFFFFFF]:
        inside = {c: k for c, k in n.items() if (c >> 9) & 0xFFFF == context & 0xFFFF}
        asked = {(context << 9) | s: 0 for s in range(257)} | inside
        code = np.array(sorted(asked), np.int64)
        p = 10 ** lm_score.code_lengths(code, np.array([asked[c] for c in code.tolist()]), one)
        assert p[code >> 9 == context].sum() == pytest.approx(1, abs=1e-9)


def test_grams_are_whole_however_they_are_cut():
    texts = pa.array(["abc", None, "", "é" * 50, "x" * 1000])
    whole = [np.concatenate(x) for x in zip(*lm_score.grams(texts), strict=True)]
    for step in (1, 7, 64):
        cut = [np.concatenate(x) for x in zip(*lm_score.grams(texts, step), strict=True)]
        assert all((a == b).all() for a, b in zip(whole, cut, strict=True))
    assert len(whole[0]) == 3 + 100 + 1000 + 5 and (np.bincount(whole[1]) == [4, 1, 1, 101, 1001]).all()


def test_without_training_rows_and_without_rows(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r.id: r for r in lm_score.score_texts(docs, F.lit(True)).collect()}
    assert got[1].score == pytest.approx(-3 * math.log10(257)) and got[2].n_tokens == 1 and got[2].n_known == 0 and got[1].train_tokens == 0
    assert got[1].base_score == pytest.approx(0)
    assert lm_score.score_texts(docs.where("false"), F.lit(True)).count() == 0


def test_held_out_texts_are_told_from_noise(spark):
    """A model of one tongue gives held-out texts of it fewer bits a byte than it gives others."""
    rng = random.Random(8)
    tongue = lambda bits: " ".join("".join(rng.choice(bits) for _ in range(3)) for _ in range(60))
    own, other = ["ka", "lo", "mi", "ren", "tu"], ["zh", "xo", "bby", "wq", "ft"]
    rows = [(i, tongue(own)) for i in range(120)] + [(1000 + i, tongue(other)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: -r.score / len(t) for (i, t), r in zip(rows, sorted(lm_score.score_texts(docs, F.col("doc_id") >= 100).collect(), key=lambda r: r.id), strict=True)}
    assert max(got[i] for i in range(100, 120)) * 2 < min(got[i] for i in range(1000, 1020))


def test_scoring_takes_little_memory_beside_what_was_told():
    """A portion's look-ups make no hash table of all grams that it was told."""
    r = np.random.default_rng(3)
    texts = [bytes(r.integers(97, 123, 400, dtype=np.uint8)).decode() for _ in range(50)]
    part = pa.table({"id": range(50), "held": [False] * 50, "text": texts}).to_batches()[0]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, part.schema) as writer:
        writer.write_batch(part)
    own = np.concatenate([code for code, _ in lm_score.grams(part["text"])])
    code = r.permutation(np.union1d(own, r.integers(0, 1 << 41, 1 << 20)))
    value = -(code % 97) / 8.0
    told = pa.table({"q": np.zeros(len(code), np.int64), "code": code, "word": pa.nulls(len(code), pa.binary()), "value": value})
    before, pool = pa.default_memory_pool(), pa.proxy_memory_pool(pa.default_memory_pool())
    pa.set_memory_pool(pool)
    try:
        got = lm_score._score(1000, 10, 50)(None, pa.table({"rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())}), told)
    finally:
        pa.set_memory_pool(before)
    assert np.allclose(got["score"].to_numpy(), (-(own % 97) / 8.0).reshape(50, 401).sum(1))
    assert pool.max_memory() < 64 << 20
