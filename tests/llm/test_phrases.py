import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.llm import phrases

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        yield re.findall(r"[^\x20\x09]+", piece)


def plain_counts(rows):
    f = Counter()
    for _, text, lang, *_ in rows:
        for w in pieces(text):
            for k in (1, 2, 3, 4):
                for s in range(len(w) - k + 1):
                    f[(lang or "und", tuple(w[s : s + k]))] += 1
    return f


def plain(rows, least, top=2000):
    f = plain_counts(rows)
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        cuts = [(2_000_000 * a // (f[lang, p[:c]] + f[lang, p[c:]]), c) for c in range(1, len(p))]
        score, c = min(cuts)
        out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:c]], f[lang, p[c:]], p))
    held = Counter()
    for (lang, p), a in f.items():
        if len(p) > 2 and a >= least:
            for m in range(2, len(p)):
                for s in range(len(p) - m + 1):
                    held[lang, p[s : s + m]] = max(held[lang, p[s : s + m]], a)
    out = sorted(x for x in out if 100 * held[x[0], x[-1]] < 80 * -x[2])
    n, rank, rows = Counter(), Counter(), []
    for (lang, p), a in f.items():
        n[lang] += a * (len(p) == 1)
    for lang, score, a, p, left, right, _ in out:
        rank[lang] += 1
        if rank[lang] <= top:
            rows.append((lang, rank[lang], p.decode(), -a, left, right, n[lang], -score))
    return sorted(rows)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    common = ["in the End of", "new York", "a b a b", "über  den Wolken\tüber", "x.y;z w", "New\x0byork x"]
    out = []
    for i in range(160):
        text = [rng.choice(common) if rng.random() < 0.4 else f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 80))]
        out.append((i, rng.choice([" ", ", ", " ", "\n"]).join(text) + rng.choice(["", ".", " !"]), rng.choice(["en", "en", "de", None, "und"]), "s", 1))
    long = " ".join(f"w{rng.randrange(40)}" for _ in range(30_000))
    return [*out, *out[:20], (900, None, "en", None, None), (901, "", None, None, None), (902, " \t\n", "de", None, None), (903, "same " * 500, "en", None, None), (None, long, "en", None, None)]


def told(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_collocations(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).withColumns({"phrase": F.lit("clash"), "words": F.lit(1)}).repartition(3)
    want = plain(rows, 30)
    assert told(phrases.collocations(docs)) == want and len(want) > 40
    assert told(phrases.collocations(docs, top=7)) == plain(rows, 30, 7)
    assert phrases.collocations(docs.where("false")).count() == 0


def test_spills_bursts_and_large_partitions_change_nothing(spark, rows, monkeypatch):
    """Small tries, containers, steps and partitions: every way out is taken, and the counts stay."""
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    f = plain_counts(rows)
    monkeypatch.setattr(phrases.HatTrie.__init__, "__defaults__", (5,))
    words, found = phrases.phrase_counts(docs, least=9, part_paths=40, memory=300, step=500)
    assert {(r.lang, r.phrase): r.f for r in words.collect()} == {(lang, p[0]): n for (lang, p), n in f.items() if len(p) == 1}
    assert {(r.lang, r.phrase): r.f for r in found.collect()} == {(lang, " ".join(p)): n for (lang, p), n in f.items() if len(p) > 1 and n >= 9}


def test_trie_spills_whole_subtrees():
    t, rng, want = phrases.HatTrie(burst=3), random.Random(1), Counter()
    got = Counter()

    def out(keep):
        taken = list(zip(*(x.tolist() for x in t.spill(keep)), strict=True))
        assert t.size <= keep and t.size == len(want - got) - len(taken)
        assert not {r for r, *_ in taken} & {*t.flat, *t.deep}
        got.update({(r, s): n for r, s, n in taken})

    for _ in range(2000):
        r, s = rng.randrange(9), (rng.randrange(4) << 42) | rng.randrange(30)
        t.add(r, [s, s])
        want[r, s] += 2
    out(200)
    out(0)
    assert got == want


def test_scores_pass_64_bits(spark, monkeypatch):
    big = 10**14
    words = spark.createDataFrame([("en", "a", 3 * big), ("en", "b", 2 * big)], "lang string, phrase string, f long")
    found = spark.createDataFrame([("en", 2, "a b", 2 * big - 1)], "lang string, k int, phrase string, f long")
    monkeypatch.setattr(phrases, "phrase_counts", lambda *a: (words, found))
    assert told(phrases.collocations(words)) == [("en", 1, "a b", 2 * big - 1, 3 * big, 2 * big, 5 * big, 2_000_000 * (2 * big - 1) // (5 * big))]


def test_equal_pairs_are_counted_before_the_trie():
    """A text of 2000 words that repeats two pairs gives the trie each distinct pair once, with all its occurrences."""
    given = []

    class Watched(phrases.HatTrie):
        def add(self, root, suffixes, counts=None):
            given.extend([1] * len(suffixes) if counts is None else counts)
            super().add(root, suffixes, counts)

    c = phrases._Counter(16, 1 << 10, 2)
    c.trie, c.langs = Watched(burst=1), {"en": 0}
    ids = c.ids_of([b"a", b"b"] * 1000)
    c.add(ids, 0 * ids, np.full(2000, 2).clip(max=2000 - np.arange(2000)), 2)
    assert sorted(given) == [999, 1000]
    root, suffix, n = c.trie.spill(0)
    assert sorted(zip(root.tolist(), (suffix >> 2 * phrases.WORD_BITS).tolist(), n.tolist())) == [(0, 2, 1000), (1, 1, 999)]
