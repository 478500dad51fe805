"""Every stage of the pipeline against a brute-force version on the same rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline as p
import numpy as np
import pytest
from tapewright.llm import lang_id
from tapewright.llm.store import finished, shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PARTS = {"aa": ["tion", "the", "ing", "of", "and"], "bb": ["ung", "der", "sch", "ß", "ei"]}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(31)
    out = []
    for i in range(120):
        lang = rng.choice(list(PARTS))
        text = " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(30, 120)))
        out.append((i, text, lang if i % 5 else None, f"s{i % 4}" if i % 9 else None, len(text)))
    t = out[3][1].split()
    near = " ".join([*t[:10], "changed", *t[11:]])
    extra = [out[0][1], out[0][1] + " ", out[1][1].replace(" ", "\n"), near, None, "", " \t", "12 !?", "the", "我们的目标是建立一个完整的系统" * 5]
    out += [(200 + k, x, "aa" if k % 2 else None, "s1", 0) for k, x in enumerate(extra)]
    return [*out, out[7], (None, out[8][1], None, None, None), (None, "a text of its own with the and the ing", None, "s2", 1)]


def language(docs):
    import pandas as pd  # noqa: F401

    model = docs["model"]
    least = (0.5 + 1 / len(model.languages)) / 2
    out = []
    for r in docs["rows"]:
        if r[1] and re.search("[^\\W\\d_]", r[1]):
            s = model.scores([r[1]])[0]
            if min(1, (1 + s.max()) / 2) >= least:
                out.append((*r[:2], r[2] or model.languages[int(s.argmax())], *r[3:]))
    return out


def exact(rows):
    best = {}
    for r in rows:
        k = re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")
        rank = (-len(r[1] or ""), r[0] is None, r[0] or 0)
        if k not in best or rank < best[k][0]:
            best[k] = (rank, r)
    return [r for _, r in best.values()]


def near(rows):
    def grams(t):
        w = WORD.findall(t or "")
        return frozenset(tuple(w[s : s + 5]) for s in range(max(1, len(w) - 4))) if w else frozenset()

    sets, label = [grams(r[1]) for r in rows], list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    least = defaultdict(lambda: None)
    for r, x in zip(rows, label):
        if r[0] is not None:
            least[x] = r[0] if least[x] is None else min(least[x], r[0])
    return [r for r, x in zip(rows, label) if r[0] == least[x]]


def mixed(rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, total = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, sum(sizes.values())
    rate = 0.0
    while True:
        held = [s for s in order if weight[s] * rate > 3 * sizes[s]]
        free = sum(weight[s] for s in order if s not in held)
        now = (total - sum(3 * sizes[s] for s in held)) / free if free else rate
        if now <= rate:
            break
        rate = now
    out = []
    for s in order:
        budget, at = math.floor(min(weight[s] * rate, 3 * sizes[s]) + 0.5), 0
        md5 = lambda r: hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest()
        for r in sorted((r for r in rows if r[3] == s), key=lambda r: (int(md5(r)[:3], 16), md5(r))):
            n = len(WORD.findall(r[1] or ""))
            if n:
                taken = budget // sizes[s] * n + max(0, min(at + n, budget % sizes[s]) - at)
                out += [r] * math.floor(taken / n + 0.5)
            at += n
    return out


def pieces(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = Counter()
    for r in rows:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for s in range(0, len(ids), 2048):
            out[(r[0], s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes()), len(ids))] += 1
    return out


def test_stages(spark, rows):
    d = spark.createDataFrame(rows, DOCS)
    model = lang_id.train(d, ~lang_id.held_out())
    naive = [lambda x: language({"rows": x, "model": model}), exact, near, mixed]
    assert [n for n, _ in p.STAGES] == ["language ID", "exact dedup", "n-gram Jaccard join", "mixing to target weights", "packing"]
    for (name, f), g in zip(p.STAGES, naive):
        before = [tuple(r) for r in d.collect()]
        d = f(spark, d, "").persist()
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert Counter(tuple(r) for r in d.collect()) == Counter(g(before)), name
    before = [tuple(r) for r in d.collect()]
    got = p.STAGES[4][1](spark, d, "").collect()
    assert Counter(tuple(r)[:5] for r in got) == pieces(before)
    seq = defaultdict(list)
    for r in got:
        seq[r.sequence_id].append((r.offset, r.length))
    for v in seq.values():
        v.sort()
        assert v[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(v, v[1:])) and sum(v[-1]) <= 2048


def test_rejects_other_languages(spark, rows):
    d = spark.createDataFrame(rows, DOCS)
    kept = {r.doc_id for r in p.language_stage(spark, d, "").collect()}
    assert set(range(120)) <= kept and not kept & {204, 205, 206, 207}
    only = lang_id.keep_known(d, languages=["aa"]).where("doc_id < 120").collect()
    assert {r.doc_id for r in only if r.doc_id % 5} == {r[0] for r in rows[:120] if r[2] == "aa"} and all(r.lang == "aa" for r in only)


def test_stages_without_rows_or_labels(spark, rows):
    d = spark.createDataFrame(rows, DOCS)
    for name, f in p.STAGES:
        assert f(spark, d.where("false"), "").count() == 0, name
    bare = spark.createDataFrame([(*r[:2], None, *r[3:]) for r in rows], DOCS)
    assert p.language_stage(spark, bare, "").count() == sum(bool(r[1] and re.search("[^\\W\\d_]", r[1])) for r in rows)


def test_run_resumes(spark, rows, tmp_path):
    spark.createDataFrame(rows[:60], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    first = p.run(spark, str(tmp_path), resume=f"r{tmp_path.name}-{random.random()}")
    name = first.inputFiles()[0].split("/")[-3]
    assert finished(spark, f"{shared_dir(spark)}/{name}/0-language-ID")
    again = p.run(spark, str(tmp_path), resume=name)
    assert Counter(map(tuple, first.collect())) == Counter(map(tuple, again.collect())) and first.count() > 0
    assert Counter(tuple(r)[:5] for r in p.run(spark, str(tmp_path)).collect()) == Counter(tuple(r)[:5] for r in first.collect())
