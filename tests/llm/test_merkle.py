import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tapewright.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(*fields):
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def brute(rows):
    """rows: (id, group, leaf, claimed); (id, group, slot, leaf, subroot, root, proof, folded) each."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)

    def path(hs, at):
        out = []
        while len(hs) > 1:
            run = at - at % 3
            out.append((hs[run:at], hs[at + 1 : run + 3]))
            hs, at = [sha("".join(hs[i : i + 3])) for i in range(0, len(hs), 3)], at // 3
        return hs[0], out

    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[3]))
    subs = [path([r[2] for r in groups[g]], 0)[0] for g in names]
    out = []
    for n, g in enumerate(names):
        for at, r in enumerate(groups[g]):
            sub, low = path([x[2] for x in groups[g]], at)
            root, high = path(subs, n)
            h = r[3]
            for left, right in low + high:
                h = sha("".join([*left, h, *right]))
            out.append((r[0], g, at, r[2], sub, root, sha("".join("".join(a + b) for a, b in low + high)), h))
    return sorted(out, key=repr)


def told(df):
    cols = ("id", "group", "slot", "leaf", "subroot", "root", "proof_sha256", "folded_root")
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_leaf_hash(spark):
    rows = [(1, "é\nx", None, "s", 3), (None, None, "en", None, None), (-7, "", "", "", 0), (5, "x" * 300_000, "de", "s", 1)]
    got = spark.createDataFrame(rows, DOCS).select("doc_id", merkle.leaf_hash("doc_id", "source", "lang", "n_chars", "text").alias("h")).collect()
    assert {r.doc_id: r.h for r in got} == {i: leaf(i, s, lang, n, t) for i, t, lang, s, n in rows}


@pytest.mark.parametrize("step", [12, 9])
def test_manifest_is_that_of_a_plain_tree(spark, monkeypatch, step):
    monkeypatch.setattr(merkle, "STEP", step)
    rng = random.Random(3)
    rows = []
    for group, n in (("a", 800), (None, 30), ("b", 1), ("ä", 3), ("", 10), *((f"s{i}", rng.randrange(1, 9)) for i in range(20))):
        ids = rng.sample(range(-500, 3000), n)
        rows += [(i, group, sha(f"{group}{i}"), sha(f"{group}{i}{i % 7 // 6}")) for i in ids]
    rows += [(rows[0][0], "a", sha(f"again{i % 9}"), sha("x")) for i in range(40)]  # repeated ids, some of equal rows
    rows += [rows[3]] * 5 + [(None, "a", sha("void"), sha("void")), (None, "a", sha("void2"), sha("void2")), (2**63 - 1, "a", sha("far"), sha("far"))]
    df = spark.createDataFrame(rows, "id long, source string, leaf string, claimed string").withColumns({"slot": F.lit(0), "tree": F.lit("clash"), "root": F.lit("clash")})
    got = merkle.prove(df, claimed_col="claimed", with_path=True).persist()
    assert told(got) == brute(rows)
    for r in got.where("verified").limit(40).collect():
        assert merkle.fold(r.leaf, r.path) == r.root and sha(r.path.replace("|", "").replace(",", "")) == r.proof_sha256
    assert 0 < got.where("NOT verified").count() < got.count()
    assert merkle.prove(df.repartition(7)).where("NOT verified").count() == 0


def test_manifest_of_few_rows(spark):
    df = spark.createDataFrame([(7, None, sha("x"))], "id long, source string, leaf string")
    (only,) = merkle.prove(df).collect()
    assert only.root == only.subroot == only.leaf == only.folded_root and only.proof_sha256 == sha("") and only.verified
    assert merkle.prove(df.where("false")).count() == 0
