"""The thin queries over the operators of this subpackage, with their production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapewright.llm.mixing import mix, word_count

    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", word_count("text").alias("size"))
    return mix(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "first_slot", "n_slots")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapewright.llm.exact_dedup import exact_groups, normalised

    docs = _read(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", F.sha2(normalised("text"), 256).alias("text_sha256"))
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapewright.llm.substring_dedup import remove_repeats

    out = remove_repeats(_read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapewright.llm.jaccard_join import near_duplicates

    out = near_duplicates(_read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "class_id", "rep_id", "n_links", "n_grams")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapewright.llm.packing import pack

    return pack(_read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapewright.llm.lang_id import held_out, predict, train

    docs = _read(spark, sf_dir, "documents")
    model = train(docs, ~held_out())
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapewright.llm.pii import KINDS, find_personal_data

    out = find_personal_data(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda test, c="spans": F.filter(c, lambda s: test(s["kind"]))
    # Of the contract's patterns; what the random field adds is in spans, secrets and n_all.
    counts = [F.size(of(lambda k, kind=kind: k == kind, "base")).cast("long").alias(f"n_{kind}") for kind in KINDS]
    secret = of(lambda k: k == "secret")
    found = [F.size(secret).cast("long").alias("n_secret"), line(secret).alias("secrets"), F.size("spans").cast("long").alias("n_all")]
    return out.select("doc_id", *counts, F.sha2(line("base"), 256).alias("base_sha256"), line(of(lambda k: k != "secret")).alias("spans"), *found)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapewright.llm.embed_dedup import near_vectors

    return near_vectors(_read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapewright.llm.license_scan import scan_licenses

    out = scan_licenses(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",")
    spans = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"], m["end"])), ",")
    return out.select("doc_id", F.size("matches").cast("long").alias("n_matches"), names.alias("licenses"), spans.alias("spans"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapewright.llm.chat_format import format_conversations, read_back

    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(n).cast("long").alias("turn"),
        F.lit(role).alias("role"), F.lit(said).alias("text")) for n, role in enumerate(("user", "assistant"))])).alias("x")).select("x.*")
    return read_back(format_conversations(rows.unionByName(own))).drop("n_tokens", "n_loss_tokens")


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapewright.llm.phrases import collocations

    return collocations(_read(spark, sf_dir, "documents"))


def op12_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapewright.llm.lm_score import held_out, score_texts

    return score_texts(_read(spark, sf_dir, "documents"), held_out()).withColumnRenamed("id", "doc_id")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapewright.llm.merkle import leaf_hash, prove

    docs = _read(spark, sf_dir, "documents")
    head, cut = ("doc_id", "source", "lang", "n_chars"), F.replace("text", F.lit("\n"), F.lit(""))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    rows = docs.select("doc_id", "source", leaf_hash(*head, "text").alias("leaf"), leaf_hash(*head, F.when(tampered, cut).otherwise(F.col("text"))).alias("claimed"))
    out = prove(rows, "doc_id", claimed_col="claimed")
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


OP10_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       first_value(doc_id) OVER w = doc_id AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY len DESC, doc_id)
"""

OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(doc_id::VARCHAR) AS h FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS ss, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM d GROUP BY source),
r AS (
  SELECT 0 AS i, 0.0::DOUBLE AS rate, NULL::DOUBLE AS before
  UNION ALL
  SELECT r.i + 1, ((SELECT sum(ss) FROM s) - (SELECT coalesce(sum(CASE WHEN w * r.rate > 3 * ss THEN 3.0 * ss END), 0.0) FROM s))
                  / (SELECT sum(CASE WHEN w * r.rate > 3 * ss THEN 0.0 ELSE w END) FROM s), r.rate
  FROM r WHERE r.i < 40 AND (r.before IS NULL OR r.rate > r.before)),
t AS (SELECT source, ss, least(w * (SELECT max(rate) FROM r), 3.0 * ss) AS target FROM s),
l AS (
  SELECT d.*, (('0x' || h[1:3])::INT) % 4096 AS run FROM d),
o AS (
  SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY run, h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM l),
z AS (SELECT o.*, t.ss, t.target, round(t.target)::BIGINT AS budget FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT source, ss, greatest(1, least(greatest(64, least(4096, (SELECT sum(ss) FROM s) // 65536)), ceil(ss / 16)))::BIGINT AS block, round(target)::BIGINT AS budget FROM t),
e AS (SELECT *, budget // greatest(ss, 1) AS passes, budget % greatest(ss, 1) AS rest, ceil(ss / block)::BIGINT AS blocks FROM c),
k AS (SELECT *, (passes * blocks + ceil(rest / block))::BIGINT AS slots FROM e),
i AS (SELECT *, sum(slots) OVER (ORDER BY source NULLS LAST)::BIGINT AS hi, sum(slots) OVER ()::DOUBLE AS whole FROM k WHERE slots > 0),
j AS (SELECT j, j * 0.6180339887498949::DOUBLE - floor(j * 0.6180339887498949::DOUBLE) AS u FROM (SELECT unnest(range(3 * (SELECT max(whole) FROM i)::BIGINT)) AS j)),
q AS (
  SELECT i.*, j, row_number() OVER (PARTITION BY source ORDER BY j) - 1 AS rank FROM j JOIN i ON u >= (hi - slots) / whole AND u < hi / whole QUALIFY rank < slots),
b AS (
  SELECT source, j, rank % blocks AS b, (rank % blocks) * block AS lo, least((rank % blocks + 1) * block, CASE WHEN rank // blocks = passes THEN rest ELSE ss END) AS up FROM q),
n AS (
  SELECT doc_id, start, min(j) AS first_slot, count(*) AS n_slots FROM z JOIN b ON z.source IS NOT DISTINCT FROM b.source AND b.lo < z.start + z.size AND b.up > z.start
  WHERE z.size > 0 GROUP BY doc_id, start)
SELECT z.doc_id, size, ss AS source_size, target,
       (CASE WHEN size = 0 THEN 0 ELSE (budget // ss) * size + greatest(0, least(z.start + size, budget % ss) - z.start) END)::BIGINT AS taken,
       first_slot, coalesce(n_slots, 0)::BIGINT AS n_slots
FROM z LEFT JOIN n ON n.doc_id = z.doc_id AND n.start = z.start AND z.size > 0
"""

OP1_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 48, 1))) AS s, w FROM w),
h AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS h FROM p),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY h) AS first FROM h) WHERE first < doc_id),
g AS (SELECT doc_id, list_distinct(flatten(list(range(s, s + 50)))) AS gone FROM r GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE
         list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN g ON w.doc_id = g.doc_id
"""

OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS s FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS overlap FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE overlap >= 0.8 * (x.n + y.n - overlap)),
s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, s.b FROM reach JOIN s ON reach.b = s.a),
cl AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a),
li AS (SELECT a, count(*) AS n_links FROM s GROUP BY a)
SELECT d.doc_id, cl.class_id, coalesce(min(d.doc_id) OVER (PARTITION BY coalesce(n.k, d.doc_id::VARCHAR)), d.doc_id) AS rep_id,
       coalesce(n_links, 0)::BIGINT AS n_links, coalesce(n.n, 0)::BIGINT AS n_grams
FROM documents d JOIN cl ON d.doc_id = cl.a LEFT JOIN li ON d.doc_id = li.a LEFT JOIN n ON d.doc_id = n.doc_id
"""

OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n,
         embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AS ok FROM embeddings),
g AS (SELECT vec_id, list_transform(e, lambda x: x / n) AS u FROM v WHERE ok AND n > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.u) = len(b.u) AND list_inner_product(a.u, b.u) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
l AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT c.a AS vec_id, coalesce(l.n, 0)::BIGINT AS n_links, component_id, c.a = component_id AS kept FROM c LEFT JOIN l ON c.a = l.a
"""

OP8_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 24 AS size FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(size)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS s FROM w),
f AS (
  SELECT lang, k, array_to_string(w[s:s + k - 1], ' ') AS phrase, count(*) AS f FROM s, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE s + k - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
u AS (
  SELECT c.lang, c.phrase, a, cut, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')),
b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (
  SELECT lang, phrase, max(a) AS over FROM (
    SELECT lang, a, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda s: array_to_string(w[s:s + m - 1], ' '))))) AS phrase FROM c)
  GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
FROM b JOIN n ON b.lang = n.lang LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.over IS NULL OR 100 * i.over < 80 * a
QUALIFY rank <= 2000
"""

#: CRC-32 byte by byte, by a table made of its polynomial; hash trees level by level.
OP13_SQL = r"""
WITH RECURSIVE k AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, x: xor(c >> 1, (c & 1) * 3988292384))) AS t),
c AS (
  SELECT doc_id, source, lang, n_chars, text, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])) % 2 = 1 AS tampered FROM documents, k),
f AS (
  SELECT doc_id, source, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    text, CASE WHEN tampered THEN replace(text, chr(10), '') ELSE text END AS now FROM c),
l AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(now) || ':' || now, '-')) AS claimed FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS slot, count(*) OVER (PARTITION BY source) AS n FROM l),
tree AS (
  SELECT source, 0 AS level, slot, leaf AS h, n FROM p
  UNION ALL
  SELECT source, level + 1, slot // 3, sha256(string_agg(h, '' ORDER BY slot)), (n + 2) // 3 FROM tree WHERE n > 1 GROUP BY source, level, slot // 3, n),
sub AS (SELECT source, level AS height, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS slot, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS level, slot, h, n FROM sub
  UNION ALL
  SELECT level + 1, slot // 3, sha256(string_agg(h, '' ORDER BY slot)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY level, slot // 3, n),
node AS (
  SELECT s.slot AS t, t.level, t.slot, t.h FROM tree t JOIN sub s ON t.source IS NOT DISTINCT FROM s.source
  UNION ALL SELECT -1, level, slot, h FROM top),
run AS (SELECT t, level, slot // 3 AS up, list(h ORDER BY slot) AS hs FROM node GROUP BY ALL),
step AS (
  SELECT p.doc_id, p.slot AS slot0, s.slot AS t, s.height, p.claimed AS h, p.slot, 0 AS level, '' AS proof FROM p JOIN sub s ON p.source IS NOT DISTINCT FROM s.source
  UNION ALL
  SELECT doc_id, slot0, x.t, x.height, sha256(array_to_string(list_concat(hs[:x.slot % 3], [x.h], hs[x.slot % 3 + 2:]), '')), x.slot // 3, x.level + 1,
         proof || array_to_string(list_concat(hs[:x.slot % 3], hs[x.slot % 3 + 2:]), '')
  FROM (SELECT doc_id, slot0, proof, h, CASE WHEN level < height THEN t ELSE -1 END AS t, height, CASE WHEN level < height THEN slot
               WHEN level = height THEN t ELSE slot END AS slot, level FROM step WHERE level < height + (SELECT max(level) FROM top)) x
  JOIN run ON run.t = x.t AND run.level = CASE WHEN x.t = -1 THEN x.level - x.height ELSE x.level END AND run.up = x.slot // 3)
SELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = r.h AS verified
FROM p JOIN sub s ON p.source IS NOT DISTINCT FROM s.source JOIN (SELECT h FROM top WHERE n = 1) r ON true
JOIN step e ON e.doc_id = p.doc_id AND e.level = s.height + (SELECT max(level) FROM top)
"""

#: name: (query, SQL or None)
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_substring_dedup": (op1_substring_dedup, OP1_SQL),
    "op2_mixing": (op2_mixing, OP2_SQL),
    "op3_pii": (op3_pii, None),
    "op4_packing": (op4_packing, None),
    "op5_embedding_dedup": (op5_embedding_dedup, OP5_SQL),
    "op6_license_scan": (op6_license_scan, None),
    "op8_chat_format": (op8_chat_format, OP8_SQL),
    "op9_language_id": (op9_language_id, None),
    "op7_ngram_jaccard": (op7_ngram_jaccard, OP7_SQL),
    "op10_exact_dedup": (op10_exact_dedup, OP10_SQL),
    "op11_phrase_mining": (op11_phrase_mining, OP11_SQL),
    "op12_lm_score": (op12_lm_score, None),
    "op13_merkle_manifest": (op13_merkle_manifest, OP13_SQL),
}
