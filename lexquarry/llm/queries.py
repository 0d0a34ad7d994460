"""The numbered operators applied to their whole tables with production parameters, by query name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.llm import bpe, decontaminate, licenses, linededup, merkle, partenum, pii, quality, resampling, secrets, suffixes, tokenfiles, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scanned(_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.deduped(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(_table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.judged(docs, model).drop("text")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduped(_table(spark, sf_dir, "documents")).drop("kept")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.joined(_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.records(warc.written(_table(spark, sf_dir, "pages")), payloads=False)
    # an archive that can't be read to its end must not pass for a short one
    broken = F.raise_error(F.concat_ws(": ", "archive", "error")).cast("boolean")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.when(F.col("error").isNotNull(), broken).otherwise(F.col("verified")).alias("verified"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(*merkle.FIELDS)
    tampered = F.expr("n_chars + if(crc32(cast(doc_id AS string)) % 7 = 0, 1, 0)")
    changed = merkle.leaf(*(tampered if c == "n_chars" else F.col(c) for c in merkle.FIELDS))
    proofs = merkle.proved(docs, merkle.leaf(*map(F.col, merkle.FIELDS)), keep=("doc_id", changed.alias("changed")))
    found = merkle.folded(F.col("changed"), F.col("proof"))
    return proofs.select("doc_id", "leaf", "subroot", "root", merkle.siblings_hash(F.col("proof")).alias("proof_sha256"), found.alias("folded_root")).withColumn("verified", F.expr("folded_root = root"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampling.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.digests(tokenfiles.read(spark, tokenfiles.written(_table(spark, sf_dir, "documents"))))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM (SELECT *, least(10, len(w)) AS k FROM i WHERE len(w) > 0))),
dw AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM iw))),
h AS (SELECT doc_id, p, k, item_id FROM dw JOIN iw USING (k, g)),
hit AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS x FROM h) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, first_value(page_id) OVER (PARTITION BY coalesce(html, '') ORDER BY page_id) AS first FROM pages)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, 1 + 10 * CAST(i // 8 AS INTEGER), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to, true AS verified
FROM p
"""

OP3_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
h AS (SELECT doc_id, l, len(l) AS n, list_transform(l, lambda x: CAST('0x' || substr(md5(x), 1, 8) AS BIGINT)) AS h FROM d),
b AS (SELECT doc_id, l, n, list_filter(range(1, n + 1), lambda i: i = n OR (i > 1 AND (h[i] + 31 * h[i - 1]) % 64 < 32)) AS b FROM h),
i AS (SELECT doc_id, l, n, b, unnest(range(1, n + 1)) AS i FROM b),
c AS (SELECT doc_id, l, i AS s, least(i + 15, n, coalesce(list_min(list_filter(b, lambda j: j > i)), n)) AS e FROM i
  UNION SELECT doc_id, l, greatest(i - 15, 1, 1 + coalesce(list_max(list_filter(b, lambda j: j < i)), 0)) AS s, i AS e FROM i),
t AS (SELECT doc_id, s, e, array_to_string(l[s:e], chr(10)) AS t FROM c WHERE e > s),
f AS (SELECT doc_id, s, e, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) > 1 AS gone FROM t WHERE length(t) >= e - s + 1),
g AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM f WHERE gone),
k AS (SELECT i.doc_id, i.i, i.l[i.i] AS line, g.i IS NOT NULL AS gone FROM i LEFT JOIN g ON g.doc_id = i.doc_id AND g.i = i.i)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed_lines, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM k GROUP BY doc_id
"""
_WORDS_5 = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_5.format("text")} AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
ph(p, label) AS (VALUES {", ".join(f"('{p}', '{x}')" for p, x in licenses.PHRASES.items())}),
pl AS (SELECT doc_id, label, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) JOIN ph ON array_to_string(w[i:i + len(string_split(p, ' ')) - 1], ' ') = p),
base AS (SELECT doc_id, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word FROM pl GROUP BY 1),
tp(label, t) AS (SELECT label, list_distinct({_WORDS_5.format("t")}) FROM (VALUES {", ".join(f"('{x}', '{t}')" for x, t in licenses.TEMPLATES)}) v(label, t)),
ln AS (SELECT doc_id, list_distinct({_WORDS_5.format("x")}) AS b FROM (SELECT doc_id, unnest(lines) AS x FROM d)),
m AS (SELECT doc_id, label, len(list_intersect(b, t)) / len(t) AS c FROM ln JOIN tp ON len(list_intersect(b, t)) >= ceil({licenses.CONTAINED} * len(t) - 1e-9)),
score AS (SELECT doc_id, max(c) AS score FROM m GROUP BY 1),
one AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT doc_id, label FROM pl) GROUP BY 1),
two AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM pl UNION SELECT doc_id, label FROM m) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN score USING (doc_id) LEFT JOIN one USING (doc_id) LEFT JOIN two USING (doc_id)
"""
OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY 1) USING (doc_id)
"""

#: crc32 of a string's UTF-8 bytes: a table of 256 remainders, then a fold over the bytes.
_CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], list_transform(range(8), lambda z: 0::BIGINT)), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab"
_CRC = "xor(list_reduce(list_concat([4294967295], list_transform(range(octet_length(encode({0}))), lambda i: CAST('0x' || substr(hex(encode({0})), CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"
_FIELD = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in merkle.FIELDS) + ")"
OP11_SQL = f"""
WITH RECURSIVE crc AS ({_CRC_TABLE}),
d AS (SELECT doc_id, lang, {_LEAF} AS leaf, CASE WHEN {_CRC.format("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_LEAF.replace("n_chars", "(n_chars + 1)")} ELSE {_LEAF} END AS changed FROM documents, crc),
i AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS i FROM d),
up(lang, k, h) AS (
  SELECT lang, 0, list(leaf ORDER BY i) FROM i GROUP BY lang
  UNION ALL SELECT lang, k + 1, list_transform(range((len(h) + 1) // 2), lambda j: sha256(h[2 * j + 1] || coalesce(h[2 * j + 2], ''))) FROM up WHERE len(h) > 1),
sub AS (SELECT lang, h[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS j FROM up WHERE len(h) = 1),
top(k, h) AS (
  SELECT 0, list(subroot ORDER BY j) FROM sub
  UNION ALL SELECT k + 1, list_transform(range((len(h) + 1) // 2), lambda j: sha256(h[2 * j + 1] || coalesce(h[2 * j + 2], ''))) FROM top WHERE len(h) > 1),
steps AS (
  SELECT i.lang, i, k, (i >> k) % 2 AS slot, coalesce(h[xor(i >> k, 1) + 1], '') AS s FROM i JOIN up ON i.lang IS NOT DISTINCT FROM up.lang AND len(h) > 1
  UNION ALL SELECT i.lang, i, 1000 + k, (j >> k) % 2, coalesce(h[xor(j >> k, 1) + 1], '') FROM i JOIN sub ON i.lang IS NOT DISTINCT FROM sub.lang, top WHERE len(h) > 1),
proofs AS (SELECT lang, i, string_agg(s, '' ORDER BY k) AS p, list({{'slot': slot, 's': s}} ORDER BY k) AS l FROM steps GROUP BY 1, 2),
f AS (SELECT doc_id, leaf, subroot, (SELECT h[1] FROM top WHERE len(h) = 1) AS root, sha256(coalesce(p, '')) AS proof_sha256,
  list_reduce(list_concat([{{'slot': 0::BIGINT, 's': changed}}], coalesce(l, [])), lambda a, x: {{'slot': 0::BIGINT, 's': sha256(CASE WHEN x.slot = 1 THEN x.s || a.s ELSE a.s || x.s END)}}).s AS folded_root
  FROM i JOIN sub ON i.lang IS NOT DISTINCT FROM sub.lang LEFT JOIN proofs p ON p.lang IS NOT DISTINCT FROM i.lang AND p.i = i.i)
SELECT *, folded_root = root AS verified FROM f
"""
_WORDS_12 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH crc AS ({_CRC_TABLE}),
d AS (SELECT doc_id, {_WORDS_12} AS w FROM documents),
dw AS (SELECT doc_id, unnest(w) AS word FROM d),
tw AS (SELECT unnest({_WORDS_12}) AS word FROM benchmark),
v AS MATERIALIZED (SELECT word, {_CRC.format("word")} % {resampling.BUCKETS} AS b FROM (SELECT word FROM dw UNION SELECT word FROM tw), crc),
s AS (SELECT b, count(*) AS s FROM dw JOIN v USING (word) GROUP BY 1),
t AS (SELECT b, count(*) AS t FROM tw JOIN v USING (word) GROUP BY 1),
g AS (SELECT b, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * (coalesce((SELECT sum(s) FROM s), 0) + {resampling.BUCKETS}) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * (coalesce((SELECT sum(t) FROM t), 0) + {resampling.BUCKETS})))) AS BIGINT) AS g FROM s FULL JOIN t USING (b)),
w AS (SELECT doc_id, count(*) AS n, sum(g) AS total FROM dw JOIN v USING (word) JOIN g USING (b) GROUP BY 1),
x AS (SELECT doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(floor(total / n), 0) AS BIGINT) AS weight, CAST('0x' || substr(sha256('{resampling.SEED}:' || doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN w USING (doc_id)),
y AS (SELECT doc_id, n_features, weight, CAST(weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM x),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM y WHERE n_features >= {resampling.MIN_WORDS}),
k AS (SELECT {resampling.PERCENT} * count(*) // 100 AS k FROM r)
SELECT y.*, CASE WHEN rank <= k THEN rank END AS rank FROM y LEFT JOIN r USING (doc_id), k
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_pii": op2_pii,
        "op3_line_dedup": op3_line_dedup,
        "op4_secrets": op4_secrets,
        "op5_licenses": op5_licenses,
        "op6_quality_rules": op6_quality_rules,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_bpe": op8_bpe,
        "op9_ngram_jaccard": op9_ngram_jaccard,
        "op10_warc": op10_warc,
        "op11_merkle": op11_merkle,
        "op12_resampling": op12_resampling,
        "op13_token_files": op13_token_files,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op3_line_dedup": OP3_SQL, "op5_licenses": OP5_SQL, "op9_ngram_jaccard": OP9_SQL, "op10_warc": OP10_SQL, "op11_merkle": OP11_SQL, "op12_resampling": OP12_SQL}
