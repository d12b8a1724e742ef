"""The operators' queries over the whole tables, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroids import clustered
from .collocations import collocations
from .common import table
from .exact_search import exact_top_k
from .language_id import fit, held_out, identify
from .license_scan import scan_licenses
from .maxent_lm import lm_scores
from .mixing import mix_plan
from .near_search import near_top_k
from .ngram_join import jaccard_join
from .secret_scan import scan_secrets
from .sentencepiece_coding import encode_texts
from .toxicity import fit as fit_toxicity
from .toxicity import toxicity
from .warc import archived

#: op4: sizes, the fixed point of the capped shares, and the same hash-seeded draws: as many documents of each source's size class as
#: whole numbers that the running sums of the fraction pass there.
OP4_SQL = r"""
WITH z AS (SELECT doc_id, text, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
d AS MATERIALIZED (SELECT doc_id, source, size, greatest(length(bin(size)) - 7, 0) * 64 + (size >> greatest(length(bin(size)) - 7, 0)::INT) AS cell,
  ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'text:' || coalesce(text, ''))), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS u FROM z),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS weight, 3 * source_size AS cap FROM s),
o AS (SELECT *, sum(source_size) OVER () AS total,
  coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM r),
l AS (SELECT (total - capped)::BIGINT AS rest, open_weight::BIGINT AS open_weight FROM o WHERE cap * open_weight >= (total - capped) * weight ORDER BY cap / weight, source ASC NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN l.rest IS NULL OR cap * o.open_weight < (total - capped) * weight THEN cap::DOUBLE
  ELSE (l.rest * weight)::DOUBLE / l.open_weight::DOUBLE END AS target FROM o LEFT JOIN l ON true),
f AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
  ('0x' || substr(md5('mix:offset:' || coalesce(source, '')), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS off FROM t),
c AS (SELECT source, cell, count(*) AS n FROM d GROUP BY source, cell),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM c),
w AS (SELECT b.source, b.cell, floor((rate - floor(rate)) * (before + n)::DOUBLE + off) - floor((rate - floor(rate)) * before::DOUBLE + off) AS wanted FROM b JOIN f ON b.source IS NOT DISTINCT FROM f.source),
k AS (SELECT *, rank() OVER (PARTITION BY source, cell ORDER BY u) - 1 AS place FROM d)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN place < wanted THEN 1 ELSE 0 END))::BIGINT AS taken
FROM k JOIN f ON k.source IS NOT DISTINCT FROM f.source JOIN w ON k.source IS NOT DISTINCT FROM w.source AND k.cell = w.cell
"""


#: op8: the response is the largest page_id of a digest; base32 from the hexadecimal digits, five bits each.
OP8_SQL = r"""
WITH h AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS s FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY s) AS top, row_number() OVER (PARTITION BY s ORDER BY page_id DESC NULLS LAST) AS k FROM h)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(s, (5 * (i // 4) + 1)::INT, 5))::INT >> (5 * (3 - i % 4))::INT) & 31), 1)), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN top END AS refers_to FROM w
"""

#: op9: every query against every other row.
OP9_SQL = r"""
WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.r AS qr, v.vec_id, v.r, list_inner_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON q.r <> v.r WHERE q.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id ASC NULLS LAST, r) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM k WHERE rank <= 20
"""

#: op11: pieces as lists of words, phrases from places in them; products in 128 bits.
OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
v AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
f AS MATERIALIZED (SELECT lang, w, count(*) AS f FROM (SELECT lang, unnest(ws) AS w FROM v) GROUP BY lang, w),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f GROUP BY lang),
b AS MATERIALIZED (SELECT lang, ws[i] AS x, ws[i + 1] AS y, count(*) AS a FROM (SELECT lang, ws, unnest(range(1, len(ws))) AS i FROM v) GROUP BY ALL HAVING count(*) >= 10),
t AS MATERIALIZED (SELECT lang, ws[i] AS x, ws[i + 1] AS y, ws[i + 2] AS z, count(*) AS a FROM (SELECT lang, ws, unnest(range(1, len(ws) - 1)) AS i FROM v) GROUP BY ALL HAVING count(*) >= 10),
o AS (SELECT lang, x, y, max(a) AS longer FROM (SELECT lang, x, y, a FROM t UNION ALL SELECT lang, y AS x, z AS y, a FROM t) GROUP BY lang, x, y),
two AS (SELECT b.lang, b.x || ' ' || b.y AS phrase, b.a, f.f AS l, g.f AS r, (1000000::HUGEINT * b.a * b.a) // (f.f::HUGEINT * g.f) AS score
  FROM b JOIN f ON b.lang = f.lang AND b.x = f.w JOIN f g ON b.lang = g.lang AND b.y = g.w LEFT JOIN o ON b.lang = o.lang AND b.x = o.x AND b.y = o.y
  WHERE o.longer IS NULL OR 100 * o.longer < 50 * b.a),
cuts AS (SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z AS phrase, t.a, f.f AS l1, b2.a AS r1, b1.a AS l2, g.f AS r2,
  (1000000::HUGEINT * t.a * t.a) // (f.f::HUGEINT * b2.a) AS s1, (1000000::HUGEINT * t.a * t.a) // (b1.a::HUGEINT * g.f) AS s2
  FROM t JOIN f ON t.lang = f.lang AND t.x = f.w JOIN f g ON t.lang = g.lang AND t.z = g.w
  JOIN b b1 ON t.lang = b1.lang AND t.x = b1.x AND t.y = b1.y JOIN b b2 ON t.lang = b2.lang AND t.y = b2.x AND t.z = b2.y),
c AS (SELECT * FROM two UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM cuts),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM c)
SELECT k.lang, k.rank, k.phrase, k.a, k.l, k.r, n.n, k.score::BIGINT AS score FROM k JOIN n ON k.lang = n.lang WHERE k.rank <= 2000
"""

#: op13: one step of assigning and moving for each round; distances in whole numbers, floors of quotients that may be negative.
_OP13_MOVE = """
a{i} AS MATERIALIZED (SELECT r, arg_min(c, d * 8 + c) AS c FROM (SELECT v.r, c.c, list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i])))::BIGINT AS d FROM v, c{i} c) GROUP BY r),
s{i} AS (SELECT c, j, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT a.c, unnest(v.e) AS x, unnest(range(1, 65)) AS j FROM a{i} a JOIN v ON a.r = v.r) GROUP BY c, j),
m{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS e FROM s{i} GROUP BY c),
c{k} AS MATERIALIZED (SELECT c.c, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN m{i} m ON c.c = m.c)"""

OP13_SQL = (
    """
WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR) ASC NULLS LAST, e) - 1 AS c, e FROM v ORDER BY c LIMIT 8),"""
    + ",".join(_OP13_MOVE.format(i=i, k=i + 1) for i in range(10))
    + """,
d AS (SELECT v.r, v.vec_id, c.c, c.e, list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i])))::BIGINT AS d FROM v, c10 c),
w AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(e, ',')) AS centroid_sha256 FROM w
"""
)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit(documents.where(~held_out()).select("doc_id", "text", "lang"))
    return identify(documents.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return plan.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"))


def op5_near_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    masked = F.transform("findings", lambda c: F.struct(c["place"].alias("place"), F.sha2(c["found"], 256).alias("digest"), c["probability"].alias("probability"), c["secret"].alias("secret")))
    return found.select("doc_id", "n_candidates", "n_secrets", "score", masked.alias("findings"), "redacted")


def op7_sentencepiece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens", "round_trip", "ids")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"), ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def op9_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit_toxicity(documents.where(~held_out()).select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity(documents, model, ["doc_id", held_out().alias("held_out")])


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_license_scan": op2_license_scan,
    "op3_language_id": op3_language_id,
    "op4_source_mixing": op4_source_mixing,
    "op5_near_search": op5_near_search,
    "op6_secret_scan": op6_secret_scan,
    "op7_sentencepiece_coding": op7_sentencepiece_coding,
    "op8_warc": op8_warc,
    "op9_exact_search": op9_exact_search,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_toxicity": op12_toxicity,
    "op13_centroid_clustering": op13_centroid_clustering,
}

ORACLES: dict[str, str] = {"op4_source_mixing": OP4_SQL, "op8_warc": OP8_SQL, "op9_exact_search": OP9_SQL, "op11_phrase_collocations": OP11_SQL, "op13_centroid_clustering": OP13_SQL}
