"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, codes, errata, html_text, license_scan, mixing, near_dedup, nn_descent, packing, quality, separators, suffix_dedup, va_file
from .common import table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.count_documents(table(spark, sf_dir, "documents"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 20 == 0, 20)


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_file.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 50 == 0, 5, change=lambda v: np.floor(256.0 * v))


def op6_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = quality.learned(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, net).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op10_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label").withColumnRenamed("id", "vec_id")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errata.variants(table(spark, sf_dir, "documents"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_near_dedup, op2_html_text, op3_token_counts, op4_nearest_neighbours, op5_exact_top_k, op6_quality_score, op7_mix_sources, op8_license_scan, op9_suffix_dedup, op10_pack_sequences, op11_vector_codes, op12_spelling_variants, op13_byte_bpe)}


def oracle_sql() -> dict[str, str]:
    return {"op1_near_dedup": OP1_SQL, "op5_exact_top_k": OP5_SQL, "op7_mix_sources": OP7_SQL, "op9_suffix_dedup": OP9_SQL, "op11_vector_codes": OP11_SQL, "op12_spelling_variants": OP12_SQL}


OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

#: The level of the water is found at the first source, by cap over weight, that it doesn't reach.
OP7_SQL = rf"""
WITH d AS (SELECT doc_id, text, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
           CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
g AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
w AS (SELECT source, CAST(source_size AS DOUBLE) AS source_size, 1.0 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM g),
c AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total, 3 * source_size / weight AS ratio FROM w),
o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
      sum(weight) OVER (ORDER BY ratio, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM c),
l AS (SELECT (total - held) / free AS level FROM o WHERE (total - held) / free <= ratio ORDER BY ratio, source LIMIT 1),
t AS (SELECT source, source_size, least(cap, level * weight) AS target FROM c, l),
f AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 0 END AS whole FROM t),
b AS (SELECT d.*, f.source_size, f.target, f.whole, round(f.target - f.whole * f.source_size) AS extra,
      coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(whole * size + greatest(0, least(size, extra - before)) AS BIGINT) AS taken FROM b
"""

#: Exact probability Jaccard similarities of all pairs that share a shingle, then the links' closure.
OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda v: v <> '') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS k FROM w WHERE len(ws) > 0),
s AS (SELECT doc_id, md5(array_to_string(ws[k:k + 4], ' ')) AS sh, CAST(count(*) AS DOUBLE) AS x FROM i GROUP BY 1, 2),
t AS (SELECT doc_id, sum(x) AS total, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(a.x) AS ax, sum(b.x) AS bx FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
q AS (SELECT p.*, ta.total AS ta, tb.total AS tb FROM p JOIN t ta ON ta.doc_id = p.a JOIN t tb ON tb.doc_id = p.b WHERE ax >= 0.79 * ta.total AND bx >= 0.79 * tb.total),
c AS (SELECT q.a, q.b, u.x AS x, v.x AS y FROM q JOIN s u ON u.doc_id = q.a JOIN s v ON v.doc_id = q.b AND v.sh = u.sh),
r AS (SELECT DISTINCT a, b, y / x AS rho FROM c),
m AS (SELECT r.a, r.b, rho, sum(greatest(x, y / rho)) AS most, sum(CASE WHEN y / x = rho THEN x ELSE 0 END) AS own FROM r JOIN c ON c.a = r.a AND c.b = r.b GROUP BY 1, 2, 3),
j AS (SELECT m.a, m.b FROM m JOIN q ON q.a = m.a AND q.b = m.b GROUP BY 1, 2 HAVING sum(own / (most + ta - ax + (tb - bx) / rho)) >= 0.8),
e AS (SELECT a, b FROM j UNION SELECT b, a FROM j),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
g AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY 1)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size FROM g
"""

#: Every 400-byte string by its start; starts whose string occurs again, merged to spans; what lies between them, as bytes and,
#: without the rest of a character at either end, as text.
OP9_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT doc_id, b, octet_length(b) AS n FROM d),
s AS (SELECT doc_id, unnest(range(0, n - 399)) AS p FROM n WHERE n >= 400),
h AS (SELECT s.doc_id, p, md5(hex(b[p + 1:p + 400])) AS m FROM s JOIN n USING (doc_id)),
r AS (SELECT doc_id, p FROM h QUALIFY count(*) OVER (PARTITION BY m) > 1),
g AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 400 THEN 0 ELSE 1 END AS f FROM r),
k AS (SELECT doc_id, p, sum(f) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM g),
x AS (SELECT doc_id, span, min(p) AS a, max(p) + 400 AS z FROM k GROUP BY 1, 2),
y AS (SELECT doc_id, a, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before, z FROM x),
parts AS (SELECT doc_id, before AS u, a AS v FROM y UNION ALL SELECT n.doc_id, coalesce(max(z), 0), n FROM n LEFT JOIN x USING (doc_id) GROUP BY n.doc_id, n),
bits AS (SELECT doc_id, u, hex(b[u + 1:v]) AS h FROM parts JOIN n USING (doc_id) WHERE v > u),
kept AS (SELECT doc_id, string_agg(h, '' ORDER BY u) AS kept, string_agg(regexp_replace(regexp_replace(h, '^([89AB].){1,3}', ''), '([CD].|E.([89AB].)?|F.([89AB].){0,2})$', ''), '' ORDER BY u) AS text FROM bits GROUP BY 1),
t AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM x GROUP BY 1)
SELECT n.doc_id, n.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256, decode(unhex(coalesce(kept.text, ''))) AS text
FROM n LEFT JOIN t USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_GAPS = "list_sum(list_transform(list_zip(x.s, c.s), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"

#: Rounds are the same three steps: distances to every entry, the nearest one (the lower of equals), floors of the means.
OP11_SQL = (
    """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
     WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
k AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS r FROM e),
w AS (SELECT CAST(max(len(v)) / 16 AS INTEGER) AS size FROM e),
x AS (SELECT r, p, v[p * size + 1:p * size + size] AS s FROM k, w, range(16) t(p)),
c0 AS (SELECT p, r AS i, s FROM x WHERE r < 64)"""
    + "".join(
        f""",
d{n} AS MATERIALIZED (SELECT r, x.p, x.s, arg_min(c.i, struct_pack(d := {_GAPS}, i := c.i)) AS i, min({_GAPS}) AS d FROM x JOIN c{n} c ON x.p = c.p GROUP BY r, x.p, x.s),
m{n} AS (SELECT p, i, j, CAST(floor(sum(s[j]) / count(*)) AS BIGINT) AS y FROM d{n}, range(1, (SELECT size FROM w) + 1) t(j) GROUP BY p, i, j),
c{n + 1} AS MATERIALIZED (SELECT c.p, c.i, coalesce(u.s, c.s) AS s FROM c{n} c LEFT JOIN (SELECT p, i, list(y ORDER BY j) AS s FROM m{n} GROUP BY p, i) u ON u.p = c.p AND u.i = c.i)"""
        for n in range(codes.ROUNDS + 1)
    )
    + f""",
h AS (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY p, i)) AS codebooks_sha256 FROM c{codes.ROUNDS}),
g AS (SELECT r, string_agg(printf('%02x', CAST(i AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM d{codes.ROUNDS} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN g USING (r), h
"""
)

#: CRC-32 byte by byte from its table; words that meet with one character skipped; forms followed to the last.
OP12_SQL = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, x)) AS t),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
g AS (SELECT doc_id, w, count(*) AS k FROM r WHERE length(w) >= 5 GROUP BY 1, 2),
b AS (SELECT w, k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS z FROM g),
h AS (SELECT w, k, xor(4294967295, list_reduce(list_transform(range(1, length(z), 2), lambda i: CAST('0x' || z[i:i + 1] AS BIGINT)), lambda a, y: xor(a >> 8, t[(xor(a, y) & 255) + 1]), CAST(4294967295 AS BIGINT))) AS h FROM b, tab),
s AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS w, k FROM h),
v AS (SELECT w, CAST(sum(k) AS BIGINT) AS n FROM s WHERE length(w) >= 5 GROUP BY 1 HAVING sum(k) >= 3),
p AS (SELECT w, n, i, left(w, i - 1) || substr(w, i + 1) AS q FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM v)),
y AS (SELECT a.w, a.n, b.w AS o, b.n AS m FROM p a JOIN p b ON a.q = b.q AND a.i = b.i AND a.w <> b.w
      UNION SELECT a.w, a.n, b.w, b.n FROM p a JOIN v b ON a.q = b.w UNION SELECT b.w, b.n, a.w, a.n FROM p a JOIN v b ON a.q = b.w),
f AS (SELECT w, count(*) AS n_near, arg_min(o, struct_pack(m := -m, o := encode(o))) AS o, max(m) AS m FROM y GROUP BY 1),
t AS (SELECT v.w AS word, CASE WHEN m >= 2 * n THEN o END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN m END AS form_n FROM v LEFT JOIN f USING (w)),
l AS (SELECT word, coalesce(form, word) AS at, form IS NULL AS done FROM t UNION ALL SELECT l.word, coalesce(t.form, t.word), t.form IS NULL FROM l JOIN t ON t.word = l.at WHERE NOT l.done)
SELECT word, form, l.at AS root, n, n_near, form_n FROM t JOIN l USING (word) WHERE l.done
"""
