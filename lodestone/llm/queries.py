"""Queries over the corpus operators, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, html_extract, language_id, media_columns, minhash_dedup, mixing, packing, quality_resampling, secret_scan, substring_dedup
from ._spark import bounded_batches


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link(_read(spark, sf_dir, "embeddings"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(_read(spark, sf_dir, "documents"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_read(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(_read(spark, sf_dir, "documents"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_read(spark, sf_dir, "documents"))


def op7_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _read(spark, sf_dir, "labels")
    good, judged = labels.agg(F.count_if(F.col("quality") == 1), F.count("quality")).head()
    targets = labels.where("quality = 1").select("doc_id")
    return quality_resampling.resample(_read(spark, sf_dir, "documents"), targets, good / judged if judged else 1.0)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns.store_and_describe(_read(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held = language_id.held_out("doc_id")
    model = language_id.train(docs.where(~held))
    found = language_id.identify(docs, model)
    return found.select("doc_id", language_id.held_out("doc_id").alias("held_out"), "lang_pred", "score", "languages")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_embedding_dedup,
        op2_secret_scan,
        op3_html_extract,
        op4_packing,
        op5_substring_dedup,
        op6_minhash_dedup,
        op7_quality_resampling,
        op8_mixing,
        op9_media_columns,
        op10_language_id,
    )
}

_WORDS = r"[^\x20\x09-\x0D]+"


def _secret_sql() -> str:
    """Matches and the text between them give the spans: DuckDB has no match positions."""
    parts, listed = [], []
    for order, rule in enumerate(secret_scan.RULES):
        pattern = rule.pattern.replace("'", "''")
        starts = f"list_transform(range(1, len(m{order}) + 1), lambda i: CAST(list_sum(list_transform(s{order}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m{order}[1:i - 1], lambda x: length(x))), 0) AS BIGINT))"
        parts.append(f"regexp_extract_all(text, '{pattern}') AS m{order}, regexp_extract_all(text, '{pattern}', {rule.group}) AS g{order}, string_split_regex(text, '{pattern}') AS s{order}")
        row = f"{{'s': b{order}[i], 'o': {order}, 'e': b{order}[i] + length(m{order}[i]), 'k': '{rule.kind}'}}"
        listed.append((f"{starts} AS b{order}", f"list_transform(list_filter(range(1, len(m{order}) + 1), lambda i: length(g{order}[i]) >= {rule.least}), lambda i: {row})"))
    base = [r.kind for r in secret_scan.RULES if r.base]
    text_of = lambda spans: f"array_to_string(list_transform({spans}, lambda x: x.k || ':' || x.s || ':' || x.e), ',')"
    counts = ", ".join(f"len(list_filter(spans, lambda x: x.k = '{k}')) AS n_{k}" for k in base)
    kept = "list_filter(spans, lambda x: x.o < " + str(len(base)) + ")"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS (SELECT doc_id, {', '.join(parts)} FROM d),
b AS (SELECT *, {', '.join(x for x, _ in listed)} FROM m),
r AS (SELECT doc_id, list_sort({' || '.join(x for _, x in listed)}) AS spans FROM b)
SELECT doc_id, {counts}, sha256({text_of(kept)}) AS base_sha256, {text_of('spans')} AS spans FROM r"""


#: For pages that hold their text in an article element: densities must find it whole and nothing beside it.
_ARTICLE_SQL = """
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|<footer>|$)', 1) AS x FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?b>', '', 'g'), '(?s)<[^>]*(?:>|$)', ' ', 'g') AS x FROM a),
c AS (SELECT page_id, url, regexp_replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS x FROM b),
t AS (SELECT page_id, url, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, length(text) AS n_chars FROM t"""

ORACLES: dict[str, str] = {
    "op2_secret_scan": _secret_sql(),
    "op3_html_extract": _ARTICLE_SQL,
    "op1_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
    label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS fine FROM embeddings),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.fine AND b.fine AND list_cosine_similarity(a.e, b.e) >= 0.98),
r(node, low) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.v, r.low FROM r JOIN l ON l.u = r.node),
c AS (SELECT node, min(low) AS component_id FROM r GROUP BY node),
d AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT v.vec_id, coalesce(d.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept,
  CASE WHEN fine THEN min(v.vec_id) OVER (PARTITION BY fine, label, e) ELSE v.vec_id END AS copy_of
FROM v JOIN c ON c.node = v.vec_id LEFT JOIN d ON d.u = v.vec_id""",
    "op5_substring_dedup": f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50),
h AS (SELECT s.doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM s JOIN w USING (doc_id)),
m AS (SELECT h, min(doc_id) AS least FROM h GROUP BY h),
g AS (SELECT doc_id, list_sort(list(i)) AS starts FROM h JOIN m USING (h) WHERE doc_id > least GROUP BY doc_id),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM (SELECT doc_id, unnest(starts) AS i FROM g)),
gone AS (SELECT doc_id, list(i) AS gone FROM x GROUP BY doc_id),
k AS (SELECT doc_id, w, coalesce(gone, []) AS gone, coalesce(starts, []) AS starts FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN g USING (doc_id))
SELECT doc_id, len(w) AS n_words, len(gone) AS n_removed,
  sha256(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]), ' ')) AS kept_sha256,
  len(list_filter(range(1, len(starts) + 1), lambda i: i = 1 OR starts[i] - starts[i - 1] > 50)) AS n_intervals
FROM k""",
    "op6_minhash_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM w),
c AS (SELECT doc_id, g, count(*) AS n FROM s GROUP BY ALL),
t AS (SELECT doc_id, sum(n) AS n, md5(string_agg(g || ':' || n, '|' ORDER BY g)) AS k FROM c GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, sum(least(a.n, b.n)) AS m FROM c a JOIN c b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN t x ON x.doc_id = u JOIN t y ON y.doc_id = v WHERE m >= 0.8 * (x.n + y.n - m)),
r(node, low) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.v, r.low FROM r JOIN l ON l.u = r.node),
f AS (SELECT node AS doc_id, min(low) AS class_id FROM r GROUP BY node)
SELECT doc_id, CASE WHEN k IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY k) END AS copy_of, class_id, doc_id = class_id AS kept FROM f LEFT JOIN t USING (doc_id)""",
    "op8_mixing": f"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORDS}')) AS size, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS o FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
p AS (SELECT *, [1, 2, 3][(row_number() OVER (ORDER BY source IS NULL, encode(coalesce(source, ''))) - 1) % 3 + 1] AS weight, 3.0 * source_size AS stop FROM s),
k AS (SELECT *, row_number() OVER w AS rn, ((SELECT sum(source_size) FROM s) - coalesce(sum(stop) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / CAST(sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM p WINDOW w AS (ORDER BY CAST(stop AS DOUBLE) / weight, source)),
t AS (SELECT source, source_size, CASE WHEN source_size > 0 THEN least(CAST(stop AS DOUBLE), (SELECT arg_min(level, rn) FROM k WHERE level < CAST(stop AS DOUBLE) / weight) * weight) ELSE 0.0 END AS target FROM p),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(3.0, round(target / source_size, 12)) ELSE 0.0 END AS rate FROM t),
z AS (SELECT source, size, count(*) AS n FROM d GROUP BY ALL),
u AS (SELECT z.source, z.size, z.n, rate, source_size, target, z.n * (rate - floor(rate)) * z.size AS part, row_number() OVER (PARTITION BY z.source ORDER BY z.size DESC) AS i FROM z JOIN r ON z.source IS NOT DISTINCT FROM r.source),
h(source, i, wanted, more, size) AS (
  SELECT source, i, part, CASE WHEN size > 0 THEN greatest(0, least(n, floor(part / size + 0.5))) ELSE 0 END, size FROM u WHERE i = 1
  UNION ALL SELECT u.source, u.i, u.part + (h.wanted - h.more * h.size), CASE WHEN u.size > 0 THEN greatest(0, least(n, floor((u.part + (h.wanted - h.more * h.size)) / u.size + 0.5))) ELSE 0 END, u.size FROM h JOIN u ON u.source IS NOT DISTINCT FROM h.source AND u.i = h.i + 1),
m AS (SELECT u.*, CAST(h.more AS BIGINT) AS more FROM u JOIN h ON u.source IS NOT DISTINCT FROM h.source AND u.i = h.i),
e AS (SELECT source, size, (o >> 7) % 256 AS salt, count(*) AS c FROM d GROUP BY ALL),
f AS (SELECT e.*, m.rate, m.source_size, m.target, CAST(sum(c) OVER (PARTITION BY e.source, e.size ORDER BY salt) AS HUGEINT) * CAST(more AS HUGEINT) // n AS reach FROM e JOIN m ON e.source IS NOT DISTINCT FROM m.source AND e.size = m.size),
g AS (SELECT *, reach - coalesce(lag(reach) OVER (PARTITION BY source, size ORDER BY salt), 0) AS extra FROM f),
q AS (SELECT *, (o >> 7) % 256 AS salt, row_number() OVER (PARTITION BY source, size, (o >> 7) % 256 ORDER BY o, doc_id) AS rank FROM d),
y AS (SELECT q.doc_id, q.size, g.source_size, g.target, g.rate, CAST(floor(rate) AS BIGINT) + CASE WHEN rank <= extra THEN 1 ELSE 0 END AS copies FROM q JOIN g ON q.source IS NOT DISTINCT FROM g.source AND q.size = g.size AND q.salt = g.salt)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, size * copies AS taken, copies, rate FROM y""",
}
