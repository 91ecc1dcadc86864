"""Queries over the test tables, each with the SQL that a second engine answers it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import shapes as S
from ..functions import text as X
from ..functions.ids import content_hash, entity_iri
from ..operators import chunking, graph, lifecycle, resolution, retrieval, rollup, search, timeline
from ..streaming import sessions, tumbling

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# --- documents and text ---------------------------------------------------------------


@query(
    """SELECT doc_id, sha256(text) AS content_hash, min(doc_id) OVER (PARTITION BY text) AS first_id,
    doc_id <> min(doc_id) OVER (PARTITION BY text) AS is_duplicate FROM documents"""
)
def doc_dedup_first_wins(spark, sf_dir):
    return resolution.dedup_documents(read(spark, sf_dir, "documents"))


@query(
    f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{{2,}}') AS words FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(words) < 50 THEN -1.0 ELSE round(len(list_filter(words, lambda x: x IN ({_list(X.STOPWORDS)}))) / len(words), 6) END AS legibility FROM w)
    SELECT doc_id, legibility, legibility < 0 OR legibility >= 0.05 AS readable FROM s"""
)
def doc_legibility(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.round(X.legibility("text"), 6).alias("legibility")).withColumn("readable", (F.col("legibility") < 0) | (F.col("legibility") >= X.LEGIBILITY_FLOOR))


@query(
    """WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS words FROM documents),
    c AS (SELECT doc_id, words, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) <= 200 THEN [0] ELSE range(0, len(words), 150) END) AS pos FROM w)
    SELECT doc_id, pos // 150 AS window_no, len(words[pos + 1 : pos + 200]) AS n_tokens, md5(array_to_string(words[pos + 1 : pos + 200], ' ')) AS digest FROM c"""
)
def chunk_token_windows(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.windows("text", 200, 50)).alias("window_no", "w"))
    return docs.select("doc_id", F.col("window_no").cast("long").alias("window_no"), chunking.token_count("w").cast("long").alias("n_tokens"), F.md5(F.col("w").cast("binary")).alias("digest"))


@query(
    """WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: list_filter(string_split_regex(x, '\\s+'), lambda y: y <> '')), lambda z: len(z) > 0) AS paras FROM documents),
    f AS (SELECT doc_id, flatten(list_transform(paras, lambda q: list_transform(range(0, len(q), 100), lambda i: q[i + 1 : i + 100]))) AS parts FROM p),
    r AS (SELECT doc_id, parts, 1 AS i, 0 AS chunk_index, len(parts[1]) AS n, parts[1] AS words FROM f WHERE len(parts) > 0
      UNION ALL SELECT doc_id, parts, i + 1, CASE WHEN n + len(parts[i + 1]) > 100 THEN chunk_index + 1 ELSE chunk_index END,
        CASE WHEN n + len(parts[i + 1]) > 100 THEN len(parts[i + 1]) ELSE n + len(parts[i + 1]) END,
        CASE WHEN n + len(parts[i + 1]) > 100 THEN list_concat(CASE WHEN len(words) > 20 THEN words[-20:] ELSE [] END, parts[i + 1]) ELSE list_concat(words, parts[i + 1]) END
      FROM r WHERE i < len(parts)),
    l AS (SELECT doc_id, chunk_index, max(i) AS i FROM r GROUP BY ALL)
    SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, len(words) AS token_count, md5(array_to_string(words, ' ')) AS digest FROM r JOIN l USING (doc_id, chunk_index, i)"""
)
def chunk_pack_overlap(spark, sf_dir):
    chunks = chunking.chunk(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", 100, 20, "\n")
    return chunks.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("token_count").cast("long").alias("token_count"), F.md5(F.array_join(chunking.tokens("chunk_text"), " ").cast("binary")).alias("digest"))


def _html_sql() -> str:
    page = "coalesce(html, '')"
    for tag in X.UNREAD:
        page = f"regexp_replace({page}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', '<x>', 'g')"
    page = f"regexp_replace({page}, '(?s)<!--.*?-->', '<x>', 'g')"
    page = f"regexp_replace({page}, '(?s)(?:<[^>]*>)+', chr(10), 'g')"
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        page = f"replace({page}, '{entity}', '{sign}')"
    return f"""WITH t AS (SELECT page_id, {page} AS x FROM pages),
    l AS (SELECT page_id, array_to_string(list_transform(string_split(x, chr(10)), lambda s: regexp_replace(s, '^[ \\t\\r\\f]+|[ \\t\\r\\f]+$', '', 'g')), chr(10)) AS x FROM t),
    s AS (SELECT page_id, regexp_replace(regexp_replace(x, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g') AS x FROM l)
    SELECT page_id, length(x) AS n_chars, md5(x) AS digest FROM s"""


@query(_html_sql())
def html_to_text(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", X.html_to_text("html").alias("text"))
    return pages.select("page_id", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query(
    "SELECT doc_id, "
    + ", ".join("(" + " OR ".join(f"regexp_matches(text, '(?mi)^\\s*[#>*\\-\\s]*{a}\\b')" for a in aliases) + f") AS {name.lower()}" for name, aliases in X.SECTIONS.items())
    + " FROM (SELECT doc_id, '# ' || CASE WHEN doc_id % 2 = 0 THEN 'Claims' ELSE 'Safety' END || ' of ' || source || chr(10) || text AS text FROM documents)"
)
def section_coverage(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    headed = docs.select("doc_id", F.concat(F.lit("# "), F.when(F.col("doc_id") % 2 == 0, "Claims").otherwise("Safety"), F.lit(" of "), "source", F.lit("\n"), "text").alias("text"))
    return headed.select("doc_id", X.section_coverage("text").alias("s")).select("doc_id", *[F.col(f"s.{n}").alias(n.lower()) for n in X.SECTIONS])


_SLUG = "regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
_KEBAB = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9_]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(
    f"""SELECT c_custkey AS id, regexp_replace(lower(trim(regexp_replace(c_name, '[^a-zA-Z0-9_\\s]', '', 'g'))), '\\s+', ' ', 'g') AS normalized, {_SLUG.format("c_name || ' ' || c_mktsegment")} AS slug,
    'https://example.org/knowledge#' || substr({_KEBAB.format("c_name")}, 1, 50) || '-' || substr(sha256(c_name || '|' || c_mktsegment), 1, 16) AS iri FROM customer"""
)
def name_normalize_slug(spark, sf_dir):
    rows = read(spark, sf_dir, "customer")
    return rows.select(F.col("c_custkey").alias("id"), X.normalize_name("c_name").alias("normalized"), X.slugify(F.concat_ws(" ", "c_name", "c_mktsegment")).alias("slug"), entity_iri("c_name", "c_mktsegment").alias("iri"))


_TRIGRAMS = """list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''),
    lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"""


@query(
    f"""WITH n AS (SELECT DISTINCT p_name FROM part), t AS (SELECT p_name, {_TRIGRAMS.format("p_name")} AS g FROM n),
    s AS (SELECT a.p_name AS name, b.p_name AS other, len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) AS similarity FROM t a, t b WHERE a.p_name < b.p_name)
    SELECT name, other, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.4"""
)
def trgm_similarity_match(spark, sf_dir):
    names = read(spark, sf_dir, "part").select("p_name").distinct()
    met = search.trigram_join(names, names, 0.4, "p_name", "p_name")
    return met.where("_l.p_name < _r.p_name").select(F.col("_l.p_name").alias("name"), F.col("_r.p_name").alias("other"), F.round("similarity", 6).alias("similarity"))


@query(
    f"""WITH m AS (SELECT DISTINCT upper(p_name) || '!' AS name, p_brand AS class_iri FROM part UNION SELECT DISTINCT p_name || 's', p_brand FROM part),
    k AS (SELECT *, lower(regexp_replace(name, '[^a-zA-Z0-9_ ]', '', 'g')) AS normalized FROM m),
    s AS (SELECT p_name AS normalized, p_brand AS class_iri, min('E' || p_partkey) AS entity_id FROM part WHERE p_size <= 25 GROUP BY ALL),
    u AS (SELECT normalized, class_iri, min(name) AS name FROM k GROUP BY ALL),
    e AS (SELECT u.*, s.entity_id FROM u LEFT JOIN s USING (normalized, class_iri)),
    q AS (SELECT e.normalized, e.class_iri, s.entity_id, {_TRIGRAMS.format("e.normalized")} AS a, {_TRIGRAMS.format("s.normalized")} AS b FROM e JOIN s USING (class_iri) WHERE e.entity_id IS NULL),
    f AS (SELECT normalized, class_iri, arg_min(entity_id, (-sim, entity_id)) AS near FROM (SELECT *, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS sim FROM q) WHERE sim >= 0.8 GROUP BY ALL),
    r AS (SELECT normalized, class_iri, CASE WHEN entity_id IS NOT NULL THEN 'exact' WHEN near IS NOT NULL THEN 'fuzzy' ELSE 'new' END AS how,
      coalesce(entity_id, near, 'https://example.org/knowledge#' || substr({_KEBAB.format("name")}, 1, 50) || '-' || substr(sha256(name || '|' || class_iri), 1, 16)) AS entity_id FROM e LEFT JOIN f USING (normalized, class_iri))
    SELECT k.name, k.class_iri, k.normalized, r.entity_id, r.how FROM k JOIN r USING (normalized, class_iri)"""
)
def entity_resolve_exact_then_fuzzy(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    mentions = part.select(F.concat(F.upper("p_name"), F.lit("!")).alias("name"), F.col("p_brand").alias("class_iri")).union(part.select(F.concat("p_name", F.lit("s")), "p_brand")).distinct()
    store = part.where("p_size <= 25").select(F.concat(F.lit("E"), "p_partkey").alias("entity_id"), F.col("p_name").alias("normalized"), F.col("p_brand").alias("class_iri"))
    return resolution.resolve(mentions, store, 0.8)


@query(
    """WITH n AS (SELECT DISTINCT conv_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: len(w) >= 6)) AS name FROM conversations WHERE role = 'user')
    SELECT c.conv_id, c.turn, n.name FROM conversations c JOIN n ON n.conv_id = c.conv_id WHERE c.role = 'assistant' AND contains(lower(c.text), n.name)"""
)
def entity_substring_link(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) >= 6)
    names = turns.where("role = 'user'").select("conv_id", F.explode(words).alias("name")).distinct()
    linked = resolution.link_by_substring(turns.where("role = 'assistant'").select("conv_id", "turn", "text"), names, "conv_id", "text", "name")
    return linked.select("conv_id", "turn", "name")


@query(
    """SELECT doc_id, substr(text, 1, 200) || '...' AS snippet,
    CASE WHEN length(replace(trim(text, ' '), chr(10), ' ')) > 600 THEN rtrim(substr(replace(trim(text, ' '), chr(10), ' '), 1, 600), ' ') || '...' ELSE replace(trim(text, ' '), chr(10), ' ') END AS clipped FROM documents"""
)
def text_snippets(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.snippet("text").alias("snippet"), X.clip("text").alias("clipped"))


@query(
    """WITH d AS (SELECT *, CAST(n_chars AS DOUBLE) AS score FROM documents),
    c AS (SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, 'chunk' AS kind, doc_id AS id, score, text FROM d WHERE lang = 'en'),
    a AS (SELECT (SELECT count(*) FROM c) + row_number() OVER (ORDER BY score DESC, doc_id) AS rank, 'artifact' AS kind, doc_id AS id, score, text FROM d WHERE lang <> 'en'),
    u AS (SELECT * FROM c UNION ALL SELECT * FROM a)
    SELECT rank, kind, id, score, CASE WHEN length(replace(trim(text, ' '), chr(10), ' ')) > 600 THEN rtrim(substr(replace(trim(text, ' '), chr(10), ' '), 1, 600), ' ') || '...' ELSE replace(trim(text, ' '), chr(10), ' ') END AS snippet FROM u"""
)
def evidence_pack(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "text", F.col("n_chars").cast("double").alias("score"))
    return retrieval.pack_evidence(docs.where("lang = 'en'"), docs.where("lang <> 'en'"))


@query(
    """SELECT source, list_sort(list_distinct(list(lang))) AS langs, count(*) AS n FROM documents GROUP BY source"""
)
def recursive_merge_by_key(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("source", F.array("lang").alias("langs"), F.lit(1).alias("one"))
    merged = lifecycle.merge_records(docs, "source", ["langs"], [])
    return merged.join(docs.groupBy("source").agg(F.count("*").alias("n")), "source")


# --- shapes ---------------------------------------------------------------------------

_TAILS = "|".join(S.TITLE_TAILS)


@query(
    f"""WITH l AS (SELECT p_partkey, p_name || CASE p_size % 6 WHEN 0 THEN ' Ltd.' WHEN 1 THEN ' Report' WHEN 2 THEN ' group' WHEN 3 THEN '' WHEN 4 THEN ' Groupies' ELSE ' hub' END AS label FROM part
      UNION ALL SELECT p_partkey, '2024 ' || p_name FROM part)
    SELECT p_partkey, label, CASE WHEN regexp_matches(label, '{S.CORPORATE}') THEN 'corporate-suffix' WHEN regexp_matches(label, '(?i)\\s(?:{_TAILS})\\s*$') THEN 'document-title'
      WHEN contains(label, ' ') AND regexp_matches(label, '{S.YEAR_PREFIX}') THEN 'year-prefix' END AS reason FROM l"""
)
def entity_shaped_labels(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    tail = F.element_at(F.array(*map(F.lit, (" Ltd.", " Report", " group", "", " Groupies", " hub"))), (F.col("p_size") % 6 + 1).cast("int"))
    labels = part.select("p_partkey", F.concat("p_name", tail).alias("label")).union(part.select("p_partkey", F.concat(F.lit("2024 "), "p_name")))
    return labels.withColumn("reason", S.entity_shape("label"))


@query(
    f"""WITH v AS (SELECT p_partkey, unnest([p_name, CAST(p_retailprice AS VARCHAR), 'FY20' || CAST(10 + p_size % 20 AS VARCHAR), 'Total', p_type, CAST(p_size AS VARCHAR) || '%', ' ab ']) AS value FROM part)
    SELECT p_partkey, value, length(trim(value)) >= 3 AND lower(trim(value)) NOT IN ({_list(S.TABLE_NOISE)}) AND NOT regexp_matches(trim(value), '{S.DATE_LIKE}')
      AND (NOT regexp_matches(trim(value), '(?i)^[\\s\\-+$€£¥₹%()0-9,.–—a-z]+$') OR length(regexp_replace(trim(value), '[^a-zA-Z]', '', 'g')) >= 3) AS keep FROM v"""
)
def table_candidates(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    price = F.col("p_retailprice").cast("string")
    values = F.array(F.col("p_name"), price, F.concat(F.lit("FY20"), (F.col("p_size") % 20 + 10).cast("string")), F.lit("Total"), F.col("p_type"), F.concat(F.col("p_size").cast("string"), F.lit("%")), F.lit(" ab "))
    return part.select("p_partkey", F.explode(values).alias("value")).withColumn("keep", S.is_table_candidate("value"))


@query(
    """WITH l AS (SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'Anna Smith' WHEN c_nationkey % 3 = 1 THEN 'Gulf War' ELSE c_name END || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE ' Bank of Rome' END AS label FROM customer)
    SELECT c_custkey, label, len(string_split(label, ' ')) BETWEEN 2 AND 4
      AND len(list_filter(string_split(label, ' '), lambda p: NOT regexp_matches(p, '^[A-Z]') OR regexp_matches(p, '[0-9]') OR lower(p) IN ('of', 'the', 'and', 'in', 'on', 'for', 'to', 'at'))) = 0
      AND NOT contains(' ' || lower(label) || ' ', ' bank of ') AND NOT regexp_matches(lower(label), '\\bwar\\b') AS is_person FROM l"""
)
def person_names(spark, sf_dir):
    rows = read(spark, sf_dir, "customer")
    label = F.when(F.col("c_nationkey") % 3 == 0, "Anna Smith").when(F.col("c_nationkey") % 3 == 1, "Gulf War").otherwise(F.col("c_name"))
    rows = rows.select("c_custkey", F.concat(label, F.when(F.col("c_custkey") % 2 == 0, "").otherwise(" Bank of Rome")).alias("label"))
    return rows.withColumn("is_person", S.is_person_name("label"))


@query(
    """WITH n AS (SELECT s_suppkey, lower(replace(s_name, '#', '')) AS base FROM supplier)
    SELECT base || ' co ltd' AS normalized, unnest([base || ' co ltd', base]) AS variant FROM n"""
)
def short_form_variants(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").select(F.concat(X.normalize_name("s_name"), F.lit(" co ltd")).alias("normalized"))
    return rows.select("normalized", F.explode(X.short_forms("normalized")).alias("variant"))


# --- vectors --------------------------------------------------------------------------

_DIST = "sqrt(list_sum(list_transform(list_zip({0}, {1}), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))))"
_PROBES = [[0.125] * 64, [0.125 if i % 2 else -0.125 for i in range(64)], [0.125 if i % 3 else -0.125 for i in range(64)]]


@query(f"""SELECT vec_id AS id, round({_DIST.format("embedding", str(_PROBES[0]))}, 5) AS distance FROM embeddings ORDER BY {_DIST.format("embedding", str(_PROBES[0]))}, vec_id LIMIT 20""")
def knn_l2_topk(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return search.knn(rows, search.literal_vector(_PROBES[0]), 20).select("id", F.round("distance", 5).alias("distance"))


_PROBE_ROWS = " UNION ALL ".join(f"SELECT {i} AS probe, {p} AS pv" for i, p in enumerate(_PROBES))


@query(
    f"""WITH p AS ({_PROBE_ROWS}), d AS (SELECT probe, vec_id AS id, {_DIST.format("embedding", "pv")} AS distance FROM embeddings, p),
    r AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY distance, id) AS rank FROM d)
    SELECT CAST(probe AS BIGINT) AS probe, id, round(distance, 5) AS distance, rank FROM r WHERE rank <= 15"""
)
def rerank_multi_probe(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    probes = spark.createDataFrame([(i, p) for i, p in enumerate(_PROBES)], "probe long, probe_vector array<double>")
    return search.rerank(rows, probes, 15).select("probe", "id", F.round("distance", 5).alias("distance"), F.col("rank").cast("long").alias("rank"))


_NEIGHBOURS = f"""d AS (SELECT a.label, a.vec_id, b.vec_id AS other, {_DIST.format("a.embedding", "b.embedding")} AS distance FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id),
    k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, other) AS rank FROM d)"""


@query(f"""WITH {_NEIGHBOURS} SELECT label, vec_id, other, round(distance, 5) AS distance, rank FROM k WHERE rank <= 5 AND distance <= 1.15""")
def knn_self_join_threshold(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    found = search.neighbour_join(rows, 5, 1.15, "label", "vec_id")
    return found.select("label", "vec_id", "other", F.round("distance", 5).alias("distance"), F.col("rank").cast("long").alias("rank"))


_CLUSTERS = f"""{_NEIGHBOURS}, l AS (SELECT vec_id AS a, other AS b FROM k WHERE rank <= 25 AND distance <= 1.15 UNION SELECT other, vec_id FROM k WHERE rank <= 25 AND distance <= 1.15),
    c(node, low) AS (SELECT a, a FROM l UNION SELECT l.b, c.low FROM c JOIN l ON l.a = c.node),
    m AS (SELECT node AS vec_id, min(low) AS cluster FROM c GROUP BY node)"""


@query(f"""WITH RECURSIVE {_CLUSTERS} SELECT vec_id, cluster FROM m""")
def rollup_components(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    return rollup.clusters(rows, 1.15, 25, 2, "label", "vec_id")


@query(
    f"""WITH RECURSIVE {_CLUSTERS}, b AS (SELECT vec_id, cluster, vec_id % 7 AS confidence, CAST((row_number() OVER (PARTITION BY cluster ORDER BY vec_id % 7 DESC, vec_id) - 1) // 4 AS BIGINT) AS batch FROM m)
    SELECT vec_id, cluster, batch FROM b JOIN (SELECT cluster, batch FROM b GROUP BY ALL HAVING count(*) >= 2) USING (cluster, batch)"""
)
def rollup_batches(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    members = rollup.clusters(rows, 1.15, 25, 2, "label", "vec_id").withColumn("confidence", F.col("vec_id") % 7)
    return rollup.batches(members, 4, 2, key="vec_id").select("vec_id", "cluster", F.col("batch").cast("long").alias("batch"))


@query(
    """SELECT DISTINCT o_custkey AS source_id, CASE WHEN l_returnflag = 'R' THEN 'summarizes' ELSE 'assertsAbout' END AS predicate, l_partkey AS target_id
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag IN ('R', 'A')"""
)
def rollup_inherit_edges(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    predicate = F.when(F.col("l_returnflag") == "R", "summarizes").when(F.col("l_returnflag") == "A", "assertsAbout").otherwise("referencesChunk")
    edges = line.select(F.col("l_orderkey").alias("source_id"), predicate.alias("predicate"), F.col("l_partkey").alias("target_id"))
    parents = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("child_id"), F.col("o_custkey").alias("parent_id"))
    return rollup.inherit_edges(edges, parents)


@query(
    f"""WITH p AS ({_PROBE_ROWS}), d AS (SELECT probe, vec_id AS id, {_DIST.format("embedding", "pv")} AS distance FROM embeddings, p),
    v AS (SELECT probe AS list_no, id, row_number() OVER (PARTITION BY probe ORDER BY distance, id) AS rank FROM d),
    h AS (SELECT l_partkey AS id, count(*) AS hits FROM lineitem WHERE l_partkey IN (SELECT vec_id FROM embeddings) GROUP BY ALL),
    u AS (SELECT * FROM v WHERE rank <= 60 UNION ALL SELECT * FROM (SELECT 9 AS list_no, id, row_number() OVER (ORDER BY hits DESC, id) AS rank FROM h) WHERE rank <= 60)
    SELECT id, round(sum(1.0 / (60 + rank)), 10) AS score FROM u GROUP BY id"""
)
def rrf_fusion(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    probes = spark.createDataFrame([(i, p) for i, p in enumerate(_PROBES)], "probe int, probe_vector array<double>")
    near = search.rerank(rows, probes, 60).select(F.col("probe").alias("list_no"), "id", "rank")
    linked = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id")).join(rows.select("id"), "id", "left_semi").groupBy("id").agg(F.count("*").alias("hits"))
    cover = search.ranked_list(linked.orderBy(F.col("hits").desc(), "id").limit(60), 9, [F.col("hits").desc()])
    return search.rrf(near.unionByName(cover)).select("id", F.round("score", 10).alias("score"))


# --- graph ----------------------------------------------------------------------------


def fact_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys as typed edges."""

    def of(table: str, kind: str, key: str, target: str, other: str) -> DataFrame:
        return read(spark, sf_dir, table).select(F.lit(kind).alias("source_type"), F.col(key).cast("long").alias("source_id"), F.lit(target).alias("target_type"), F.col(other).cast("long").alias("target_id"))

    return of("nation", "nation", "n_nationkey", "region", "n_regionkey").union(of("customer", "customer", "c_custkey", "nation", "c_nationkey")).union(of("supplier", "supplier", "s_suppkey", "nation", "s_nationkey")).union(of("orders", "order", "o_orderkey", "customer", "o_custkey"))


_EDGES = """f AS (SELECT 'nation' AS st, CAST(n_nationkey AS BIGINT) AS si, 'region' AS tt, CAST(n_regionkey AS BIGINT) AS ti FROM nation
    UNION ALL SELECT 'customer', c_custkey, 'nation', CAST(c_nationkey AS BIGINT) FROM customer UNION ALL SELECT 'supplier', s_suppkey, 'nation', CAST(s_nationkey AS BIGINT) FROM supplier
    UNION ALL SELECT 'order', o_orderkey, 'customer', o_custkey FROM orders),
    e AS (SELECT * FROM f UNION ALL SELECT tt, ti, st, si FROM f)"""


@query(
    f"""WITH RECURSIVE {_EDGES}, w(t, i, hop) AS (SELECT 'region', CAST(r_regionkey AS BIGINT), 0 FROM region WHERE r_name = 'ASIA'
      UNION SELECT e.tt, e.ti, w.hop + 1 FROM w JOIN e ON e.st = w.t AND e.si = w.i WHERE w.hop < 3)
    SELECT t AS node_type, i AS node_id, CAST(min(hop) AS BIGINT) AS hop, power(0.5, min(hop)) AS score FROM w GROUP BY ALL"""
)
def bfs_hops(spark, sf_dir):
    seeds = read(spark, sf_dir, "region").where("r_name = 'ASIA'").select(F.lit("region").alias("node_type"), F.col("r_regionkey").cast("long").alias("node_id"))
    return graph.bfs(fact_edges(spark, sf_dir), seeds, 3).withColumn("hop", F.col("hop").cast("long"))


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(child, parent)``: segments of a nation under it, nations under regions."""
    nation = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    segment = read(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey", F.lit("/"), "c_mktsegment").alias("child"), F.concat(F.lit("n"), "c_nationkey").alias("parent")).distinct()
    return nation.union(segment)


_ISA = """isa AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation
    UNION SELECT 'n' || c_nationkey || '/' || c_mktsegment, 'n' || c_nationkey FROM customer)"""


@query(
    f"""WITH RECURSIVE {_ISA}, w(node, depth) AS (SELECT 'r2', 0 UNION SELECT isa.child, w.depth + 1 FROM w JOIN isa ON isa.parent = w.node WHERE w.depth < 10)
    SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM w GROUP BY node"""
)
def class_subtree(spark, sf_dir):
    roots = spark.createDataFrame([("r2",)], "node string")
    return graph.subtree(hierarchy(spark, sf_dir), roots).withColumn("depth", F.col("depth").cast("long"))


_CLOSURE = f"""{_ISA}, up(node) AS (SELECT 'n3' UNION SELECT isa.parent FROM up JOIN isa ON isa.child = up.node),
    down(node) AS (SELECT 'n3' UNION SELECT isa.child FROM down JOIN isa ON isa.parent = down.node), cl AS (SELECT node FROM up UNION SELECT node FROM down)"""


@query(f"""WITH RECURSIVE {_CLOSURE} SELECT node FROM cl""")
def isa_closure(spark, sf_dir):
    return graph.closure(hierarchy(spark, sf_dir), spark.createDataFrame([("n3",)], "node string"))


def taxonomy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Classes and properties: a property joins each supplier's nation to a segment of the nation after it."""
    isa = hierarchy(spark, sf_dir)
    nodes = isa.select(F.col("child").alias("iri")).union(isa.select("parent")).distinct()
    supers = isa.groupBy(F.col("child").alias("iri")).agg(F.array_sort(F.collect_list(F.struct(F.col("parent").alias("iri")))).alias("superclasses"))
    classes = nodes.join(supers, "iri", "left").withColumn("superclasses", F.coalesce("superclasses", F.array().cast("array<struct<iri: string>>"))).withColumn("label", F.upper("iri"))
    props = read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("p"), "s_suppkey").alias("iri"),
        F.array(F.struct(F.concat(F.lit("n"), "s_nationkey").alias("iri"))).alias("domain"),
        F.array(F.struct(F.concat(F.lit("r"), (F.col("s_suppkey") % 5).cast("string")).alias("iri"))).alias("range"),
    )
    return classes, props


@query(
    f"""WITH RECURSIVE {_CLOSURE}, pr AS (SELECT 'n' || s_nationkey AS d, 'r' || CAST(s_suppkey % 5 AS VARCHAR) AS r FROM supplier),
    t AS (SELECT * FROM pr WHERE d IN (SELECT node FROM cl) OR r IN (SELECT node FROM cl)), k AS (SELECT node FROM cl UNION SELECT d FROM t UNION SELECT r FROM t UNION SELECT parent FROM isa WHERE starts_with(parent, 'r1'))
    SELECT node FROM k WHERE node IN (SELECT child FROM isa UNION SELECT parent FROM isa)"""
)
def prune_keep_set(spark, sf_dir):
    classes, props = taxonomy(spark, sf_dir)
    return graph.keep_set(classes, props, spark.createDataFrame([("n3",)], "node string"), ("r1",))


@query(
    f"""WITH RECURSIVE {_CLOSURE}, pr AS (SELECT 'p' || s_suppkey AS iri, 'n' || s_nationkey AS d, 'r' || CAST(s_suppkey % 5 AS VARCHAR) AS r FROM supplier),
    t AS (SELECT * FROM pr WHERE d IN (SELECT node FROM cl) OR r IN (SELECT node FROM cl)), k AS (SELECT node FROM cl UNION SELECT d FROM t UNION SELECT r FROM t),
    al AS (SELECT child AS node FROM isa UNION SELECT parent FROM isa), kk AS (SELECT node FROM k WHERE node IN (SELECT node FROM al)),
    c AS (SELECT 'class' AS kind, node AS iri, coalesce((SELECT list_sort(list(parent)) FROM isa WHERE child = node AND parent IN (SELECT node FROM kk)), []) AS refs FROM kk),
    p AS (SELECT 'property' AS kind, iri, list_filter([CASE WHEN d IN (SELECT node FROM kk) THEN d END, CASE WHEN r IN (SELECT node FROM kk) THEN r END], lambda x: x IS NOT NULL) AS refs FROM pr)
    SELECT kind, iri, array_to_string(refs, ',') AS refs FROM c UNION ALL SELECT kind, iri, array_to_string(refs, ',') FROM p WHERE len(refs) > 0"""
)
def prune_ontology(spark, sf_dir):
    classes, props = graph.prune(*taxonomy(spark, sf_dir), spark.createDataFrame([("n3",)], "node string"))
    names = lambda c: F.transform(c, lambda x: x["iri"])
    rows = classes.select(F.lit("class").alias("kind"), "iri", names("superclasses").alias("refs")).union(props.select(F.lit("property"), "iri", F.concat(names("domain"), names("range"))))
    return rows.withColumn("refs", F.array_join("refs", ","))


@query(f"""WITH {_ISA} SELECT DISTINCT parent AS iri, upper(parent) AS label FROM isa WHERE parent NOT IN (SELECT child FROM isa)""")
def top_level_branches(spark, sf_dir):
    return graph.top_level_branches(taxonomy(spark, sf_dir)[0])


@query(
    f"""WITH {_ISA}, pr AS (SELECT 'p' || s_suppkey AS via, 'n' || s_nationkey AS d, 'r' || CAST(s_suppkey % 5 AS VARCHAR) AS r FROM supplier)
    SELECT child AS node, 'parent' AS kind, parent AS other, NULL AS via FROM isa UNION SELECT parent, 'child', child, NULL FROM isa UNION SELECT d, 'domain_of', r, via FROM pr UNION SELECT r, 'range_of', d, via FROM pr"""
)
def immediate_edges(spark, sf_dir):
    return graph.immediate_edges(*taxonomy(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {_ISA}, b AS (SELECT child AS x, parent AS y FROM isa UNION SELECT parent, child FROM isa),
    w(node, depth) AS (SELECT 'n3', 0 UNION SELECT b.y, w.depth + 1 FROM w JOIN b ON b.x = w.node WHERE w.depth < 2)
    SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM w GROUP BY node"""
)
def class_neighbourhood(spark, sf_dir):
    edges = hierarchy(spark, sf_dir).select(F.col("child").alias("a"), F.col("parent").alias("b"))
    return graph.neighbourhood(edges, spark.createDataFrame([("n3",)], "node string"), 2).withColumn("depth", F.col("depth").cast("long"))


@query(
    f"""WITH {_ISA}, n AS (SELECT child AS iri FROM isa UNION SELECT parent FROM isa), s AS (SELECT 'k#' || replace(iri, '/', '_') AS iri, lower(replace(iri, '/', '_')) AS slug FROM n)
    SELECT 'k#has_' || substr(b.slug, length(a.slug) + 2) AS property_iri, 'has_' || substr(b.slug, length(a.slug) + 2) AS label, a.iri AS domain_iri, b.iri AS range_iri FROM s a JOIN s b ON starts_with(b.slug, a.slug || '_')"""
)
def stem_relations(spark, sf_dir):
    from ..sources.ontology import stem_relations as stems

    classes = taxonomy(spark, sf_dir)[0].select(F.concat(F.lit("k#"), F.replace("iri", F.lit("/"), F.lit("_"))).alias("iri"))
    return stems(classes, "k#")


# --- candidates -----------------------------------------------------------------------


@query("""SELECT l_orderkey AS source_id, count(*) AS hits FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#2') GROUP BY ALL ORDER BY hits DESC, source_id LIMIT 500""")
def candidate_hits(spark, sf_dir):
    edges = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id"))
    return retrieval.hits(edges, read(spark, sf_dir, "part").where("p_brand = 'Brand#2'").select(F.col("p_partkey").alias("target_id")))


@query("""SELECT l_orderkey AS source_id, count(*) AS hits FROM lineitem WHERE year(l_shipdate) = 1998 AND quarter(l_shipdate) = 2 GROUP BY ALL ORDER BY hits DESC, source_id LIMIT 200""")
def candidate_time_hits(spark, sf_dir):
    edges = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_id"), C.quarter_id("l_shipdate").alias("target_id"))
    return retrieval.hits(edges, spark.createDataFrame([("Q2_1998",)], "target_id string"), 200)


@query(
    """SELECT l_orderkey AS source_id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY ALL HAVING count(DISTINCT p_brand) = 3"""
)
def exhaustive_intersection(spark, sf_dir):
    edges = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id"))
    groups = read(spark, sf_dir, "part").where(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3")).select(F.col("p_brand").alias("group_no"), F.col("p_partkey").alias("target_id"))
    return retrieval.in_every_group(edges, groups)


@query(
    """WITH c AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 40), d AS (SELECT l_orderkey AS document_id, count(*) AS hits FROM c GROUP BY ALL)
    SELECT o_custkey * 1000000 + o_orderkey AS table_id, document_id, hits FROM d JOIN orders ON o_orderkey = document_id WHERE o_orderstatus = 'F' ORDER BY hits DESC, table_id LIMIT 50"""
)
def doc_mediated_tables(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), F.col("l_orderkey").alias("document_id"))
    candidates = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 40").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"))
    tables = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select((F.col("o_custkey") * 1000000 + F.col("o_orderkey")).alias("table_id"), F.col("o_orderkey").alias("document_id"))
    return retrieval.tables_of_documents(line, candidates, tables)


_CHUNKS = """ch AS (SELECT l_orderkey * 10 + l_linenumber AS chunk_id, l_orderkey AS document_id, CASE WHEN bool_or(l_linestatus = 'F') AND l_linenumber % 3 = 0 THEN 'fulltext' ELSE 'summary' END AS kind, count(*) AS hits FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


@query(
    f"""WITH {_CHUNKS}, d AS (SELECT document_id, sum(hits) AS hits FROM ch GROUP BY ALL), full_ AS (SELECT * FROM ch WHERE kind = 'fulltext')
    SELECT f.chunk_id, CAST(d.hits AS BIGINT) AS hits, 'fulltext' AS kind FROM full_ f JOIN d USING (document_id)
    UNION ALL SELECT chunk_id, hits, kind FROM ch WHERE kind <> 'fulltext' AND document_id NOT IN (SELECT document_id FROM full_)"""
)
def fulltext_bridge(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    rows = line.groupBy("l_orderkey", "l_linenumber").agg(F.bool_or(F.col("l_linestatus") == "F").alias("f"), F.count("*").alias("hits"))
    rows = rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), F.col("l_orderkey").alias("document_id"), F.when(F.col("f") & (F.col("l_linenumber") % 3 == 0), "fulltext").otherwise("summary").alias("kind"), "hits")
    return retrieval.fulltext_bridge(rows.select("chunk_id", "hits"), rows.drop("hits"))


@query(
    """SELECT p_type AS class_id, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type NOT IN (SELECT p_type FROM part WHERE p_size = 1 AND p_brand = 'Brand#1') GROUP BY ALL HAVING count(*) >= 100"""
)
def insight_clusters(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    links = read(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_type").alias("class_id"), F.col("p_partkey").alias("entity_id"), F.col("l_orderkey").alias("artifact_id"))
    return rollup.insight_groups(links, part.where("p_size = 1 AND p_brand = 'Brand#1'").select(F.col("p_type").alias("class_id")), 100)


@query("""SELECT o_orderpriority AS grp, o_orderkey AS id, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderdate DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 25""")
def insight_top_members(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("confidence"), "o_orderdate")
    return rollup.top_members(rows, "grp", 25, recent="o_orderdate").select("grp", "id", F.col("rank").cast("long").alias("rank"))


@query("""SELECT o_orderkey AS id, o_totalprice AS confidence FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY o_totalprice DESC, o_orderkey LIMIT 15""")
def recommendation_inputs(spark, sf_dir):
    insights = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("confidence"))
    return rollup.recommendation_inputs(insights, read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("insight_id")))


# --- time -----------------------------------------------------------------------------


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    text = F.concat(F.lit("Order of "), F.date_format(d, "yyyy-MM-dd"), F.lit(", planned "), F.date_format(d, "MMMM d, yyyy"), F.lit("; see "), F.date_format(d, "yyyy-MM"), F.lit(" and Q"), F.quarter(d).cast("string"), F.lit(" "), F.year(d).cast("string"), F.lit(" or "), (F.year(d) + 1).cast("string"), F.lit("."))
    return read(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))


_DATED = """SELECT o_orderkey, unnest(list_distinct(['DAY_' || strftime(o_orderdate, '%Y_%m_%d'), 'MONTH_' || strftime(o_orderdate, '%Y_%m'), 'Q' || quarter(o_orderdate) || '_' || year(o_orderdate), 'YEAR_' || (year(o_orderdate) + 1)])) AS time_identifier FROM orders"""


@query(_DATED)
def time_mentions(spark, sf_dir):
    return _dated(spark, sf_dir).select("o_orderkey", F.explode(timeline.mentions("text")).alias("time_identifier"))


@query(_DATED)
def time_mentions_masked(spark, sf_dir):
    return _dated(spark, sf_dir).select("o_orderkey", F.explode(timeline.masked_mentions("text")).alias("time_identifier"))


@query(
    """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), b AS (SELECT date_trunc('month', min(d)) AS a, date_trunc('month', max(d)) AS z FROM d),
    m AS (SELECT CAST(unnest(generate_series(a, z, INTERVAL 1 MONTH)) AS DATE) AS m FROM b),
    r AS (SELECT 'DAY_' || strftime(d, '%Y_%m_%d') AS time_identifier, 'day' AS time_level, d AS start_date, d AS end_date, strftime(d, '%Y-%m-%d') AS display_label, 'MONTH_' || strftime(d, '%Y_%m') AS parent_identifier FROM d
      UNION SELECT 'MONTH_' || strftime(m, '%Y_%m'), 'month', m, last_day(m), strftime(m, '%B %Y'), 'Q' || quarter(m) || '_' || year(m) FROM m
      UNION SELECT 'Q' || quarter(m) || '_' || year(m), 'quarter', CAST(date_trunc('quarter', m) AS DATE), CAST(date_trunc('quarter', m) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE), 'Q' || quarter(m) || ' ' || year(m), 'YEAR_' || year(m) FROM m
      UNION SELECT 'YEAR_' || year(m), 'year', CAST(date_trunc('year', m) AS DATE), CAST(date_trunc('year', m) + INTERVAL 12 MONTH - INTERVAL 1 DAY AS DATE), CAST(year(m) AS VARCHAR), NULL FROM m)
    SELECT * FROM r"""
)
def time_hierarchy_gapfill(spark, sf_dir):
    days = read(spark, sf_dir, "orders").select(C.day_id("o_orderdate").alias("time_identifier")).distinct()
    return timeline.hierarchy(days)


@query(
    """WITH e AS (SELECT event_type, unnest(['DAY_' || strftime(ts, '%Y_%m_%d'), 'MONTH_' || strftime(ts, '%Y_%m'), 'Q' || quarter(ts) || '_' || year(ts), 'YEAR_' || year(ts)]) AS time_identifier, value FROM events)
    SELECT time_identifier, event_type, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY ALL"""
)
def time_intervals_range_join(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    instances = timeline.hierarchy(events.select(C.day_id("ts").alias("time_identifier")).distinct())
    met = timeline.containing(events.select("ts", "event_type", "value"), instances.select("time_identifier"))
    return met.groupBy("time_identifier", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def event_windows(spark, sf_dir):
    return tumbling(read(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k"""
)
def event_sessions(spark, sf_dir):
    return sessions(read(spark, sf_dir, "events"))


# --- lifecycle ------------------------------------------------------------------------


@query("""SELECT conv_id, count(*) AS n_turns, max(turn) + 1 AS next_turn FROM conversations GROUP BY conv_id ORDER BY next_turn DESC, conv_id LIMIT 50 OFFSET 10""")
def conversation_list(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    rows = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns")).join(lifecycle.next_turn(turns), "conv_id")
    return lifecycle.page(rows, [F.col("next_turn").desc(), F.col("conv_id")], 50, 10)


@query("""SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3""")
def conversation_history(spark, sf_dir):
    return lifecycle.history(read(spark, sf_dir, "conversations"))


@query("""SELECT conv_id, count(*) AS n_turns, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id""")
def conversation_replay(spark, sf_dir):
    rows = lifecycle.replay(read(spark, sf_dir, "conversations"))
    return rows.select("conv_id", "n_turns", F.md5(F.col("transcript").cast("binary")).alias("digest"))


@query(
    """WITH s AS (SELECT DISTINCT l_partkey AS artifact_id, l_orderkey AS document_id FROM lineitem), g AS (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O'),
    t AS (SELECT artifact_id FROM s GROUP BY ALL HAVING count(*) = count(CASE WHEN document_id IN (SELECT o_orderkey FROM g) THEN 1 END))
    SELECT p_partkey AS artifact_id, CASE WHEN p_partkey IN (SELECT artifact_id FROM t) THEN 'STALE' ELSE 'ACTIVE' END AS status FROM part"""
)
def doc_stale_on_delete(spark, sf_dir):
    artifacts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("artifact_id"), F.lit("ACTIVE").alias("status"))
    sources = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("artifact_id"), F.col("l_orderkey").alias("document_id"))
    return lifecycle.mark_stale(artifacts, sources, read(spark, sf_dir, "orders").where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("document_id")))


@query(
    """SELECT d.lang AS metric, round(avg(l.quality), 6) AS mean, min(l.quality) AS min, max(l.quality) AS max, count(*) AS n, count(*) FILTER (l.quality < 0.7) AS n_low FROM labels l JOIN documents d USING (doc_id) GROUP BY d.lang"""
)
def eval_aggregate(spark, sf_dir):
    scores = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("metric")), "doc_id").select("metric", F.col("quality").cast("double").alias("value"))
    return lifecycle.evaluation(scores).withColumn("mean", F.round("mean", 6)).withColumn("min", F.col("min").cast("long")).withColumn("max", F.col("max").cast("long"))


@query(
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events),
    a AS (SELECT *, least(greatest(floor(19 * (n + 1) / 20), 1), n - 1) AS lo FROM r)
    SELECT event_type, round(max(CASE WHEN r = lo THEN value END) + (max(CASE WHEN r = lo + 1 THEN value END) - max(CASE WHEN r = lo THEN value END)) * max(19 * (n + 1) / 20 - lo), 6) AS p95 FROM a GROUP BY event_type"""
)
def eval_p95(spark, sf_dir):
    return lifecycle.p95(read(spark, sf_dir, "events"), "value", "event_type").withColumn("p95", F.round("p95", 6))


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")))
def status_counts(spark, sf_dir):
    return lifecycle.count_tables({t: read(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")})


@query("""SELECT c_custkey, c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer ORDER BY c_name, c_custkey LIMIT 100 OFFSET 50""")
def paged_listing(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    rows = lifecycle.count_left(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), orders, "c_custkey", "n_orders")
    return lifecycle.page(rows, ["c_name", "c_custkey"], 100, 50)


@query(
    """WITH i AS (SELECT o_custkey AS k, arg_max(o_orderstatus, o_orderkey) AS v FROM orders GROUP BY o_custkey)
    SELECT c_custkey AS k, coalesce(i.v, c_mktsegment) AS v FROM customer LEFT JOIN i ON i.k = c_custkey"""
)
def upsert_latest(spark, sf_dir):
    stored = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    fresh = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("v"), F.col("o_orderkey").alias("n"))
    latest = fresh.groupBy("k").agg(F.max_by("v", "n").alias("v"))
    return lifecycle.upsert(stored, latest, ["k"])


@query(
    """SELECT p_type AS label, 'store' AS origin FROM part GROUP BY p_type UNION ALL SELECT min(l), 'user' FROM (SELECT DISTINCT upper(p_type) AS l FROM part UNION SELECT p_brand FROM part) WHERE lower(l) NOT IN (SELECT lower(p_type) FROM part) GROUP BY lower(l)"""
)
def suggestion_merge(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    stored = part.select(F.col("p_type").alias("label")).distinct().withColumn("origin", F.lit("store"))
    users = part.select(F.upper("p_type").alias("label")).union(part.select("p_brand")).distinct().withColumn("origin", F.lit("user"))
    return resolution.merge_suggestions(stored, users)


@query(
    """WITH s AS (SELECT source AS name, sha256(min(text)) AS content_hash FROM documents GROUP BY source), n AS (SELECT source AS name, sha256(CASE WHEN source < 'src2' THEN min(text) ELSE max(text) END) AS content_hash FROM documents GROUP BY source)
    SELECT s.name, s.content_hash, CAST(1 AS BIGINT) AS version, CASE WHEN n.content_hash <> s.content_hash THEN 'STALE' ELSE 'ACTIVE' END AS status, NULL AS supersedes FROM s JOIN n USING (name)
    UNION ALL SELECT name, n.content_hash, 2, 'ACTIVE', s.content_hash FROM s JOIN n USING (name) WHERE n.content_hash <> s.content_hash"""
)
def document_versions(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").groupBy(F.col("source").alias("name")).agg(F.min("text").alias("a"), F.max("text").alias("b"))
    stored = docs.select("name", content_hash("a").alias("content_hash"), F.lit(1).cast("long").alias("version"), F.lit("ACTIVE").alias("status"), F.lit(None).cast("string").alias("supersedes"))
    fresh = docs.select("name", content_hash(F.when(F.col("name") < "src2", F.col("a")).otherwise(F.col("b"))).alias("content_hash"))
    return lifecycle.new_versions(stored, fresh)


@query("""SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def unprocessed_documents(spark, sf_dir):
    return lifecycle.unprocessed(read(spark, sf_dir, "documents").select("doc_id", "lang"), read(spark, sf_dir, "labels"), "doc_id")


# --- flagship -------------------------------------------------------------------------

_REACH = f"""{_EDGES}, w(t, i, hop) AS (SELECT 'region', CAST(r_regionkey AS BIGINT), 0 FROM region WHERE r_name = 'ASIA'
      UNION SELECT e.tt, e.ti, w.hop + 1 FROM w JOIN e ON e.st = w.t AND e.si = w.i WHERE w.hop < 2), cand AS (SELECT DISTINCT i AS id FROM w WHERE t = 'customer')"""


@query(
    f"""WITH RECURSIVE {_REACH}, p AS ({_PROBE_ROWS}), nv AS (SELECT count(*) AS n FROM embeddings), c AS (SELECT cand.id, embedding FROM cand, nv JOIN embeddings ON vec_id = cand.id % nv.n),
    d AS (SELECT probe, id, {_DIST.format("embedding", "pv")} AS distance FROM c, p), v AS (SELECT probe + 1 AS list_no, id, row_number() OVER (PARTITION BY probe ORDER BY distance, id) AS rank FROM d),
    h AS (SELECT o_custkey AS id, count(*) AS hits FROM orders WHERE o_custkey IN (SELECT id FROM cand) GROUP BY ALL), g AS (SELECT 9 AS list_no, id, row_number() OVER (ORDER BY hits DESC, id) AS rank FROM h),
    u AS (SELECT * FROM v WHERE rank <= 60 UNION ALL SELECT * FROM g WHERE rank <= 60), s AS (SELECT id, sum(1.0 / (60 + rank)) AS score, min((list_no, rank)) AS f FROM u GROUP BY id)
    SELECT id, round(score, 10) AS score, c_name AS name FROM s JOIN customer ON c_custkey = id ORDER BY round(score, 12) DESC, f, id LIMIT 20"""
)
def evidence_by_fused_rank(spark, sf_dir):
    """Customers near a region by two hops, ranked by three probes and by their orders, fused."""
    seeds = read(spark, sf_dir, "region").where("r_name = 'ASIA'").select(F.lit("region").alias("node_type"), F.col("r_regionkey").cast("long").alias("node_id"))
    reached = graph.bfs(fact_edges(spark, sf_dir), seeds, 2).where("node_type = 'customer'").select(F.col("node_id").alias("id"))
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = vectors.count()
    items = reached.withColumn("vec_id", F.col("id") % n).join(vectors, "vec_id").select("id", "embedding")
    probes = spark.createDataFrame([(i, p) for i, p in enumerate(_PROBES)], "probe int, probe_vector array<double>")
    near = search.rerank(items, probes, 60).select((F.col("probe") + 1).alias("list_no"), "id", "rank")
    linked = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).join(reached, "id", "left_semi").groupBy("id").agg(F.count("*").alias("hits"))
    cover = search.ranked_list(linked.orderBy(F.col("hits").desc(), "id").limit(60), 9, [F.col("hits").desc()])
    best = search.rrf(near.unionByName(cover)).limit(20)
    names = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return best.join(names, "id").select("id", F.round("score", 10).alias("score"), "name")


