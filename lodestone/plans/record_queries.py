"""More queries over the test tables: labels, fields, ids, grids, lists, classes, lookups, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions import shapes as S
from ..functions import text as X
from ..functions import vectors as V
from ..operators import chunking, expansion, graph, lifecycle, resolution, retrieval, search, timeline
from ..sources import tables, web
from . import browse
from . import ontology_import as ontology_store
from . import versions
from .queries import _ISA, _list, fact_edges, query, read, taxonomy

# --- labels and ids -------------------------------------------------------------------


@query(
    f"""WITH p AS (SELECT p_partkey, p_name, p_type, 'https://example.org/v' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '/a#' ELSE '/a/' END || replace(p_name, ' ', '_') AS iri FROM part)
    SELECT p_partkey, regexp_extract(iri, '[#/]([^#/]*)$', 1) AS local, regexp_extract(iri, '^(.*[#/])', 1) AS namespace,
      array_to_string(list_sort(list_distinct(list_filter(string_split(lower(p_name) || ' ' || lower(p_type), ' '), lambda w: w NOT IN ({_list(X.LABEL_STOP_TOKENS)})))), ' ') AS tokens,
      array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS spaced, lower(p_type) AS table_label,
      'https://example.org/base/' || replace(p_name, ' ', '_') AS class_iri FROM p"""
)
def label_parts(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    iri = F.concat(F.lit("https://example.org/v"), F.col("p_size"), F.when(F.col("p_partkey") % 2 == 0, "/a#").otherwise("/a/"), F.replace("p_name", F.lit(" "), F.lit("_")))
    camel = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    return p.select(
        "p_partkey", X.local_name(iri).alias("local"), X.namespace_of(iri).alias("namespace"),
        F.array_join(X.label_tokens(F.concat(F.lit("The "), "p_name", F.lit(" of. "), "p_type", F.lit("!"))), " ").alias("tokens"),
        X.split_camel(camel).alias("spaced"), X.table_label(F.concat(F.lit(" "), "p_type", F.lit(" (USD million) "))).alias("table_label"),
        I.class_iri(F.lit("https://example.org/base/"), "p_name").alias("class_iri"),
    )


@query(
    """SELECT doc_id, 'https://example.org/knowledge#Document_' || substr(sha256(text), 1, 16) AS document_iri,
    'https://example.org/knowledge#Chunk_' || substr(sha256(text), 1, 16) || '_' || lpad(CAST(doc_id % 1000 AS VARCHAR), 4, '0') AS chunk_iri,
    'https://example.org/knowledge#FulltextChunk_' || substr(sha256(text), 1, 16) || '_' || lpad(CAST(doc_id % 1000 AS VARCHAR), 4, '0') AS fulltext_iri,
    'https://example.org/knowledge#Table_' || substr(sha256(text), 1, 16) || '_0007_cell_' || lpad(CAST(doc_id % 100 AS VARCHAR), 3, '0') || '_002' AS cell_iri FROM documents"""
)
def record_iris(spark, sf_dir):
    d = read(spark, sf_dir, "documents").withColumn("h", I.content_hash("text"))
    n = F.col("doc_id") % 1000
    cell = I.part_iri(I.table_iri("h", F.lit(7)), "cell", F.col("doc_id") % 100, F.lit(2))
    return d.select("doc_id", I.document_iri("h").alias("document_iri"), I.chunk_iri("h", n).alias("chunk_iri"), I.chunk_iri("h", n, "FulltextChunk").alias("fulltext_iri"), cell.alias("cell_iri"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS priority,
    o_orderkey % 5 < 3 AS is_number, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderstatus END AS first_part,
    CASE WHEN o_orderkey < 1024 THEN printf('%.0f B', CAST(o_orderkey AS DOUBLE)) WHEN o_orderkey < 1048576 THEN printf('%.1f KB', o_orderkey / 1024.0) ELSE printf('%.1f MB', o_orderkey / 1048576.0) END AS size_text,
    o_orderstatus || CASE WHEN o_orderkey % 4 > 0 THEN ' — ' || o_orderpriority ELSE '' END AS embed_text, 'Order ' || o_orderkey || ' stands.' AS scrubbed,
    'YEAR_' || year(o_orderdate) AS year_term, 'Order_' || o_orderkey || '_' || o_orderstatus AS file_name, 'order-' || o_orderkey || '-' || lower(o_orderstatus) AS folder FROM orders"""
)
def field_parts(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    text = k.cast("string")
    priority = F.when(k % 4 > 0, F.concat(F.lit(" "), "o_orderpriority", F.lit(" "))).otherwise("  ")
    number = F.when(k % 5 == 0, F.concat(F.lit("$"), text)).when(k % 5 == 1, F.concat(F.lit("("), text, F.lit(")"))).when(k % 5 == 2, F.concat(text, F.lit(" %"))).when(k % 5 == 3, F.concat(text, F.lit(" units"))).otherwise("%")
    return o.select(
        "o_orderkey",
        X.date_field(F.when(k % 3 == 0, F.date_format("o_orderdate", " yyyy-MM-dd ")).otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))).alias("day"),
        X.string_field(priority).alias("priority"),
        X.looks_numeric(number).alias("is_number"),
        X.first_nonblank(F.array(F.lit(" "), F.when(k % 2 == 0, F.col("o_orderpriority")).otherwise(""), "o_orderstatus")).alias("first_part"),
        X.human_bytes("o_orderkey").alias("size_text"),
        X.embed_text("o_orderstatus", priority, F.lit(None).cast("string")).alias("embed_text"),
        X.scrub_citations(F.concat(F.lit("Order "), text, F.lit(" [ex:o"), text, F.lit("] stands [https://example.org/x#"), text, F.lit("]."))).alias("scrubbed"),
        X.year_term(F.date_format("o_orderdate", "'since' MMMM yyyy")).alias("year_term"),
        X.safe_filename(F.concat(F.lit("Order  "), text, F.lit("?/"), "o_orderstatus", F.lit("."))).alias("file_name"),
        X.directory_slug(F.concat(F.lit(" Order: "), text, F.lit(" - "), "o_orderstatus")).alias("folder"),
    )


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, event_id % 4 < 3 AS found FROM events WHERE event_id % 4 < 3 UNION ALL SELECT event_id, NULL, false FROM events WHERE event_id % 4 = 3""")
def json_of_answers(spark, sf_dir):
    e, n = read(spark, sf_dir, "events"), F.col("event_id") % 4
    answer = F.when(n == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(n == 1, F.concat(F.lit("Here it is: "), "props", F.lit(" as asked."))).when(n == 2, F.col("props")).otherwise(F.concat(F.lit("none {"), "event_type"))
    found = X.json_text(answer)
    return e.select("event_id", F.get_json_object(found, "$.k").alias("k"), found.isNotNull().alias("found"))


@query(
    """WITH d AS (SELECT vec_id, embedding AS e, list_reverse(embedding) AS r FROM embeddings)
    SELECT vec_id, round(1 - sqrt(list_sum(list_transform(range(1, len(e) + 1), lambda i: pow(CAST(e[i] AS DOUBLE) - CAST(r[i] AS DOUBLE), 2)))) / 2, 6) AS score, len(e) AS dims FROM d"""
)
def vector_scores(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings")
    return v.select("vec_id", F.round(V.distance_score(V.l2_distance("embedding", F.reverse("embedding"))), 6).alias("score"), F.size(V.rounded("embedding")).cast("long").alias("dims"))


@query(
    f"""WITH l AS (SELECT c_custkey, [c_mktsegment || ' Holdings Group', 'Port ' || c_mktsegment || ' closure', 'Mary Ann Smith', 'Prime Minister', lower(c_mktsegment) || ' engine'][c_custkey % 5 + 1] AS label, ['Entity', 'Market event', 'Organization', NULL][c_custkey % 4 + 1] AS parent FROM customer),
    p AS (SELECT *, lower(coalesce(parent, 'owl:Thing')) AS pl, ' ' || lower(label) || ' ' AS padded FROM l),
    s AS (SELECT *, len(list_filter([{_list(S.AUDIT_SUFFIXES)}], lambda x: contains(padded, x))) > 0 AS firm, regexp_matches(lower(label), '\\b({'|'.join(S.EVENT_WORDS)})\\b') AS event FROM p)
    SELECT c_custkey, pl = 'owl:thing' OR (firm AND NOT contains(pl, 'organization')) OR (event AND NOT contains(pl, 'event')) OR (NOT firm AND NOT event AND regexp_matches(label, '^[A-Z]\\S*( [A-Z]\\S*){{1,3}}$')) OR (replace(lower(label), ' ', '') = 'primeminister' AND NOT contains(pl, 'role')) AS suspicious FROM s"""
)
def suspicious_labels(spark, sf_dir):
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    labels = F.array(F.concat("c_mktsegment", F.lit(" Holdings Group")), F.concat(F.lit("Port "), "c_mktsegment", F.lit(" closure")), F.lit("Mary Ann Smith"), F.lit("Prime Minister"), F.concat(F.lower("c_mktsegment"), F.lit(" engine")))
    parents = F.array(F.lit("Entity"), F.lit("Market event"), F.lit("Organization"), F.lit(None).cast("string"))
    return c.select("c_custkey", S.is_suspicious(F.get(labels, (k % 5).cast("int")), F.get(parents, (k % 4).cast("int"))).alias("suspicious"))


@query(
    """SELECT p_type AS label, 'class' AS kind, NULL AS reason FROM part WHERE p_partkey % 2 = 0 GROUP BY p_type UNION ALL SELECT p_type || ' Company', 'entity', 'corporate-suffix' FROM part GROUP BY p_type
    UNION ALL SELECT '2021 ' || p_type, 'entity', 'year-prefix' FROM part GROUP BY p_type"""
)
def promoted_entities(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    labels = p.where("p_partkey % 2 = 0").select(F.col("p_type").alias("label")).union(p.select(F.concat("p_type", F.lit(" Company")))).union(p.select(F.concat(F.lit("2021 "), "p_type"))).distinct()
    classes, entities = expansion.promote_entities(labels, S.entity_shape("label"))
    return classes.select("label", F.lit("class").alias("kind"), F.lit(None).cast("string").alias("reason")).union(entities.select("label", F.lit("entity"), "reason"))


# --- tables -----------------------------------------------------------------------------


@query(
    """WITH g AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, n >= 2 AS simple, CASE WHEN n < 3 THEN NULL WHEN n >= 5 AND (n - r) / n >= 0.7 THEN 'toc-or-index' WHEN r >= 4 AND r / (3.0 * n) >= 0.25 THEN 'bibliography' END AS noise, n * 10 / 1000.0 < 0.02 AS thin,
    l_orderkey % 5 >= 2 AS fabricated FROM g"""
)
def grid_filters(spark, sf_dir):
    last = F.when(F.col("l_returnflag") == "R", "Smith et al., 1999").otherwise(F.col("l_quantity").cast("int").cast("string"))
    cells = F.struct(F.col("l_linenumber").cast("string").alias("a"), F.col("l_linestatus").alias("b"), last.alias("c"))
    grid = F.transform(F.array_sort(F.collect_list(cells)), lambda r: F.array(r["a"], r["b"], r["c"]))
    g = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(grid.alias("grid"))
    invented = F.slice(F.array(F.lit("Category A"), F.lit(" category b"), F.lit("Item 1"), F.lit("Column 2")), F.lit(1), (F.col("l_orderkey") % 5).cast("int"))
    return g.select("l_orderkey", S.is_simple_grid("grid").alias("simple"), S.grid_noise("grid").alias("noise"), S.is_thin_band(F.lit(5.0), F.lit(5.0) + F.size("grid") * 10, F.lit(1000.0)).alias("thin"), S.is_fabricated(F.concat(invented, F.array(F.lit("Revenue")))).alias("fabricated"))


@query(
    """SELECT lower(p_type) AS label, parent_iri, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS sources, arg_min(p_type || CASE WHEN p_partkey % 2 = 0 THEN ' (USD)' ELSE '' END, (p_brand, p_partkey)) AS first_label
    FROM (SELECT *, CASE WHEN p_size <= 20 THEN 'small' WHEN p_size <= 40 THEN 'large' ELSE 'other' END AS parent_iri FROM part) WHERE parent_iri <> 'other' GROUP BY p_type, parent_iri"""
)
def table_concepts(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    parent = F.when(F.col("p_size") <= 20, "small").when(F.col("p_size") <= 40, "large").otherwise("other")
    label = F.concat("p_type", F.when(F.col("p_partkey") % 2 == 0, " (USD)").otherwise(""))
    found = tables.concepts(p.select(label.alias("label"), parent.alias("parent_iri"), F.col("p_brand").alias("table_id"), F.col("p_partkey").alias("position")), ("small", "large"))
    return found.withColumn("sources", F.array_join("sources", ","))


@query(
    """WITH k AS (SELECT c_custkey AS id, lower(c_mktsegment) || ' ' || c_custkey % 400 AS short FROM customer), f AS (SELECT id, CASE WHEN id % 3 = 0 THEN short || ' inc' ELSE short END AS n, short FROM k),
    v AS (SELECT id, n AS variant, true AS whole FROM f UNION SELECT id, short, n = short FROM f),
    g AS (SELECT variant, count(DISTINCT CASE WHEN whole THEN id END) AS n_full, min(CASE WHEN whole THEN id END) AS full_id, count(DISTINCT id) AS n, min(id) AS id FROM v GROUP BY variant)
    SELECT variant, CASE WHEN n_full = 1 THEN full_id ELSE id END AS entity_id FROM g WHERE n_full = 1 OR (n_full = 0 AND n = 1)"""
)
def name_dictionary(spark, sf_dir):
    k = F.col("c_custkey")
    name = F.concat(F.lower("c_mktsegment"), F.lit(" "), (k % 400).cast("string"), F.when(k % 3 == 0, " inc").otherwise(""))
    return resolution.name_dictionary(read(spark, sf_dir, "customer").select(k.alias("entity_id"), name.alias("normalized")))


@query("""SELECT p_partkey, n_name FROM part JOIN (SELECT n_name, n_nationkey FROM nation) ON n_nationkey = p_partkey % 40""")
def cells_by_name(spark, sf_dir):
    strings = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" Nation_"), (F.col("p_partkey") % 40).cast("string"), F.lit("! ")).alias("cell"))
    names = read(spark, sf_dir, "nation").select(F.col("n_name").alias("entity_id"), X.normalize_name("n_name").alias("normalized"))
    return resolution.link_by_name(strings, resolution.name_dictionary(names), "cell").select("p_partkey", F.col("entity_id").alias("n_name"))


# --- lists and edges --------------------------------------------------------------------


@query("""SELECT n_nationkey AS target_id, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def typed_edge_counts(spark, sf_dir):
    met = retrieval.typed_edges(fact_edges(spark, sf_dir), source_type="customer", target_type="nation")
    return met.groupBy(F.col("target_id").cast("int").alias("target_id")).agg(F.count("*").alias("n"))


@query("""SELECT event_type, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') IS DISTINCT FROM '3' GROUP BY ALL""")
def json_is_distinct(spark, sf_dir):
    return read(spark, sf_dir, "events").where(~F.get_json_object("props", "$.k").eqNullSafe("3")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT source, count(*) AS n FROM documents WHERE lang = 'fr' OR NOT EXISTS (SELECT 1 FROM documents WHERE lang = 'fr') GROUP BY source""")
def prefer_fulltext(spark, sf_dir):
    chunks = read(spark, sf_dir, "documents").select("source", F.when(F.col("lang") == "fr", "fulltext").otherwise("summary").alias("kind"))
    return retrieval.prefer_fulltext(chunks).groupBy("source").agg(F.count("*").alias("n"))


@query("""SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey""")
def first_wins(spark, sf_dir):
    return resolution.first_wins(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"])


@query(
    """WITH l AS (SELECT o_custkey AS id, min(o_orderkey) AS position, 0 AS list_no FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL UNION ALL SELECT o_custkey, min(o_orderkey), 1 FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL UNION ALL SELECT c_custkey, c_custkey, 2 FROM customer)
    SELECT id, min(list_no) AS list_no, arg_min(position, (list_no, position)) AS position FROM l GROUP BY id"""
)
def append_absent(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    of = lambda s: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderkey").alias("position"))
    return retrieval.append_absent([of("F"), of("P"), read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("position"))], "id")


@query("""SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem EXCEPT SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'""")
def new_edges(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    return timeline.new_edges(rows.select("l_orderkey", "l_suppkey"), rows.where("l_returnflag = 'R'").select("l_orderkey", "l_suppkey"), ["l_orderkey", "l_suppkey"])


@query("""SELECT l_orderkey, l_partkey FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A')""")
def validated_classes(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    return resolution.validate_class(rows, rows.where("l_returnflag = 'A'"), ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_partkey")


@query(
    """WITH t AS (SELECT DISTINCT p_name AS label FROM part), c AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN array_to_string(list_reverse(string_split(p_name, ' ')), ' the ') ELSE p_name || ' ' || lower(p_type) END AS candidate FROM part),
    a AS (SELECT candidate, lower(candidate) AS k, list_sort(list_distinct(list_filter(string_split(lower(candidate), ' '), lambda w: w <> 'the'))) AS s FROM c), b AS (SELECT label, list_sort(list_distinct(string_split(label, ' '))) AS s FROM t),
    m AS (SELECT candidate, label, CASE WHEN k = label THEN 1 WHEN a.s = b.s THEN 2 ELSE 3 END AS r FROM a JOIN b ON k = label OR a.s = b.s OR (len(a.s) <> len(b.s) AND len(list_intersect(a.s, b.s)) = least(len(a.s), len(b.s))))
    SELECT candidate, arg_min(label, (r, label)) AS iri, ['exact', 'tokens', 'containment'][min(r)] AS how FROM m GROUP BY candidate"""
)
def token_set_match(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey") % 3
    words = F.array_join(F.reverse(F.split("p_name", " ")), " the ")
    candidate = F.when(k == 0, F.upper("p_name")).when(k == 1, words).otherwise(F.concat("p_name", F.lit(" "), F.lower("p_type")))
    candidates = p.select(candidate.alias("candidate"), F.lit("m").alias("parent")).distinct()
    labels = p.select(F.col("p_name").alias("iri"), F.col("p_name").alias("label"), F.lit("m").alias("parent")).distinct()
    return search.token_set_match(candidates, labels).select("candidate", "iri", "how")


@query(
    """WITH r AS (SELECT 0 AS part, 0 AS n, 'Which nations?' AS text UNION ALL SELECT 1, r_regionkey, r_name FROM region UNION ALL SELECT 2, n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'asia' END FROM nation WHERE n_nationkey < 8),
    f AS (SELECT lower(text) AS k, min((part, n)) AS p, arg_min(text, (part, n)) AS text FROM r GROUP BY lower(text)) SELECT row_number() OVER (ORDER BY p) AS probe, text FROM f"""
)
def probe_texts(spark, sf_dir):
    question = spark.createDataFrame([("Which nations?",)], "text string")
    expanded = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n"), F.col("r_name").alias("text"))
    entities = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("asia").alias("text"))
    return retrieval.probe_texts(question, expanded, entities).withColumn("probe", F.col("probe").cast("long"))


# --- classes ----------------------------------------------------------------------------

_PROPERTIES = "pr AS (SELECT 'p' || s_suppkey AS iri, 'n' || s_nationkey AS d, 'r' || CAST(s_suppkey % 5 AS VARCHAR) AS r FROM supplier)"


@query(f"""WITH {_PROPERTIES} SELECT d AS class_iri, 'domain' AS role, array_to_string(list_sort(list(iri)), ',') AS properties FROM pr GROUP BY d UNION ALL SELECT r, 'range', array_to_string(list_sort(list(iri)), ',') FROM pr GROUP BY r""")
def properties_by_class(spark, sf_dir):
    return graph.properties_by_class(taxonomy(spark, sf_dir)[1]).withColumn("properties", F.array_join("properties", ","))


@query(f"""WITH RECURSIVE {_ISA}, d(node) AS (SELECT DISTINCT parent FROM isa WHERE parent = 'r2' UNION SELECT isa.child FROM d JOIN isa ON isa.parent = d.node) SELECT lower(node) AS label FROM d""")
def known_places(spark, sf_dir):
    return graph.known_places(taxonomy(spark, sf_dir)[0], ("R2",))


@query(f"""WITH {_ISA} SELECT DISTINCT iri FROM (SELECT 'n3' AS iri UNION SELECT parent FROM isa WHERE child = 'n3' UNION SELECT child FROM isa WHERE parent = 'n3' UNION SELECT 'r4')""")
def ontology_slice(spark, sf_dir):
    edges = graph.isa_index(taxonomy(spark, sf_dir)[0]).select(F.col("child").alias("a"), F.col("parent").alias("b"))
    return graph.slice_for(taxonomy(spark, sf_dir)[0], edges, spark.createDataFrame([("n3",)], "node string"), ("r4",)).select("iri")


def _kinds(spark, sf_dir):
    """Classes named after part names; every fourth hangs on nothing."""
    p = read(spark, sf_dir, "part")
    iri = F.concat(F.lit("https://example.org/base/"), X.slugify("p_name"))
    return p.groupBy(iri.alias("iri"), F.col("p_name").alias("label")).agg(F.when(F.min("p_partkey") % 4 > 0, F.concat(F.lit("https://example.org/base/"), F.min(F.lower("p_type")))).alias("parent")).select("iri", "label", "parent", F.array().cast("array<string>").alias("descriptions"), F.lit("file").alias("origin"))


_KINDS = "k AS (SELECT 'https://example.org/base/' || replace(p_name, ' ', '_') AS iri, p_name AS label, CASE WHEN min(p_partkey) % 4 > 0 THEN 'https://example.org/base/' || min(lower(p_type)) END AS parent FROM part GROUP BY p_name)"


@query(
    f"""WITH {_KINDS}, t AS (SELECT DISTINCT upper(string_split(label, ' ')[1]) AS c FROM k)
    SELECT iri, label, coalesce(parent, 'https://example.org/base/' || lower(string_split(label, ' ')[1])) AS parent, 'file' AS origin FROM k UNION ALL SELECT 'https://example.org/base/' || lower(c), c, 'top', 'concept' FROM t"""
)
def grouped_orphans(spark, sf_dir):
    kinds = _kinds(spark, sf_dir)
    loose = expansion.orphans(kinds, "https://example.org/base/")
    first = F.upper(F.get(F.split("label", " "), F.lit(0)))
    concepts = kinds.select(first.alias("label"), F.lit("").alias("description")).distinct()
    return expansion.apply_grouping(kinds, concepts, loose.select(F.col("label").alias("class_label"), first.alias("concept_label")), "https://example.org/base/", "top").select("iri", "label", "parent", "origin")


@query(
    f"""WITH {_KINDS}, d AS (SELECT *, length(label) % 3 AS a FROM k)
    SELECT 'class' AS kind, iri, label, CASE WHEN a = 1 THEN 'https://example.org/base/thing' ELSE parent END AS parent FROM d WHERE a < 2 UNION ALL SELECT 'class', 'https://example.org/base/thing', 'Thing', NULL
    UNION ALL SELECT 'instance', iri, label, 'https://example.org/base/thing' FROM d WHERE a = 2"""
)
def audited_classes(spark, sf_dir):
    kinds = _kinds(spark, sf_dir)
    action = F.get(F.array(F.lit("keep"), F.lit(" re_home"), F.lit("CONVERT_TO_INSTANCE")), F.length("label") % 3)
    classes, instances = expansion.apply_audit(kinds, kinds.select("iri", action.alias("action"), F.lit("Thing").alias("new_parent")), "https://example.org/base/")
    return classes.select(F.lit("class").alias("kind"), "iri", "label", "parent").union(instances.select(F.lit("instance"), "iri", "label", "type_iri"))


@query(f"""WITH {_KINDS} SELECT label, coalesce(CASE label WHEN 'red widget' THEN 'https://example.org/base/red_widget' END, label) AS coerced FROM k""")
def coerced_labels(spark, sf_dir):
    kinds = _kinds(spark, sf_dir)
    rows = kinds.select("label", F.upper("label").alias("coerced"))
    out = expansion.coerce_labels(rows, "coerced", {"Red Widget": "https://example.org/base/red_widget", "small ring": "https://example.org/other"}, kinds)
    return out.withColumn("coerced", F.when(F.col("coerced").startswith("https:"), F.col("coerced")).otherwise(F.lower("coerced")))


@query("""SELECT c_custkey, CAST((row_number() OVER (ORDER BY c_custkey) - 1) // 40 AS BIGINT) AS batch FROM customer""")
def batched_rows(spark, sf_dir):
    return expansion.batches_of(read(spark, sf_dir, "customer").select("c_custkey"), 40, "c_custkey").withColumn("batch", F.col("batch").cast("long"))


# --- texts ------------------------------------------------------------------------------


@query(
    """SELECT doc_id, CASE WHEN len(w) = 0 THEN ' ' WHEN len(w) <= 300 THEN text ELSE array_to_string(w[1:300], ' ') END AS truncated, CASE WHEN len(w) <= 200 THEN text ELSE substr(text, 1, 40) END AS gated
    FROM (SELECT doc_id, text, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents)"""
)
def bounded_texts(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", chunking.truncate("text", 300).alias("truncated"), chunking.summarize_if_long("text", lambda t: F.substring(t, 1, 40), 200).alias("gated"))


@query("""SELECT page_id, url AS target, 'https://archive.example.org/data/' || page_id || '/' || lpad(CAST(page_id AS VARCHAR), 10, '0') || '00' || lpad(CAST(page_id % 1000000 AS VARCHAR), 6, '0') || '/index.json' AS filing FROM pages""")
def unwrapped_links(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    link = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("//search.example.org/l/?uddg="), F.url_encode("url"), F.lit("&rut=1"))).otherwise(F.col("url"))
    number = F.format_string("%010d-00-%06d", F.col("page_id"), F.col("page_id") % 1000000)
    return pages.select("page_id", X.unwrap_redirect(link).alias("target"), web.filing_index_url("https://archive.example.org/data", F.col("page_id").cast("string"), number).alias("filing"))


# --- lookups ----------------------------------------------------------------------------


def _corpus(spark, sf_dir):
    """Documents as chunks of one document a source, and what they are about."""
    d = read(spark, sf_dir, "documents").withColumn("chunk_id", F.col("doc_id").cast("string"))
    chunks = d.select("chunk_id", F.col("source").alias("document_id"), F.col("doc_id").alias("chunk_index"), "text")
    documents = d.select(F.col("source").alias("document_id"), F.upper("source").alias("title"), F.when(F.col("source") == "src3", "DELETED").otherwise("ACTIVE").alias("status")).distinct()
    edge = lambda kind, p, source: d.select(F.lit(kind).alias("source_type"), source.alias("source_id"), F.lit(p).alias("predicate"), F.lit("entity").alias("target_type"), F.col("lang").alias("target_id"), F.lit("DOCUMENT_EXTRACTION").alias("relationship_source"))
    return chunks, documents, edge("chunk", "assertsAbout", F.col("chunk_id")).union(edge("artifact", "assertsAbout", F.col("source")))


@query("""SELECT source AS document_id, upper(source) AS title, count(*) AS n_chunks FROM documents WHERE source <> 'src3' GROUP BY source ORDER BY title, source LIMIT 10 OFFSET 2""")
def browse_documents(spark, sf_dir):
    chunks, documents, _ = _corpus(spark, sf_dir)
    return browse.list_documents(documents, chunks, limit=10, offset=2).select("document_id", "title", "n_chunks")


@query("""SELECT source AS document_id, CAST(doc_id AS VARCHAR) AS chunk_id, doc_id AS chunk_index, substr(text, 1, 200) || '...' AS snippet FROM documents WHERE source = 'src1' ORDER BY doc_id LIMIT 20""")
def browse_document(spark, sf_dir):
    chunks, documents, _ = _corpus(spark, sf_dir)
    return browse.document(documents, chunks, "src1").select("document_id", "chunk_id", "chunk_index", "snippet")


@query("""SELECT CAST(doc_id AS VARCHAR) AS chunk_id, substr(text, 1, 200) || '...' AS snippet, source AS document_id, upper(source) AS title FROM documents WHERE lang = 'de' ORDER BY chunk_id LIMIT 20""")
def browse_entity(spark, sf_dir):
    chunks, documents, edges = _corpus(spark, sf_dir)
    return browse.entity("de", edges, chunks, documents)


@query(f"""WITH {_ISA} SELECT * FROM (SELECT DISTINCT 'subclass' AS kind, child AS id, upper(child) AS label FROM isa WHERE parent = 'r2' ORDER BY id LIMIT 30) UNION ALL SELECT * FROM (SELECT 'entity', CAST(c_custkey AS VARCHAR) AS id, c_name FROM customer WHERE c_mktsegment = 'MACHINERY' ORDER BY id LIMIT 30)""")
def browse_class(spark, sf_dir):
    entities = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("entity_id"), F.col("c_name").alias("name"), F.when(F.col("c_mktsegment") == "MACHINERY", "r2").otherwise("x").alias("class_iri"))
    return browse.ontology_class("r2", taxonomy(spark, sf_dir)[0], entities)


@query(
    """SELECT * FROM (SELECT 'source' AS kind, CAST(doc_id AS VARCHAR) AS id, substr(text, 1, 200) || '...' AS text FROM documents WHERE source = 'src2' ORDER BY id LIMIT 20)
    UNION ALL SELECT 'entity', lang, upper(lang) FROM documents WHERE source = 'src2' GROUP BY lang"""
)
def browse_artifact(spark, sf_dir):
    chunks, documents, edges = _corpus(spark, sf_dir)
    sources = chunks.select(F.col("document_id").alias("artifact_id"), "chunk_id")
    entities = edges.select(F.col("target_id").alias("entity_id"), F.upper("target_id").alias("name")).distinct()
    return browse.artifact("src2", sources, chunks, documents, edges, entities)


@query("""SELECT o_orderkey AS run_id, o_orderstatus, coalesce(l_linenumber, 0) AS rank, substr(l_shipinstruct, 1, 3) AS snippet FROM orders LEFT JOIN (SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus || '-cut' AS l_shipinstruct FROM lineitem WHERE l_linenumber <= 2) ON l_orderkey = o_orderkey""")
def run_traces(spark, sf_dir):
    runs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), "o_orderstatus")
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("rank"), F.lit("chunk").alias("kind"), F.col("l_quantity").alias("score"), F.concat("l_returnflag", "l_linestatus", F.lit("-cut")).alias("snippet"))
    return lifecycle.trace(runs, rows, 2, 3).select("run_id", "o_orderstatus", F.coalesce("rank", F.lit(0)).alias("rank"), "snippet")


@query("""SELECT event_type AS task, count(*) AS calls, round(sum(value), 4) AS cost, round(sum(user_id % 7) / sum(user_id + 7), 6) AS cache_rate FROM events GROUP BY event_type""")
def cost_by_task(spark, sf_dir):
    log = read(spark, sf_dir, "events").select(F.col("event_type").alias("task"), F.col("value").alias("cost"), (F.col("user_id") + 7).alias("tokens"), (F.col("user_id") % 7).alias("cached_tokens"))
    return lifecycle.cost_by_task(log).withColumn("cost", F.round("cost", 4)).withColumn("cache_rate", F.round("cache_rate", 6))


@query("""SELECT 'nation' AS source_type, count(*) AS n FROM nation""")
def wiped_corpus(spark, sf_dir):
    edges = fact_edges(spark, sf_dir).withColumn("relationship_source", F.when(F.col("source_type") == "nation", "ONTOLOGY").otherwise("DOCUMENT_EXTRACTION"))
    _, left = lifecycle.wipe_corpus({"documents": read(spark, sf_dir, "documents")}, edges, 1, True)
    return left.groupBy("source_type").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_ISA}, k AS (SELECT child AS iri FROM isa UNION SELECT parent FROM isa)
    SELECT 'class' AS kind, iri, upper(iri) AS a, CASE WHEN starts_with(iri, 'r') THEN 'kept' ELSE 'made' END AS b FROM k
    UNION ALL SELECT 'edge', child, parent, '7' FROM isa UNION ALL SELECT 'edge', 'doc', 'n1', '3'
    UNION ALL SELECT 'property', 'p' || s_suppkey, s_name, 'object' FROM supplier UNION ALL SELECT 'instance', 'c' || c_custkey, c_name, 'n' || c_nationkey FROM customer"""
)
def ontology_import(spark, sf_dir):
    classes, _ = taxonomy(spark, sf_dir)
    incoming = classes.withColumn("name", F.col("iri")).withColumn("labels", F.array(F.lit(" "), F.upper("iri"))).drop("label")
    named = lambda df, iri, label: df.select(iri.alias("iri"), F.col(label).alias("name"), F.array().cast("array<string>").alias("labels"), F.array(F.lit("file")).alias("sources"))
    props = named(read(spark, sf_dir, "supplier"), F.concat(F.lit("p"), "s_suppkey"), "s_name")
    people = read(spark, sf_dir, "customer")
    instances = people.select(F.concat(F.lit("c"), "c_custkey").alias("iri"), F.col("c_name").alias("name"), F.array(F.struct(F.concat(F.lit("n"), "c_nationkey").alias("iri"))).alias("types"))
    empty = lambda ddl: spark.createDataFrame([], ddl)
    regions = classes.where(F.col("iri").startswith("r")).select("iri", "label", F.lit(None).cast("string").alias("description"), F.lit("").alias("namespace"), F.lit("kept").alias("source"), F.array(F.lit(1.0)).alias("embedding"))
    five = "iri string, label string, description string, namespace string, source string"
    edges = spark.createDataFrame([("chunk", "doc", "assertsAbout", "ontology_class", "n1", "DOCUMENT_EXTRACTION", 3), ("ontology_class", "n1", "subClassOf", "ontology_class", "gone", "ONTOLOGY", 2)], ", ".join(f"{c} string" for c in ontology_store.EDGE[:-1]) + ", graph_version long")
    store = ontology_store.Store(regions, empty(five + ", kind string"), empty(five + ", type_iri string"), edges)
    new = ontology_store.import_ontology(store, incoming.withColumn("equivalent_to", F.array(F.struct("iri"))), {"object": props}, instances, 7, lambda text: F.array(F.length(text).cast("double")))
    out = new.classes.select(F.lit("class").alias("kind"), "iri", F.col("label").alias("a"), F.coalesce("source", F.lit("made")).alias("b"))
    out = out.union(ontology_store.as_of(new.edges, 7).select(F.lit("edge"), "source_id", "target_id", F.col("graph_version").cast("string")))
    return out.union(new.properties.select(F.lit("property"), "iri", "label", "kind")).union(new.instances.select(F.lit("instance"), "iri", "label", "type_iri"))


@query(
    f"""WITH {_KINDS}, m AS (SELECT iri AS old, 'https://example.org/moved/' || replace(label, ' ', '_') AS new, 'https://example.org/top' AS parent FROM k WHERE length(label) % 2 = 0), c AS (SELECT iri, label, parent FROM k UNION ALL SELECT 'https://example.org/leaf/' || replace(label, ' ', '_'), label, iri FROM k)
    SELECT coalesce(m.new, c.iri) AS iri, c.label, coalesce(r.new, m.parent, c.parent) AS parent FROM c LEFT JOIN m ON m.old = c.iri LEFT JOIN m r ON r.old = coalesce(m.parent, c.parent)"""
)
def moved_classes(spark, sf_dir):
    kinds = _kinds(spark, sf_dir).select("iri", "label", "parent")
    leaves = kinds.select(F.concat(F.lit("https://example.org/leaf/"), X.slugify("label")), "label", F.col("iri").alias("parent"))
    moves = kinds.where(F.length("label") % 2 == 0).select(F.col("iri").alias("old"), F.concat(F.lit("https://example.org/moved/"), X.slugify("label")).alias("new"), F.lit("https://example.org/top").alias("parent"))
    return expansion.move(kinds.union(leaves), moves)


@query(f"""WITH {_KINDS} SELECT iri AS old, 'https://example.org/project/' || replace(label, ' ', '_') AS new FROM k WHERE label NOT IN ('red widget', 'small ring')""")
def repaired_classes(spark, sf_dir):
    return versions.repaired(_kinds(spark, sf_dir), "https://example.org/project/", ("https://example.org/base/",), ("red_widget", "small_ring"))


@query(
    """WITH p AS (SELECT p_partkey, p_name || CASE WHEN p_partkey % 3 = 0 THEN ' river' ELSE '' END AS label, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'https://example.org/ontology/geography#Place' WHEN 2 THEN 'https://example.org/ontology/geography#Island' ELSE 'https://example.org/thing' END AS parent FROM part)
    SELECT p_partkey, parent IS NULL OR NOT contains(parent, 'geography') OR label LIKE '% river' OR parent LIKE '%#Island' AS safe FROM p"""
)
def safe_parents(spark, sf_dir):
    k = F.col("p_partkey")
    label = F.concat("p_name", F.when(k % 3 == 0, " River").otherwise(""))
    parent = F.when(k % 4 == 1, "https://example.org/ontology/geography#Place").when(k % 4 == 2, "https://example.org/ontology/geography#Island").when(k % 4 == 3, "https://example.org/thing")
    return read(spark, sf_dir, "part").select("p_partkey", expansion.safe_parent(label, parent).alias("safe"))


@query(
    """WITH c AS (SELECT p_partkey AS k, ['Island_', 'River_Delta_', 'Market_', 'War_Island_'][p_partkey % 4 + 1] || p_partkey AS n FROM part)
    SELECT 'https://example.org/a#' || n AS old, 'https://example.org/g#' || n AS new, 'https://example.org/g#' || CASE k % 4 WHEN 0 THEN 'Island' ELSE 'Delta' END AS parent, 'landform:' || CASE k % 4 WHEN 0 THEN 'island' ELSE 'delta' END AS signal FROM c WHERE k % 4 < 2"""
)
def landform_places(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.concat(F.get(F.array(F.lit("Island_"), F.lit("River_Delta_"), F.lit("Market_"), F.lit("War_Island_")), (k % 4).cast("int")), k.cast("string"))
    rows = read(spark, sf_dir, "part").select(F.concat(F.lit("https://example.org/a#"), name).alias("iri"), F.replace(name, F.lit("_"), F.lit(" ")).alias("label"), F.lit(None).cast("string").alias("parent"))
    homes = spark.createDataFrame([(f"https://example.org/g#{n}", n, "https://example.org/g#Place") for n in ("Island", "Delta", "River")], "iri string, label string, parent string")
    return expansion.place_landforms(rows.union(homes))


@query("""SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_partkey % 3 = 0 AND l_suppkey % 3 = 0""")
def visible_edges(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    nodes = rows.select(F.col("a").alias("node")).union(rows.select("b")).where("node % 3 = 0")
    return graph.visible_edges(rows, nodes)


@query("""SELECT p_partkey, '<p>Price of ' || p_name || ': ' || p_partkey || '</p><p>end</p>' AS page FROM part""")
def unwrapped_facts(spark, sf_dir):
    page = F.concat(F.lit("<p>Price of <ix:nonNumeric name=\"n\">"), "p_name", F.lit("</ix:nonNumeric>: <ix:nonFraction unitRef='usd'>"), F.col("p_partkey").cast("string"), F.lit("</ix:nonFraction></p><div style=\"display:none\"><span>ref</span></div><p>end</p>"))
    return read(spark, sf_dir, "part").select("p_partkey", web.without_inline_facts(page).alias("page"))


@query(
    """WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents)
    SELECT doc_id, CAST(ceil(len(w) / 150.0) AS BIGINT) AS n_pieces, md5(array_to_string(w, ' ')) AS digest FROM w"""
)
def section_pieces(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", chunking.split_on_sections("text", 150).alias("p"))
    return d.select("doc_id", F.size("p").cast("long").alias("n_pieces"), F.md5(F.array_join(chunking.tokens(F.array_join("p", " ")), " ").cast("binary")).alias("digest"))
