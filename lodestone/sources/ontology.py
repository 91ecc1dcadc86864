"""Ontology files as triples, records from triples, merges, imports, and export.

RDF/XML and a subset of Turtle are parsed with the standard library, one file a row, in
Arrow batches; everything after that is a table of triples.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import local_name, namespace_of
from .documents import read_files

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XML = "http://www.w3.org/XML/1998/namespace"
SUFFIXES = ("owl", "rdf", "xml", "ttl")
TRIPLE = "source string, subject string, predicate string, object string, is_literal boolean, lang string, error string"


def resolve_entities(text: str, rounds: int = 5) -> str:
    """XML with its internal general entities written out; nested ones need more than one round."""
    entities = dict(re.findall(r"<!ENTITY\s+(\S+)\s+[\"']([^\"']*)[\"']\s*>", text))
    body = re.sub(r"<!DOCTYPE.*?\]\s*>", "", text, count=1, flags=re.S)
    for _ in range(rounds):
        changed = re.sub(r"&(\w[\w.-]*);", lambda m: entities.get(m.group(1), m.group(0)), body)
        if changed == body:
            break
        body = changed
    return body


def parse_rdfxml(text: str) -> Iterator[tuple[str, str, str, bool, str | None]]:
    """Triples of an RDF/XML document; nodes without a name are ``_:n``."""
    root = ET.fromstring(resolve_entities(text))
    base = root.get(f"{{{XML}}}base") or ""
    fresh = iter(range(1 << 60))

    def iri(value: str) -> str:
        return value if re.match(r"[a-zA-Z][\w+.-]*:", value) or value.startswith("_:") else base + value

    def name(tag: str) -> str:
        return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag

    def subject_of(element: ET.Element) -> str:
        about, node, own = element.get(f"{{{RDF}}}about"), element.get(f"{{{RDF}}}nodeID"), element.get(f"{{{RDF}}}ID")
        if about is not None:
            return iri(about)
        if own is not None:
            return iri(f"#{own}")
        return f"_:{node}" if node is not None else f"_:n{next(fresh)}"

    stack: list[tuple[ET.Element, str]] = [(e, subject_of(e)) for e in reversed(root if name(root.tag) == RDF + "RDF" else [root])]
    while stack:
        element, subject = stack.pop()
        if name(element.tag) != RDF + "Description":
            yield subject, RDF + "type", name(element.tag), False, None
        for key, value in element.attrib.items():
            if not key.startswith((f"{{{RDF}}}", f"{{{XML}}}")):
                yield subject, name(key), value, True, None
        for child in element:
            predicate, resource = name(child.tag), child.get(f"{{{RDF}}}resource")
            inner = list(child)
            if resource is not None:
                yield subject, predicate, iri(resource), False, None
            elif child.get(f"{{{RDF}}}parseType") == "Collection":
                heads = [f"_:n{next(fresh)}" for _ in inner]
                yield subject, predicate, heads[0] if heads else RDF + "nil", False, None
                for i, member in enumerate(inner):
                    node = subject_of(member)
                    yield heads[i], RDF + "first", node, False, None
                    yield heads[i], RDF + "rest", heads[i + 1] if i + 1 < len(heads) else RDF + "nil", False, None
                    stack.append((member, node))
            elif child.get(f"{{{RDF}}}parseType") == "Resource":
                node = f"_:n{next(fresh)}"
                yield subject, predicate, node, False, None
                holder = ET.Element(f"{{{RDF}}}Description")
                holder.extend(inner)
                stack.append((holder, node))
            elif inner:
                for member in inner:
                    node = subject_of(member)
                    yield subject, predicate, node, False, None
                    stack.append((member, node))
            elif child.get(f"{{{RDF}}}nodeID") is not None:
                yield subject, predicate, "_:" + child.get(f"{{{RDF}}}nodeID"), False, None
            else:
                yield subject, predicate, child.text or "", True, child.get(f"{{{XML}}}lang")


_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>\s]*>)|(?P<str>\"\"\"(?:.|\n)*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|(?P<lang>@[a-zA-Z][\w-]*)|(?P<typed>\^\^)|(?P<blank>_:[\w-]+)|(?P<mark>[;,.\[\]()](?!\d))|(?P<number>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<name>[\w-]*:[\w%.~-]*[\w%~-]|[\w-]*:|\w+)""",
)


def parse_turtle(text: str) -> Iterator[tuple[str, str, str, bool, str | None]]:
    """Triples of a Turtle document: prefixes, base, predicate and object lists, literals, blank nodes and lists."""
    parts: list[tuple[str, str]] = []
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise ValueError(f"not Turtle at {at}: {text[at : at + 30]!r}")
        if m.lastgroup:
            parts.append((m.lastgroup, m.group()))
        at = m.end()
    prefixes, base, pos, fresh = {}, "", 0, iter(range(1 << 60))
    out: list[tuple[str, str, str, bool, str | None]] = []

    def peek() -> tuple[str, str]:
        return parts[pos] if pos < len(parts) else ("end", "")

    def take(value: str | None = None) -> tuple[str, str]:
        nonlocal pos
        got = peek()
        if value is not None and got[1] != value:
            raise ValueError(f"Turtle: {value} expected, {got[1]!r} found")
        pos += 1
        return got

    def full(kind: str, value: str) -> str:
        if kind == "iri":
            inner = value[1:-1]
            return inner if re.match(r"[a-zA-Z][\w+.-]*:", inner) else base + inner
        if kind == "blank":
            return value
        if value == "a":
            return RDF + "type"
        prefix, _, rest = value.partition(":")
        if prefix not in prefixes:
            raise ValueError(f"Turtle: unknown prefix {prefix!r}")
        return prefixes[prefix] + rest

    def term() -> tuple[str, bool, str | None]:
        kind, value = take()
        if value == "[":
            node = f"_:n{next(fresh)}"
            if peek()[1] != "]":
                statements(node)
            take("]")
            return node, False, None
        if value == "(":
            items = []
            while peek()[1] != ")":
                items.append(term())
            take(")")
            heads = [f"_:n{next(fresh)}" for _ in items]
            for i, (item, literal, lang) in enumerate(items):
                out.append((heads[i], RDF + "first", item, literal, lang))
                out.append((heads[i], RDF + "rest", heads[i + 1] if i + 1 < len(heads) else RDF + "nil", False, None))
            return heads[0] if heads else RDF + "nil", False, None
        if kind == "str":
            cut = 3 if value.startswith('"""') else 1
            body = re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m.group(1), chr(int(m.group(1)[1:], 16)) if m.group(1)[0] == "u" and len(m.group(1)) == 5 else m.group(1)), value[cut:-cut])
            lang = None
            if peek()[0] == "lang":
                lang = take()[1][1:]
            elif peek()[0] == "typed":
                take()
                take()
            return body, True, lang
        if kind == "number" or value in ("true", "false"):
            return value, True, None
        return full(kind, value), False, None

    def statements(subject: str) -> None:
        while True:
            predicate = full(*take())
            while True:
                value, literal, lang = term()
                out.append((subject, predicate, value, literal, lang))
                if peek()[1] != ",":
                    break
                take()
            if peek()[1] != ";":
                return
            while peek()[1] == ";":
                take()
            if peek()[1] in (".", "]"):
                return

    while pos < len(parts):
        kind, value = peek()
        if value.lower() in ("@prefix", "prefix") or kind == "lang" and value == "@prefix":
            take()
            name_, iri_ = take()[1], take()[1]
            prefixes[name_.rstrip(":")] = iri_[1:-1] if re.match(r"<[a-zA-Z][\w+.-]*:", iri_) else base + iri_[1:-1]
            if value.startswith("@"):
                take(".")
        elif value.lower() in ("@base", "base"):
            take()
            base = take()[1][1:-1]
            if value.startswith("@"):
                take(".")
        else:
            subject, _, _ = term()
            if peek()[1] != ".":
                statements(subject)
            take(".")
    yield from out


def parse(name: str, text: str) -> list[tuple]:
    """Triples of a file by its suffix; one that can't be read gives one row with the error."""
    try:
        triples = parse_turtle(text) if name.lower().endswith(".ttl") else parse_rdfxml(text)
        return [(name, *t, None) for t in triples]
    except (ET.ParseError, ValueError) as e:
        return [(name, None, None, None, None, None, str(e))]


def triples(files: DataFrame) -> DataFrame:
    """Triples of ``files(name, content)``, with ``source`` and, for a file that can't be read, ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                rows = parse(name, bytes(content).decode("utf-8", "replace"))
                for a in range(0, len(rows), 20_000):
                    yield pd.DataFrame(rows[a : a + 20_000], columns=["source", "subject", "predicate", "object", "is_literal", "lang", "error"])

    return files.select("name", "content").mapInPandas(run, TRIPLE)


def load(spark: SparkSession, folder: str) -> DataFrame:
    """Triples of all ontology files below a folder; another suffix there is an error."""
    files = read_files(spark, folder)
    odd = [r[0] for r in files.where(~F.col("suffix").isin(*SUFFIXES)).select("name").limit(5).collect()]
    if odd:
        raise ValueError(f"not ontology files: {', '.join(odd)}")
    return triples(files)


def named_only(rows: DataFrame) -> DataFrame:
    """Triples without those class axioms whose object is a blank node."""
    axiom = F.col("predicate").isin(RDFS + "subClassOf", OWL + "equivalentClass")
    return rows.where(~(axiom & F.col("object").startswith("_:")))


def imports(files: DataFrame) -> DataFrame:
    """``(name, url)`` of the imports that a file declares in its first 256 KB."""
    head = F.make_valid_utf8(F.substring("content", 1, 262144).cast("string"))
    both = F.concat(F.regexp_extract_all(head, F.lit(r"owl:imports[^>]*?(?:rdf:)?resource=[\"']([^\"']+)"), F.lit(1)), F.regexp_extract_all(head, F.lit(r"owl:imports\s+<([^>]+)>"), F.lit(1)))
    return files.select("name", F.explode(F.array_distinct(both)).alias("url"))


def resolvable(found: DataFrame, files: DataFrame) -> DataFrame:
    """Imports with the local file of the same base name without case; the first by name."""
    base = lambda c: F.lower(F.regexp_extract(c, r"([^/\\#]+?)(?:\.\w+)?[/#]?$", 1))
    local = files.groupBy(base(F.col("name")).alias("_b")).agg(F.min("name").alias("local"))
    return found.withColumn("_b", base(F.col("url"))).join(local, "_b", "left").drop("_b")


def root_files(files: DataFrame, found: DataFrame) -> DataFrame:
    """Files that no other imports; all if each is imported."""
    known = resolvable(found, files).where("local is not null and local <> name").select(F.col("local").alias("name")).distinct()
    roots = files.select("name").join(known, "name", "left_anti")
    return files.select("name") if roots.isEmpty() else roots


def without_imports(text: Column, urls: Column) -> Column:
    """RDF/XML without the import elements of the listed URLs."""
    escaped = F.transform(urls, lambda u: F.regexp_replace(u, r"([.?*+^$\[\]\\(){}|-])", r"\\$1"))
    pattern = F.concat(F.lit(r"<owl:imports\s+rdf:resource=[\"'](?:"), F.array_join(escaped, "|"), F.lit(r")[\"']\s*/?>(?:\s*</owl:imports>)?"))
    return F.when(F.size(urls) > 0, F.regexp_replace(text, pattern, F.lit(""))).otherwise(text)


def catalog(text: Column) -> Column:
    """Map from IRI to local path of an OASIS catalog."""
    entries = F.regexp_extract_all(text, F.lit(r"(<uri\b[^>]*>)"), F.lit(1))
    pairs = F.transform(entries, lambda e: F.struct(F.regexp_extract(e, r"name=[\"']([^\"']+)", 1).alias("key"), F.regexp_extract(e, r"uri=[\"']([^\"']+)", 1).alias("value")))
    return F.map_from_entries(pairs)


def _literals(rows: DataFrame, predicates: tuple[str, ...], alias: str) -> DataFrame:
    wanted = rows.where(F.col("is_literal") & F.col("predicate").isin(*predicates))
    return wanted.groupBy(F.col("subject").alias("iri")).agg(F.array_sort(F.collect_set("object")).alias(alias))


def _references(rows: DataFrame, predicate: str, alias: str) -> DataFrame:
    wanted = rows.where((F.col("predicate") == predicate) & ~F.col("is_literal") & ~F.col("object").startswith("_:"))
    return wanted.groupBy(F.col("subject").alias("iri")).agg(F.array_sort(F.collect_set(F.struct(F.lit("entity").alias("kind"), F.col("object").alias("iri")))).alias(alias))


def classes(rows: DataFrame) -> DataFrame:
    """``(iri, name, namespace, label, labels, comments, superclasses, equivalent_to, disjoints, sources)`` of all named classes."""
    own = rows.where((F.col("predicate") == RDF + "type") & F.col("object").isin(OWL + "Class", RDFS + "Class") & ~F.col("subject").startswith("_:"))
    out = own.groupBy(F.col("subject").alias("iri")).agg(F.array_sort(F.collect_set("source")).alias("sources"))
    for part in (_literals(rows, (RDFS + "label",), "labels"), _literals(rows, (RDFS + "comment",), "comments"), _references(rows, RDFS + "subClassOf", "superclasses"), _references(rows, OWL + "equivalentClass", "equivalent_to"), _references(rows, OWL + "disjointWith", "disjoints")):
        out = out.join(part, "iri", "left")
    filled = [F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c) for c in ("labels", "comments", "superclasses", "equivalent_to", "disjoints")]
    return out.select("iri", local_name("iri").alias("name"), namespace_of("iri").alias("namespace"), F.coalesce(F.get("labels", F.lit(0)), local_name("iri")).alias("label"), *filled, "sources")


def properties(rows: DataFrame, kind: str = "ObjectProperty") -> DataFrame:
    """``(iri, name, label, superproperties, domain, range, characteristics, sources)`` of object or data properties."""
    own = rows.where((F.col("predicate") == RDF + "type") & (F.col("object") == OWL + kind))
    out = own.groupBy(F.col("subject").alias("iri")).agg(F.array_sort(F.collect_set("source")).alias("sources"))
    traits = rows.where((F.col("predicate") == RDF + "type") & F.col("object").rlike(r"#(?:Functional|InverseFunctional|Transitive|Symmetric|Asymmetric|Reflexive|Irreflexive)Property$"))
    named = traits.groupBy(F.col("subject").alias("iri")).agg(F.array_sort(F.collect_set(local_name("object"))).alias("characteristics"))
    for part in (_literals(rows, (RDFS + "label",), "labels"), _references(rows, RDFS + "subPropertyOf", "superproperties"), _references(rows, RDFS + "domain", "domain"), _references(rows, RDFS + "range", "range"), named):
        out = out.join(part, "iri", "left")
    filled = [F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c) for c in ("superproperties", "domain", "range", "characteristics")]
    return out.select("iri", local_name("iri").alias("name"), F.coalesce(F.get("labels", F.lit(0)), local_name("iri")).alias("label"), *filled, "sources")


def instances(rows: DataFrame) -> DataFrame:
    """``(iri, name, label, types, sources)`` of named individuals and of what has a class of its own as type."""
    structural = F.col("object").startswith(OWL) | F.col("object").startswith(RDFS) | F.col("object").startswith(RDF)
    typed = rows.where((F.col("predicate") == RDF + "type") & ~structural & ~F.col("subject").startswith("_:"))
    named = rows.where((F.col("predicate") == RDF + "type") & (F.col("object") == OWL + "NamedIndividual"))
    own = typed.select("subject", "source").union(named.select("subject", "source"))
    out = own.groupBy(F.col("subject").alias("iri")).agg(F.array_sort(F.collect_set("source")).alias("sources"))
    types = typed.groupBy(F.col("subject").alias("iri")).agg(F.array_sort(F.collect_set(F.struct(F.lit("entity").alias("kind"), F.col("object").alias("iri")))).alias("types"))
    out = out.join(types, "iri", "left").join(_literals(rows, (RDFS + "label",), "labels"), "iri", "left")
    return out.select("iri", local_name("iri").alias("name"), F.coalesce(F.get("labels", F.lit(0)), local_name("iri")).alias("label"), F.coalesce("types", F.array().cast(out.schema["types"].dataType)).alias("types"), "sources")


def restrictions(rows: DataFrame) -> DataFrame:
    """``(iri, property, value_iri, kind)``: restrictions that a class is a subclass of or equivalent to."""
    axiom = rows.where(F.col("predicate").isin(RDFS + "subClassOf", OWL + "equivalentClass") & F.col("object").startswith("_:")).select("source", F.col("subject").alias("iri"), F.col("object").alias("node"))
    on = rows.where(F.col("predicate") == OWL + "onProperty").select("source", F.col("subject").alias("node"), F.col("object").alias("property"))
    kinds = ("someValuesFrom", "allValuesFrom", "hasValue", "onClass")
    value = rows.where(F.col("predicate").isin(*[OWL + k for k in kinds])).select("source", F.col("subject").alias("node"), F.col("object").alias("value_iri"), local_name("predicate").alias("kind"))
    return axiom.join(on, ["source", "node"]).join(value, ["source", "node"], "left").select("iri", "property", "value_iri", "kind").distinct()


def merge(parts: list[DataFrame], key: str = "iri") -> DataFrame:
    """One record an IRI: lists united and sorted, the smallest label and name."""
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more)
    lists = [f.name for f in whole.schema.fields if f.dataType.typeName() == "array"]
    scalars = [c for c in whole.columns if c not in lists and c != key]
    merged = whole.groupBy(key).agg(*[F.min(c).alias(c) for c in scalars], *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists])
    return merged.select(*whole.columns)


def to_triples(class_rows: DataFrame, property_rows: DataFrame | None = None) -> DataFrame:
    """``(subject, predicate, object, is_literal)`` of class and object property records."""

    def refs(df: DataFrame, column: str, predicate: str) -> DataFrame:
        return df.select(F.col("iri").alias("subject"), F.lit(predicate).alias("predicate"), F.explode(column).alias("o")).select("subject", "predicate", F.col("o.iri").alias("object"), F.lit(False).alias("is_literal"))

    def typed(df: DataFrame, kind: str) -> DataFrame:
        return df.select(F.col("iri").alias("subject"), F.lit(RDF + "type").alias("predicate"), F.lit(OWL + kind).alias("object"), F.lit(False).alias("is_literal"))

    out = typed(class_rows, "Class").union(refs(class_rows, "superclasses", RDFS + "subClassOf"))
    out = out.union(class_rows.select("iri", F.lit(RDFS + "label"), F.explode("labels"), F.lit(True)) if "labels" in class_rows.columns else class_rows.select("iri", F.lit(RDFS + "label"), "label", F.lit(True)))
    if property_rows is not None:
        out = out.union(typed(property_rows, "ObjectProperty")).union(refs(property_rows, "domain", RDFS + "domain")).union(refs(property_rows, "range", RDFS + "range")).union(property_rows.select("iri", F.lit(RDFS + "label"), "label", F.lit(True)))
    return out.distinct()


def xml_safe(text: Column) -> Column:
    """Text for XML: control characters out, markup signs escaped."""
    out = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def rdfxml_lines(rows: DataFrame) -> DataFrame:
    """``(part, value)``: one RDF/XML description a subject, between a head and a foot."""
    ns, name = namespace_of("predicate"), local_name("predicate")
    element = F.when(F.col("is_literal"), F.concat(F.lit('<p:'), name, F.lit(' xmlns:p="'), xml_safe(ns), F.lit('">'), xml_safe(F.col("object")), F.lit("</p:"), name, F.lit(">"))).otherwise(F.concat(F.lit("<p:"), name, F.lit(' xmlns:p="'), xml_safe(ns), F.lit('" rdf:resource="'), xml_safe(F.col("object")), F.lit('"/>')))
    body = rows.groupBy("subject").agg(F.array_join(F.array_sort(F.collect_list(element)), "").alias("inner")).select(F.lit(1).alias("part"), F.concat(F.lit('<rdf:Description rdf:about="'), xml_safe(F.col("subject")), F.lit('">'), "inner", F.lit("</rdf:Description>")).alias("value"))
    head = rows.sparkSession.createDataFrame([(0, f'<?xml version="1.0"?><rdf:RDF xmlns:rdf="{RDF}">'), (2, "</rdf:RDF>")], "part int, value string")
    return body.union(head)


def write_owl(rows: DataFrame, path: str) -> None:
    """RDF/XML as text parts in order; joined they are one document."""
    rdfxml_lines(rows).repartitionByRange("part", "value").sortWithinPartitions("part", "value").select("value").write.mode("overwrite").text(path)


def stem_relations(class_rows: DataFrame, base: str) -> DataFrame:
    """``(property_iri, label, domain_iri, range_iri)``: ``has_x`` from ``a`` to ``a_x`` of one namespace.

    An equi-join: every prefix of a slug that ends before an underscore is looked up.
    """
    from ..functions.text import slugify

    slugs = class_rows.select("iri", namespace_of("iri").alias("ns"), slugify(local_name("iri")).alias("slug")).where("slug <> ''")
    parts = slugs.withColumn("p", F.split("slug", "_")).where(F.size("p") > 1)
    heads = parts.select("ns", F.col("iri").alias("range_iri"), "slug", F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.array_join(F.slice("p", F.lit(1), i), "_"))).alias("head"))
    met = heads.join(slugs.select("ns", F.col("iri").alias("domain_iri"), F.col("slug").alias("head")), ["ns", "head"])
    label = F.concat(F.lit("has_"), F.substring(F.col("slug"), F.length("head") + 2, F.length("slug")))
    return met.select(F.concat(F.lit(base), label).alias("property_iri"), label.alias("label"), "domain_iri", "range_iri").distinct()


def rewrite(rows: DataFrame, moved: DataFrame) -> DataFrame:
    """Triples with the IRIs of ``moved(old, new)`` replaced wherever they stand."""
    out = rows
    for column in ("subject", "predicate", "object"):
        found = moved.select(F.col("old").alias(column), F.col("new").alias("_new"))
        out = out.join(found, column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")
    return out.select(*rows.columns)


def label_index(class_rows: DataFrame) -> DataFrame:
    """``(label, iri)``: each lower-case label's first class."""
    rows = class_rows.select("iri", F.explode(F.array_distinct(F.concat("labels", F.array("name")))).alias("label")).withColumn("label", F.lower(F.trim("label"))).where("label <> ''")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("label").orderBy("iri"))).where("_n = 1").select("label", "iri")
