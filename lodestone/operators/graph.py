"""Graph operators: traversal, closures, neighbourhoods, components, pruning.

Edges are rows ``(source_type, source_id, target_type, target_id, ...)`` or, for a
class hierarchy, ``(child, parent)``. Walks run level by level: each level is one
equi-join of the frontier with the edges and one anti-join with what has been seen,
written to the shared folder, until the frontier is empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions of every edge as ``(source_type, source_id, target_type, target_id)``: an OR-join as an equi-join."""
    names = ["source_type", "source_id", "target_type", "target_id"]
    forth = edges.select(*names)
    return forth.unionByName(edges.select(F.col("target_type").alias("source_type"), F.col("target_id").alias("source_id"), F.col("source_type").alias("target_type"), F.col("source_id").alias("target_id")))


def bfs(edges: DataFrame, seeds: DataFrame, max_hops: int, decay: float = 0.5) -> DataFrame:
    """``(node_type, node_id, hop, score)`` of all nodes within ``max_hops`` of ``seeds(node_type, node_id)``.

    Edges count in both directions; ``score`` is ``decay ** hop`` for the least hop.
    """
    if max_hops < 0:
        raise ValueError("max_hops is negative")
    both = symmetrize(edges)
    keys = ["node_type", "node_id"]
    seen = settle(seeds.select(*keys).dropna().distinct().withColumn("hop", F.lit(0)), "hop")
    levels, frontier = [seen], seen
    for hop in range(1, max_hops + 1):
        reached = frontier.select(*keys).join(both, (F.col("node_type") == F.col("source_type")) & (F.col("node_id") == F.col("source_id")))
        reached = reached.select(F.col("target_type").alias("node_type"), F.col("target_id").alias("node_id")).distinct()
        # a node's neighbours lie one level before it, on it, or after it
        for level in levels[-2:]:
            reached = reached.join(level.select(*keys), keys, "left_anti")
        frontier = settle(reached.withColumn("hop", F.lit(hop)), "hop")
        if frontier.isEmpty():
            break
        levels.append(frontier)
    found = reduce(DataFrame.unionByName, levels)
    return found.withColumn("score", F.pow(F.lit(float(decay)), F.col("hop").cast("double")))


def walk(edges: DataFrame, roots: DataFrame, start: str, end: str, max_depth: int | None = None) -> DataFrame:
    """``(node, depth)`` reached from ``roots(node)`` along ``start`` to ``end``; roots have depth 0."""
    steps = edges.select(F.col(start).alias("_from"), F.col(end).alias("_to")).dropna().where("_from <> _to")
    seen = settle(roots.select("node").dropna().distinct().withColumn("depth", F.lit(0)), "walk")
    frontier, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        nodes = frontier.select(F.col("node").alias("_from")).join(steps, "_from").select(F.col("_to").alias("node")).distinct()
        frontier = settle(nodes.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)), "walk")
        if frontier.isEmpty():
            break
        seen = settle(seen.unionByName(frontier), "seen") if depth % 8 == 0 else seen.unionByName(frontier)
    return seen


def subtree(isa: DataFrame, roots: DataFrame, max_depth: int = 10) -> DataFrame:
    """Roots and their descendants over ``isa(child, parent)``."""
    return walk(isa, roots, "parent", "child", max_depth)


def closure(isa: DataFrame, seeds: DataFrame) -> DataFrame:
    """``node`` of the seeds, all their ancestors, and all their descendants; siblings stay out."""
    up = walk(isa, seeds, "child", "parent")
    down = walk(isa, seeds, "parent", "child")
    return up.select("node").union(down.select("node")).distinct()


def isa_index(classes: DataFrame) -> DataFrame:
    """``(child, parent)`` from ``classes(iri, superclasses array<struct<iri>>)``; both ends must be classes."""
    pairs = classes.select(F.col("iri").alias("child"), F.explode("superclasses").alias("s")).select("child", F.col("s.iri").alias("parent"))
    known = classes.select(F.col("iri").alias("parent"))
    return pairs.where("parent is not null and parent <> child").join(known, "parent", "left_semi").distinct()


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """``(node, depth)`` within ``hops`` undirected steps over ``edges(a, b)``."""
    if hops < 0:
        raise ValueError("hops is negative")
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return walk(both, seeds, "a", "b", hops) if hops else seeds.select("node").distinct().withColumn("depth", F.lit(0))


def partners(properties: DataFrame, keep: DataFrame) -> DataFrame:
    """``keep(node)`` and all domain and range classes of each property of which one is in it; one step."""
    ends = properties.select(F.col("iri").alias("property"), F.explode(F.concat(F.coalesce("domain", F.array()), F.coalesce("range", F.array()))).alias("e")).select("property", F.col("e.iri").alias("node"))
    touching = ends.join(keep, "node", "left_semi").select("property").distinct()
    return keep.select("node").union(ends.join(touching, "property", "left_semi").select("node")).where("node is not null").distinct()


def keep_set(classes: DataFrame, properties: DataFrame, detected: DataFrame, protected: tuple[str, ...] = ()) -> DataFrame:
    """Classes to keep: detected, their closure, relationship partners, then those under protected prefixes."""
    isa = isa_index(classes)
    kept = partners(properties, closure(isa, detected.join(classes.select(F.col("iri").alias("node")), "node", "left_semi")))
    if protected:
        kept = kept.union(classes.select(F.col("iri").alias("node")).where(starts_with_any(F.col("node"), protected)))
    return kept.join(classes.select(F.col("iri").alias("node")), "node", "left_semi").distinct()


def starts_with_any(c: Column, prefixes: tuple[str, ...]) -> Column:
    return reduce(lambda a, p: a | c.startswith(p), prefixes, F.lit(False))


def _kept_references(df: DataFrame, column: str, keep: DataFrame, key: str = "iri") -> DataFrame:
    """``df`` with only those structs of an array column whose iri is kept."""
    refs = df.select(key, F.posexplode_outer(column).alias("_at", "_ref"))
    good = refs.join(keep.select(F.col("node").alias("_node")), F.col("_ref.iri") == F.col("_node"))
    lists = good.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_ref"))), lambda x: x["_ref"]).alias("_refs"))
    return df.join(lists, key, "left").withColumn(column, F.coalesce("_refs", F.slice(column, 1, 0), F.array())).drop("_refs")


def prune_classes(classes: DataFrame, keep: DataFrame) -> DataFrame:
    """Kept classes, with kept superclasses only."""
    left = classes.join(keep.select(F.col("node").alias("iri")), "iri", "left_semi")
    return _kept_references(left, "superclasses", keep)


def prune_properties(properties: DataFrame, keep: DataFrame, need_both_empty: bool = True) -> DataFrame:
    """Properties with kept domain and range classes; an object property needs one of them, a data property its domain."""
    out = _kept_references(_kept_references(properties, "domain", keep), "range", keep)
    return out.where((F.size("domain") > 0) | (F.size("range") > 0)) if need_both_empty else out.where(F.size("domain") > 0)


def prune_instances(instances: DataFrame, keep: DataFrame) -> DataFrame:
    """Instances with at least one kept type."""
    return _kept_references(instances, "types", keep).where(F.size("types") > 0)


def prune(classes: DataFrame, properties: DataFrame, detected: DataFrame, protected: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Classes and object properties cut to the keep set; unchanged if nothing is detected or protected."""
    if not protected and detected.isEmpty():
        return classes, properties
    kept = settle(keep_set(classes, properties, detected, protected), "keep")
    return prune_classes(classes, kept), prune_properties(properties, kept)


def top_level_branches(classes: DataFrame, generic: tuple[str, ...] = ("http://www.w3.org/2002/07/owl#Thing",), most: int = 256) -> DataFrame:
    """``(iri, label)`` of classes without a superclass among the classes, generic tops aside; by label."""
    own = classes.where(~F.col("iri").isin(*generic))
    inner = isa_index(own).select(F.col("child").alias("iri"))
    return own.join(inner, "iri", "left_anti").select("iri", F.coalesce("label", "iri").alias("label")).orderBy("label", "iri").limit(most)


def immediate_edges(classes: DataFrame, properties: DataFrame, restrictions: DataFrame | None = None) -> DataFrame:
    """``(node, kind, other, via)``: parents, children, domains, ranges and restriction values of each class."""
    isa = isa_index(classes)
    out = isa.select(F.col("child").alias("node"), F.lit("parent").alias("kind"), F.col("parent").alias("other"), F.lit(None).cast("string").alias("via"))
    out = out.union(isa.select("parent", F.lit("child"), "child", F.lit(None).cast("string")))
    domain = properties.select(F.col("iri").alias("via"), F.explode("domain").alias("d")).select("via", F.col("d.iri").alias("d"))
    range_ = properties.select(F.col("iri").alias("via"), F.explode("range").alias("r")).select("via", F.col("r.iri").alias("r"))
    pairs = domain.join(range_, "via")
    out = out.union(pairs.select("d", F.lit("domain_of"), "r", "via")).union(pairs.select("r", F.lit("range_of"), "d", "via"))
    if restrictions is not None:
        out = out.union(restrictions.select("iri", F.lit("restriction"), "value_iri", "property"))
    return out.distinct()


def properties_by_class(properties: DataFrame) -> DataFrame:
    """``(class_iri, role, properties)``: sorted properties of which a class is domain or range."""
    rows = properties.select("iri", F.lit("domain").alias("role"), F.explode("domain").alias("c")).union(properties.select("iri", F.lit("range").alias("role"), F.explode("range").alias("c")))
    return rows.groupBy(F.col("c.iri").alias("class_iri"), "role").agg(F.array_sort(F.collect_set("iri")).alias("properties"))


def components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``(node, component)`` over undirected ``links(a, b)``; component is the smallest node.

    Every node takes the least label around it, then the label of its label, until no label changes.
    """
    pairs = links.select("a", "b").dropna()
    both = settle(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    labels = settle(labels, "labels")
    for _ in range(max_rounds):
        around = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(around, F.col("node") == F.col("a")).select("node", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        jump = step.select(F.col("node").alias("_n"), F.col("next").alias("_l"))
        step = settle(step.join(jump, F.col("next") == F.col("_n"), "left").select("node", F.least("next", F.coalesce("_l", "next")).alias("label"), "old"), "labels")
        labels = step.select("node", "label")
        if step.where("label <> old").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"labels still change after {max_rounds} rounds")


def known_places(classes: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Lower-case labels of all classes under a class whose label is a kind of place."""
    roots = classes.where(F.lower("label").isin(*[k.lower() for k in kinds])).select(F.col("iri").alias("node"))
    under = subtree(isa_index(classes), roots, 50)
    return classes.join(under.select(F.col("node").alias("iri")), "iri", "left_semi").select(F.lower("label").alias("label")).distinct()


def slice_for(classes: DataFrame, edges: DataFrame, detected: DataFrame, anchors: tuple[str, ...] = (), hops: int = 1) -> DataFrame:
    """Classes around the detected ones and the anchors; nothing if nothing is detected."""
    near = neighbourhood(edges, detected, hops).select(F.col("node").alias("iri"))
    wanted = near.union(classes.where(F.col("iri").isin(*anchors) if anchors else F.lit(False)).select("iri"))
    return classes.join(wanted.distinct(), "iri", "left_semi").where(F.lit(not detected.isEmpty()))


def visible_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges ``(a, b)`` with both ends among ``nodes(node)``."""
    seen = nodes.select("node").distinct()
    return edges.join(seen.select(F.col("node").alias("a")), "a", "left_semi").join(seen.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b").distinct()
