"""Traversal: bounded breadth-first search, one-hop neighbourhoods, field flow.

Hops are shortest-path lengths and carry the edge that was taken.  A start node is never emitted.  Each level joins
the frontier with the oriented edges, keeps one row per (seed, node) and drops what was visited before, so the work
of a level is bounded by the edges however many paths there are.  Below ``EAGER_FROM`` levels a search is one lazy
plan; deeper ones make the oriented edges once, cut lineage at every level, send a frontier of counted, bounded size to
the edges (a larger one is shuffled to them), and stop when a frontier is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators.adjacency import SENT_FRONTIER, Adjacency
from graphloom.storage import cut, release

EAGER_FROM = 3
DEFAULT_DEPTH = 5
#: seeds beyond which a search for hops alone moves sets of them, and words of 64 seeds in a set
MANY_SEEDS, WORDS = 64, 4


def oriented(edges: DataFrame, direction: str = "forward", labels: list[str] | None = None) -> DataFrame:
    """(src, dst, label, call_site) of the chosen labels: forward, reverse or both ways."""
    edges = edges.where("from_id is not null and to_id is not null")
    if labels:
        edges = edges.where(F.col("label").isin(*labels))
    site = F.col("call_site") if "call_site" in edges.columns else F.lit(None).cast("string")
    ahead = edges.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), "label", site.alias("call_site"))
    back = edges.select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"), "label", site.alias("call_site"))
    return {"forward": ahead, "reverse": back}.get(direction) if direction != "both" else ahead.unionByName(back)


def _bfs(seeds: DataFrame, edges: DataFrame | Adjacency, direction: str, wanted: list[str], depth: int, labels: list[str] | None = None, via: bool = True) -> DataFrame:
    """Rows (seed_id, node_id, hop, parent_id, label, call_site) reached from ``seeds`` (seed_id, node_id).

    With ``labels`` each of them is walked by itself and a node comes once for each.  Stored edges are read where they lie.
    Without ``via`` the rows are (seed_id, node_id, hop, and with ``labels`` the label): no more of an edge than its ends (and
    the label) is written or moved, and a task drops repeated nodes before they are.
    """
    stored = isinstance(edges, Adjacency)
    keys = ["seed_id", "walk"] if labels else ["seed_id"]
    none = F.lit(None).cast("string")
    eager = depth >= EAGER_FROM
    frontier = seeds.select("seed_id", *([F.explode(F.array(*map(F.lit, labels))).alias("walk")] if labels else []), "node_id")
    at = None if stored else oriented(edges, direction, wanted).withColumnRenamed("label", "edge_label")
    if at is not None and not via:
        at = at.select("src", "dst", *(["edge_label"] if labels else []))
    if eager:
        frontier = cut(frontier.distinct())
        if not stored:  # the edges are made once, however many levels read them
            at = cut(at if via or labels else at.distinct())
        if not stored and not via and not labels:
            numbered = cut(frontier.select("seed_id").distinct().withColumn("n", F.monotonically_increasing_id()))  # dense in each partition
            if numbered.count() > MANY_SEEDS:
                return _reached_sets(frontier, numbered, at, depth)
    visited = frontier.select(*keys, "node_id")
    out, rows_ahead = None, frontier.count() if eager else None
    for hop in range(1, depth + 1):
        ahead = frontier.select(*keys, F.col("node_id").alias("src"))
        if stored:
            met = edges.step(ahead, direction, wanted, rows_ahead)
        else:
            met = at.join(F.broadcast(ahead) if eager and rows_ahead <= SENT_FRONTIER else ahead, "src")
        if labels:
            met = met.where(F.col("walk") == F.col("edge_label"))
        if via:
            best = met.groupBy(*keys, F.col("dst").alias("node_id")).agg(F.min(F.struct("src", "edge_label", "call_site")).alias("via"))
        else:
            best = met.select(*keys, F.col("dst").alias("node_id")).distinct()
        new = best.join(visited, [*keys, "node_id"], "left_anti")
        if eager and hop < depth:  # nothing goes on from the last level, which may be the largest: it is not written here
            new = cut(new)
            rows_ahead = new.count()
            if not rows_ahead:
                break
        if via:
            made = [F.col("via.src").alias("parent_id"), F.col("via.edge_label").alias("label"), F.col("via.call_site").alias("call_site")]
        else:
            made = [F.col("walk").alias("label")] if labels else []
        rows = new.select("seed_id", "node_id", F.lit(hop).alias("hop"), *made)
        out = rows if out is None else out.unionByName(rows)
        frontier = new.select(*keys, "node_id")
        visited = visited.unionByName(frontier)
    else:
        return out
    if eager and not stored:  # a search that ended before its depth reads the edges no more
        release(at)
    if out is None:
        more = [none.alias(c) for c in (("parent_id", "label", "call_site") if via else ("label",) if labels else ())]
        out = frontier.where("false").select("seed_id", "node_id", F.lit(0).alias("hop"), *more)
    return out


def _reached_sets(starts: DataFrame, numbered: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(seed_id, node_id, hop) reached from ``starts`` (seed_id, node_id), distinct ones, over ``edges`` (src, dst).

    ``numbered`` (seed_id, n) gives each seed a number.  A row stands for a node and up to 256 seeds as bits: these rows are
    written and moved, and become one for each seed in the last step, after which nothing is moved.
    """
    size, words = 64 * WORDS, [f"w{k}" for k in range(WORDS)]
    block, bit = F.expr(f"n div {size}"), F.expr(f"cast(n % {size} as int)")
    placed = starts.join(numbered.withColumnRenamed("seed_id", "__seed"), F.col("seed_id").eqNullSafe(F.col("__seed"))).select(block.alias("block"), "node_id", bit.alias("bit"))
    one = (F.expr(f"bit_or(if(bit div 64 = {k}, shiftleft(1L, bit % 64), 0L))").alias(w) for k, w in enumerate(words))
    frontier = cut(placed.groupBy("block", "node_id").agg(*one))
    visited, levels = frontier, []
    for hop in range(1, depth + 1):
        met = frontier.join(edges, frontier["node_id"] == edges["src"]).select("block", F.col("dst").alias("node_id"), *words, *(F.lit(0).cast("long").alias(f"seen_{w}") for w in words))
        seen = visited.select("block", "node_id", *(F.lit(0).cast("long").alias(w) for w in words), *(F.col(w).alias(f"seen_{w}") for w in words))
        reached = met.unionByName(seen).groupBy("block", "node_id").agg(*(F.bit_or(w).alias(w) for w in (*words, *(f"seen_{w}" for w in words))))
        new = reached.select("block", "node_id", *(F.col(w).bitwiseAND(F.bitwise_not(F.col(f"seen_{w}"))).alias(w) for w in words))
        new = new.where(" or ".join(f"{w} <> 0" for w in words))
        if hop < depth:
            new = cut(new)
            if new.isEmpty():
                break
        levels.append(new.withColumn("hop", F.lit(hop)))
        frontier, visited = new, visited.unionByName(new)
    if not levels:
        return starts.where("false").select("seed_id", "node_id", F.lit(0).alias("hop"))
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    names = numbered.select(block.alias("block"), bit.alias("bit"), "seed_id").groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("bit", "seed_id"))).alias("names"))
    bits = found.join(names, "block").select("node_id", "hop", "names", F.posexplode(F.array(*words)).alias("word", "bits")).where("bits <> 0")
    each = F.expr("explode(filter(sequence(0, 63), b -> (shiftrightunsigned(bits, b) & 1L) = 1L))").alias("bit")
    return bits.select("node_id", "hop", "names", "word", each).select(F.expr("names[word * 64 + bit]").alias("seed_id"), "node_id", "hop")


def traverse(seeds: DataFrame, edges: DataFrame | Adjacency, labels: list[str] = ("calls",), direction: str = "forward", max_depth: int = DEFAULT_DEPTH,
             mode: str = "per_label", nodes: DataFrame | None = None, target_labels: list[str] | None = None, via: bool = True) -> DataFrame:
    """(seed_id, node_id, hop, parent_id, label, call_site): nodes reachable from ``seeds`` (seed_id, node_id).

    ``per_label`` walks each label by itself and keeps, for a node reached along several, the first in the order
    of ``labels``; ``mixed`` walks all together.  Edges are a frame or a stored adjacency.  A depth of 0 or less is the default.  ``target_labels`` (with
    ``nodes``) restricts what is emitted.  Null ends never match.  Without ``via`` nodes and hops alone are looked for
    (seed_id, node_id, hop and, of labels walked by themselves, label), which moves much less.
    """
    labels = list(labels) or ["calls"]
    depth = max_depth if max_depth > 0 else DEFAULT_DEPTH
    if mode == "mixed" or len(labels) == 1:
        out = _bfs(seeds, edges, direction, labels, depth, via=via)
    else:
        walked = _bfs(seeds, edges, direction, labels, depth, labels, via)
        order = F.array_position(F.array(*map(F.lit, labels)), F.col("label"))
        first = F.min_by(F.struct("hop", "parent_id", "label", "call_site"), F.struct(order, "hop")) if via else F.min(F.struct(order.cast("int").alias("order"), "hop", "label"))
        out = walked.groupBy("seed_id", "node_id").agg(first.alias("f")).select("seed_id", "node_id", "f.*").drop("order")
    if target_labels:
        wanted = nodes.where(F.col("label").isin(*target_labels)).select("node_id")
        out = out.join(wanted, "node_id", "left_semi")
    return out.select("seed_id", "node_id", "hop", *(c for c in ("parent_id", "label", "call_site") if c in out.columns))


def min_hop(hops: DataFrame) -> DataFrame:
    """One row for each node: the least hop over all seeds, ties by parent; of hops without one, the least hop alone."""
    if "parent_id" not in hops.columns:
        return hops.groupBy("node_id").agg(F.min("hop").alias("hop"))
    best = F.min(F.struct("hop", "parent_id", "label", "call_site"))
    return hops.groupBy("node_id").agg(best.alias("b")).select("node_id", "b.*")


def first_by_qualified(hops: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hops with their node's qualified name, one row for each name (or id, where it has none): the least hop stays."""
    named = hops.join(nodes.select("node_id", "qualified"), "node_id", "left")
    key = F.coalesce(F.when(F.col("qualified") != "", F.col("qualified")), F.col("node_id"))
    ranked = named.withColumn("__n", F.row_number().over(W.partitionBy("seed_id", key).orderBy("hop", "node_id")))
    return ranked.where("__n = 1").drop("__n")


#: how many neighbours of each kind a neighbourhood lists
NEIGHBOUR_LIMITS = {"callees": 30, "callers": 30, "sinks": 20, "sources": 20, "reads": 20, "writes": 20}


def neighbour_rows(edges: DataFrame, nodes: DataFrame, of: DataFrame) -> DataFrame:
    """(node_id, kind, other_id, other_qualified, detail) of the nodes ``of``: the first few of each kind, by name.

    Edges whose other end is no node with a name are left out.
    """
    label, prop = F.col("label"), lambda k: F.try_element_at("props", F.lit(k))
    # an edge stands for a neighbour of the node it leaves and, of calls and flows, of the one it reaches
    ahead = F.when(label == "calls", "callees").when(label == "data_flow", "sinks").otherwise(label)
    back = F.when(label == "calls", "callers").when(label == "data_flow", "sources")
    rows = edges.where(label.isin("calls", "data_flow", "reads", "writes")).select(
        "from_id", "to_id", ahead.alias("ahead"), back.alias("back"), F.when(label == "data_flow", prop("field_path")).when(label != "calls", prop("field")).alias("ahead_detail"), F.when(label == "data_flow", prop("arg_expr")).alias("back_detail"))
    ends = _ends(nodes, of)
    for side in ("from", "to"):  # edges move once to each end, before they become rows
        at = ends.select(F.col("node_id").alias("__id"), F.col("qualified").alias(f"{side}_qualified"), F.col("center").alias(f"{side}_center"))
        rows = rows.join(at, (F.xxhash64(f"{side}_id") == F.xxhash64("__id")) & (F.col(f"{side}_id") == F.col("__id"))).drop("__id")

    def as_row(here, there, kind):
        row = F.struct(F.col(f"{here}_id").alias("center"), F.col(kind).alias("kind"), F.col(f"{there}_id").alias("other_id"), F.col(f"{there}_qualified").alias("other_qualified"), F.col(f"{kind}_detail").alias("detail"))
        return F.when(F.col(f"{here}_center") & F.col(f"{there}_qualified").isNotNull() & F.col(kind).isNotNull(), row)

    found = rows.select(F.explode(F.array(as_row("from", "to", "ahead"), as_row("to", "from", "back"))).alias("e")).where("e is not null").select("e.*")
    found = found.withColumn("__h", F.xxhash64("center"))  # sorted by a number first: ids begin alike
    most = F.element_at(F.create_map(*(F.lit(x) for kv in NEIGHBOUR_LIMITS.items() for x in kv)), F.col("kind"))
    ranked = found.withColumn("__n", F.row_number().over(W.partitionBy("__h", "center", "kind").orderBy("other_qualified", "other_id", F.col("detail").asc_nulls_first())))
    ranked = ranked.where(F.col("__n") <= max(NEIGHBOUR_LIMITS.values()))  # a plain number: windows are cut before the shuffle
    return ranked.where(F.col("__n") <= most).select(F.col("center").alias("node_id"), "kind", "other_id", "other_qualified", "detail")


def _ends(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """(node_id, qualified, center): a row for each name of a node, one without a name for a node of ``of`` that has none.

    ``center`` holds for one row of each node of ``of``.
    """
    named = nodes.where("qualified is not null").select("node_id", "qualified", F.lit(False).alias("wanted"))
    marks = named.unionByName(of.select("node_id", F.lit(None).cast("string").alias("qualified"), F.lit(True).alias("wanted"))).withColumn("__h", F.xxhash64("node_id"))
    node = W.partitionBy("__h", "node_id")
    ranked = marks.select("node_id", "qualified", F.max("wanted").over(node).alias("wanted"), F.count("qualified").over(node).alias("names"), F.row_number().over(node.orderBy("wanted", "qualified")).alias("__n"))
    return ranked.where("__n <= greatest(names, 1)").select("node_id", "qualified", (F.col("wanted") & (F.col("__n") == 1)).alias("center"))


def neighbours(edges: DataFrame, nodes: DataFrame, of: DataFrame) -> DataFrame:
    """One row for each node of ``of``: node_id and six sorted lists of (qualified, detail)."""
    rows = neighbour_rows(edges, nodes, of)
    item = F.struct("other_qualified", "other_id", "detail")
    lists = [F.sort_array(F.collect_list(F.when(F.col("kind") == k, item))).alias(k) for k in NEIGHBOUR_LIMITS]
    none = [F.coalesce(k, F.array()).alias(k) for k in NEIGHBOUR_LIMITS]
    return of.select("node_id").distinct().join(rows.groupBy("node_id").agg(*lists), "node_id", "left").select("node_id", *none)


def field_flow_edges(seeds: DataFrame, edges: DataFrame, field_path: str | None = None, max_depth: int = 10, labels: tuple[str, ...] = ("data_flow",),
                     fan_out: int = 50, direction: str = "forward") -> DataFrame:
    """Edges walked from ``seeds`` (node_id): (depth, from_id, to_id, label, field_path, mutation_type, arg_expr).

    Nodes are expanded once, but every edge out of an expanded node is emitted, those into visited nodes too.  With
    a ``field_path`` only edges of that path or of none are walked.  At most ``fan_out`` edges leave a node, in the
    order of target and field.
    """
    depth = max_depth if max_depth > 0 else 10
    flow = edges.where(F.col("label").isin(*labels))
    path = F.coalesce(F.try_element_at("props", F.lit("field_path")), F.try_element_at("props", F.lit("field")))
    flow = flow.select(
        F.col("from_id" if direction == "forward" else "to_id").alias("src"), F.col("to_id" if direction == "forward" else "from_id").alias("dst"), "label", path.alias("field_path"),
        F.try_element_at("props", F.lit("mutation_type")).alias("mutation_type"), F.try_element_at("props", F.lit("arg_expr")).alias("arg_expr"),
    )
    if field_path is not None:
        flow = flow.where((F.col("field_path") == field_path) | F.col("field_path").isNull())
    order = ["dst", F.col("field_path").asc_nulls_first(), "label", F.col("mutation_type").asc_nulls_first(), F.col("arg_expr").asc_nulls_first()]
    flow = flow.withColumn("__n", F.row_number().over(W.partitionBy("src").orderBy(*order))).where(F.col("__n") <= fan_out).drop("__n")
    frontier, out = seeds.select("node_id").distinct(), None
    expanded = frontier
    for d in range(1, depth + 1):
        met = frontier.select(F.col("node_id").alias("src")).join(flow, "src")
        if depth >= EAGER_FROM:
            met = cut(met)
            if met.isEmpty():
                break
        rows = met.select(F.lit(d).alias("depth"), F.col("src").alias("from_id"), F.col("dst").alias("to_id"), "label", "field_path", "mutation_type", "arg_expr")
        out = rows if out is None else out.unionByName(rows)
        frontier = met.select(F.col("dst").alias("node_id")).distinct().join(expanded, "node_id", "left_anti")
        expanded = expanded.unionByName(frontier)
    if out is None:
        s = F.lit(None).cast("string")
        out = frontier.where("false").select(F.lit(0).alias("depth"), s.alias("from_id"), s.alias("to_id"), s.alias("label"), s.alias("field_path"), s.alias("mutation_type"), s.alias("arg_expr"))
    return out


def find_mutations(edges: DataFrame, nodes: DataFrame, field_path: str | None = None, limit: int = 100) -> DataFrame:
    """Mutating data-flow edges whose target is a node: (from_id, to_id, field_path, mutation_type), by ends, at most ``limit``."""
    prop = lambda k: F.try_element_at("props", F.lit(k)).alias(k)
    rows = edges.where(F.col("label") == "data_flow").select("from_id", "to_id", prop("field_path"), prop("mutation_type")).where("mutation_type is not null")
    if field_path is not None:
        rows = rows.where(F.col("field_path") == field_path)
    known = nodes.select(F.col("node_id").alias("to_id"))
    return rows.join(known, "to_id", "left_semi").orderBy("from_id", "to_id", "field_path", "mutation_type").limit(limit)
