"""Linkers: raw edge targets become node ids, by joins with a symbol table.

A linker takes edges and symbols and gives edges with ``to_id`` and ``resolved``; an unresolved target keeps its
raw text.  ``EdgeLinker`` is the extension point: anything with ``name``, ``labels`` and ``link``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import ids, text
from graphloom.storage import cut


class EdgeLinker(Protocol):
    name: str
    labels: tuple[str, ...]

    def link(self, edges: DataFrame, nodes: DataFrame) -> DataFrame: ...


def exact_symbols(nodes: DataFrame) -> DataFrame:
    """(symbol, exact_id): of several nodes with a qualified name the one stored last counts (by ``ordinal``, else by id)."""
    order = F.col("ordinal") if "ordinal" in nodes.columns else F.col("node_id")
    return nodes.where("qualified is not null and qualified <> ''").groupBy(F.col("qualified").alias("symbol")).agg(F.max_by("node_id", order).alias("exact_id"))


def suffix_symbols(nodes: DataFrame) -> DataFrame:
    """(suffix, suffix_id) of functions: the only one with that last segment, else the smallest id that is no test."""
    functions = nodes.where((F.col("label") == "function") & (F.col("qualified") != ""))
    test = ids.looks_like_test(F.col("file_path"), F.col("name"))
    return functions.groupBy(ids.suffix_of(F.col("qualified")).alias("suffix")).agg(
        F.when(F.count("*") == 1, F.min("node_id")).otherwise(F.min(F.when(~test, F.col("node_id")))).alias("suffix_id")
    )


def _spread(key: Column, *by: str) -> Column:
    """A join key whose nulls are many values that match nothing: a left join deals them to all tasks."""
    return F.coalesce(key, F.concat(F.lit("\0"), F.pmod(F.xxhash64(*by), F.lit(4096)).cast("string")))


def resolve_targets(edges: DataFrame, nodes: DataFrame, target: str = "to_id", caller: str = "from_id") -> DataFrame:
    """``edges`` with ``resolved_id`` and ``strategy``: exact name, then same package (targets without dot), then suffix.

    Targets that are ids already are kept as they are (strategy ``id``).  Three equi joins; the symbol tables are
    aggregates of the nodes and are sent whole only where Spark finds them small.
    """
    exact, suffix = exact_symbols(nodes), suffix_symbols(nodes)
    callers = nodes.select(F.col("node_id").alias("__caller"), ids.package_of(F.col("qualified")).alias("__package"))
    raw = F.col(target)
    keyed = edges.join(callers, F.col(caller) == F.col("__caller"), "left").withColumns({
        "__same": _spread(F.when(~raw.contains("."), F.concat("__package", F.lit("."), raw)), target, caller), "__suffix": ids.suffix_of(raw),
    })
    found = (
        keyed.join(exact.withColumnRenamed("symbol", target), target, "left")
        .join(exact.select(F.col("symbol").alias("__same"), F.col("exact_id").alias("same_id")), "__same", "left")
        .join(suffix.withColumnRenamed("suffix", "__suffix"), "__suffix", "left")
    )
    is_id = ids.is_resolved(raw)
    strategy = F.when(is_id, "id").when(F.col("exact_id").isNotNull(), "exact").when(F.col("same_id").isNotNull(), "package").when(F.col("suffix_id").isNotNull(), "suffix")
    resolved = F.when(is_id, raw).otherwise(F.coalesce("exact_id", "same_id", "suffix_id"))
    return found.select(*(F.col(c) for c in edges.columns), resolved.alias("resolved_id"), strategy.alias("strategy"))


def _applied(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    out = resolve_targets(edges, nodes)
    return out.withColumns({"to_id": F.coalesce("resolved_id", "to_id"), "resolved": F.col("resolved_id").isNotNull()}).drop("resolved_id", "strategy")


#: callers that build things, by name or the start of it
BUILDERS = ("init", "main")
BUILDER_STARTS = ("New", "wire", "setup", "register")
BUILDER_FILES = ("wire.go", "main.go")


def call_label(path: Column, name: Column, known: Column) -> Column:
    """Label of a call by its caller: tests, then constructs, then calls; an unknown caller just calls."""
    file = F.substring_index(path, "/", -1)
    builds = name.isin(*BUILDERS) | file.isin(*BUILDER_FILES)
    for start in BUILDER_STARTS:
        builds = builds | name.startswith(start)
    builds = F.coalesce(builds, F.lit(False))
    return F.when(~known, "calls").when(ids.looks_like_test(path, name), "tests").when(builds, "constructs").otherwise("calls")


class CallLinker:
    """Resolves call targets and relabels calls by their caller."""

    name, labels = "calls", ("calls",)

    def link(self, edges: DataFrame, nodes: DataFrame) -> DataFrame:
        out = _applied(edges.where(F.col("label") == "calls"), nodes)
        callers = nodes.select(F.col("node_id").alias("__id"), F.col("file_path").alias("__path"), F.col("name").alias("__name"))
        joined = out.join(callers, F.col("from_id") == F.col("__id"), "left")
        label = call_label(F.col("__path"), F.col("__name"), F.col("__id").isNotNull())
        return joined.withColumn("label", label).select(*out.columns)


class DataFlowLinker:
    name, labels = "data_flow", ("data_flow",)

    def link(self, edges: DataFrame, nodes: DataFrame) -> DataFrame:
        return _applied(edges.where(F.col("label") == "data_flow"), nodes)


class RouteLinker:
    """Route handlers; a target that is a known id stays."""

    name, labels = "route", ("route",)

    def link(self, edges: DataFrame, nodes: DataFrame) -> DataFrame:
        return _applied(edges.where(F.col("label") == "route"), nodes)


class FieldAccessLinker:
    """The type behind ``operand.field``: the caller's own type if the caller is a method, else a type of its package."""

    name, labels = "field_access", ("reads", "writes")

    def link(self, edges: DataFrame, nodes: DataFrame) -> DataFrame:
        chosen = edges.where(F.col("label").isin("reads", "writes"))
        callers = nodes.select(F.col("node_id").alias("__id"), F.col("qualified").alias("__q"))
        types = exact_symbols(nodes.where(F.col("label") == "class"))
        parts = F.split("__q", r"\.")
        own = F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "."))
        operand = F.substring_index("to_id", ".", 1)
        other = F.when(operand != "", F.concat(ids.package_of(F.col("__q")), F.lit("."), ids.capitalised(operand)))
        found = (
            chosen.join(callers, F.col("from_id") == F.col("__id"), "left").withColumns({"__own": _spread(own, "from_id", "to_id"), "__other": _spread(other, "from_id", "to_id")})
            .join(types.select(F.col("symbol").alias("__own"), F.col("exact_id").alias("__own_id")), "__own", "left")
            .join(types.select(F.col("symbol").alias("__other"), F.col("exact_id").alias("__other_id")), "__other", "left")
        )
        id_ = F.coalesce("__own_id", "__other_id")
        return found.select(*(F.coalesce(id_, F.col(c)).alias(c) if c == "to_id" else F.col(c) for c in chosen.columns), id_.isNotNull().alias("resolved"))


def defines_edges(nodes: DataFrame) -> DataFrame:
    """(label, from_id, to_id): every class and function below its owner, the class with the longest name that is a
    dotted prefix of its own, else the file of its path.  Prefixes are exploded, so it is an equi join."""
    member = nodes.where(F.col("label").isin("class", "function") & (F.col("qualified") != "")).select("node_id", "qualified", "file_path")
    classes = nodes.where((F.col("label") == "class") & (F.col("qualified") != "")).groupBy(F.col("qualified").alias("prefix")).agg(F.min("node_id").alias("class_id"))
    files = nodes.where((F.col("label") == "file") & (F.col("file_path") != "")).groupBy(F.col("file_path").alias("__path")).agg(F.min("node_id").alias("file_id"))
    prefixed = member.where(F.instr("qualified", ".") > 0).select("node_id", F.explode(ids.dotted_prefixes(F.col("qualified"))).alias("prefix"))
    owner = prefixed.join(classes, "prefix").groupBy("node_id").agg(F.max_by("class_id", F.length("prefix")).alias("class_id"))
    found = member.join(owner, "node_id", "left").join(files, F.col("file_path") == F.col("__path"), "left")
    return found.select(F.lit("defines").alias("label"), F.coalesce("class_id", "file_id").alias("from_id"), F.col("node_id").alias("to_id")).where("from_id is not null")


#: words of 64 bits that say which types of a block have a method; blocks and interfaces that a cell has, about
WORDS, CELL_BLOCKS, CELL_IFACES = 16, 32, 200_000
#: words of sets that a task holds at once beside those of its cell, and that it turns into pairs at once
SETS_AT_ONCE, PAIRED = 1 << 22, 1 << 13


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(type, iface) of rows (cell, kind, block, id, name, longs) in the order of cell and kind.

    0: the set of a block's types that have method ``id``; 1: the name of a block's type ``id``; 2: an interface with its
    methods, (number, method id) by number, where one of those with a number will do.
    """
    cell, sets, names, ready = None, [], [], None

    def table() -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Sorted method ids, a row of sets for each and one of zeros, and the types' names by their place in a row."""
        blocks = np.unique(np.concatenate([x[0] for x in names]))
        ids = np.unique(np.concatenate([x[1] for x in sets])) if sets else np.zeros(0, np.int64)
        bits = np.zeros((len(ids) + 1, len(blocks), WORDS), np.uint64)
        for block, method, words in sets:
            bits[np.searchsorted(ids, method), np.searchsorted(blocks, block)] = words
        place = np.concatenate([np.searchsorted(blocks, b) * 64 * WORDS + i for b, i, _ in names])
        at = np.zeros(len(blocks) * 64 * WORDS, np.int64)
        at[place] = np.arange(len(place))
        return ids, bits.reshape(len(ids) + 1, -1), pa.concat_arrays([x[2] for x in names]).take(pa.array(at))

    def pairs(ifaces: pa.Array, flat: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, bits, types = ready
        number, method = flat[::2], flat[1::2]
        row = np.searchsorted(ids, method)
        row[(row == len(ids)) | (ids[np.minimum(row, len(ids) - 1)] != method if len(ids) else True)] = len(ids)
        step, first = max(1, SETS_AT_ONCE // bits.shape[1]), 0
        while first < len(ifaces):
            last = max(first + 1, int(np.searchsorted(starts, starts[first] + step, side="right")) - 1)
            lo, hi = starts[first], starts[last]
            new = np.r_[True, np.diff(number[lo:hi]) != 0]
            new[starts[first:last] - lo] = True
            held = np.flatnonzero(new)
            either = np.bitwise_or.reduceat(bits[row[lo:hi]], held, axis=0) if len(held) < hi - lo else bits[row[lo:hi]]
            both = np.bitwise_and.reduceat(either, np.searchsorted(held, starts[first:last] - lo), axis=0)
            i, w = np.nonzero(both)
            for at in range(0, len(i), PAIRED):
                own, word = i[at : at + PAIRED], w[at : at + PAIRED]
                k, bit = np.nonzero(np.unpackbits(both[own, word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                out = pa.RecordBatch.from_arrays([types.take(pa.array(64 * word[k] + bit)), ifaces.take(pa.array(first + own[k]))], ["type", "iface"])
                yield out.filter(pc.not_equal(out.column(0), out.column(1)))
            first = last

    for batch in batches:
        cells, kinds = (batch.column(c).to_numpy() for c in (0, 1))
        cuts = np.r_[0, np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds) != 0)) + 1, len(cells)]
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if lo == hi:
                continue
            if cells[lo] != cell:
                cell, sets, names, ready = cells[lo], [], [], None
            block, id_, name, longs = (batch.column(c).slice(lo, hi - lo) for c in (2, 3, 4, 5))
            if kinds[lo] == 0:
                sets.append((block.to_numpy(), id_.to_numpy(), longs.flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)))
            elif kinds[lo] == 1:
                names.append((block.to_numpy(), id_.to_numpy(), name))
            elif names:  # without types a cell has no pairs
                ready = ready or table()
                sizes = pc.list_value_length(longs).to_numpy() // 2
                yield from pairs(name, longs.flatten().to_numpy(), np.r_[0, np.cumsum(sizes)])


def implements_edges(nodes: DataFrame) -> DataFrame:
    """(label, from_id, to_id): types whose methods cover an interface's, name by name with equal bare signatures.

    Types are numbered and lie in blocks; a method has, for each block that knows it, the set of its types as bits.  Interfaces
    and blocks are dealt to the cells of a grid: a task holds the sets of some blocks and intersects those of each interface's
    methods as it comes.  An interface is moved once for about 32,768 types, a set once for about 200,000 interfaces, and no row of
    a type and an interface is.  Embedded entries (no name) do not count; an interface without other methods
    has no implementors; an interface method without signature matches any.  A type is no implementor of itself.
    """
    methods = nodes.where(F.col("label") == "class").select("node_id", F.explode("methods").alias("m")).select(
        "node_id", F.col("m.name").alias("name"), F.coalesce(F.col("m.receiver"), F.lit("")).alias("receiver"), text.bare_signature(F.coalesce(F.col("m.signature"), F.lit(""))).alias("signature")
    ).where("name <> ''")
    wanted = methods.where("receiver = ''").select(F.col("node_id").alias("iface"), "name", F.col("signature").alias("want"))
    have = cut(methods.where("receiver <> ''").select(F.col("node_id").alias("type"), "name", "signature").distinct())
    types = cut(have.select("type").distinct().withColumn("n", F.monotonically_increasing_id()))  # dense in each partition
    size, words = 64 * WORDS, [f"w{k}" for k in range(WORDS)]
    block, bit = F.expr(f"n div {size}").alias("block"), F.expr(f"cast(n % {size} as int)").alias("bit")
    shapes = F.explode(F.array_distinct(F.array(F.lit(""), "signature"))).alias("want")  # "" stands for any signature
    placed = have.join(types, "type").select("name", shapes, block, bit)
    sets = placed.groupBy("name", "want", "block").agg(*(F.expr(f"bit_or(if(bit div 64 = {k}, shiftleft(1L, bit % 64), 0L))").alias(w) for k, w in enumerate(words)))
    sets = cut(sets)
    known = cut(sets.select("name", "want").distinct().withColumn("id", F.monotonically_increasing_id()))

    wants = F.when(F.array_contains("wants", ""), F.array(F.lit(""))).otherwise(F.col("wants")).alias("wants")
    asked = wanted.groupBy("iface", "name").agg(F.collect_set("want").alias("wants")).select("iface", "name", wants)
    each = asked.select("iface", "name", F.explode("wants").alias("want")).join(known, ["name", "want"], "left")
    # an interface with a method that no type has is left out
    each = each.groupBy("iface", "name").agg(F.collect_list("id").alias("ids")).groupBy("iface").agg(F.collect_list("ids").alias("l"), F.min(F.size("ids")).alias("fewest")).where("fewest > 0")
    longs = F.flatten(F.transform("l", lambda ids, k: F.flatten(F.transform(ids, lambda x: F.array(k.cast("long"), x)))))
    ifaces = cut(each.select("iface", longs.alias("longs")))

    many = -(-ifaces.count() // CELL_IFACES) or 1
    groups = -(-types.select(block).distinct().count() // CELL_BLOCKS) or 1
    many = max(many, -(-nodes.sparkSession.sparkContext.defaultParallelism // groups))
    none, group = F.lit(None), F.pmod(F.xxhash64("block"), F.lit(groups))
    over = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    def side(kind: int, rows: DataFrame, id_, name, longs) -> DataFrame:
        """Rows of types or their sets, once for every part of the interfaces."""
        return rows.select(group.alias("group"), over(many).alias("part"), "block", id_.cast("long").alias("id"), name.cast("string").alias("name"), longs.cast("array<long>").alias("longs")).select((F.col("part") * groups + F.col("group")).alias("cell"), F.lit(kind).alias("kind"), "block", "id", "name", "longs")

    dealt = side(0, sets.join(known, ["name", "want"]).drop("name"), F.col("id"), none, F.array(*words))
    dealt = dealt.unionByName(side(1, types.select("type", block, bit), F.col("bit"), F.col("type"), none))
    part = F.pmod(F.xxhash64("iface"), F.lit(many))
    asking = ifaces.select(part.alias("part"), over(groups).alias("group"), F.col("iface").alias("name"), "longs")
    dealt = dealt.unionByName(asking.select((F.col("part") * groups + F.col("group")).alias("cell"), F.lit(2).alias("kind"), F.lit(None).cast("long").alias("block"), F.lit(None).cast("long").alias("id"), "name", "longs"))
    pairs = dealt.repartition(many * groups, "cell").sortWithinPartitions("cell", "kind").mapInArrow(_met, "type string, iface string")
    return pairs.select(F.lit("implements").alias("label"), F.col("type").alias("from_id"), F.col("iface").alias("to_id"))


LINKERS: list[EdgeLinker] = [CallLinker(), DataFlowLinker(), FieldAccessLinker(), RouteLinker()]


def link_all(edges: DataFrame, nodes: DataFrame, linkers: list[EdgeLinker] | None = None) -> DataFrame:
    """All edges after the linkers, with ``resolved``; defines and implements edges are added.

    Edges of labels that no linker takes stay; they are resolved if their target is an id.
    """
    linkers = LINKERS if linkers is None else linkers
    taken = [x for l in linkers for x in l.labels]
    out = edges.where(~F.col("label").isin(*taken)).withColumn("resolved", ids.is_resolved(F.col("to_id"))) if taken else edges.withColumn("resolved", ids.is_resolved(F.col("to_id")))
    for linker in linkers:
        out = out.unionByName(linker.link(edges, nodes))
    for made in (defines_edges(nodes), *([implements_edges(nodes)] if "methods" in nodes.columns else [])):
        out = out.unionByName(made.withColumn("resolved", F.lit(True)), allowMissingColumns=True)
    return out


def link_stats(linked: DataFrame) -> DataFrame:
    """label, processed, resolved and unresolved edges."""
    return linked.groupBy("label").agg(F.count("*").alias("processed"), F.count_if("resolved").alias("resolved"), F.count_if(~F.col("resolved")).alias("unresolved"))


def first_call_site(hops: DataFrame, edges: DataFrame) -> DataFrame:
    """``hops`` with ``caller_site``, the first call site (in order) of each node's outgoing edges; null if none."""
    sites = edges.where("call_site <> ''").groupBy(F.col("from_id").alias("__id")).agg(F.min("call_site").alias("caller_site"))
    return hops.join(sites, F.col("node_id") == F.col("__id"), "left").drop("__id")


def site_excerpt(hops: DataFrame, nodes: DataFrame) -> DataFrame:
    """``hops`` (with ``caller_site``) and the lines around that site in the node's body."""
    line = F.substring_index("caller_site", ":", -1).try_cast("int")
    body = nodes.select(F.col("node_id").alias("__id"), F.col("body").alias("__body"), F.col("start_line").alias("__start"))
    joined = hops.join(body, F.col("node_id") == F.col("__id"), "left")
    return joined.withColumn("excerpt", text.excerpt(F.col("__body"), F.col("__start"), line)).drop("__id", "__body", "__start")
