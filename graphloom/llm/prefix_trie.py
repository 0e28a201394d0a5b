"""Prefix trie of conversations: a Cartesian tree over the LCP array of the sorted conversations.

Conversations are sorted by the digests of their turns.  Every node of the trie is an interval of that order: the nodes
at which the tree branches or a conversation ends are the distinct values of the array of longest common prefixes (LCP)
between neighbours, and an interval ends at the nearest smaller values to both sides.  A block (a partition of the sorted
order) finds those inside it with a stack; for intervals that cross its ends the minima of the blocks say in which block
they began, so the parts that blocks have of such a node meet under one key.  Depths at which nothing branches or ends
are filled in from their node below, which has the same members.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import join_spread, materialise, release, table

#: turns of a conversation in one row; longer ones go on in rows of the next level
CHUNK = 1024
WIDTH = 16  # bytes of a turn's digest
SHARED = 20  # conversations that take their first turns from one
NOTHING = hashlib.sha256(b"").hexdigest()


# ---- turns and their places ---------------------------------------------------------------------------------------


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest, words and n (repeats of the row): texts go no further than this."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # the role's length in front keeps (role, text) apart from other splits of the same characters
    digest = F.unhex(F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH))
    words = F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), words.alias("words"))
    return rows.groupBy("conv_id", "turn", "digest", "words").agg(F.count("*").alias("n"))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows: the partition, and how many turns of the conversation stand before in it."""
    part, last, held = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, n = batch.column("conv_id").to_numpy(), batch.column("n").to_numpy()
        first = np.r_[True, conv[1:] != conv[:-1]]
        before = np.cumsum(n) - n
        run = np.cumsum(first) - 1
        place = before - before[np.flatnonzero(first)][run]
        if conv[0] == last:
            place[run == 0] += held
        last, held = conv[-1], int(place[-1] + n[-1])
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("digest"), batch.column("words"), batch.column("n"), pa.array(np.full(len(n), part), pa.int32()), pa.array(place)], names=["conv_id", "digest", "words", "n", "part", "place"])


def placed_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, digest, words, n, place): n equal turns from that place, counted from 0; and (conv_id, turns).

    Turns go by ``turn``, null first, and by digest where it is equal.  A conversation, however long, is spread over as
    many partitions as its turns need.
    """
    by = ["conv_id", "turn", "digest"]
    rows = turn_rows(conversations)
    rows = rows.select("conv_id", "turn", "digest", "words", "n").repartitionByRange(*by).sortWithinPartitions(*by)
    rows = materialise(rows.mapInArrow(_places, "conv_id long, digest binary, words int, n long, part int, place long"))
    spans = rows.groupBy("conv_id", "part").agg(F.sum("n").alias("turns"))
    before = F.sum("turns").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # only the first conversation of a partition can have turns in earlier ones: at most a row a partition
    carried = spans.withColumn("before", before).where("before > 0").select("conv_id", "part", "before")
    at = F.col("place") + F.coalesce("before", F.lit(0))
    placed = rows.join(F.broadcast(carried), ["conv_id", "part"], "left").select("conv_id", "digest", "words", "n", at.alias("place"))
    return placed, spans.groupBy("conv_id").agg(F.sum("turns").alias("turns"))


def own_head(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string")) % 4).cast("int")


def chunk_rows(conversations: DataFrame, chunk: int) -> DataFrame:
    """conv_id, chunk, last, digests (in hexadecimal) and words of the rebuilt conversations.

    A conversation has a row for every ``chunk`` turns and one for what is left, which may be nothing.
    """
    placed, lengths = placed_turns(conversations)
    placed, lengths = materialise(placed), materialise(lengths)
    heads = placed.where((F.col("place") < 3) & (F.col("conv_id") % SHARED == 0)).groupBy("conv_id").agg(
        F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "digest", "words", F.least("n", F.lit(3)).cast("int").alias("n")))), lambda x: F.array_repeat(F.struct(x["digest"].alias("digest"), x["words"].alias("words")), x["n"]))), 1, 3).alias("head")
    )
    convs = lengths.select("conv_id", "turns", own_head(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % SHARED).alias("base"))
    # a conversation gives its head to 20 others (39 around zero): no key is hot
    convs = convs.join(heads.withColumnRenamed("conv_id", "base"), "base", "left").select(
        "conv_id", "turns", "h", F.expr("if(head is null or h = 0, filter(head, x -> false), slice(head, 1, h))").alias("head")
    )
    convs = materialise(convs.withColumn("k", F.coalesce(F.size("head"), F.lit(0))).withColumn("k", F.greatest("k", F.lit(0))).withColumn("size", F.col("k") + F.greatest(F.col("turns") - F.col("h"), F.lit(0))))
    total = placed.count()
    own = join_spread(placed, convs.select("conv_id", "h", "k", "turns"), "conv_id", "turns", total)
    own = own.where(F.col("place") + F.col("n") > F.col("h")).select(
        "conv_id", "digest", "words", F.explode(F.sequence(F.greatest(F.col("place"), F.col("h").cast("long")) - F.col("h") + F.col("k"), F.col("place") + F.col("n") - 1 - F.col("h") + F.col("k"))).alias("at")
    )
    first = convs.where("k > 0").select("conv_id", F.posexplode("head").alias("at", "x")).select("conv_id", "x.digest", "x.words", F.col("at").cast("long").alias("at"))
    item = F.struct("at", F.hex("digest").alias("digest"), "words")
    turns = own.unionByName(first).select("conv_id", F.expr(f"at div {chunk}").alias("chunk"), item.alias("item"))
    frame = convs.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"size div {chunk}"))).alias("chunk"), F.expr(f"size div {chunk}").alias("last"))
    every = turns.select("*", F.lit(None).cast("long").alias("last")).unionByName(frame.select("conv_id", "chunk", F.lit(None).cast(dict(turns.dtypes)["item"]).alias("item"), "last"))
    rows = every.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list("item")).alias("items"), F.max("last").alias("last"))  # at most `chunk` items
    return rows.select("conv_id", "chunk", "last", F.array_join(F.transform("items", lambda x: x["digest"]), "").alias("digests"), F.transform("items", lambda x: x["words"]).alias("words"))


def with_groups(rows: DataFrame) -> DataFrame:
    """Adds ``start`` and ``end`` (hexadecimal): digests of all turns before a row, and of those and its own.

    Rows of one start share their whole path so far; those of the first chunk have a start of zeros.
    """
    zeros = F.lit("0" * 2 * WIDTH)
    single = rows.where("last = 0").select("*", zeros.alias("start"), F.lit(None).cast("string").alias("end"))
    w = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    chain = F.collect_list(F.sha2("digests", 256)).over(w)  # a digest for every chunk of turns
    name = lambda c: F.substring(F.sha2(F.array_join(c, ""), 256), 1, 2 * WIDTH)
    longer = rows.where("last > 0").withColumn("chain", chain)
    longer = longer.select(*rows.columns, F.when(F.col("chunk") == 0, zeros).otherwise(name(F.expr("slice(chain, 1, size(chain) - 1)"))).alias("start"), F.when(F.col("chunk") < F.col("last"), name(F.col("chain"))).alias("end"))
    return single.unionByName(longer)


# ---- the sorted order, its LCP array and the blocks' minima -------------------------------------------------------


def common_symbols(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax()) // WIDTH


def _with_lcp(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, last, pos = TaskContext.get().partitionId(), None, 0
    for pdf in batches:
        lcp = []
        for seq in pdf["seq"]:
            lcp.append(-1 if last is None else common_symbols(last, seq))
            last = seq
        yield pdf.assign(part=part, pos=np.arange(pos, pos + len(pdf)), lcp=lcp)
        pos += len(pdf)


def sorted_rows(rows: DataFrame) -> DataFrame:
    """Rows with part, pos in it and lcp with the row before (-1 for a part's first), in the order of seq and conv_id."""
    ordered = rows.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    return materialise(ordered.mapInPandas(_with_lcp, ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", part int, pos long, lcp int"))


def block_plan(ordered: DataFrame) -> dict[int, tuple[int, int, list[int], list[int]]]:
    """Of each block: LCPs at its left and right end, and the intervals open at its left end.

    Those are two lists: a block, and the greatest depth of the nodes that began in it and are open.  The driver sees a
    block's row count, its minimum and its two outer sequences (of at most ``CHUNK`` turns), one block after another.
    """
    ends = ordered.groupBy("part").agg(F.min(F.when(F.col("lcp") >= 0, F.col("lcp"))).alias("least"), F.min_by("seq", "pos").alias("first"), F.max_by("seq", "pos").alias("last")).orderBy("part")
    plan, last, before, held = {}, None, None, ([], [])
    for row in ends.toLocalIterator():
        left = 0 if last is None else common_symbols(last, bytes(row.first))
        if before is not None:
            part, own_left, inner = before
            floor = min(x for x in (own_left, inner, left) if x is not None)
            plan[part] = (own_left, left, *held)
            starts, depths = (list(x) for x in held)
            while depths and depths[-1] > floor:
                if len(depths) > 1 and depths[-2] >= floor:
                    starts.pop(), depths.pop()
                else:
                    depths[-1] = floor
            if depths and depths[-1] == 0:
                starts.pop(), depths.pop()
            if left > floor:
                starts.append(part), depths.append(left)
            held = (starts, depths)
        last, before = bytes(row.last), (row.part, left, row.least)
    if before is not None:
        plan[before[0]] = (before[1], 0, *held)
    return plan


# ---- one block: a stack over its LCPs -----------------------------------------------------------------------------

_DEPTH_KEY = 1 << 31


def node_key(part: int, number: int) -> int:
    return part << 32 | number


def open_key(part: int, depth: int) -> int:
    """Of the node at ``depth`` that began in ``part`` and is open at its end."""
    return part << 32 | _DEPTH_KEY | depth


class _Open:
    __slots__ = ("children", "depth", "ends", "ids", "least", "leaves", "left", "n", "number", "saved", "words")

    def __init__(self, depth: int, number: int, left: bool, words):
        self.depth, self.number, self.left, self.words = depth, number, left, words
        self.n, self.least, self.children, self.leaves, self.saved, self.ids, self.ends = 0, None, 0, 0, 0, [], None

    def add(self, n: int, least: int) -> None:
        self.n += n
        self.least = least if self.least is None else min(self.least, least)


FIELDS = "kind string, key long, parent long, depth int, top int, n long, least long, children long, leaves long, saved array<long>, ends string, ids string, part int, words long, alias long, start binary"
_NAMES = [x.split()[0] for x in FIELDS.split(", ")]


class Block:
    """The nodes of one block, from its rows in order.

    ``node`` rows are whole nodes with all depths down to below their parent's (``top``); ``open`` rows are what the block
    has of a node that crosses its ends, beside what lies under a deeper such node; ``begun`` rows say which nodes began
    here and are open at the end.
    """

    def __init__(self, part: int, left: int, right: int, starts: list[int], depths: list[int]):
        self.part, self.left, self.right, self.starts, self.depths = part, left, right, starts, depths
        self.stack = [_Open(left, 0, True, None)] if left else []
        self.floor, self.numbers, self.rows, self.words, self.start = left, 0, [], None, None
        self.first = True

    def _began(self, depth: int) -> int:
        return self.starts[bisect_left(self.depths, depth)]

    def _emit(self, **values) -> None:
        self.rows.append(tuple(values.get(k) for k in _NAMES))

    def _key(self, e: _Open) -> int:
        return open_key(self._began(e.depth), e.depth) if e.left else node_key(self.part, e.number)

    def _ids(self, e: _Open) -> str | None:
        return ",".join(map(str, e.ids)) if e.ids else None

    def _part_of(self, e: _Open) -> None:
        key = open_key(self._began(e.depth) if e.left else self.part, e.depth)
        alias = None if e.left else node_key(self.part, e.number)
        self._emit(kind="open", key=key, depth=e.depth, n=e.n, least=e.least, children=e.children, leaves=e.leaves, saved=[e.saved], ends=e.ends, ids=self._ids(e), part=self.part, alias=alias)

    def _number(self) -> int:
        self.numbers += 1
        return self.numbers

    def _close(self, v: int) -> None:
        """Ends all intervals deeper than ``v``."""
        while self.stack and self.stack[-1].depth > v:
            e = self.stack.pop()
            if v and (not self.stack or self.stack[-1].depth < v):
                self.stack.append(_Open(v, self._number(), e.left, e.words))
            over = self.stack[-1] if self.stack else None
            if e.left:
                self._part_of(e)
                continue
            top = over.depth if over else 0
            # saved tokens at each depth from e's up to the one below `top`; the first symbol stands for the group, without words
            chain, saved = [], e.saved
            for k in range(e.depth, top, -1):
                saved += (e.n - 1) * (int(e.words[k - 2]) if k > 1 else 0) if e.n > 1 else 0
                chain.append(saved)
            leaves = e.leaves if e.children else 1
            ends = e.ends or hashlib.sha256((self._ids(e) or "").encode()).hexdigest()
            self._emit(kind="node", key=node_key(self.part, e.number), parent=self._key(over) if over else None, depth=e.depth, top=top, n=e.n, least=e.least, children=e.children, leaves=leaves, saved=chain[::-1], ends=ends, start=None if top else self.start)
            if over:
                over.add(e.n, e.least)
                over.children, over.leaves, over.saved = over.children + 1, over.leaves + leaves, over.saved + chain[-1]

    def add(self, conv: int, seq: bytes, words, lcp: int, below) -> None:
        """``below``: children, leaves, saved tokens and ends of a full row's last node, from the next level."""
        v = self.left if self.first else lcp
        self.first, self.floor = False, min(self.floor, v)
        self._close(v)
        size = len(seq) // WIDTH
        self.words, self.start = words, seq[:WIDTH]
        if size > v:
            e = _Open(size, self._number(), False, words)
            if below is not None:
                e.children, e.leaves, e.saved, e.ends = below
            self.stack.append(e)
        top = self.stack[-1]
        top.add(1, conv)
        if below is None:
            top.ids.append(conv)

    def finish(self) -> None:
        self._close(self.right)
        floor = min(self.floor, self.right)
        for e in self.stack:
            self._part_of(e)
        for depth in range(floor + 1, self.right + 1):
            parent = None if depth == 1 else open_key(self._began(depth - 1) if depth - 1 <= floor else self.part, depth - 1)
            self._emit(kind="begun", key=open_key(self.part, depth), parent=parent, depth=depth, part=self.part, words=int(self.words[depth - 2]) if depth > 1 else 0, start=self.start if depth == 1 else None)

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def _frames(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_NAMES)
    return out.astype({k: "Int64" for k in ("key", "parent", "n", "least", "children", "leaves", "words", "alias")} | {k: "Int32" for k in ("depth", "top", "part")})


def block_nodes(ordered: DataFrame, plan: dict) -> DataFrame:
    shared = ordered.sparkSession.sparkContext.broadcast(plan)  # a few numbers a block

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, out = None, []
        for pdf in batches:
            for part, conv, seq, words, lcp, below in zip(pdf["part"], pdf["conv_id"], pdf["seq"], pdf["words"], pdf["lcp"], pdf["below"]):
                if block is None or block.part != part:
                    if block is not None:
                        block.finish()
                        out += block.taken()
                    block = Block(int(part), *shared.value[int(part)])
                if below is not None:
                    below = (int(below["children"]), int(below["leaves"]), int(below["saved"]), below["ends"])
                block.add(int(conv), seq, words, int(lcp), below)
                if len(block.rows) > 10_000:
                    out += block.taken()
                if len(out) > 10_000:
                    yield _frames(out)
                    out = []
        if block is not None:
            block.finish()
            out += block.taken()
        if out:
            yield _frames(out)

    dealt = ordered.select("part", "pos", "conv_id", "seq", "words", "lcp", "below").repartition("part").sortWithinPartitions("part", "pos")
    return dealt.mapInPandas(walk, FIELDS)


# ---- nodes that cross blocks --------------------------------------------------------------------------------------


def crossing_ends(parts: DataFrame) -> DataFrame:
    """(key, ends): the hash of all ids that end at a crossing node, block by block.  SHA-256 reads them one after another,
    so one task does for one node, but never holds more than a block's ids."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, out = None, None, []
        for pdf in batches:
            for k, ids in zip(pdf["key"], pdf["ids"]):
                if k != key:
                    if key is not None:
                        out.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=["key", "ends"])
            out = []
        if key is not None:
            yield pd.DataFrame([(key, state.hexdigest())], columns=["key", "ends"])

    rows = parts.where("kind = 'open' and ids is not null").select("key", "part", "ids")
    return rows.repartition("key").sortWithinPartitions("key", "part").mapInPandas(digest, "key long, ends string")


def _joined_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums over subtrees of crossing nodes, which come in the reverse of their preorder: children are just before."""
    held: list[list] = []  # depth, n, least, leaves, saved
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            n, least, children, leaves, saved = r.n, r.least, r.children, r.leaves, r.saved
            while held and held[-1][0] == r.depth + 1:
                _, cn, cl, cleaves, csaved = held.pop()
                n, least, children, leaves, saved = n + cn, cl if pd.isna(least) else min(least, cl), children + 1, leaves + cleaves, saved + csaved
            leaves = leaves if children else 1
            saved += (n - 1) * r.words
            held.append([r.depth, n, least, leaves, saved])
            out.append(("node", r.key, r.parent, r.depth, r.depth - 1, n, least, children, leaves, [saved], r.ends or NOTHING, None, None, None, r.alias, r.start))
        yield _frames(out)


def crossing_nodes(parts: DataFrame) -> DataFrame:
    """Whole nodes of the intervals that cross blocks: at most ``CHUNK`` of them begin in a block, so one task can put
    together the sums of the whole list, a stream of small rows as long as there are blocks."""
    sums = parts.where("kind = 'open'").groupBy("key").agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.sum("children").alias("children"), F.sum("leaves").alias("leaves"), F.sum(F.element_at("saved", 1)).alias("saved"),
        F.max("ends").alias("below"), F.max("alias").alias("alias"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    begun = parts.where("kind = 'begun'").select("key", "parent", "depth", "part", "words", "start")
    rows = begun.join(sums, "key", "left").join(crossing_ends(parts), "key", "left").select(
        "key", "parent", "depth", "part", "words", "start", zero("n"), F.coalesce("least", F.lit(None)).alias("least"), zero("children"), zero("leaves"), zero("saved"), F.coalesce("below", "ends").alias("ends"), "alias"
    )
    return rows.coalesce(1).sortWithinPartitions(F.desc("part"), F.desc("depth")).mapInPandas(_joined_up, FIELDS)


# ---- levels and the whole tree ------------------------------------------------------------------------------------


def level_nodes(rows: DataFrame) -> DataFrame:
    """All nodes of one level's rows (conv_id, seq, words, below)."""
    ordered = sorted_rows(rows)
    parts = materialise(block_nodes(ordered, block_plan(ordered)))
    release(ordered)
    return materialise(parts.where("kind = 'node'").unionByName(crossing_nodes(parts)))


def node_rows(nodes: DataFrame, level: int, chunk: int) -> DataFrame:
    """A row for every depth of every node, without the groups' own symbol beyond the first level."""
    total = nodes.count()
    names = nodes.select("key", F.col("least").alias("above"), "children").unionByName(nodes.where("alias is not null").select(F.col("alias").alias("key"), F.col("least").alias("above"), "children"))
    children = nodes.where("parent is not null").drop("key").withColumnRenamed("parent", "key")
    own = [c for c in children.columns if c != "children"]
    children = children.select(*own, F.col("children").alias("n_below"))
    told = join_spread(children, names, "key", "children", total)
    roots = nodes.where("parent is null").select(*[F.col(c) for c in own if c != "key"], F.lit(None).cast("long").alias("key"), F.col("children").alias("n_below"), F.lit(None).cast("long").alias("above"))
    every = told.unionByName(roots).select("*", F.posexplode("saved").alias("step", "tokens"))
    symbol, lowest = F.col("top") + 1 + F.col("step"), F.col("top") + 1 + F.col("step") == F.col("depth")
    out = every.select(
        F.col("least").alias("conv_id"), symbol.alias("symbol"), F.when(F.col("step") == 0, F.col("above")).otherwise(F.col("least")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(lowest, F.col("n_below")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("tokens").alias("saved_tokens"), F.when(lowest, F.col("ends")).otherwise(NOTHING).alias("ends_sha256"),
    )
    if level:
        out = out.where("symbol > 1")
    depth = (F.col("symbol") - 1 + level * chunk).cast("long")
    return out.select("conv_id", depth.alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _root_rows(nodes: DataFrame) -> DataFrame:
    """start and what the last node of the rows that end there takes over: (children, leaves, saved, ends), and members."""
    one = F.col("depth") == 1
    below = F.struct(F.when(one, F.col("children")).otherwise(1).cast("long").alias("children"), "leaves", F.element_at("saved", 1).alias("saved"), F.when(one, F.col("ends")).otherwise(NOTHING).alias("ends"))
    return nodes.where("top = 0").select(F.hex("start").alias("end"), below.alias("below"), F.col("n").alias("members"))


def prefix_trie(conversations: DataFrame, chunk: int | None = None) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is told by its depth and its smallest member.  Turns of one conversation with equal ``turn`` (repeated rows
    too: each is a turn) go by the digest of role and text.  Rows without conv_id belong to no conversation; conversations
    without any turn left by the rebuilding are members of the root; an empty table has no nodes.  Other columns are not
    read.  Rows of ``chunk`` turns bound what a task holds of one conversation: the deepest turns come first, and a node at
    a chunk's end takes over what its next level found.
    """
    chunk = chunk or CHUNK
    rows = materialise(with_groups(chunk_rows(conversations, chunk)))
    deepest = rows.agg(F.max("chunk")).first()[0]
    kind = "struct<children: bigint, leaves: bigint, saved: bigint, ends: string>"
    out, roots = None, None
    for level in range(deepest if deepest is not None else 0, -1, -1):
        here = rows.where(F.col("chunk") == level).select("conv_id", F.unhex(F.concat("start", "digests")).alias("seq"), "words", F.upper("end").alias("end"))
        if roots is None:
            here = here.select("conv_id", "seq", "words", F.lit(None).cast(kind).alias("below"))
        else:
            full = join_spread(here.where(F.col("end").isNotNull()), roots, "end", "members", here.count())
            here = here.where(F.col("end").isNull()).withColumn("below", F.lit(None).cast(kind)).unionByName(full).drop("end")
        nodes = level_nodes(here)
        found = node_rows(nodes, level, chunk)
        out, roots = found if out is None else out.unionByName(found), _root_rows(nodes)
    return out


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))
