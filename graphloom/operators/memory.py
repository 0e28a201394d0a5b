"""Memory and scratchpad: budgeted prefixes, truncation, evidence scores, contradictions, convergence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.functions import text
from graphloom.functions.joins import spread
from graphloom.operators.tables import SegmentTable
from graphloom.storage import cut


def within_budget(entries: DataFrame, budget: int, group: list[str], order: list) -> DataFrame:
    """Entries in order while the budget before them is not used up: the last one may overshoot."""
    used = F.coalesce(F.sum("token_count").over(W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return entries.withColumn("__used", used).where(F.col("__used") < budget).drop("__used")


def session_context(memory: DataFrame, budget: int) -> DataFrame:
    """Session memories, oldest first, within the budget of each session."""
    return within_budget(memory.where(F.col("tier") == "session"), budget, ["session_id"], ["created_at", "memory_id"])


def token_totals(memory: DataFrame) -> DataFrame:
    return memory.groupBy("session_id").agg(F.sum("token_count").cast("long").alias("tokens"))


def truncated_turn(content: Column, most: int = 200) -> Column:
    """A turn as it is kept without a compressor: at most ``most`` bytes of UTF-8 and three dots; a character that the cut
    would divide goes."""
    return text.ellipsis_bytes(content, most)


#: fixed values: the highest confidence of each kind of source, first match counts
RELIABILITY = ((("deep_dive", "lookup_node"), 0.95), (("trace", "neighborhood"), 0.90), (("search",), 0.70), (("security", "blast"), 0.85))
#: fixed values: what denies
NEGATIONS = ("no ", "not ", "never ", "none ", "without ", "missing ", "lacks ")


def reliability(source: Column) -> Column:
    out = F.lit(0.80)
    for words, value in reversed(RELIABILITY):
        hit = F.lit(False)
        for w in words:
            hit = hit | source.contains(w)
        out = F.when(hit, value).otherwise(out)
    return out


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def priority() -> Column:
    return 0.3 * F.col("relevance") + 0.3 * F.col("confidence") + 0.2 * F.col("novelty") + 0.2 * F.col("actionability")


def similar_pairs(rows: DataFrame, least: float, group: list[str], strict: bool = True) -> DataFrame:
    """(group, a, b, similarity) of entries (group, entry, content) whose word sets are similar: a before b.

    Pairs are found through shared words, rarest first: two sets whose similarity is above ``least`` share one of
    the first (1 - least) part of their words in any fixed order, so only those are joined on; the exact
    similarity follows.  The pairs are the result: entries that are all alike give all their pairs, so a group is one
    session's or one day's entries, not a table.
    """
    sets = rows.select(*group, "entry", text.word_set(F.col("content")).alias("w")).where(F.size("w") > 0)
    sized = sets.withColumn("n", F.size("w"))
    words = sized.select(*group, "entry", "n", F.explode("w").alias("word"))
    freq = words.groupBy(*group, "word").agg(F.count("*").alias("f"))
    place = F.row_number().over(W.partitionBy(*group, "entry").orderBy("f", "word"))
    prefix = words.join(freq, [*group, "word"]).withColumn("p", place).where(F.col("p") <= F.floor(F.col("n") * (1 - least)) + 1).select(*group, "word", "entry")
    pairs = prefix.withColumnRenamed("entry", "a").join(prefix.withColumnRenamed("entry", "b"), [*group, "word"]).where("a < b").select(*group, "a", "b").distinct()
    left, right = sets.select(*group, F.col("entry").alias("a"), F.col("w").alias("wa")), sets.select(*group, F.col("entry").alias("b"), F.col("w").alias("wb"))
    score = text.jaccard(F.col("wa"), F.col("wb"))
    out = pairs.join(left, [*group, "a"]).join(right, [*group, "b"]).select(*group, "a", "b", score.alias("similarity"))
    return out.where(F.col("similarity") > least if strict else F.col("similarity") >= least)


def similar_classes(rows: DataFrame, least: float, group: list[str], strict: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, members, links) of entries (group, entry, content) that are similar.

    A class is the entries of one group with equal word sets; its smallest entry stands for it.  ``classes`` has (group,
    class_id, n_members, n_links, least): how many other classes are similar, and the smallest entry of the class and those.
    ``members`` has (group, entry) and those columns of its class, ``links`` (group, a, b, similarity) of classes, a before b.  All pairs of
    entries follow from links and members (``expanded``); here equal entries, however many, are one row and a membership.
    Entries without words are in no class.
    """
    sets = rows.select(*group, "entry", "content", text.word_set(F.col("content")).alias("w")).where(F.size("w") > 0).withColumn("set", F.sha2(F.array_join(F.array_sort("w"), " "), 256))
    found = cut(sets.groupBy(*group, "set").agg(F.min("entry").alias("class_id"), F.min_by("content", "entry").alias("content"), F.count("*").alias("n_members")))
    links = cut(similar_pairs(found.select(*group, F.col("class_id").alias("entry"), "content"), least, group, strict))
    ends = links.select(*group, F.explode(F.array(F.struct(F.col("a").alias("class_id"), F.col("b").alias("other")), F.struct(F.col("b").alias("class_id"), F.col("a").alias("other")))).alias("e"))
    near = ends.select(*group, "e.*").groupBy(*group, "class_id").agg(F.count("*").alias("n_links"), F.min("other").alias("other"))
    classes = found.join(near, [*group, "class_id"], "left").select(*group, "set", "class_id", "n_members", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.least("class_id", "other").alias("least"))
    total = found.agg(F.sum("n_members")).first()[0] or 0
    keyed = classes.withColumn("__n", F.col("n_members"))
    members = spread(sets.select(*group, "set", "entry"), keyed, [*group, "set"], "__n", total)
    return classes.drop("set"), members.drop("set"), links


def expanded(members: DataFrame, links: DataFrame, group: list[str]) -> DataFrame:
    """(group, a, b) of all similar pairs of entries, a before b: as many rows as that are, for groups where those are few."""
    one = members.select(*group, F.col("entry").alias("x"), F.col("class_id").alias("cx"))
    two = members.select(*group, F.col("entry").alias("y"), F.col("class_id").alias("cy"))
    within = one.join(two.withColumnRenamed("cy", "cx"), [*group, "cx"]).where("x < y").select(*group, F.col("x").alias("a"), F.col("y").alias("b"))
    across = links.select(*group, F.col("a").alias("cx"), F.col("b").alias("cy")).join(one, [*group, "cx"]).join(two, [*group, "cy"])
    return within.unionByName(across.select(*group, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def validate(evidence: DataFrame, goal: str, group: list[str]) -> DataFrame:
    """Evidence (entry, content, source and four scores) with clamped and capped scores and its ``priority``.

    Novelty is at most 0.1 after a similar earlier entry, relevance at most 0.5 without a word of the goal, confidence
    at most what the source allows.
    """
    _, members, _ = similar_classes(evidence, 0.8, group)
    repeats = members.where(F.col("entry") > F.col("least")).select(*group, "entry").withColumn("repeat", F.lit(True))
    words = [w for w in goal.lower().split() if len(w.encode()) > 3]
    on_goal = F.lit(False)
    for w in words:
        on_goal = on_goal | F.lower("content").contains(w)
    scored = evidence.join(repeats, [*group, "entry"], "left").withColumns({
        "relevance": F.when(on_goal, clamp(F.col("relevance"))).otherwise(F.least(clamp(F.col("relevance")), F.lit(0.5))),
        "confidence": F.least(clamp(F.col("confidence")), reliability(F.col("source"))),
        "novelty": F.when(F.col("repeat"), F.least(clamp(F.col("novelty")), F.lit(0.1))).otherwise(clamp(F.col("novelty"))),
        "actionability": clamp(F.col("actionability")),
    }).drop("repeat")
    return scored.withColumn("priority", F.round(priority(), 6))


def contradictions(evidence: DataFrame, group: list[str]) -> DataFrame:
    """(group, a, b) of entries of relevance 0.5 or more on one topic, one of which denies: a negation in just one."""
    relevant = evidence.where(F.col("relevance") >= 0.5)
    negated = F.array(*(F.lower("content").contains(n) for n in NEGATIONS))
    flags = relevant.select(*group, "entry", negated.alias("neg"))
    pairs = similar_pairs(relevant, 0.3, group)
    joined = pairs.join(flags.select(*group, F.col("entry").alias("a"), F.col("neg").alias("na")), [*group, "a"]).join(flags.select(*group, F.col("entry").alias("b"), F.col("neg").alias("nb")), [*group, "b"])
    differ = F.exists(F.zip_with("na", "nb", lambda x, y: x != y), lambda z: z)
    return joined.where(differ).select(*group, "a", "b")


def after_contradictions(evidence: DataFrame, pairs: DataFrame, group: list[str]) -> DataFrame:
    """Evidence with 0.2 less confidence (0 at least) for each contradiction, and priority anew."""
    ends = pairs.select(*group, F.explode(F.array("a", "b")).alias("entry")).groupBy(*group, "entry").agg(F.count("*").alias("against"))
    joined = evidence.join(ends, [*group, "entry"], "left").withColumn("confidence", F.greatest(F.lit(0.0), F.col("confidence") - 0.2 * F.coalesce("against", F.lit(0))))
    return joined.drop("against").withColumn("priority", F.round(priority(), 6))


def top_evidence(evidence: DataFrame, n: int = 10, least: float = 0.0) -> DataFrame:
    return evidence.where(F.col("priority") >= least).orderBy(F.desc("priority"), "entry").limit(n)


def already_tried(actions: DataFrame, tool: str, args: str) -> DataFrame:
    """Earlier actions of a tool whose arguments are more than 0.7 alike."""
    words = sorted({w for w in args.lower().split() if len(w.encode()) > 2})
    mine = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
    return actions.where((F.col("tool") == tool) & (text.jaccard(text.word_set(F.col("args")), mine) > 0.7))


def convergence(state: DataFrame) -> DataFrame:
    """One row (session, converged, failures) for each row of counts: delegations, high_priority, open_high, last_novel,
    previous_novel, hypotheses, concluded, unresolved.  Six gates; novelty is judged only with two findings."""
    gate = lambda bad, name: F.when(bad, F.lit(name))
    failures = F.array_compact(F.array(
        gate(F.col("delegations") < 3, "delegations"), gate(F.col("high_priority") < 5, "evidence"), gate(F.col("open_high") > 0, "open_question"),
        gate((F.col("last_novel") >= 2) | (F.col("previous_novel") >= 2), "still_novel"), gate((F.col("hypotheses") > 0) & (F.col("concluded") == 0), "hypotheses"),
        gate(F.col("unresolved") > 0, "contradiction"),
    ))
    return state.select("session", (F.size(failures) == 0).alias("converged"), F.array_join(failures, ",").alias("failures"))


def persistable(evidence: DataFrame, hypotheses: DataFrame, strategy: DataFrame) -> DataFrame:
    """(kind, content) worth keeping: the ten best findings of priority 0.4 or more, concluded hypotheses, the strategy."""
    found = top_evidence(evidence, 10, 0.4).select(F.lit("finding").alias("kind"), "content")
    kept = hypotheses.where(F.col("status").isin("confirmed", "rejected")).select(F.lit("hypothesis").alias("kind"), F.concat(F.col("status"), F.lit(": "), F.col("content")).alias("content"))
    return found.unionByName(kept).unionByName(strategy.select(F.lit("strategy").alias("kind"), "content"))


def is_redundant(candidates: DataFrame, evidence: DataFrame, least: float = 0.7) -> DataFrame:
    """Candidates (entry, content) that are like some evidence (content), each once."""
    name = lambda kind: F.concat(F.lit(kind), F.sha2("content", 256))
    # equal texts are one on either side
    every = candidates.select("content").distinct().select(F.lit(0).alias("g"), name("c:").alias("entry"), "content").unionByName(
        evidence.select("content").distinct().select(F.lit(0).alias("g"), name("e:").alias("entry"), "content")
    )
    pairs = similar_pairs(every, least, ["g"])
    hit = pairs.where(F.col("a").startswith("c:") & F.col("b").startswith("e:")).select(F.expr("substring(a, 3)").alias("__hash")).distinct()
    return candidates.withColumn("__hash", F.sha2("content", 256)).join(hit, "__hash", "left_semi").drop("__hash")


def valid_messages(messages: DataFrame) -> DataFrame:
    """Messages of a known role with content, in the order of their session."""
    return messages.where(F.col("role").isin("user", "assistant", "system") & (F.trim("content") != "")).orderBy("session_id", "created_at")


class MemoryStore:
    """Sessions, their messages and memories of three tiers, below a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        table = lambda name, ddl, by: SegmentTable(spark, f"{path}/{name}", ddl, by)
        self.spark = spark
        self.session_table = table("sessions", schema.SESSIONS, ("repo_slug", "repo_slug"))
        self.message_table = table("messages", schema.MESSAGES, ("role", "role"))
        self.memory_table = table("memories", schema.MEMORY, ("repo_slug", "tier"))

    def _put(self, table: SegmentTable, rows: DataFrame, key: str) -> None:
        from graphloom.operators.store import upsert

        seen, new = table.version()[0], cut(schema.conform(rows, table.ddl))
        pairs = table.pairs_of(new)
        if pairs:
            table.replace(upsert(table.of_pairs(pairs), new, [key]), pairs, seen, new.count())

    def put_sessions(self, sessions: DataFrame) -> None:
        self._put(self.session_table, sessions, "session_id")

    def add_messages(self, messages: DataFrame) -> None:
        """Appended; a message of another role than user, assistant or system is an error."""
        self.message_table.append(cut(schema.require(schema.conform(messages, schema.MESSAGES), "role")))

    def remember(self, memories: DataFrame) -> None:
        """Replaced by memory_id; a missing token count is a quarter of the bytes."""
        rows = schema.require(schema.conform(memories, schema.MEMORY), "tier")
        self._put(self.memory_table, rows.withColumn("token_count", F.coalesce("token_count", text.token_estimate(F.coalesce("content", F.lit(""))))), "memory_id")

    def sessions(self, repo_slug: str | None = None) -> DataFrame:
        """Newest first."""
        return self.session_table.read(repo_slug).orderBy(F.desc("created_at"), "session_id")

    def messages(self, session_id: str) -> DataFrame:
        return valid_messages(self.message_table.read().where(F.col("session_id") == session_id))

    def memories(self, session_id: str) -> DataFrame:
        """A session's memories, oldest first."""
        return self.memory_table.read(labels=["session"]).where(F.col("session_id") == session_id).orderBy("created_at", "memory_id")

    def recall(self, query: list[float], k: int = 5, tier: str = "persistent", repo_slug: str | None = None) -> DataFrame:
        """(memory_id, content, score) of the ``k`` memories of a tier most like a vector, best first."""
        return recalled(self.memory_table.read(repo_slug, [tier]), query, k)

    def prefix(self, session_id: str, query: list[float], budget: int, k: int = 5, repo_slug: str | None = None) -> DataFrame:
        """(tier, memory_id, content): a session's memories within a budget of tokens, then the ``k`` best persistent ones."""
        session = session_context(self.memories(session_id), budget).select("tier", "memory_id", "content")
        return session.unionByName(self.recall(query, k, repo_slug=repo_slug).select(F.lit("persistent").alias("tier"), "memory_id", "content"))

    def delete_session(self, session_id: str) -> None:
        """The session, its messages and its memories."""
        for table in (self.session_table, self.message_table, self.memory_table):
            here = F.coalesce(F.col("session_id") == session_id, F.lit(False))
            seen = table.version()[0]
            pairs = table.pairs_of(table.read().where(here))
            if pairs:
                table.replace(cut(table.of_pairs(pairs).where(~here)), pairs, seen)


def recalled(memories: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    """(memory_id, content, score) of the ``k`` memories with a vector that are most like ``query``, ties by id."""
    from graphloom.operators.search import vector_search

    best = vector_search(memories, query, k, id_column="memory_id")
    return best.join(memories.select("memory_id", "content"), "memory_id").select("memory_id", "content", "score").orderBy(F.desc("score"), "memory_id")
