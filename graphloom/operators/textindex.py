"""A stored inverted index: postings by term in blocks of like impact, read by term and skipped by threshold.

An impact is what a posting adds to a score before the term's weight.  Blocks of a term hold postings of one impact level
(highest first), so a search knows from a small dictionary which levels can still reach the best ``k``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators.search import B, DIGITS, K1, postings
from graphloom.storage import cut, release

#: postings of a block, about; folders that terms are dealt to by hash; impact levels of a term
BLOCK, SHARDS, LEVELS = 1024, 64, 16
#: a (term, level) with more postings than this and than a hundred-thousandth of all is split: at most 100,000 are
HOT, MOST_HOT = 8192, 100_000
#: documents up to which a search names the blocks that may hold them
MOST_NAMED = 1000


@dataclass
class TextIndex:
    spark: SparkSession
    path: str
    id_column: str

    def _schema(self, name: str) -> str:
        return self.spark.read.text(f"{self.path}/{name}_schema").first()[0]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self._schema(name)).parquet(f"{self.path}/{name}")

    def levels(self, terms: list[str]) -> list:
        """(field, term, level, weight, most, n) of the terms: at most fields x terms x ``LEVELS`` rows."""
        shards = sorted({int(r[0]) for r in self.spark.range(1).select(F.explode(F.array(*map(F.lit, terms))).alias("term")).select(shard_of(F.col("term"))).collect()})
        return self.table("dictionary").where(F.col("shard").isin(shards) & F.col("term").isin(*terms)).orderBy("field", "term", F.desc("level")).collect()

    def blocks(self, wanted: list[tuple[str, str, int, list[int] | None]]) -> DataFrame:
        """Blocks of (field, term, level, block numbers or None for all): folders by shard, row groups by term."""
        shards = [int(x) for x in self.spark.range(1).select(F.array_distinct(F.array(*(shard_of(F.lit(w[1])) for w in wanted)))).first()[0]]
        some = F.lit(False)
        for name, term, level, numbers in wanted:
            one = (F.col("field") == name) & (F.col("term") == term) & (F.col("level") == level)
            some = some | (one if numbers is None else one & F.col("block").isin(numbers))
        return self.table("postings").where(F.col("shard").isin(shards) & F.col("term").isin(*sorted({w[1] for w in wanted})) & some)

    def _scores(self, wanted: list, weights: dict[tuple[str, str], float]) -> DataFrame:
        if not wanted:
            return self._none()
        weight = F.element_at(F.create_map(*(x for (f, t), w in weights.items() for x in (F.lit(f + "\n" + t), F.lit(w)))), F.concat("field", F.lit("\n"), "term"))
        rows = self.blocks(wanted).select(F.explode(F.arrays_zip("ids", "impacts")).alias("p"), weight.alias("weight"))
        return rows.select(F.col("p.ids").alias(self.id_column), (F.col("p.impacts") * F.col("weight")).alias("score"))

    def _summed(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(self.id_column).agg(F.sum("score").alias("score"))

    def _none(self) -> DataFrame:
        return self.table("postings").select(F.explode("ids").alias(self.id_column), F.lit(0.0).alias("score")).where("false")

    def search(self, terms: list[str], k: int = 10) -> DataFrame:
        """(id, score): the ``k`` best by BM25 over all fields, best first, ties by id, as ``bm25_scores`` gives them.

        The highest levels give ``k`` documents and so a score that the answer reaches.  Terms that all together cannot reach it
        find no document by themselves.  Of the others, levels that cannot reach it with the most that all terms can add are
        not read: no document of the answer lies in them.  What the first kind of terms adds is read for the documents found,
        from the blocks that their hashes name.
        """
        terms = list(dict.fromkeys(terms))
        found = self.levels(terms) if terms else []
        if not found or k < 1:
            return self._none()
        weights = {(r.field, r.term): r.weight for r in found}
        most: dict[tuple[str, str], float] = {}
        for r in found:
            most[r.field, r.term] = max(most.get((r.field, r.term), 0.0), r.weight * r.most)
        every, reached = sum(most.values()), self._reached(found, weights, k)
        light, adds = set(), 0.0
        for key in sorted(most, key=lambda x: (most[x], x)):
            if adds + most[key] >= reached:
                break
            light.add(key)
            adds += most[key]
        heavy = [(r.field, r.term, r.level, None) for r in found if (r.field, r.term) not in light and r.weight * r.most + every - most[r.field, r.term] >= reached]
        partial = self._summed(self._scores(heavy, weights))
        if light:
            near = cut(partial.where(F.col("score") >= reached - adds))
            rest = self._scores(self._holding(near, [r for r in found if (r.field, r.term) in light]), weights)
            partial = self._summed(near.unionByName(rest.join(near.select(self.id_column), self.id_column, "left_semi")))
        return partial.select(self.id_column, F.round("score", DIGITS).alias("score")).orderBy(F.desc("score"), self.id_column).limit(k)

    def _reached(self, found: list, weights: dict, k: int) -> float:
        """A score that the ``k`` best have, less what rounding may hide: from the levels with the highest scores, until they
        hold ``k`` postings of one term."""
        first, held = [], {}
        for r in sorted(found, key=lambda r: (-r.weight * r.most, r.field, r.term)):
            first.append((r.field, r.term, r.level, None))
            held[r.field, r.term] = held.get((r.field, r.term), 0) + r.n
            if held[r.field, r.term] >= k:
                best = self._summed(self._scores(first, weights)).orderBy(F.desc("score")).limit(k).agg(F.min("score"), F.count("*")).first()
                return best[0] - 10.0**-DIGITS if best[1] == k else 0.0
        return 0.0

    def _holding(self, near: DataFrame, levels: list) -> list:
        """The blocks of ``levels`` that may hold documents of ``near``: named by their hashes where they are few."""
        if near.count() > MOST_NAMED:
            return [(r.field, r.term, r.level, None) for r in levels]
        hashes = [r[0] for r in near.select(F.xxhash64(self.id_column)).collect()]
        return [(r.field, r.term, r.level, sorted({h % r.parts for h in hashes})) for r in levels if hashes]


def shard_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SHARDS)).cast("int")


def build(docs: DataFrame, id_column: str, fields: dict[str, Column], path: str) -> TextIndex:
    """Stores the index of token columns below ``path``.

    Impacts stand for the documents as they are now (field lengths and their mean); new documents go into an index of
    their own until it is made anew.  A term in very many documents has as many blocks as its postings need, dealt by a
    hash of the document, so no task holds all of them.
    """
    spark = docs.sparkSession
    every = cut(postings(docs, id_column, fields))  # tokens are made once, however often postings are read
    totals = cut(every.where("head").groupBy("field").agg(F.count("*").alias("docs"), F.avg("length").alias("mean")))  # a row a field
    impact = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    level = F.least(F.lit(LEVELS - 1), F.floor(F.col("impact") / (K1 + 1) * LEVELS)).cast("int")
    rows = every.join(F.broadcast(totals), "field").select(id_column, "field", "term", "docs", impact.alias("impact")).withColumn("level", level)
    key = ["term", "level", "field"]  # what tells most first: rows are sorted by it
    sizes = cut(rows.groupBy(*key).agg(F.count("*").alias("n"), F.max("impact").alias("most"), F.first("docs").alias("docs")))
    # a folder's terms come together once: counted, sorted and written there
    dictionary = sizes.withColumn("shard", shard_of(F.col("term"))).repartition("shard").withColumn("df", F.sum("n").over(W.partitionBy("shard", "term", "field")))
    weight = F.log1p((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    dictionary = dictionary.select("field", "term", "level", weight.alias("weight"), "most", "n", F.ceil(F.col("n") / BLOCK).alias("parts"), "shard")
    bound = max(HOT, (sizes.agg(F.sum("n")).first()[0] or 0) // MOST_HOT)
    hot = F.broadcast(sizes.where(F.col("n") > bound).select(*key, F.ceil(F.col("n") / BLOCK).alias("parts")))
    # postings of a hot key are dealt before they move, all others come together, and are dealt where their key has several blocks
    block = F.coalesce(F.pmod(F.xxhash64(id_column), "parts"), F.lit(0))
    met = rows.join(hot, key, "left").groupBy(*key, block.alias("block"), F.col("parts").isNotNull().alias("dealt")).agg(F.collect_list(F.struct(id_column, "impact")).alias("p"))
    met = met.select(*key, "block", "p", F.when(F.col("dealt"), F.lit(1)).otherwise(F.ceil(F.size("p") / BLOCK)).cast("long").alias("parts"))
    split = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda b: F.struct(b.alias("block"), F.filter("p", lambda x: F.pmod(F.xxhash64(x[id_column]), F.col("parts")) == b).alias("p")))
    whole = F.array(F.struct("block", "p"))
    blocks = met.select(*key, F.explode(F.when(F.col("parts") == 1, whole).otherwise(split)).alias("b")).select(*key, "b.*").where(F.size("p") > 0)
    stored = blocks.select("field", "term", "level", "block", F.col(f"p.{id_column}").alias("ids"), F.col("p.impact").alias("impacts"), shard_of(F.col("term")).alias("shard"))
    for name, frame in (("postings", stored.repartitionByRange("shard", "term", "level")), ("dictionary", dictionary)):
        frame.sortWithinPartitions("shard", "term", F.desc("level")).write.partitionBy("shard").option("parquet.block.size", 4 << 20).parquet(f"{path}/{name}")
        ddl = ", ".join(f"{c} {t}" for c, t in frame.dtypes)
        spark.createDataFrame([(ddl,)], "value string").coalesce(1).write.text(f"{path}/{name}_schema")
    release(every, totals, sizes)
    return TextIndex(spark, path, id_column)


def load(spark: SparkSession, path: str, id_column: str) -> TextIndex:
    return TextIndex(spark, path, id_column)

