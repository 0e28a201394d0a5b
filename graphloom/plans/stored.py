"""Queries over stored, organised copies of the tables: vector cells, adjacency, postings, sorted nodes, keyed state."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import adjacency, analyze, ann, history, lookup, memory, merkle, textindex
from graphloom.plans import driver_graph as g
from graphloom.plans.catalogue import BLAST, FLOW_WALK, OVERLAP, PAIRS, _all, _bfs_sql, _diffs, _evidence, _flow_seeds, query
from graphloom.storage import new_folder
from graphloom.streaming import changefeed, degrees, registry

# --- vectors by cell ----------------------------------------------------------------------------------------------------


@query("ann_recall", "SELECT count(*) FILTER (vec_id % 20 = 0) AS queries, 10 * count(*) FILTER (vec_id % 20 = 0) AS expected, true AS recall_is_enough FROM embeddings WHERE list_sum(list_transform(embedding, lambda x: x * x)) > 0", graph=False)
def _(t):
    """Recall of the ten nearest by cells against all rows compared: 0.9 or more."""
    index = ann.build(t.embeddings, 64, new_folder(t.spark), id_column="vec_id")
    asked = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    rows = ann.recall(index.search_many(asked), ann.exact_many(t.embeddings, asked, id_column="vec_id"), "vec_id")
    return rows.select("queries", "expected", (F.col("recall") >= 0.9).alias("recall_is_enough"))


# --- adjacency on disk ------------------------------------------------------------------------------------------------


@query("blast_radius_stored", BLAST + "SELECT h.node_id, qualified, file_path, hop FROM hops h JOIN nodes n ON n.node_id = h.node_id")
def _(t):
    nodes, stored = g.nodes(t), adjacency.save(g.calls(t), new_folder(t.spark))
    return analyze.blast_radius(_all(nodes, "supplier"), stored, nodes).select("node_id", "qualified", "file_path", "hop")


@query("diff_impact_stored", OVERLAP + _bfs_sql("SELECT * FROM calls", "SELECT node_id FROM changed", 3, True) + """SELECT node_id, CAST(0 AS INTEGER) AS hop, 'changed' AS role FROM changed UNION ALL
SELECT h.node_id, h.hop, 'affected' FROM hops h WHERE h.node_id IN (SELECT node_id FROM nodes) AND h.node_id NOT IN (SELECT node_id FROM changed)""")
def _(t):
    nodes, stored = g.nodes(t), adjacency.save(g.calls(t), new_folder(t.spark))
    as_code = nodes.withColumn("label", F.when(F.col("label") == "part", "function").otherwise(F.col("label")))
    return analyze.diff_impact(_diffs(t), stored, as_code).select("node_id", "hop", "role")


# --- postings on disk -------------------------------------------------------------------------------------------------

ASKED = ["idiot", "reason", "thereon", "src1", "de"]
FIELDS_SQL = f"""WITH toks AS (
  SELECT doc_id, field, list_filter(string_split_regex(replace(translate(lower(words), '{text.ACCENTS}', '{text.FOLDED}'), 'ß', 'ss'), '[^a-z0-9]+'), lambda x: x <> '') AS t
  FROM (SELECT doc_id, 'text' AS field, text AS words FROM documents UNION ALL SELECT doc_id, 'origin', source || ' ' || lang FROM documents)
), lens AS (SELECT doc_id, field, len(t) AS length, t FROM toks WHERE len(t) > 0), tot AS (SELECT field, count(*) AS n, avg(length) AS mean FROM lens GROUP BY field),
tf AS (SELECT doc_id, field, length, term, CAST(len(list_filter(t, lambda x: x = term)) AS BIGINT) AS tf FROM lens, (SELECT unnest({ASKED!r}) AS term)),
hit AS (SELECT * FROM tf WHERE tf > 0), df AS (SELECT field, term, count(*) AS df FROM hit GROUP BY field, term)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
FROM hit JOIN df USING (field, term) JOIN tot USING (field) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20"""


@query("bm25_indexed", FIELDS_SQL, graph=False)
def _(t):
    """Two fields, from the stored index: the same as scanning all documents."""
    fields = {"text": text.word_tokens(F.col("text")), "origin": text.word_tokens(F.concat("source", F.lit(" "), F.col("lang")))}
    return textindex.build(t.documents, "doc_id", fields, new_folder(t.spark)).search(ASKED, 20)


# --- sorted nodes with filters ----------------------------------------------------------------------------------------


@query("point_lookup_stored", """ SELECT 'id' AS how, node_id, label, qualified FROM nodes WHERE node_id IN ('part:7', 'supplier:3', 'orders:32', 'part:-1')
UNION ALL SELECT 'qualified', node_id, label, qualified FROM nodes WHERE qualified = 'ASIA.NATION_2'
UNION ALL SELECT * FROM (SELECT 'name', node_id, label, qualified FROM nodes WHERE name = 'O7' ORDER BY node_id LIMIT 1)""")
def _(t):
    path = new_folder(t.spark)
    lookup.save(g.nodes(t), path)
    found = lookup.by_id(t.spark, path, ["part:7", "supplier:3", "orders:32", "part:-1"]).withColumn("how", F.lit("id"))
    for how, symbol in (("qualified", "ASIA.NATION_2"), ("name", "O7")):
        found = found.unionByName(lookup.find(t.spark, path, symbol).withColumn("how", F.lit(how)))
    return found.select("how", "node_id", "label", "qualified")


# --- keyed state ------------------------------------------------------------------------------------------------------


@query("registry_evicted", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 DAY THEN 0 ELSE 1 END AS fresh FROM events WHERE user_id IS NOT NULL),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS run FROM e),
g AS (SELECT user_id, run, min(ts) AS started, max(ts) AS seen, count(*) AS n FROM r GROUP BY user_id, run)
SELECT user_id, started, seen, n FROM g WHERE EXISTS (SELECT 1 FROM g later WHERE later.user_id = g.user_id AND later.run > g.run) OR seen + INTERVAL 2 DAY <= (SELECT max(ts) FROM events)""", graph=False)
def _(t):
    """Users not seen for two days, as they are evicted by a stream over all events."""
    out, log = new_folder(t.spark), new_folder(t.spark)
    t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts")).repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(log)
    kind = t.events.schema["user_id"].dataType.simpleString()
    stream = t.spark.readStream.schema(f"user_id {kind}, ts timestamp").parquet(log)
    ddl = f"user_id {kind}, started timestamp, seen timestamp, n long"
    rows = registry.evicted(stream, "user_id", "ts", 2 * 86_400)
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_folder(t.spark)).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(ddl).parquet(out).select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("seen").cast("timestamp_ntz").alias("seen"), "n")


#: lines in a file of a change log, about
LOG_ROWS = 1_000_000


@query("degrees_live", """WITH e AS (SELECT 'orders:' || l_orderkey AS a, 'part:' || l_partkey AS b FROM lineitem WHERE l_returnflag <> 'R'),
d AS (SELECT a AS node_id, 0 AS i, 1 AS o FROM e UNION ALL SELECT b, 1, 0 FROM e)
SELECT node_id, CAST(sum(i) AS BIGINT) AS call_count, CAST(sum(o) AS BIGINT) AS callee_count, CAST(count(*) AS BIGINT) AS centrality FROM d GROUP BY node_id""", graph=False)
def _(t):
    """Degrees after a change log of all lines was taken in, batch by batch: returned lines are taken out again."""
    log = new_folder(t.spark)
    ends = F.concat(F.lit("orders:"), F.col("l_orderkey").cast("string")).alias("from_id"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("to_id")
    ops = F.explode(F.when(F.col("l_returnflag") == "R", F.array(F.lit("put"), F.lit("delete"))).otherwise(F.array(F.lit("put"))))
    files = 3 * max(1, round(t.lineitem.count() / (3 * LOG_ROWS)))  # three batches, of as many files as their lines need
    t.lineitem.select(ops.alias("op"), F.lit("calls").alias("label"), *ends, F.col("l_shipdate").cast("timestamp").alias("ts")).repartition(files).write.parquet(log)
    live = degrees.LiveDegrees(t.spark, new_folder(t.spark))
    changes = changefeed.read_changes(t.spark, log, "op string, label string, from_id string, to_id string, ts timestamp", files_per_trigger=files // 3)
    changes.writeStream.foreachBatch(live.apply).option("checkpointLocation", new_folder(t.spark)).trigger(availableNow=True).start().awaitTermination()
    return live.current()


# --- two sides --------------------------------------------------------------------------------------------------------


@query("merkle_delta", """WITH l AS (SELECT c_custkey AS k, c_mktsegment AS h FROM customer WHERE c_custkey % 7 <> 0), r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 11 = 0 THEN 'old' ELSE c_mktsegment END AS h FROM customer WHERE c_custkey % 13 <> 0)
SELECT 'send' AS op, l.k AS c_custkey FROM l LEFT JOIN r ON l.k = r.k WHERE r.k IS NULL OR l.h IS DISTINCT FROM r.h UNION ALL SELECT 'remove', k FROM r WHERE k NOT IN (SELECT k FROM l)""", graph=False)
def _(t):
    rows = t.customer.select("c_custkey", F.col("c_mktsegment").alias("content_hash"))
    remote = rows.where("c_custkey % 13 <> 0").withColumn("content_hash", F.when(F.col("c_custkey") % 11 == 0, "old").otherwise(F.col("content_hash")))
    send, remove, _ = merkle.delta(rows.where("c_custkey % 7 <> 0"), remote, ["c_custkey"])
    return send.select(F.lit("send").alias("op"), "c_custkey").unionByName(remove.select(F.lit("remove").alias("op"), "c_custkey"))


# --- the graph at any commit ------------------------------------------------------------------------------------------

REPLAY = """WITH c AS (SELECT *, row_number() OVER (ORDER BY ts, 'c' || event_id) AS seq FROM events), d AS (SELECT max(seq) AS seq FROM c GROUP BY date_trunc('day', ts)),
v AS (SELECT 'node' AS kind, CAST(user_id AS VARCHAR) AS key, seq, event_type = 'error' AS gone FROM c UNION ALL SELECT 'edge', user_id || '>' || event_type, seq, event_id % 4 = 0 FROM c),
s AS (SELECT kind, d.seq, key, arg_max(gone, v.seq) AS gone FROM d JOIN v ON v.seq <= d.seq GROUP BY kind, d.seq, key)
SELECT kind, CAST(seq AS BIGINT) AS seq, count(*) AS n FROM s WHERE NOT gone GROUP BY kind, seq"""


@query("graph_at_commits", REPLAY, graph=False)
def _(t):
    """Nodes and edges that are there at the last commit of each day."""
    hash_ = F.concat(F.lit("c"), F.col("event_id").cast("string"))
    commits = history.numbered(t.events.select(hash_.alias("hash"), "ts"))
    rows = t.events.withColumn("hash", hash_).join(commits.select("hash", "seq"), "hash")
    gone = lambda c: F.when(c, "deleted").otherwise("modified").alias("status")
    nodes = rows.select(F.lit("node").alias("kind"), F.col("user_id").cast("string").alias("key"), "seq", gone(F.col("event_type") == "error"), F.col("event_type").alias("value"))
    edges = rows.select(F.lit("edge").alias("kind"), F.concat(F.col("user_id").cast("string"), F.lit(">"), "event_type").alias("key"), "seq", gone(F.col("event_id") % 4 == 0), F.lit("").alias("value"))
    spans = history.intervals(nodes.unionByName(edges), ["kind", "key"], ["value"])
    days = commits.groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.max("seq").alias("seq"))
    return history.at_commits(spans, days).groupBy("kind", "seq").agg(F.count("*").alias("n"))


# --- similar entries --------------------------------------------------------------------------------------------------


@query("similar_classes", PAIRS + """, c AS (SELECT user_id, day, entry, min(entry) OVER (PARTITION BY user_id, day, list_sort(list_distinct(w))) AS class_id FROM s WHERE len(w) > 0),
k AS (SELECT user_id, day, class_id, count(*) AS n_members FROM c GROUP BY ALL),
l AS (SELECT j.user_id, j.day, a, b FROM j JOIN k x ON x.user_id = j.user_id AND x.day = j.day AND x.class_id = a JOIN k y ON y.user_id = j.user_id AND y.day = j.day AND y.class_id = b WHERE similarity > 0.4),
n AS (SELECT user_id, day, class_id, count(*) AS n_links FROM (SELECT user_id, day, a AS class_id FROM l UNION ALL SELECT user_id, day, b FROM l) GROUP BY ALL)
SELECT user_id, day, entry, class_id, n_members, coalesce(n_links, 0) AS n_links FROM c JOIN k USING (user_id, day, class_id) LEFT JOIN n USING (user_id, day, class_id)""", graph=False)
def _(t):
    _, members, _ = memory.similar_classes(_evidence(t), 0.4, ["user_id", "day"])
    return members.select("user_id", "day", "entry", "class_id", "n_members", "n_links")


# --- branches of walks --------------------------------------------------------------------------------------------------


@query("field_flow_of_one_field", FLOW_WALK.replace("FROM flows)", "FROM flows WHERE field_path = 'f1' OR field_path IS NULL)") + "SELECT field_path, depth, from_id, to_id, mutation_type, mutation_type IS NOT NULL AS mutates FROM hops")
def _(t):
    """Hops over edges of one field or of none."""
    return analyze.field_flow_hops(_flow_seeds(t), g.flows(t), "f1").select("field_path", "depth", "from_id", "to_id", "mutation_type", "mutates")
