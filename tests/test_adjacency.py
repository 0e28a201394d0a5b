import re

import pytest
from pyspark.sql import functions as F

from graphloom.operators import adjacency, traverse
from graphloom.storage import new_folder


@pytest.fixture(scope="module")
def edges(spark):
    rows = [("calls", f"n{k}", f"n{(k * 7 + j) % 200}", f"s{j}") for k in range(200) for j in range(3)]
    rows += [("calls", f"n{k}", "hub", "h") for k in range(150)] + [("calls", "hub", f"n{k}", "g") for k in range(0, 200, 5)]
    rows += [("tests", f"t{k}", f"n{k}", None) for k in range(20)] + [("calls", None, "n1", "x"), ("calls", "n1", None, "x"), ("calls", "n1", "n7", "s0")]
    return spark.createDataFrame([(*r, 1) for r in rows], "label string, from_id string, to_id string, call_site string, src int")


def rows(frame):
    return sorted(map(tuple, frame.select("seed_id", "node_id", "hop", "parent_id", "label", "call_site").collect()), key=str)


@pytest.mark.parametrize("sent", [0, 200_000])
def test_stored_edges_give_what_a_frame_of_them_gives(spark, edges, monkeypatch, sent):
    monkeypatch.setattr(adjacency, "HUB_EDGES", 30)
    monkeypatch.setattr(adjacency, "MOST_HUBS", 20)
    monkeypatch.setattr(adjacency, "SENT_FRONTIER", sent)
    stored = adjacency.save(edges, new_folder(spark), buckets=4)
    assert {r.to_id for r in spark.read.parquet(f"{stored.path}/hubs/to_id").collect()} == {"hub"}
    seeds = spark.createDataFrame([("a", "n3"), ("a", "n4"), ("b", "hub"), ("c", "nowhere")], "seed_id string, node_id string")
    for direction, labels, depth in (("forward", ["calls"], 2), ("reverse", ["calls", "tests"], 4), ("both", ["calls"], 3)):
        assert rows(traverse.traverse(seeds, stored, labels, direction, depth)) == rows(traverse.traverse(seeds, edges, labels, direction, depth))
    again = adjacency.load(spark, stored.path)
    assert rows(traverse.traverse(seeds, again, ["calls"], "reverse", 3)) == rows(traverse.traverse(seeds, edges, ["calls"], "reverse", 3))
    again.drop()


def moved(plan: str) -> list[str]:
    """Exchanges with a scan of an adjacency below them and no other exchange between."""
    lines, found = [x for x in plan.splitlines() if x.strip()], []
    for i, line in enumerate(lines):
        if "adjacency_" in line and "Scan" in line:
            depth = len(re.match(r"[\\s:+*-]*", line)[0])
            for up in reversed(lines[:i]):
                indent = len(re.match(r"[\\s:+*-]*", up)[0])
                if indent < depth:
                    depth = indent
                    if "Join" in up:
                        break
                    if "Exchange" in up:
                        found.append(up)
                        break
    return found


def test_no_step_moves_the_edges(spark, edges):
    stored = adjacency.save(edges, new_folder(spark), buckets=4)
    ahead = edges.selectExpr("from_id as src", "from_id as seed_id").distinct()
    for count in (None, 10):
        plan = stored.step(ahead, "reverse", ["calls"], count)._jdf.queryExecution().executedPlan().toString()
        assert "adjacency_to_id" in plan and moved(plan) == [], plan
    # what the same step over a frame does
    assert "Exchange hashpartitioning(src" in traverse.oriented(edges, "reverse").join(ahead.hint("shuffle_merge"), "src")._jdf.queryExecution().executedPlan().toString()


def test_edges_to_store_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def end(k):
        made.add(1)
        return f"b{k % 7}"

    edges = spark.range(200).select(F.lit("calls").alias("label"), F.concat(F.lit("a"), "id").alias("from_id"), end("id").alias("to_id"))
    stored = adjacency.save(edges, f"{tmp_path}/once")
    assert made.value <= 400  # an id is read for the filter and the row, at most
    assert stored.step(spark.createDataFrame([("b3",)], "src string"), "reverse", ["calls"]).count() == 29
    stored.drop()
