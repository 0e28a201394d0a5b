import corpus_pipeline
from graphloom.llm import decontaminate, pieces
from graphloom.llm.simhash import shingle_hashes

SF = "/root/testdata/sf0.001"


def test_stages_on_the_smallest_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    sizes = [docs.count()]
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, before, SF)
        assert docs.columns[: len(names)] == names or name == "sentencepiece"
        docs = corpus_pipeline.materialise(docs)
        sizes.append(docs.count())
        if name == "near_duplicates":
            check_near_duplicates({r.doc_id: r.text for r in before.collect()}, {r.doc_id for r in docs.collect()})
        if name == "decontamination":
            windows = decontaminate.load_windows(spark.read.parquet(f"{SF}/benchmark.parquet"))
            assert not decontaminate.scan_documents(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count()
            assert len(windows.items) > 0
        before = docs
    assert sizes[0] >= sizes[1] >= sizes[2] > sizes[3] == sizes[4] == sizes[5]
    rows = before.collect()
    assert all(r.round_trip for r in rows)
    model = pieces.pieces(pieces.default_model())
    assert all(list(r.token_ids) == model.sp.encode(r.text) for r in rows[:50])


def check_near_duplicates(texts, kept):
    """Exact comparison of all shingle sets: of each group of similar texts just the one with the smallest id stays."""
    sets = {i: set(shingle_hashes(t, 5).tolist()) for i, t in texts.items()}
    ids, least = sorted(sets), {i: i for i in sets}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if texts[a] == texts[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                least[max(p, q)] = min(p, q)
    assert kept == {find(i) for i in ids}


def test_stages_on_empty_input(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, SF)
        assert out.columns[: len(none.columns)] == none.columns and out.collect() == [], name


def test_pipeline_on_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_on_nulls_and_repeated_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(1).selectExpr("cast(null as bigint) as doc_id", "cast(null as string) as text", "cast(null as string) as lang", "cast(null as string) as source", "cast(null as int) as n_chars")
    odd = odd.select(*(odd[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns))
    rows = docs.where("doc_id < 40").unionByName(docs.where("doc_id < 10")).unionByName(odd).unionByName(odd)
    sizes = [rows.count()]
    for _, stage in corpus_pipeline.STAGES:
        rows = corpus_pipeline.materialise(stage(spark, rows, SF))
        sizes.append(rows.count())
    assert sizes[0] == 52 and sizes == sorted(sizes, reverse=True) and sizes[-1] > 20
    assert rows.select("doc_id").distinct().count() == rows.count()
