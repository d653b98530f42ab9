"""Each stage of the pipeline on nulls, empty and long texts, repeated rows and ids, empty tables and clashing column names."""

import pytest

pytest.importorskip("shoebox.llm.queries")
pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"
CLASHES = ["_body", "pu_score", "places", "row", "_row", "_text", "rest", "c", "c0", "score", "class", "at", "key", "total", "a`b.c", "component_id", "first"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    whole = docs.where("doc_id < 40").unionByName(docs.where("doc_id = 3")).unionByName(docs.where("doc_id = 5").selectExpr("cast(null as bigint) doc_id", "text", "lang", "source", "n_chars"))
    odd = spark.createDataFrame([(900, None, None, None, None), (901, "", "en", "s", 0), (902, "word " * 60_000, "en", "s", 300_000), (903, " \n", None, "s", 2), (7, "another text that has the id seven as well", "en", "s", 42)], docs.schema)
    every = whole.unionByName(odd).selectExpr("*", *[f"concat('{i}-', doc_id) as `{c.replace('`', '``')}`" for i, c in enumerate(CLASHES)])
    every.repartition(3).write.parquet(str(top / "d.parquet"))
    every.limit(0).write.parquet(str(top / "none.parquet"))
    return spark.read.parquet(str(top / "d.parquet")), spark.read.parquet(str(top / "none.parquet"))


@pytest.mark.parametrize("stage", [s for s, _ in pipeline.STAGES])
def test_stage(spark, tables, stage):
    docs, none = tables
    run = dict(pipeline.STAGES)[stage]
    out = run(spark, docs, SF)
    rows = out.collect()
    if stage == "packing":
        assert sum(r.length for r in rows if r.doc_id == 900) == 1 and {r.doc_id for r in rows} >= {901, 902, 903, None}
        assert run(spark, none, SF).count() == 0
        return
    assert out.schema == docs.schema and rows
    for r in rows:  # what came in with a row stays with it
        assert all(r[c] == (None if r.doc_id is None else f"{i}-{r.doc_id}") for i, c in enumerate(CLASHES))
    ids = [r.doc_id for r in rows]
    if stage == "n-gram Jaccard join":
        assert ids.count(3) == 1 and ids.count(7) == 2 and None not in ids and {900, 901, 902, 903} <= set(ids)
    if stage == "substring dedup":
        assert 902 not in ids and {900, 901, 903} <= set(ids) and len([i for i in ids if i == 3]) in (0, 2)
    if stage == "benchmark decontamination":
        assert {900, 901, 902, 903} <= set(ids) and ids.count(3) in (0, 2)
    assert run(spark, none, SF).collect() == []
