import corpus_pipeline
from llm_cases import odd_docs

import __spark_entry__ as entry
from larkseek.llm import decontaminate, packing, quality, simhash, toxicity
from larkseek.llm.common import table
from tools.check import compare, connect


def test_stages_match_their_operators(spark, sf):
    """Each stage, on its own input, against the report of its operator."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    stages = dict(corpus_pipeline.STAGES)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "toxicity", "near_dedup", "decontamination", "packing"]
    rows = quality.features(docs, labels)
    keep = {r["doc_id"] for r in quality.score_documents(rows, quality.co_train(rows)).collect() if r["keep"]}
    first = stages["quality"](spark, docs, sf).cache()
    assert first.columns == docs.columns and {r["doc_id"] for r in first.select("doc_id").collect()} == keep
    scored = toxicity.score_documents(first, toxicity.fit(first, labels))
    clean = {r["doc_id"] for r in scored.collect() if not r["predicted"]}
    second = stages["toxicity"](spark, first, sf).cache()
    assert second.columns == docs.columns and {r["doc_id"] for r in second.select("doc_id").collect()} == clean
    groups = simhash.near_duplicates(second).collect()
    third = stages["near_dedup"](spark, second, sf).cache()
    assert sorted(r["doc_id"] for r in third.select("doc_id").collect()) == sorted({r["component_id"] for r in groups})
    report = decontaminate.report(third, table(spark, sf, "benchmark")).collect()
    fourth = stages["decontamination"](spark, third, sf).cache()
    assert sorted(r["doc_id"] for r in fourth.select("doc_id").collect()) == sorted(r["doc_id"] for r in report if not r["contaminated"])
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, stages["packing"](spark, fourth, sf).select(key).collect())) == sorted(map(tuple, packing.pack(fourth).select(key).collect()))


def test_run_takes_odd_rows(spark, tmp_path):
    odd_docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} >= {None, 1, 6, 7, 8}


def test_registered_queries_and_their_twins(spark, sf):
    from larkseek.llm.queries import ORACLES, QUERIES
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES if q.startswith("op")} and "pipeline" in QUERIES
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    con = connect(sf)
    for name, sql in ORACLES.items():
        ok, info = compare(spark, con, sf, name, QUERIES[name], sql)
        assert ok, (name, info)
