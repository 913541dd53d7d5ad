"""The pipeline's stages, each against what its operator says of the rows it got."""

import math
import re

import duckdb
from test_dedup import classes, fingerprint
from test_packing import check

import corpus_pipeline
from skylode.llm import quality_rules, toxicity
from skylode.llm.oracle import QUALITY_CTES


def test_stages(spark, documents, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs, kept = documents, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir).cache()
        assert after.columns == documents.columns
        before_ids, after_ids = ({r["doc_id"] for r in d.select("doc_id").collect()} for d in (docs, after))
        if name == "toxicity":
            gone = toxicity.score(docs, toxicity.train(docs, labels)).filter("toxic").select("doc_id").collect()
            assert before_ids - after_ids == {r[0] for r in gone}
        elif name == "quality_rules":
            assert after_ids == {r["doc_id"] for r in quality_rules.judge(docs, labels).filter("kept").collect()}
        else:
            own = {r["doc_id"]: fingerprint(r["text"]) for r in docs.collect()}
            roots = classes(set(own.values()))
            least = {}
            for i, f in own.items():
                least[roots[f]] = min(i, least.get(roots[f], i))
            assert after_ids == set(least.values())
        assert after.count() == len(after_ids)
        docs, kept[name] = after, after_ids
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    check(packed, docs, 2048)
    whole = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in whole.collect()} == kept["simhash_near_dedup"]


def test_toxicity_stage_by_hand(spark, documents, sf_dir):
    """The stage's rows from the learned weights and thresholds alone, in plain Python."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(documents, labels)
    kept = set()
    for i, text in documents.select("doc_id", "text").collect():
        words = {w for w in re.findall(r"[^\W_]+", (text or "").lower()) if w in model.weights}
        x = sum(model.weights[w] for w in words)
        if not words or sum(1 / (1 + math.exp(t - x)) for t in model.thresholds) < toxicity.REJECT:
            kept.add(i)
    assert {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, documents, sf_dir).collect()} == kept


def test_quality_stage_by_sql(spark, documents, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    con.execute(f"CREATE VIEW labels AS SELECT * FROM '{sf_dir}/labels.parquet'")
    kept = con.execute(f"WITH d AS (SELECT * FROM documents), {QUALITY_CTES} SELECT doc_id FROM q_judged WHERE kept").fetchall()
    assert {r["doc_id"] for r in corpus_pipeline.drop_low_quality(spark, documents, sf_dir).collect()} == {i for (i,) in kept}


def test_messy_rows_pass(spark, messy, empty, sf_dir):
    for docs in (messy, empty):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
        docs.collect()
