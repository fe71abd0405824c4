"""The pipeline stage by stage."""

from collections import Counter

import brute

import corpus_pipeline
from hearthline.llm import mixing, toxicity


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = Counter(r.doc_id for r in docs.collect())
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "jaccard", "decontaminate", "mixing", "tokens"]
    clean = corpus_pipeline.written(stages["toxicity"](spark, docs, sf), "t")
    net = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in toxicity.score(docs, net).filter("predicted = 0").collect()}
    one = corpus_pipeline.written(stages["jaccard"](spark, clean, sf), "j")
    want = brute.jaccard_components([(r.doc_id, r.text) for r in clean.collect()])
    assert Counter(r.doc_id for r in one.collect()) == Counter(d for d, (_, c) in want.items() if d == c)
    left = corpus_pipeline.written(stages["decontaminate"](spark, one, sf), "d")
    items = [brute.WORD.findall(r.text.lower()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {r.doc_id: " " + " ".join(brute.WORD.findall(r.text.lower())) + " " for r in one.collect()}
    leaked = {d for d, t in texts.items() if any(" " + " ".join(i) + " " in t for i in items)}
    kept = {r.doc_id for r in left.collect()}
    assert not leaked & kept and len(texts) - len(kept) < 3 * len(leaked) + 5
    mixed = corpus_pipeline.written(stages["mixing"](spark, left, sf), "m")
    assert all(x.columns == docs.columns for x in (clean, one, left, mixed)) and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 2 and set(first) >= kept
    out = stages["tokens"](spark, mixed, sf).collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in mixed.collect())


def test_stages_on_odd_tables(spark, sf, odd, none):
    """Own columns stay as they are, nulls, empty and long texts and repeated rows have their defined result, and no rows give none."""
    from pyspark.sql import functions as F

    odd = odd.withColumn("taken", F.lit(777)).withColumn("source_size", F.col("doc_id") * 3)
    none = odd.filter("false")
    for name, stage in corpus_pipeline.STAGES:
        assert corpus_pipeline.written(stage(spark, none, sf), name).count() == 0
        rows = stage(spark, odd, sf).collect()
        if name == "tokens":
            assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd.collect())
            continue
        assert all(r.asDict().keys() == dict.fromkeys(odd.columns).keys() for r in rows)
        assert all(r["size"] == "x" and r.taken == 777 and r.source_size == (None if r.doc_id is None else 3 * r.doc_id) for r in rows)
        if name in ("toxicity", "decontaminate"):
            assert {r.doc_id for r in rows} >= {None, 2, 3, 4, 5, 6, 7, 8} and sum(r.doc_id == 1 for r in rows) == 2
        if name == "jaccard":
            assert Counter(r.doc_id for r in rows) == Counter([1, 2, None, None, 3, 4, 5, 7, 9])
        if name == "mixing":
            want = Counter()
            for r in mixing.mix(odd).collect():
                want[r.doc_id] += r.copies
            assert Counter(r.doc_id for r in rows) == +want
