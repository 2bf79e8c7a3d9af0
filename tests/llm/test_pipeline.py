import re
from collections import Counter

import corpus_pipeline
from .test_exact_dedup import expected as exact_verdicts
from .test_near_dup import brute
from vakanz.llm import quality_rules
from vakanz.llm.common import stage


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, []
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = stage(step(spark, docs, sf_dir))
        assert out.columns == columns, name
        kept.append((docs, out))
        docs = out
    (raw, good), (_, single), (_, distinct), (_, mix) = kept
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")
    assert ids(good) == sorted(r[0] for r in quality_rules.judge(raw, trusted).filter("kept").select("row.doc_id").collect())
    rows = [tuple(r) for r in good.select("doc_id", "text", "lang", "source").collect()]
    assert ids(single) == sorted(r[0] for r in exact_verdicts(rows) if r[3])
    rows = [tuple(r) for r in single.select("doc_id", "text").collect()]
    assert ids(distinct) == sorted(r[0] for r in brute(rows, 5) if r[3])
    assert max(Counter(ids(mix)).values()) <= 3 and set(ids(mix)) <= set(ids(distinct))
    bins = corpus_pipeline.STAGES[-1][1](spark, mix, sf_dir).collect()
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    assert sum(r["n_words"] for r in bins) == sum(len(words(r["text"])) for r in mix.collect())
    assert all(r["n_words"] <= 2048 and len(r["doc_ids"]) == len(set(r["doc_ids"])) for r in bins)


def test_run_is_the_stages(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["bin", "doc_ids", "n_words", "text"]
