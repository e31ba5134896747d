"""The pipeline against its stages done by hand on the smallest tables."""

import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from foliant.llm import near_dedup, quality, secrets

DATA = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))
    good = {r.doc_id for r in quality.score_documents(docs, labels).where("predicted = 1").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    first: dict[str, int] = {}
    for d, t in sorted(texts.items(), key=lambda x: (-len(x[1]), x[0])):
        first.setdefault(re.sub("[\x20\x09-\x0d]", "", t), d)
    bags, parent = {d: near_dedup.shingles(texts[d]) for d in first.values()}, {}
    for d in sorted(bags):
        parent[d] = d
        for e in sorted(parent):
            if e < d and near_dedup.overlap(bags[d], bags[e]) >= 0.8:
                a, b = parent[d], parent[e]
                for k, v in parent.items():
                    if v in (a, b):
                        parent[k] = min(a, b)
    kept = {d for d, p in parent.items() if d == p}
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = {d: len(t.encode(secrets.mask(texts[d]), add_special_tokens=False).ids) + 1 for d in kept}
    got: dict[int, int] = {}
    rows = corpus_pipeline.run(spark, DATA).collect()
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == lengths and len(kept) < docs.count()
    fill = np.bincount([r.sequence_id for r in rows], weights=[r.length for r in rows])
    assert fill.max() <= 2048 and len(fill) <= -(-sum(lengths.values()) // 2048) + 1


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns
        assert stage(spark, docs.limit(0), DATA).count() == 0
