"""The keep functions where ids are null or shared: a row goes only for its own text."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliant.llm import exact_dedup, near_dedup, quality

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def _text(rng):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    t = [_text(rng) for _ in range(12)]
    near = t[0] + " more", t[3] + " more"  # near one null-id row each
    return [*((None, x) for x in t[:4]), (None, t[1]), *((7, x) for x in t[4:8]), (7, t[4]), (8, t[8]), (9, t[9]), (10, near[0]), (11, near[1])]


def test_exact_keeps_every_text(spark, rows):
    got = [tuple(r) for r in exact_dedup.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert Counter(got) == Counter(set(rows))


def test_near_keeps_every_text(spark, rows):
    got = Counter(tuple(r) for r in near_dedup.keep_one(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == Counter(x for x in set(rows) if x[0] not in (10, 11))  # null is the least id


def test_near_groups_do_not_link_null_ids(spark, rows):
    got = near_dedup.near_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    none = Counter((r.n_copies, r.n_links) for r in got if r.doc_id is None)
    assert none == Counter({(1, 1): 2, (2, 0): 2, (1, 0): 1})
    assert {r.class_id for r in got if r.doc_id in (8, 9)} == {8, 9} and {r.class_id for r in got if r.doc_id == 7} == {7}


def test_quality_judges_every_row(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    scored = {r.doc_id: r.predicted for r in quality.score_documents(docs, labels).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {t for d, t in texts.items() if scored[d]}
    assert 0 < len(good) < len(set(texts.values()))
    more = docs.select(F.lit(None).cast("long").alias("doc_id"), "text").union(docs.select(F.lit(10**9).cast("long"), "text"))
    got = quality.keep_good(docs.union(more), labels).collect()
    for odd in (None, 10**9):
        assert Counter(r.text for r in got if r.doc_id == odd) == Counter(t for t in texts.values() if t in good)
    assert Counter(r.doc_id for r in got if r.doc_id not in (None, 10**9)) == Counter(d for d in texts if scored[d])
