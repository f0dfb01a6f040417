"""The pipeline's stages against brute force on a small fixture."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from monthgrid.llm import registry

WORDS = [a + b for a in "ba de fi go lu ma ne po ri su ta ve".split() for b in "l n r s t".split()]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(5)
    folder = tmp_path_factory.mktemp("sf")
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows, labels = [], []
    for k in range(300):
        toxic = k % 6 == 0
        rows.append([k, say(40) + (" vileword scumword" if toxic else ""), "en", f"s{k % 2}", 0])
        labels.append((k, 0, int(toxic)))
    item = say(25)
    rows[7][1] += " " + item
    rows[9][1] = rows[8][1]
    rows[11][1] = rows[13][1] + " oneword"
    for r in rows[1::2]:
        r[1] = "Shared banner line\n" + r[1]
    rows.append([400, None, None, None, None])
    for r in rows:
        r[4] = len(r[1]) if r[1] is not None else None
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = corpus_pipeline.toxicity_filter(spark, docs, sf)
    ids = lambda df: {r.doc_id for r in df.collect()}
    assert ids(docs) - ids(first) == {k for k in range(300) if k % 6 == 0} and first.columns == docs.columns
    second = corpus_pipeline.line_dedup(spark, first, sf)
    got = {r.doc_id: r for r in second.collect()}
    assert second.dtypes == docs.dtypes and set(got) == ids(first)
    assert not any("banner" in (r.text or "") for r in got.values()) and all(r.n_chars == (len(r.text) if r.text is not None else None) for r in got.values())
    third = corpus_pipeline.jaccard_dedup(spark, second, sf)
    assert ids(second) - ids(third) == {9, 13}
    fourth = corpus_pipeline.decontamination(spark, third, sf)
    assert ids(third) - ids(fourth) == {7} and fourth.columns == docs.columns
    last = {r.doc_id: r for r in corpus_pipeline.sentencepiece_ids(spark, fourth, sf).collect()}
    assert set(last) == ids(fourth) and all(r.exact for r in last.values()) and last[400].ids is None and len(last[8].ids) == last[8].n_pieces > 10


def test_run_is_its_stages(spark, sf):
    whole = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert whole == {r.doc_id: r.ids for r in docs.collect()}
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_long_and_repeated_rows(spark, sf):
    rng = random.Random(6)
    long = " ".join(rng.choice(WORDS) for _ in range(120_000))
    extra = [(500, long, "en", "s9", len(long)), (501, "a" * 300_000, "en", "s9", 300_000)] + [(502, "one two three four five six seven", "en", "s9", 32)] * 3 + [(None, "nine eight seven six five four", None, None, None)] * 2
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).repartition(3)
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        docs.write.parquet(f"{sf}/long-{name}")
        docs = spark.read.parquet(f"{sf}/long-{name}")
        counts.append(docs.filter("doc_id = 502").count())
    assert counts == [3, 3, 1, 1, 1]  # rows of one document and text are near-duplicates of one another
    got = {r.doc_id: r for r in docs.filter("doc_id >= 500 or doc_id is null").collect()}
    assert set(got) == {500, 501, 502, None} and all(r.exact for r in got.values()) and got[500].n_pieces > 120_000


def test_run_leaves_its_last_documents_only(spark, sf):
    import os

    from monthgrid.session import shared_dir

    there = lambda: {n for n in os.listdir(shared_dir(spark)) if n != "lost+found"}
    before = there()
    assert corpus_pipeline.run(spark, sf).count() > 0
    left = there() - before
    assert [n.split("-")[0] for n in left] == ["pipeline"] and len(os.listdir(f"{shared_dir(spark)}/{left.pop()}")) == 1


def test_one_query_for_each_operator():
    names = sorted(n.split("_")[0] for n in registry.QUERIES if n.startswith("op"))
    assert names == sorted(f"op{k}" for k in range(1, 14)) and "pipeline" in registry.QUERIES
