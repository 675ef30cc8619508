"""Repeated ids, clashing column names and empty tables in the operators and in every stage of the pipeline."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from trackgeo.llm import packing, quality, queries, similar_sets, url_filters
from trackgeo.session import checkpoint_dir, fresh_name

A = " ".join(f"alpha{i}" for i in range(60))
B = " ".join(f"beta{i}" for i in range(60))
ITEM = " ".join(f"question{i} and answer" for i in range(12))
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def folder(spark):
    path = f"{checkpoint_dir(spark)}/{fresh_name()}"  # not in the folder of a stage, which the next stage removes
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(1, 60)]
    texts = [(i, ("vile slur hate " * 6 if i % 5 == 0 else "calm kind words ") + f"text{i} " * 12) for i in range(1, 60)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], DOCS).write.parquet(f"{path}/documents.parquet")
    return path


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).repartition(3)


def test_a_repeated_id_keeps_its_unlike_text(spark, folder):
    import corpus_pipeline as p

    rows = [(1, A), (5, A), (5, B), (7, B + " tail"), (None, A), (8, None), (9, ""), (5, B)]
    kept = sorted(((r.doc_id, r.text) for r in p.drop_near_copies(spark, docs_of(spark, rows), folder).collect()), key=str)
    assert kept == sorted([(1, A), (5, B), (5, B), (None, A), (8, None)], key=str)
    held = "x " + ITEM + " y"
    rows = [(5, held), (5, B), (None, held), (None, B), (6, None), (6, "")]
    kept = sorted(((r.doc_id, r.text) for r in p.drop_benchmark(spark, docs_of(spark, rows), folder).collect()), key=str)
    assert kept == sorted([(5, B), (None, B), (6, None), (6, "")], key=str)
    rows = [(1, A), (2, A + " end"), (2, B), (None, A), (3, None)]
    cut = sorted(((r.doc_id, r.text) for r in p.cut_repeats(spark, docs_of(spark, rows), folder).collect()), key=str)
    assert cut == sorted([(1, A), (2, "end"), (2, B), (None, A), (3, None)], key=str)
    packed = p.pack_sequences(spark, docs_of(spark, rows), folder).collect()
    assert sorted(r.doc_id is None for r in packed) == [False] * 4 + [True]
    toxic = p.drop_toxic(spark, docs_of(spark, [(5, A), (5, A), (6, None), (None, B)]), folder).collect()
    assert len(toxic) >= 2 and all(r.text in (A, B, None) for r in toxic)


def test_empty_tables_in_every_stage(spark, folder):
    import corpus_pipeline as p

    none = docs_of(spark, [(1, A)]).limit(0)
    for name, stage in p.STAGES:
        assert stage(spark, none, folder).count() == 0, name


def test_survivors_of_components(spark):
    rows = [(4, A), (2, A + " x"), (2, B), (3, B), (None, B)]
    got = sorted(((r.doc_id, r.component_id, r.stays) for r in similar_sets.near_duplicates(docs_of(spark, rows)).collect()), key=str)
    assert got == sorted([(4, 2, False), (2, 2, True), (2, 2, True), (3, 2, False), (None, 2, True)], key=str)


NAMES = ["_words", "_lines", "_sorted", "_at", "_n", "_size", "_grams", "_sum", "_ratios", "_in", "_text", "_id", "_trusted"]


def test_quality_keeps_clashing_columns(spark):
    docs = docs_of(spark, [(1, A), (2, B), (3, None)]).withColumns({n: F.lit(n) for n in NAMES})
    trusted = spark.createDataFrame([(1,)], "doc_id bigint")
    got = quality.judge_quality(docs, trusted).collect()
    plain = {r.doc_id: r for r in quality.judge_quality(docs.select("doc_id", "text"), trusted).collect()}
    assert len(got) == 3 and all(r[n] == n for r in got for n in NAMES)
    assert all(r[c] == plain[r.doc_id][c] for r in got for c in quality.RESULTS)


def test_url_filters_keep_clashing_columns(spark):
    names = ["best", "_bh", "_bp", "of_host", "of_path", "won", "h_", "p_", "digest", "short"]
    pages = spark.createDataFrame([(1, "http://a.net/x")], "page_id bigint, url string").withColumns({n: F.lit(n) for n in names})
    rules = spark.createDataFrame(queries.RULES, "host string, path string, verdict string")
    row = url_filters.filter_urls(pages, rules).collect()[0]
    assert (row.host, row.path, row["rule"], row.verdict) == ("a.net", "/x", "net/", "block") and all(row[n] == n for n in names)
    long = spark.createDataFrame([(2, "http://" + "sub." * 4000 + "net/" + "p" * 60_000)], "page_id bigint, url string")
    assert url_filters.filter_urls(long, rules).collect()[0]["rule"] == "net/"


def test_packing_keeps_clashing_columns(spark):
    names = ["_rank", "_row", "_chunk", "_nth", "_before", "rank", "row", "chunk", "nth", "before", "piece", "n"]
    pieces = spark.createDataFrame([(i, 100 + i) for i in range(40)], "doc_id bigint, length int").withColumns({n: F.lit(n) for n in names})
    got = packing.pack(pieces).collect()
    assert len(got) == 40 and all(r[n] == n for r in got for n in names) and sorted(r.length for r in got) == list(range(100, 140))
