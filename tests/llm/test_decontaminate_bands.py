"""A short item beside a long one keeps to its own band."""

import numpy as np

from trackgeo.llm import decontaminate


def test_neighbouring_occurrences_of_a_short_item_beside_a_long_item(spark):
    rng = np.random.default_rng(12)
    short, long = ("".join(rng.choice(list("abcdefghijkl"), n)) for n in (60, 400))
    edited = short[:15] + "Z" + short[16:40] + "Z" + short[41:]
    df = spark.createDataFrame([(1, edited + short), (2, long)], "doc_id bigint, text string").coalesce(1)
    items = [(0, short), (1, long)]
    for used in (items[:1], items):
        got = decontaminate.find_items(df, spark.createDataFrame(used, "item_id bigint, text string")).collect()
        assert sorted((r.start, r.end, r.edits) for r in got if r.item_id == 0) == [(0, 60, 2), (60, 120, 0)]
    assert [(r.doc_id, r.edits) for r in got if r.item_id == 1] == [(2, 0)]
