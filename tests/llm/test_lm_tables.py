"""LM scoring: empty tables, no training rows, bands of counts, and the numbers that training and scores are taken from."""

import math
import zlib
from collections import Counter

import numpy as np

from trackgeo.llm import gru

DDL = "doc_id bigint, text string, score string, _row int"


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def test_empty_table(spark):
    assert gru.score_texts(spark.createDataFrame([], DDL)).collect() == []


def test_without_training_rows(spark):
    ids = [i for i in range(40) if held(i)]
    rows = [(i, "one two two", "x", 1) for i in ids] + [(ids[0], None, None, None), (ids[0], " \t", None, None)]
    got = gru.score_texts(spark.createDataFrame(rows, DDL)).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows) and len(ids) > 2
    assert all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 and math.isfinite(r.score) for r in got)
    assert sorted(r.n_tokens for r in got) == [1, 1] + [4] * len(ids)


def test_frequent_words_keep_whole_bands(spark, monkeypatch):
    monkeypatch.setattr(gru, "KNOWN", 3)
    counts = [(b"a", 9), (b"b", 7), (b"c", 5), (b"d", 5), (b"e", 1), (gru.END, 2)]
    table = spark.createDataFrame([(bytearray(w), c) for w, c in counts], "word binary, c bigint")
    assert gru.frequent_words(table) == {b"a": 9, b"b": 7, gru.END: 2}  # both words counted five times would be four
    monkeypatch.setattr(gru, "KNOWN", 4)
    assert list(gru.frequent_words(table)) == [b"a", b"b", b"c", b"d", gru.END]


def test_encoded_texts_spell_their_words(spark, monkeypatch):
    """Across batches: numbers of known words, tail classes and rare words with their times, against plain counts."""
    monkeypatch.setattr(gru, "ENCODE_TOKENS", 7)
    known = {b"aa": 5, b"bb": 3, gru.END: 0}
    rows = [(1, "aa BB zz zz\x1cq aa"), (2, None), (3, "zz yy\nzz"), (3, "zz yy\nzz"), (None, "aa"), (4, "aa " * 3000 + "é")]
    source = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got = {}
    for r in gru.encode(source, known, np.array([True, False, True])).collect():
        got.setdefault(r.doc_id, []).append(r)
    numbers = {w: i for i, w in enumerate(known)}
    for i, text in rows:
        words = gru.tokens_of(text)
        ids = [numbers.get(w, 65_535 - gru.tail_class(w)) for w in words]
        rare = Counter(w for w in words if w not in known)
        for r in got[i]:
            assert np.frombuffer(r.ids, "<u2").tolist() == ids and r.n_tokens == len(words)
            assert Counter({bytes(e["word"]): e["n"] for e in r.rare}) == rare
            assert r.known == sum(known.get(w, 0) > 0 for w in words)
            assert math.isclose(r.logs, sum(math.log(known.get(w, 0) + 1) for w in words), abs_tol=1e-9)
            assert math.isclose(r.tail_logs, sum(math.log(4) for w in words if w == b"bb"), abs_tol=1e-9)
    assert sum(map(len, got.values())) == len(rows)
