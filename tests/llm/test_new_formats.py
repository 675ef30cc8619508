"""Token lists, bitmask codes and periodic runs against brute force, and their defined cases."""

import glob
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trackgeo.llm import bitmask_codes, byte_level, periodic_runs, queries, token_lists
from trackgeo.session import new_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
TEXTS = [
    (5, "it's  a\n test \n\n of   spaces  "), (3, None), (None, "null id"), (4, ""), (5, "it's  a\n test \n\n of   spaces  "),
    (1, "Ωμ 日本 ﬁ\x85\xa0x <|endoftext|> <|"), (2, "long " * 30_000), (5, "same id, other text"), (-7, " \t"), (9, "'s'll don’t 3½²")]


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, token_lists.END]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "x", 2) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, part int, tokens string, base int").repartition(3)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"ab1é³'! \n\t", "  ", "'s", "’", "Ω", "<|endoftext|>", "\x85", "ſ", "...", "bc"]), max_size=10).map("".join))
def test_byte_level_equals_the_tokenizer(text):
    got = np.frombuffer(byte_level_encoder()(text), np.uint32).tolist()
    assert got == TOKENIZER.encode(text, add_special_tokens=False).ids


def byte_level_encoder(held=[]):
    if not held:
        held.append(byte_level.encoder(PATH))
    return held[0]


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_lists_round_trip(spark, docs, encoding):
    path = new_path(spark)
    token_lists.write_token_lists(docs, path, PATH, encoding=encoding, file_bytes=20_000)
    rows = token_lists.read_token_lists(spark, path).orderBy("start").collect()
    assert sorted(((r.doc_id, tuple(r.tokens)) for r in rows), key=str) == sorted(((i, tuple(ids_of(t))) for i, t in TEXTS), key=str)
    assert [r.doc_id for r in rows] == sorted((i for i, _ in TEXTS), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.tokens)
        at += r.n_tokens
    whole = [t for r in rows for t in r.tokens]
    for first, last in ((0, 5), (3, 60), (20_000, 20_010), (at - 3, at + 9), (7, 7), (at, at + 5), (0, at)):
        span = token_lists.read_span(spark, path, first, last).orderBy("start").collect()
        assert [t for r in span for t in r.tokens] == whole[first:last]
    sums = {r.start: r.ids_crc32 for r in token_lists.checksums(token_lists.read_token_lists(spark, path)).collect()}
    assert all(sums[r.start] == zlib.crc32(np.array(r.tokens, "<u4").tobytes()) for r in rows)


def test_token_lists_layout(spark, docs):
    more = spark.range(20_000).selectExpr("id AS doc_id", "concat_ws(' ', 'a', id, id * 7, 'tail words here') AS text")
    for encoding, name in (("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")):
        path = new_path(spark)
        token_lists.write_token_lists(more, path, PATH, encoding=encoding, row_group_bytes=20_000, page_bytes=5_000, page_rows=500)
        file = pq.ParquetFile(sorted(glob.glob(f"{path.removeprefix('file:')}/tokens/part-*"))[0])
        columns = {file.metadata.row_group(0).column(i).path_in_schema: file.metadata.row_group(0).column(i) for i in range(5)}
        assert name in columns["tokens.list.element"].encodings
        assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
        assert file.metadata.num_row_groups > 1
        assert all(c.has_offset_index and c.has_column_index for c in columns.values())
    index = token_lists.read_index(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert all("tokens:array" not in schema for schema in re.findall(r"ReadSchema: \S+", index))  # no token is read
    plan = token_lists.read_token_lists(spark, path).filter("doc_id = 77")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,77)" in plan
    with pytest.raises(ValueError):
        token_lists.write_token_lists(docs, path, PATH, encoding="plain")


def test_token_lists_empty(spark, docs):
    path = new_path(spark)
    token_lists.write_token_lists(docs.limit(0), path, PATH)
    assert token_lists.checksums(token_lists.read_token_lists(spark, path)).count() == 0
    assert token_lists.read_span(spark, path, 0, 5).count() == 0


# --- vector codes -------------------------------------------------------------------------------------

def brute_codes(rows, parts, entries, rounds, scale=256):
    """Rows (key, vector, label) in plain Python integers."""
    good = [(k, [int(np.floor(scale * float(x))) for x in v], l) for k, v, l in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = len(good[0][1]) // parts
    firsts = {}
    for k, v, _ in sorted((g for g in good if g[0] is not None), key=lambda g: (g[0], g[1])):
        firsts.setdefault(k, v)
    books = [[v[p * width:(p + 1) * width] for v in list(firsts.values())[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p]))

    def assigned():
        return [[nearest(p, v[p * width:(p + 1) * width]) for p in range(parts)] for _, v, _ in good]

    for _ in range(rounds):
        chosen = assigned()
        for p in range(parts):
            for e in range(len(books[p])):
                members = [v[p * width:(p + 1) * width] for (_, v, _), c in zip(good, chosen) if c[p][1] == e]
                if members:
                    books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    out = [(k, "".join(f"{i:02x}" for _, i in c), sum(d for d, _ in c), l) for (k, _, l), c in zip(good, assigned())]
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 64), st.integers(1, 4), st.sampled_from([1, 3, 50, 100_000]), st.integers(0, 2**31))
def test_slices_are_exact(entries, width, spread, seed):
    rng = np.random.default_rng(seed)
    book = rng.integers(-spread, spread + 1, (entries, width))
    queries_ = np.concatenate([rng.integers(-2 * spread, 2 * spread + 1, (60, width)), book])
    number, best = bitmask_codes.Slices(book).nearest(queries_)
    away = ((queries_[:, None] - book[None]) ** 2).sum(axis=2)
    assert (number == away.argmin(axis=1)).all() and (best == away.min(axis=1)).all()


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vector_codes(spark, kind):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.2, 32)], int(rng.integers(0, 3))) for i in rng.permutation(300)]
    rows += [(7, None, 1), (301, [None] + [0.0] * 31, 1), (302, [float("nan")] * 32, 1), (303, [float("inf")] + [0.0] * 31, 1),
             (None, rows[0][1], None), (2, rows[5][1], None), rows[9], (-4, [0.0] * 32, 2), (-3, [-1 / 512] * 32, None)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], f"vec_id bigint, embedding array<{kind}>, label int, codes int, vector string")
    got, books = bitmask_codes.encode_vectors(table.repartition(5), parts=8)
    want, digest = brute_codes(rows, 8, 64, 2)
    by_label = {}
    for *_, error, label in want:
        by_label[label] = by_label.get(label, 0) + error
    assert bitmask_codes.codebooks_digest(books) == digest
    assert sorted(((r.vec_id, r.codes.hex(), r.error, r.label, r.label_error) for r in got.collect()), key=str) == sorted(
        ((*w, by_label[w[3]]) for w in want), key=str)


def test_vector_codes_small_tables(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    none, books = bitmask_codes.encode_vectors(spark.createDataFrame([], schema))
    assert none.count() == 0 and books.size == 0
    few, _ = bitmask_codes.encode_vectors(spark.createDataFrame([(1, [0.5] * 16, None), (2, [0.5] * 16, 3)], schema))
    assert {(r.vec_id, r.codes.hex(), r.error, r.label_error) for r in few.collect()} == {(1, "00" * 16, 0, 0), (2, "00" * 16, 0, 0)}
    for bad in ([[0.5] * 16, [0.5] * 32], [[0.5] * 15], [[]], [[1e30] * 16]):
        with pytest.raises(Exception, match="vectors need one length|in size"):
            bitmask_codes.encode_vectors(spark.createDataFrame([(i, v, 1) for i, v in enumerate(bad)], schema))[0].collect()


# --- periodic runs ------------------------------------------------------------------------------------

def brute_runs(words):
    n, found = len(words), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            begin = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i - begin + p >= max(24, 3 * p):
                found.setdefault((begin, i - begin + p), p)
    return sorted(((s, length, p) for (s, length), p in found.items()), key=lambda r: (r[0], r[2]))


def words_strategy():
    piece = st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.integers(1, 14)).map(lambda t: t[0] * t[1])
    return st.lists(piece, max_size=8).map(lambda parts: [w for p in parts for w in p])


@settings(max_examples=250, deadline=None)
@given(st.lists(words_strategy(), min_size=1, max_size=4))
def test_runs_equal_brute_force(texts):
    owner, start, length, period = periodic_runs.find_runs([np.array(t, np.int64) for t in texts], 4)
    got = [[] for _ in texts]
    for o, *run in zip(owner.tolist(), start.tolist(), length.tolist(), period.tolist()):
        got[o].append(tuple(run))
    assert got == [brute_runs(t) for t in texts]


def test_runs_of_structured_words():
    rng = np.random.default_rng(3)
    fibonacci = [0], [0, 1]
    while len(fibonacci[1]) < 1500:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    block = rng.integers(0, 90, 210).tolist()
    cases = [fibonacci[1], [0] * 3000, block * 5 + block[:100] + [99] + block * 4, [0, 1] * 700 + [0] * 500, rng.integers(0, 2, 4000).tolist(),
             (([1, 2, 3] * 9 + [4]) * 40), [5]]
    owner, start, length, period = periodic_runs.find_runs([np.array(c, np.int64) for c in cases], 100)
    for k, c in enumerate(cases):
        mine = list(zip(start[owner == k].tolist(), length[owner == k].tolist(), period[owner == k].tolist()))
        assert mine == brute_runs(c), k


def test_cover_and_extensions():
    apart = {(a - b) % periodic_runs.MODULUS for a in periodic_runs.COVER for b in periodic_runs.COVER}
    assert apart == set(range(periodic_runs.MODULUS))
    words = np.append(np.tile([1, 2, 1, 3], 60), 7)
    held = periodic_runs.Extensions(words)
    places = np.flatnonzero(np.isin(np.arange(len(words)) % periodic_runs.MODULUS, periodic_runs.COVER))
    a, b = (x.ravel() for x in np.meshgrid(places, places))
    a, b = a[a != b], b[a != b]
    assert (held.lce(a, b) == periodic_runs.direct(words, a, b, len(words))).all()


def contract(doc, text):
    words = (text or "").split()
    n, h = len(words), zlib.crc32(str(doc).encode())
    if doc is not None and h % 10 == 0 and n > 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    digest = hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
    kept = hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()
    return (doc, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest, kept)


def test_periodic_runs_query(spark):
    path = new_path(spark)
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 50, rng.integers(0, 160)))) for i in range(150)]
    rows += [(200, None), (201, ""), (None, "a " * 30), (202, "b \n" * 500), (202, "b \n" * 500), (203, " \t\x0b")]
    table = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id bigint, text string, n_runs int")
    table.write.parquet(f"{path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op13_periodic_runs(spark, path).collect()), key=str)
    assert got == sorted((contract(*r) for r in rows), key=str)


def test_periodic_runs_other_columns(spark):
    table = spark.createDataFrame([(1, "a " * 40, 3, "y")], "doc_id bigint, start string, whole int, Runs string")
    row = periodic_runs.mark_runs(table, text="start").collect()[0]
    assert (row.doc_id, row.whole, row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (1, 3, 1, 0, 40, 1, 40_000)
    assert row.collapsed_text == "a" and [tuple(r) for r in row.runs] == [(0, 40, 1)]
    assert periodic_runs.mark_runs(table.limit(0), text="start").count() == 0
