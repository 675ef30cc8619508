"""The training-data operators against brute force, and their defined cases."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trackgeo.llm import (
    chat, components, decontaminate, gru, packing, quality, queries, similar_sets, simhash, substrings, token_scan, toxicity, url_filters)
from trackgeo.session import new_path

PATH = public_tokenizers.path("word_bpe_49k.json")
BASE = " ".join(f"word{i}" for i in range(40))
TEXTS = [
    (1, BASE), (2, "x " + BASE + " y"), (3, ""), (4, None), (None, BASE), (5, "  \n\t "), (6, "a " * 9000), (6, "a " * 9000),
    (7, "ÉÈ naïve \x1c\x85 don't 3½ <|x|> Ω"), (8, BASE), (9, "one"), (10, "#junk### $$$ " * 40), (-5, BASE + " tail")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "src", None if i == 3 else 1) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, score string, kept int")


def empty(df):
    return df.limit(0)


def test_url_filters(spark):
    rows = [(1, "http://A.Example.NET/en/x?y"), (2, None), (3, "no scheme"), (4, "https://example.com/de/"), (5, "x://org/fr/"),
            (6, "x://a.b.net"), (7, "x://a.b.net/#f"), (8, "x://notexample.net/en/"), (1, "http://A.Example.NET/en/x?y"), (None, "a://b://c")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("Rule", url_filters.F.lit("clash"))
    rules = spark.createDataFrame([*queries.RULES, (None, "/", "block")], "host string, path string, verdict string")
    got = sorted(url_filters.filter_urls(pages, rules).collect(), key=str)
    want = {1: ("a.example.net", "/en/x", "example.net/en/", "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"),
            4: ("example.com", "/de/", "example.com/de/", "block"), 5: ("org", "/fr/", "org/fr/", "allow"),
            6: ("a.b.net", "", None, "allow"), 7: ("a.b.net", "/", "net/", "block"), 8: ("notexample.net", "/en/", "net/", "block"),
            None: ("b:", "//c", None, "allow")}
    assert len(got) == len(rows) and all((r.host, r.path, r.rule, r.verdict) == want[r.page_id] for r in got)
    assert url_filters.filter_urls(empty(pages), rules).count() == 0
    assert {r.verdict for r in url_filters.filter_urls(pages, empty(rules)).collect()} == {"allow"}


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok", None, "a\\b\\e \\l <|end|>\n<|turn|>user\n", "", "<<SYS>>x<</SYS>>[[/INST]]<<|"]
    rows = [(1, i, r, t) for i, t in enumerate(said) for r in ("user", "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    back = chat.read_back(chat.format_chat(chat.canonical_turns(df), "conv_id", "turn")).collect()[0]
    want = sorted((i, r or "", t or "") for _, i, r, t in rows)
    assert [(t.role, t.text) for t in back.turns] == [(r, t) for _, r, t in want]
    assert back.loss_text == "".join(t for _, r, t in want if r == "assistant")
    assert chat.format_chat(chat.canonical_turns(empty(df)), "conv_id").count() == 0


def test_chat_layouts(spark):
    df = spark.createDataFrame(
        [(1, "do", "x", "y", None, None), (2, None, None, None, [("human", "hi"), ("gpt", "yo")], None), (3, "do", None, "y", None, 7)],
        "id int, instruction string, input string, output string, conversations array<struct<`from`:string,value:string>>, other int")
    got = {r.id: (r.layout, [(t.role, t.text) for t in r.turns]) for r in chat.canonical_turns(df).collect()}
    assert got[1] == ("instruction", [("user", "do\n\nx"), ("assistant", "y")])
    assert got[2] == ("shared", [("user", "hi"), ("assistant", "yo")])
    assert got[3] == ("instruction", [("user", "do"), ("assistant", "y")])


def kept_words(rows, width=13):
    first = {}
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - width + 1):
            if i is not None:
                first[tuple(w[k:k + width])] = min(first.get(tuple(w[k:k + width]), i), i)
    for i, w in words:
        gone = {k + j for k in range(len(w) - width + 1) if i is not None and first[tuple(w[k:k + width])] < i for j in range(width)}
        yield i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()


def test_substrings(docs):
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substrings.dedup_substrings(docs).collect()), key=str)
    assert got == sorted(kept_words(TEXTS), key=str)
    assert substrings.dedup_substrings(empty(docs)).count() == 0


def test_substrings_many_groups(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BATCH_WINDOWS", 300)
    monkeypatch.setattr(substrings, "GROUP_WINDOWS", 200)
    rng = np.random.default_rng(1)
    parts = [" ".join(f"p{k}w{i}" for i in range(50)) for k in range(4)]
    rows = [(int(rng.choice([i, -i, i * 10**12])), " ".join([*(f"r{x}" for x in rng.integers(0, 90, rng.integers(0, 40))), parts[i % 4]]))
            for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substrings.dedup_substrings(df).collect())
    assert got == sorted(kept_words(rows))


def test_toxicity(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join([*(f"w{x}" for x in rng.integers(0, 300, 60)), *(["vile"] if i % 4 == 0 else [])])) for i in range(400)]
    df = spark.createDataFrame([*rows, (None, None), (900, "")], "doc_id bigint, text string").withColumn("rejected", toxicity.F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 4 == 0)) for i in range(0, 400, 2)], "doc_id bigint, junk int, toxic int")
    models = toxicity.fit_chain(df, labels, ["junk", "toxic"])
    got = toxicity.score_chain(df, models, ["junk", "toxic"]).collect()
    assert len(models[1][2]) == 1 and len(got) == 402
    held = [r for r in got if r.doc_id is not None and r.doc_id % 2 and r.doc_id < 400]
    assert not any(r.rejected for r in held)  # odd ids are never toxic here
    assert all(r.rejected == (r.doc_id % 4 == 0) for r in got if r.doc_id is not None and r.doc_id < 400)
    assert not any(r.rejected for r in got if r.doc_id in (None, 900))
    nothing = toxicity.fit_chain(df, empty(labels), ["junk", "toxic"])
    assert not any(r.rejected for r in toxicity.score_chain(df, nothing, ["junk", "toxic"]).collect())


def test_quality(spark, docs):
    trusted = spark.createDataFrame([(1,), (2,), (None,)], "doc_id bigint")
    got = quality.judge_quality(docs, trusted).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        text = r.text or ""
        w = text.encode().split()
        seen = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        repeat = {i + j for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat))
        assert r.base_failed == (len(w) < 50 or 100 * len(repeat) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality.judge_quality(empty(docs), trusted).count() == 0


def test_quality_ratios(spark):
    """Log ratios as counted in Python with the same hash."""
    import xxhash

    def h(words, seed=42):
        for w in words:
            seed = xxhash.xxh64_intdigest(w, seed)
        return (seed - (1 << 64) if seed >= 1 << 63 else seed) % quality.BUCKETS

    rows = [(i, " ".join(f"w{(i * j) % 37}" for j in range(60))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    trusted = spark.createDataFrame([(i,) for i in range(0, 20, 2)], "id bigint")
    grams = {i: [h([w]) for w in t.encode().split()] + [h(p) for p in zip(t.encode().split(), t.encode().split()[1:])] for i, t in rows}
    raw, target = Counter(b for g in grams.values() for b in g), Counter(b for i, g in grams.items() if i % 2 == 0 for b in g)
    r_all, t_all = sum(raw.values()), sum(target.values())

    def micro(b):
        share = (raw[b] + 1) / (r_all + quality.BUCKETS)
        return round(math.log((target[b] + quality.PRIOR * share) / (t_all + quality.PRIOR) / share) * 1e6)

    for r in quality.judge_quality(df, trusted).collect():
        assert abs(r.score - sum(map(micro, grams[r.doc_id])) / len(grams[r.doc_id]) / 1e6) < 2e-6


def test_quality_counts_all_trusted_documents(spark):
    """25,000 trusted documents of one word: its log ratio counts each of them."""
    df = spark.range(25_100).selectExpr("id AS doc_id", "if(id < 25000, 'good', 'bad') AS text")
    got = {r.text: r.score for r in quality.judge_quality(df, df.filter("doc_id < 25000").select("doc_id")).filter(
        "doc_id IN (7, 25050)").collect()}
    for word, raw, target in (("good", 25_000, 25_000), ("bad", 100, 0)):
        share = (raw + 1) / (25_100 + quality.BUCKETS)
        assert abs(got[word] - math.log((target + quality.PRIOR * share) / (25_000 + quality.PRIOR) / share)) < 1e-6


def test_token_scan(spark, docs, monkeypatch):
    path = new_path(spark)
    token_scan.write_token_files(docs.repartition(3), path, PATH)
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted(((i, len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in TEXTS), key=str)
    for block in (1 << 19, 1 << 6):
        monkeypatch.setattr(token_scan, "BLOCK", block)
        assert sorted(((r.doc_id, r.n_tokens) for r in token_scan.scan_token_files(spark, path).collect()), key=str) == want
    assert all(token_scan.read_spelt(np.frombuffer(token_scan.spell(x), np.uint16)) == x for x in (None, 0, -1, 2**63 - 1, -2**63, 49407))


def test_decontamination(spark):
    rng = np.random.default_rng(3)
    item = " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(30))
    edited = list(item)
    for k in range(5, 200, 20):  # 10 edits in 209 characters
        edited[k] = "Z"
    far = list(item)
    for k in range(0, 209, 4):
        far[k] = "Z"
    rows = [(1, "before " + item.upper().replace(" ", " \n ") + " after"), (2, "x " + "".join(edited) + " y"), (3, "".join(far)),
            (4, None), (5, ""), (None, item + " and " + item), (6, item[:100])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame([(9, item), (8, "short"), (7, None), (6, "")], "item_id bigint, text string")
    got = decontaminate.find_items(df, bench).collect()
    assert sorted(((r.doc_id, r.item_id, r.edits) for r in got), key=str) == sorted([(1, 9, 0), (2, 9, 10), (None, 9, 0), (None, 9, 0)], key=str)
    assert {(r.start, r.end) for r in got if r.doc_id == 1} == {(7, 7 + len(item))}
    assert decontaminate.find_items(df, empty(bench)).count() == 0
    small = decontaminate.find_items(df, bench.unionByName(bench), block_chars=10)
    assert small.count() == 8


def brute_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_decontamination_finds_all_within_budget(spark):
    rng = np.random.default_rng(4)
    letters = list("abcdefghij ")
    items = ["".join(rng.choice(letters, 120)).strip() for _ in range(4)]
    rows = []
    for n in range(60):
        s = list(" ".join(items[n % 4].split()))
        for _ in range(rng.integers(0, 22)):
            k = rng.integers(0, len(s))
            s[k:k + 1] = rng.choice(["x", "", "xy"])
        rows.append((n, "".join(rng.choice(letters, 50)) + "".join(s) + "".join(rng.choice(letters, 50))))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.find_items(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()}
    for n, text in rows:
        for i, item in enumerate(items):
            a, b = " ".join(item.split()), " ".join(text.split())
            d, k = brute_distance(a, b), min(int(0.1 * len(a)), (len(a) - 8) // 8)
            assert got.get((n, i)) == (d if d <= k else None)


def test_packing(spark, docs):
    tokenizer = Tokenizer.from_file(PATH)
    pieces = packing.pack(packing.tokenize(docs, PATH)).collect()
    want = Counter()
    for i, t in TEXTS:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            want[i, k // 2048, k, tuple(ids[k:k + 2048])] += 1
    assert Counter((r.doc_id, r.piece, r.start, tuple(np.frombuffer(r.ids, np.uint32).tolist())) for r in pieces) == want
    by: dict = {}
    for r in pieces:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(packing.tokenize(empty(docs), PATH)).count() == 0
    assert packing.sequences(packing.pack(packing.tokenize(docs, PATH))).count() == len(by)


def test_packing_plan():
    rng = np.random.default_rng(5)
    for top, n in ((2048, 3000), (600, 900), (2048, 5), (10, 400)):
        counts = Counter(rng.integers(1, top + 1, n).tolist())
        held = Counter()
        patterns = packing.plan(counts)
        for times, lengths in patterns:
            assert times > 0 and sum(lengths) <= 2048
            for x in lengths:
                held[x] += times
        assert held == counts
        total = sum(k * v for k, v in counts.items())
        assert sum(t for t, _ in patterns) <= 1.05 * total / 2048 + 2
    assert packing.plan(Counter({1500: 2, 548: 1, 300: 1, 248: 1})) == [(1, (1500, 548)), (1, (1500, 300, 248))]


def brute_components(prints, distance):
    label = np.arange(len(prints))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]).sum(-1) <= distance
    while True:
        new = np.where(near, label[None, :], len(prints)).min(1)
        if (new == label).all():
            return label
        label = new


def test_simhash(spark, docs):
    rows = docs.collect()
    prints = np.array([simhash.fingerprint(r.text, 3) for r in rows]).view(np.uint64)
    label = brute_components(prints, 2)
    known = [[r.doc_id for r, x in zip(rows, label) if x == i and r.doc_id is not None] for i in label]
    want = Counter((r.doc_id, int(p.view(np.int64)[0]), min(k) if k else None) for r, p, k in zip(rows, prints, known))
    got = Counter((r.doc_id, r.fingerprint[0], r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert simhash.near_duplicates(empty(docs)).count() == 0
    assert simhash.fingerprint("a b c", 3)[0] == spark.sql("select xxhash64('a b c')").first()[0]


@pytest.mark.parametrize("cell", [2, 64])
def test_simhash_links_are_complete(spark, monkeypatch, cell):
    """Also when nearly every anchor is crowded."""
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = np.random.default_rng(6)
    prints = [int(x) for x in rng.integers(0, 1 << 63, 30)]
    for _ in range(300):
        x = prints[rng.integers(0, len(prints))]
        for b in rng.choice(63, rng.integers(1, 4), replace=False):
            x ^= 1 << int(b)
        prints.append(x)
    prints = sorted(set(prints))
    nodes = spark.createDataFrame([(i, [x]) for i, x in enumerate(prints)], "node bigint, fingerprint array<bigint>").repartition(3)
    got = {r.node: r.component for r in components.components(simhash.links(nodes, 2)).collect()}
    label = brute_components(np.array(prints, np.uint64)[:, None], 2)
    assert [got.get(i, i) for i in range(len(prints))] == label.tolist()


@pytest.mark.parametrize("size, families, noise", [(1, 1, 0), (2, 2, 0), (300, 1, 45), (300, 4, 60), (200, 200, 0)])
def test_spanning_links_connect_all_pairs(size, families, noise):
    rng = np.random.default_rng(size + families)
    bits = rng.integers(0, 2, (families, 512), dtype=np.uint8)[np.arange(size) % families]
    for row in bits:
        row[rng.integers(0, 512, noise)] ^= 1
    prints = np.packbits(bits, axis=1).view(np.uint64)

    def classes(pairs):
        label = list(range(size))
        for a, b in pairs:
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = [new if x == old else x for x in label]
        return label

    apart = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2, dtype=int)
    assert classes(zip(*simhash.spanning(prints, 80))) == classes(np.argwhere(apart <= 80))


@pytest.mark.parametrize("cell", [2, 64])
def test_simhash_long_prints(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[:i * 7] + [f"z{i}"] + words[i * 7:])) for i in range(20)] + [
        (100 + i, " ".join(f"q{i}x{j}" for j in range(200))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = simhash.near_duplicates(df, shingle=5, bits=512, distance=80, chunk_bits=32, chunk_distance=2).collect()
    assert {r.component_id for r in got if r.doc_id < 100} == {0}
    assert all(r.component_id == r.doc_id for r in got if r.doc_id >= 100)


def alike_components(texts, width=5):
    """Components of all pairs at 0.8 or more, by brute force."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


@pytest.mark.parametrize("cell", [5, 64])
def test_similar_sets_link_all_pairs_at_the_limit_and_no_other(spark, monkeypatch, cell):
    """Texts around 0.8, in families with a common passage; also when nearly every shingle is crowded."""
    monkeypatch.setattr(similar_sets, "CELL", cell)
    rng = np.random.default_rng(11)
    passage = [f"p{i}" for i in range(9)]
    texts = ["", None, "one two", "ONE two", "one two three"]
    for f in range(6):
        base = [*(f"f{f}w{i}" for i in range(120 if f % 2 else 40)), *passage]
        for _ in range(20):
            words = list(base)
            for k in rng.choice(len(words), rng.integers(1, 6 if f % 2 else 3), replace=False):
                words[k] = f"x{rng.integers(0, 10**6)}"
            texts.append(" ".join(words))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in similar_sets.near_duplicates(df).collect()}
    assert [got[i] for i, _ in rows] == alike_components(texts)
    assert len(set(got.values())) > 12
    assert similar_sets.near_duplicates(empty(df)).count() == 0


def test_a_family_that_leaders_do_not_join_gives_few_pairs(spark, monkeypatch):
    """Two hundred texts, a third of all pairs at the limit: pairs to confirm grow with the texts, not with their square."""
    monkeypatch.setattr(similar_sets, "CELL", 8)
    rng, asked = np.random.default_rng(5), []
    texts = []
    for _ in range(200):
        words = [f"w{i}" for i in range(150)]
        for k in rng.choice(150, rng.integers(1, 6), replace=False):
            words[k] = f"x{rng.integers(0, 10**6)}"
        texts.append(" ".join(words))
    whole = similar_sets.confirmed
    monkeypatch.setattr(similar_sets, "confirmed", lambda pairs, *rest: asked.append(pairs.count()) or whole(pairs, *rest))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in similar_sets.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == alike_components(texts)
    assert max(asked[1:]) < 16 * len(texts)



def test_pipeline_near_copies_are_decided_by_the_shingles(spark):
    """80 of 90 shingles shared are 0.8 and a copy, 79 are not, whatever the fingerprints say."""
    import corpus_pipeline as p

    rows = []
    for f in range(30):
        words = [f"f{f}w{i}" for i in range(94)]  # 90 shingles
        changed = [f"f{f}y{i}" for i in range(11)]
        rows += [(3 * f, " ".join(words)), (3 * f + 1, " ".join(words[:84] + changed[:10])), (100 + f, f"a b only{f}")]
        rows += [(1000 + 2 * f, " ".join(f"n{w}" for w in words)), (1001 + 2 * f, " ".join([f"n{w}" for w in words[:83]] + changed))]
    got = p.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").select("doc_id").collect()
    gone = {i for i, _ in rows} - {r.doc_id for r in got}
    assert gone == {i for i, _ in rows if i % 3 == 1 and i < 90}


def test_components_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(5, 5), (90, 80), (3, 1)], "a bigint, b bigint")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 80: 80, 90: 80}


def test_gru_base_and_model(spark, monkeypatch):
    monkeypatch.setattr(gru, "KNOWN", 20)
    monkeypatch.setattr(gru, "VOCABULARY", 10)
    rng = np.random.default_rng(7)
    rows = [(i, " ".join("AB cd ef".split() * rng.integers(1, 9)) + f" r{rng.integers(0, 60)}") for i in range(300)]
    rows += [(None, None), (301, ""), (301, ""), (302, "x " * 3000)]
    got = gru.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    remainder = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7
    c = Counter(w for i, t in rows if remainder(i) != 2 for w in gru.tokens_of(t))
    n, v = sum(c.values()), len(c)
    want = Counter((i, remainder(i) == 2, len(gru.tokens_of(t)), sum(w in c for w in gru.tokens_of(t)), n,
                    round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in gru.tokens_of(t)), 6)) for i, t in rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # context helps on texts not trained on


def test_gru_gradient():
    """Backpropagation against differences of the loss."""
    rng = np.random.default_rng(8)
    net = gru.Network.initial(np.ones(40), np.ones(gru.TAIL_CLASSES))
    net.C[:] = rng.normal(0, 0.3, net.C.shape)
    net.W[:] = rng.normal(0, 0.3, net.W.shape)
    x, y = rng.integers(0, 40, (4, 3)), rng.integers(0, 50, (4, 3))
    carry = np.ones((4, 3), np.float32)
    carry[2, 1] = 0

    def loss(gradients=False):
        h, kept, states = np.zeros((3, gru.HIDDEN), np.float32), [], []
        for t in range(4):
            h, trace = net.step(x[t], h * carry[t][:, None])
            kept.append(trace)
            states.append(h)
        out = net.outputs(np.concatenate(states), y.ravel(), gradients)
        return (out[2] | net.backward(kept, carry, out[1])) if gradients else -out.astype(float).sum()

    g = loss(True)
    for name in ("E", "U", "C", "c", "W", "w"):
        flat, grad = getattr(net, name).reshape(-1), g[name].reshape(-1)
        for i in np.argsort(-np.abs(grad))[:4]:
            old = flat[i]
            flat[i] = old + 0.01
            up = loss()
            flat[i] = old - 0.01
            down = loss()
            flat[i] = old
            assert abs((up - down) / 0.02 - grad[i]) < 0.02 * max(1, abs(grad[i])), name


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    rng = np.random.default_rng(9)
    clean = [" ".join(f"c{x}" for x in rng.integers(0, 10**6, 80)) for _ in range(12)]
    item = " ".join(f"b{x}" for x in rng.integers(0, 10**6, 30))
    rows = [(i, t) for i, t in enumerate(clean)] + [(20, clean[0]), (21, clean[1] + " more"), (22, clean[2] + " " + item), (None, None), (23, "")]
    bad = [(50 + i, " ".join(f"c{x}" for x in rng.integers(0, 10**6, 30)) + " vile") for i in range(12)]
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows + bad], "doc_id bigint, text string, n_chars bigint")
    folder = str(tmp_path)
    spark.createDataFrame([(i, 1, int(i >= 50)) for i, _ in rows + bad if i is not None], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    ids = []
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, df, folder)
        if k < 4:
            assert out.columns == df.columns
        out.write.parquet(f"{folder}/{k}")
        df = spark.read.parquet(f"{folder}/{k}")
        ids.append({r.doc_id for r in df.select("doc_id").collect()})
    assert not ids[0] & set(range(50, 70)) and ids[0] >= set(range(12)) | {20, 21, 22, 23, None}
    assert ids[1] == ids[0] - {20, 21} and ids[2] == ids[1] and ids[3] == ids[2] - {22} and ids[4] == ids[3]
    assert p.STAGES[0][1](spark, df.limit(0).select("doc_id").withColumn("text", quality.F.lit("")), folder).count() == 0
