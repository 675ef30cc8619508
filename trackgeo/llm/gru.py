"""LM scoring: a gated recurrent network with class-factored output, in numpy, trained and applied by Spark tasks.

Counts: every word of the training documents is counted in Spark. The `VOCABULARY` most frequent words (the end of a
document among them) have outputs of their own, cut into classes of equal size; all other words fall into tail
classes by their last two bytes. p(word) = p(class | state) p(word | class, state); within a tail class a word has its
smoothed share (c + 1) / (N + V + 1) of that class, which any unseen word gets too.

Training: all training documents, once, in `ROUNDS` rounds. In a round each task runs truncated backpropagation over
its share, from the common parameters; the parameters are then averaged by tokens, summed in Spark slice by
slice. Documents run side by side in streams; state is carried over windows within a document and reset at its
end, so scores are those of complete documents.

Texts are cut into words twice: for the counts, then into a written table of 16-bit numbers, from which all rounds and the
scores are taken. Counts of words that are not among the `KNOWN` most frequent meet the documents by a join, so nothing that grows with
the corpus is broadcast: tasks get the parameters and `KNOWN` counts at most.

Defined cases: null and blank texts are the end alone; null ids hash as the empty text (remainder 0: trained on);
repeated rows count each; without training documents all counts are zero and every base score is 0, and the model
stays as it began; extra columns are not carried.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackgeo.llm.common import no_cycles, require_columns
from trackgeo.session import durable

END = b"\n"  # no word holds white space
VOCABULARY, CLASS_SIZE, TAIL_CLASSES, HIDDEN = 1024, 32, 16, 8
KNOWN = 50_000
ROUNDS, WINDOW, STREAMS, RATE = 3, 16, 256, 0.05
SLICES = 16
BATCH_TOKENS, ENCODE_TOKENS = 2_000_000, 500_000
FOLDS, HELD_OUT = 7, 2


def tokens_of(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAIL_CLASSES


def fold() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


# --- network -----------------------------------------------------------------------------------------

class Network:
    """Parameters as one flat vector; inputs and outputs are vocabulary words and then tail classes."""

    def __init__(self, words: int, flat: np.ndarray | None = None):
        self.words, self.classes = words, -(-words // CLASS_SIZE)
        inputs, out, h = words + TAIL_CLASSES + 1, self.classes + TAIL_CLASSES, HIDDEN
        shapes = {"E": (inputs, 3 * h), "U": (h, 3 * h), "C": (h, out), "c": (out,), "W": (h, self.classes * CLASS_SIZE),
                  "w": (self.classes * CLASS_SIZE,)}
        size = sum(int(np.prod(s)) for s in shapes.values())
        self.flat = np.zeros(size, np.float32) if flat is None else flat.astype(np.float32)
        at = 0
        for name, shape in shapes.items():
            n = int(np.prod(shape))
            setattr(self, name, self.flat[at:at + n].reshape(shape))
            at += n

    @classmethod
    def initial(cls, counts: np.ndarray, tail: np.ndarray) -> Network:
        """State weights small and random (fixed seed); output biases at the logarithms of the counts."""
        net, rng = cls(len(counts)), np.random.default_rng(20_26)
        net.E[:] = rng.normal(0, 0.1, net.E.shape)
        net.U[:] = rng.normal(0, 1 / np.sqrt(HIDDEN), net.U.shape)
        padded = np.zeros(net.classes * CLASS_SIZE)
        padded[:len(counts)] = counts + 1
        mass = np.append(padded.reshape(net.classes, CLASS_SIZE).sum(1), tail + 1)
        net.c[:] = np.log(mass / mass.sum())
        net.w[:] = np.where(padded > 0, np.log(np.maximum(padded, 1)), -30)
        return net

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple:
        """One step of all streams; x numbers the inputs. States lie unit by unit in memory, so gates are whole rows."""
        e, u = self.E[x].T, self.U.T @ h.T
        gates = u[:2 * HIDDEN] + e[:2 * HIDDEN]
        gates = np.reciprocal(1 + np.exp(-gates, out=gates), out=gates)
        z, r, un = gates[:HIDDEN], gates[HIDDEN:], u[2 * HIDDEN:]
        n = r * un
        n += e[2 * HIDDEN:]
        np.tanh(n, out=n)
        new = h.T - n
        new *= z
        new += n
        return new.T, (x, h, z, r, n, un)

    def outputs(self, h: np.ndarray, y: np.ndarray, gradients: bool = False):
        """Natural log probabilities of outputs `y` after states `h`; with gradients, also those of the loss."""
        ht, rows = np.ascontiguousarray(h.T), np.arange(len(y))
        klass = np.where(y < self.words, y // CLASS_SIZE, self.classes + y - self.words)
        p = self.C.T @ ht
        p += self.c[:, None]
        p -= p.max(axis=0)
        logp = p[klass, rows]
        np.exp(p, out=p)
        total = p.sum(axis=0)
        logp -= np.log(total)
        own = np.flatnonzero(y < self.words)  # words with outputs of their own, class by class
        own = own[np.argsort(klass[own].astype(np.uint16), kind="stable")]
        kinds, first = np.unique(klass[own], return_index=True)
        spans = [(slice(k * CLASS_SIZE, (k + 1) * CLASS_SIZE), slice(i, j)) for k, i, j in zip(kinds, first, np.append(first[1:], len(own)))]
        hs, q = ht[:, own], np.empty((CLASS_SIZE, len(own)), np.float32)
        for span, at in spans:
            np.matmul(self.W[:, span].T, hs[:, at], out=q[:, at])
            q[:, at] += self.w[span, None]
        q -= q.max(axis=0)
        place = y[own] % CLASS_SIZE, np.arange(len(own))
        inner = q[place]
        np.exp(q, out=q)
        within = q.sum(axis=0)
        logp[own] += inner - np.log(within)
        if not gradients:
            return logp
        p /= total
        p[klass, rows] -= 1
        q /= within
        q[place] -= 1
        dh, part = self.C @ p, np.empty_like(hs)
        g = {"C": ht @ p.T, "c": p.sum(axis=1), "W": np.zeros_like(self.W), "w": np.zeros_like(self.w)}
        for span, at in spans:
            np.matmul(self.W[:, span], q[:, at], out=part[:, at])
            g["W"][:, span] = hs[:, at] @ q[:, at].T
            g["w"][span] = q[:, at].sum(axis=1)
        dh[:, own] += part
        return logp, dh.T, g

    def backward(self, kept: list[tuple], carry: np.ndarray, dh: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of inputs and state weights through one window; `carry` masks states that were carried."""
        streams, d_all = len(carry[0]), np.ascontiguousarray(dh.T)
        pre = np.empty((3 * HIDDEN, streams * len(kept)), np.float32)
        rec, back = np.empty_like(pre), np.zeros((HIDDEN, streams), np.float32)
        for t in range(len(kept) - 1, -1, -1):
            _, h, z, r, n, un = kept[t]
            at = slice(t * streams, (t + 1) * streams)
            d = d_all[:, at] + back
            keep = d * z
            dn = (d - keep) * (1 - n * n)
            pre[:HIDDEN, at] = (h.T - n) * keep * (1 - z)
            dr = dn * r
            rec[2 * HIDDEN:, at] = dr
            pre[HIDDEN:2 * HIDDEN, at] = dr * (1 - r) * un
            pre[2 * HIDDEN:, at] = dn
            rec[:2 * HIDDEN, at] = pre[:2 * HIDDEN, at]
            back = (keep + self.U @ rec[:, at]) * carry[t]
        x = np.concatenate([k[0] for k in kept])
        order = np.argsort(x.astype(np.uint16) if len(self.E) < 65536 else x, kind="stable")
        x = x[order]
        first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        g = np.zeros_like(self.E)
        g[x[first]] = np.add.reduceat(np.ascontiguousarray(pre.T)[order], first, axis=0)
        return {"E": g, "U": np.concatenate([k[1].T for k in kept], axis=1) @ rec.T}


def streams_of(docs: list[np.ndarray], streams: int) -> tuple[np.ndarray, np.ndarray]:
    """(steps x streams) of outputs and document numbers, -1 where a stream is done; longest documents first."""
    import heapq

    ends, lines = [(0, s) for s in range(streams)], [[] for _ in range(streams)]
    for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
        end, s = heapq.heappop(ends)
        lines[s].append(i)
        heapq.heappush(ends, (end + len(docs[i]), s))
    steps = max(e for e, _ in ends)
    y, doc = np.full((steps, streams), -1, np.int32), np.full((steps, streams), -1, np.int32)
    for s, line in enumerate(lines):
        if line:
            run = np.concatenate([docs[i] for i in line])
            y[:len(run), s] = run
            doc[:len(run), s] = np.repeat(line, [len(docs[i]) for i in line])
    return y, doc


def walk(net: Network, docs: list[np.ndarray], streams: int, train: bool, memory: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """Log probability of each document; with `train`, the parameters move after every window."""
    y, doc = streams_of(docs, streams)
    score = np.zeros(len(docs))
    h, before = np.zeros((streams, HIDDEN), np.float32, order="F"), np.arange(streams)
    start = net.words + TAIL_CLASSES  # the input before the first word
    fresh = np.ones_like(doc, bool)
    fresh[1:] = doc[1:] != doc[:-1]
    x = np.full_like(y, start)
    x[1:][~fresh[1:]] = y[:-1][~fresh[1:]]
    x[x < 0] = start
    for at in range(0, len(y), WINDOW):
        window = slice(at, min(at + WINDOW, len(y)))
        open_streams = np.flatnonzero(y[at] >= 0)  # a stream that is done costs nothing more
        if len(before) != len(open_streams):
            h = np.asfortranarray(h[np.searchsorted(before, open_streams)])
            before = open_streams
        wx, wy, wdoc = x[window, open_streams], y[window, open_streams], doc[window, open_streams]
        carried = (~fresh[window, open_streams]).astype(np.float32)
        kept, states = [], []
        for t in range(len(wx)):
            h, trace = net.step(wx[t], h * carried[t][:, None])
            kept.append(trace)
            states.append(h)
        live = np.flatnonzero(wy.ravel() >= 0)
        states = np.concatenate(states)
        if train:
            _, part, g = net.outputs(states[live], wy.ravel()[live], gradients=True)
            dh = np.zeros_like(states)
            dh[live] = part
            g |= net.backward(kept, carried, dh)
            rate = RATE * 0.1 * len(live) / (streams * WINDOW)  # a few last streams do not outweigh the rest
            for name, value in g.items():
                value /= max(1, len(live))
                held = memory[name]
                held *= 0.95
                held += 0.05 * value * value
                getattr(net, name)[...] -= rate * value / (np.sqrt(held) + 1e-4)
        else:
            logp = net.outputs(states[live], wy.ravel()[live])
            score += np.bincount(wdoc.ravel()[live], weights=logp, minlength=len(docs))
    return score


def memory_of(net: Network) -> dict[str, np.ndarray]:
    return {name: np.zeros_like(getattr(net, name)) for name in ("E", "U", "C", "c", "W", "w")}


# --- Spark -------------------------------------------------------------------------------------------

def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all of `docs`; each task adds up its own words first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])
            counts.clear()
            return out

        for batch in batches:
            with no_cycles():
                for text in batch.column(0):
                    counts.update(tokens_of(text.as_py()))
            if len(counts) > 400_000:
                yield flush()
        if counts:
            yield flush()

    return docs.select("text").mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def frequent_words(counts: DataFrame) -> dict[bytes, int]:
    """Counts of at most `KNOWN` words, all those of the most frequent bands of counts; the end is always among them.

    Bands are a 64th of a doubling (single counts below 46). Their sizes come to the driver, then the words of the bands
    that fit as a whole, so what it gets does not grow with the corpus or its partitions.
    """
    band = F.floor(F.log2("c") * 64)
    words = counts.filter(F.col("word") != F.lit(END))
    sizes = sorted(words.groupBy(band.alias("band")).count().collect(), reverse=True)  # at most 64 x 63 bands
    total, least = 0, None
    for at, n in sizes:
        total += n
        if total > KNOWN:
            break
        least = at
    top = words.filter(band >= least).collect() if least is not None else []
    ends = counts.filter(F.col("word") == F.lit(END)).first()
    known = {bytes(r["word"]): r["c"] for r in top} | {END: ends["c"] if ends else 0}
    return dict(sorted(known.items(), key=lambda w: (-w[1], w[0])))


class Numbers(dict):
    """Numbers of the known words; any other word gets the next free number when it is first met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


ENCODED = ("fold bigint, turn bigint, doc_id bigint, n_tokens bigint, known bigint, logs double, tail_logs double, ids binary, "
           "rare array<struct<word:binary,n:int>>")


def encode(source: DataFrame, known: dict[bytes, int], modelled: np.ndarray) -> DataFrame:
    """Each text cut into words once: 16-bit numbers, what the known counts say of it, and its rare words with their times.

    A number is the rank of a known word; other words are 65,535 less their tail class.
    """
    sent = source.sparkSession.sparkContext.broadcast((known, modelled))  # KNOWN words at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, modelled = sent.value
        words = Numbers(zip(known, range(len(known))))
        c = np.fromiter(known.values(), np.int64, len(known))
        for rows, texts in _batches(batches, ENCODE_TOKENS):
            with no_cycles():
                whole = one(words, np.log(c + 1.0), c > 0, modelled, rows, texts)
            for at in range(0, whole.num_rows, 1000):
                yield whole.slice(at, 1000)

    def one(words, logs, seen, modelled, rows, texts) -> pa.RecordBatch:
        k, sizes = len(logs), np.fromiter(map(len, texts), np.int64, len(texts))
        ids = np.fromiter(map(words.__getitem__, chain.from_iterable(texts)), np.int64, sizes.sum())
        rare = list(islice(words, k, None))
        for word in rare:
            del words[word]
        doc = np.repeat(np.arange(len(texts)), sizes)
        is_rare = ids >= k
        pairs, times = np.unique(doc[is_rare] * np.int64(len(rare) or 1) + ids[is_rare] - k, return_counts=True)
        per_doc = np.bincount(pairs // (len(rare) or 1), minlength=len(texts))
        at = pairs % (len(rare) or 1)
        entries = pa.StructArray.from_arrays(
            [pa.array(rare, pa.binary()).take(pa.array(at)), pa.array(times, pa.int32())], ["word", "n"])
        logs, seen = np.append(logs, 0.0), np.append(seen, False)
        flat = np.minimum(ids, k)
        sums = lambda v: pa.array(np.bincount(doc, weights=v, minlength=len(texts)))
        numbers = np.concatenate([np.arange(k), 65_535 - np.fromiter(map(tail_class, rare), np.int64, len(rare))])
        stored = numbers[ids].astype("<u2").tobytes()
        ends = 2 * np.concatenate([[0], np.cumsum(sizes)])
        columns = [pa.array(v, pa.int64()) for v in zip(*rows)] + [
            pa.array(sizes), sums(seen[flat]).cast(pa.int64()), sums(logs[flat]), sums(logs[flat] * ~np.append(modelled, False)[flat]),
            pa.array([stored[i:j] for i, j in zip(ends[:-1], ends[1:])], pa.binary()),
            pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_doc)]), pa.int32()), entries)]
        return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in ENCODED.split(", ")])

    turn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS))
    return source.select(fold().alias("fold"), turn.alias("turn"), "doc_id", "text").mapInArrow(run, ENCODED)


def _batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Documents with their tokens, about `most` tokens at a time."""
    rows, held, size = [], [], 0
    for batch in batches:
        for row in zip(*[batch.column(i) for i in range(batch.num_columns)]):
            words = tokens_of(row[-1].as_py())
            rows.append([v.as_py() for v in row[:-1]])
            held.append(words)
            size += len(words)
            if size >= most:
                yield rows, held
                rows, held, size = [], [], 0
    if held:
        yield rows, held


def _arrays(batches: Iterator[pa.RecordBatch], outputs: np.ndarray) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Encoded documents with their numbers as outputs of the network, `BATCH_TOKENS` or a little more at a time."""
    held, docs, size = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            part = batch.slice(at, 100)
            held.append(part)
            docs += [outputs[np.frombuffer(x.as_py(), "<u2")] for x in part.column("ids")]
            size += sum(map(len, docs[-part.num_rows:]))
            if size >= BATCH_TOKENS:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0], docs
                held, docs, size = [], [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0], docs


def train_round(docs: DataFrame, flat: np.ndarray, outputs: np.ndarray, words: int) -> np.ndarray:
    """Parameters after one round over encoded `docs`, averaged over tasks by tokens."""
    sent = docs.sparkSession.sparkContext.broadcast((flat, outputs, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, outputs, words = sent.value
        net = Network(words, start)
        memory, seen = memory_of(net), 0
        for _, some in _arrays(batches, outputs):
            seen += sum(map(len, some))
            walk(net, some, min(STREAMS, len(some)), True, memory)
        if seen:
            parts = np.array_split(net.flat.astype(np.float64) * seen, SLICES)
            salt = zlib.crc32(np.float64(seen).tobytes() + net.c.tobytes()) % 64
            yield pa.RecordBatch.from_arrays([
                pa.array(range(SLICES)), pa.array([salt] * SLICES), pa.array([float(seen)] * SLICES), pa.array([p.tobytes() for p in parts])],
                names=["slice", "salt", "weight", "total"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(group["total"].iat[0]) // 8)
        for x in group["total"]:
            total += np.frombuffer(x)
        return pd.DataFrame({"slice": [group["slice"].iat[0]], "salt": [0], "weight": [group["weight"].sum()], "total": [total.tobytes()]})

    schema = "slice bigint, salt bigint, weight double, total binary"
    shares = docs.select("ids").mapInArrow(run, schema)
    salted = shares.groupBy("slice", "salt").applyInPandas(add, schema)
    rows = sorted(salted.groupBy("slice").applyInPandas(add, schema).collect(), key=lambda r: r["slice"])  # SLICES rows
    if not rows:
        return flat
    return np.concatenate([np.frombuffer(r["total"]) / r["weight"] for r in rows]).astype(np.float32)


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, in log10."""
    require_columns(docs, key, text)
    source = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    spark = docs.sparkSession
    training = source.filter(fold() != HELD_OUT)
    counts = durable(word_counts(training))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    known = frequent_words(counts)
    model = list(known)[:VOCABULARY]
    if END not in model:
        model = [*model[:VOCABULARY - 1], END]
    words = {w: i for i, w in enumerate(model)}
    tails = {r["t"]: (r["n"], r["v"]) for r in counts.groupBy(F.pmod(
        F.crc32(F.substring("word", -2, 2)), F.lit(TAIL_CLASSES)).alias("t")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    tail_n = np.array([tails.get(t, (0, 0))[0] for t in range(TAIL_CLASSES)], float)
    tail_v = np.array([tails.get(t, (0, 0))[1] for t in range(TAIL_CLASSES)], float)
    for w in model:  # the model's own words leave the tail
        tail_n[tail_class(w)] -= known[w]
        tail_v[tail_class(w)] -= known[w] > 0
    flat = Network.initial(np.array([known[w] for w in model], float), tail_n).flat
    outputs = np.arange(65_536)[::-1] + len(words)  # of every number; the last ones are tail classes
    outputs[:len(known)] = [words[w] if w in words else len(words) + tail_class(w) for w in known]
    encoded = durable(encode(source, known, np.array([w in words for w in known])).withColumn("_row", F.monotonically_increasing_id()))
    for i in range(ROUNDS):
        flat = train_round(encoded.filter((F.col("fold") != HELD_OUT) & (F.col("turn") == i)), flat, outputs, len(words))
    sent = spark.sparkContext.broadcast((flat, outputs, len(words), np.log(tail_n + tail_v + 1)))
    scored = encoded.drop("rare", "turn").mapInArrow(
        _score(sent), "_row bigint, fold bigint, doc_id bigint, n_tokens bigint, known bigint, logs double, net double")
    rare = encoded.select("_row", F.explode("rare").alias("r")).select("_row", "r.word", "r.n").join(counts, "word").groupBy(
        "_row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log(F.col("c") + 1)).alias("more_logs"))
    ten = float(np.log(10))
    return scored.join(rare, "_row", "left").na.fill({"more": 0, "more_logs": 0.0}).select(
        "doc_id", (F.col("fold") == HELD_OUT).alias("held_out"), "n_tokens", (F.col("known") + F.col("more")).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        ((F.col("logs") + F.col("more_logs") - F.col("n_tokens") * float(np.log(total + distinct + 1))) / ten).alias("base_score"),
        ((F.col("net") + F.col("more_logs")) / ten).alias("score"))


def _score(sent):
    """The network's share of the score of every encoded text, with its tail words by their share of their class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, outputs, n_words, shares = sent.value
        net = Network(n_words, flat)
        for batch, docs in _arrays(batches, outputs):
            score = walk(net, docs, min(STREAMS, len(docs)), False)
            score -= [shares[y[y >= n_words] - n_words].sum() for y in docs]
            score += batch.column("tail_logs").to_numpy()
            names = ["_row", "fold", "doc_id", "n_tokens", "known", "logs"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(score)], names=[*names, "net"])

    return run
