"""Toxicity by a classifier chain of linear models over hashed words.

Categories are predicted one after another. The model of a later category also sees the probabilities of the
earlier ones; in training these are out-of-fold predictions, so a later model learns from probabilities as
good as those it will meet. Folds go by the hash of the text, so copies share a fold.

Bounded: the chain is fitted on at most `max_rows` labelled documents, those with the smallest hash of their id.
Each fold's fit is one task over that sample. Scoring covers every document; the models that travel to the tasks
have at most `MAX_FEATURES` weights for each category.

Defined cases: null and blank texts have no words and get the models' base rate; labels that are null are left out
of that category's fit; a category with one class only predicts its base rate; repeated ids in labels count each;
an empty label table rejects nothing; other columns pass through, and input columns with the names of results are
replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from trackgeo.llm.common import require_columns
from trackgeo.session import durable

DIMENSIONS = 1 << 22
MAX_ROWS = 20_000
MAX_FEATURES = 8_192
MIN_DOCUMENTS = 3
MIN_GAIN = 12.0  # of a word's chi-square statistic; below it words are chance
FOLDS = 5
PENALTY = 0.01
STEPS = 150
LETTERS = re.compile(r"[^\W_]+")


def features(text: str | None) -> np.ndarray:
    """Sorted distinct hashed words, case ignored."""
    words = set(LETTERS.findall(text.lower())) if text else ()
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(w) % DIMENSIONS for w in words), np.int64, len(words)))


def fit_linear(flat: np.ndarray, sizes: np.ndarray, extra: np.ndarray, y: np.ndarray) -> tuple:
    """Logistic model on word presence and `extra` columns: (words, weights, extra weights, bias)."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(rate / (1 - rate)))
    if not len(y) or y.min() == y.max():
        return np.empty(0, np.int64), np.empty(0), np.zeros(extra.shape[1]), bias
    row = np.repeat(np.arange(len(y)), sizes)
    words, place = np.unique(flat, return_inverse=True)
    seen = np.bincount(place, minlength=len(words))
    toxic = np.bincount(place, weights=y[row], minlength=len(words))
    # Words whose share of positives differs most from chance.
    expected = seen * y.mean()
    gain = (toxic - expected) ** 2 / (expected * (1 - y.mean()))
    gain[(seen < MIN_DOCUMENTS) | (gain < MIN_GAIN)] = 0
    best = np.sort(np.argsort(-gain, kind="stable")[:MAX_FEATURES])
    best = best[gain[best] > 0]
    new = np.full(len(words), -1)
    new[best] = np.arange(len(best))
    kept = new[place] >= 0
    row, place = row[kept], new[place][kept]
    n, k = len(y), len(best)
    w = np.zeros(k + extra.shape[1] + 1)
    w[-1] = bias
    scale = np.zeros_like(w)
    for _ in range(STEPS):  # full-batch gradient with per-weight step sizes
        z = np.bincount(row, weights=w[place], minlength=n) + extra @ w[k:-1] + w[-1]
        miss = 1 / (1 + np.exp(-z)) - y
        grad = np.concatenate([np.bincount(place, weights=miss[row], minlength=k), extra.T @ miss, [miss.sum()]])
        grad[:-1] += PENALTY * n / 1000 * w[:-1]
        scale += grad * grad
        w -= 0.5 * grad / np.sqrt(scale + 1e-9)
    return words[best], w[:k], w[k:-1], float(w[-1])


def predict(flat: np.ndarray, sizes: np.ndarray, extra: np.ndarray, model: tuple) -> np.ndarray:
    words, weights, more, bias = model
    z = np.full(len(sizes), bias) + extra @ more
    if len(words) and len(flat):
        at = np.minimum(np.searchsorted(words, flat), len(words) - 1)
        value = np.where(words[at] == flat, weights[at], 0.0)
        z += np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=value, minlength=len(sizes))
    return 1 / (1 + np.exp(-z))


def sample(docs: DataFrame, labels: DataFrame, categories: list[str], key: str, text: str, max_rows: int) -> DataFrame:
    """(row, fold, words, one column of 0/1 per category) of the labelled sample."""
    few = labels.select(F.col(key).alias("_id"), *categories).dropna(subset=["_id"]).orderBy(
        F.xxhash64("_id"), "_id").limit(max_rows)
    met = docs.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{text}`").alias("_text")).join(
        F.broadcast(few), "_id")  # max_rows ids at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [features(t.as_py()).tolist() for t in batch.column("_text")]
            columns = [batch.column(c).cast(pa.float64()) for c in categories]
            yield pa.RecordBatch.from_arrays(
                [batch.column("fold"), pa.array(words, pa.list_(pa.int64())), *columns], names=["fold", "words", *categories])

    folded = met.withColumn("fold", F.pmod(F.xxhash64("_text"), F.lit(FOLDS)))
    schema = "fold bigint, words array<bigint>, " + ", ".join(f"`{c}` double" for c in categories)
    return durable(folded.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))


def fit_chain(docs: DataFrame, labels: DataFrame, categories: list[str], key: str = "doc_id", text: str = "text",
              max_rows: int = MAX_ROWS) -> list[tuple]:
    """One linear model per category, in order; each also weighs the earlier categories' probabilities."""
    rows = sample(docs, labels, categories, key, text, max_rows)
    models = []
    for nth, category in enumerate(categories):
        earlier = [f"_p{i}" for i in range(nth)]

        def fit(group: pd.DataFrame) -> pd.DataFrame:
            held = int(group["part"].iat[0])
            words = [np.asarray(x, np.int64) for x in group["words"]]
            extra = group[earlier].to_numpy(float) if earlier else np.zeros((len(group), 0))
            y = group[category].to_numpy(float)

            def cut(mask: np.ndarray) -> tuple:
                some = [words[i] for i in np.flatnonzero(mask)]
                return (np.concatenate([np.empty(0, np.int64), *some]), np.array([len(x) for x in some], int), extra[mask])

            out = (group["fold"] == held).to_numpy()
            model = fit_linear(*cut(~out & ~np.isnan(y)), y[~out & ~np.isnan(y)])
            shown = pd.DataFrame({"row": group["row"][out], "p": predict(*cut(out), model) if out.any() else []})
            for name in ("words", "weights", "more"):
                shown[name] = None
            shown["bias"] = np.nan
            if held == FOLDS:  # no fold has this number: the model over all rows
                shown = pd.DataFrame({"row": [-1], "p": [np.nan], "words": [model[0]], "weights": [model[1]],
                                      "more": [model[2]], "bias": [model[3]]})
            return shown

        parts = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(FOLDS))))
        fitted = durable(parts.groupBy("part").applyInPandas(
            fit, "row bigint, p double, words array<bigint>, weights array<double>, more array<double>, bias double"))
        final = fitted.filter("row = -1").collect()  # one row, MAX_FEATURES weights at most
        models.append((np.array(final[0]["words"], np.int64), np.array(final[0]["weights"], float),
                       np.array(final[0]["more"], float), final[0]["bias"]) if final
                      else (np.empty(0, np.int64), np.empty(0), np.zeros(nth), -20.0))
        rows = rows.join(fitted.filter("row >= 0").select("row", F.col("p").alias(f"_p{nth}")), "row")
    return models


def score_chain(docs: DataFrame, models: list[tuple], categories: list[str], text: str = "text") -> DataFrame:
    """`docs` with one probability `p_<category>` per category and `rejected`: the last one is 0.5 or more."""
    from pyspark.sql.pandas.types import to_arrow_schema

    require_columns(docs, text)
    names = [f"p_{c}" for c in categories]
    rest = [c for c in docs.columns if c.lower() not in (*[n.lower() for n in names], "rejected")]
    fields = [StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(rest)]
    schema = StructType([*fields, *[StructField(n, DoubleType()) for n in names], StructField("rejected", BooleanType())])
    target, at = to_arrow_schema(schema), rest.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 500):
                batch = whole.slice(begin, 500)
                words = [features(t.as_py()) for t in batch.column(at)]
                flat = np.concatenate([np.empty(0, np.int64), *words])
                sizes = np.array([len(x) for x in words], int)
                extra = np.zeros((len(words), 0))
                for model in models:
                    extra = np.column_stack([extra, predict(flat, sizes, extra, model)])
                columns = [*batch.columns, *[pa.array(extra[:, i]) for i in range(len(models))], pa.array(extra[:, -1] >= 0.5)]
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    named = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)])
    return named.mapInArrow(run, schema).toDF(*rest, *names, "rejected")
